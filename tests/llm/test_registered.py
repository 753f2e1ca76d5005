"""The registered queries that SQL does not express: their columns against plain versions on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quire.llm.queries import QUERIES, _tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(spark, sf_dir, name, columns):
    got = QUERIES[name](spark, sf_dir)
    assert got.columns[: len(columns)] == columns
    out = got.collect()
    return {r["doc_id"]: r for r in out}, len(out)


def test_op1(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_tokenizer())
    got, n = by_id(spark, sf_dir, "op1_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert n == len(texts)
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want = (len(ids), hashlib.sha256(packed).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == want


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


def test_op2(spark, sf_dir, texts):
    got, n = by_id(spark, sf_dir, "op2_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    assert n == len(texts)
    some = 0
    for doc, text in texts.items():
        found, r = base(text), got[doc]
        assert [r[f"n_{k}"] for k in found] == [len(x) for x in found.values()]
        listed = [f"{k}:{s}:{e}" for k, spans in found.items() for s, e in spans]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(","))
        some += len(listed)
    assert some


def test_op3(spark, sf_dir, texts):
    got, n = by_id(spark, sf_dir, "op3_mix_sources", ["doc_id", "size", "source_size", "target", "taken"])
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    total = Counter()
    for d, s in sources.items():
        total[s] += size[d]
    names = sorted(total, key=lambda s: (s is None, s))
    weight, target, open_, left = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} if full else share
        left -= sum(3 * total[s] for s in full)
        open_ = open_ - full if full else set()
    assert n == len(texts)
    taken = Counter()
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (size[d], total[sources[d]])
        assert math.isclose(r["target"], target[sources[d]], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * size[d]
        taken[sources[d]] += r["taken"]
    longest = {s: max(size[d] for d in sources if sources[d] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in names)
    assert by_id(spark, sf_dir, "op3_mix_sources", [])[0] == got


def test_op4(spark, sf_dir, texts):
    got, n = by_id(spark, sf_dir, "op4_toxicity", ["doc_id", "held_out", "score", "predicted"])
    assert n == len(texts)
    for d, r in got.items():
        assert r["held_out"] is (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op6(spark, sf_dir, texts):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got, n = by_id(spark, sf_dir, "op6_fingerprints", columns)
    assert n == len(texts)
    ids = sorted(texts)
    for d, following in zip(ids, ids[1:] + ids[:1]):
        cut, r = len(texts[d]) // 4, got[d]
        edited = texts[d][: len(texts[d]) - cut] + texts[following][:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[d]), sha(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == texts[d]:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    same = {}
    assert all(same.setdefault(texts[d], r["fingerprint"]) == r["fingerprint"] for d, r in got.items())


def test_op8(spark, sf_dir, texts):
    got, n = by_id(spark, sf_dir, "op8_lm_score", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    words = {d: [w.encode().lower().decode() for w in WORD.findall(t)] + [None] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d in texts if not out[d] for w in words[d])
    total = sum(count.values())
    assert n == len(texts)
    for d, r in got.items():
        plain = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words[d])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[d], len(words[d]), total)
        assert r["n_known"] == sum(count[w] > 0 for w in words[d]) and r["score"] < 0
        assert math.isclose(r["base_score"], plain, rel_tol=1e-9)


def test_op9(spark, sf_dir, texts):
    got, n = by_id(spark, sf_dir, "op9_jaccard_join", ["doc_id", "n_shingles", "component_id"])

    def shingles(text):
        w = [x.encode().lower() for x in WORD.findall(text)]
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small * 100 >= large * 90 and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert n == len(texts)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(sets[d]), root[d]) for d in texts}
