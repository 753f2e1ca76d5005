"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, exact_dedup, fingerprints, line_dedup, lm, mixing, partenum, pii, toxicity, warc
from quire.llm.common import components, materialise, ranked
from quire.llm.elias_fano import EliasFano
from quire.llm.queries import QUERIES, _tokenizer
from quire.llm.reference_sql import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ["id", "uid", "name", "root", "part", "h", "n", "size", "copies", "score", "pii", "ids", "key", "row"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(rng, n=60):
    base = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    near = base[3].split()
    rows += [(n + i, " ".join(near[: len(near) // 2] + [f"x{i}"] + near[len(near) // 2 :]), "en", "s1", 0) for i in range(12)]
    rows += [(n + 20 + i, base[5].replace(" ", "\n ", 2), "fr", None, 0) for i in range(3)]
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, " \n\t", "en", "s0", 3), (None, base[7], "en", "s2", 1)]
    rows += [(903, base[9], "en", "s3", 1), (903, base[9], "en", "s3", 1), (904, words(rng, 4000), "en", "s0", 1), (905, "one", "en", "s0", 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    # read back from files, as tables are: the row order of a scan is fixed
    return materialise(df, "docs").coalesce(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


# ---- 1 BPE ----------------------------------------------------------------------------------------------------

def test_bpe_is_the_library(spark, docs, rows, none):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(_tokenizer())
    rng = random.Random(3)
    letters = "abc ABC 's'll 12½²٣ \n\t\x1c\x85 éÉΣσςİß你好!?<|endoftext|>"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    odd += ["<|endoftext|>a<|startoftext|><|", "a" * 3000, "ab" * 400 + "!" * 900, None, ""]
    texts = [r[1] for r in rows] + odd
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = bpe.encode_documents(df, _tokenizer()).withColumn("u", bpe.unpack(F.col("ids"))).orderBy("i").collect()
    for r, t in zip(got, texts):
        want = known.encode(t or "", add_special_tokens=False).ids
        assert r["u"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == known.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(none, _tokenizer()).count() == 0


# ---- 2 PII ----------------------------------------------------------------------------------------------------

def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_identifiers():
    rng = random.Random(2)
    parts = ["a", "B", "1", "34", "255", "256", ".", "@", "-", " ", "+", "(", "_", "é", "4111111111111111", "x@y.z", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [x[:3] for x in pii.personal_data(t) if x[3]] == plain_spans(t)


@pytest.mark.parametrize("text, kind, span", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("jane at example dot org", "email", "jane at example dot org"),
    ("by jоhn@example.com.", "email", "jоhn@example.com"),
    ("a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
    ("card ４１１１ １１１１ １１１１ １１１１!", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguised_identifiers(text, kind, span):
    found = [(k, text[s:e]) for k, s, e, plain in pii.personal_data(text) if not plain]
    assert (kind, span) in found


@pytest.mark.parametrize("text, kind, span", [
    ("write to jane at example.com, soon", "email", "jane at example.com"),
    ("J.Doe AT mail.firma.pl", "email", "J.Doe AT mail.firma.pl"),
    ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
    ("call plus-49-30-1234567 now", "phone", "plus-49-30-1234567"),
    ("by jane@example[.]com", "email", "jane@example[.]com"),
    ("by jane[@]example[.]com", "email", "jane[@]example[.]com"),
    ("by jane (@) mail ( . ) example.com", "email", "jane (@) mail ( . ) example.com"),
    ("host 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ("anna at firma dot pl", "email", "anna at firma dot pl"),
    ("anna at firma dot ca", "email", "anna at firma dot ca"),
    ("anna at firma dot co dot jp", "email", "anna at firma dot co dot jp"),
    ("anna at firma dot photography", "email", "anna at firma dot photography"),
    ("anna at firma dot xn--p1ai", "email", "anna at firma dot xn--p1ai"),
])
def test_disguises_by_one_sign(text, kind, span):
    found = [(k, text[s:e]) for k, s, e, plain in pii.personal_data(text) if not plain]
    assert found == [(kind, span)]


@pytest.mark.parametrize("address", [
    "jоhn." + "a" * 30 + "@" + "mail." * 30 + "example.com",
    "john@" + "mail." * 30 + "exаmple.com",
    "о" + "a" * 300 + "@example.com",
])
def test_long_disguised_address_is_whole(address):
    for text in (address, f"write to {address} soon", f"one {'word ' * 50}{address} two"):
        # the plain pattern may take a part of it
        assert [(k, text[s:e]) for k, s, e, plain in pii.personal_data(text) if not plain] == [("email", address)]


def test_long_texts_of_marks():
    phone = "plus 49 30" + " " * 200 + "1234567"
    assert [(k, phone[s:e]) for k, s, e, _ in pii.personal_data(phone)] == [("phone", phone)]
    assert pii.personal_data("0" * 5000 + ".1.1.1") == [("ip", 0, 5006, True)]
    assert pii.personal_data("0" * 5000 + ".1.1.999") == []
    assert pii.personal_data(("a" * 400 + "о") * 2000) == []


def test_prose_with_domains_is_left_alone():
    for t in (
        "Read it at example.com today", "more at www.example.com", "the docs at example.com/help", "He looked at 3.5 of them",
        "look at the dot in the middle", "reston at leosrm.25", "he sat at home.Then left", "plus 12 more", "see [.] or (@)",
        "stay at night dot matrix", "j.x at the dot in it", "x at leosrm.2x",
    ):
        assert pii.personal_data(t) == []


def test_prose_is_left_alone(spark, docs, none):
    for t in ("He was at the dot of noon", "look at one of two", "plus one", "at home. dot com was a time", "", None):
        assert pii.personal_data(t) == []
    df = spark.createDataFrame([("a x@y.org b +1 234 567 890",), (None,)], "text string")
    assert [r.text for r in pii.masked(df).collect()] == ["a <email> b <phone>", None]
    assert pii.find_personal_data(none).count() == 0
    long = "a" * 200_000 + "@" + "1" * 200_000 + "+1" + " " * 200_000
    assert pii.personal_data(long) == []


# ---- 3 mixing -------------------------------------------------------------------------------------------------

def test_mix(spark, docs, rows, none):
    mixed = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(mixed) == len(rows)
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share, stop, share again
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = rest / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * share > 3 * size[s]}
        if not above:
            break
        capped |= above
    target = {s: 3 * size[s] if s in capped else weight[s] * share for s in order}
    by_id = {(r[0], r[1]): r[3] for r in rows}
    taken, longest = Counter(), Counter()
    for r in mixed:
        s = next(v for (i, t), v in by_id.items() if i == r["doc_id"] and len((t or "").split()) == r["size"])
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
        longest[s] = max(longest[s], 2 * r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(docs.repartition(7))
    assert Counter(map(tuple, again.collect())) == Counter(tuple(r.values()) for r in mixed)
    assert mixing.mix(none).count() == 0


def test_mix_with_importance(spark):
    rows = [(i, "a " * 10, "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, importance=F.when(F.col("doc_id") < 100, 9.0).otherwise(1.0)).collect()
    assert abs(sum(r["size"] * r["copies"] for r in got) - 3000) <= 30
    high, low = ([r["copies"] for r in got if (r["doc_id"] < 100) == b] for b in (True, False))
    assert np.mean(high) > 4 * np.mean(low) and max(high) <= 3


# ---- 4 toxicity -----------------------------------------------------------------------------------------------

def test_toxicity(spark, none):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        t = words(rng, 60, 3000).split()
        if bad:
            for w in rng.sample(["grumblesnort", "vexnibber", "quorblat"], 2):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, rows[0][1])], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(df, y).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    assert got[5000] == got[5001] < 0.5
    assert got[None] == got[0]
    empty = toxicity.score_toxicity(df, y.limit(0)).agg(F.max("toxicity")).first()[0]
    assert 0 <= empty < 0.5
    assert toxicity.score_toxicity(none, y).count() == 0


def test_toxicity_of_unseen_expressions():
    """Expressions that no labelled row holds are judged by the plain recursion down to the shared counts."""
    rng = random.Random(4)
    texts = {y: ["".join(rng.choice("abcde"[y : y + 4] + " ") for _ in range(30)) for _ in range(40)] for y in (0, 1)}
    tops = {}
    for y in (0, 1):
        tops[y] = Counter()
        for t in texts[y]:
            tops[y].update(set(toxicity._grams(f"   {t} ".encode(), [34])[1].tolist()))
    model = toxicity.fit_ratios({y: tuple(np.array(x, t) for x, t in zip(zip(*sorted(c.items())), (np.uint64, np.int64))) for y, c in tops.items()})
    low = Counter()
    for c in tops.values():
        for g, n in c.items():
            low[g & 255] += n

    def chance(y, g, k):
        if k == 1:
            return (low[g] + 0.5) / (sum(low.values()) + 128)
        level = tops[y]
        for j in range(3, k - 1, -1):
            level = Counter(x & (1 << 8 * j) - 1 for x in level)
        of = {x: n for x, n in level.items() if x >> 8 == g >> 8}
        rest = chance(y, g & (1 << 8 * k - 8) - 1, k - 1)
        if not of:
            return rest
        share = {x: max(n - 3, 0) for x, n in of.items()}
        return (share.get(g, 0) + (sum(of.values()) - sum(share.values())) * rest) / sum(of.values())

    asked = [int.from_bytes(bytes(rng.choice(b"abcdez ") for _ in range(4)), "big") for _ in range(300)]
    unseen = [g not in tops[0] and g not in tops[1] for g in asked]
    got = model.ratios(np.array(asked, np.uint64))
    want = [np.log(chance(1, g, 4) / chance(0, g, 4)) for g in asked]
    assert np.allclose(got, want, atol=1e-4) and np.abs(got[unseen]).max() > 0.1


def test_toxicity_curve_ends_at_its_least_loss():
    """Clean texts lie close, with a tail of long ones far below, toxic ones are spread: whole Newton steps swing to and fro."""
    rng = np.random.default_rng(5)
    clean = np.concatenate([rng.normal(-0.3, 0.3, 4400), -rng.exponential(40, 200)])
    toxic = 0.6 + rng.gamma(2, 1.4, 500)
    x, y = np.concatenate([clean, toxic]), np.repeat([0, 1], [len(clean), len(toxic)])
    slope, offset = toxicity._logistic(x, y)
    predicted = slope * x + offset >= 0
    assert predicted[y == 1].mean() > 0.9 and predicted[y == 0].mean() < 0.01

    def loss(a, b):
        z = a * x + b
        return np.logaddexp(0, z).sum() - y @ z + 0.5e-2 * (a * x.std()) ** 2

    least = loss(slope, offset)
    assert all(least <= loss(slope * f, offset * g) + 1e-6 for f in (0.98, 1, 1.02) for g in (0.98, 1, 1.02))


# ---- 5 exact dedup --------------------------------------------------------------------------------------------

def check_exact(rows, got):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    want = Counter()
    for i, t in texts:
        ids = [x for x in groups[t] if x is not None]
        want[i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_exact_dedup(docs, rows, block):
    check_exact(rows, exact_dedup.exact_duplicates(docs, block=block).collect())


def test_exact_dedup_tells_blocks_of_one_hash_apart(docs, rows):
    weak = lambda b: F.length(b).cast("long") % 3
    check_exact(rows, exact_dedup.exact_duplicates(docs, block=40, block_hash=weak).collect())


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).count() == 0


# ---- 6 fingerprints -------------------------------------------------------------------------------------------

def test_fingerprints(docs, rows, none):
    got = fingerprints.neighbour_likeness(docs).withColumns(
        {
            "near": fingerprints.likeness(F.col("print"), F.col("edited_print")),
            "text": fingerprints.as_text(F.col("print")),
        }
    ).collect()
    assert len(got) == len(rows)
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4)) if w}
    whole = {r[0]: r[1] or "" for r in rows}
    errors = []
    for r in got:
        t = whole[r.doc_id]
        assert r.n_chars == len(t) and r.edited_text[: len(t) - len(t) // 4] == t[: len(t) - len(t) // 4]
        a, b = sets(t), sets(r.edited_text)
        errors.append(r.near - (len(a & b) / len(a | b) if a | b else 1.0))
        assert (r.text == "") == (not t.split())
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.03
    ids = sorted(i for i in whole if i is not None)
    follows = dict(zip(ids, ids[1:]))
    for r in got:
        if r.doc_id in follows and r.doc_id != 903:
            q = r.n_chars // 4
            assert r.edited_text == whole[r.doc_id][: r.n_chars - q] + whole[follows[r.doc_id]][:q]
    assert fingerprints.neighbour_likeness(none).count() == 0


# ---- 7 line dedup ---------------------------------------------------------------------------------------------

def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        at = line_dedup.PerfectHash.build(keys).index(keys)
        assert sorted(at.tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("shard_keys, block", [(1 << 16, 64 << 20), (8, 400)])
def test_line_dedup(spark, none, monkeypatch, shard_keys, block):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    rng = random.Random(4)
    lines = [f" Line {i} É\t" for i in range(40)] + ["", "  ", "\r"]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(90)]
    rows += [(1000, None), (1001, ""), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("own"))
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = Counter()
    for i, t in rows:
        cut = (t or "").split("\n")
        kept = [x for x in cut if not key(x) or count[key(x)] < 10]
        want[i, "\n".join(kept), len(cut), len(cut) - len(kept)] += 1
    got = line_dedup.drop_common_lines(df).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert line_dedup.drop_common_lines(none).count() == 0


# ---- 8 language model -----------------------------------------------------------------------------------------

def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 5), (900, 1000), (4000, 1 << 60)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        coded = EliasFano(EliasFano.build(v))
        asked = np.concatenate([v, rng.integers(0, top, 500).astype(np.uint64)])
        place = {int(x): i for i, x in enumerate(v)}
        assert coded.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
        assert coded.access(np.arange(len(v))).tolist() == v.tolist()


def test_language_model(spark, docs, rows, none):
    train = docs.filter(~lm.held_out(F.col("doc_id")))
    spec = lm.train(train)
    got = lm.score_texts(docs, spec).collect()
    learnt = [(t or "").lower().split() + [None] for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in learnt for w in t)
    n, v = sum(c.values()), len(c)
    pairs = defaultdict(Counter)
    for t in learnt:
        for a, b in zip(["^", *t], t):
            pairs[a][b] += 1
    one = lambda w: (c[w] + 1) / (n + v + 1)

    def two(a, b):
        if a not in pairs:
            return one(b)
        total = sum(pairs[a].values())
        return max(pairs[a][b] - 0.75, 0) / total + 0.75 * len(pairs[a]) / total * one(b)

    assert (spec["tokens"], spec["words"]) == (n, v) and len(got) == len(rows)
    for r in got:
        t = (r.text or "").lower().split() + [None]
        assert (r.lm.n_tokens, r.lm.n_known) == (len(t), sum(w in c for w in t))
        assert r.lm.base_score == pytest.approx(sum(np.log10(one(w)) for w in t), rel=1e-9)
        assert abs(r.lm.score - sum(np.log10(two(a, b)) for a, b in zip(["^", *t], t))) <= 0.03 * len(t)
    assert lm.score_texts(none, spec).count() == 0
    blank = lm.train(none)
    assert lm.score_texts(docs, blank).agg(F.max("lm.n_known")).first()[0] == 0


# ---- 9 n-gram join --------------------------------------------------------------------------------------------

def plain_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(sets))]


def family(rng):
    """Copies at all distances from each other, and texts of every small size."""
    base = words(rng, 160, 5000).split()
    out = []
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randrange(14)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(t))
    for n in range(1, 30):
        t = words(rng, n, 5000).split()
        out += [" ".join(t), " ".join([*t, "more"]), " ".join(t).upper()]
    return out


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (3, 60)])
@pytest.mark.parametrize("block, held", [(256, 1 << 21), (8, 500)])
def test_jaccard_components(spark, monkeypatch, rows, width, percent, block, held):
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "HELD", held)
    texts = [r[1] for r in rows] + family(random.Random(9))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in partenum.jaccard_components(df, width=width, percent=percent).collect()}
    sets, root = plain_components(texts, width, percent)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    for i in range(len(texts)):
        assert got[i].n_shingles == len(sets[i])
        assert got[i].component_id == (least[root[i]] if sets[i] else i)
    distinct = {frozenset(s) for s in sets if s}
    for i in range(0, len(texts), 7):
        s = sets[i]
        links = sum(1 for o in distinct if s and o != s and 100 * len(s & o) >= percent * len(s | o))
        assert got[i].n_links == links


@pytest.mark.parametrize("shards", [2, 8])
def test_jaccard_bands_of_one_difference(spark, monkeypatch, shards):
    """At 90 percent the bands that end at 19 and at 27 both allow two differences."""
    monkeypatch.setattr(partenum, "LEAST_CELL_SHARDS", shards)
    rng = random.Random(19)
    texts = []
    for _ in range(40):
        base = words(rng, 22, 100_000).split()
        texts += [" ".join(base[:n]) for n in (19, 20, 21, 22)]  # 17 to 20 shingles
        texts += [" ".join([*base[:20], f"y{i}"]) for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in partenum.jaccard_components(df, width=3, percent=90).collect()}
    sets, root = plain_components(texts, 3, 90)
    assert {len(s) for s in sets} == {17, 18, 19, 20}
    for i, s in enumerate(sets):
        assert got[i].component_id == root.index(root[i])
        assert got[i].n_links == sum(100 * len(s & o) >= 90 * len(s | o) for o in sets) - 1


def test_shards_of_cells_hold_one_band_and_a_bounded_number_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(partenum, "CELL_SIGNATURES", 500)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(1 << 62, size=n).astype(np.uint64)) for n in [30] * 60 + [400] * 20 + [5000]]
    sizes = spark.createDataFrame([(len(x),) for x in sets], "n long")
    count, first = partenum.cell_shards(sizes, 80)
    signed = np.zeros(len(count), np.int64)
    for found in partenum.signatures(sets, 80):
        for sigs, band, _ in found:
            signed[band] += len(sigs)
    assert (np.flatnonzero(count > 1) == np.flatnonzero(signed > 500)).all() and (signed <= 500 * count).all()
    assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all()


def test_keep_one(docs, rows, none):
    kept = partenum.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    _, root = plain_components([r[1] for r in rows], 5, 80)
    worded = {r for r, x in zip(root, rows) if (x[1] or "").split()}
    blank = [x for x in rows if not (x[1] or "").split()]
    assert len(got) == len(worded) + len(blank)
    assert partenum.keep_one(none).count() == 0


# ---- 10 WARC --------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    same = "<p>é</p>" * 30
    rows = [(i, f"http://Host{i % 3}.example.org:80/p/{i % 5}?q={i}", f"<p>{i}</p>" * (i % 40)) for i in range(80)]
    rows += [(100 + i, "http://hot.example.org/one", same) for i in range(40)]
    rows += [(200, None, same), (201, "no scheme/x y", None), (202, "", "short"), (203, "", "short"), (None, "http://a/", "z" * 200)]
    df = spark.createDataFrame(rows, PAGES).repartition(6).withColumn("digest", F.lit("own"))
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = i is not None and len(raw) >= 100 and first[html] != i
        assert r.record_type == ("revisit" if again else "response")
        assert r.refers_to == (first[html] if again else None)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_key_lookup(spark):
    rows = [(i, f"http://www.example.org/{i // 10}", f"page {i}") for i in range(60)]
    df = spark.createDataFrame(rows, PAGES)
    folder = warc.shared_path(spark, "warc")
    manifest = warc.write_archives(df, folder, parts=4)
    index = warc.CaptureIndex(folder, [tuple(r) for r in manifest.select("stem", "first_key", "first_id").collect()])
    found = [index.record(o, n)["payload"].decode() for _, o, n in index.captures("org,example,www)/3", every=True)]
    assert found == [f"page {i}" for i in range(30, 40)]
    assert list(index.captures("org,example,www)/7", every=True)) == []
    assert list(index.captures("org,example,www)/3", 41)) == []


# ---- shared ---------------------------------------------------------------------------------------------------

def test_components_and_ranks(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    edges += [(999, 500 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(97)], "k string").repartition(6)
    assert {r.k: r.rank for r in ranked(df, "k").collect()} == {f"k{i:03}": i for i in range(97)}
