"""The stages in order, and what each does to the rows of its predecessor."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "mix_sources", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("own"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != "bpe":
            assert out.columns == docs.columns
    raw, clean, lined, single, mixed, coded = ([r.asDict() for r in d.collect()] for d in seen)
    assert len(raw) * 0.8 < len(clean) <= len(raw) and all(r["score"] == "own" for r in mixed)

    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    count = Counter(k for r in clean for k in {key(x) for x in r["text"].split("\n")})
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not key(x) or count[key(x)] < 10) for r in clean}
    assert {r["doc_id"]: r["text"] for r in lined} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined)

    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in lined}
    left = {r["doc_id"] for r in single}
    assert len(left) == len(single)
    near = lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b)
    ids = sorted(left)
    assert not any(near(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[:i])
    assert all(any(near(sets[a], s) for b, s in sets.items() if b < a) for a in sets if a not in left)

    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= left and max(copies.values()) <= 3
    assert sum(len(re.findall(r"\S+", r["text"])) for r in mixed) > 0
    assert Counter(r["doc_id"] for r in coded) == copies
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in coded)
