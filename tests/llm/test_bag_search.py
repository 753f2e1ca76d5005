"""Ranked search against a plain version that scores every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import bag_search

DOCS = "doc_id long, text string, rank string, uid string"
ITEMS = "item_id long, text string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        scored = []
        for doc, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "élan", "naïve", "東京", "the", "x'y", "A-b"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.randrange(1, 40)), "own", "own") for i in range(150)]
    docs += [(1000 + i, docs[3][1], "own", "own") for i in range(40)]  # copies: ties by id
    docs += [(900 - i, docs[5][1] + " . ?", "own", None) for i in range(15)]  # the same bag in other words
    docs += [(300, None, None, None), (301, "", "", ""), (302, " .,- ", "", ""), (None, docs[3][1], "", ""), (None, "w1", "", "")]
    docs += [(77, "w2 w3", "", ""), (77, "w2 w3", "", ""), (303, "w4 " * 50_000, "", "")]
    items = [(i, text(rng.randrange(1, 12)), "own") for i in range(25)]
    items += [(50, docs[3][1], "own"), (51, None, None), (52, "...", ""), (53, "unheard of", ""), (54, "W2 w3 w2", ""), (54, "W2 w3 w2", ""), (None, "w1", "")]
    return docs, items


@pytest.mark.parametrize("block, cells", [(4 << 20, 1 << 21), (300, 64)])
def test_search(spark, tables, monkeypatch, block, cells):
    monkeypatch.setattr(bag_search, "ITEM_BYTES", block)
    monkeypatch.setattr(bag_search, "CELLS", cells)
    docs, items = tables
    documents = spark.createDataFrame(docs, DOCS).repartition(5)
    for k in (10,) if block == 300 else (10, 1):
        got = bag_search.search(documents, spark.createDataFrame(items, ITEMS).repartition(2), k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, k)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(tables, (DOCS, ITEMS)))
    assert bag_search.search(docs.limit(0), items).count() == 0
    assert bag_search.search(docs, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    assert bag_search.search(blank, items).count() == 0


def test_copies_are_one_class(spark, tables):
    docs = spark.createDataFrame(tables[0], DOCS).select("doc_id", "text")
    block = bag_search.Items([(0, tables[0][3][1])])
    found = bag_search.vectors(docs, block)
    n_docs, n_terms = 200, 3000
    made = bag_search.classes(found, n_docs, n_terms, 10).collect()
    assert len({(r["vector"], r["m"]) for r in made}) == len(made)
    want = sorted(d for d, t, *_ in tables[0] if t == tables[0][3][1] and d is not None)[:10]
    assert want in [r["members"] for r in made]
    assert all(len(r["members"]) <= 10 for r in made)


def test_terms_of_slices():
    texts = pa.array(["skip me", "Ab,cd", None, "", "é1 _x", "  "]).slice(1)
    ends, found = bag_search._terms(texts)
    assert ends.tolist() == [2, 2, 2, 4, 4] and found.to_pylist() == ["ab", "cd", "é1", "x"]
    n, vectors = bag_search._vectors(texts, pa.array(["x", "cd"]))
    assert n.tolist() == [2, 0, 0, 2, 0]
    assert [np.frombuffer(v, "<u4").tolist() for v in vectors] == [[1, 1], [], [], [0, 1], []]
