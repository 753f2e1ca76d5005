"""Chunked ordered work against plain loops, over several chunk sizes and partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import (
    first_per_key, latest_per_key, number_chunk, number_within, previous_within, running_sum_within,
)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    # one key holds most rows; positions repeat, the id breaks the ties
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(200), i, rng.randrange(9)) for i in range(400)]


@pytest.mark.parametrize("size, partitions", [(1, 1), (7, 4), (50, 16), (10_000, 3)])
def test_numbers_sums_and_neighbours(spark, data, size, partitions):
    df = spark.createDataFrame(data, "k string, pos int, id int, v int").repartition(partitions)
    order, chunk = ["pos", "id"], number_chunk("pos", size)
    numbers = {r["id"]: r["n"] for r in number_within(df, ["k"], order, chunk, "n").collect()}
    sums = {r["id"]: r["s"] for r in running_sum_within(df, ["k"], order, chunk, F.col("v"), "s").collect()}
    back = {
        n: {r["id"]: [p["id"] for p in r["p"]] for r in previous_within(df, ["k"], order, chunk, ["id"], n, "p").collect()}
        for n in (1, 2, 3)
    }
    for key in {d[0] for d in data}:
        group = sorted((d for d in data if d[0] == key), key=lambda d: d[1:3])
        total = 0
        for at, (_, _, id_, v) in enumerate(group):
            total += v
            assert numbers[id_] == at + 1
            assert sums[id_] == total
            for n in (1, 2, 3):
                assert back[n][id_] == [d[2] for d in group[max(0, at - n):at]]
    assert len(numbers) == len(sums) == len(data)


def test_first_and_last(spark, data):
    df = spark.createDataFrame(data, "k string, pos int, id int, v int")
    first = {r["k"]: (r["pos"], r["id"]) for r in first_per_key(df, ["k"], ["pos", "id"]).collect()}
    last = {r["k"]: (r["pos"], r["id"]) for r in latest_per_key(df, ["k"], ["pos", "id"]).collect()}
    for key in first:
        group = [d[1:3] for d in data if d[0] == key]
        assert first[key] == min(group) and last[key] == max(group)


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", None, 2), ("a", 1, 3)], "k string, pos int, id int")
    assert number_within(df, ["k"], ["pos"], number_chunk("pos"), "n").count() == 3
    assert previous_within(df, ["k"], ["pos"], number_chunk("pos"), ["id"], 2).count() == 3
