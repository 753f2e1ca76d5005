"""Mixing sources to target weights by Pareto order sampling.

A source's factor is its target over its size. Each document first gets the whole copies its expected number of
copies contains; the fraction left is its inclusion probability p for one more copy. With a uniform u drawn from
the document's key, documents are ranked by the odds u / (1 - u) over the odds p / (1 - p), and each source takes
documents in that order until the words that are still due are met. The cut is found from sums per bin of the
rank, level by level, so a source that holds a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WORD, materialise, ranked, small

WEIGHTS = (1, 2, 3)
#: Most expected copies of a document.
MAX_COPIES = 3.0
#: Bins of one level of the search for the cut, and its levels.
BINS, LEVELS = 1024, 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(absent, key, source_size) per source -> the same with `target`.

    Sources in code point order, the null source last, weigh weights[0], weights[1], ... repeating. They share the
    whole size; a target stops at `most` times its source's size and the excess is shared by weight until none is
    above. Each round is one aggregate over the sources.
    """
    order = ranked(sizes, "absent", "key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    state = materialise(order.select("absent", "key", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * most
    share, capped = None, F.lit(False)
    while True:
        got = state.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
        ).first()
        if share is not None and got["n"] == known:
            break
        known = got["n"]
        share = (got["all"] - got["stopped"]) / got["weights"] if got["weights"] else 0.0
        # once stopped, a source stays so: the share only rises
        capped = F.col("weight") * F.lit(share) > limit
    return state.select("absent", "key", "source_size", F.when(capped, limit).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def _expected(rows: DataFrame, importance: bool, most: float) -> DataFrame:
    """Add `copies`, the expected number of copies, so that the expected words of a source are its target."""
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if not importance:
        return rows.withColumn("copies", F.least(factor, F.lit(most)))
    # documents stopped at `most` leave their excess to the others of the source, until none is above
    scale = rows.select("absent", "key", F.lit(0.0).alias("scale")).distinct()
    while True:
        state = rows.join(scale, ["absent", "key"])
        above = F.col("scale") * F.col("importance") > most
        new = materialise(
            state.groupBy("absent", "key").agg(
                (
                    (F.max("target") - F.sum(F.when(above, F.col("size") * most).otherwise(0.0)))
                    / F.sum(F.when(above, 0.0).otherwise(F.col("size") * F.col("importance")))
                ).alias("scale"),
                F.sum(above.cast("long")).alias("n"),
            ),
            "scale",
        )
        change = new.alias("a").join(scale.alias("b"), ["absent", "key"])
        if change.filter("coalesce(a.scale, 0) > b.scale * (1 + 1e-12)").isEmpty():
            break
        scale = materialise(
            change.select("absent", "key", F.greatest(F.coalesce("a.scale", "b.scale"), "b.scale").alias("scale")), "scale"
        )
    return rows.join(scale, ["absent", "key"]).withColumn("copies", F.least(F.col("scale") * F.col("importance"), F.lit(most)))


def _cut(drawn: DataFrame) -> DataFrame:
    """(absent, key, at) per source: documents with rank value below or equal to `at` get one more copy.

    `due` words are missing per source. Level by level the bin that holds the cut is found from sums per bin;
    within the last one, documents are ordered, a share of BINS ** -LEVELS of the source.
    """
    state = drawn.groupBy("absent", "key").agg(F.sum(F.col("p") * F.col("size")).alias("due"))
    state = materialise(state.select("*", F.lit(0.0).alias("low"), F.lit(1.0).alias("width")), "cut")
    for _ in range(LEVELS):
        inside = drawn.join(small(state), ["absent", "key"]).filter("r >= low AND r < low + width")
        bins = inside.groupBy(
            "absent", "key", "due", "low", "width", F.floor((F.col("r") - F.col("low")) / F.col("width") * BINS).alias("bin")
        ).agg(F.sum("size").alias("words"))
        # at most BINS rows per source
        run = bins.withColumn("before", F.sum("words").over(W.partitionBy("absent", "key").orderBy("bin")) - F.col("words"))
        step = F.col("width") / BINS
        found = run.filter("before <= due").groupBy("absent", "key").agg(
            F.max(F.struct("bin", "before", "due", "low", "width")).alias("x")
        ).select("absent", "key", "x.*")
        state = materialise(
            found.select("absent", "key", (F.col("due") - F.col("before")).alias("due"), (F.col("low") + F.col("bin") * step).alias("low"), step.alias("width")),
            "cut",
        )
    inside = drawn.join(small(state), ["absent", "key"]).filter("r >= low AND r < low + width")
    order = inside.groupBy("absent", "key", "due", "low", "r").agg(F.sum("size").alias("words"))
    run = order.withColumn("upto", F.sum("words").over(W.partitionBy("absent", "key").orderBy("r")))
    # the last document taken is the one after which the words are nearest to what is due
    near = run.filter((F.col("upto") - F.col("words") / 2) <= F.col("due"))
    last = near.groupBy("absent", "key").agg(F.max("r").alias("at"))
    below = state.select("absent", "key", F.col("low").alias("floor"))
    return materialise(
        below.join(last, ["absent", "key"], "left").select("absent", "key", F.coalesce("at", "floor").alias("at"), F.col("at").isNull().alias("open")),
        "at",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MAX_COPIES,
    importance: Column | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row per document: id, text_hash, size (words), source_size, target, copies (taken into the mix).

    The words taken of a source, sum of size * copies, come within about half a document of its target. The draw
    depends on id, text and seed alone, so reruns agree; rows that repeat both share their fate. `importance`
    (a positive column, else equal) makes the inclusion probabilities unequal within a source; copies stay at most
    `most`. Null texts and sources count as an empty text and a source of their own; documents without words are
    never copied. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("text_hash"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.col(source_col).isNull().alias("absent"),
            F.coalesce(F.col(source_col), F.lit("")).alias("key"),
            (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"),
        ),
        "sizes",
    )
    sizes = materialise(narrow.groupBy("absent", "key").agg(F.sum("size").alias("source_size")), "sources")
    targets = materialise(source_targets(sizes, weights, most), "targets")
    rows = _expected(narrow.join(small(targets), ["absent", "key"]), importance is not None, most)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text_hash"), 11)
    u = (bits + 0.5) / float(1 << 53)
    drawn = rows.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole")).withColumn("u", u)
    # u / (1 - u) over p / (1 - p), mapped from 0..infinity to 0..1 without changing the order
    top, bottom = F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")
    drawn = drawn.withColumn("r", F.when(F.col("p") > 0, top / (top + bottom)))
    drawn = materialise(
        drawn.select("id", "text_hash", "absent", "key", "size", "source_size", "target", "whole", "p", "r"), "drawn"
    )
    cut = _cut(drawn.filter("p > 0 AND size > 0"))
    more = (F.col("r") < F.col("at")) | ((F.col("r") == F.col("at")) & ~F.col("open"))
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return drawn.join(small(cut), ["absent", "key"], "left").select(
        F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", taken.cast("long").alias("copies")
    )
