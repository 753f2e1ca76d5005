"""Document fingerprints by one-permutation MinHash with densified bins and packed low-order bits.

The distinct hashes of a text's word shingles are dealt once over BINS bins by their high bits; a bin keeps its
smallest hash. An empty bin takes the value of the first filled bin on a probe sequence of its own (a random start
and a random odd stride, which visits every bin once), so any two texts fill the same empty bin alike. Only BITS
low-order bits of each value, hashed with its bin so that copies of a value stay independent, are stored, 16 values
to a 64-bit integer; the share of equal values is corrected for the 1 in 2 ** BITS that are equal by chance.

All of it is array expressions within a row: no shingle is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SPACE, materialise

SHINGLE = 5
#: Bins are a power of two; BITS * 16 is the width of a packed integer.
BINS, BITS = 256, 4
_LOW = 63 - (BINS.bit_length() - 1)
#: Bins that are probed one by one before all filled bins are compared.
PROBES = 24
#: Code points of a range of ids in neighbour_likeness, about, and most ranges.
RANGE_CHARS, MOST_RANGES = 4_000_000, 2048


def _numbers(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _mixed(x: int) -> int:
    x = (x + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ (x >> 29)


_STARTS = [_mixed(j) % BINS for j in range(BINS)]
_STRIDES = [_mixed(j + BINS) % BINS | 1 for j in range(BINS)]
_INVERSES = [pow(s, -1, BINS) for s in _STRIDES]


def _densified(mins: Column, filled: Column) -> Column:
    """Low-order bits of all bins; an odd value marks an empty one. `filled` are the numbers of the others."""
    starts, strides, inverses = (_numbers(x, "int") for x in (_STARTS, _STRIDES, _INVERSES))

    def value(x: Column) -> Column:
        return F.when(x.bitwiseAND(F.lit(1)) == 0, x)

    def fill(x: Column, j: Column) -> Column:
        probe = [value(F.get(mins, (F.get(starts, j) + F.get(strides, j) * t).bitwiseAND(F.lit(BINS - 1)))) for t in range(PROBES)]
        step = lambda b: ((b - F.get(starts, j)) * F.get(inverses, j)).bitwiseAND(F.lit(BINS - 1))
        nearest = F.array_min(F.transform(filled, lambda b: F.struct(step(b).alias("step"), F.get(mins, b).alias("value"))))
        found = F.when(x.bitwiseAND(F.lit(1)) == 0, x).otherwise(F.coalesce(*probe, nearest["value"]))
        return F.xxhash64(found, j).bitwiseAND(F.lit((1 << BITS) - 1))

    return F.transform(mins, fill)


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add `out`, the packed fingerprint as array<long>; empty for texts without words.

    Fewer than SHINGLE words are one shingle. Columns of the names out and out_0 to out_5 are replaced.
    """
    words, keys, ordered, mins, filled, low = (f"{out}_{i}" for i in range(6))
    cut = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+"), "")
    df = df.withColumn(words, cut)
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    # 63 bits; the lowest is 0, and 1 in the marks that close every bin
    shingle = lambda i: F.shiftleft(F.shiftrightunsigned(hashed(i), 2), 1)
    marks = _numbers([(j << _LOW) + (1 << _LOW) - 1 for j in range(BINS)], "bigint")
    df = df.withColumn(keys, F.transform(at, shingle))
    df = df.withColumn(ordered, F.sort_array(F.concat(keys, marks)))
    first = lambda x, i: (i == 0) | (x.bitwiseXOR(F.get(ordered, i - 1)) >= F.lit(1 << _LOW))
    df = df.withColumn(mins, F.filter(ordered, first))
    even = lambda b: F.get(mins, b).bitwiseAND(F.lit(1)) == 0
    df = df.withColumn(filled, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), even))
    df = df.withColumn(low, _densified(F.col(mins), F.col(filled)))

    def pack(g: int) -> Column:
        return F.aggregate(F.slice(low, g * 16 + 1, 16), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))

    # named one by one: a single use of the values within a lambda would be inlined there and evaluated for each integer
    packed = F.array(*[pack(g) for g in range(BINS // 16)])
    none = F.array().cast("array<long>")
    return df.withColumn(out, F.when(F.size(words) == 0, none).otherwise(packed)).drop(words, keys, ordered, mins, filled, low)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints; two texts without words are alike, one such is not."""

    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.lit(16) - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    total = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x)
    chance = 1 / 2**BITS
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), (total / BINS - chance) / (1 - chance)))
    )


def as_text(packed: Column) -> Column:
    """A hexadecimal digit per bin; empty for an empty fingerprint."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_text, print, edited_print, next_print (packed fingerprints).

    The edited text is the text with its last quarter replaced by as many first code points of the next document
    in ascending id order; after the last comes the first, null ids come last, and rows that share an id follow
    each other by the hash of their text. Texts are shuffled once, to ranges of ids; a copy of the first row of
    each range closes the range before it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = int(min(max(size // RANGE_CHARS, 16), MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("id", shares, 20 * MOST_RANGES).alias("b")).first()["b"] or []
    bounds = _numbers(sorted(set(bounds)), "bigint") if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("id").isNull(), F.lit(MOST_RANGES)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    rows = rows.select(part.alias("part"), F.col("id").isNull().alias("absent"), "id", F.xxhash64("text").alias("hash"), "text")
    order = ["absent", "id", "hash"]
    # a row for each range
    firsts = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("f")).select("part", "f.*")
    before = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.orderBy(F.lit(1))))
    firsts = materialise(firsts.select(before.alias("before"), *order), "firsts")
    matched = [rows[c].eqNullSafe(firsts[c]) for c in order]
    closing = rows.join(F.broadcast(firsts), matched).select(
        F.col("before").alias("part"), rows["absent"], rows["id"], rows["hash"], "text", F.lit(True).alias("copy")
    )
    both = with_fingerprint(rows.withColumn("copy", F.lit(False)).unionByName(closing), "text", "print")
    follows = W.partitionBy("part").orderBy("copy", *order)
    both = both.withColumn("next", F.lead(F.struct("text", "print")).over(follows)).filter("NOT copy")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    out = both.select("id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "print", F.col("next.print").alias("next_print"))
    return with_fingerprint(out, "edited_text", "edited_print").withColumnRenamed("id", id_col)
