"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.rows import let
from quire.llm import bag_search, bpe, exact_dedup, fingerprints, line_dedup, lm, mixing, packing, partenum, pii, runs, toxicity, warc
from quire.llm.common import SPACE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels"), score_col="score")
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, _tokenizer()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the plain spans, `spans` has the disguised ones as well."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs).withColumn("plain", F.filter("pii", lambda s: s.plain))

    def count(kind: str) -> Column:
        return F.size(F.filter("plain", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    base = F.sha2(pii.spans_text(F.col("plain")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.neighbour_likeness(_table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("print")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spec = lm.train(docs.filter(~lm.held_out(F.col("doc_id"))))
    return lm.score_texts(docs, spec).select(
        "doc_id",
        lm.held_out(F.col("doc_id")).alias("held_out"),
        "lm.n_tokens",
        "lm.n_known",
        F.lit(spec["tokens"]).cast("long").alias("train_tokens"),
        "lm.base_score",
        "lm.score",
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = partenum.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id ends in 0, its words from a certain one on are repeated with a period.

    A text without words, or without an id, stays as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    trimmed = F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")

    return F.when((h % 10 == 0) & (trimmed != ""), let(F.split(trimmed, f"{SPACE}+"), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", _with_repeats(F.col("doc_id"), F.col("text")))
    found = runs.collapse_runs(docs)
    best = found.withColumn("best", F.array_max(F.transform(
        "runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, _tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {f.__name__: f for f in (op1_bpe, op2_pii, op3_mix_sources, op4_toxicity, op5_exact_dedup, op6_fingerprints, op7_line_dedup, op8_lm_score, op9_jaccard_join, op10_warc, op11_periodic_runs, op12_ranked_search, op13_pack_windows)}
