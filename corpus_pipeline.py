"""Corpus pipeline: raw documents to packed token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. `run` applies them in order to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, line_dedup, mixing, partenum, toxicity
from quire.llm.common import materialise

#: A document is rejected at this score or above.
TOXIC = 0.5
#: Whole texts go to Python, so a batch holds few of them.
BATCH_ROWS = "1000"


def _row(docs: DataFrame) -> DataFrame:
    """The whole row in one column beside its id and text, so that no column an operator adds meets one of the table."""
    return docs.select(F.struct(F.col("*")).alias("row"), "doc_id", "text")


def _few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score stay. Labels of a fifth of the ids are never learnt from."""
    _few_rows(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(_row(docs), labels, score_col="score").filter(F.col("score") < TOXIC).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; every document stays, with n_chars of what is left."""
    _few_rows(spark)
    cleaned = line_dedup.drop_common_lines(_row(docs))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles one stays."""
    _few_rows(spark)
    return partenum.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights: a document comes as often as the mix takes it."""
    mixed = mixing.mix(docs).filter("copies > 0")
    key = [F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")]
    # rows that repeat id and text share their fate, so one of them tells it
    taken = materialise(mixed.select(*key, F.col("copies").alias("n")).distinct(), "taken")
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = docs.select(F.struct(F.col("*")).alias("row"), key[0], key[1], text)
    chosen = rows.join(taken, ["absent", "id", "text_hash"])
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its packed ids, their number, and the digest of what they decode to."""
    _few_rows(spark)
    import public_tokenizers

    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the fitted scores nor the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
