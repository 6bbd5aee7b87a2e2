"""The corpus pipeline: each stage works on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents` (doc_id, text, lang, source, n_chars).
`run` writes each stage's result to the shared folder and reads it for the next.

Rows with null or empty texts and repeated rows pass through like any others;
an empty table gives an empty result. Extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import mixing, packing, pii, simhash, toxicity
from meshlark.llm.words import document_key
from meshlark.operators.cluster import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores 0.5 or more; texts are scored where they lie."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, list(COLUMNS), text_at="text").where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, likeness of 0.8 or more) keep the document with the smallest id (null last), of rows alike in id and text one.

    The texts are shuffled once: the join and the removal of repeats share their keys.
    """
    kept = simhash.representatives(docs).select(_id_key().alias("id_key"), "text_key")
    own = docs.select(*COLUMNS, _id_key().alias("id_key"), F.xxhash64("text").alias("text_key"))
    return own.join(kept, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select(*COLUMNS)


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows."""
    return pii.redact_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one for each time a document is taken whole, and its first words where the last pass ends inside it.

    Documents without words, and those the mix takes nothing of, are not in it.
    Copies keep their doc_id. Rows alike in id, text and source are one document here, of which the mix takes what it takes of all of them.
    """
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key")
    taken = mixing.mix(docs).where("taken > 0").groupBy("key", source_key, "size").agg(F.sum("taken").alias("taken"))
    rows = docs.select(*COLUMNS, document_key(F.col("doc_id"), F.col("text")).alias("key"), source_key)
    rows = rows.join(taken, ["key", "source_key"]).dropDuplicates(["key", "source_key"])
    rows = rows.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.filter(F.array(F.col("taken") % F.col("size")), lambda n: n > 0))))
    first = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first)
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The classifier, SimHash and deobfuscation have no SQL form; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
