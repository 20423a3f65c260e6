"""A training-corpus pipeline: quality rules, near-duplicates, secrets, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  All but the last return the columns of ``documents``; further columns of the
input are not carried on, whatever their names.  An empty table gives an empty one
at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import mixing, pieces, secrets
from skyloom.llm.common import durable
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold.

    Null, empty and wordless texts fail the base rules and go.  Repeated rows and ids
    are judged one by one, equal texts of one id alike; rows without id are judged as
    others.  A score at the threshold is kept.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group (five words, 0.8).

    Null, empty and wordless texts are like nothing else and stay.  Repeated rows of a
    kept id come down to one, that of least length, source, language and text hash.
    Rows without id cannot be told apart by the decision and go.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    once = Window.partitionBy("doc_id").orderBy("n_chars", "source", "lang", F.xxhash64("text"), "text")
    return docs.join(kept, "doc_id", "left_semi").withColumn("_turn", F.row_number().over(once)).where("_turn = 1").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark, n_chars counted anew where the text changed.

    Null and empty texts stay as they are; repeated rows each stay, changed alike; ids
    are not looked at; a missing source or language counts as an owner of its own.
    """
    rows = secrets.scan(docs.select(*COLUMNS), keep=True).select("doc.*", secrets.reported(F.col("spans")).alias("_spans"))
    text = secrets.redacted(F.col("text"), F.col("_spans"))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order; those taken more than once are repeated.

    Null, empty and wordless texts have no words to take and go.  Repeated rows each
    have their turn, rows without id too, and rows without source are a source of
    their own; positions that tie go by id and row.
    """
    return mixing.stream(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row's best segmentation with the scores of the two best.

    Null and empty texts have no ids, a best score of 0 and no second one; they and
    all others come back whole from their ids.  Every row is encoded, with or without
    id, repeated ones alike.
    """
    coded = pieces.encode(docs, 2)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.get("scores", F.lit(0)).alias("best_score"), F.get("scores", F.lit(1)).alias("second_score"), "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

#: SQL cannot express hashed likelihood ratios or segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
