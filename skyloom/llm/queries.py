"""The queries over the corpus operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, mixing, phrases, pieces, resampling, secrets, top_k, warc
from .near_dedup import near_duplicates
from .quality import quality
from .suffix_dedup import remove_repeats
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labelled rows that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labelled = _table(spark, sf_dir, "labels").where(~held).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    scored = toxicity(_table(spark, sf_dir, "documents"), labelled)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, Jaccard of 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and likelihood-ratio verdict of every document; trusted are those labelled of good quality."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).select(*names)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 50-byte strings that start in an earlier document, over all documents."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic archives, the normaliser and the index."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, judged by who else has them."""
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best segmentations of every document: pieces and hash of the best, both scores, and whether decoding gives the text again."""
    coded = pieces.encode(_table(spark, sf_dir, "documents"), 2)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.get("scores", F.lit(0)).alias("best_score"), F.get("scores", F.lit(1)).alias("second_score"), "round_trip")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source weights 1, 2, 3 along the curriculum."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best integer inner products of every vector whose id is divisible by 50, against all others."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), top_k.quantised(F.col("embedding")).alias("v"))
    return top_k.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language over all documents."""
    return phrases.ranked(phrases.phrases(_table(spark, sf_dir, "documents")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's texts, and the ranked draw of five percent."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text, and their likenesses."""
    rows = fingerprints.fingerprints(_table(spark, sf_dir, "documents"))
    printed = {"fingerprint": fingerprints.printed(F.col("print")), "edited_fingerprint": fingerprints.printed(F.col("edited_print"))}
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[c.alias(n) for n, c in printed.items()], "near_edited", "near_next")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_pieces": op8_pieces,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
    "op11_phrases": op11_phrases,
    "op12_resampling": op12_resampling,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES: dict[str, str] = {
    "op6_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_top_k": top_k.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
