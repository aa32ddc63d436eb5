"""Queries of the problems on vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import leakage, packing, similar, spans
from tidewheel.session import read

# The scales of the four means.
SCALES = {"mean_velo": 6.0, "mean_ivb": 8.0, "mean_hb": 10.0, "mean_spin_rate": 350.0}


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "pitcher_gmm_components").select("vec_id", *SCALES)
    return similar.nearest(vectors, "vec_id", [F.col(c).cast("double") / F.lit(s) for c, s in SCALES.items()], 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nearest(spark, sf_dir)
    return n.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


def _leak_tables(spark: SparkSession, sf_dir: str) -> tuple:
    return read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "text"


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(*_leak_tables(spark, sf_dir))


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.paraphrases(*_leak_tables(spark, sf_dir))


def _shared(spark: SparkSession, sf_dir: str) -> tuple:
    return spans.shared_spans(read(spark, sf_dir, "documents"), "doc_id", "text", one=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_pairs(*_shared(spark, sf_dir))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class of equal texts and how many other texts share a span with it."""
    return spans.classes(*_shared(spark, sf_dir))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(read(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest, "p6_containers": p6_containers, "p7_found": p7_found, "p7_paraphrases": p7_paraphrases, "p8_found": p8_found, "p8_classes": p8_classes, "p8_coverage": p8_coverage}
SQL: dict[str, str] = {}
