"""From raw documents to a training mixture: each stage works on all that its predecessor kept.

STAGES name the operators in order; run() applies them to `documents`, with the result of each written as Parquet and read again.
Language models' kernels can't be told in SQL, so ORACLE_SQL is None and tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, jaccard, langid, lines, mixing
from leafmill.llm.common import stored, table, without

#: Documents whose language is less certain go; the score is 0 for texts without letters.
MIN_LANG_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    known = langid.identified(docs).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANG_SCORE))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those that lose all their lines go."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows, the one with the smallest doc_id; a null doc_id comes before any other, as in line_dedup. Rows without words are one if they share a doc_id."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "near-dedup-rows")
    found = jaccard.linked(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__id"), "n_shingles", "component_id")
    ids = rows.select("__row", F.col("doc_id").alias("__doc"))
    told = ids.join(found, ids["__row"] == found["__id"])
    own = F.when((F.col("n_shingles") == 0) & F.col("__doc").isNotNull(), F.col("__doc"))
    kept = told.groupBy(own.alias("own"), F.when(own.isNull(), F.col("component_id")).alias("component")).agg(F.min(F.struct("__doc", "__row")).alias("first"))
    kept = stored(kept.select(F.col("first.__row").alias("__kept")), "near-dedup-kept")
    gone = stored(ids.select("__row").join(kept, F.col("__row") == F.col("__kept"), "left_anti"), "near-dedup-gone")
    return without(rows, "__row", gone).drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
