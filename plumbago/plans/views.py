"""The relations that the suite's queries start from, with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.session import table

#: WITH clauses of the same relations.
SQL = {
    "scores": "SELECT crop_id, image_id, fold, decision, anomaly_kind, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY risk_score DESC, image_id, batch_no, ingested_at) rn FROM crop_scores WHERE risk_score >= 0 AND risk_score <= 1 AND NOT isnan(risk_score)) t WHERE rn = 1",
    "images": "SELECT * EXCLUDE (split_role, rn), replace(upper(trim(split_role)), '-', '_') AS split_role FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY batch_no DESC, ingested_at DESC, source_id NULLS FIRST, split_role NULLS FIRST, product_id NULLS FIRST) rn FROM real_manifest) t WHERE rn = 1",
    "folds": "SELECT image_id, min(fold) AS fold, min(component_id) AS component_id, min(phash) AS phash, min(image_label) AS image_label, min(split_role) AS split_role FROM fold_manifest GROUP BY image_id",
    "labelled": "SELECT crop_id, image_id, fold, anomaly_kind, decision = 'BLOCK' AS label, risk_score AS score FROM scores WHERE decision IN ('PASS', 'BLOCK')",
    "queue": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY disagreement DESC NULLS LAST, risk_score DESC, priority_rank, queue_version) rn FROM review_candidates) t WHERE rn = 1",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
}


def canon_sql(column: str) -> str:
    """``canon`` in SQL: full-width forms by a rule, the other forms that occur by NFC."""
    wide, narrow = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
    drop = r"[\s\-_\x{a0}\x{3000}\x{200b}-\x{200f}\x{2060}\x{feff}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]"
    return f"nullif(lower(regexp_replace(translate(nfc_normalize({column}), '{wide}', '{narrow}'), '{drop}', '', 'g')), '')"


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def scores(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "crop_scores").select("crop_id", "image_id", "fold", "decision", "anomaly_kind", "risk_score", "batch_no", "ingested_at").where("risk_score >= 0 AND risk_score <= 1 AND NOT isnan(risk_score)")
    w = Window.partitionBy("crop_id").orderBy(F.desc("risk_score"), "image_id", "batch_no", "ingested_at")
    return ok.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch_no", "ingested_at")


def images(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(F.desc("batch_no"), F.desc("ingested_at"), F.asc_nulls_first("source_id"), F.asc_nulls_first("split_role"), F.asc_nulls_first("product_id"))
    return table(spark, d, "real_manifest").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("split_role", F.replace(F.upper(F.trim("split_role")), F.lit("-"), F.lit("_")))


def folds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fold_manifest").groupBy("image_id").agg(*[F.min(c).alias(c) for c in ("fold", "component_id", "phash", "image_label", "split_role")])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where("decision IN ('PASS', 'BLOCK')").select("crop_id", "image_id", "fold", "anomaly_kind", (F.col("decision") == "BLOCK").alias("label"), F.col("risk_score").alias("score"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("crop_id").orderBy(F.desc_nulls_last("disagreement"), F.desc("risk_score"), "priority_rank", "queue_version")
    return table(spark, d, "review_candidates").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")
