"""The engine's query suite, one entry per operator of the inventory, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.functions import text
from plumbago.operators import bags, constraints, grouping, images, metrics, queues, sampling, vectors
from plumbago.operators import views as arrays
from plumbago.plans import views
from plumbago.plans.views import canon_sql, ctes
from plumbago.session import table, written
from plumbago.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- score analytics ----

STEPS = ctes("scores", "labelled")[:-1] + """,
 tot AS (SELECT count(*) FILTER (label) pos, count(*) FILTER (NOT label) neg FROM labelled),
 st AS (SELECT score, count(*) FILTER (label) p, count(*) FILTER (NOT label) n FROM labelled GROUP BY score),
 cum AS (SELECT score, p, n, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) fp FROM st),
 pts AS (SELECT score AS threshold, tp, fp FROM cum UNION ALL SELECT nextafter(max(score), CAST('infinity' AS DOUBLE)), 0, 0 FROM cum),
 swp AS (SELECT threshold, tp, fp, tp / nullif(pos, 0)::DOUBLE AS recall, fp / nullif(neg, 0)::DOUBLE AS fpr, pos, neg FROM pts, tot) """


@query(STEPS + "SELECT threshold, tp, fp, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(CASE WHEN 0.001 * recall + 0.999 * fpr > 0 THEN 0.001 * recall / (0.001 * recall + (1 - 0.001) * fpr) ELSE 0 END, 6) AS ppv FROM swp")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.threshold_sweep(views.labelled(spark, d)), "recall", "fpr", "ppv")


@query(STEPS + "SELECT pos, neg, round((SELECT sum(n * (tp - p + p / 2.0)) FROM cum) / (pos::DOUBLE * neg), 6) AS auroc, round((SELECT sum(p / pos::DOUBLE * (tp / (tp + fp)::DOUBLE)) FROM cum), 6) AS aucpr FROM tot")
def auroc_aucpr(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.ranking_areas(views.labelled(spark, d)), "auroc", "aucpr")


@query(ctes("scores", "labelled")[:-1] + """,
 tot AS (SELECT fold, count(*) FILTER (label) pos, count(*) FILTER (NOT label) neg FROM labelled GROUP BY fold),
 st AS (SELECT fold, score, count(*) FILTER (label) p, count(*) FILTER (NOT label) n FROM labelled GROUP BY fold, score),
 cum AS (SELECT fold, score, p, n, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) tp, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) fp FROM st)
 SELECT fold, pos, neg, round(sum(n * (tp - p + p / 2.0)) / (pos::DOUBLE * neg), 6) AS auroc, round(sum(p / pos::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS aucpr FROM cum JOIN tot USING (fold) GROUP BY fold, pos, neg""")
def auroc_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.ranking_areas(views.labelled(spark, d), ["fold"]), "auroc", "aucpr")


@query(STEPS + """, g(gate, max_fpr, min_recall) AS (VALUES ('MVP', 1e-4::DOUBLE, 0.40::DOUBLE), ('TRIAL', 2.5e-5::DOUBLE, 0.50::DOUBLE)),
 c AS (SELECT *, fpr <= max_fpr AND recall >= min_recall AS ok, greatest(fpr / max_fpr - 1, 0) + greatest(min_recall - recall, 0) / min_recall AS over FROM swp, g),
 b AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE over END, recall DESC, fpr, threshold DESC) rn FROM c)
 SELECT gate, threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, CASE WHEN neg < ceil(1 / max_fpr) OR pos = 0 THEN 'inconclusive' WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM b WHERE rn = 1""")
def operating_gates(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.operating_gates(views.labelled(spark, d)), "recall", "fpr")


CALIBRATED = """,
 neg AS (SELECT fold, score, row_number() OVER (PARTITION BY fold ORDER BY score DESC) rn, count(*) OVER (PARTITION BY fold) n, min(score) OVER (PARTITION BY fold) least FROM labelled WHERE NOT label),
 cal AS (SELECT fold, n AS negatives, coalesce(nextafter(max(score) FILTER (rn = floor(0.02 * n) + 1), CAST('infinity' AS DOUBLE)), least) AS threshold FROM neg GROUP BY fold, n, least) """


@query(ctes("scores", "labelled")[:-1] + CALIBRATED + "SELECT * FROM cal")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibrated_threshold(views.labelled(spark, d), 0.02, "fold")


@query(ctes("scores", "labelled")[:-1] + CALIBRATED + """
 SELECT l.fold, count(*) FILTER (label AND score >= threshold) tp, count(*) FILTER (NOT label AND score >= threshold) fp, count(*) FILTER (NOT label AND score < threshold) tn, count(*) FILTER (label AND score < threshold) fn,
 round(count(*) FILTER (label AND score >= threshold) / nullif(count(*) FILTER (label), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (NOT label AND score >= threshold) / nullif(count(*) FILTER (NOT label), 0)::DOUBLE, 6) AS fpr
 FROM labelled l JOIN cal ON l.fold = cal.fold GROUP BY l.fold""")
def locked_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = views.labelled(spark, d)
    cut = metrics.calibrated_threshold(rows, 0.02, "fold").select("fold", "threshold")
    return r6(metrics.confusion(rows.join(cut, "fold"), F.col("threshold"), ["fold"]), "recall", "fpr")


@query(ctes("scores", "labelled")[:-1] + """, g AS (SELECT anomaly_kind, count(*) support, count(*) FILTER (score >= 0.5) detected FROM labelled WHERE label AND coalesce(anomaly_kind, '') <> '' GROUP BY anomaly_kind),
 w AS (SELECT *, detected / support::DOUBLE p, 1.959963984540054::DOUBLE z FROM g)
 SELECT anomaly_kind, support, detected, round(p, 6) AS recall, round(greatest(0, (p + z*z/(2*support) - z*sqrt(p*(1-p)/support + z*z/(4.0*support*support))) / (1 + z*z/support)), 6) AS low, round(least(1, (p + z*z/(2*support) + z*sqrt(p*(1-p)/support + z*z/(4.0*support*support))) / (1 + z*z/support)), 6) AS high FROM w""")
def recall_by_group(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.recall_by_group(views.labelled(spark, d), "anomaly_kind", 0.5), "recall", "low", "high")


@query(STEPS + "SELECT threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM swp WHERE fpr <= 0.05 ORDER BY recall DESC, swp.fpr, threshold DESC LIMIT 1")
def diagnostic_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.diagnostic_threshold(views.labelled(spark, d), 0.05), "recall", "fpr")


@query(ctes("scores", "labelled") + "SELECT CASE WHEN label AND score >= 0.5 THEN 'TP' WHEN label THEN 'FN' WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n FROM labelled GROUP BY 1")
def outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("score") >= 0.5
    kind = F.when(F.col("label") & hit, "TP").when(F.col("label"), "FN").when(hit, "FP").otherwise("TN")
    return views.labelled(spark, d).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query(ctes("scores", "labelled")[:-1] + """, c AS (SELECT t.t AS threshold, count(*) FILTER (label AND score >= t.t) / nullif(count(*) FILTER (label), 0)::DOUBLE r, count(*) FILTER (NOT label AND score >= t.t) / nullif(count(*) FILTER (NOT label), 0)::DOUBLE f FROM labelled, (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) t(t) GROUP BY t.t)
 SELECT threshold, p.p AS prevalence, round(CASE WHEN p.p * r + (1 - p.p) * f > 0 THEN p.p * r / (p.p * r + (1 - p.p) * f) ELSE 0 END, 6) AS ppv FROM c, (VALUES (0.0001::DOUBLE), (0.001), (0.01), (0.1)) p(p)""")
def base_rate_table(spark: SparkSession, d: str) -> DataFrame:
    rows = views.labelled(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7, 0.9)])))
    c = metrics.confusion(rows, F.col("threshold"), ["threshold"]).withColumn("prevalence", F.explode(F.array(*[F.lit(p) for p in (0.0001, 0.001, 0.01, 0.1)])))
    return c.select("threshold", "prevalence", F.round(metrics.base_rate_ppv(F.col("prevalence"), F.coalesce("recall", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0))), 6).alias("ppv"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.percentiles(table(spark, d, "events"), "event_type", "value", [0.5, 0.95])
    return got.select("event_type", "n", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"))


@query("""SELECT model_id, bool_and(risk_score IS NOT NULL AND NOT isnan(risk_score)) AS all_scored, bool_or(risk_score > 1 AND NOT isnan(risk_score)) AS any_over,
 list_filter([CASE WHEN NOT bool_and(risk_score IS NOT NULL AND NOT isnan(risk_score)) THEN 'missing scores' END, CASE WHEN NOT bool_and(coalesce(risk_score, 0) BETWEEN 0 AND 1) THEN 'out of range' END, CASE WHEN NOT bool_or(fold = -1) THEN 'no locked rows' END], lambda x: x IS NOT NULL) AS gaps FROM crop_scores GROUP BY model_id""")
def capability_rollup(spark: SparkSession, d: str) -> DataFrame:
    have, fits = F.col("risk_score").isNotNull() & ~F.isnan("risk_score"), F.coalesce("risk_score", F.lit(0.0)).between(0, 1)
    g = table(spark, d, "crop_scores").groupBy("model_id").agg(F.bool_and(have).alias("all_scored"), F.bool_or((F.col("risk_score") > 1) & ~F.isnan("risk_score")).alias("any_over"), F.bool_and(fits).alias("fits"), F.bool_or(F.col("fold") == -1).alias("locked"))
    gaps = queues.reason_tags({"missing scores": ~F.col("all_scored"), "out of range": ~F.col("fits"), "no locked rows": ~F.col("locked")})
    return g.select("model_id", "all_scored", "any_over", gaps.alias("gaps"))


@query(ctes("images")[:-1] + """, t(image_label, split_role, target) AS (VALUES ('ABNORMAL', 'DEV', 60), ('NORMAL', 'DEV', 20), ('ABNORMAL', 'LOCKED_TEST', 20), ('NORMAL', 'LOCKED_TEST', 20), ('NORMAL', 'NORMAL_REPLAY', 200))
 SELECT t.image_label, t.split_role, t.target, count(i.image_id) AS n, CASE WHEN count(i.image_id) >= t.target THEN 'ok' ELSE 'short by ' || (t.target - count(i.image_id)) END AS status FROM t LEFT JOIN images i ON i.image_label = t.image_label AND i.split_role = t.split_role GROUP BY t.image_label, t.split_role, t.target""")
def budget_report(spark: SparkSession, d: str) -> DataFrame:
    goals = spark.createDataFrame([("ABNORMAL", "DEV", 60), ("NORMAL", "DEV", 20), ("ABNORMAL", "LOCKED_TEST", 20), ("NORMAL", "LOCKED_TEST", 20), ("NORMAL", "NORMAL_REPLAY", 200)], "image_label string, split_role string, target int")
    have = views.images(spark, d).groupBy("image_label", "split_role").agg(F.count("*").alias("n"))
    j = goals.join(have, ["image_label", "split_role"], "left").fillna(0, ["n"])
    return j.withColumn("status", F.when(F.col("n") >= F.col("target"), "ok").otherwise(F.concat(F.lit("short by "), (F.col("target") - F.col("n")).cast("string"))))


@query(ctes("images") + "SELECT license_id, split_role, count(*) AS n, count(DISTINCT source_group_id) AS source_groups, count(*) FILTER (NOT production_allowed) AS not_allowed FROM images GROUP BY license_id, split_role")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).groupBy("license_id", "split_role").agg(F.count("*").alias("n"), F.count_distinct("source_group_id").alias("source_groups"), F.count_if(~F.col("production_allowed")).alias("not_allowed"))


# ---- constraints ----


@query("SELECT 'unique_key' AS \"constraint\", crop_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM crop_scores GROUP BY crop_id HAVING count(*) > 1")
def dup_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.unique_key(table(spark, d, "crop_scores"), "crop_id")


BAD_BOX = "len(list_filter(characters, lambda c: NOT coalesce(c.box.x0 >= 0 AND c.box.y0 >= 0 AND c.box.x1 <= width AND c.box.y1 <= height AND c.box.x1 > c.box.x0 AND c.box.y1 > c.box.y0, false)))"


@query("""SELECT unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(image_sha256, '[0-9a-f]{64}'), false) THEN 'sha' END, CASE WHEN NOT coalesce(image_label IN ('NORMAL', 'ABNORMAL'), false) THEN 'label' END,
 CASE WHEN NOT coalesce(NOT (training_eligible AND upper(trim(split_role)) = 'LOCKED_TEST'), false) THEN 'locked' END, CASE WHEN NOT coalesce(""" + BAD_BOX + """ = 0, false) THEN 'box' END,
 CASE WHEN NOT coalesce(image_label <> 'NORMAL' OR len(list_filter(characters, lambda c: c.decision = 'BLOCK')) = 0, false) THEN 'normal_block' END,
 CASE WHEN NOT (image_path IS NOT NULL AND NOT regexp_matches(image_path, '^[/\\\\]') AND NOT regexp_matches(image_path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AND length(image_path) > 0) THEN 'path' END], lambda x: x IS NOT NULL)) AS "constraint", image_id AS key, NULL::VARCHAR AS detail FROM real_manifest""")
def condition_violations(spark: SparkSession, d: str) -> DataFrame:
    box = F.forall("characters", lambda c: F.coalesce((c["box"]["x0"] >= 0) & (c["box"]["y0"] >= 0) & (c["box"]["x1"] <= F.col("width")) & (c["box"]["y1"] <= F.col("height")) & (c["box"]["x1"] > c["box"]["x0"]) & (c["box"]["y1"] > c["box"]["y0"]), F.lit(False)))
    rules = {
        "sha": F.col("image_sha256").rlike(constraints.SHA256),
        "label": F.col("image_label").isin("NORMAL", "ABNORMAL"),
        "locked": ~(F.col("training_eligible") & (F.upper(F.trim("split_role")) == "LOCKED_TEST")),
        "box": box,
        "normal_block": (F.col("image_label") != "NORMAL") | (F.size(F.filter("characters", lambda c: c["decision"] == "BLOCK")) == 0),
        "path": constraints.contained_path(F.col("image_path")),
    }
    return constraints.conditions(table(spark, d, "real_manifest"), "image_id", rules)


@query("SELECT 'foreign_key' AS \"constraint\", image_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM crop_scores WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM real_manifest) GROUP BY image_id")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.foreign_key(table(spark, d, "crop_scores"), "image_id", table(spark, d, "real_manifest"), "image_id")


@query("SELECT 'same_keys' AS \"constraint\", coalesce(a.image_id, b.image_id) AS key, CASE WHEN a.image_id IS NULL THEN 'missing left' ELSE 'missing right' END AS detail FROM (SELECT DISTINCT image_id FROM real_manifest) a FULL JOIN (SELECT DISTINCT image_id FROM fold_manifest) b ON a.image_id = b.image_id WHERE a.image_id IS NULL OR b.image_id IS NULL")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return constraints.same_keys(table(spark, d, "real_manifest"), table(spark, d, "fold_manifest"), "image_id")


_PIXELS = f"nullif(regexp_replace({canon_sql('pixel_sha256')}, '^(sha256[:=]?|0x)', ''), '')"


@query(f"SELECT 'disjoint' AS \"constraint\", h AS key, string_agg(DISTINCT r, ',' ORDER BY r) AS detail FROM (SELECT {_PIXELS} AS h, {canon_sql('split_role')} AS r FROM glyph_items) t WHERE h IS NOT NULL AND r IS NOT NULL GROUP BY h HAVING count(DISTINCT r) > 1")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "glyph_items").select(text.canon_digest("pixel_sha256").alias("h"), text.canon_col("split_role").alias("r"))
    return constraints.disjoint(rows, "h", "r")


@query("SELECT 'determines' AS \"constraint\", source_group_id AS key, CAST(count(DISTINCT split_role) AS VARCHAR) AS detail FROM real_manifest GROUP BY source_group_id HAVING count(DISTINCT split_role) > 1")
def fd_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.determines(table(spark, d, "real_manifest"), "source_group_id", "split_role")


@query("SELECT 'determines' AS \"constraint\", component_id AS key, CAST(count(DISTINCT fold) AS VARCHAR) AS detail FROM fold_manifest GROUP BY component_id HAVING count(DISTINCT fold) > 1")
def component_fold_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.determines(table(spark, d, "fold_manifest"), "component_id", "fold")


@query(ctes("images", "folds") + "SELECT 'fields_match' AS \"constraint\", key, unnest(list_filter([CASE WHEN a IS DISTINCT FROM b THEN 'image_label' END, CASE WHEN r IS DISTINCT FROM s THEN 'split_role' END], lambda x: x IS NOT NULL)) AS detail FROM (SELECT i.image_id AS key, i.image_label a, f.image_label b, i.split_role r, f.split_role s FROM images i JOIN folds f ON i.image_id = f.image_id) t")
def field_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return constraints.fields_match(views.images(spark, d), views.folds(spark, d), "image_id", ["image_label", "split_role"])


@query("SELECT 'contiguous_folds' AS \"constraint\", CAST(coalesce(w.f, h.fold) AS VARCHAR) AS key, CASE WHEN w.f IS NULL THEN 'unexpected' ELSE 'missing' END AS detail FROM (SELECT unnest(range(6)) f) w FULL JOIN (SELECT DISTINCT fold FROM fold_manifest WHERE fold >= 0) h ON w.f = h.fold WHERE w.f IS NULL OR h.fold IS NULL")
def fold_range(spark: SparkSession, d: str) -> DataFrame:
    return constraints.contiguous_folds(table(spark, d, "fold_manifest"), "fold", 6)


@query("SELECT 'fold_isolation' AS \"constraint\", crop_id AS key, CAST(fold AS VARCHAR) AS detail FROM crop_scores WHERE NOT coalesce(list_contains(excluded_folds, fold), false)")
def fold_isolation(spark: SparkSession, d: str) -> DataFrame:
    return constraints.fold_isolation(table(spark, d, "crop_scores"), "crop_id", "fold", "excluded_folds")


@query("SELECT 'independent_models' AS \"constraint\", crop_id AS key, NULL::VARCHAR AS detail FROM review_candidates WHERE score_model_id = disagreement_model_id OR score_artifact_sha256 = disagreement_artifact_sha256")
def model_independence(spark: SparkSession, d: str) -> DataFrame:
    return constraints.independent_models(table(spark, d, "review_candidates"), "crop_id", ["score_model_id", "score_artifact_sha256"], ["disagreement_model_id", "disagreement_artifact_sha256"])


@query("""SELECT unnest(list_filter([CASE WHEN NOT coalesce(decision <> 'PASS' OR changed_pixels = 0, false) THEN 'pass_unchanged' END, CASE WHEN NOT coalesce(decision <> 'BLOCK' OR changed_pixels > 0, false) THEN 'block_changed' END, CASE WHEN NOT coalesce(training_eligible = (split_role = 'train'), false) THEN 'eligible_role' END], lambda x: x IS NOT NULL)) AS "constraint", sample_id AS key, NULL::VARCHAR AS detail FROM glyph_items""")
def glyph_violations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = {"pass_unchanged": (c("decision") != "PASS") | (c("changed_pixels") == 0), "block_changed": (c("decision") != "BLOCK") | (c("changed_pixels") > 0), "eligible_role": c("training_eligible") == (c("split_role") == "train")}
    return constraints.conditions(table(spark, d, "glyph_items").select("sample_id", "decision", "changed_pixels", "training_eligible", "split_role"), "sample_id", rules)


@query("""SELECT 'finite_range' AS "constraint", crop_id AS key, CASE WHEN risk_score IS NULL THEN 'null' WHEN isnan(risk_score) THEN 'nan' WHEN isinf(risk_score) THEN 'infinite' ELSE 'outside' END AS detail FROM crop_scores WHERE risk_score IS NULL OR isnan(risk_score) OR NOT risk_score BETWEEN 0 AND 1""")
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.finite_range(table(spark, d, "crop_scores"), "crop_id", "risk_score", 0.0, 1.0)


@query(ctes("images", "scores") + """SELECT 'counts_match' AS "constraint", coalesce(a.image_id, e.image_id) AS key, coalesce(a.n, 0) || ' of ' || coalesce(e.n, 0) AS detail FROM (SELECT image_id, count(*) n FROM scores WHERE image_id IS NOT NULL GROUP BY image_id) a
 FULL JOIN (SELECT image_id, coalesce(len(characters), 0) n FROM images) e ON a.image_id = e.image_id WHERE coalesce(a.n, 0) <> coalesce(e.n, 0)""")
def denominator_check(spark: SparkSession, d: str) -> DataFrame:
    have = views.scores(spark, d).where("image_id IS NOT NULL").groupBy("image_id").agg(F.count("*").alias("n"))
    want = views.images(spark, d).select("image_id", F.when(F.col("characters").isNull(), 0).otherwise(F.size("characters")).cast("long").alias("n"))
    return constraints.counts_match(have, want, ["image_id"])


@query(f"SELECT 'unapproved' AS \"constraint\", s AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT {canon_sql('source_id')} AS s, production_allowed FROM real_manifest) t WHERE NOT coalesce(production_allowed, false) GROUP BY s")
def licence_gate(spark: SparkSession, d: str) -> DataFrame:
    return constraints.unapproved(table(spark, d, "real_manifest").select(text.canon_col("source_id").alias("s"), "production_allowed"), "s", "production_allowed")


@query("SELECT 'rank_sequence' AS \"constraint\", queue_version AS key, concat_ws('|', count(*), count(DISTINCT priority_rank), min(priority_rank), max(priority_rank)) AS detail FROM review_candidates GROUP BY queue_version HAVING NOT coalesce(count(*) = count(DISTINCT priority_rank) AND min(priority_rank) = 1 AND max(priority_rank) = count(*), false)")
def queue_ranks(spark: SparkSession, d: str) -> DataFrame:
    return constraints.rank_sequence(table(spark, d, "review_candidates"), "queue_version", "priority_rank")


_BLOCKS = "SELECT g, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM (SELECT g, b, count(*) AS n, sha256(string_agg(v, chr(10) ORDER BY k, v)) AS h FROM (SELECT *, substr(sha256(k), 1, 2) AS b FROM r) x GROUP BY g, b) y GROUP BY g"


@query("WITH r AS (SELECT queue_version AS g, crop_id AS k, sha256(crop_id || chr(0) || coalesce(CAST(priority_rank AS VARCHAR), '') || chr(0) || coalesce(style_id, '')) AS v FROM review_candidates WHERE crop_id IS NOT NULL) SELECT g AS queue_version, n, digest FROM (" + _BLOCKS + ") z")
def queue_digests(spark: SparkSession, d: str) -> DataFrame:
    row = F.sha2(F.concat_ws("\0", "crop_id", F.coalesce(F.col("priority_rank").cast("string"), F.lit("")), F.coalesce("style_id", F.lit(""))), 256)
    rows = table(spark, d, "review_candidates").where("crop_id IS NOT NULL").select("queue_version", "crop_id", row.alias("v"))
    return constraints.block_digest(rows, "queue_version", "crop_id", "v")


@query(ctes("images", "folds") + """SELECT 'merged_maps' AS "constraint", image_id AS key, coalesce(min(image_label), 'null') || '|' || max(image_label) AS detail FROM (SELECT image_id, image_label FROM images UNION ALL SELECT image_id, image_label FROM folds) t GROUP BY image_id HAVING count(DISTINCT image_label) + (count(*) > count(image_label))::INTEGER > 1""")
def label_map_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return constraints.merged_maps([views.images(spark, d), views.folds(spark, d)], "image_id", "image_label")[1]


@query("""SELECT DISTINCT model_id, parent_checkpoint_sha256 AS parent FROM crop_scores WHERE parent_checkpoint_sha256 IS NOT NULL AND parent_checkpoint_sha256 NOT IN (SELECT checkpoint_sha256 FROM crop_scores WHERE checkpoint_sha256 IS NOT NULL)""")
def lineage_breaks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "crop_scores").select("model_id", "checkpoint_sha256", F.col("parent_checkpoint_sha256").alias("parent")).distinct()
    return progress.lineage_breaks(m, "checkpoint_sha256", "parent").select("model_id", "parent").distinct()


@query(ctes("images")[:-1] + f""", g AS (SELECT {canon_sql('source_id')} AS source, count(*) AS n, count(*) FILTER (production_allowed) AS k FROM images GROUP BY 1), w AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM g)
 SELECT source, n, k, round(p, 6) AS share, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high FROM w""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    g = views.images(spark, d).groupBy(text.canon_col("source_id").alias("source")).agg(F.count("*").alias("n"), F.count_if("production_allowed").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return r6(g.select("source", "n", "k", (F.col("k") / F.col("n")).alias("share"), low.alias("low"), high.alias("high")), "share", "low", "high")


# ---- filters, joins, sets ----

ELIGIBLE = "training_eligible AND split_role IN ('DEV', 'IMAGE_ONLY', 'NORMAL_REPLAY')"


@query(ctes("images") + f"SELECT count(*) AS n, count(*) FILTER ({ELIGIBLE}) AS eligible, count(*) FILTER (split_role = 'LOCKED_TEST') AS locked FROM images")
def locked_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).agg(F.count("*").alias("n"), F.count_if(F.expr(ELIGIBLE)).alias("eligible"), F.count_if(F.col("split_role") == "LOCKED_TEST").alias("locked"))


@query("SELECT sample_id, split_role, changed_pixels FROM glyph_items WHERE split_role = 'test' AND changed_pixels > 200")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glyph_items").where("split_role = 'test' AND changed_pixels > 200").select("sample_id", "split_role", "changed_pixels")


@query(ctes("scores", "images", "folds") + "SELECT i.split_role, f.fold, s.decision, count(*) AS n, round(avg(s.risk_score), 6) AS mean_risk FROM scores s JOIN images i ON s.image_id = i.image_id JOIN folds f ON s.image_id = f.image_id GROUP BY ALL")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    j = views.scores(spark, d).select("image_id", "decision", "risk_score").join(views.images(spark, d).select("image_id", "split_role"), "image_id").join(views.folds(spark, d).select("image_id", "fold"), "image_id")
    return j.groupBy("split_role", "fold", "decision").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 6).alias("mean_risk"))


@query(ctes("scores", "images", "folds", "queue") + f"SELECT s.crop_id, s.image_id, f.fold, s.risk_score FROM scores s JOIN folds f ON s.image_id = f.image_id WHERE s.crop_id IN (SELECT crop_id FROM queue WHERE label IS NOT NULL) AND s.image_id IN (SELECT image_id FROM images WHERE {ELIGIBLE})")
def chain_join(spark: SparkSession, d: str) -> DataFrame:
    ok = views.images(spark, d).where(ELIGIBLE).select("image_id")
    got = views.queue(spark, d).where("label IS NOT NULL").select("crop_id")
    s = views.scores(spark, d).select("crop_id", "image_id", "risk_score").join(got, "crop_id", "left_semi").join(ok, "image_id", "left_semi")
    return s.join(views.folds(spark, d).select("image_id", "fold"), "image_id").select("crop_id", "image_id", "fold", "risk_score")


@query("SELECT 'kept' AS part, count(*) AS n FROM (SELECT image_id FROM real_manifest INTERSECT SELECT image_id FROM fold_manifest) t UNION ALL SELECT 'unfolded', count(*) FROM (SELECT image_id FROM real_manifest EXCEPT SELECT image_id FROM fold_manifest) t UNION ALL SELECT 'unscored', count(*) FROM (SELECT image_id FROM real_manifest EXCEPT SELECT image_id FROM crop_scores) t")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    m, f, s = (table(spark, d, t).select("image_id").distinct() for t in ("real_manifest", "fold_manifest", "crop_scores"))
    parts = {"kept": m.join(f, "image_id", "left_semi"), "unfolded": m.join(f, "image_id", "left_anti"), "unscored": m.join(s, "image_id", "left_anti")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT image_id, position, c.annotation_id AS annotation_id, c.decision AS decision, c.box.x1 - c.box.x0 AS w, c.box.y1 - c.box.y0 AS h FROM (SELECT image_id, unnest(characters) AS c, unnest(range(len(characters))) AS position FROM real_manifest) t")
def exploded_characters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "real_manifest").select("image_id", F.posexplode("characters").alias("position", "c"))
    return e.select("image_id", F.col("position").cast("long").alias("position"), "c.annotation_id", "c.decision", (F.col("c.box.x1") - F.col("c.box.x0")).alias("w"), (F.col("c.box.y1") - F.col("c.box.y0")).alias("h"))


@query("SELECT image_id, c.annotation_id AS annotation_id, greatest(c.box.x0 - 8, 0) AS x0, greatest(c.box.y0 - 8, 0) AS y0, least(c.box.x1 + 8, width) AS x1, least(c.box.y1 + 8, height) AS y1 FROM (SELECT image_id, width, height, unnest(characters) AS c FROM real_manifest) t")
def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "real_manifest").select("image_id", "width", "height", F.explode("characters").alias("c"))
    return e.select("image_id", "c.annotation_id", text.clamped_box(F.col("c.box"), 8, F.col("width"), F.col("height")).alias("b")).select("image_id", "annotation_id", "b.*")


# ---- bags and folds ----


@query(ctes("images", "scores") + "SELECT i.image_id, count(s.crop_id) AS characters, max(s.risk_score) AS top FROM images i LEFT JOIN scores s ON i.image_id = s.image_id GROUP BY i.image_id")
def bags_with_empty(spark: SparkSession, d: str) -> DataFrame:
    g = views.scores(spark, d).groupBy("image_id").agg(F.count("*").alias("characters"), F.max("risk_score").alias("top"))
    return views.images(spark, d).select("image_id").join(g, "image_id", "left").fillna(0, ["characters"])


@query(ctes("images", "scores")[:-1] + f""", r AS (SELECT s.fold, coalesce({ELIGIBLE}, false) e, s.decision IN ('PASS', 'BLOCK') a FROM scores s JOIN images i ON s.image_id = i.image_id)
 SELECT CAST(h.k AS INTEGER) AS held, count(*) FILTER (fold = h.k) AS scoring, count(*) FILTER (fold <> h.k AND fold >= 0 AND e AND a) AS training, count(*) FILTER (fold <> h.k AND e AND NOT a) AS review FROM r, (SELECT unnest(range(5)) k) h GROUP BY h.k""")
def gold_split(spark: SparkSession, d: str) -> DataFrame:
    j = views.scores(spark, d).join(views.images(spark, d).select("image_id", F.coalesce(F.expr(ELIGIBLE), F.lit(False)).alias("e")), "image_id")
    return bags.fold_plan(j, "fold", F.col("e"), F.col("decision").isin("PASS", "BLOCK"), 5)


@query(ctes("scores")[:-1] + """, f AS (SELECT CAST(unnest(range(5)) AS INTEGER) k), c AS (SELECT fold, count(*) n FROM scores WHERE fold >= 0 GROUP BY fold)
 SELECT a.k AS outer_fold, b.k AS scoring_fold, list_sort(list_distinct([a.k, b.k])) AS excluded, CAST(sum(CASE WHEN c.fold <> a.k AND c.fold <> b.k THEN n ELSE 0 END) AS BIGINT) AS training FROM f a, f b, c GROUP BY a.k, b.k""")
def nested_fold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bags.nested_pairs(views.scores(spark, d), "fold", 5)


POOL = "SELECT i.image_id, coalesce(characters, 0) AS characters, round(1 / (1 + exp(-coalesce(ln(1 + exp(1.0)) * 0.5 * (wr / w + top), -2.0))), 6) AS score FROM (SELECT DISTINCT image_id FROM images) i LEFT JOIN (SELECT image_id, count(*) characters, sum(exp(1 / (1 + exp(-0.7)) * risk_score)) w, sum(exp(1 / (1 + exp(-0.7)) * risk_score) * risk_score) wr, max(risk_score) top FROM scores GROUP BY image_id) p ON i.image_id = p.image_id"


@query(ctes("images", "scores") + POOL)
def mil_score(spark: SparkSession, d: str) -> DataFrame:
    return r6(bags.pooled_scores(views.images(spark, d), views.scores(spark, d), "image_id", "risk_score", 0.7), "score")


@query(ctes("scores") + "SELECT image_id, crop_id, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY risk_score DESC, crop_id) rn FROM scores) t WHERE rn = 1")
def attention_top1(spark: SparkSession, d: str) -> DataFrame:
    return bags.top_instance(views.scores(spark, d), "image_id", "crop_id", "risk_score")


# ---- identity graph ----


def _phashes(spark: SparkSession, d: str) -> DataFrame:
    half = lambda at: F.conv(F.substring("phash", at, 8), 16, 10).cast("long")
    return views.folds(spark, d).where("phash RLIKE '^[0-9A-Fa-f]{16}$'").select("image_id", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("code"))


HAMMING = """, hc AS (SELECT image_id, CAST('0x' || phash AS UBIGINT) AS code FROM folds WHERE regexp_full_match(phash, '[0-9A-Fa-f]{16}')), hr AS (SELECT code, min(image_id) rep FROM hc GROUP BY code),
 hp AS (SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.code, y.code)) AS INTEGER) AS distance FROM hr x JOIN hr y ON x.rep < y.rep AND bit_count(xor(x.code, y.code)) <= 10 UNION ALL SELECT hr.rep, hc.image_id, 0 FROM hc JOIN hr USING (code) WHERE hc.image_id <> hr.rep) """


@query(ctes("folds")[:-1] + HAMMING + "SELECT a, b, distance FROM hp")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return grouping.hamming_pairs(_phashes(spark, d), "image_id", "code", 10)


IDENTITY = ["image_sha256", "product_id", "campaign_id", "template_id", "source_group_id"]


def _identity(spark: SparkSession, d: str) -> DataFrame:
    m = views.images(spark, d).select("image_id", *IDENTITY)
    near = hamming_pairs(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return grouping.component_ids(m, "image_id", grouping.equality_edges(m, "image_id", IDENTITY).unionByName(near))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    m = views.images(spark, d).select("image_id", "image_sha256", "source_group_id")
    return grouping.component_ids(m, "image_id", grouping.equality_edges(m, "image_id", ["image_sha256", "source_group_id"]))


def _component_sql(columns: list[str], near: bool) -> str:
    values = " UNION ALL ".join(f"SELECT image_id, '{c}:' || {c} AS val FROM images WHERE {c} IS NOT NULL" for c in columns)
    return ctes("images", "folds")[:-1] + (HAMMING[:-1] if near else "") + f""", v AS ({values}), lo AS (SELECT val, min(image_id) m FROM v GROUP BY val),
 e AS (SELECT DISTINCT m AS a, image_id AS b FROM v JOIN lo USING (val) WHERE m <> image_id{" UNION SELECT a, b FROM hp" if near else ""}), ee AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 nodes AS (SELECT image_id AS id FROM images UNION SELECT a FROM ee), cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT u.id, min(v.comp) FROM recurring.cc AS u JOIN ee ON ee.b = u.id JOIN cc AS v ON v.id = ee.a WHERE v.comp < u.comp GROUP BY u.id)),
 comp AS (SELECT i.image_id, cc.comp AS component FROM images i JOIN cc ON i.image_id = cc.id) """


COMPONENTS, GROUPS = _component_sql(IDENTITY, True), _component_sql(["image_sha256", "source_group_id"], False)
DIGESTS = "SELECT component, count(*) AS size, substr(sha256(string_agg(image_id, chr(0) ORDER BY image_id)), 1, 16) AS digest FROM comp GROUP BY component"
LEAKAGE = "SELECT component, count(*) FILTER (coalesce(split_role = 'LOCKED_TEST', false)) AS locked, count(*) FILTER (NOT coalesce(split_role = 'LOCKED_TEST', false)) AS open FROM comp JOIN images USING (image_id) GROUP BY component HAVING count(*) FILTER (coalesce(split_role = 'LOCKED_TEST', false)) > 0 AND count(*) FILTER (NOT coalesce(split_role = 'LOCKED_TEST', false)) > 0"


@query(COMPONENTS + DIGESTS)
def components(spark: SparkSession, d: str) -> DataFrame:
    return grouping.component_digest(_identity(spark, d), "image_id")


@query(GROUPS + DIGESTS)
def group_components(spark: SparkSession, d: str) -> DataFrame:
    return grouping.component_digest(_groups(spark, d), "image_id")


def _leakage(spark: SparkSession, d: str, parts: DataFrame) -> DataFrame:
    j = parts.join(views.images(spark, d).select("image_id", "split_role"), "image_id")
    return grouping.mixed_components(j, F.coalesce(F.col("split_role") == "LOCKED_TEST", F.lit(False)))


@query(COMPONENTS + LEAKAGE)
def component_leakage(spark: SparkSession, d: str) -> DataFrame:
    return _leakage(spark, d, _identity(spark, d))


@query(GROUPS + LEAKAGE)
def group_leakage(spark: SparkSession, d: str) -> DataFrame:
    return _leakage(spark, d, _groups(spark, d))


#: The placing one by one, as a recursion over the components in order.
FOLDS = """, k AS (SELECT component, bool_or(coalesce(split_role = 'LOCKED_TEST', false)) AS locked, count(*) FILTER (coalesce(image_label = 'ABNORMAL', false)) AS pos, count(*) FILTER (NOT coalesce(image_label = 'ABNORMAL', false)) AS neg FROM comp JOIN images USING (image_id) GROUP BY component),
 o AS MATERIALIZED (SELECT pos, neg, row_number() OVER (ORDER BY pos + neg DESC, pos DESC) AS rn FROM k WHERE NOT locked), w AS MATERIALIZED (SELECT greatest(1, coalesce(sum(pos), 0))::DOUBLE AS p, greatest(1, coalesce(sum(neg), 0))::DOUBLE AS n FROM o),
 f(rn, p, n, c) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
  SELECT rn, list_transform([1, 2, 3, 4, 5], lambda i: p[i] + CASE WHEN i = best THEN pos ELSE 0 END), list_transform([1, 2, 3, 4, 5], lambda i: n[i] + CASE WHEN i = best THEN neg ELSE 0 END), list_transform([1, 2, 3, 4, 5], lambda i: c[i] + CASE WHEN i = best THEN 1 ELSE 0 END)
  FROM (SELECT o.rn, f.p, f.n, f.c, o.pos, o.neg, list_sort(list_transform([1, 2, 3, 4, 5], lambda i: {'x': round(CASE WHEN o.pos > 0 THEN (f.p[i] + o.pos) / w.p ELSE 0 END + CASE WHEN o.neg > 0 THEN (f.n[i] + o.neg) / w.n ELSE 0 END, 12), 'l': f.p[i] + f.n[i], 'i': i}))[1].i AS best FROM f JOIN o ON o.rn = f.rn + 1, w) s),
 z AS (SELECT * FROM f ORDER BY rn DESC LIMIT 1)
 SELECT fold, n, abnormal, components FROM (SELECT CAST(i - 1 AS INTEGER) AS fold, p[i] + n[i] AS n, p[i] AS abnormal, c[i] AS components FROM z, (SELECT unnest(range(1, 6)) AS i) t) q WHERE components > 0
 UNION ALL SELECT -1, CAST(sum(pos + neg) AS BIGINT), CAST(sum(pos) AS BIGINT), count(*) FROM k WHERE locked HAVING count(*) > 0"""


def _folded(spark: SparkSession, d: str, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = views.images(spark, d).select("image_id", F.coalesce(F.col("image_label") == "ABNORMAL", F.lit(False)).alias("abnormal"), F.coalesce(F.col("split_role") == "LOCKED_TEST", F.lit(False)).alias("is_locked"))
    rows = written(parts.join(i, "image_id"), "fold-parts")
    return rows, grouping.balanced_folds(rows, "abnormal", "is_locked")


def _balance(spark: SparkSession, d: str, parts: DataFrame) -> DataFrame:
    rows, folds_ = _folded(spark, d, parts)
    return rows.join(folds_, "component").groupBy("fold").agg(F.count("*").alias("n"), F.count_if("abnormal").alias("abnormal"), F.count_distinct("component").alias("components"))


@query()
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d, _identity(spark, d))[1]


@query(COMPONENTS[:-1] + FOLDS)
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    return _balance(spark, d, _identity(spark, d))


@query(GROUPS[:-1] + FOLDS)
def group_fold_balance(spark: SparkSession, d: str) -> DataFrame:
    return _balance(spark, d, _groups(spark, d))


# ---- vectors ----

UNIT = ctes("vectors")[:-1] + """, u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM vectors),
 fl AS (SELECT label, unnest(range(len(e))) AS dim, unnest(e) AS v FROM u), mn AS (SELECT label, dim, avg(v) AS v FROM fl GROUP BY label, dim),
 nm AS (SELECT label, sqrt(sum(v * v)) AS nrm FROM mn GROUP BY label), ce AS (SELECT label, list(v / nrm ORDER BY dim) AS c FROM mn JOIN nm USING (label) GROUP BY label) """
NEAREST = UNIT[:-1] + """, ds AS (SELECT vec_id, u.label AS own, ce.label, 1 - list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * c[i])) AS dd FROM u, ce),
 rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, label) rn FROM ds) """


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return vectors.class_centres(views.vectors(spark, d), "label", "embedding")


@query(UNIT + "SELECT label, CAST(dim AS INTEGER) AS dim, round(v / nrm, 6) AS value FROM mn JOIN nm USING (label)")
def prototype_centers(spark: SparkSession, d: str) -> DataFrame:
    return _centres(spark, d).select("label", F.posexplode("centre").alias("dim", "value")).select("label", "dim", F.round("value", 6).alias("value"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_class(views.vectors(spark, d), "vec_id", "embedding", _centres(spark, d), "label")


@query(NEAREST + "SELECT a.vec_id, a.label AS nearest, round(a.dd, 6) AS distance, round(b.dd, 6) AS second, round(b.dd - a.dd, 6) AS margin FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.rn = 1 AND b.rn = 2")
def nearest_class(spark: SparkSession, d: str) -> DataFrame:
    return r6(_nearest(spark, d), "distance", "second", "margin")


@query(NEAREST + "SELECT count(*) AS n, round(avg((own = label)::INTEGER), 6) AS accuracy FROM rk WHERE rn = 1")
def prototype_accuracy(spark: SparkSession, d: str) -> DataFrame:
    own = views.vectors(spark, d).select("vec_id", "label")
    return _nearest(spark, d).join(own, "vec_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("nearest") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query(UNIT[:-1] + """, pr AS (SELECT a.vec_id, b.vec_id AS neighbour, 1 - list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS dd FROM u a JOIN u b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
 SELECT vec_id, neighbour, round(dd, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dd, 12), neighbour) rn FROM pr) t WHERE rn = 1""")
def own_class_nn(spark: SparkSession, d: str) -> DataFrame:
    v = views.vectors(spark, d)
    return r6(vectors.own_class_neighbour(v.where("vec_id % 100 = 0"), v, "vec_id", "label", "embedding"), "distance")


@query("SELECT count(*) AS rows, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round((SELECT avg(v) FROM (SELECT var_pop(x::DOUBLE) v FROM (SELECT unnest(range(len(embedding))) d, unnest(embedding) x FROM embeddings) t GROUP BY d) w), 6) AS mean_variance FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) n FROM embeddings) q")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(vectors.embedding_statistics(table(spark, d, "embeddings"), "embedding"), "norm_mean", "norm_std", "mean_variance")


@query(UNIT + "SELECT vec_id, round(1 - list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * c[i])), 6) AS centre_distance FROM u JOIN ce ON u.label = ce.label")
def own_centre(spark: SparkSession, d: str) -> DataFrame:
    return r6(vectors.own_centre_distance(views.vectors(spark, d), _centres(spark, d), "vec_id", "label", "embedding"), "centre_distance")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x: x::DOUBLE + 0.05) AS b FROM embeddings), q AS (SELECT 1 - list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS d FROM p)
 SELECT count(*) AS rows, round(avg(d), 6) AS drift_mean, round(max(d), 6) AS drift_max, (SELECT avg(v) < 0.0001 FROM (SELECT var_pop(x) v FROM (SELECT unnest(range(len(b))) k, unnest(b) x FROM p) t GROUP BY k) u) AS collapsed FROM q""")
def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    v = views.vectors(spark, d)
    moved = v.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + 0.05))
    return r6(vectors.embedding_drift(v, moved, "vec_id", "embedding"), "drift_mean", "drift_max")


@query()
def kmeans_centers(spark: SparkSession, d: str) -> DataFrame:
    return vectors.kmeans_centres(views.vectors(spark, d), "label", "embedding", "vec_id")


# ---- mining and review ----

MINED = ctes("scores", "images", "queue")[:-1] + """, m AS (SELECT s.crop_id, s.risk_score, i.image_label, i.product_id, i.template_id, i.source_id, q.disagreement, q.style_id, q.crop_sha256, i.source_group_id FROM scores s JOIN images i ON s.image_id = i.image_id JOIN queue q ON s.crop_id = q.crop_id WHERE i.split_role IS DISTINCT FROM 'LOCKED_TEST'),
 g AS (SELECT *, coalesce(image_label = 'ABNORMAL' AND risk_score >= 0.7, false) r1, coalesce(style_id >= 'style-200', false) r2, coalesce(disagreement >= 0.3, false) r3, coalesce(risk_score >= 0.4 AND risk_score <= 0.6, false) r4, coalesce(image_label = 'NORMAL' AND risk_score >= 0.5, false) r5 FROM m),
 t AS (SELECT *, list_filter([CASE WHEN r1 THEN 'ABNORMAL_HIGH_ATTENTION' END, CASE WHEN r2 THEN 'NEW_STYLE_CLUSTER' END, CASE WHEN r3 THEN 'DISAGREEMENT' END, CASE WHEN r4 THEN 'THRESHOLD_BAND' END, CASE WHEN r5 THEN 'NORMAL_FALSE_POSITIVE' END], lambda x: x IS NOT NULL) AS reasons,
  greatest(CASE WHEN r1 THEN risk_score END, CASE WHEN r2 THEN 0.5 END, CASE WHEN r3 THEN disagreement END, CASE WHEN r4 THEN 1 - least(abs(risk_score - 0.5) / 0.1, 1) END, CASE WHEN r5 THEN risk_score END) AS priority FROM g) """


def _mined(spark: SparkSession, d: str) -> DataFrame:
    s = views.scores(spark, d).select("crop_id", "image_id", "risk_score")
    i = views.images(spark, d).where(~F.col("split_role").eqNullSafe("LOCKED_TEST")).select("image_id", "image_label", "product_id", "template_id", "source_id", "source_group_id")
    q = views.queue(spark, d).select("crop_id", "disagreement", "style_id", "crop_sha256")
    m = s.join(i, "image_id").join(q, "crop_id")
    c, no = F.col, F.lit(False)
    on = dict(
        zip(
            queues.REASONS,
            [
                F.coalesce((c("image_label") == "ABNORMAL") & (c("risk_score") >= 0.7), no),
                F.coalesce(c("style_id") >= "style-200", no),
                F.coalesce(c("disagreement") >= 0.3, no),
                F.coalesce((c("risk_score") >= 0.4) & (c("risk_score") <= 0.6), no),
                F.coalesce((c("image_label") == "NORMAL") & (c("risk_score") >= 0.5), no),
            ],
            strict=True,
        )
    )
    value = dict(zip(queues.REASONS, [c("risk_score"), F.lit(0.5), c("disagreement"), queues.band_signal(c("risk_score"), 0.4, 0.6), c("risk_score")], strict=True))
    return m.withColumns({"reasons": queues.reason_tags(on), "priority": queues.priority({n: (on[n], value[n]) for n in on})})


@query(MINED + "SELECT reason, count(*) AS n, round(avg(priority), 6) AS mean_priority FROM (SELECT unnest(reasons) AS reason, priority FROM t) x GROUP BY reason")
def mining_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d).select(F.explode("reasons").alias("reason"), "priority").groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("priority"), 6).alias("mean_priority"))


@query(MINED + "SELECT bucket, crop_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY priority DESC, sha256('7:' || crop_id), crop_id) rn FROM (SELECT unnest(reasons) AS bucket, crop_id, round(priority, 9) AS priority FROM t) x) y WHERE rn <= 20")
def bucket_rank(spark: SparkSession, d: str) -> DataFrame:
    e = _mined(spark, d).select(F.explode("reasons").alias("bucket"), "crop_id", F.round("priority", 9).alias("priority")).withColumn("tie", queues.tie_break(7, "crop_id"))
    ranked = vectors.top_per_class(e.withColumn("o", F.struct(-F.col("priority"), F.col("tie"))), "bucket", F.col("o"), "crop_id", 20)
    return ranked.select("bucket", "crop_id", F.col("rank").cast("int").alias("rank"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d).where(F.size("reasons") > 0).withColumn("rank", F.concat(F.format_string("%012.9f", 1 - F.col("priority")), queues.tie_break(7, "crop_id")))


@query()
def mining_dedup(spark: SparkSession, d: str) -> DataFrame:
    return queues.greedy_suppression(written(_ranked(spark, d), "mined"), "crop_id", "rank", ["crop_sha256", "source_group_id"]).select("crop_id", "rank")


@query()
def mining_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_ranked(spark, d), "mined")
    kept = queues.greedy_suppression(rows, "crop_id", "rank", ["crop_sha256", "source_group_id"])
    return queues.interleaved(kept, "crop_id", "rank", "reasons", {"product_id": 3, "template_id": 20, "source_id": 50}, 500)


@query(ctes("queue")[:-1] + """, s AS (SELECT *, count(*) OVER (PARTITION BY style_id) AS style_count FROM queue WHERE label IS NULL)
 SELECT crop_id, style_count, CAST(row_number() OVER (ORDER BY coalesce(disagreement, -1) DESC, abs(risk_score - 0.5), style_count, sha256('11:' || crop_id), crop_id) AS INTEGER) AS priority FROM s WHERE risk_score IS NOT NULL ORDER BY priority LIMIT 300""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d).where("label IS NULL").select("crop_id", "style_id", "disagreement", "risk_score")
    n = q.groupBy("style_id").agg(F.count("*").alias("style_count"))
    j = q.join(n, q["style_id"].eqNullSafe(n["style_id"])).drop("style_id").where("risk_score IS NOT NULL")
    order = [F.desc("d"), F.asc("gap"), F.asc("style_count"), F.asc("tie"), F.asc("crop_id")]
    top = j.withColumns({"d": F.coalesce("disagreement", F.lit(-1.0)), "gap": F.abs(F.col("risk_score") - 0.5), "tie": queues.tie_break(11, "crop_id")}).orderBy(*order).limit(300)
    return top.select("crop_id", "style_count", F.row_number().over(Window.orderBy(*order)).alias("priority"))  # 300 rows


@query("SELECT ocr_model_name, count(*) AS queued, count(*) FILTER (label IN ('PASS', 'BLOCK')) AS accepted, count(*) FILTER (label = 'BLOCK') AS blocked, round(count(*) FILTER (label = 'BLOCK') / nullif(count(*) FILTER (label IN ('PASS', 'BLOCK')), 0)::DOUBLE, 6) AS yield FROM review_candidates GROUP BY ocr_model_name")
def review_yield(spark: SparkSession, d: str) -> DataFrame:
    ok, hit = F.col("label").isin("PASS", "BLOCK"), F.col("label") == "BLOCK"
    g = table(spark, d, "review_candidates").groupBy("ocr_model_name").agg(F.count("*").alias("queued"), F.count_if(ok).alias("accepted"), F.count_if(hit).alias("blocked"))
    return g.withColumn("yield", F.round(F.try_divide(F.col("blocked"), F.col("accepted")), 6))


GOLD = """WITH l AS (SELECT crop_id, min(label) AS label, max(label) AS other, min(annotator_id) AS annotator_id, coalesce(batch_no, 0) <= 5 AS old FROM review_candidates WHERE label IS NOT NULL GROUP BY ALL), a AS (SELECT crop_id, label, annotator_id FROM l WHERE old AND label = other), b AS (SELECT * FROM l WHERE NOT old) """


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "review_candidates").where("label IS NOT NULL").select("crop_id", "label", "annotator_id", (F.coalesce("batch_no", F.lit(0)) <= 5).alias("old"))
    none = rows.drop("old").limit(0)
    accepted, _ = queues.merge_labels(none, rows.where("old").drop("old"), "crop_id", ["label"])
    return queues.merge_labels(accepted, rows.where("NOT old").drop("old"), "crop_id", ["label"])


@query(GOLD + "SELECT crop_id, label, annotator_id FROM a UNION ALL SELECT crop_id, label, annotator_id FROM b WHERE label = other AND crop_id NOT IN (SELECT crop_id FROM a)")
def gold_merge(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)[0]


@query(GOLD + "SELECT b.crop_id FROM b LEFT JOIN a ON a.crop_id = b.crop_id WHERE b.label <> b.other OR a.label <> b.label")
def gold_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)[1]


# ---- sampling, identifiers, text ----

CLASS = """CASE WHEN cp = 65533 THEN 'REPLACEMENT' WHEN cp BETWEEN 57344 AND 63743 OR cp BETWEEN 983040 AND 1048573 OR cp BETWEEN 1048576 AND 1114109 THEN 'PRIVATE_USE' WHEN cp BETWEEN 64976 AND 65007 OR cp & 65534 = 65534 THEN 'NONCHARACTER'
 WHEN cp BETWEEN 13312 AND 19903 OR cp BETWEEN 19968 AND 40959 OR cp BETWEEN 63744 AND 64255 OR cp BETWEEN 131072 AND 173791 OR cp BETWEEN 173824 AND 191471 OR cp BETWEEN 194560 AND 195103 OR cp BETWEEN 196608 AND 205743 THEN 'CJK' ELSE 'OTHER' END"""


@query(ctes("images")[:-1] + """, h AS (SELECT image_id, split_role, row_number() OVER (PARTITION BY split_role ORDER BY sha256('5:' || image_id), image_id) rn, count(*) OVER (PARTITION BY split_role) n FROM images WHERE split_role IS NOT NULL)
 SELECT image_id, split_role, rn <= least(n - 1, greatest(1, round_even(n * 0.1, 0))) AS chosen FROM h""")
def hash_holdout(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_holdout(views.images(spark, d).where("split_role IS NOT NULL"), "image_id", "split_role", 0.1, 5)


@query(f"SELECT sample_id, CASE WHEN CAST('0x' || substr(sha256(c || chr(0) || source_group_id), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0 < 0.8 THEN 'train' ELSE 'validation' END AS split FROM (SELECT sample_id, {canon_sql('base_char')} AS c, source_group_id FROM glyph_items) t WHERE c IS NOT NULL AND source_group_id IS NOT NULL")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "glyph_items").select("sample_id", text.canon_col("base_char").alias("c"), "source_group_id").where("c IS NOT NULL AND source_group_id IS NOT NULL")
    return sampling.hash_split(rows, "sample_id", ["c", "source_group_id"], 0.8)


PAIRS = """WITH k AS (SELECT DISTINCT sample_id, source_group_id FROM glyph_items WHERE source_group_id IS NOT NULL AND split_role = 'train'), r AS (SELECT sample_id, source_group_id, row_number() OVER w rn, lead(sample_id) OVER w nxt, first_value(sample_id) OVER w fst FROM k WINDOW w AS (PARTITION BY source_group_id ORDER BY sha256('3:' || sample_id), sample_id)),
 pb AS (SELECT source_group_id, CAST((rn + 1) / 2 AS BIGINT) AS pair, sample_id AS a, coalesce(nxt, fst) AS b FROM r WHERE rn % 2 = 1 AND (nxt IS NOT NULL OR rn > 1)) """


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "glyph_items").where("source_group_id IS NOT NULL AND split_role = 'train'").select("sample_id", "source_group_id").distinct()
    return sampling.paired_batches(k, "sample_id", "source_group_id", 3)


@query(PAIRS + "SELECT * FROM pb")
def pair_batches(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(f"""WITH b AS (SELECT CAST('0x' || substr(sha256('9:' || sample_id), 1, 2) AS INTEGER) % 4 AS epoch, CAST('0x' || substr(sha256('9:' || sample_id), 3, 3) AS INTEGER) AS batch, {canon_sql('base_char')} AS base_char FROM glyph_items WHERE {canon_sql('base_char')} IS NOT NULL),
 n AS (SELECT epoch, batch, base_char, count(*) n FROM b GROUP BY ALL), p AS (SELECT epoch, batch, sum(n) AS "rows", sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS eligible, sum(n * (n - 1) // 2) AS pairs FROM n GROUP BY epoch, batch)
 SELECT epoch, CAST(sum("rows") AS BIGINT) AS "rows", CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) FILTER (pairs = 0) AS empty_batches FROM p GROUP BY epoch""")
def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    h = sampling.seeded(9, F.col("sample_id"))
    b = table(spark, d, "glyph_items").withColumn("base_char", text.canon_col("base_char")).where("base_char IS NOT NULL").select((F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % 4).alias("epoch"), F.conv(F.substring(h, 3, 3), 16, 10).cast("int").alias("batch"), "base_char")
    return sampling.pair_exposure(b, "epoch", "batch", "base_char")


SLOTS = """WITH s AS (SELECT n.c AS character, r.r AS role, o.o AS operator, CAST(p.p AS INTEGER) AS replica FROM (SELECT DISTINCT {CANON} AS c FROM glyph_items WHERE {CANON} IS NOT NULL) n, (VALUES ('train'), ('calibration'), ('test')) r(r), (VALUES ('identity'), ('erase'), ('add'), ('break'), ('bridge'), ('shift')) o(o), (SELECT unnest(range(4)) p) p),
 x AS (SELECT *, sha256('17:' || character || ':' || role || ':' || operator || ':' || replica) h FROM s), z AS (SELECT character, role, operator, replica, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) & 9223372036854775807::UBIGINT AS BIGINT) AS seed FROM x) """.replace("{CANON}", canon_sql("base_char"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return sampling.slot_plan(table(spark, d, "glyph_items").select(text.canon_col("base_char").alias("c")).where("c IS NOT NULL"), "c", ["train", "calibration", "test"], ["identity", "erase", "add", "break", "bridge", "shift"], 4, 17)


@query(SLOTS + "SELECT * FROM z")
def slot_plan(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d)


@query(SLOTS[:-1] + """, t AS (SELECT z.*, a.a AS attempt, CAST('0x' || substr(sha256(seed || ':' || a.a), 1, 2) AS INTEGER) < 77 AS ok FROM z, (SELECT unnest(range(8)) a) a), b AS (SELECT role, operator, character, replica, min(attempt) FILTER (ok) AS accepted FROM t GROUP BY ALL)
 SELECT role, operator, count(*) AS expected, count(accepted) AS actual, CAST(sum(coalesce(accepted + 1, 8)) AS BIGINT) AS attempts, count(*) - count(accepted) AS skipped, count(*) = count(accepted) AS complete FROM b GROUP BY role, operator""")
def quota_accounting(spark: SparkSession, d: str) -> DataFrame:
    ok = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("seed").cast("string"), F.col("attempt").cast("string")), 256), 1, 2), 16, 10).cast("int") < 77
    return sampling.quota_accounting(sampling.bounded_retry(_slots(spark, d), 8, ok), ["role", "operator"])


@query("SELECT sample_id, 'g-' || sha256(coalesce(base_char, '') || chr(0) || coalesce(operator, '') || chr(0) || coalesce(CAST(seed AS VARCHAR), '')) AS stable_id FROM glyph_items")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glyph_items").select("sample_id", text.stable_id("g-", F.col("base_char"), F.col("operator"), F.col("seed")).alias("stable_id"))


@query("WITH r AS (SELECT DISTINCT split_role AS g, sample_id AS k, sample_id AS v FROM glyph_items WHERE split_role IS NOT NULL AND sample_id IS NOT NULL) SELECT g AS split_role, n, digest FROM (" + _BLOCKS + ") z")
def digest(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "glyph_items").where("split_role IS NOT NULL AND sample_id IS NOT NULL").select("split_role", "sample_id").distinct()
    return constraints.block_digest(k, "split_role", "sample_id", "sample_id")


POSITIONS = "row_number() OVER (ORDER BY sha256('{0}:' || {1}), {1}) - 1"


@query("WITH k AS (SELECT DISTINCT image_id FROM real_manifest WHERE image_id IS NOT NULL), n AS (SELECT image_id, " + POSITIONS.format(21, "image_id") + " AS pos FROM k) SELECT image_id, pos // 32 AS batch, CAST(pos % 32 AS INTEGER) AS place FROM n")
def random_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_batches(table(spark, d, "real_manifest").where("image_id IS NOT NULL").select("image_id").distinct(), "image_id", 32, 21)


@query(PAIRS[:-1] + ", pn AS (SELECT a, b, " + POSITIONS.format(4, "(a || '|' || b)") + " AS at FROM pb), ok AS (SELECT DISTINCT sample_id FROM glyph_items WHERE decision = 'BLOCK' AND sample_id IS NOT NULL), bn AS (SELECT sample_id, " + POSITIONS.format(5, "sample_id") + """ AS at FROM ok),
 z AS (SELECT (SELECT count(*) FROM pn) AS p, (SELECT count(*) FROM bn) AS o), m AS (SELECT greatest(ceil(p / 8.0), ceil(o / 16.0))::BIGINT AS batches, p, o FROM z)
 SELECT s // 8 AS batch, CAST(s % 8 AS INTEGER) AS slot, 'pair' AS kind, a, b FROM m, (SELECT unnest(range((SELECT batches * 8 FROM m))) AS s) t JOIN pn ON pn.at = s % (SELECT p FROM z)
 UNION ALL SELECT s // 16, CAST(s % 16 AS INTEGER), 'other', sample_id, NULL FROM m, (SELECT unnest(range((SELECT batches * 16 FROM m))) AS s) t JOIN bn ON bn.at = s % (SELECT o FROM z)""")
def composed_batches(spark: SparkSession, d: str) -> DataFrame:
    others = table(spark, d, "glyph_items").where("decision = 'BLOCK' AND sample_id IS NOT NULL").select("sample_id").distinct()
    return sampling.composed_batches(_pairs(spark, d), others, "sample_id", 32, 3)


@query("SELECT DISTINCT image_path, regexp_extract(image_path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, regexp_extract(image_path, '([^/\\\\]*)$', 1) AS name, lower(regexp_extract(image_path, '.(\\.[^./\\\\]*)$', 1)) AS suffix FROM real_manifest WHERE image_path IS NOT NULL")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "real_manifest").where("image_path IS NOT NULL").select("image_path").distinct()
    return p.withColumn("x", text.path_parts(F.col("image_path"))).select("image_path", "x.folder", "x.name", "x.suffix")


@query("SELECT decision, coalesce(nullif(trim(anomaly_kind), ''), CASE WHEN decision = 'PASS' THEN 'NONE' ELSE 'unknown' END) AS kind, count(*) AS n FROM crop_scores GROUP BY 1, 2")
def kind_defaults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crop_scores").groupBy("decision", text.default_kind(F.col("anomaly_kind"), F.col("decision")).alias("kind")).agg(F.count("*").alias("n"))


@query(ctes("scores", "queue") + f""", cat AS (SELECT DISTINCT {canon_sql('base_char')} AS base_char FROM glyph_items), e AS (SELECT image_id, c.annotation_id AS annotation_id, c.text AS ch FROM (SELECT image_id, unnest(characters) AS c FROM real_manifest) t WHERE length(c.text) = 1),
 s AS (SELECT image_id, max(risk_score) AS visual FROM scores GROUP BY image_id), q AS (SELECT image_id, 1 - max(disagreement) AS confidence FROM queue WHERE disagreement BETWEEN 0 AND 1 GROUP BY image_id),
 k AS (SELECT e.image_id, annotation_id, unicode(ch) AS cp, coalesce({canon_sql('ch')} IN (SELECT base_char FROM cat WHERE base_char IS NOT NULL), false) AS known, visual, coalesce(confidence, 0.9) AS confidence FROM e LEFT JOIN s ON e.image_id = s.image_id LEFT JOIN q ON e.image_id = q.image_id),
 m AS (SELECT *, {{CLASS}} AS class FROM k), r AS (SELECT *, class IN ('REPLACEMENT', 'PRIVATE_USE', 'NONCHARACTER') AS unsafe, CASE WHEN class IN ('REPLACEMENT', 'PRIVATE_USE', 'NONCHARACTER') THEN 1.0::DOUBLE WHEN class = 'OTHER' OR NOT known THEN 0.49 ELSE 0 END AS membership_risk FROM m)
 SELECT image_id, annotation_id, class AS unicode_class, round(greatest(1 - confidence, membership_risk, coalesce(visual, 0)), 6) AS combined_risk, unsafe OR coalesce(visual >= 0.5, false) AS auto_block, NOT known OR unsafe OR class = 'OTHER' OR confidence < 0.5 OR visual IS NOT NULL AS needs_review FROM r""".replace("{CLASS}", CLASS).replace(" , cat", ", cat"))
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    cat = table(spark, d, "glyph_items").select(text.canon_col("base_char").alias("key")).where("key IS NOT NULL").distinct().withColumn("known", F.lit(True))
    e = table(spark, d, "real_manifest").select("image_id", F.explode("characters").alias("c")).select("image_id", "c.annotation_id", F.col("c.text").alias("ch")).where("length(ch) = 1").withColumn("key", text.canon_col("ch"))
    s = views.scores(spark, d).groupBy("image_id").agg(F.max("risk_score").alias("visual"))
    q = views.queue(spark, d).where("disagreement BETWEEN 0 AND 1").groupBy("image_id").agg((1 - F.max("disagreement")).alias("confidence"))
    j = e.join(cat, "key", "left").join(s, "image_id", "left").join(q, "image_id", "left").fillna(0.9, ["confidence"])
    out = text.policy_scores(j, "ch", "confidence", "visual", "known")
    return out.select("image_id", "annotation_id", "unicode_class", F.round("combined_risk", 6).alias("combined_risk"), "auto_block", "needs_review")


CHARS = "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), k AS (SELECT doc_id, ch, unicode(ch) AS cp FROM c WHERE ch <> '') "


@query(CHARS + f"SELECT {CLASS} AS class, count(*) AS n, count(DISTINCT ch) AS characters FROM k GROUP BY 1")
def unicode_class(spark: SparkSession, d: str) -> DataFrame:
    n = text.characters(table(spark, d, "documents"), "doc_id", "text").groupBy("char").agg(F.count("*").alias("n"))
    return n.withColumn("class", text.unicode_class(F.col("char"))).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("characters"))


@query(CHARS[:-1] + f""", cat AS (SELECT DISTINCT {canon_sql('base_char')} AS base_char FROM glyph_items WHERE {canon_sql('base_char')} IS NOT NULL), z AS (SELECT doc_id, {CLASS} AS class, ch IN (SELECT base_char FROM cat) AS known FROM k)
 SELECT doc_id, max(CASE WHEN class IN ('REPLACEMENT', 'PRIVATE_USE', 'NONCHARACTER') THEN 1.0::DOUBLE WHEN class = 'CJK' AND NOT known THEN 0.49 WHEN class = 'OTHER' THEN 0.49 ELSE 0 END) AS risk, count(*) FILTER (class = 'CJK' AND NOT known) AS rare, count(*) AS characters FROM z GROUP BY doc_id""")
def baseline_policy(spark: SparkSession, d: str) -> DataFrame:
    cat = table(spark, d, "glyph_items").select(text.canon_col("base_char").alias("char")).where("char IS NOT NULL").distinct().withColumn("known", F.lit(True))
    chars = text.characters(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id", "char").agg(F.count("*").alias("k"))
    j = chars.join(cat, "char", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "class": text.unicode_class(F.col("char"))})
    risk = text.policy_risk(F.col("class"), F.col("known"), 0.5)
    return j.groupBy("doc_id").agg(F.max(risk).alias("risk"), F.sum(F.when((F.col("class") == "CJK") & ~F.col("known"), F.col("k")).otherwise(0)).alias("rare"), F.sum("k").alias("characters"))


# ---- reports, images, streams ----


@query(ctes("scores", "labelled")[:-1] + """, x AS (SELECT *, CASE WHEN label AND score < 0.5 THEN 'FN' WHEN NOT label AND score >= 0.5 THEN 'FP' END AS kind FROM labelled), y AS (SELECT kind, CASE WHEN kind = 'FN' THEN anomaly_kind ELSE '' END AS grp, crop_id, score FROM x WHERE kind IS NOT NULL),
 z AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY CASE WHEN kind = 'FN' THEN 0 ELSE -score END, sha256('13:' || crop_id), crop_id) rn FROM y) SELECT kind, grp, crop_id FROM z WHERE rn <= CASE WHEN kind = 'FN' THEN 10 ELSE 50 END""")
def error_examples(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") & (F.col("score") < 0.5), "FN").when(~F.col("label") & (F.col("score") >= 0.5), "FP")
    e = views.labelled(spark, d).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("grp", F.when(F.col("kind") == "FN", F.col("anomaly_kind")).otherwise(""))
    e = e.withColumns({"cell": F.concat_ws("|", "kind", "grp"), "o": F.struct(F.when(F.col("kind") == "FN", 0.0).otherwise(-F.col("score")), queues.tie_break(13, "crop_id"))})
    top = vectors.top_per_class(e, "cell", F.col("o"), "crop_id", 50)
    return top.where((F.col("kind") == "FP") | (F.col("rank") <= 10)).select("kind", "grp", "crop_id")


@query(ctes("scores", "labelled")[:-1] + """, g AS (SELECT fold, count(*) FILTER (label) p, count(*) FILTER (NOT label) n FROM labelled GROUP BY fold), f AS (SELECT fold, list_filter([CASE WHEN p < 30 THEN 'positives' END, CASE WHEN n < 1000 THEN 'negatives' END], lambda x: x IS NOT NULL) AS reasons FROM g) SELECT fold, reasons, CASE WHEN len(reasons) > 0 THEN 'inconclusive' ELSE 'development_gate_only' END AS status FROM f""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = views.labelled(spark, d).groupBy("fold").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    r = g.withColumn("reasons", queues.reason_tags({"positives": F.col("p") < 30, "negatives": F.col("n") < 1000}))
    return r.select("fold", "reasons", F.when(F.size("reasons") > 0, "inconclusive").otherwise("development_gate_only").alias("status"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = views.labelled(spark, d).withColumnRenamed("crop_id", "key")
    return r6(metrics.bootstrap_ap(rows, "fold"), "low", "high")


@query()
def corrupt_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "glyph_items").select("sample_id", F.slice("views", 1, 100).alias("views"))
    return images.corrupted(rows, "sample_id", "views", 10)


def _grays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glyph_items").select("sample_id", F.slice("views", 1, 100).alias("views"))


def _moved(image, seed: int) -> dict:
    out, tries, outcome = arrays.augmented(image, seed)
    return {"tries": tries, "outcome": outcome, **arrays.visibility(image, out)}


@query()
def augmented_views(spark: SparkSession, d: str) -> DataFrame:
    return arrays.mapped(_grays(spark, d), "sample_id", "views", 10, _moved, "tries int, outcome string, changed double, ink_changed double, edge_changed double, largest_body double")


@query()
def rendered_views(spark: SparkSession, d: str) -> DataFrame:
    """Appearance, then photometry, then the three views at twice the size: their means and the image's topology."""

    def work(image, seed: int) -> dict:
        gray, mask, line = arrays.three_views(arrays.photometric(arrays.appearance(image, seed), seed), 20)
        return {"gray": round(float(gray.mean()), 6), "ink": round(float(mask.mean()), 6), "edge": round(float(line.mean()), 6), "euler": arrays.euler_number(image < 0.5)}

    return arrays.mapped(_grays(spark, d), "sample_id", "views", 10, work, "gray double, ink double, edge double, euler int")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def progress_windows(spark: SparkSession, d: str) -> DataFrame:
    return progress.windows(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))
