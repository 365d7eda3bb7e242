"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import capping, clusters, ledger, mixing, overlaps, packing, splits, toxicity
from plumbago.llm.keys import canon_col, trimmed
from plumbago.llm.tokens import with_tokens
from plumbago.plans.views import canon_sql
from plumbago.session import table, written

SAMPLE_RATE = 0.1


def _sample(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(key, "batch_no")
    newest = F.col("batch_no") >= 10
    before = written(ledger.advance(None, rows.where(~newest), key, "batch_no", SAMPLE_RATE), "ledger")
    after = written(ledger.advance(before, rows.where(newest | F.col("batch_no").isNull()), key, "batch_no", SAMPLE_RATE), "ledger")
    return after.where("chosen").select(F.lit(name).alias("record_table"), F.col("key").alias("record_id"), F.col("delivery").alias("since_batch"))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, "glyph_items", "sample_id").unionByName(_sample(spark, sf_dir, "review_candidates", "crop_id"))


def _split_rows(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    images = table(spark, sf_dir, "real_manifest").select(trimmed("image_id").alias("record"), canon_col("source_id").alias("grp"), canon_col("split_role").alias("role"))
    glyphs = table(spark, sf_dir, "glyph_items").select(canon_col("sample_id").alias("record"), canon_col("base_char").alias("grp"), canon_col("split_role").alias("role"))
    return {"real_manifest": (written(images.distinct(), "split-rows"), "lockedtest"), "glyph_items": (written(glyphs.distinct(), "split-rows"), "train")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (rows, held) in _split_rows(spark, sf_dir).items():
        assigned = written(splits.assign_splits(rows.select("record", "grp")), "split-assigned")
        one = splits.role_conflicts(rows, assigned, held).select(F.lit(name).alias("record_table"), F.col("record").alias("record_id"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (rows, _) in _split_rows(spark, sf_dir).items():
        one = splits.assign_splits(rows.select("record", "grp")).select("record", "component", "split").distinct().select(F.lit(name).alias("record_table"), F.col("record").alias("record_id"), "component", "split")
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "real_manifest").select(trimmed("image_id").alias("record"), canon_col("source_id").alias("contributor"))
    scores = table(spark, sf_dir, "crop_scores").select(trimmed("image_id").alias("record"), F.col("risk_score").alias("score"))
    return capping.over_cap(written(pairs, "cap-pairs"), scores, share=0.02).select(F.col("record").alias("image_id")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps.cross_split_pairs(table(spark, sf_dir, "glyph_items"))
    return pairs.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, sf_dir, "glyph_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.glyph_clusters(table(spark, sf_dir, "glyph_items"))


def p5_glyph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.glyph_groups(table(spark, sf_dir, "glyph_items"))


def p5_crop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.crop_groups(table(spark, sf_dir, "review_candidates"), whole=True)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return packing.packed(written(sizes, "pack-sizes"), table(spark, sf_dir, "container_sizes"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(_placed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = mixing.mix_input(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), with_tokens)
    return mixing.mixed(written(docs, "mix-docs"), targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), ["doc_id", "source"])
    by = scored.groupBy(canon_col("source").alias("source"))
    return by.agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_sample, p2_found, p2_splits, p3_found, p4_found, p4_report, p5_found, p5_glyph_groups, p5_crop_groups, p6_containers, p6_usage, p7_mix, p7_shares, p8_found, p8_scores, p8_rates]
    return {f.__name__: f for f in own}


def _trim(column: str) -> str:
    return rf"nullif(lower(regexp_replace({column}, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g')), '')"


def _sample_sql(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS record_table, key AS record_id, CAST(delivery AS INTEGER) AS since_batch FROM (
  SELECT k.*, q.quota, row_number() OVER (PARTITION BY k.delivery ORDER BY md5('sample:' || key), key) AS rn FROM (
    SELECT {canon_sql(key)} AS key, min(coalesce(batch_no, 10)) AS delivery FROM {name} WHERE {canon_sql(key)} IS NOT NULL GROUP BY 1) k
  JOIN (SELECT delivery, round(upto * 0.1) - round((upto - n) * 0.1) AS quota FROM (SELECT delivery, n, sum(n) OVER (ORDER BY delivery) AS upto FROM (
    SELECT delivery, count(*) AS n FROM (SELECT min(coalesce(batch_no, 10)) AS delivery FROM {name} WHERE {canon_sql(key)} IS NOT NULL GROUP BY {canon_sql(key)}) a GROUP BY delivery) b) c) q ON k.delivery = q.delivery) t WHERE rn <= quota"""


def _conflict_sql(name: str, record: str, grp: str, held: str) -> str:
    return f"""SELECT DISTINCT '{name}' AS record_table, {record} AS record_id FROM {name} WHERE {record} IS NOT NULL AND {grp} IN (
  SELECT g FROM (SELECT {grp} AS g, {canon_sql("split_role")} AS r FROM {name}) t WHERE g IS NOT NULL AND r IS NOT NULL GROUP BY g HAVING bool_or(r = '{held}') AND bool_or(r <> '{held}'))"""


def _splits_sql(name: str, record: str, grp: str) -> str:
    """Components of groups that share a record, then the best of the weighted scores of the splits."""
    score = lambda split, w: f"{{'s': -{w}::DOUBLE / ln((CAST('0x' || substr(md5('split:{split}:' || component), 1, 13) AS UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0), 'n': '{split}'}}"
    best = ", ".join(score(s, w) for s, w in sorted(splits.DEFAULT.items()))
    return f"""SELECT * FROM (WITH RECURSIVE p AS (SELECT DISTINCT {record} AS rec, {grp} AS grp FROM {name} WHERE {record} IS NOT NULL), lo AS (SELECT rec, min(grp) AS low, max(grp) AS high FROM p GROUP BY rec),
  e AS (SELECT DISTINCT lo.low AS a, p.grp AS b FROM p JOIN lo USING (rec) WHERE lo.low < lo.high AND p.grp <> lo.low), ee AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM ee UNION (SELECT u.id, min(v.comp) FROM recurring.cc AS u JOIN ee ON ee.b = u.id JOIN cc AS v ON v.id = ee.a WHERE v.comp < u.comp GROUP BY u.id)),
  c AS (SELECT rec, coalesce('g:' || coalesce(cc.comp, low), 'r:' || rec) AS component FROM lo LEFT JOIN cc ON cc.id = lo.low)
  SELECT '{name}' AS record_table, rec AS record_id, component, list_sort([{best}])[-1].n AS split FROM c)"""


_GLYPHS = f"""WITH RECURSIVE g AS (SELECT DISTINCT {canon_sql("sample_id")} AS id, {canon_sql("split_role")} AS role, nullif(regexp_replace({canon_sql("pixel_sha256")}, '^sha256[:=]?', ''), '') AS hash, views[1:100] AS v FROM glyph_items) """


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the pairs and clusters by brute force over all pairs."""
    near = "list_sum(list_transform(range(1, 101), lambda i: abs(a.v[i]::DOUBLE - b.v[i]::DOUBLE))) / 100"
    return {
        "p1_sample": _sample_sql("glyph_items", "sample_id") + " UNION ALL " + _sample_sql("review_candidates", "crop_id"),
        "p2_found": _conflict_sql("real_manifest", _trim("image_id"), canon_sql("source_id"), "lockedtest") + " UNION ALL " + _conflict_sql("glyph_items", canon_sql("sample_id"), canon_sql("base_char"), "train"),
        "p3_found": f"""WITH p AS (SELECT DISTINCT {_trim("image_id")} AS i, {canon_sql("source_id")} AS s FROM real_manifest WHERE {_trim("image_id")} IS NOT NULL),
  cap AS (SELECT greatest(1, floor(count(DISTINCT i) * 0.02 + 1e-9)) AS c FROM p), k AS (SELECT {_trim("image_id")} AS i, max(risk_score) AS r FROM crop_scores WHERE risk_score >= 0 AND risk_score <= 1 AND NOT isnan(risk_score) GROUP BY 1),
  o AS (SELECT p.i, row_number() OVER (PARTITION BY s ORDER BY (r IS NULL)::INTEGER, r, p.i) AS rn FROM p LEFT JOIN k ON p.i = k.i WHERE s IS NOT NULL) SELECT DISTINCT i AS image_id FROM o, cap WHERE rn > c""",
        "p4_found": _GLYPHS + f"""SELECT DISTINCT least(a.id, b.id) AS sample_id_a, greatest(a.id, b.id) AS sample_id_b FROM g a JOIN g b ON a.role = 'train' AND b.role IN ('calibration', 'test') AND (a.hash = b.hash OR {near} <= 0.020001)""",
        "p2_splits": _splits_sql("real_manifest", _trim("image_id"), canon_sql("source_id")) + " UNION ALL " + _splits_sql("glyph_items", canon_sql("sample_id"), canon_sql("base_char")),
        "p4_report": _GLYPHS[:-1] + f""", pr AS (SELECT DISTINCT a.id AS t, b.id AS e FROM g a JOIN g b ON a.role = 'train' AND b.role IN ('calibration', 'test') AND (a.hash = b.hash OR {near} <= 0.020001)), n AS (SELECT e, count(*) AS pairs FROM pr GROUP BY e),
  s AS (SELECT DISTINCT {canon_sql("sample_id")} AS id, {canon_sql("split_role")} AS role, source_group_id, unnest(CASE WHEN coalesce(len(source_asset_ids), 0) = 0 THEN [NULL] ELSE source_asset_ids END) AS asset FROM glyph_items)
  SELECT role, source_group_id, asset, CAST(sum(pairs) AS BIGINT) AS n_pairs, count(DISTINCT id) AS n_records FROM n JOIN s ON s.id = n.e WHERE role IN ('calibration', 'test') GROUP BY ALL""",
        "p5_found": _GLYPHS[:-1] + f""", n AS (SELECT v, min(id) AS low FROM g WHERE v IS NOT NULL AND len(v) = 100 GROUP BY v), k AS (SELECT v, row_number() OVER (ORDER BY low, v) AS id FROM n),
  e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.id < b.id AND {near} <= 0.080001), ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  full_reach(a, b) AS (SELECT id, id FROM k UNION SELECT r.a, ee.b FROM full_reach r JOIN ee ON r.b = ee.a), c AS (SELECT a AS id, min(b) AS comp FROM full_reach GROUP BY a),
  m AS (SELECT DISTINCT c.comp, g.id FROM g JOIN k ON g.v = k.v JOIN c ON c.id = k.id), z AS (SELECT comp, min(id) AS cluster_id FROM m GROUP BY comp HAVING count(DISTINCT id) > 1)
  SELECT z.cluster_id, m.id AS sample_id FROM m JOIN z ON m.comp = z.comp""",
    }
