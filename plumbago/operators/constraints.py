"""Integrity checks. Each returns a violations frame (constraint, key, detail); an empty one means clean."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = r"^[0-9a-f]{64}$"


class ConstraintError(ValueError):
    """A violations frame was not empty."""


def _rows(df: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("constraint"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def assert_clean(violations: DataFrame, shown: int = 5) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise ConstraintError("; ".join(f"{r[0]}: {r[1]} ({r[2]})" for r in found))


def unique_key(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    dup = df.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1")
    return _rows(dup, "unique_key", F.concat_ws("|", *key), F.col("__n"))


def conditions(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per row and rule that isn't true; a rule that gives null is violated. One scan for all rules."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("constraint"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child values that the parent lacks; nulls are no references."""
    refs = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("__n"))
    return _rows(refs.join(parent.select(F.col(key).alias("__k")).distinct(), "__k", "left_anti"), "foreign_key", F.col("__k"), F.col("__n"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    x, y = (df.select(F.col(key).alias("__k")).distinct().withColumn(n, F.lit(True)) for df, n in ((a, "__a"), (b, "__b")))
    j = x.join(y, "__k", "full_outer")
    return _rows(j.where("__a IS NULL OR __b IS NULL"), "same_keys", F.col("__k"), F.when(F.col("__a").isNull(), "missing left").otherwise("missing right"))


def disjoint(df: DataFrame, value: str, side: str) -> DataFrame:
    """Values that occur on several sides (a split role, say)."""
    s = df.where(F.col(value).isNotNull() & F.col(side).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(side)).alias("__s"))
    return _rows(s.where(F.size("__s") > 1), "disjoint", F.col(value), F.array_join("__s", ","))


def determines(df: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """Functional dependency lhs -> rhs: left values with several right values."""
    g = df.groupBy(lhs).agg(F.count_distinct(rhs).alias("__n")).where("__n > 1")
    return _rows(g, "determines", F.col(lhs), F.col("__n"))


def fields_match(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that differ (null-safe) between rows of one key."""
    j = a.select(key, *[F.col(f).alias(f"__a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"__b_{f}") for f in fields]), key)
    off = F.filter(F.array(*[F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return j.select(F.lit("fields_match").alias("constraint"), F.col(key).cast("string").alias("key"), F.explode(off).alias("detail"))


def contained_path(column: Column) -> Column:
    """A relative path that stays under its root."""
    return column.isNotNull() & ~column.rlike(r"^[/\\]") & ~column.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (F.length(column) > 0)


def contiguous_folds(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Folds of 0..k-1 that are missing and other non-negative folds that occur."""
    have = df.where(F.col(fold) >= 0).select(F.col(fold).cast("long").alias("__f")).distinct()
    want = df.sparkSession.range(k).select(F.col("id").alias("__f"))
    j = want.withColumn("__w", F.lit(True)).join(have.withColumn("__h", F.lit(True)), "__f", "full_outer").where("__w IS NULL OR __h IS NULL")
    return _rows(j, "contiguous_folds", F.col("__f"), F.when(F.col("__w").isNull(), "unexpected").otherwise("missing"))


def fold_isolation(scores: DataFrame, key: str, fold: str, excluded: str) -> DataFrame:
    """Scores of a fold by a model that wasn't kept from that fold."""
    return _rows(scores.where(~F.coalesce(F.array_contains(excluded, F.col(fold)), F.lit(False))), "fold_isolation", F.col(key), F.col(fold))


def content_hashes(files: DataFrame, manifest: DataFrame, path: str, digest: str, root: str) -> DataFrame:
    """Rows whose file (binaryFile: path, content) under ``root`` is missing or hashes to something else."""
    base = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    relative = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base), "")
    own = files.select(relative(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("__path"), F.sha2("content", 256).alias("__sha"))
    j = manifest.withColumn("__path", F.regexp_replace(path, r"^(\./)+", "")).join(own, "__path", "left")
    return _rows(j.where(~F.col("__sha").eqNullSafe(F.lower(F.col(digest)))), "content_hashes", F.col(path), F.coalesce("__sha", F.lit("missing")))


def finite_range(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """Rows whose number is null, NaN, infinite or outside low..high, with the reason."""
    c = F.col(column).cast("double")
    why = F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(F.abs(c) == F.lit(float("inf")), "infinite").when((c < low) | (c > high), "outside")
    return _rows(df.withColumn("__why", why).where("__why IS NOT NULL"), "finite_range", F.col(key), F.col("__why"))


def column_types(df: DataFrame, **wanted: str) -> list[str]:
    """Columns that are missing or of another type (a boolean is no number), from the schema alone."""
    have = dict(df.dtypes)
    return [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in wanted.items() if have.get(n) != t]


def counts_match(actual: DataFrame, expected: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Groups whose row count differs from the expected one; a group on one side only counts 0 on the other."""
    j = actual.select(*by, F.col(n).alias("__a")).join(expected.select(*by, F.col(n).alias("__e")), list(by), "full_outer").fillna(0, ["__a", "__e"])
    return _rows(j.where("__a <> __e"), "counts_match", F.concat_ws("|", *by), F.concat_ws(" of ", F.col("__a").cast("string"), F.col("__e").cast("string")))


def unapproved(df: DataFrame, source: str, allowed: str, opt_in: Sequence[str] = ()) -> DataFrame:
    """Sources with rows that production may not use (null is no permission), but for those opted in."""
    bad = df.where(~F.coalesce(F.col(allowed), F.lit(False)) & ~F.coalesce(F.col(source).isin(*opt_in), F.lit(False))).groupBy(source).agg(F.count("*").alias("__n"))
    return _rows(bad, "unapproved", F.col(source), F.col("__n"))


def rank_sequence(df: DataFrame, version: str, rank: str) -> DataFrame:
    """Queue versions whose ranks are not exactly 1..n, told by counts alone."""
    g = df.groupBy(version).agg(F.count("*").alias("n"), F.count_distinct(rank).alias("d"), F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    return _rows(g.where("NOT coalesce(n = d AND lo = 1 AND hi = n, false)"), "rank_sequence", F.col(version), F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "d", "lo", "hi")]))


def self_hash(df: DataFrame, version: str, key: str, columns: Sequence[str], stored: Mapping[str, str]) -> DataFrame:
    """Versions whose digest over their rows is not the stored one (two levels: buckets of keys, then their digests)."""
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    got = block_digest(df.select(F.col(version).alias("__v"), F.col(key).cast("string").alias("__k"), row.alias("__h")), "__v", "__k", "__h")
    want = df.sparkSession.createDataFrame(sorted(stored.items()), "__v string, want string")
    j = got.join(want, "__v", "full_outer").where("NOT digest <=> want")
    return _rows(j, "self_hash", F.col("__v"), F.coalesce("digest", F.lit("missing")))


def block_digest(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, n, digest): SHA-256 over the digests of blocks of rows, a block by the first two hex digits of the key's
    SHA-256, rows of a block in the order of their key, blocks in order; lines joined by a line feed.

    Independent of order and partitioning; a task holds one block of a group, 1/256 of it.
    """
    rows = df.select(group, F.col(key).alias("__key"), F.col(value).alias("__value"), F.substring(F.sha2(F.col(key), 256), 1, 2).alias("__b"))
    blocks = rows.groupBy(group, "__b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__key", "__value"))), lambda e: e["__value"]), "\n"), 256).alias("h"))
    return blocks.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "h"))), lambda e: e["h"]), "\n"), 256).alias("digest"))


def merged_maps(parts: Sequence[DataFrame], key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): one value a key over all parts; keys with several values (null is one) are conflicts instead."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(key, value) for p in parts])
    g = rows.groupBy(key).agg(F.min(F.struct(F.col(value).alias("v"))).alias("lo"), F.max(F.struct(F.col(value).alias("v"))).alias("hi"))
    return g.where("lo <=> hi").select(key, F.col("lo.v").alias(value)), _rows(g.where("NOT lo <=> hi"), "merged_maps", F.col(key), F.concat_ws("|", F.coalesce(F.col("lo.v").cast("string"), F.lit("null")), F.col("hi.v").cast("string")))


def independent_models(df: DataFrame, key: str, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Rows whose two models share an id or a checkpoint."""
    same = reduce(lambda x, y: x | y, [F.col(p) == F.col(q) for p, q in zip(a, b, strict=True)])
    return _rows(df.where(same), "independent_models", F.col(key), F.lit(None))


def unchanged(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Accepted rows that are gone or changed."""
    lost = _rows(previous.join(current.select(key), key, "left_anti"), "unchanged", F.col(key), F.lit("gone"))
    return lost.unionByName(fields_match(previous, current, key, fields).withColumn("constraint", F.lit("unchanged")))
