"""Sources: declared-schema tables by suffix, JSON lines, CSV, numbered catalogs, documents, files and scoring services."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines or CSV by suffix; text formats need a schema and fail on malformed rows."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if low.endswith(".orc"):
        return (spark.read.schema(schema) if schema else spark.read).orc(path)
    if low.endswith((".jsonl", ".ndjson")):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if low.endswith((".csv", ".csv.gz")):
        return (spark.read.schema(schema) if schema else spark.read).option("header", True).option("mode", "FAILFAST").csv(path)
    raise ValueError(f"unknown format: {path}")


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): blank lines skipped; malformed lines and repeated keys are errors with their line number."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        for pdf in frames:
            at = pdf.groupby(["file", "block"]).cumcount()
            base = [seen.get(k, 0) for k in zip(pdf["file"], pdf["block"], strict=True)]
            for k, n in pdf.groupby(["file", "block"]).size().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield pdf.assign(inside=at + base + 1)

    inside = lines.mapInPandas(numbered, "value string, file string, block long, inside long")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offset = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    raw = inside.join(offset, ["file", "block"]).select("value", "file", (F.col("inside") + F.col("offset")).alias("line")).where("trim(value) <> ''")
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("r._bad IS NULL").select("file", "line", "r.*").drop("_bad")
    bad = parsed.where("r._bad IS NOT NULL").select("file", "line", F.lit("malformed").alias("error"))
    dup = good.join(good.groupBy(key).agg(F.min(F.struct("file", "line")).alias("first"), F.count("*").alias("n")).where("n > 1"), key)
    dup = dup.where((F.col("first.file") != F.col("file")) | (F.col("first.line") != F.col("line"))).select("file", "line", F.lit("duplicate key").alias("error"))
    return good, bad.unionByName(dup)


def with_optional(df: DataFrame, **defaults: T.DataType) -> DataFrame:
    """Add missing columns as typed nulls."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in defaults.items() if n not in df.columns}) if defaults else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Characters of a UTF-8 text, with or without byte-order mark, numbered (n<tab>char) or free: (char, uses)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    body = F.when(F.col("v").rlike(r"^\s*[0-9]+\t"), F.regexp_replace("v", r"^\s*[0-9]+\t", "")).otherwise(F.col("v"))
    return lines.select(F.explode(F.split(F.regexp_replace(body, r"\s+", ""), "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("uses"))


def document(path: str) -> dict:
    """A small TOML document, on the driver."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256, content) of binary files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, mode, data) of decodable images."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.mode", "image.data")


def scored(df: DataFrame, columns: list[str], scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a pluggable scorer, built once per task (a service client, a model), in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for pdf in frames:
            yield score(pdf)

    return df.select(*columns).mapInPandas(run, schema)


OCR = "lines array<struct<text:string,score:double,characters:array<struct<char:string,confidence:double,box:array<double>,topk:map<string,double>>>>>, stage_ms map<string,double>, model string"


def ocr_characters(df: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(characters, errors) of JSON payloads: ids are positional (ocr-key-line-char); payloads that don't parse, and
    characters without text or with a confidence outside 0..1, are errors."""
    parsed = df.select(F.col(key).alias("key"), F.col(payload).alias("__raw"), F.from_json(payload, OCR + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    flat = parsed.where("r._bad IS NULL").select("key", F.posexplode("r.lines").alias("line", "l")).select("key", "line", F.posexplode("l.characters").alias("position", "c"))
    chars = flat.select(F.concat_ws("-", F.lit("ocr"), "key", "line", "position").alias("character_id"), "key", "line", "position", F.col("c.char").alias("char"), F.col("c.confidence").alias("confidence"), F.element_at("c.topk", F.col("c.char")).alias("own_score"), F.size("c.topk").alias("alternatives"))
    ok = F.col("char").isNotNull() & (F.col("char") != "") & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    bad = parsed.where("__raw IS NULL OR r._bad IS NOT NULL").select("key", F.lit("payload").alias("error")).unionByName(chars.where(~ok).select("key", F.lit("character").alias("error")))
    return chars.where(ok), bad
