"""Sources of arrays and outlines: NPZ archives, stroke outlines as JSON lines, footers of Parquet tables, and reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions.text import SVG_PATH
from plumbago.sources.readers import json_lines

OUTLINE = "character string, strokes array<string>, medians array<array<array<double>>>"


def footer(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Column names and row count of a Parquet table, from its footers: no column is read."""
    df = spark.read.parquet(path)
    return df.columns, df.select().count()


def npz_arrays(spark: SparkSession, folder: str, glob: str = "*.npz") -> DataFrame:
    """(path, name, shape, dtype, values) of every numeric array in the archives; pickled objects are refused."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    rows += [(path, n, list(z[n].shape), str(z[n].dtype), z[n].astype(float).ravel().tolist()) for n in z.files]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "dtype", "values"])

    return raw.mapInPandas(run, "path string, name string, shape array<long>, dtype string, values array<double>")


def stroke_outlines(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outlines, errors) of JSON lines (character, strokes, medians), all of them checked, also those not asked for.

    Errors: malformed lines and repeated characters (by line), characters of several code points, strokes that are no SVG
    path, medians that don't match the strokes, and characters of ``wanted`` (char) that are not there.
    """
    rows, bad = json_lines(spark, path, OUTLINE, "character")
    one = F.coalesce(F.length("character") == 1, F.lit(False))
    paths = F.coalesce((F.size("strokes") > 0) & F.forall("strokes", lambda s: F.coalesce(s.rlike(SVG_PATH), F.lit(False))), F.lit(False))
    match = F.coalesce((F.size("strokes") == F.size("medians")) & F.forall("medians", lambda m: F.size(m) >= 2), F.lit(False))
    why = F.when(~one, "character").when(~paths, "strokes").when(~match, "medians")
    told = rows.withColumn("error", why)
    errors = bad.unionByName(told.where("error IS NOT NULL").select("file", "line", "error"))
    good = told.where("error IS NULL").drop("error")
    if wanted is not None:
        lost = wanted.select("char").distinct().join(rows.select(F.col("character").alias("char")), "char", "left_anti")
        errors = errors.unionByName(lost.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.concat(F.lit("missing "), "char").alias("error")))
        good = good.join(wanted.select(F.col("char").alias("character")).distinct(), "character", "left_semi")
    return good.drop("file", "line"), errors


def report(frames: Mapping[str, DataFrame], path: str, title: str, most_rows: int = 1000) -> tuple[str, str]:
    """Write small result frames as one JSON and one Markdown document (``path`` + .json, .md) and return both texts.

    Only for results: a frame of more than ``most_rows`` rows is refused, never cut.
    """
    tables = {}
    for name, df in frames.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        tables[name] = {"columns": df.columns, "rows": [[v if isinstance(v, int | float | bool | str | list | None) else str(v) for v in r] for r in rows]}
    cell = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", ""]
    for name, t in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(t["columns"]) + " |", "|" + " --- |" * len(t["columns"]), *["| " + " | ".join(map(cell, r)) + " |" for r in t["rows"]], ""]
    texts = json.dumps({"title": title, "tables": tables}, ensure_ascii=False, sort_keys=True, indent=1), "\n".join(lines)
    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.getActiveSession()
    for suffix, body in zip((".json", ".md"), texts, strict=True):
        out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + suffix)
        stream = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(out, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
    return texts
