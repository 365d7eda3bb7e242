"""Canonical keys, code-point classes, identifiers and the text policy, as JVM expressions where they can be."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP = re.compile("[\\s\\-_\u2010-\u2015\u2212\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f\ufe63\uff0d\uff3f\U000e0100-\U000e01ef]+")
_ASCII_DROP = str.maketrans("", "", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f-_")


def canon(text: str | None) -> str | None:
    """NFKC, lower case, without white space, joiners, variation selectors and format characters; blank gives None."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_ASCII_DROP).lower() or None
    return _DROP.sub("", unicodedata.normalize("NFKC", _DROP.sub("", text))).lower() or None


def _canon_series(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else canon(v) for v in values], dtype=object)


def canon_col(column: Column | str) -> Column:
    """``canon`` as a column: ASCII values in the JVM, the others in Arrow batches (the rest of them is sent as nulls)."""
    c = F.col(column) if isinstance(column, str) else column
    plain = ~c.rlike("[^\\x00-\\x7f]")
    own = F.nullif(F.lower(F.translate(c, " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f-_", "")), F.lit(""))
    return F.when(plain, own).otherwise(F.pandas_udf(_canon_series, T.StringType())(F.when(~plain, c)))


def canon_digest(column: Column | str) -> Column:
    """A hex digest by its value: ``canon_col`` without the name of the algorithm or 0x in front."""
    return F.nullif(F.regexp_replace(canon_col(column), "^(sha256[:=]?|0x)", ""), F.lit(""))


# The code-point ranges that count as CJK (Unicode blocks of unified and compatibility ideographs).
CJK = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2F800, 0x2FA1F), (0x30000, 0x323AF),
)
# The private-use ranges (general category Co).
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))


def _within(cp: Column, ranges) -> Column:
    return reduce(lambda a, b: a | b, [cp.between(lo, hi) for lo, hi in ranges])


def unicode_class(char: Column) -> Column:
    """REPLACEMENT, PRIVATE_USE, NONCHARACTER, CJK or OTHER of the first code point, tested in this order; null for null."""
    cp = F.ascii(char)
    last = cp.bitwiseAND(F.lit(0xFFFE))
    return (
        F.when(char.isNull(), F.lit(None).cast("string"))
        .when(cp == 0xFFFD, "REPLACEMENT")
        .when(_within(cp, PRIVATE), "PRIVATE_USE")
        .when(cp.between(0xFDD0, 0xFDEF) | (last == 0xFFFE), "NONCHARACTER")
        .when(_within(cp, CJK), "CJK")
        .otherwise("OTHER")
    )


def policy_risk(klass: Column, in_catalog: Column, threshold: float) -> Column:
    """1 for unsafe code points; below 0.5 and below the threshold for rare CJK and for others; 0 for catalogued CJK."""
    soft = F.lit(max(0.0, min(0.49, threshold - 1e-9)))
    return F.when(klass.isin("REPLACEMENT", "PRIVATE_USE", "NONCHARACTER"), 1.0).when((klass == "CJK") & ~in_catalog, soft).when(klass == "OTHER", F.least(F.lit(0.49), soft)).otherwise(0.0)


def policy_scores(df: DataFrame, char: str, confidence: str, visual: str, known: str, threshold: float = 0.5) -> DataFrame:
    """The text policy per recognised character, added to ``df``.

    ocr_risk is 1 - confidence, membership_risk comes from the code point and the catalog, combined_risk is the largest of
    these and the visual score (null counts 0 there). auto_block needs an unsafe code point or a visual score at the
    threshold; needs_review is set by anything unusual, a visual score at all included. Null characters give nulls.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be within (0, 1]")
    c, klass = F.col, unicode_class(F.col(char))
    unsafe, outside = F.col("unicode_class").isin("REPLACEMENT", "PRIVATE_USE", "NONCHARACTER"), ~F.coalesce(c(known), F.lit(False))
    seen = F.coalesce(c(visual) >= threshold, F.lit(False))
    out = df.withColumn("unicode_class", klass).withColumns({"ocr_risk": 1 - c(confidence), "membership_risk": policy_risk(F.col("unicode_class"), ~outside, threshold)})
    out = out.withColumn("combined_risk", F.greatest("ocr_risk", "membership_risk", F.coalesce(visual, F.lit(0.0))))
    odd = unsafe | (F.col("unicode_class") == "OTHER")
    return out.withColumns({"out_of_catalog": outside, "text_rule_anomaly": odd, "auto_block": unsafe | seen, "needs_review": outside | odd | F.coalesce(c(confidence) < threshold, F.lit(False)) | c(visual).isNotNull()})


def default_kind(kind: Column, decision: Column) -> Column:
    """A missing or blank kind is NONE for rows that pass and unknown for the others."""
    return F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.when(decision == "PASS", "NONE").otherwise("unknown"))


#: An SVG path: a move, then drawing commands, each with at least one number or Z.
SVG_PATH = r"^\s*[Mm][\s,]*[-+0-9.eE\s,]+([LlHhVvCcSsQqTtAaMm][-+0-9.eE\s,]+|[Zz]\s*)*$"


def svg_tokens(path: Column) -> Column:
    """Commands and numbers of a path in order; null if it is no path."""
    return F.when(path.rlike(SVG_PATH), F.regexp_extract_all(path, F.lit(r"([MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"), 1))


def valid_url(url: Column) -> Column:
    """http or https with a host and no white space; null is not valid."""
    return F.coalesce(url.rlike(r"^https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def path_parts(path: Column) -> Column:
    """Folder, name, stem and suffix (lower case, with the dot) of a path or of the path of a URL."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^[a-zA-Z]+://[^/]*", ""), r"[?#].*$", "")
    name = F.element_at(F.split(plain, r"[/\\]"), -1)
    return F.struct(F.regexp_extract(plain, r"^(.*)[/\\][^/\\]*$", 1).alias("folder"), name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).alias("suffix"))


def utc_today() -> Column:
    """The current date; only for metadata, never part of a hash."""
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per code point: (key, position, char)."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(F.split(text, "")).alias("position", "char")).where("char <> ''")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix + SHA-256 of the parts joined by NUL; a null part counts as empty."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def clamped_box(box: Column, pad: int, width: Column, height: Column) -> Column:
    """The box grown by ``pad`` and cut to the image."""
    return F.struct(
        F.greatest(box["x0"] - pad, F.lit(0)).alias("x0"), F.greatest(box["y0"] - pad, F.lit(0)).alias("y0"),
        F.least(box["x1"] + pad, width).alias("x1"), F.least(box["y1"] + pad, height).alias("y1"),
    )


def canonical_json(columns: list[str]) -> Column:
    """JSON of the columns in name order, nulls included, for hashing."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
