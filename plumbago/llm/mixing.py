"""Problem 7: mix sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear, whose integral is its target share; at
every moment the weights sum to 1. The integral times the total size is the source's cumulative demand. A document
starts at the cumulative tokens of its source before it; inverting the demand at that point gives its position, and
sorting by position gives the mix. A source shorter than its demand is repeated, at most max_repeats times; one that
is still too short gives all it may, and the others share what it lacks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.keys import canon_col
from plumbago.operators.blocked import lowest, running_sums
from plumbago.session import written

KNOTS = 5
LIMIT_SOURCES = 100_000
#: How much of the mix scarce sources may miss together when the total is chosen for them.
SHORT = 0.02


def schedules(shares: Mapping[str, float], slopes: Mapping[str, float] | None = None, knots: int = KNOTS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weights and their integrals at equidistant knots for each source; shares must be positive and sum to 1.

    A slope of a source (-1 .. 1) moves its weight from early to late training. By default sources alternate between
    the two by rank of their share. Slopes are centred so that the weights sum to 1 at every knot.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    p = np.array([shares[s] for s in names])
    a = np.array([(slopes or {}).get(s, 0.5 if k % 2 else -0.5) for k, s in enumerate(names)])
    a = a - (p * a).sum()
    a = a / max(1.0, np.abs(a).max())
    t = np.linspace(0, 1, knots)
    w = p[:, None] * (1 + a[:, None] * (2 * t - 1)[None])
    c = np.concatenate([np.zeros((len(names), 1)), np.cumsum((w[:, 1:] + w[:, :-1]) / 2 * np.diff(t), axis=1)], axis=1)
    return {s: (w[k], c[k]) for k, s in enumerate(names)}


def inverse(demand, weights, integrals, knots: int):
    """Column: the time at which the integral reaches ``demand`` (both per unit of total size)."""
    seg = F.least(F.greatest(F.size(F.filter(integrals, lambda x: x <= demand)) - 1, F.lit(0)), F.lit(knots - 2))
    step = 1.0 / (knots - 1)
    w0, w1 = F.element_at(weights, seg + 1), F.element_at(weights, seg + 2)
    rest = demand - F.element_at(integrals, seg + 1)
    slope = (w1 - w0) / F.lit(step)
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    x = F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(F.lit(0.0))
    return F.least(seg * F.lit(step) + F.least(x, F.lit(step)), F.lit(1.0))


def supplies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share, repeats, documents and tokens at hand."""
    wanted = targets.select(F.col("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source IS NOT NULL AND target_share > 0")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    return wanted.join(held, "source", "left").fillna(0, ["docs", "tokens"])


def largest_total(caps: Mapping[str, float], shares: Mapping[str, float], short: float) -> float:
    """The largest total at which the shares that sources cannot reach (cap < share x total) add up to at most ``short``.

    What is missing at a total T is the sum of max(0, share - cap / T): it grows with T and between two sources that
    run out it is a - b / T. No total is above what all caps give together.
    """
    a = b = 0.0
    best = 0.0
    for source in sorted(shares, key=lambda s: (caps[s] / shares[s], s)):
        start = caps[source] / shares[source]
        if a - b / max(start, 1e-300) > short:
            break
        best = start
        a, b = a + shares[source], b + caps[source]
    if a > short:
        best = max(best, b / (a - short))
    return min(best, sum(caps.values()))


def demands(caps: Mapping[str, float], shares: Mapping[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: its share of the total, at most its cap; what short sources lack goes to the others in
    proportion to their shares (water-filling). All caps together bound the total."""
    out: dict[str, float] = {}
    rest, weight = min(total, sum(caps.values())), sum(shares.values())
    for source in sorted(shares, key=lambda s: (caps[s] / shares[s], s)):
        out[source] = min(caps[source], rest * shares[source] / weight)
        rest, weight = rest - out[source], weight - shares[source]
    return out


def _closed(size: np.ndarray, n: np.ndarray, take: np.ndarray, gap: float, whole: bool) -> tuple[float, np.ndarray]:
    """``take`` changed to close the gap, and what stays open of it. Documents that are too much go from the longest that
    is not too long down, or (``whole``) as the shortest one that is long enough; then what fits comes in."""
    take = take.copy()
    while gap < 0 and take.any():
        used = np.flatnonzero(take)
        fits, enough = used[size[used] <= -gap], used[size[used] >= -gap]
        k = enough[0] if len(enough) and (whole or not len(fits)) else fits[-1]
        less = int(min(take[k], max(-gap // size[k], 1)))
        take[k] -= less
        gap += less * size[k]
    for k in range(len(size) - 1, -1, -1):
        more = int(min(n[k] - take[k], max(gap, 0) // size[k]))
        take[k] += more
        gap -= more * size[k]
    left = np.flatnonzero(take < n)
    if len(left) and gap * 2 >= size[left[0]]:
        take[left[0]] += 1
        gap -= size[left[0]]
    return abs(gap), take


def fill(size: np.ndarray, n: np.ndarray, rest: float) -> np.ndarray:
    """How many of ``n`` documents of each size (ascending) to take so that their sizes sum to about ``rest``: a systematic
    sample over all sizes, so that short and long documents are taken alike, changed where it misses the sum."""
    part = min(rest / max(float((n * size).sum()), 1.0), 1.0)
    take = np.diff(np.r_[0, np.floor(np.cumsum(n) * part + 0.5).astype(np.int64)])
    gap = rest - float((take * size).sum())
    return min((_closed(size, n, take, gap, whole) for whole in (True, False)), key=lambda x: x[0])[1]


def _last_pass(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, n_tokens, take): ``fill`` for what whole passes over a source leave open, on the counts per source and
    size (at most one row for each size up to the longest document)."""
    sizes = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).join(plans.select("source", "rest"), "source")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens", kind="stable")
        take = fill(pdf["n_tokens"].to_numpy(), pdf["n"].to_numpy(), float(pdf["rest"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "take": take})

    return sizes.groupBy("source").applyInPandas(run, "source string, n_tokens long, take long").where("take > 0")


def mixed(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, slopes: Mapping[str, float] | None = None, short: float = SHORT) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of (doc_id, source, n_tokens) rows with n_tokens > 0 and canonical sources.

    Without ``total_tokens`` the total is the largest at which the shares that scarce sources cannot reach add up to at
    most ``short``: it follows the corpus, not its scarcest source. Scarce sources give all their repeats, the report
    shows by how much they miss, and the others share the rest in proportion. Sources without documents are left out.
    mix: source, doc_id, copy, n_tokens, position, sorted by position. A source is passed over as a whole as often as its
    demand allows; the last pass takes documents of all sizes so that it misses the demand by about half of the
    shortest document left. Repeated doc_ids count as documents of their own; no matching source gives an empty mix.
    """
    spark = sized.sparkSession
    supply = written(supplies(sized, targets), "mix-supply")
    rows = supply.limit(LIMIT_SOURCES + 1).collect()
    if len(rows) > LIMIT_SOURCES:
        raise ValueError("too many target sources for driver-side schedules")
    live = {r.source: r for r in rows if r.tokens > 0 and r.max_repeats > 0}
    whole = sum(r.target_share for r in live.values())
    shares = {s: r.target_share / whole for s, r in live.items()}
    caps = {s: float(r.tokens * r.max_repeats) for s, r in live.items()}
    schema = "source string, demand double, supply long, passes int, rest double, weights array<double>, integrals array<double>"
    plan: list[Sequence] = []
    wanted = demands(caps, shares, float(total_tokens) if total_tokens is not None else largest_total(caps, shares, short)) if live else {}
    total = sum(wanted.values())
    if total > 0:
        for s, (w, c) in schedules({s: d / total for s, d in wanted.items()}, slopes).items():
            passes = int(wanted[s] / live[s].tokens + 1e-9)
            plan.append((s, wanted[s], int(live[s].tokens), passes, max(wanted[s] - passes * live[s].tokens, 0.0), w.tolist(), c.tolist()))
    plans = F.broadcast(spark.createDataFrame(plan, schema))  # one row a source, bounded by LIMIT_SOURCES
    order = F.xxhash64("doc_id")
    fit = sized.select("source", "doc_id", "n_tokens", order.alias("order"), F.concat_ws("|", F.col("n_tokens").cast("string"), "source").alias("cell"))
    fit = written(fit.join(plans.select("source"), "source", "left_semi").withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("n_tokens"))), "mix-fit")
    quotas = _last_pass(fit, plans).select(F.concat_ws("|", F.col("n_tokens").cast("string"), "source").alias("cell"), "take")
    chosen = lowest(fit, "cell", F.shiftright("order", 52), [F.col("order"), F.col("doc_id"), F.col("twin")], quotas, "take")
    placed = running_sums(chosen, ["source"], F.shiftright("order", 52), [F.col("order"), F.col("doc_id"), F.col("twin")], {"before": F.col("n_tokens"), "before_last": F.when(F.col("chosen"), F.col("n_tokens")).otherwise(0)}).join(plans, "source")
    passes = F.col("passes") + F.col("chosen").cast("int")
    copies = placed.where(passes > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), passes)))
    start = F.when(F.col("copy") <= F.col("passes"), F.col("before") + (F.col("copy") - 1) * F.col("supply")).otherwise(F.col("before_last") + F.col("passes") * F.col("supply"))
    at = inverse(start / F.lit(max(total, 1.0)), F.col("weights"), F.col("integrals"), KNOTS)
    mix = copies.select("source", "doc_id", "copy", "n_tokens", at.alias("position"))
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_copies"), F.max("copy").alias("most_repeats"))
    both = supply.join(used, "source", "left").fillna(0, ["used_tokens", "used_copies", "most_repeats"])
    all_used = both.agg(F.sum("used_tokens").alias("all_used"))
    report = both.crossJoin(F.broadcast(all_used)).select("source", "target_share", F.round(F.when(F.col("all_used") > 0, F.col("used_tokens") / F.col("all_used")), 6).alias("actual_share"), "docs", "tokens", "used_tokens", "used_copies", "most_repeats", "max_repeats")  # one row
    report = report.withColumn("scarce", F.coalesce(F.col("used_tokens") >= F.col("tokens") * F.col("max_repeats"), F.lit(True)))
    return mix.orderBy("position", "source", "doc_id", "copy"), report


def mix_input(documents: DataFrame, targets: DataFrame, sized) -> tuple[DataFrame, DataFrame]:
    """Canonical sources on both sides, copied texts reduced to the smallest doc_id, token counts of the target sources' texts."""
    wanted = targets.select(canon_col("source").alias("source"), "target_share", "max_repeats")
    named = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", canon_col("source").alias("source"))
    kept = named.join(wanted.select("source").distinct(), "source", "left_semi")
    texts = sized(kept, "text", ["doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest")]).where("n_tokens > 0")
    one = texts.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")
    return one, wanted
