"""Problem 8: abusive, hateful or sexual content.

A linear classifier over hashed character n-grams whose features are scaled by naive Bayes log-count ratios. Texts are
cut into sentences, a document scores as its worst sentence: one remark counts however long the text around it. The
labels are of documents, so fitting alternates between the classifier and the choice of the sentences that carry the
label (the sentences of clean documents are all clean).

Disguises are undone first: Unicode form, case, invisible characters, look-alike letters, digits for letters, stretched
letters, and separators between letters or Han characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
BUCKETS = 1 << BITS
ORDERS = 4
#: Bound of the labelled documents the classifier is fitted on, by label.
FIT_POSITIVE, FIT_NEGATIVE = 2500, 7000
POSITIVE_WEIGHT = 3.0
#: A sentence's score is its sum over n-grams divided by their number to this power.
LENGTH_POWER = 0.35

# Cyrillic and Greek letters and the Latin letters they look like.
_LOOKALIKE = dict(zip("аеорсхуіјѕкмтвнгԁαβεικνορτυχ", "aeopcxyijskmtbhrdabeiknoptux", strict=True))
_LEET = str.maketrans("013457@$", "oieastas")
_HAN = "㐀-䶿一-鿿"
_GAP = " \\t·•・|丶*_~^./\\\\+#=\\-"
_HAN_ANY = re.compile(f"[{_HAN}]")
_INVISIBLE = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\xad\u0300-\u036f\u0600-\u0605\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0001-\U000e01ef]")
_FOREIGN = re.compile("[\u0370-\u052f]")
_LATIN = re.compile("[ßà-ɏ]")
# Patterns start with the rarest character class, which the matcher can search for; what comes before is looked at after.
_HAN_GAP = re.compile(f"[{_GAP}]{{1,3}}(?=[{_HAN}])")
_SPACED = re.compile(f"[a-z0-9@$*](?<![a-z0-9][a-z0-9@$*])(?:[{_GAP}][a-z0-9@$*]){{2,}}(?![a-z0-9])")
_INNER = re.compile("[·•・|*_~^丶]+(?=[a-z])")
_SEPARATOR = re.compile("[ \\t·•・|_~^./\\\\+#=\\-]")
_LEET_IN = re.compile("[013457@$]+(?=[a-z])")
_NUMBER = re.compile("[0-9][0-9.,]*[0-9]|[1-9]")
_DOT = re.compile(rf"\.(?=\s|$|[{_HAN}])(?<=[^\W_][^\W_]\.)|\.\.+")
_END = re.compile("[。！？!?;；…\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")


def _between_han(m: re.Match) -> str:
    return "" if m.start() and _HAN_ANY.match(m.string[m.start() - 1]) else m.group()


def _inside_word(m: re.Match) -> str:
    return "" if m.start() and "a" <= m.string[m.start() - 1] <= "z" else m.group()


def _letters(m: re.Match) -> str:
    """Digits for letters: between letters, or one at the start of a word."""
    before = m.string[m.start() - 1] if m.start() else " "
    after = m.string[m.end() : m.end() + 2]
    if "a" <= before <= "z" or (len(m.group()) == 1 and not before.isalnum() and after.isalpha() and after.isascii()):
        return m.group().translate(_LEET)
    return m.group()


def undisguised(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        if _LATIN.search(text):
            text = unicodedata.normalize("NFKD", text).replace("ß", "ss")
        text = _INVISIBLE.sub("", text)
        text = _FOREIGN.sub(lambda m: _LOOKALIKE.get(m.group(), m.group()), text)
        text = _HAN_GAP.sub(_between_han, text)
    text = _SPACED.sub(lambda m: _SEPARATOR.sub("", m.group()), text)
    text = _LEET_IN.sub(_letters, text)
    text = _INNER.sub(_inside_word, text)
    for c in "abcdefghijklmnopqrstuvwxyz":
        if c * 3 in text:
            text = re.sub(c + "{3,}", c, text)
    return _NUMBER.sub("0", text)


def sentences(text: str | None) -> list[str]:
    """The undisguised sentences of a text, none for null or blank text."""
    return split_all([text])[0]


def split_all(texts: list[str | None]) -> list[list[str]]:
    """``sentences`` of many texts: equal raw sentences are undisguised once, all in one pass over a joined string."""
    index: dict[str, int] = {}
    of = [[index.setdefault(s, len(index)) for s in _END.split(_DOT.sub("\n", t)) if s] if t else [] for t in texts]
    clear = [s.strip() for s in undisguised("\n".join(index)).split("\n")] if index else []
    return [[clear[k] for k in ids if clear[k]] for ids in of]


def _grams(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed n-grams of all sentences (padded with a mark at both ends) and their rows, ascending."""
    joined = "\x02" + "\x03\x02".join(parts) + "\x03"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), np.array([len(p) + 2 for p in parts], np.int64))
    h = np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        k = len(code) - n + 1
        if k <= 0:
            return
        h = h[:k] * np.uint32(0x9E3779B1) + code[n - 1 :] + np.uint32(n)
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x85EBCA6B)
        f = (x >> np.uint32(32 - BITS)).astype(np.int32)
        inside = row[:k] == row[n - 1 :]
        yield f[inside], row[:k][inside]


def ngrams(parts: list[str], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams by sentence: (feature, offsets). Grams of a sentence lie together, by order and place."""
    size = np.array([len(p) + 2 for p in parts], np.int64)
    per = [np.maximum(size - n + 1, 0) for n in range(1, ORDERS + 1)]
    offset = np.concatenate([[0], np.cumsum(np.sum(per, axis=0))]) if parts else np.zeros(1, np.int64)
    out = np.empty(offset[-1], np.int32)
    for lo in range(0, len(parts), chunk):
        own = slice(lo, lo + chunk)
        start = offset[:-1][own].copy()
        for n, (f, r) in enumerate(_grams(parts[own])):
            count = per[n][own]
            inside = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            out[start[r] + inside] = f
            start += count
    return out, offset


def _by_sentence(feature: np.ndarray, offset: np.ndarray, most: int = 2_000_000):
    """(feature, row) in slices of whole sentences, about ``most`` n-grams each: bounds the temporary arrays."""
    lo = 0
    while lo < len(offset) - 1:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + most, "right")) - 1)
        yield feature[offset[lo] : offset[hi]], np.repeat(np.arange(lo, hi), np.diff(offset[lo : hi + 1]))
        lo = hi


def sums(feature: np.ndarray, offset: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of the weights of each sentence's n-grams."""
    out = np.zeros(len(offset) - 1)
    for f, r in _by_sentence(feature, offset):
        out += np.bincount(r, weight[f], len(out))
    return out


@dataclass
class Model:
    weight: np.ndarray  # the product of log-count ratio and coefficient of each bucket
    bias: float
    threshold: float

    def scores(self, feature: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return self._squash(sums(feature, offset, self.weight), np.diff(offset))

    def of_sentences(self, parts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(parts)), np.zeros(len(parts))
        for f, r in _grams(parts):
            total += np.bincount(r, self.weight[f], len(parts))
            n += np.bincount(r, minlength=len(parts))
        return self._squash(total, n)

    def _squash(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) ** LENGTH_POWER + self.bias, -30, 30)))


def log_ratios(feature: np.ndarray, offset: np.ndarray, pos_mass: np.ndarray, neg_mass: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Smoothed log of how much more often each n-gram occurs in the positive than in the negative sentences."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, r in _by_sentence(feature, offset):
        pos += np.bincount(f, pos_mass[r], BUCKETS)
        neg += np.bincount(f, neg_mass[r], BUCKETS)
    scale = max(neg.sum(), 1.0) / max(pos.sum(), 1.0)
    return np.log((pos * scale + alpha * min(scale, 10)) / (neg + alpha * min(scale, 10))).astype(np.float32)


def _linear(feature: np.ndarray, offset: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 5, decay: float = 2e-5, seed: int = 3) -> Model:
    """Logistic regression on the scaled features by Adam in mini-batches."""
    n = np.diff(offset)
    ratio = log_ratios(feature, offset, weight * y, weight * (1 - y))
    coef, bias = np.full(BUCKETS, 0.5, np.float32), -2.0
    m, v, mb, vb = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0
    rng, step = np.random.default_rng(seed), 0
    used = np.flatnonzero(weight > 0)
    size = max(256, len(used) // 60)
    for _ in range(epochs):
        order = used[rng.permutation(len(used))]
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            k = n[rows]
            ends = np.cumsum(k)
            f = feature[np.arange(ends[-1]) - np.repeat(ends - k, k) + np.repeat(offset[rows], k)]
            r = np.repeat(np.arange(len(rows)), k)
            scale = 1 / np.maximum(k, 1) ** LENGTH_POWER
            z = np.bincount(r, (coef * ratio)[f], len(rows)) * scale + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - y[rows]) * weight[rows]
            total = weight[rows].sum()
            grad = (np.bincount(f, (g * scale)[r], BUCKETS).astype(np.float32) * ratio) / total + decay * coef
            gb = g.sum() / total
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            coef = coef - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return Model((coef * ratio).astype(np.float32), float(bias), 0.5)


def fit(texts: list[str], labels: list[int], positive_rate: float | None = None, folds: int = 2, passes: int = 2) -> Model:
    """Fit on labelled documents.

    1. For each fold, n-gram ratios of the sentences in positive and negative documents outside the fold; sentences of
       the fold's positive documents above 97 % of its negative documents' sentences (with and without Han apart) carry the
       label.
    2. For each fold, a classifier of these sentences from the other folds: its scores of the fold's documents set the
       threshold at the best F1 and choose the label-carrying sentences anew (``passes`` times).
    3. The classifier of all folds. ``positive_rate`` is the share of positives among all labelled documents, of which
       the sample may hold more.
    """
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -8.0 if not len(y) or y.max() == 0 else 8.0, 0.5)
    index: dict[str, int] = {}
    of = [np.array(sorted({index.setdefault(s, len(index)) for s in p}), np.int64) for p in split_all(texts)]
    feature, offset = ngrams(list(index))
    total = len(index)
    fold = np.arange(len(y)) % folds

    def mass(docs: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([of[k] for k in docs] or [np.zeros(0, np.int64)]), minlength=total).astype(float)

    n = np.diff(offset)
    han = np.array([bool(_HAN_ANY.search(t)) for t in index])
    carriers: set[int] = set()
    for k in range(folds):
        ratio = log_ratios(feature, offset, mass(np.flatnonzero((fold != k) & (y == 1))), mass(np.flatnonzero((fold != k) & (y == 0))))
        s = sums(feature, offset, ratio) / np.sqrt(np.maximum(n, 1))
        clean = mass(np.flatnonzero((fold == k) & (y == 0))) > 0
        bar = np.array([max(np.quantile(s[clean & own], 0.97), 0.3) if (clean & own).any() else 0.3 for own in (~han, han)])[han.astype(int)]
        for d in np.flatnonzero((fold == k) & (y == 1)):
            carriers.update(of[d][s[of[d]] > bar[of[d]]].tolist())

    def train(docs: np.ndarray, chosen: set[int]) -> Model:
        pos, neg = mass(docs[y[docs] == 1]), mass(docs[y[docs] == 0])
        carried = np.zeros(total)
        carried[list(chosen)] = 1
        target = ((carried > 0) & (pos >= neg)).astype(float)
        # sentences of positive documents that don't carry the label are left out, those of negative ones count by document
        return _linear(feature, offset, target, np.where(target > 0, (pos > 0) * POSITIVE_WEIGHT, neg**0.75))

    out_of_fold = np.zeros(len(y))
    for _ in range(passes):
        again: set[int] = set()
        for k in range(folds):
            s = train(np.flatnonzero(fold != k), carriers).scores(feature, offset)
            for d in np.flatnonzero(fold == k):
                if len(of[d]):
                    out_of_fold[d] = s[of[d]].max()
                    if y[d]:
                        again.update(of[d][s[of[d]] >= max(0.5, 0.6 * out_of_fold[d])].tolist())
        carriers = again or carriers
    threshold = best_threshold(out_of_fold, y, positive_rate)
    model = train(np.arange(len(y)), carriers)
    return Model(model.weight, model.bias, threshold)


def best_threshold(score: np.ndarray, y: np.ndarray, positive_rate: float | None) -> float:
    if not len(y) or y.min() == y.max():
        return 0.5
    rate = y.mean() if positive_rate is None else min(max(positive_rate, 1e-6), 1 - 1e-6)
    w = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    o = np.argsort(-score, kind="stable")
    tp, n = np.cumsum((w * y)[o]), np.cumsum(w[o])
    f1 = 2 * tp / (n + (w * y).sum())
    k = int(np.flatnonzero(f1 >= 0.985 * f1.max())[-1])  # the lowest threshold about as good as the best
    nxt = score[o][k + 1] if k + 1 < len(o) else 0.0
    return float((score[o][k] + nxt) / 2)


def document_scores(parts: list[list[str]], model: Model, chunk: int = 300_000) -> np.ndarray:
    """The worst sentence's score of each document, 0 without any; equal sentences are scored once, about ``chunk``
    characters at a time."""
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(s, len(index)) for p in parts for s in p], np.int64)
    values, at, size = [], [], 0
    for s in index:
        at.append(s)
        size += len(s)
        if size >= chunk:
            values.append(model.of_sentences(at))
            at, size = [], 0
    if at:
        values.append(model.of_sentences(at))
    out = np.zeros(len(parts))
    if len(flat):
        np.maximum.at(out, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(values)[flat])
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVE, negatives: int = FIT_NEGATIVE) -> tuple[list[str], list[int], float]:
    """Texts, labels and the positive rate. Of each label the documents with the lowest hash are taken, up to the bounds;
    documents labelled null only, with different values, or not there are left out."""
    agreed = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").select("doc_id", "toxic")
    ready = agreed.join(documents.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("order", F.md5(F.col("doc_id").cast("string").cast("binary")))
    counts = {r[0]: r[1] for r in ready.groupBy("toxic").count().collect()}
    picked = ready.where("toxic = 1").orderBy("order").limit(positives).unionByName(ready.where("toxic = 0").orderBy("order").limit(negatives))
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("order", "text", "toxic").collect()  # at most positives + negatives ids
    rows = sorted(rows)
    total = sum(counts.values())
    return [r[1] for r in rows], [int(r[2]) for r in rows], counts.get(1, 0) / total if total else 0.0


def scored(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, score (0..1) and flagged of every document; null and blank texts score 0."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats
    slim = documents.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes[:-1]) + ", score double, flagged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                b = whole.slice(at, 10_000)
                s = document_scores(split_all(b.column(b.num_columns - 1).to_pylist()), own)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array(s >= own.threshold)], [*b.schema.names[:-1], "score", "flagged"])

    return slim.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    texts, y, rate = labelled_sample(documents, labels)
    return scored(documents, fit(texts, y, positive_rate=rate), keep or ["doc_id"])
