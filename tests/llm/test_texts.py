import os
import random

import numpy as np
import pytest

from plumbago.llm import mixing, packing, tokens, toxicity

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")


def test_sum_of_squares_by_definition():
    rng = random.Random(1)
    sizes = [rng.randint(1, 20) for _ in range(300)]
    got = packing.sum_of_squares(sizes, 20)
    gaps, count = {}, np.zeros(21, int)
    for s, b in zip(sizes, got, strict=True):
        def after(g):
            c = count.copy()
            if g != 20:
                c[g] -= 1
            if g - s:
                c[g - s] += 1
            return int((c[1:20] ** 2).sum())
        used = gaps.get(b, 20)
        assert used >= s and after(used) == min([after(20), *[after(g) for g in range(s, 20) if count[g] > 0]])
        if used != 20:
            count[used] -= 1
        gaps[b] = used - s
        if gaps[b]:
            count[gaps[b]] += 1


def test_packing_keeps_everything(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice([1, 5, 60, 99, 100, 101, 350])) for k in range(900)] + [(9001, 0), (9002, None), (3, 40)]
    sizes = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("a", 100), ("b", 400), ("bad", None), ("zero", 0)], "container_name string, capacity_tokens int")
    out = packing.packed(sizes, kinds, shard_rows=200).cache()
    for name, cap in (("a", 100), ("b", 400)):
        rows = [r for r in out.collect() if r.container_name == name]
        assert sum(r.n_tokens or 0 for r in rows) == sum(n or 0 for _, n in docs)
        fill = {}
        for r in rows:
            if r.container_id is not None:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) / (cap * len(fill)) > 0.9
        assert all(r.container_id is None for r in rows if r.doc_id > 9000)
        assert {r.doc_id for r in rows if r.piece} == {k for k, n in docs if n and n > cap}
    assert packing.packed(sizes.limit(0), kinds).count() == 0
    assert {r.container_name for r in packing.usage(out).collect()} == {"a", "b"}


@needs_tokenizer
def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "字" * 60000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()}
    assert got[1] == got[2] == 0 and 0 < got[3] <= 4 and got[4] > 1 and got[5] >= 30000


def test_shares_repeats_and_positions(spark):
    rng = random.Random(3)
    docs = [(k, s, rng.randint(5, 40)) for k, s in enumerate(["a"] * 800 + ["b"] * 500 + ["c"] * 60)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("none", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(df, goals, short=0.0)
    rep = {r.source: r for r in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(rep[s].actual_share - share / 0.9) < 0.01 and rep[s].most_repeats <= rep[s].max_repeats
    assert rep["none"].actual_share == 0
    rows = mix.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    early = [r.n_tokens for r in rows if r.position < 0.5 and r.source == "a"]
    w, c = mixing.schedules({"a": 5 / 9, "b": 3 / 9, "c": 1 / 9})["a"]
    assert abs(sum(early) / sum(r.n_tokens for r in rows if r.source == "a") - c[2] / c[-1]) < 0.03
    assert np.allclose(np.sum([v[0] for v in mixing.schedules({"a": 0.5, "b": 0.3, "c": 0.2}).values()], axis=0), 1)


def test_last_pass_takes_all_sizes_and_meets_the_demand():
    rng = np.random.default_rng(2)
    for t in range(60):
        size = np.unique(rng.integers(1, 400 if t % 2 else 40_000, int(rng.integers(1, 60))))
        n = rng.integers(1, 6, len(size))
        rest = float(rng.uniform(0, (size * n).sum()))
        take = mixing.fill(size, n, rest)
        assert (take >= 0).all() and (take <= n).all()
        left, gap = np.flatnonzero(take < n), rest - float((take * size).sum())
        assert gap <= (size[left[0]] / 2 if len(left) else 0) + 1e-6 or not take.any()
    take = mixing.fill(np.arange(1, 101), np.full(100, 10), 25_250.0)
    assert take[:50].sum() > 200 and take[50:].sum() > 200  # short and long texts alike
    assert mixing.fill(np.array([5, 900]), np.array([3, 1]), 14.0).tolist() == [3, 0]


def test_total_follows_the_corpus_not_the_scarcest_source():
    caps, shares = {"a": 1000.0, "b": 500.0, "c": 1.0}, {"a": 0.6, "b": 0.39, "c": 0.01}
    total = mixing.largest_total(caps, shares, 0.02)
    missing = lambda x: sum(max(0, shares[s] - caps[s] / x) for s in caps)
    assert missing(total) <= 0.02 + 1e-9 < missing(total * 1.01) and total > 1000
    got = mixing.demands(caps, shares, total)
    assert abs(sum(got.values()) - total) < 1e-6 and got["c"] == 1 and abs(got["a"] / got["b"] - 0.6 / 0.39) < 0.1
    assert mixing.demands(caps, shares, 1e9) == caps
    assert mixing.largest_total({"a": 5.0}, {"a": 1.0}, 0.02) == 5


def test_mix_of_nothing_and_scarce_total(spark):
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    mix, report = mixing.mixed(empty, goals)
    assert mix.count() == 0 and report.count() == 2
    one = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "doc_id long, source string, n_tokens long")
    rep = {r.source: r for r in mixing.mixed(one, goals, total_tokens=1000)[1].collect()}
    assert rep["a"].used_tokens == 20 and rep["b"].used_tokens == 10


def test_copied_texts_are_one_text(spark):
    docs = spark.createDataFrame([(1, "x y", "A_b"), (2, "x y", "a-B"), (3, None, "ab"), (4, "", "ab"), (5, "z", "other")], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("ab", 1.0, 2)], "source string, target_share double, max_repeats int")
    from pyspark.sql import functions as F

    count = lambda d, t, keep: d.select(*keep, F.length(t).cast("long").alias("n_tokens"))
    rows, _ = mixing.mix_input(docs, goals, count)
    assert [(r.doc_id, r.source) for r in rows.collect()] == [(1, "ab")]


def test_disguises_are_undone():
    f = toxicity.undisguised
    assert f("ＦＯＯ") == "foo" and f("b a d w o r d") == "badword" and f("b4d") == "bad" and f("坏·人|啊") == "坏人啊" and f("baaaad") == "bad"
    assert f("f​oo") == "foo" and f("bа d") == "ba d" and f("12.50 x") == "0 x"
    assert toxicity.sentences("One two. Three！四？\n\n") == ["one two", "three", "四"] and toxicity.sentences(None) == toxicity.sentences("  ") == []


def corpus(n, seed):
    rng = random.Random(seed)
    good = ["the {} arrived on time", "please check the {} again", "这批{}印得很清楚", "the {} is terrible, i want a refund", "谢谢{}收到了"]
    bad = ["you are a worthless {} brain", "i will break your {} and your bones", "你就是个废物{}", "go away stupid {} head", "滚出去{}垃圾人"]
    things = ["lamp", "mug", "bag", "kettle", "灯", "杯", "箱"]
    docs, y = [], []
    for _ in range(n):
        label = rng.random() < 0.2
        s = [rng.choice(good).format(rng.choice(things)) for _ in range(rng.randint(1, 8))]
        if label:
            s.insert(rng.randrange(len(s) + 1), rng.choice(bad).format(rng.choice(things)))
        docs.append(". ".join(s))
        y.append(int(label if rng.random() > 0.04 else not label))
    return docs, y


def test_held_out_accuracy_with_noisy_labels():
    m = toxicity.fit(*corpus(900, 1))
    docs, y = corpus(500, 2)
    s = toxicity.document_scores(toxicity.split_all(docs), m) >= m.threshold
    assert (s == np.array(y)).mean() > 0.93


def test_scores_of_every_document(spark):
    docs, y = corpus(300, 4)
    rows = [(k, t, "src", 1.0) for k, t in enumerate(docs)] + [(1000, None, None, 1.0), (1001, "", "x", 1.0), (1002, "好 " * 50000, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, flag double")
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(y)] + [(1, None), (2, 1 - y[2]), (99999, 1), (None, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels, ["doc_id", "source"]).collect()}
    assert len(got) == len(rows) and got[1000].score == 0 and got[1001].score == 0
    none = toxicity.toxicity(df, labels.limit(0)).where("flagged").count()
    assert none == 0 and toxicity.toxicity(df.limit(0), labels).count() == 0
