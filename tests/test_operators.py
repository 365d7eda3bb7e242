import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbago.functions import text
from plumbago.operators import bags, constraints, grouping, images, metrics, queues, sampling, vectors
from plumbago.operators.blocked import lowest, running_sum
from plumbago.operators.components import hash_to_min
from plumbago.plans import suite
from plumbago.streaming import progress


def scored(spark, rows):
    return spark.createDataFrame(rows, "label boolean, score double")


def test_sweep_by_hand(spark):
    df = scored(spark, [(True, 0.9), (True, 0.8), (False, 0.8), (False, 0.1), (None, 0.5), (True, None), (True, float("nan"))])
    rows = sorted(metrics.threshold_sweep(df).collect(), key=lambda r: -r.threshold)
    assert [(r.tp, r.fp) for r in rows] == [(0, 0), (1, 0), (2, 1), (2, 2)]
    assert rows[0].threshold == np.nextafter(0.9, np.inf) and rows[2].recall == 1.0 and rows[2].fpr == 0.5


def test_areas_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(300)]
    got = metrics.ranking_areas(scored(spark, rows)).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert got.auroc == pytest.approx(auc)


def test_areas_without_positives_or_rows(spark):
    assert metrics.ranking_areas(scored(spark, [(False, 0.5)])).first().auroc is None
    assert metrics.ranking_areas(scored(spark, [])).count() == 0
    assert metrics.threshold_sweep(scored(spark, [])).count() == 0


def test_perfect_separation_on_few_rows_is_inconclusive(spark):
    df = scored(spark, [(True, 0.9)] * 5 + [(False, 0.1)] * 10)
    assert {r.status for r in metrics.operating_gates(df).collect()} == {"inconclusive"}


def test_calibrated_threshold_is_tie_safe(spark):
    rows = [("a", False, 0.5)] * 3 + [("a", False, 0.2)] * 7 + [("b", False, 0.4)]
    df = spark.createDataFrame(rows, "g string, label boolean, score double")
    got = {r.g: r.threshold for r in metrics.calibrated_threshold(df, 0.2, "g").collect()}
    assert got == {"a": np.nextafter(0.5, np.inf), "b": np.nextafter(0.4, np.inf)}
    assert {r.g: r.threshold for r in metrics.calibrated_threshold(df, 1.0, "g").collect()} == {"a": 0.2, "b": 0.4}


def test_running_sum_and_lowest(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(50), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id long")
    got = {r.id: r.before for r in running_sum(df, ["g"], F.floor(F.col("o") / 7), [F.col("o"), F.col("id")], F.lit(1), "before").collect()}
    quota = spark.createDataFrame([("a", 13), ("b", 1000)], "g string, q long")
    chosen = {r.id for r in lowest(df, "g", F.floor(F.col("o") / 7), [F.col("o"), F.col("id")], quota, "q").collect() if r.chosen}
    for g in "ab":
        own = sorted((o, k) for gg, o, k in rows if gg == g)
        assert all(got[k] == n for n, (_, k) in enumerate(own))
        assert {k for _, k in own} & chosen == {k for _, k in own[: 13 if g == "a" else 1000]}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(500, 560)] + [(None, 3), (9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert hash_to_min(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hamming_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(k, base[k % 20] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(8)))) for k in range(120)] + [(999, None), (500, base[0]), (501, base[0]), (502, -1)]
    df = spark.createDataFrame(rows, "id long, code long")
    got, bands = ({(r.a, r.b) for r in grouping.hamming_pairs(df, "id", "code", 6, segments=m).collect()} for m in (3, 7))
    assert got == bands
    code = {}
    for k, c in sorted(rows):
        if c is not None:
            code.setdefault(c & (1 << 64) - 1, k)
    reps = {k: c for c, k in code.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(reps), 2) if (reps[a] ^ reps[b]).bit_count() <= 6}
    want |= {(code[c & (1 << 64) - 1], k) for k, c in rows if c is not None and code[c & (1 << 64) - 1] != k}
    assert got == want


def test_suppressed_rows_hold_no_keys(spark):
    rng = random.Random(5)
    rows = [(k, rng.random(), rng.choice("abcdefghij") + str(rng.randrange(9)), rng.choice([None, *"uvwxyz"]) and f"g{rng.randrange(60)}") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, rank double, sha string, grp string")
    kept, seen = set(), set()
    for k, _, sha, grp in sorted(rows, key=lambda r: (r[1], r[0])):
        keys = {("sha", sha), ("grp", grp)} - {("grp", None)}
        if not keys & seen:
            kept.add(k)
            seen |= keys
    assert {r.id for r in queues.greedy_suppression(df, "id", "rank", ["sha", "grp"]).collect()} == kept


def test_interleaving_with_caps(spark):
    rows = [("a", 1, ["DISAGREEMENT"], "p"), ("b", 2, ["DISAGREEMENT", "THRESHOLD_BAND"], "p"), ("c", 3, ["THRESHOLD_BAND"], "q"), ("d", 4, ["DISAGREEMENT"], None)]
    df = spark.createDataFrame(rows, "id string, rank int, buckets array<string>, product string")
    got = [(r.id, r.bucket) for r in queues.interleaved(df, "id", "rank", "buckets", {"product": 1}, 10).orderBy("queue_rank").collect()]
    assert got == [("a", "DISAGREEMENT"), ("d", "DISAGREEMENT"), ("c", "THRESHOLD_BAND")]
    assert queues.interleaved(df.limit(0), "id", "rank", "buckets", {}, 10).count() == 0


def test_constraints_fail_closed(spark):
    df = spark.createDataFrame([("a", 1, "x/y"), ("a", 2, "../y"), ("b", None, "/z")], "k string, v int, path string")
    assert [(r.key, r.detail) for r in constraints.unique_key(df, "k").collect()] == [("a", "2")]
    found = constraints.conditions(df, "k", {"small": F.col("v") < 2, "path": constraints.contained_path(F.col("path"))}).collect()
    assert sorted((r.constraint, r.key) for r in found) == [("path", "a"), ("path", "b"), ("small", "a"), ("small", "b")]
    with pytest.raises(constraints.ConstraintError):
        constraints.assert_clean(constraints.determines(df, "k", "v"))
    constraints.assert_clean(constraints.foreign_key(df, "k", df, "k"))
    assert constraints.contiguous_folds(spark.createDataFrame([(0,), (2,), (-1,)], "f long"), "f", 2).count() == 2


def test_files_are_hashed_by_their_whole_path(spark, tmp_path):
    import hashlib

    from plumbago.sources import readers

    for folder, body in (("x", b"abc"), ("y", b"def")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a b.bin").write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = spark.createDataFrame([("x/a b.bin", sha(b"abc")), ("./y/a b.bin", sha(b"def").upper()), ("x/b.bin", "0" * 64)], "path string, sha string")
    check = lambda df: [(r.key, r.detail) for r in constraints.content_hashes(readers.files(spark, str(tmp_path)), df, "path", "sha", str(tmp_path)).collect()]
    assert check(rows) == [("x/b.bin", "missing")]
    assert check(spark.createDataFrame([("y/a b.bin", sha(b"abc"))], "path string, sha string")) == [("y/a b.bin", sha(b"def"))]


def test_labels_that_differ_in_one_batch_change_nothing(spark):
    old = spark.createDataFrame([("k", "PASS", "p")], "id string, label string, who string")
    new = spark.createDataFrame([("a", "PASS", "q"), ("a", "BLOCK", "p"), ("b", "PASS", "z"), ("b", "PASS", "y"), ("k", "BLOCK", "p"), ("n", None, "p"), ("n", "PASS", "p")], old.schema)
    merged, bad = queues.merge_labels(old, new, "id", ["label"])
    assert {tuple(r) for r in merged.collect()} == {("k", "PASS", "p"), ("b", "PASS", "y")} and {r.id for r in bad.collect()} == {"a", "k", "n"}
    assert queues.merge_labels(old, old, "id", ["label", "who"])[0].count() == 1


def test_equal_components_are_shared_out_as_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        load, item, n, whole = [[rng.randrange(9), rng.randrange(9)] for _ in range(5)], (rng.randrange(3), rng.randrange(1, 4)), rng.randrange(1, 300), [60, 300]
        slow, take = [x[:] for x in load], [0] * 5
        used = [x for x in (0, 1) if item[x]]
        for _ in range(n):
            f = min(range(5), key=lambda f: (round(sum((slow[f][x] + item[x]) / whole[x] for x in used), 12), sum(slow[f]), f))
            slow[f], take[f] = [a + b for a, b in zip(slow[f], item, strict=True)], take[f] + 1
        assert grouping.shared_out(load, whole, item, n) == take and load == slow


def test_turns_fetch_longer_heads_where_caps_use_them_up(spark):
    rows = [(k, f"{k:03d}", ["THRESHOLD_BAND"], "same" if k < 40 else f"p{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "id int, rank string, buckets array<string>, product string")
    got = queues.interleaved(df, "id", "rank", "buckets", {"product": 1}, 5).orderBy("queue_rank").collect()
    assert [r.id for r in got] == [0, 40, 41, 42, 43]


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    values = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 101), ("b", 2), ("c", 1))}
    df = spark.createDataFrame([(g, float(v)) for g, own in values.items() for v in own] + [("a", None), ("a", float("nan"))], "g string, v double")
    for r in metrics.percentiles(df, "g", "v", [0, 0.37, 1]).collect():
        assert [r.p0, r.p1, r.p2] == pytest.approx(np.quantile(values[r.g], [0, 0.37, 1]).tolist()) and r.n == len(values[r.g])
    assert metrics.percentiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_batches_start_the_shorter_side_again(spark):
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(3)], "a string, b string")
    others = spark.createDataFrame([(f"o{k}",) for k in range(20)], "id string")
    got = sampling.composed_batches(pairs, others, "id", 8, 1).collect()
    assert len(got) == 5 * (2 + 4) and {r.a for r in got if r.kind == "other"} == {f"o{k}" for k in range(20)}
    used = [r.a for r in got if r.kind == "pair"]
    assert sorted(used.count(f"a{k}") for k in range(3)) == [3, 3, 4]
    assert sampling.composed_batches(pairs.limit(0), others, "id", 8, 1).count() == 0


def test_paths_urls_and_outlines(spark):
    rows = [("https://h.org/a/b.PNG?x=1", "M 0 0 L 10 5.5 Z"), ("a\\b\\.hidden", "L 1 1"), ("plain", None), ("ftp://h/x", "M1,2Q3 4 5 6")]
    got = spark.createDataFrame(rows, "p string, d string").select(text.path_parts(F.col("p")).alias("x"), text.valid_url(F.col("p")).alias("ok"), text.svg_tokens(F.col("d")).alias("t")).collect()
    assert [tuple(r.x) for r in got] == [("/a", "b.PNG", "b", ".png"), ("a\\b", ".hidden", ".hidden", ""), ("", "plain", "plain", ""), ("", "x", "x", "")]
    assert [r.ok for r in got] == [True, False, False, False]
    assert [r.t for r in got] == [["M", "0", "0", "L", "10", "5.5", "Z"], None, None, ["M", "1", "2", "Q", "3", "4", "5", "6"]]


def test_policy_flags(spark):
    rows = [("永", 0.9, None, True), ("永", 0.9, None, False), ("永", 0.4, 0.5, True), ("\ue000", 0.9, None, False), ("A", 0.9, 0.1, True)]
    got = text.policy_scores(spark.createDataFrame(rows, "c string, p double, v double, k boolean"), "c", "p", "v", "k").collect()
    assert [(r.auto_block, r.needs_review) for r in got] == [(False, False), (False, True), (True, True), (True, True), (False, True)]
    assert [round(r.combined_risk, 6) for r in got] == [0.1, 0.49, 0.6, 1.0, 0.49]


def test_maps_lineage_and_types(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, v string"), spark.createDataFrame([("x", "1"), ("y", None)], "k string, v string")
    merged, bad = constraints.merged_maps([a, b], "k", "v")
    assert merged.collect() == [("x", "1")] and [(r.key, r.detail) for r in bad.collect()] == [("y", "null|1")]
    v = spark.createDataFrame([("a", None), ("b", "a"), ("c", "z")], "v string, p string")
    assert [r.v for r in progress.lineage_breaks(v, "v", "p").collect()] == ["c"]
    assert constraints.column_types(a, k="string", v="double", w="int") == ["v: string instead of double", "w: missing instead of int"]
    own = spark.createDataFrame([("q", "i", "1")], "ver string, id string, r string")
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    good = h(h(h("i\0" + "1")))
    assert constraints.self_hash(own, "ver", "id", ["id", "r"], {"q": good}).count() == 0
    assert constraints.self_hash(own, "ver", "id", ["id", "r"], {"q": good, "gone": "0"}).count() == 1


def test_unicode_order(spark):
    chars = ["永", "\ufffd", "\ue000", "\ufdd0", "\U0001fffe", "\U00020000", "A", "\uf900", "\U00031350"]
    got = [r.c for r in spark.createDataFrame([(c,) for c in chars], "x string").select(text.unicode_class(F.col("x")).alias("c")).collect()]
    assert got == ["CJK", "REPLACEMENT", "PRIVATE_USE", "NONCHARACTER", "NONCHARACTER", "CJK", "OTHER", "CJK", "CJK"]


def test_nearest_class_and_single_class(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "a", [0.9, 0.1]), (4, "b", [0.0, 0.0]), (5, "a", None)], "id int, label string, v array<double>")
    bank = vectors.class_centres(df.where("id < 3"), "label", "v")
    got = {r.id: r for r in vectors.nearest_class(df, "id", "v", bank, "label").collect()}
    assert got[3].nearest == "a" and got[3].second > got[3].distance and got[4].nearest is None and got[5].nearest is None
    one = vectors.nearest_class(df.where("id = 3"), "id", "v", bank.where("label = 'a'"), "label").first()
    assert one.second == float("inf")


def test_empty_bag_keeps_its_image(spark):
    images_ = spark.createDataFrame([("i",), ("j",)], "image_id string")
    crops = spark.createDataFrame([("i", "c", 0.2), ("i", "d", 0.9)], "image_id string, crop_id string, r double")
    got = {r.image_id: r.score for r in bags.pooled_scores(images_, crops, "image_id", "r", 0.5).collect()}
    w = [np.exp(1 / (1 + np.exp(-0.5)) * x) for x in (0.2, 0.9)]
    logit = np.log1p(np.e) * 0.5 * ((w[0] * 0.2 + w[1] * 0.9) / sum(w) + 0.9)
    assert got["i"] == pytest.approx(1 / (1 + np.exp(-logit))) and got["j"] == pytest.approx(1 / (1 + np.exp(2.0)))


def test_odd_group_pairs_with_its_first(spark):
    df = spark.createDataFrame([(k, "g") for k in range(3)] + [(9, "alone")], "id long, g string")
    rows = sampling.paired_batches(df, "id", "g", 1).orderBy("pair").collect()
    assert len(rows) == 2 and rows[1].b == rows[0].a


def test_defects_stay_in_bounds():
    img = np.zeros((32, 32), np.uint8)
    img[8:24, 12:20] = 255
    for kind in images.OPERATORS:
        out, changed, tries = images.accepted_defect(img, kind, 5)
        assert tries <= 20 and (out is None or 8 <= changed <= 0.35 * 128)
    assert images.tight_box(img) == (12, 8, 20, 24) and images.components_of(img > 0) == 1
    assert images.perceptual_hash(img) == images.perceptual_hash(img // 2 * 2)


def test_bootstrap_interval_brackets_the_estimate(spark):
    rng = random.Random(7)
    rows = [("f", k, (y := rng.random() < 0.4), rng.random() * 0.6 + 0.4 * y) for k in range(300)]
    df = spark.createDataFrame(rows, "f string, key long, label boolean, score double")
    b = metrics.bootstrap_ap(df, "f", 60).first()
    ap = metrics.ranking_areas(df).first().aucpr
    assert b.low < ap < b.high and b.rounds == 60


def test_kmeans_centres_keep_the_clusters_of_large_classes(spark):
    rng = np.random.default_rng(5)
    true = np.eye(8)
    x = true[rng.integers(0, 8, 30_000)] + rng.normal(0, 0.02, (30_000, 8))
    rows = [(k, "a", v.tolist()) for k, v in enumerate(x)] + [(-1, "few", [1.0] + [0.0] * 7), (-2, "few", [0.0, 1.0] + [0.0] * 6), (-3, None, [0.0] * 7 + [2.0]), (-4, "none", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, l string, v array<double>").repartition(5)
    got = vectors.kmeans_centres(df, "l", "v", "id").collect()
    centres = np.array([r.centre for r in got if r.l == "a"])
    assert centres.shape == (8, 8) and (centres @ true.T).max(0).min() > 0.999
    assert [np.round(r.centre, 6).tolist() for r in got if r.l == "few"] == [[0.707107, 0.707107] + [0.0] * 6]
    assert {r.l for r in got} == {"a", "few", None}


def test_phash_pairs_reach_ten_bits(spark, tmp_path):
    rows = [("a", "00000000000000ff"), ("b", "ffc00000000000ff"), ("c", "ffe00000000000ff"), ("d", "0123456789abcdef"), ("e", None)]
    spark.createDataFrame([(i, 0, "c", h, "NORMAL", "TEST") for i, h in rows], "image_id string, fold long, component_id string, phash string, image_label string, split_role string").write.parquet(f"{tmp_path}/fold_manifest.parquet")
    assert {(r.a, r.b, r.distance) for r in suite.queries()["hamming_pairs"](spark, str(tmp_path)).collect()} == {("a", "b", 10), ("b", "c", 1)}


def test_identity_graph_has_all_fields_and_near_hashes(spark, tmp_path):
    ids = [f"i{k}" for k in range(12)]
    own = {c: [f"{c}{k}" for k in range(12)] for c in suite.IDENTITY}
    for n, c in enumerate(suite.IDENTITY):
        own[c][2 * n + 1] = own[c][2 * n]  # i0 and i1 share the first field, i2 and i3 the second, ...
    codes = [int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") for i in ids]
    codes[11] = codes[10] ^ 0b1001_1111_1111 << 52  # ten bits apart, the highest among them
    spark.createDataFrame([(i, "DEVELOPMENT", "NORMAL", "s", 1, None, *[own[c][k] for c in suite.IDENTITY]) for k, i in enumerate(ids)], "image_id string, split_role string, image_label string, source_id string, batch_no int, ingested_at timestamp, " + ", ".join(f"{c} string" for c in suite.IDENTITY)).write.parquet(f"{tmp_path}/real_manifest.parquet")
    spark.createDataFrame([(i, 0, "c", f"{codes[k]:016x}", "NORMAL", "DEVELOPMENT") for k, i in enumerate(ids)], "image_id string, fold long, component_id string, phash string, image_label string, split_role string").write.parquet(f"{tmp_path}/fold_manifest.parquet")
    assert {(r.a, r.b, r.distance) for r in suite.queries()["hamming_pairs"](spark, str(tmp_path)).collect()} == {("i10", "i11", 10)}
    assert {r.component: r["size"] for r in suite.queries()["components"](spark, str(tmp_path)).collect()} == {"i0": 2, "i2": 2, "i4": 2, "i6": 2, "i8": 2, "i10": 2}
    assert sorted(r.component for r in suite.queries()["fold_assignment"](spark, str(tmp_path)).collect()) == ["i0", "i10", "i2", "i4", "i6", "i8"]


def test_queries_take_all_rows(spark, tmp_path):
    rows = [(f"s{k}", r, [0.0] * 300) for k, r in enumerate(["train", None, " Calibration", "test"])]
    spark.createDataFrame(rows, "sample_id string, split_role string, views array<float>").write.parquet(f"{tmp_path}/glyph_items.parquet")
    assert {r.sample_id for r in suite.queries()["corrupt_bitmaps"](spark, str(tmp_path)).select("sample_id").collect()} == {"s0", "s1", "s2", "s3"}
    spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [1.0, 0.1]), (2, "a", [0.0, 1.0]), (6, "b", [0.0, 1.0])], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.vec_id, r.neighbour) for r in suite.queries()["own_class_nn"](spark, str(tmp_path)).collect()] == [(0, 1)]
    assert {r.vec_id for r in suite.queries()["nearest_class"](spark, str(tmp_path)).collect()} == {0, 1, 2, 6}
    assert {r.label for r in suite.queries()["kmeans_centers"](spark, str(tmp_path)).collect()} == {"a", "b"}
