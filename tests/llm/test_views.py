import itertools

import numpy as np
import pyarrow as pa
import pytest

from plumbago.llm import clusters, codes, overlaps, queries

SCHEMA = "sample_id string, split_role string, pixel_sha256 string, views array<float>, source_group_id string, source_asset_ids array<string>, gid string, gray int, code int"


def view(v):
    return None if v is None else [float(x) / 255 for x in v] + [0.0] * 200


def fixture(spark, seed=0, groups=30, extra=()):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.integers(20, 235, 100)
        for m in range(int(rng.integers(1, 9))):
            v = np.clip(base + rng.integers(-20, 21, 100), 0, 255)
            rows.append([f"s{g:02d}{m}", ["train", "test", "calibration"][m % 3], None, v])
            if m % 3 == 1:  # a near copy in another split, few or many pixels changed
                w = v.copy()
                w[: (3 if g % 2 else 100)] = np.clip(w[: (3 if g % 2 else 100)] + (80 if g % 2 else 2), 0, 255)
                rows.append([f"n{g:02d}{m}", "train", None, w])
    rows += [list(r) for r in extra]
    df = spark.createDataFrame([(i, r, h, view(v), "grp", ["a", "b"], "x", 1, 2) for i, r, h, v in rows], SCHEMA)
    return df, rows


def near(a, b, limit):
    return np.abs(a.astype(float) - b).sum() / 25500 <= limit + 1e-9


EXTRA = [
    ("H1", "Train", "SHA256:AB", None), ("h2 ", "test", "ab", None), ("both", "train", None, np.full(100, 7)), ("both", "calibration", None, np.full(100, 7)),
    ("flat1", "train", None, np.full(100, 128)), ("flat2", "test", None, np.full(100, 128) + np.arange(100) % 2 * 9), ("none", None, "ab", np.full(100, 128)),
]


def test_overlaps_against_all_pairs(spark):
    df, rows = fixture(spark, extra=EXTRA)
    got = {(r.train_id, r.eval_id) for r in overlaps.cross_split_pairs(df).collect()}
    want = {("h1", "h2"), ("both", "both")}
    for (i, r, _, v), (j, q, _, w) in itertools.product(rows, rows):
        if r == "train" and q in ("test", "calibration") and v is not None and w is not None and near(v, w, 0.02):
            want.add((i, j))
    assert got == want and len(got) > 10


def test_recall_bound_does_not_fall_with_wider_keys():
    def missed(width, h):
        return (1 - (1 - h / 100) ** width) ** len(codes.segments(overlaps.tables_for(width), width))

    assert overlaps.tables_for(14) == 10
    for width in range(14, 31):
        assert all(missed(width, h) <= missed(14, h) * (1 + 1e-6) for h in range(1, 8))


def test_hot_buckets_are_salted_without_loss(spark):
    df, _ = fixture(spark, 1)
    plain = {(r.train_id, r.eval_id) for r in overlaps.cross_split_pairs(df).collect()}
    assert {(r.train_id, r.eval_id) for r in overlaps.cross_split_pairs(df, hot=4).collect()} == plain


def test_report_counts_every_pair_once(spark):
    df, rows = fixture(spark, extra=[*EXTRA, *[(f"copy{k}", "train" if k % 2 else "test", f"{k % 3:02d}", np.full(100, 60)) for k in range(9)], ("copy1", "train", "00", np.full(100, 61))])
    pairs = {(r.train_id, r.eval_id) for r in overlaps.cross_split_pairs(df).collect()}
    assert ("copy1", "copy6") in pairs
    role_of = {i: r for i, r, _, _ in rows if r in ("test", "calibration")}
    want = {}
    for role in ("test", "calibration"):
        own = [p for p in pairs if role_of.get(p[1].upper() if p[1] in ("h1",) else p[1], "test") == role]
        want[role] = (len(own), len({p[1] for p in own}))
    got = {(r.role, r.asset): (r.n_pairs, r.n_records) for r in overlaps.overlap_report(df).collect()}
    assert got == {(role, a): n for role, n in want.items() for a in ("a", "b") if n[0]}


def components(rows, limit):
    ids = [(i, v) for i, _, _, v in rows if v is not None]
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if near(ids[a][1], ids[b][1], limit):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    out = {}
    for k, (i, _) in enumerate(ids):
        out.setdefault(find(k), set()).add(i)
    return {(min(s), i) for s in out.values() if len(s) > 1 for i in s}


def test_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(60, 190, 100)
    chain = [(f"c{k}", "train", None, base + np.where(np.arange(100) < 10 * k, 40, 0)) for k in range(8)]  # ends far apart
    df, rows = fixture(spark, 2, extra=[*chain, ("copy", "test", None, chain[0][3]), ("null", "test", None, None)])
    got = {(r.cluster_id, r.sample_id) for r in clusters.glyph_clusters(df).collect()}
    assert got == components(rows, 0.08)


@pytest.mark.parametrize("count", [184, 204, 304])
def test_chains_of_low_contrast_views_stay_whole(spark, count):
    rng = np.random.default_rng(count)
    rows = []
    for k in range(count):
        v = np.full(100, 60 + 20 * (k % 4)) - rng.integers(0, 2, 100) * (k % 3 == 0)  # four levels, neighbours within the limit
        rows.append((f"f{k:03d}", "train", None, v))
    df, _ = fixture(spark, groups=0, extra=rows)
    got = {(r.cluster_id, r.sample_id) for r in clusters.glyph_clusters(df).collect()}
    assert got == components(rows, 0.08) and len({c for c, _ in got}) == 1


def test_leaves_keep_their_cover_and_lose_no_link_inside_a_bucket():
    rng = np.random.default_rng(4)
    base = rng.integers(40, 200, (6, 100))
    q = np.concatenate([np.clip(b + rng.integers(-22, 23, (220, 100)), 0, 255) for b in base]).astype(np.uint8)[rng.permutation(1320)]
    owner, radius, links = clusters.contracted(q, np.zeros(len(q)), np.array([0]), 0.08)
    while (owner[owner] != owner).any():
        owner = owner[owner]
    d = codes.distance(q, np.arange(len(q)), owner)
    assert (d <= radius[owner] + 1e-9).all() and (radius <= clusters.COVER * 0.08 + 1e-9).all()
    left = len(set(owner.tolist()))
    assert left < len(q) / 2
    i = np.r_[np.arange(len(q)), *[a for a, _ in links]]
    j = np.r_[owner, *[b for _, b in links]]
    every = [(a, b) for a, b, x in clusters._all_pairs(q, np.array([0])) for a, b in zip(a[x <= 0.08], b[x <= 0.08], strict=True)]
    whole = clusters.local_labels(len(q), *np.array(every).T)
    assert len(set(clusters.local_labels(len(q), i, j).tolist())) == len(set(whole.tolist())) == 6


def test_members_are_tested_where_leaders_are_apart():
    line = np.stack([np.full(100, 100) + np.where(np.arange(100) < k, 100, 0) for k in (0, 12, 60)]).astype(np.uint8)
    label, i, j = clusters._near_pairs(line[[0, 2]], np.array([0]), np.array([0.05, 0.0]), 0.2)
    assert label.tolist() == [0, 1] and (i.tolist(), j.tolist()) == ([0], [1])


def test_groups_have_size_and_typical_members(spark):
    df, rows = fixture(spark, 3)
    sizes = {}
    for c, _ in components(rows, 0.08):
        sizes[c] = sizes.get(c, 0) + 1
    got = {r.cluster_id: r for r in clusters.glyph_groups(df).collect()}
    assert {c: r.size for c, r in got.items()} == sizes and all(1 <= len(r.typical) <= 3 for r in got.values())


def test_empty_tables(spark):
    df, _ = fixture(spark)
    assert overlaps.cross_split_pairs(df.limit(0)).count() == 0
    assert clusters.glyph_clusters(df.limit(0)).count() == 0
    assert clusters.glyph_groups(df.limit(0)).count() == 0


def test_odd_views_are_kept_exactly():
    nan = float("nan")
    v = pa.array([[0.5] * 100, None, [0.1] * 99, [nan] + [0.1] * 99, [0.123456] * 120, [None] + [0.2] * 99], pa.list_(pa.float32()))
    got = codes.encode_views(v)
    assert [None if g is None else len(g) for g in got] == [400, None, None, None, 400, None]
    q = codes.matrix([bytes([10] * 100), got[4]])
    assert codes.distance(q, np.array([0]), np.array([1]))[0] == pytest.approx(abs(10 / 255 - 0.123456), abs=1e-6)


def test_ward_and_leaves():
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.05, (200, 2)) for c in (0, 3, 9)])
    n, ls, ss = clusters.leaves_of(x, 32)
    assert len(n) <= 32 and n.sum() == 600 and np.allclose(ls.sum(0), x.sum(0))
    assert (ss / n - ((ls / n[:, None]) ** 2).sum(1)).max() < 0.1  # leaves are tight
    label = clusters.ward(n, ls, 3)
    assert sorted(int(n[label == k].sum()) for k in range(3)) == [200, 200, 200]


def test_crop_groups(spark):
    rows = [(f"c{k}", "Style-1 " if k % 2 else "style_1", 0.1 if k < 10 else 0.9, 0.2) for k in range(20)] + [("x", None, 0.1, 0.1), ("y", "style-1", None, 0.1), ("z", "s2", float("nan"), 0.1), ("c1", "style-1", 0.1, 0.2)]
    df = spark.createDataFrame(rows, "crop_id string, style_id string, risk_score double, disagreement double")
    got = clusters.crop_groups(df, k=2).collect()
    assert sorted(r.size for r in got) == [10, 10] and {r.style_id for r in got} == {"style1"}
    assert clusters.crop_groups(df.limit(0)).count() == 0


def test_crop_groups_of_all_crops(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(f"c{k}", "Style-1 " if k % 2 else "style_1", 0.1 if k < 10 else 0.9, 0.2) for k in range(20)]
    rows += [("x", None, 0.1, 0.1), ("y", "style-1", None, 0.1), ("z", "s2", nan, nan), ("v", "style_1", 0.2, None), ("w", "style 1", 0.2, inf)]
    rows += [("C-1", "style1", 0.9, 0.9), ("c2", None, 0.1, None), ("c3", "style1", 0.1, None)]  # queued again
    spark.createDataFrame(rows, "crop_id string, style_id string, risk_score double, disagreement double").write.parquet(f"{tmp_path}/review_candidates.parquet")
    got = queries.queries()["p5_crop_groups"](spark, str(tmp_path)).collect()
    assert sum(r["size"] for r in got) == 25
    style = {}
    for r in got:
        style[r.style_id] = style.get(r.style_id, 0) + r["size"]
    assert style == {"style1": 23, "s2": 1, None: 1}
    assert {(r.style_id, r.part // 4, tuple(sorted(r.typical))) for r in got if r.part >= 4} == {("style1", 1, ("y",)), ("style1", 2, ("v", "w")), ("s2", 3, ("z",))}
