import json

import numpy as np
import pytest

from plumbago.__main__ import main
from plumbago.operators import views
from plumbago.sources import archives


def ring(n=32):
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    r = np.hypot(x, y)
    return np.where((r > 6) & (r < 10), 0.0, 1.0)


def test_moves_keep_the_ink():
    image = ring()
    assert np.allclose(views.warped(image, views.Affine()), image)
    assert np.allclose(views.warped(image, views.Affine(dx=2))[:, 2:], image[:, :-2])
    assert np.allclose(views.warped(image, views.Affine(angle=90)), image, atol=1e-9)
    out, tries, outcome = views.augmented(image, 5)
    assert outcome == "moved" and tries >= 1 and views.euler_number(out < 0.5) == 0 and not np.array_equal(out, image)
    assert np.array_equal(out, views.augmented(image, 5)[0])
    assert views.augmented(np.zeros((8, 8)), 1)[2] in ("moved", "kept")
    assert 0.5 < (views.appearance(image, 3) < 0.5).sum() / (image < 0.5).sum() <= 1.05


def test_topology():
    assert views.euler_number(ring() < 0.5) == 0
    two = np.zeros((5, 5), bool)
    two[0, 0] = two[1, 1] = two[4, 4] = True
    assert views.euler_number(two) == 2 and views.euler_number(np.zeros((3, 3), bool)) == 0


def test_resize_edges_and_views():
    image = ring()
    assert np.isclose(views.area_resized(image, 8).mean(), image.mean()) and np.allclose(views.area_resized(image, 32), image)
    assert not views.edges(np.full((9, 9), 0.3)).any()
    line = views.edges(np.repeat([[0.0] * 8 + [1.0] * 8], 16, 0))
    assert line.any(0).sum() == 1 and line.sum() == 16
    assert views.three_views(image, 24).shape == (3, 24, 24)


def test_photometry_crops_and_visibility():
    image = ring()
    out = views.photometric(image, 9)
    assert out.min() >= 0 and out.max() <= 1 and np.array_equal(out, views.photometric(image, 9))
    assert views.cropped(image, (-3, 4, 5, 99)).shape == (28, 5) and views.cropped(image, (90, 0, 99, 9)).size == 0
    same = views.visibility(image, image)
    assert set(same.values()) == {0.0}
    gone = image.copy()
    gone[:16] = 1
    told = views.visibility(image, gone)
    assert told["ink_changed"] == pytest.approx(0.5) and told["largest_body"] == pytest.approx(0.5) and told["changed"] > 0


def test_rows_are_mapped_by_key(spark):
    rows = [("a", [0.0] * 100), ("b", None), ("c", [0.5] * 3), ("d", [float("nan")] * 100), ("e", [1.0] * 120)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = views.mapped(df, "id", "v", 10, lambda x, seed: {"m": float(x.mean()), "s": seed % 97}, "m double, s int")
    assert {(r.id, r.m) for r in got.collect()} == {("a", 0.0), ("e", 1.0)} and got.collect() == got.repartition(3).orderBy("id").collect()
    assert views.mapped(df.limit(0), "id", "v", 10, lambda x, seed: {"m": 0.0}, "m double").count() == 0


def test_archives_outlines_and_footers(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.arange(6).reshape(2, 3), b=np.array([True]))
    got = {r["name"]: (r["shape"], r["values"]) for r in archives.npz_arrays(spark, str(tmp_path)).collect()}
    assert got == {"a": ([2, 3], [0, 1, 2, 3, 4, 5]), "b": ([1], [1.0])}
    good = {"character": "一", "strokes": ["M 0 0 L 5 5 Z"], "medians": [[[0, 0], [5, 5]]]}
    lines = [good, good | {"character": "二", "strokes": ["nope"]}, good | {"character": "三", "medians": []}, good, good | {"character": "四"}]
    (tmp_path / "o.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    kept, bad = archives.stroke_outlines(spark, str(tmp_path / "o.jsonl"), spark.createDataFrame([("一",), ("五",)], "char string"))
    assert {r.character for r in kept.collect()} == {"一"}
    assert sorted(r.error for r in bad.collect()) == sorted(["strokes", "medians", "duplicate key", "malformed", "missing 五"])
    spark.range(7).write.parquet(str(tmp_path / "t.parquet"))
    assert archives.footer(spark, str(tmp_path / "t.parquet")) == (["id"], 7)


def test_reports_and_command_line(spark, tmp_path, capsys):
    path = f"{tmp_path}/r"
    as_json, as_text = archives.report({"one": spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, n int")}, path, "T")
    assert json.loads((tmp_path / "r.json").read_text()) == json.loads(as_json) and "| a\\|b | 0.5 |  |" in (tmp_path / "r.md").read_text() == as_text
    with pytest.raises(ValueError):
        archives.report({"x": spark.range(5)}, path + "2", "T", most_rows=4)
    assert main(["list"]) == 0 and "threshold_sweep" in capsys.readouterr().out
    assert main(["show", "nothing", "--data", "x"]) == 2
