import os
import random

import pytest
from pyspark.sql import functions as F

from plumbago.llm import capping, ledger, queries, splits
from plumbago.llm.keys import canon, canon_hash
from plumbago.session import written
from tests.util import connect, same

FOLDER = "/root/testdata/sf0.001"
ROWS = "sample_id string, batch_no int, key string, delivery string"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, "x", "y") for i, b in rows], ROWS)


def chosen(df):
    return {r.key for r in df.where("chosen").collect()}


def test_keys_without_meaningless_marks():
    assert canon(" Ｓtyle_0－1\n") == canon("STYLE-01") == "style01"
    assert canon("惡︀") == canon("惡") == "惡" and canon(" \t") is None and canon(None) is None
    assert canon_hash(" SHA256:AB ") == canon_hash("ab") == "ab"


def test_ledger_is_kept_under_its_path(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert ledger.load(spark, path) is None
    df = frame(spark, [(f"s{k}", 1 + k % 2) for k in range(200)])
    first = ledger.store(ledger.advance(ledger.load(spark, path), df.where("batch_no = 1"), "sample_id", "batch_no", 0.1), path)
    second = ledger.store(ledger.advance(ledger.load(spark, path), df, "sample_id", "batch_no", 0.1), path)
    assert chosen(first) <= chosen(second) == chosen(ledger.load(spark, path)) and len(chosen(second)) == 20
    (tmp_path / "ledger" / "v00000009").mkdir()  # a version that was never finished
    assert ledger.load(spark, path).count() == 200


def test_sample_is_nested_exact_and_independent_of_layout(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(900)}", rng.randrange(1, 6)) for _ in range(1500)] + [(None, 1), ("S1 ", 2), ("s1", None)]
    df = frame(spark, rows)
    whole = ledger.advance(None, df, "sample_id", "batch_no", 0.2).cache()
    again = ledger.advance(None, df.repartition(7).orderBy("sample_id"), "sample_id", "batch_no", 0.2)
    assert chosen(whole) == chosen(again)
    keys = whole.count()
    assert len(chosen(whole)) == round(keys * 0.2)
    state, before = None, set()
    for k in range(1, 6):
        part = df.where((F.col("batch_no") == k) | (F.col("batch_no").isNull() & F.lit(k == 5)))
        state = written(ledger.advance(state, part, "sample_id", "batch_no", 0.2), "ledger")
        now = chosen(state)
        assert before <= now
        before = now
    assert before == chosen(whole)
    picked = ledger.sampled(df, whole, "sample_id")
    assert picked.columns == df.columns and {canon(r.sample_id) for r in picked.collect()} == chosen(whole)


def test_sample_of_nothing(spark):
    assert ledger.advance(None, frame(spark, []), "sample_id", "batch_no", 0.5).count() == 0
    one = ledger.advance(None, frame(spark, [("a", None)]), "sample_id", "batch_no", 1.0)
    assert chosen(one) == {"a"} and ledger.advance(one, frame(spark, []), "sample_id", "batch_no", 1.0).count() == 1


def test_related_records_share_a_split(spark):
    pairs = [("i1", "a"), ("i1", "b"), ("i2", "b"), ("i3", "c"), ("i4", None), ("i1", "a"), (None, "a"), ("i5", "c")]
    got = splits.assign_splits(spark.createDataFrame(pairs, "record string, grp string")).collect()
    comp = {r.record: r.component for r in got}
    assert comp["i1"] == comp["i2"] != comp["i3"] == comp["i5"] and comp["i4"] == "r:i4"
    assert len({(r.record, r.split) for r in got}) == 5
    assert splits.assign_splits(spark.createDataFrame([], "record string, grp string")).count() == 0


def test_split_shares_and_minimal_moves(spark):
    ids = spark.range(8000).select(F.col("id").cast("string").alias("c"))
    one = {r.c: r.s for r in ids.select("c", splits.rendezvous(F.col("c"), {"train": 0.8, "test": 0.2}).alias("s")).collect()}
    two = {r.c: r.s for r in ids.select("c", splits.rendezvous(F.col("c"), {"train": 0.8, "test": 0.3}).alias("s")).collect()}
    assert abs(sum(s == "train" for s in one.values()) / 8000 - 0.8) < 0.02
    assert not [c for c in one if one[c] == "test" and two[c] == "train"]
    with pytest.raises(ValueError):
        splits.rendezvous(F.col("c"), {})


def test_role_conflicts_are_by_group_not_component(spark):
    rows = [("i1", "a", "held"), ("i2", "a", "dev"), ("i1", "b", None), ("i3", "b", "dev"), ("i4", None, "held"), ("i5", "c", "held")]
    df = spark.createDataFrame(rows, "record string, grp string, role string")
    assigned = splits.assign_splits(df.select("record", "grp"))
    assert {r.record for r in splits.role_conflicts(df, assigned, "held").collect()} == {"i1", "i2"}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_cap_against_sorting(spark, limit):
    rng = random.Random(3)
    rec = [(f"i{k:03d}", "hot" if k % 3 == 0 else rng.choice(["b", "c", None])) for k in range(300)] + [("i000", "b"), ("i003", "hot")]
    sc = [(f"i{rng.randrange(300):03d}", rng.choice([0.1, 0.2, 0.2, None, float("nan"), 1.5, -1.0])) for _ in range(400)]
    pairs, scores = spark.createDataFrame(rec, "record string, contributor string"), spark.createDataFrame(sc, "record string, score double")
    got = {(r.record, r.contributor) for r in capping.over_cap(pairs, scores, share=0.1, heap_limit=limit).collect()}
    peak = {}
    for i, s in sc:
        if s is not None and 0 <= s <= 1:
            peak[i] = max(peak.get(i, 0), s)
    cap, want = 30, set()
    for c in ("hot", "b", "c"):
        own = sorted({i for i, x in rec if x == c}, key=lambda i: (i not in peak, peak.get(i, 0), i))
        want |= {(i, c) for i in own[cap:]}
    assert got == want and got


def test_cap_of_nothing(spark):
    e, s = spark.createDataFrame([], "record string, contributor string"), spark.createDataFrame([], "record string, score double")
    assert capping.over_cap(e, s, share=0.02).count() == 0
    one = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "record string, contributor string")
    assert capping.over_cap(one, s, share=0.02).count() == 0
    with pytest.raises(ValueError):
        capping.over_cap(one, s)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
