import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanspark.llm import packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.sets(st.integers(1, 40), min_size=1, max_size=3))
def test_best_fit(sizes, capacities):
    sizes = np.array(sizes, np.int64)
    capacities = sorted(capacities)
    item, number, count, place, final = packing.best_fit(sizes, capacities)
    assert np.bincount(item, weights=count, minlength=len(sizes)).tolist() == sizes.tolist()
    used = np.bincount(place, weights=count, minlength=len(final)) if len(place) else np.empty(0)
    assert (used <= final).all() and set(final.tolist()) <= set(capacities)
    top = capacities[-1]
    assert all((item == i).sum() == max(1, -(-s // top)) for i, s in enumerate(sizes))
    for u, c in zip(used, final):
        assert c == min(x for x in capacities if x >= u)
    for i in range(len(sizes)):
        assert sorted(number[item == i].tolist()) == list(range((item == i).sum()))
    if len(capacities) == 1 and sizes.sum():
        # best fit never leaves two containers whose contents fit into one
        small = np.sort(used[used > 0])
        assert len(small) < 2 or small[0] + small[1] > top


def test_pack(spark):
    rows = [(i, 7 if i % 3 else 3) for i in range(1, 500)] + [(1000, None), (1001, -5), (1002, 95), (1003, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "'x' AS g", "2 AS s")
    got = packing.pack(df, {"a": [10], "b": [5, 10]}, group=100).toPandas()
    for name in "ab":
        p = got[got.packing == name]
        want = {i: max(0, n or 0) for i, n in rows}
        assert p.groupby("doc_id").n_tokens.sum().to_dict() == want
        assert (p.groupby("container_no").n_tokens.sum() <= p.groupby("container_no").container_size.first()).all()
        assert (p[p.doc_id != 1002].groupby("doc_id").size() == 1).all()
    assert packing.pack(df.limit(0), {"a": [10]}).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x " * 500)], "doc_id long, text string")
    windows = spark.createDataFrame([("w", 64), ("w2", 128), (None, None), ("bad", 0)], "window_name string, capacity int")
    got = packing.pack_documents(docs, windows).toPandas()
    assert set(got.packing) == {"w", "w2", "joint"} and (got.groupby("packing").doc_id.nunique() == 4).all()
    assert packing.pack_documents(docs, windows.limit(0)).count() == 0


def test_capacity_is_chosen_by_what_is_left():
    # two items of 60 fill 120; a third leaves nothing for more than 64
    assert packing._least_cost(60, [64, 120], [60, 60], 2) == 120
    assert packing._least_cost(60, [64, 120], [50], 1) == 64
    assert packing._least_cost(60, [64, 120], [], 0) == 120 and packing._filled(100, [0, 30, 30, 45], 4) == 75
    sizes = np.random.default_rng(3).lognormal(6, 1, 20_000).astype(np.int64)
    capacities = [2048, 4096, 8192, 32768]
    _, _, count, place, final = packing.best_fit(sizes, capacities)
    assert final.sum() <= 1.002 * sizes.sum()
    some = np.array([1500, 1400, 1300, 700, 600] * 40)
    _, _, count, place, final = packing.best_fit(some, [2000, 2048, 5000])
    assert len(set(final.tolist())) > 1 and final.sum() <= min(packing.best_fit(some, [c])[4].sum() for c in (2000, 2048, 5000))


def test_names_of_windows(spark):
    windows = spark.createDataFrame([("a", 10), ("a", 20), ("joint", 5), (None, 7)], "window_name string, capacity int")
    assert packing.window_packings(windows) == {"joint:5": [5], "window": [7], "a:10": [10], "a:20": [20], "joint": [5, 7, 10, 20]}


def test_checks_find_faults(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string")
    windows = spark.createDataFrame([("w", 16), ("v", 64)], "window_name string, capacity int")
    rows = {r.packing: tuple(r)[1:] for r in packing.packing_checks(docs, windows).collect()}
    assert rows == {k: (40, 0, 0, True) for k in ("w", "v", "joint")}
    real = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a: real(*a).withColumn("container_size", F.lit(1)).withColumn("n_tokens", F.expr("if(doc_id = 7, 0, n_tokens)")))
    rows = {r.packing: r for r in packing.packing_checks(docs, windows).collect()}
    assert rows["v"].wrong_documents == 1 and rows["v"].overfull > 0
    monkeypatch.setattr(packing, "pack_documents", lambda *a: real(*a).withColumn("container_size", F.lit(10_000)))
    assert not any(r.near_bound for r in packing.packing_checks(docs, windows).collect())


@pytest.mark.parametrize("capacities", [[256], [256, 512, 2048, 4096]])
def test_hardly_any_room_is_left(capacities):
    sizes = np.random.default_rng(1).integers(1, 250, 20_000)
    _, _, count, place, final = packing.best_fit(sizes, capacities)
    assert final.sum() <= 1.01 * sizes.sum()
