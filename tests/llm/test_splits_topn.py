import random

import pytest

from crysmill.llm.splits import QUARANTINE, SplitTable, components, connected, material_keys, read_targets
from crysmill.llm.top_groups import top_n
from crysmill.runtime import Scratch

TARGETS = [("train", 0.8), ("test", 0.2)]


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, keys in rows:
        find(("r", i))
        for k in keys:
            parent[find(("k", k))] = find(("r", i))
    groups = {}
    for i, _ in rows:
        groups.setdefault(find(("r", i)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed,n,keys", [(1, 300, 120), (2, 300, 900), (3, 200, 15)])
def test_components_against_union_find(spark, seed, n, keys):
    rnd = random.Random(seed)
    rows = [(i * 7 % 1009, [f"k{rnd.randrange(keys)}" for _ in range(rnd.randrange(4))]) for i in range(n)]
    ids, named = components(spark.createDataFrame(rows, "id bigint, keys array<string>"), Scratch(spark, "t"))
    want = brute(rows)
    assert {r["id"]: r["root"] for r in ids.collect()} == want
    assert all(r["root"] in set(want.values()) for r in named.collect())


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[j] == 1000 for j in range(1000, 1100))


def test_material_keys_by_meaning(spark):
    rows = [
        (1, "Al2O3", "LMI000000001", "fp:00aaBBccDDee1122"), (2, " Al4 O6", "lmi-000000001", "00AA-bbcc-ddee-1122"), (3, "n/a", "TBD", "unknown"), (4, "?", "nan", "None"), (5, None, None, None), (6, "", " ", ""), (7, "?", "lmi000000000", "0000000000000000"), (8, None, "LMI-000 000 000", "fp:FFFF-FFFF-FFFF-FFFF"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "row_no bigint, formula string, immutable_id string, structure_fingerprint string, key string, root int")
    got = {r["id"]: sorted(r["keys"]) for r in material_keys(df).collect()}
    assert got[1] == got[2] and len(got[1]) == 3 and all(got[i] == [] for i in range(3, 9))


def test_rows_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, ["a"]), (5, ["a"]), (5, []), (7, ["a"]), (7, ["a"]), (9, [])], "id bigint, keys array<string>")
    ids, _ = components(df, Scratch(spark, "t"))
    assert sorted((r["id"], r["root"]) for r in ids.collect()) == [(5, 5), (7, 5), (9, 9)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, keys array<string>")


def test_incremental_keeps_fills_and_quarantines(spark, tmp_path):
    t = SplitTable(spark, str(tmp_path), TARGETS)
    first = {r["id"]: (r["component_id"], r["split"]) for r in t.add(frame(spark, [(i, [f"a{i // 2}"]) for i in range(400)])).collect()}
    assert len(first) == 400 and all(first[2 * i][1] == first[2 * i + 1][1] for i in range(200))
    share = sum(s == "test" for _, s in first.values()) / 400
    assert abs(share - 0.2) < 0.02
    a = next(i for i in range(200) if first[2 * i][1] == "train")
    b = next(i for i in range(200) if first[2 * i][1] == "test")
    c = next(i for i in range(a + 1, 200) if first[2 * i][1] == "train")
    batch = [(1000, [f"a{a}", f"a{b}"]), (1001, [f"a{c}"]), (1002, [f"a{c}", "new"])] + [(2000 + i, [f"b{i}"]) for i in range(100)]
    second = {r["id"]: r["split"] for r in t.add(frame(spark, batch)).collect()}
    assert second[1000] == QUARANTINE and second[1001] == second[1002] == "train"
    comps = {r["component_id"]: r for r in t.components().collect()}
    keys = {r["key"]: r["component_id"] for r in t.keys().collect()}
    assert keys[f"a{a}"] == keys[f"a{b}"] and comps[keys[f"a{a}"]]["split"] == QUARANTINE and sorted(comps[keys[f"a{a}"]]["was"]) == ["test", "train"]
    assert keys["new"] == keys[f"a{c}"] and len(set(second.values()) - {"train", "test", QUARANTINE}) == 0
    assert len(t.add(frame(spark, [])).collect()) == 0


def test_reopened_table_goes_on(spark, tmp_path):
    first = {r["id"]: (r["component_id"], r["split"]) for r in SplitTable(spark, str(tmp_path), TARGETS).add(frame(spark, [(i, [f"k{i // 2}"]) for i in range(200)])).collect()}
    again = SplitTable(spark, str(tmp_path), TARGETS)
    assert again.version == 1
    train = next(i for i in range(0, 200, 2) if first[i][1] == "train")
    test = next(i for i in range(0, 200, 2) if first[i][1] == "test")
    second = {r["id"]: (r["component_id"], r["split"]) for r in again.add(frame(spark, [(500, [f"k{train // 2}"]), (501, ["fresh"])])).collect()}
    assert second[500] == first[train] and second[501][0] == 501
    third = SplitTable(spark, str(tmp_path), TARGETS)
    assert third.version == 2
    assert {r["split"] for r in third.add(frame(spark, [(600, [f"k{train // 2}", f"k{test // 2}"])])).collect()} == {QUARANTINE}
    fourth = SplitTable(spark, str(tmp_path), TARGETS)
    now = {r["id"]: (r["component_id"], r["split"], r["batch"]) for r in fourth.present().collect()}
    assert len(now) == 203 and {now[i][:2] for i in (train, train + 1, test, test + 1, 500, 600)} == {(min(train, test), QUARANTINE)}
    assert all(now[i][:2] == first[i] for i in range(200) if i not in (train, train + 1, test, test + 1))
    # a merge of a component that is quarantined stays so, and pointers are followed at once
    assert {r["split"] for r in fourth.add(frame(spark, [(700, [f"k{test // 2}", "fresh"])])).collect()} == {QUARANTINE}
    assert {r["split"] for r in fourth.present().where("id IN (501, 600, 700)").collect()} == {QUARANTINE}


def test_early_rows_get_their_present_split(spark, tmp_path):
    from datetime import datetime

    from crysmill.llm.queries import p1_incremental

    early = [(i, f"fp:{i * 7919 + 4096:016x}", f"lmi-{i + 10:09d}", None, datetime(2024, 1, 1)) for i in range(40)]
    late = [(100 + i, early[i][1], early[i + 1][2], None, datetime(2024, 1, 2)) for i in range(20)]
    rows = early + late + [(500, None, None, None, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "row_no bigint, structure_fingerprint string, immutable_id string, formula string, ingested_at timestamp").write.parquet(f"{tmp_path}/lemat_bulk_sample.parquet")
    spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double").write.parquet(f"{tmp_path}/split_targets.parquet")
    out = {r["row_no"]: (r["split"], r["batch"]) for r in p1_incremental(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and {b for i, (_, b) in out.items() if i < 100} == {1}
    # one late row after the other ties the first 21 early rows, of both splits
    assert {out[i] for i in range(21)} == {(QUARANTINE, 1)} and {out[100 + i] for i in range(20)} == {(QUARANTINE, 2)}
    assert {out[i][0] for i in range(21, 40)} | {out[500][0]} <= {"train", "test"}


def test_hot_component_and_empty_start(spark, tmp_path):
    t = SplitTable(spark, str(tmp_path), TARGETS)
    assert t.add(frame(spark, [])).count() == 0
    got = t.add(frame(spark, [(i, ["hot"] if i % 3 == 0 else [f"x{i}"]) for i in range(900)])).groupBy("split").count().collect()
    shares = {r["split"]: r["count"] / 900 for r in got}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.2) < 0.02


def test_targets(spark, tmp_path):
    with pytest.raises(ValueError):
        SplitTable(spark, str(tmp_path), [("a", 0.5)])
    assert read_targets(spark.createDataFrame([("a", 2.0), ("b", 2.0), (None, 1.0), ("c", 0.0)], "split_name string, target_share double")) == [("a", 0.5), ("b", 0.5)]


def brute_top(rows, n):
    out = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or s != s:
            continue
        out.setdefault(g, []).append((-s, t is None or t != t, t if t is not None and t == t else 0.0, i))
    return {(g, i[3], k + 1) for g, v in out.items() for k, i in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n_against_sort(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["a", "b", "c", "hot", "hot", "hot", None]), f"i{k:05d}" if k % 50 else None, rnd.choice([0.5, 0.25, float("nan"), None, rnd.random()]), rnd.choice([None, float("nan"), 0.1, 0.2])) for k in range(6000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "gg string, item string, score double, tie double, g string, place int").repartition(7)
    got = top_n(df, "gg", "score", "item", n, ("tie",)).collect()
    assert {(r["gg"], r["item"], r["place"]) for r in got} == brute_top(rows, n) and len(got) == len(brute_top(rows, n))


def test_hot_group_over_many_partitions(spark):
    df = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 500) END AS g1", "id % 100 / 10 AS s", "lpad(id, 8, '0') AS i")
    got = top_n(df.repartition(16), "g1", "s", "i", 50).where("g1 = 'hot'").orderBy("place").collect()
    want = sorted((-(k % 100) / 10, f"{k:08d}") for k in range(0, 40_000, 3))[:50]
    assert [(r["place"], r["i"]) for r in got] == [(k + 1, w[1]) for k, w in enumerate(want)]


def test_top_n_empty_and_bad_n(spark):
    df = spark.createDataFrame([], "g string, s double, i string")
    assert top_n(df, "g", "s", "i", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", "s", "i", 0)
