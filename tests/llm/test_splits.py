from __future__ import annotations

import random
from collections import defaultdict

from tonearm.llm import splits as sp

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_components(spark):
    for seed, n, m in ((1, 60, 40), (2, 60, 90), (3, 500, 300)):
        rng = random.Random(seed)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        pairs = [p for p in pairs if p[0] != p[1]]
        got = {r.node: r.component for r in sp.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
        assert got == _union(pairs)


def test_a_long_chain(spark):
    order = list(range(300))
    random.Random(0).shuffle(order)
    got = sp.components(spark.createDataFrame(list(zip(order, order[1:])), "u bigint, v bigint")).collect()
    assert len(got) == 300 and {r.component for r in got} == {0}
    assert sp.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_link_edges_of_a_hot_value(spark):
    rows = [(i, 7) for i in range(400)] * 2 + [(1000, None), (None, 7), (1001, 8), (1001, 9)]
    edges = sp.link_edges(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()
    assert len(edges) == 399
    assert set(_union([(e.u, e.v) for e in edges]).values()) == {0}


def _check(rows, done):
    comp = _union([(("n", a), ("v", b)) for a, b, in rows if a is not None and b is not None] + [(("n", a), ("n", a)) for a, _ in rows if a is not None])
    by = defaultdict(set)
    for (kind, x), c in comp.items():
        if kind == "n":
            by[c].add(x)
    for members in by.values():
        got = [done[x] for x in members]
        assert len({r.component for r in got}) == 1 and len({r.split for r in got}) == 1
        assert got[0].component == min(members)
    assert len({r.component for r in done.values()}) == len(by)


def test_loads_keep_fill_and_quarantine(spark):
    rng = random.Random(9)
    first = [(rng.randrange(3000), rng.choice([None, *range(15000)])) for _ in range(4000)] + [(None, 3)]
    one = {r.node: r for r in sp.load(None, spark.createDataFrame(first, "a bigint, b bigint"), "a", "b", PROPORTIONS).collect()}
    _check(first, one)
    weight = defaultdict(int)
    for r in one.values():
        weight[r.split] += r.weight
    total = sum(weight.values())
    assert total == 4000 and all(abs(weight[s] / total - p) < 0.03 for s, p in PROPORTIONS.items())
    table = sp.load(None, spark.createDataFrame(first, "a bigint, b bigint"), "a", "b", PROPORTIONS)
    assert {r.node: (r.component, r.split) for r in table.collect()} == {k: (r.component, r.split) for k, r in one.items()}
    a, b = (next(r for r in one.values() if r.split == s) for s in ("train", "test"))
    same = [r for r in one.values() if r.split == "train" and r.component not in (a.component,)][:2]
    late = [(a.node, 9001), (b.node, 9001), (same[0].node, 9002), (same[1].node, 9002), (5000, 9003), (5001, 9003), (same[0].node, 9002)]
    two = {r.node: r for r in sp.load(table, spark.createDataFrame(late, "a bigint, b bigint"), "a", "b", PROPORTIONS).collect()}
    assert two[a.node].split == two[b.node].split == sp.QUARANTINE and two[a.node].status == "conflict"
    assert two[same[0].node].component == two[same[1].node].component and two[same[0].node].split == "train"
    assert two[5000].status == "new" and two[5000].component == two[5001].component == 5000
    untouched = [k for k, r in one.items() if r.component not in {a.component, b.component, same[0].component, same[1].component}]
    assert all(two[k].split == one[k].split and two[k].status == "kept" for k in untouched)
    assert two[same[0].node].weight == one[same[0].node].weight + 2


def test_loads_in_parts_give_the_components_of_one_load(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(900), rng.choice([None, *range(700)])) for _ in range(1200)] + [(2000, 5000), (2001, 5001), (2002, 5000), (2002, 5001)]
    frame = lambda part: spark.createDataFrame(part, "a bigint, b bigint")
    done = None
    for part in (rows[:400], rows[400:1000], rows[1000:1202], rows[1202:]):
        done = sp.load_linked(done, frame(part), "a", "b", PROPORTIONS)
    got = {r.node: r for r in done.splits.collect()}
    whole = sp.load(None, frame(rows), "a", "b", PROPORTIONS).collect()
    assert {k: (r.component, r.weight) for k, r in got.items()} == {r.node: (r.component, r.weight) for r in whole}
    _check(rows, got)
    links = [(r.node, r.via) for r in done.links.collect()]
    assert set(links) <= set(rows) and sorted(v for _, v in links) == sorted({b for _, b in rows if b is not None})


def test_a_value_of_an_earlier_load_merges_and_quarantines(spark):
    first = [(i, 10000 + i) for i in range(1000)]
    one = sp.load_linked(None, spark.createDataFrame(first, "a bigint, b bigint"), "a", "b", PROPORTIONS)
    split = {r.node: r.split for r in one.splits.collect()}
    a, b = (next(k for k in sorted(split) if split[k] == s) for s in ("train", "test"))
    late = [(b, 10000 + a), (7777, 10000 + b)]
    two = sp.load_linked(one, spark.createDataFrame(late, "a bigint, b bigint"), "a", "b", PROPORTIONS)
    got = {r.node: r for r in two.splits.collect()}
    assert {got[x].component for x in (a, b, 7777)} == {min(a, b)}
    assert {(got[x].split, got[x].status) for x in (a, b, 7777)} == {(sp.QUARANTINE, "conflict")}


def test_the_incremental_query_has_the_components_of_one_load(spark, sf):
    from tonearm.llm.queries import llm

    two, one = (llm.queries[q](spark, sf) for q in ("p5_incremental", "p5_splits"))
    assert {(r.artist_no, r.component, r.n_rows) for r in two.collect()} == {(r.artist_no, r.component, r.n_rows) for r in one.collect()}


def test_a_kept_table_outlives_the_cuts(spark, tmp_path):
    from tonearm import storage

    early, late = [(1, 10), (2, 20), (3, None)], [(4, 10), (4, 20)]
    before, storage._WRITTEN[:] = list(storage._WRITTEN), []
    one = sp.load_linked(None, spark.createDataFrame(early, "a bigint, b bigint"), "a", "b", PROPORTIONS, path=f"file://{tmp_path}/1")
    storage.drop_cuts()
    assert one.splits.count() == 3 and one.links.count() == 2
    two = sp.load_linked(sp.kept(spark, f"file://{tmp_path}/1"), spark.createDataFrame(late, "a bigint, b bigint"), "a", "b", PROPORTIONS, path=f"file://{tmp_path}/2")
    storage.drop_cuts()
    storage._WRITTEN[:] = before
    assert {r.node: r.component for r in two.splits.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {(r.via, r.node) for r in sp.kept(spark, f"file://{tmp_path}/2").links.collect()} == {(10, 1), (20, 2)}


def test_p5_found_goes_through_the_incremental_table(spark, sf, monkeypatch):
    from tonearm.llm import q_splits

    calls = []
    monkeypatch.setattr(q_splits, "load_linked", lambda known, *a, **k: calls.append(known is None) or sp.load_linked(known, *a, **k))
    q_splits.p5_found(spark, sf).collect()
    assert calls == [True, False]


def test_empty_load(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert sp.load(None, df, "a", "b", PROPORTIONS).count() == 0
    some = sp.load(None, spark.createDataFrame([(1, 1), (2, None)], "a bigint, b bigint"), "a", "b", PROPORTIONS)
    assert sorted(r.node for r in sp.load(some, df, "a", "b", PROPORTIONS).collect()) == [1, 2]


def test_heavy_components_fill_the_largest_deficit(spark):
    rows = [(1, 50.0, None), (2, 30.0, None), (3, 10.0, None), (4, 10.0, None)]
    got = {r.component: r.split for r in sp.assign_splits(spark.createDataFrame(rows, "component bigint, weight double, prior array<string>"), PROPORTIONS).collect()}
    assert got == {1: "train", 2: "train", 3: "validation", 4: "test"}


def test_pairs_in_blocks(spark):
    rows = [(i, i % 3) for i in range(100)] + [(500, 9)]
    got = sorted((r.a, r.b) for r in sp.pairs_within(spark.createDataFrame(rows, "node bigint, component bigint"), 7).collect())
    assert got == sorted((a, b) for a in range(100) for b in range(a + 1, 100) if a % 3 == b % 3)


def test_hot_values_and_giant_components_change_nothing(spark):
    rng = random.Random(11)
    rows = [(i, 1) for i in range(120)] + [(rng.randrange(300), rng.randrange(2, 90)) for _ in range(260)] + [(None, 1), (5, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    want = {r.node: r.component for r in sp.components(sp.link_edges(df, "a", "b")).collect()}
    edges = sp.link_edges(df, "a", "b", floor=7)
    degree = {r.v: r["count"] for r in edges.groupBy("v").count().collect()}
    assert max(degree.values()) < 120
    assert {r.node: r.component for r in sp.components(edges, floor=7).collect()} == want
