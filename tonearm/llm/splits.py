"""Splits that keep related records together.

Records that share an entity, also by way of others, form a component and get one split. Components live in a persisted
table (node, component), beside a table (via, node) of a node of every linking value seen. A new load is mapped onto them,
only its links, among them those to nodes of earlier loads, are contracted, by hooking every component to its smallest
neighbour and pointer jumping, and the table is relabelled. Components that had a split keep it, new ones fill the deficits
of the splits, and a merge of components with different splits is quarantined. The tables grow with the data, so they are
joined by shuffles; only hot keys and heavy components, whose numbers are bounded, are broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions.scalar import shuffled
from tonearm.operators.skew import HOT_ROWS, hot_keys, join_unique
from tonearm.storage import cut

QUARANTINE = "quarantine"


def link_edges(df: DataFrame, node: str, via: str, floor: int = HOT_ROWS) -> DataFrame:
    """Edges (u, v), u <> v, that connect all nodes sharing a value of via: a star, or, for a hot value, a star for each of as
    many salts as its measured number of nodes needs, and a star of the salts' centres. Linear in the distinct (node, via);
    rows with a null in either column make no edge.
    """
    seen = df.select(F.col(node).alias("u"), F.col(via).alias("__via")).where("u is not null and __via is not null").distinct()
    seen = cut(seen, "seen")
    if (total := seen.count()) > floor:
        hot = hot_keys(seen, ["__via"], total, floor).select("__via", F.ceil(F.col("__rows") / F.col("__bound")).alias("__n"))
        seen = seen.join(F.broadcast(hot), "__via", "left")
        seen = seen.select("u", "__via", F.pmod(F.xxhash64("u"), F.coalesce("__n", F.lit(1))).alias("__salt"))
    else:
        seen = seen.withColumn("__salt", F.lit(0).cast("bigint"))
    centres = seen.groupBy("__via", "__salt").agg(F.min("u").alias("v"), F.max("u").alias("__last"))
    spokes = seen.join(centres.where("v <> __last").hint("merge"), ["__via", "__salt"]).where("u <> v").select("u", "v")
    hubs = centres.groupBy("__via").agg(F.min("v").alias("__hub"), F.max("v").alias("__last")).where("__hub <> __last")
    rim = centres.select("__via", F.col("v").alias("u")).join(hubs.hint("merge"), "__via").where("u <> __hub")
    return spokes.union(rim.select("u", F.col("__hub").alias("v"))).distinct()


def components(edges: DataFrame, floor: int = HOT_ROWS) -> DataFrame:
    """(node, component) of every node on an edge (u, v); a component's id is its smallest node. No edges: no rows.

    Roots to which more than floor nodes point, and more than a thousandth of all, are looked up by broadcast, so that a giant
    component is no task of its own. Each round every node points to its smallest neighbour, pointers jump until all point to roots, and edges are
    contracted to the roots; at least every second node is contracted a round, so the rounds are few.
    """
    left = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    first = True
    while first or not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        point = cut(point.withColumn("root", F.least("node", "root")), "pointers")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            jumped = join_unique(point, up, "root", "inner", floor)
            jumped = jumped.select("node", F.col("__up").alias("root"), (F.col("__up") < F.col("root")).alias("moved"))
            jumped = cut(jumped, "pointers")
            point = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if first:
            labels, first = point.select("node", F.col("root").alias("component")), False
        else:
            up = point.select(F.col("node").alias("component"), F.col("root").alias("__up"))
            labels = join_unique(labels, up, "component", "left", floor)
            labels = cut(labels.select("node", F.coalesce("__up", "component").alias("component")), "labels")
        a = point.select(F.col("node").alias("u"), F.col("root").alias("__a"))
        b = point.select(F.col("node").alias("v"), F.col("root").alias("__b"))
        one = join_unique(left, a, "u", "inner", floor).select("v", "__a")
        one = cut(one, "edges") if left.count() > floor else one
        left = join_unique(one, b, "v", "inner", floor).select(F.col("__a").alias("u"), F.col("__b").alias("v"))
        left = cut(left.where("u <> v").distinct(), "edges")
    return labels


def update_components(known: DataFrame | None, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The component table (node, component, old_component) after a load with nodes (node) and edges (u, v).

    known: the table before, or None. old_component is null for nodes that are new. Only components touched by an edge of
    the load are relabelled. Null nodes are ignored, repeated ones count once.
    """
    nodes = nodes.select("node").where("node is not null").distinct()
    if known is None:
        old = nodes.select("node", F.col("node").alias("component"), F.lit(None).cast("bigint").alias("old_component"))
        contracted = edges
    else:
        known = known.select("node", "component")
        old = known.withColumn("old_component", F.col("component"))
        fresh = nodes.join(known.hint("merge"), "node", "left_anti")
        old = old.unionByName(fresh.select("node", F.col("node").alias("component"), F.lit(None).cast("bigint").alias("old_component")))
        ku = known.select(F.col("node").alias("u"), F.col("component").alias("__cu"))
        kv = known.select(F.col("node").alias("v"), F.col("component").alias("__cv"))
        contracted = edges.join(ku.hint("merge"), "u", "left").join(kv.hint("merge"), "v", "left")
        contracted = contracted.select(F.coalesce("__cu", "u").alias("u"), F.coalesce("__cv", "v").alias("v"))
    merged = components(contracted).select(F.col("node").alias("component"), F.col("component").alias("__new"))
    out = join_unique(cut(old, "old"), merged, "component")
    return cut(out.select("node", F.coalesce("__new", "component").alias("component"), "old_component"), "components")


#: Components of at least this share of the weight are placed one by one; there are at most 1 / HEAVY of them.
HEAVY, BUCKETS = 0.001, 1024


def assign_splits(weights: DataFrame, proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """(component, weight, split, status) for components (component, weight, prior): prior is the array of the splits that
    the component's parts had.

    One prior split is kept (status kept), several give quarantine (status conflict), none means new: the heaviest new
    components go one by one, largest first, to the split with the largest deficit; the others, in hash order, fill what is
    left of the deficits by cumulative weight, which needs sums over buckets only. A null weight counts 0. With no
    components the result is empty.
    """
    names = list(proportions)
    whole = sum(proportions.values())
    rows = weights.select(
        "component",
        F.coalesce("weight", F.lit(0)).cast("double").alias("weight"),
        F.array_distinct(F.filter(F.coalesce("prior", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("prior"),
    )
    old = rows.where("size(prior) > 0").select(
        "component",
        "weight",
        F.when(F.size("prior") > 1, QUARANTINE).otherwise(F.element_at("prior", 1)).alias("split"),
        F.when(F.size("prior") > 1, "conflict").otherwise("kept").alias("status"),
    )
    new = rows.where("size(prior) = 0").select("component", "weight")
    held = {r.split: r.w for r in old.groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = (new.agg(F.sum("weight")).first()[0] or 0.0) + sum(w for s, w in held.items() if s in names)
    deficit = {s: max(0.0, proportions[s] / whole * total - held.get(s, 0.0)) for s in names}
    heavy: dict[int, str] = {}
    bar = max(HEAVY * total, 1e-12)
    for r in new.where(F.col("weight") >= bar).orderBy(F.desc("weight"), "component").collect():
        s = max(names, key=lambda s: (deficit[s], -names.index(s)))
        heavy[r.component] = s
        deficit[s] -= r.weight
    deficit = {s: max(0.0, d) for s, d in deficit.items()}
    digits = F.substring(shuffled(seed, "component"), 1, 15)
    light = new.where(F.col("weight") < bar).withColumn("__h", F.conv(digits, 16, 10).cast("bigint"))
    light = light.withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    sums = {r["__b"]: r.w for r in light.groupBy("__b").agg(F.sum("weight").alias("w")).collect()}
    before, at = {}, 0.0
    for b in range(BUCKETS):
        before[b] = at
        at += sums.get(b, 0.0)
    left = sum(deficit.values())
    cuts, edge = [], 0.0
    for s in names:
        edge += (deficit[s] / left if left > 0 else proportions[s] / whole) * at
        cuts.append((s, edge))
    offset = F.get(F.array(*(F.lit(before[b]) for b in range(BUCKETS))), F.col("__b").cast("int"))
    inside = Window.partitionBy("__b").orderBy("__h", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    light = light.withColumn("__mid", offset + F.sum("weight").over(inside) - F.col("weight") / 2)
    split = F.lit(cuts[-1][0])
    for s, edge in reversed(cuts[:-1]):
        split = F.when(F.col("__mid") < edge, s).otherwise(split)
    placed = light.select("component", "weight", split.alias("split"), F.lit("new").alias("status"))
    if heavy:
        spark = weights.sparkSession
        where = spark.createDataFrame(list(heavy.items()), f"component {dict(weights.dtypes)['component']}, split string")
        one = new.where(F.col("weight") >= bar).join(F.broadcast(where), "component")
        placed = placed.union(one.select("component", "weight", "split", F.lit("new").alias("status")))
    return old.union(placed)


def load(
    known: DataFrame | None,
    records: DataFrame,
    node: str,
    via: str,
    proportions: dict[str, float],
    seed: int = 0,
    links: DataFrame | None = None,
) -> DataFrame:
    """The persisted table (node, component, weight, split, status) after a load of records, whose weight is their number.

    known: the table that the load before returned, or None. links: nodes (node, via) of earlier loads, which link the
    records but aren't counted; without them a value links only the records of this load, so that loads that follow one
    another take load_linked(). Nodes of a quarantined component are all quarantined, so that nothing leaks between splits.
    Records with a null node are ignored; a null in via links nothing.
    """
    return _load(known, _pairs(records, node, via), proportions, seed, links)


def _pairs(records: DataFrame, node: str, via: str) -> DataFrame:
    """(node, via, n): the different links of records with their number of rows, cut; records are read once."""
    named = records.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(via).alias("via"))
    return cut(named.groupBy("node", "via").agg(F.count(F.lit(1)).alias("n")), "links")


def _load(known: DataFrame | None, pairs: DataFrame, proportions: dict[str, float], seed: int, links: DataFrame | None) -> DataFrame:
    counts = pairs.groupBy("node").agg(F.sum("n").alias("weight"))
    if known is not None:
        counts = counts.unionByName(known.select("node", "weight")).groupBy("node").agg(F.sum("weight").alias("weight"))
    linked = pairs.select("node", "via")
    if links is not None:
        linked = linked.unionByName(links.select("node", "via"))
    merged = update_components(known, pairs.select("node"), link_edges(linked, "node", "via"))
    if known is not None:
        prior = known.select("node", F.col("split").alias("__prior"))
        merged = merged.join(prior.hint("merge"), "node", "left")
    else:
        merged = merged.withColumn("__prior", F.lit(None).cast("string"))
    members = cut(merged.join(counts.hint("merge"), "node", "left").select("node", "component", "weight", "__prior"), "members")
    per = members.groupBy("component").agg(F.sum("weight").alias("weight"), F.collect_set("__prior").alias("prior"))
    placed = assign_splits(cut(per, "weights"), proportions, seed).select("component", "split", "status")
    return cut(join_unique(members, placed, "component", "inner").select("node", "component", "weight", "split", "status"), "splits")


class Loaded(NamedTuple):
    """What stays between loads: splits, the table of load(), and links (via, node), one node of each value of all loads."""

    splits: DataFrame
    links: DataFrame


def kept(spark: SparkSession, path: str) -> Loaded:
    """What a load kept under path."""
    return Loaded(spark.read.parquet(f"{path}/splits"), spark.read.parquet(f"{path}/links"))


def load_linked(
    known: Loaded | None,
    records: DataFrame,
    node: str,
    via: str,
    proportions: dict[str, float],
    seed: int = 0,
    path: str | None = None,
) -> Loaded:
    """load() after earlier loads whose values link too: the components are those of all records in one load.

    known: what the load before returned or kept() reads, or None. path: a new folder in which the tables stay, for a later
    session too; without it they are deleted by drop_cuts(), at the latest at exit. A value's node of an earlier load stands for all that have it, as they are
    of one component already; so only one row a value is kept, and only the values of this load are looked up.
    """
    pairs = _pairs(records, node, via)
    first = cut(pairs.where("via is not null").groupBy("via").agg(F.min("node").alias("node")), "first")
    if known is None:
        return _keep(Loaded(_load(None, pairs, proportions, seed, None), first), path)
    met = cut(known.links.join(first.select("via").hint("merge"), "via", "left_semi").select("via", "node"), "met")
    done = _load(known.splits, pairs, proportions, seed, met)
    links = known.links.select("via", "node").unionByName(first.join(met.hint("merge"), "via", "left_anti"))
    return _keep(Loaded(done, links if path else cut(links, "links")), path)


def _keep(loaded: Loaded, path: str | None) -> Loaded:
    if path is None:
        return loaded
    for name, df in loaded._asdict().items():
        df.write.parquet(f"{path}/{name}")
    return kept(loaded.splits.sparkSession, path)


def pairs_within(members: DataFrame, block: int = 512) -> DataFrame:
    """(a, b), a < b, of all members (node, component) of one component, made block by block, so that a large component's
    pairs are spread over many tasks.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n")).where("__n is not null")
    m = join_unique(members.select("node", "component"), sizes, "component", "inner")
    m = m.withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
    one = m.select("component", F.col("node").alias("a"), F.col("__own").alias("__i"), F.explode(F.sequence("__own", F.col("__n") - 1)).alias("__j"))
    two = m.select("component", F.col("node").alias("b"), F.col("__own").alias("__j"), F.explode(F.sequence(F.lit(0), "__own")).alias("__i"))
    met = one.join(two.hint("merge"), ["component", "__i", "__j"]).where("a < b or (__i < __j and a <> b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
