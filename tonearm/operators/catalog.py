"""Catalog profiles: contributors and their genres, strata, candidate picks, quotas and prompt grids."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.scalar import draw, shuffled
from tonearm.operators.skew import number_rows
from tonearm.operators.stats import percentiles
from tonearm.storage import cut


def modal_values(tags: DataFrame, key: str, value: str, seq: Sequence[str]) -> DataFrame:
    """(key, primary, coherence, n_unique, n_tags): the most frequent value of each key, of equals the one seen first by seq,
    and its share. Counts are pre-aggregated, so no task gets the rows of a hot key.
    """
    per = tags.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*seq)).alias("__f"))
    first = per.groupBy(F.col(key).alias("__k")).agg(F.max("__n").alias("__top"), F.sum("__n").alias("n_tags"), F.count(F.lit(1)).alias("n_unique"))
    ties = per.join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__top")))
    best = ties.groupBy(key, "__top", "n_unique", "n_tags").agg(F.min_by(value, "__f").alias("primary"))
    return best.select(key, "primary", (F.col("__top") / F.col("n_tags")).alias("coherence"), "n_unique", "n_tags")


def contributor_summary(tracks: DataFrame, tags: DataFrame, key: str, album: str, duration: str, genre: str, seq: Sequence[str]) -> DataFrame:
    """Per key: n_tracks, total and mean duration, n_albums, primary genre, coherence and n_unique genres.

    A key without genres has ('unknown', 0.0, 0). Rows with a null key form a key of their own.
    """
    base = tracks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.sum(duration).alias("total_duration_s"),
        F.avg(duration).alias("mean_duration_s"),
        F.count_distinct(album).alias("n_albums"),
    )
    modal = modal_values(tags, key, genre, seq).select(F.col(key).alias("__k"), "primary", "coherence", "n_unique")
    return base.join(modal, F.col(key).eqNullSafe(F.col("__k")), "left").select(
        *base.columns,
        F.coalesce("primary", F.lit("unknown")).alias("primary_genre"),
        F.coalesce("coherence", F.lit(0.0)).alias("genre_coherence"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique_genres"),
    )


def within(c: Column | str, low: Column | int | None, high: Column | int | None) -> Column:
    """low <= c <= high, where null bounds are open."""
    x = F.col(c) if isinstance(c, str) else c
    lo = F.lit(low) if not isinstance(low, Column) else low
    hi = F.lit(high) if not isinstance(high, Column) else high
    return (lo.isNull() | (x >= lo)) & (hi.isNull() | (x <= hi))


def quantile_labels(df: DataFrame, value: str, cuts: Sequence[float], labels: Sequence[str], name: str) -> DataFrame:
    """df with the label of the right-closed bin between exact quantiles that the value lies in; one row of cuts is broadcast."""
    qs = percentiles(df, value, cuts).select(F.col("p").alias("__q"))
    out = F.lit(labels[-1])
    for i in reversed(range(len(cuts))):
        out = F.when(F.col(value) <= F.get("__q", i), labels[i]).otherwise(out)
    one = df.withColumn("__k", F.lit(1)).join(F.broadcast(qs.withColumn("__k", F.lit(1))), "__k", "left")
    return one.withColumn(name, out).drop("__q", "__k")


def terciles(df: DataFrame, value: str, name: str = "tier") -> DataFrame:
    """low, mid or high by the thirds of the value."""
    return quantile_labels(df, value, [1 / 3, 2 / 3], ["low", "mid", "high"], name)


def quartiles(df: DataFrame, value: str, name: str = "band") -> DataFrame:
    """low, mid, high or extra_high by the quarters of the value."""
    return quantile_labels(df, value, [0.25, 0.5, 0.75], ["low", "mid", "high", "extra_high"], name)


def nearest_to_median(df: DataFrame, tier: str, value: str, tie: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The k rows of each tier whose value is nearest to the tier's median, ties by the order given; place from 1."""
    med = percentiles(df, value, [0.5], [tier]).select(tier, F.get("p", 0).alias("__med"))
    near = df.join(med, tier).withColumn("__dist", F.abs(F.col(value) - F.col("__med")))
    place = F.row_number().over(Window.partitionBy(tier).orderBy("__dist", *tie))
    return near.withColumn(name, place).where(F.col(name) <= k).drop("__med", "__dist")


def diverse_picks(ranked: DataFrame, tier: str, place: str, genre: str, tiers: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Of each tier, in order, the best placed row whose genre no earlier tier took, or the best if all are taken."""
    out = None
    for t in tiers:
        own = ranked.where(F.col(tier) == t)
        if out is not None:
            used = F.broadcast(out.select(F.col(genre).alias("__g")).distinct().withColumn("__used", F.lit(1)))
            own = own.join(used, F.col(genre).eqNullSafe(F.col("__g")), "left").drop("__g")
        else:
            own = own.withColumn("__used", F.lit(None).cast("int"))
        first = F.row_number().over(Window.partitionBy(tier).orderBy(F.col("__used").isNotNull(), place))
        pick = own.withColumn("__r", first).where(F.col("__r") == 1).drop("__r", "__used")
        out = pick if out is None else out.unionByName(pick)
    return out


def diverse_median_picks(df: DataFrame, tier: str, value: str, genre: str, tie: Sequence[Column], tiers: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Of each tier, in order, the row nearest to the median of those whose genre no earlier tier took, or of all if none is
    left; ties by the order given. The median is taken anew after genres are left out, and one row a tier is held.
    """
    out, used = None, []
    for t in tiers:
        own = df.where(F.col(tier) == t)
        free = own.where(~F.coalesce(F.col(genre).isin(used), F.lit(False))) if used else own
        free = own if free.isEmpty() else free
        middle = percentiles(free, value, [0.5]).first()
        if middle is None:
            continue
        pick = cut(free.orderBy(F.abs(F.col(value) - F.lit(middle.p[0])), *tie).limit(1), "pick")
        used += [r[genre] for r in pick.select(genre).collect() if r[genre] is not None]
        out = pick if out is None else out.unionByName(pick)
    return df.limit(0) if out is None else out


def walk_order(ranked: DataFrame, picks: DataFrame, key: str, tier: str, place: str, tiers: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """ranked with walk_no: all picks by tier, then the others round-robin: each tier's first, each tier's second, and so on."""
    at = F.array_position(F.array(*(F.lit(t) for t in tiers)), F.col(tier))
    joined = ranked.join(F.broadcast(picks.select(F.col(key).alias("__p"))), F.col(key) == F.col("__p"), "left")
    joined = joined.withColumn("__fb", F.col("__p").isNull().cast("int"))
    nth = F.row_number().over(Window.partitionBy(tier, "__fb").orderBy(place))
    joined = joined.withColumns({"__n": nth, "__t": at})
    numbered = sequence_numbers(joined, ["__fb", "__n", "__t"], "walk_no").withColumn("walk_no", F.col("walk_no") + 1)
    return numbered.drop("__p", "__fb", "__n", "__t")


def reconcile_quotas(quotas: dict[str, int], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Seats per band: each band's quota up to its cap, the rest to the free seats of highest quota / (seats + 1), earlier
    bands first. An error if the caps don't suffice or the quotas exceed the seats. The bands are few, so this is plain Python.
    """
    given = {b: min(q, caps[b]) for b, q in quotas.items()}
    missing = seats - sum(given.values())
    free = [(-quotas[b] / (k + 1), i, b) for i, b in enumerate(quotas) for k in range(given[b], caps[b])]
    if missing < 0 or missing > len(free):
        raise ValueError("quotas can't be met")
    for _, _, b in sorted(free)[:missing]:
        given[b] += 1
    return given


def stratified_draw(df: DataFrame, band: str, key: str, counts: dict[str, int], seed: int) -> DataFrame:
    """counts[band] rows of each band in a hashed order; fewer where a band has fewer. A band's losers never leave their task."""
    order = Window.partitionBy(band).orderBy(shuffled(seed, key), key)
    table = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.coalesce(F.try_element_at(table, F.col(band)), F.lit(0))).drop("__r")


def draw_cells(df: DataFrame, key: str, value: str, cells: Sequence[dict], seed: int, name: str = "band") -> DataFrame:
    """The rows drawn for each cell, with the cell's band and draw_no from 1 across cells: of the rows whose value lies within
    the cell's low and high (None is open) and that no earlier cell took, count in a hashed order. An error if a cell has too
    few. What earlier cells took is at most the sum of their counts, which is broadcast.
    """
    taken, out, before = None, None, 0
    for cell in cells:
        free = df.where(within(value, cell.get("low"), cell.get("high")))
        if taken is not None:
            free = free.join(F.broadcast(taken.select(key)), key, "left_anti")
        drawn = free.withColumn("__h", shuffled(seed, F.lit(cell["band"]), key)).orderBy("__h", key).limit(cell["count"])
        drawn = cut(drawn.select(*df.columns, "__h"), "cell")
        if (n := drawn.count()) < cell["count"]:
            raise ValueError(f"cell {cell['band']!r} has {n} rows, {cell['count']} are asked for")
        place = F.row_number().over(Window.orderBy("__h", key)) + before
        one = drawn.withColumn("draw_no", place.cast("int")).withColumn(name, F.lit(cell["band"])).drop("__h")
        taken = drawn.select(key) if taken is None else taken.union(drawn.select(key))
        out = one if out is None else out.unionByName(one)
        before += n
    return out


def hashed_subset(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in a hashed order (all if there are fewer), as a top-k and not a sort of everything."""
    return df.orderBy(shuffled(seed, key), key).limit(k)


def fraction_subset(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """int(n ratio) rows, one at least, in a hashed order."""
    return hashed_subset(df, key, max(1, int(df.count() * ratio)), seed)


def prompt_grid(sellers: DataFrame, seller: str, n_sellers: int, n_prompts: int, templates: Sequence[str], controls: Sequence[str]) -> DataFrame:
    """(prompt_no, kind, linked_seller, text): the same number of prompts for each seller (in order of seller), templates
    cycled, and controls for the rest, a tenth at least.
    """
    per = max(1, (n_prompts - max(1, n_prompts // 10)) // n_sellers)
    off = n_prompts - per * n_sellers
    if off < 1:
        raise ValueError("too few prompts for a control")
    own = sequence_numbers(sellers.select(F.col(seller).alias("linked_seller")), ["linked_seller"], "__s").withColumn("__s", F.col("__s") + 1)
    own = own.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    pool = F.array(*(F.lit(t) for t in templates))
    on = own.select(
        ((F.col("__s") - 1) * per + F.col("__i") + 1).cast("int").alias("prompt_no"),
        F.lit("on_genre").alias("kind"),
        "linked_seller",
        F.get(pool, F.pmod(F.col("__i"), F.lit(len(templates)))).alias("text"),
    )
    spare = F.array(*(F.lit(t) for t in controls))
    rest = sellers.sparkSession.range(off).select(
        (F.col("id") + per * n_sellers + 1).cast("int").alias("prompt_no"),
        F.lit("control").alias("kind"),
        F.lit(None).cast(dict(own.dtypes)["linked_seller"]).alias("linked_seller"),
        F.get(spare, F.pmod(F.col("id"), F.lit(len(controls))).cast("int")).alias("text"),
    )
    return on.union(rest)


def redrawn(df: DataFrame, key: str, ok: Column, order: Sequence[Column | str], seed: int = 0) -> DataFrame:
    """df with each row that isn't ok replaced by a row drawn among those that are, keyed by its own key; drawn_for is the key
    of the row replaced, or null. Without any ok row nothing is left.
    """
    good = sequence_numbers(df.where(ok), list(order), "__at")
    n = good.count()
    bad = df.where(~F.coalesce(ok, F.lit(False))).select(F.col(key).alias("drawn_for"), F.floor(draw(seed, key) * n).alias("__at"))
    put = good.join(bad, "__at")
    return good.withColumn("drawn_for", F.lit(None).cast(dict(df.dtypes)[key])).drop("__at").unionByName(put.drop("__at"))


def ordered_map(df: DataFrame, order: Sequence[Column | str], function, schema: str) -> DataFrame:
    """What a function of Arrow batches makes of the rows of df, in parallel, sorted by the rows' positions in the order.

    function: a generator over record batches that has to yield as many rows as it gets, in order; schema: of its columns. The
    position, idx, is carried past it.
    """
    rows = sequence_numbers(df, order, "idx")
    own = [c for c in rows.columns if c != "idx"]

    def run(batches):
        for b in batches:
            made = pa.Table.from_batches(list(function(iter([b.select(own)])))).combine_chunks()
            if made.num_rows != b.num_rows:
                raise ValueError("an ordered map has to yield a row for each row")
            if b.num_rows:
                made = made.append_column("idx", b.column("idx"))
                yield from made.to_batches()

    return rows.mapInArrow(run, f"{schema}, idx bigint").orderBy("idx")


def top_counts(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values with their counts, ties by value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)


def sequence_numbers(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """df numbered from 0 in an order, by range partitions and offsets, so that the whole never passes through one task."""
    one = number_rows(df.withColumn("__all", F.lit(0)), ["__all"], list(order), name).drop("__all")
    return one.withColumn(name, F.col(name) - 1)
