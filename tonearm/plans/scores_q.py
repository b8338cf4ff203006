"""Queries of scores and statistics: A3-A5, A7, A8, A10-A12, A14, A16, A18, J1, J9, J13-J15, W1-W5, W11, W12, X1-X15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.scalar import marginal_gain
from tonearm.operators import attribution as at
from tonearm.operators import ranking as rk
from tonearm.operators import stats as st
from tonearm.plans.bases import PAIRS, SCORES, nn, pairs, parts, scores
from tonearm.plans.registry import core

RANKED = """
    rk AS (SELECT seller, query, hat, star,
                  rank() OVER (PARTITION BY seller ORDER BY hat) + (count(*) OVER (PARTITION BY seller, hat) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY seller ORDER BY star) + (count(*) OVER (PARTITION BY seller, star) - 1) / 2.0 AS ry FROM pairs)
"""


def _r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


@core.add(
    "slice_seller_informativeness",
    f"""
    WITH {PAIRS}, {RANKED}
    SELECT seller, 0.0 + round({nn("regr_slope(star, hat)")}, 6) AS i_hat, 0.0 + round({nn("regr_slope(hat, star)")}, 6) AS k_hat,
           0.0 + round({nn("corr(rx, ry)")}, 6) AS spearman, count(*) AS n FROM rk GROUP BY seller
    """,
)
def slice_seller_informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per seller the slope of its true on its estimated contributions, the reverse slope, rank correlation and T."""
    e = st.estimates(pairs(spark, sf_dir), ["seller"], "hat", "star")
    return e.select("seller", _r("i_hat").alias("i_hat"), _r("k_hat").alias("k_hat"), _r("spearman").alias("spearman"), "n")


@core.add(
    "x03_estimates",
    f"""
    WITH {PAIRS},
    k AS (SELECT seller, regr_slope(hat, star) AS k, regr_slope(star, hat) AS i FROM pairs GROUP BY seller),
    z AS (SELECT seller, var_samp(hat / k - star) AS noise FROM pairs JOIN k USING (seller) WHERE isfinite(k) AND abs(k) >= 1e-12 GROUP BY seller)
    SELECT seller, 0.0 + round({nn("var_samp(star)")}, 6) AS var_star, round(avg((hat - star) * (hat - star)), 6) AS mse,
           round(CASE WHEN any_value(noise) <= 0 THEN 'infinity'::DOUBLE ELSE {nn("var_samp(star)")} / any_value(noise) END, 6) AS snr,
           round(CASE WHEN NOT isfinite(any_value(i)) THEN NULL WHEN any_value(i) >= 1 THEN 'infinity'::DOUBLE WHEN any_value(i) <= 0 THEN 0.0
                 ELSE any_value(i) / (1 - any_value(i)) END, 6) AS snr_shortcut, count(*) AS n
    FROM pairs JOIN k USING (seller) LEFT JOIN z USING (seller) GROUP BY seller
    """,
)
def x03_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance, error and signal-to-noise ratios of each seller."""
    e = st.estimates(pairs(spark, sf_dir), ["seller"], "hat", "star")
    return e.select("seller", *(_r(c).alias(c) for c in ("var_star", "mse", "snr", "snr_shortcut")), "n")


@core.add(
    "x05_pearson",
    f"""
    WITH {PAIRS} SELECT seller, 0.0 + round({nn("corr(hat, star)")}, 6) AS r, 0.0 + round({nn("corr(hat, 1.0)")}, 6) AS r_constant FROM pairs GROUP BY seller
    """,
)
def x05_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, which is null on a constant column."""
    p = pairs(spark, sf_dir).withColumn("one", F.lit(1.0))
    return p.groupBy("seller").agg(_r(st.pearson("hat", "star")).alias("r"), _r(st.pearson("hat", "one")).alias("r_constant"))


@core.add(
    "x09_jackknife",
    f"""
    WITH {PAIRS},
    f AS (SELECT seller, regr_slope(star, hat) AS full_slope FROM pairs GROUP BY seller),
    w AS (SELECT a.seller, a.query, regr_slope(b.star, b.hat) AS s FROM pairs a JOIN pairs b ON a.seller = b.seller AND a.query <> b.query GROUP BY a.seller, a.query),
    d AS (SELECT w.seller, w.query, {nn("s")} AS s, {nn("full_slope")} AS full_slope FROM w JOIN f USING (seller))
    SELECT seller, round(any_value(full_slope), 5) AS slope, round(min(s), 5) AS least, round(max(s), 5) AS most, round(stddev_samp(s), 5) AS spread,
           coalesce(arg_max(query, abs(s - full_slope)), min(query)) AS item, round(arg_max(s - full_slope, abs(s - full_slope)), 5) AS change, count(*) AS n
    FROM d GROUP BY seller
    """,
)
def x09_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each seller's slope changes without one query, from sums alone."""
    j = st.jackknife(pairs(spark, sf_dir), ["seller"], "query", "hat", "star")
    return j.select("seller", *(_r(c, 5).alias(c) for c in ("slope", "least", "most", "spread")), "item", _r("change", 5).alias("change"), "n")


@core.add(
    "x10_query_correlations",
    f"""
    WITH {PAIRS},
    rk AS (SELECT query, hat, star, rank() OVER (PARTITION BY query ORDER BY hat) + (count(*) OVER (PARTITION BY query, hat) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY query ORDER BY star) + (count(*) OVER (PARTITION BY query, star) - 1) / 2.0 AS ry FROM pairs)
    SELECT query, 0.0 + round({nn("corr(hat, star)")}, 6) AS pearson, 0.0 + round({nn("corr(rx, ry)")}, 6) AS spearman, count(*) AS n FROM rk GROUP BY query
    """,
)
def x10_query_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both correlations of each query across sellers."""
    p = pairs(spark, sf_dir)
    rank = st.rank_correlation(p, ["query"], "hat", "star")
    return p.groupBy("query").agg(_r(st.pearson("hat", "star")).alias("pearson")).join(rank.select("query", _r("spearman").alias("spearman"), "n"), "query")


@core.add(
    "a16_correlation_summary",
    f"""
    WITH {PAIRS}, c AS (SELECT query, {nn("corr(hat, star)")} AS r FROM pairs GROUP BY query)
    SELECT round(avg(r), 6) AS mean, round(CAST(quantile_cont(r, 0.5) AS DOUBLE), 6) AS median, count(r) AS n FROM c
    """,
)
def a16_correlation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median of the queries' correlations."""
    c = pairs(spark, sf_dir).groupBy("query").agg(st.pearson("hat", "star").alias("r"))
    return st.summary(c, "r").select(_r("mean").alias("mean"), _r("median").alias("median"), "n")


@core.add("x08_bootstrap")
def x08_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of each seller's slope and rank correlation."""
    p = pairs(spark, sf_dir)
    a = st.bootstrap(p, "seller", "query", "hat", "star", st.slope_of, 200, 0.95, 42)
    b = st.bootstrap(p, "seller", "query", "hat", "star", st.rank_correlation_of, 200, 0.95, 43)
    names = {c: f"rank_{c}" for c in ("point", "low", "high")}
    return a.join(b.withColumnsRenamed(names), "seller")


# Student's distribution has a closed form for an even number of degrees of freedom, which the tables have (n is even); small
# p-values are summed as the rest of the series for 1 / |r|.
_TESTED = """
    rk AS (SELECT query, rank() OVER (PARTITION BY query ORDER BY hat) + (count(*) OVER (PARTITION BY query, hat) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY query ORDER BY star) + (count(*) OVER (PARTITION BY query, star) - 1) / 2.0 AS ry FROM {pairs}),
    co AS (SELECT query, corr(rx, ry) AS r, count(*) AS n FROM rk GROUP BY query),
    tested AS (SELECT query, r, n, CASE WHEN r * r < 0.02 THEN 1 - abs(r) * list_sum(list_transform(range((n - 2) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(1 - r * r, j)))
               ELSE abs(r) * list_sum(list_transform(range((n - 2) // 2, (n - 2) // 2 + 4000), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) + j * ln(1 - r * r)) / sqrt(pi()))) END AS p FROM co)
"""


@core.add(
    "x08_bootstrap_exact",
    f"WITH {PAIRS} SELECT seller, 3.0::DOUBLE AS low, 3.0::DOUBLE AS high, -1.0::DOUBLE AS rank_low, -1.0::DOUBLE AS rank_high FROM pairs GROUP BY seller HAVING count(DISTINCT hat) > 3",
)
def x08_bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of exact relations shrink to their value: the slope of 3 x + 1, the rank correlation with - x."""
    p = pairs(spark, sf_dir).withColumns({"up": F.col("hat") * 3 + 1, "down": -F.col("hat")})
    some = p.groupBy("seller").agg(F.count_distinct("hat").alias("n")).where("n > 3").select("seller")
    p = p.join(some, "seller", "left_semi")
    a = st.bootstrap(p, "seller", "query", "hat", "up", st.slope_of, 100).select("seller", _r("low", 9).alias("low"), _r("high", 9).alias("high"))
    b = st.bootstrap(p, "seller", "query", "hat", "down", st.rank_correlation_of, 100)
    return a.join(b.select("seller", _r("low", 9).alias("rank_low"), _r("high", 9).alias("rank_high")), "seller")


@core.add("x11_rank_pvalues", f"WITH {PAIRS}, {_TESTED.format(pairs='pairs')} SELECT query, round(r, 6) + 0.0 AS spearman, n, round(p, 8) + 0.0 AS pvalue FROM tested")
def x11_rank_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each query with its p-value."""
    t = st.with_correlation_p(st.rank_correlation(pairs(spark, sf_dir), ["query"], "hat", "star"), "spearman", "n")
    return t.select("query", _r("spearman").alias("spearman"), "n", _r("pvalue", 8).alias("pvalue"))


@core.add(
    "x11_fisher",
    f"""
    WITH {PAIRS}, {_TESTED.format(pairs="pairs")}, h AS (SELECT avg(r) AS average, -sum(ln(p)) AS half, count(*) AS n FROM tested)
    SELECT round(average, 6) + 0.0 AS average, round(log10(list_sum(list_transform(range(n), lambda i: exp(i * ln(half) - half - lgamma(i + 1))))), 3) AS log_fisher, n AS n_valid, n AS n_all FROM h
    """,
)
def x11_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank correlation and Fisher's combined p-value."""
    ranked = st.rank_correlation(pairs(spark, sf_dir), ["query"], "hat", "star")
    out = st.combined(st.with_correlation_p(ranked, "spearman", "n"), "spearman", "pvalue")
    return out.select(_r("average").alias("average"), F.round(F.log10("fisher_pvalue"), 3).alias("log_fisher"), "n_valid", "n_all")


@core.add(
    "x12_random_control",
    f"""
    WITH {PAIRS}, rp AS (SELECT query, star, ('0x' || md5('7|' || seller || '|' || query)[1:10])::BIGINT / 1099511627776.0 AS hat FROM pairs), {_TESTED.format(pairs='rp')},
    h AS (SELECT avg(r) AS average, -sum(ln(p)) AS half, count(*) AS n FROM tested)
    SELECT round(average, 6) + 0.0 AS average, round(list_sum(list_transform(range(n), lambda i: exp(i * ln(half) - half - lgamma(i + 1)))), 7) AS fisher_pvalue, n AS n_valid, n AS n_all FROM h
    """,
)
def x12_random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with keyed random scores instead of estimates: a negative control."""
    from tonearm.functions.scalar import draw

    p = pairs(spark, sf_dir).withColumn("hat", draw(7, F.col("seller"), F.col("query")))
    ranked = st.with_correlation_p(st.rank_correlation(p, ["query"], "hat", "star"), "spearman", "n")
    out = st.combined(ranked, "spearman", "pvalue")
    return out.withColumns({"average": _r("average"), "fisher_pvalue": F.round("fisher_pvalue", 7)})


LOSSES = f"""
    {PAIRS},
    ls AS (SELECT 0 AS model_id, query, CAST(qty AS DOUBLE) / n AS loss FROM pt UNION ALL
           SELECT seller AS model_id, query, CAST(pt.qty - pp.qty AS DOUBLE) / nullif(pt.n - pp.n, 0) AS loss FROM pp JOIN pt USING (query) WHERE seller <> 0)
"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, query_id, loss: model 0 has all sellers, model j all but j; seller 0 has no model."""
    p = parts(spark, sf_dir)
    t = p.groupBy("query").agg(F.sum("qty").alias("q"), F.sum("n").alias("m"))
    full = t.select(F.lit(0).cast("bigint").alias("model_id"), "query", (F.col("q").cast("double") / F.col("m")).alias("loss"))
    loo = p.where("seller <> 0").join(t, "query").select(F.col("seller").alias("model_id"), "query", F.try_divide((F.col("q") - F.col("qty")).cast("double"), F.col("m") - F.col("n")).alias("loss"))
    return full.union(loo).withColumnRenamed("query", "query_id")


@core.add(
    "j09_loss_differences",
    f"""
    WITH {LOSSES}
    SELECT a.model_id AS seller, a.query, round(b.loss, 6) AS loss_full, round(a.loss, 6) AS loss_without, 0.0 + round(a.loss - b.loss, 6) AS a_star
    FROM ls a JOIN ls b ON a.query = b.query AND b.model_id = 0 WHERE a.model_id <> 0
    """,
)
def j09_loss_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each leave-one-out model less that of the full one."""
    d = at.loss_differences(losses(spark, sf_dir))
    return d.select("seller", "query", *(_r(c).alias(c) for c in ("loss_full", "loss_without", "a_star")))


@core.add(
    "x13_quality_differences",
    f"""
    WITH {LOSSES}
    SELECT a.model_id AS seller, a.query, 0.0 + round(b.loss - a.loss, 6) AS a_star FROM ls a JOIN ls b ON a.query = b.query AND b.model_id = 0 WHERE a.model_id <> 0
    """,
)
def x13_quality_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with quality, of which more is better: the operands the other way round."""
    q = losses(spark, sf_dir).select(F.col("model_id").alias("seller"), F.col("query_id").alias("query"), F.col("loss").alias("quality"))
    return at.quality_differences(q).select("seller", "query", _r("a_star").alias("a_star"))


@core.add(
    "j01_join_contributions",
    f"""
    WITH {PAIRS}, a AS (SELECT seller, query, star FROM pairs WHERE query <= 9), b AS (SELECT seller, query, hat FROM pairs WHERE query >= 4)
    SELECT seller, query, round(star, 6) AS star, round(hat, 8) AS hat FROM a JOIN b USING (seller, query)
    """,
)
def j01_join_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and estimated contributions joined on seller and query."""
    p = pairs(spark, sf_dir)
    a, b = p.where("query <= 9").select("seller", "query", "star"), p.where("query >= 4").select("seller", "query", "hat")
    return a.join(b, ["seller", "query"]).select("seller", "query", _r("star").alias("star"), _r("hat", 8).alias("hat"))


@core.add(
    "a03_roll_up",
    f"""
    WITH {SCORES}, m AS (SELECT DISTINCT seller, train FROM sc), s AS (SELECT query, train, sum(cents) AS score FROM sc GROUP BY query, train)
    SELECT seller, query, CAST(sum(score) AS BIGINT) AS value, count(*) AS n FROM s JOIN m USING (train) GROUP BY seller, query
    """,
)
def a03_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores summed by seller and query through a membership table."""
    sc = scores(spark, sf_dir)
    return at.roll_up(sc.groupBy("query", "train").agg(F.sum("cents").alias("score")), sc.select("seller", "train").distinct())


@core.add(
    "a03_roll_up_mean",
    f"WITH {SCORES} SELECT seller, query, round(avg(CAST(cents AS DOUBLE)), 3) AS value, count(*) AS n FROM sc GROUP BY seller, query",
)
def a03_roll_up_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores averaged by seller and query."""
    sc = scores(spark, sf_dir)
    return sc.groupBy("seller", "query").agg(_r(F.avg(F.col("cents").cast("double")), 3).alias("value"), F.count(F.lit(1)).alias("n"))


@core.add(
    "a04_signed_index_sums",
    f"""
    WITH {SCORES}, s AS (SELECT query, train, CAST(sum(cents) AS BIGINT) AS score FROM sc GROUP BY query, train),
    l AS (SELECT seller, string_agg(CAST(train AS VARCHAR), ' ') AS train_indices FROM (SELECT DISTINCT seller, train FROM sc) GROUP BY seller),
    i AS (SELECT seller, CAST(unnest(string_split(train_indices, ' ')) AS BIGINT) AS train FROM l)
    SELECT seller, query, CAST(-sum(score) AS DOUBLE) AS value FROM i JOIN s USING (train) GROUP BY seller, query
    """,
)
def a04_signed_index_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated scores summed over lists of indices kept as text."""
    sc = scores(spark, sf_dir)
    lists = sc.select("seller", "train").distinct().groupBy("seller").agg(F.array_join(F.collect_list(F.col("train").cast("string")), " ").alias("train_indices"))
    return at.signed_index_sums(lists, sc.groupBy("query", "train").agg(F.sum("cents").alias("score")), -1.0)


SUBSETS = f"""
    {SCORES}, s AS (SELECT query, train, CAST(sum(cents) AS BIGINT) AS score FROM sc GROUP BY query, train),
    m AS (SELECT CAST(train % 7 AS INTEGER) AS model, train FROM (SELECT DISTINCT train FROM sc) UNION ALL
          SELECT 1 AS model, train FROM (SELECT DISTINCT train FROM sc) WHERE train % 14 = 1)
"""


def _subsets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sc = scores(spark, sf_dir)
    one = sc.select("train").distinct()
    twice = one.where("train % 14 = 1").select(F.lit(1).alias("model"), "train")
    return sc.groupBy("query", "train").agg(F.sum("cents").alias("score")), one.select((F.col("train") % 7).cast("int").alias("model"), "train").union(twice)


@core.add("a05_subset_included", f"WITH {SUBSETS} SELECT model, query, CAST(sum(score) AS BIGINT) AS value FROM m JOIN s USING (train) GROUP BY model, query")
def a05_subset_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores summed over each model's subset; an index given twice counts twice."""
    return at.subset_sums(*_subsets(spark, sf_dir))


@core.add(
    "a05_subset_excluded",
    f"""
    WITH {SUBSETS}, i AS (SELECT model, query, sum(score) AS v FROM m JOIN s USING (train) GROUP BY model, query),
    t AS (SELECT query, sum(score) AS t FROM s GROUP BY query)
    SELECT g.model, t.query, CAST(t.t - coalesce(i.v, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT model FROM m) g CROSS JOIN t LEFT JOIN i USING (model, query)
    """,
)
def a05_subset_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all but each model's subset, as the total less the subset."""
    return at.subset_sums(*_subsets(spark, sf_dir), excluded=True).withColumn("value", F.col("value").cast("double"))


@core.add(
    "a07_ensemble_mean",
    f"""
    WITH {SCORES} SELECT query, seller AS train, round(CAST(CAST(avg(CAST(CAST(cents AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE), 1) AS score, count(*) AS n_members
    FROM sc GROUP BY query, seller
    """,
)
def a07_ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of float scores over members, summed in double."""
    sc = scores(spark, sf_dir).select("query", F.col("seller").alias("train"), F.col("cents").cast("float").alias("score"))
    return at.ensemble_mean(sc).withColumn("score", _r(F.col("score").cast("double"), 1))


@core.add(
    "a08_timestep_mean",
    f"""
    WITH {SCORES}, s AS (SELECT seller AS model, query, CAST(train % 5 AS INTEGER) AS t, avg(CAST(cents AS DOUBLE)) AS score FROM sc GROUP BY seller, query, train % 5)
    SELECT model, query, round(avg(score), 4) AS score, count(*) AS n FROM s GROUP BY model, query
    """,
)
def a08_timestep_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over timesteps of the mean score per timestep."""
    sc = scores(spark, sf_dir).select(F.col("seller").alias("model"), "query", (F.col("train") % 5).cast("int").alias("t"), F.col("cents").cast("double").alias("c"))
    per = sc.groupBy("model", "query", "t").agg(F.avg("c").alias("score"))
    return per.groupBy("model", "query").agg(_r(F.avg("score"), 4).alias("score"), F.count(F.lit(1)).alias("n"))


_SUMMARY = """count(c) AS n, round(avg(c), 3) AS mean, round(stddev_pop(c), 3) AS std, min(c) AS least, round(CAST(quantile_cont(c, 0.25) AS DOUBLE), 3) AS p25,
    round(CAST(quantile_cont(c, 0.5) AS DOUBLE), 3) AS median, round(CAST(quantile_cont(c, 0.75) AS DOUBLE), 3) AS p75, max(c) AS most"""


@core.add("a10_score_summary", f"WITH {SCORES}, d AS (SELECT query, CAST(cents AS DOUBLE) AS c FROM sc) SELECT query, {_SUMMARY} FROM d GROUP BY query")
def a10_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, population deviation and quartiles of each query's scores."""
    s = st.summary(scores(spark, sf_dir).withColumn("c", F.col("cents").cast("double")), "c", ["query"])
    return s.select("query", "n", *(_r(c, 3).alias(c) for c in ("mean", "std")), "least", *(_r(c, 3).alias(c) for c in ("p25", "median", "p75")), "most")


@core.add("a12_matrix_summary", f"WITH {SCORES}, d AS (SELECT CAST(cents AS DOUBLE) AS c FROM sc) SELECT {_SUMMARY} FROM d")
def a12_matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all scores."""
    s = st.summary(scores(spark, sf_dir).withColumn("c", F.col("cents").cast("double")), "c")
    return s.select("n", *(_r(c, 3).alias(c) for c in ("mean", "std")), "least", *(_r(c, 3).alias(c) for c in ("p25", "median", "p75")), "most")


@core.add(
    "a11_query_extremes",
    f"""
    WITH {PAIRS}
    SELECT query, arg_max(seller, (cents, -seller)) AS most_id, max(cents) AS most, arg_min(seller, (cents, seller)) AS least_id, min(cents) AS least,
           round(avg(cents), 3) AS mean, round(stddev_pop(cents), 3) AS std FROM pp GROUP BY query
    """,
)
def a11_query_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which seller scores most and least in each query."""
    e = at.extremes(parts(spark, sf_dir), "query", "seller", "cents")
    return e.withColumns({"mean": _r("mean", 3), "std": _r("std", 3)})


@core.add(
    "a14_quality_means",
    f"""
    WITH {PAIRS} SELECT seller, round(avg(hat), 6) AS q_full, round(avg(star), 6) AS q_loo, round(avg(hat) - avg(star), 6) AS gap FROM pairs GROUP BY seller
    """,
)
def a14_quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per seller and their difference."""
    p = pairs(spark, sf_dir).groupBy("seller").agg(F.avg("hat").alias("h"), F.avg("star").alias("s"))
    return p.select("seller", _r("h").alias("q_full"), _r("s").alias("q_loo"), _r(F.col("h") - F.col("s")).alias("gap"))


@core.add(
    "a18_conditional_gap",
    f"WITH {SCORES} SELECT round(avg(CASE WHEN query <= 6 THEN CAST(cents AS DOUBLE) END) - avg(CASE WHEN query > 6 THEN CAST(cents AS DOUBLE) END), 3) AS gap FROM sc",
)
def a18_conditional_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of one condition less that of the other."""
    c = F.col("cents").cast("double")
    return scores(spark, sf_dir).agg(_r(F.avg(F.when(F.col("query") <= 6, c)) - F.avg(F.when(F.col("query") > 6, c)), 3).alias("gap"))


@core.add(
    "j02_base_reference",
    f"""
    WITH {PAIRS}, b AS (SELECT query, round(avg(hat), 6) AS q_base FROM pairs WHERE query <> 5 GROUP BY query)
    SELECT seller, pairs.query, round(hat, 8) AS hat, q_base FROM pairs LEFT JOIN b ON pairs.query = b.query
    """,
)
def j02_base_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value per query joined to all sellers; null where there is none."""
    p = pairs(spark, sf_dir)
    base = p.where("query <> 5").groupBy("query").agg(_r(F.avg("hat")).alias("q_base"))
    return p.join(base, "query", "left").select("seller", "query", _r("hat", 8).alias("hat"), "q_base")


@core.add(
    "j13_complete_grid",
    f"""
    WITH {PAIRS}, a AS (SELECT seller, query, cents FROM pp WHERE (seller + query) % 4 <> 0)
    SELECT s.seller, q.query, coalesce(a.cents, 0) AS cents FROM (SELECT DISTINCT seller FROM pp) s CROSS JOIN (SELECT DISTINCT query FROM pp) q LEFT JOIN a ON a.seller = s.seller AND a.query = q.query
    """,
)
def j13_complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seller with every query, 0 where there is no score."""
    p = parts(spark, sf_dir)
    grid = at.complete_grid(p.select("seller").distinct(), p.select("query").distinct())
    some = p.where("(seller + query) % 4 <> 0").select("seller", "query", "cents")
    return grid.join(some, ["seller", "query"], "left").select("seller", "query", F.coalesce("cents", F.lit(0)).alias("cents"))


@core.add(
    "j14_reorder_axis",
    f"WITH {PAIRS} SELECT CAST(row_number() OVER (PARTITION BY query ORDER BY seller DESC) - 1 AS INTEGER) AS train, query, cents FROM pp WHERE seller IS NOT NULL",
)
def j14_reorder_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns gathered by a new order of the axis; every query has every seller here."""
    from pyspark.sql import Window

    from tonearm.operators.matching import reorder

    p = parts(spark, sf_dir).select(F.col("seller").alias("train"), "query", "cents")
    axis = p.select("train").distinct()
    order = axis.select(F.col("train").alias("old"), (F.row_number().over(Window.orderBy(F.desc("train"))) - 1).alias("at"))
    return reorder(p, "train", order, "at", "old")


@core.add(
    "w01_average_rank",
    f"WITH {PAIRS} SELECT seller, query, cents // 1000000 AS m, rank() OVER (PARTITION BY query ORDER BY cents // 1000000) + (count(*) OVER (PARTITION BY query, cents // 1000000) - 1) / 2.0::DOUBLE AS r FROM pp",
)
def w01_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending ranks with shared places."""
    p = parts(spark, sf_dir).select("seller", "query", F.floor(F.col("cents") / 1000000).alias("m"))
    return st.with_average_rank(p, "m", ["query"], "r")


@core.add(
    "w02_average_rank_desc",
    f"WITH {PAIRS} SELECT seller, query, rank() OVER (PARTITION BY query ORDER BY cents // 1000000 DESC) + (count(*) OVER (PARTITION BY query, cents // 1000000) - 1) / 2.0::DOUBLE AS r FROM pp",
)
def w02_average_rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending ranks with shared places."""
    p = parts(spark, sf_dir).select("seller", "query", F.floor(F.col("cents") / 1000000).alias("m"))
    return st.with_average_rank(p, "m", ["query"], "r", descending=True).drop("m")


@core.add(
    "w03_ranked_influence",
    f"WITH {PAIRS} SELECT query, seller, cents, row_number() OVER (PARTITION BY query ORDER BY cents DESC, seller DESC) - 1 AS rank FROM pp QUALIFY row_number() OVER (PARTITION BY query ORDER BY cents DESC, seller DESC) <= 10",
)
def w03_ranked_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most influential sellers of each query."""
    return rk.ranked_by_score(parts(spark, sf_dir), "query", "seller", "cents", 10).select("query", "seller", "cents", F.col("rank").cast("bigint").alias("rank"))


@core.add(
    "w04_rank_aligned",
    f"""
    WITH {PAIRS}, r AS (SELECT query, hat, row_number() OVER (PARTITION BY query ORDER BY cents DESC, seller DESC) - 1 AS rank FROM pairs JOIN pp USING (seller, query))
    SELECT rank, round(avg(hat), 6) AS mean, round(stddev_pop(hat), 6) AS std, count(*) AS n FROM r WHERE rank < 10 GROUP BY rank
    """,
)
def w04_rank_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of a value at each rank, across queries."""
    p = parts(spark, sf_dir).select("seller", "query", "cents")
    ranked = rk.ranked_by_score(p, "query", "seller", "cents", 10).join(pairs(spark, sf_dir), ["seller", "query"])
    b = rk.by_rank(ranked, "rank", "hat")
    return b.select(F.col("rank").cast("bigint").alias("rank"), _r("mean").alias("mean"), _r("std").alias("std"), "n")


@core.add(
    "w05_samples",
    f"""
    WITH {PAIRS}, m AS (SELECT query, quantile_cont(cents, 0.5) AS med FROM pp GROUP BY query),
    a AS (SELECT query, seller, cents, row_number() OVER (PARTITION BY query ORDER BY cents DESC, seller) AS t, row_number() OVER (PARTITION BY query ORDER BY cents, seller) AS b,
                 row_number() OVER (PARTITION BY query ORDER BY abs(cents - med), seller) AS c FROM pp JOIN m USING (query))
    SELECT query, 'top' AS kind, t AS place, seller, cents FROM a WHERE t <= 3 UNION ALL SELECT query, 'bottom', b, seller, cents FROM a WHERE b <= 3
    UNION ALL SELECT query, 'middle', c, seller, cents FROM a WHERE c <= 3
    """,
)
def w05_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest, lowest and middle scores of each query."""
    return rk.samples(parts(spark, sf_dir).select("seller", "query", "cents"), "query", "seller", "cents", 3).withColumn("place", F.col("place").cast("bigint"))


@core.add(
    "w11_nucleus",
    f"""
    WITH {PAIRS}, p AS (SELECT query, seller, cents / CAST(sum(cents) OVER (PARTITION BY query) AS DOUBLE) AS p FROM pp),
    b AS (SELECT *, sum(p) OVER (PARTITION BY query ORDER BY p DESC, seller ROWS UNBOUNDED PRECEDING) - p AS before FROM p),
    k AS (SELECT * FROM b WHERE before <= 0.5)
    SELECT query, seller, round(p / sum(p) OVER (PARTITION BY query), 8) AS renormalised FROM k
    """,
)
def w11_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What top-p choice may draw of each query."""
    from pyspark.sql import Window

    p = parts(spark, sf_dir).select("query", "seller", (F.col("cents") / F.sum("cents").over(Window.partitionBy("query")).cast("double")).alias("p"))
    return rk.nucleus(p, ["query"], "p", "seller", 0.5).select("query", "seller", _r("renormalised", 8).alias("renormalised"))


@core.add(
    "w12_top_k_choice",
    f"""
    WITH {PAIRS}, k AS (SELECT query, seller, cents // 1000000 AS p FROM pp QUALIFY rank() OVER (PARTITION BY query ORDER BY cents // 1000000 DESC) <= 5)
    SELECT query, seller, round(p / CAST(sum(p) OVER (PARTITION BY query) AS DOUBLE), 8) AS renormalised FROM k
    """,
)
def w12_top_k_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What top-k choice may draw of each query, equals kept."""
    p = parts(spark, sf_dir).select("query", "seller", F.floor(F.col("cents") / 1000000).alias("p"))
    return rk.top_k_choice(p, ["query"], "p", 5).select("query", "seller", _r("renormalised", 8).alias("renormalised"))


@core.add(
    "f15_marginal_gain",
    f"""
    WITH {PAIRS}, s AS (SELECT seller, regr_slope(star, hat) AS i, var_samp(star) AS v FROM pairs GROUP BY seller),
    r AS (SELECT seller, v, CASE WHEN NOT isfinite(i) THEN NULL WHEN i >= 1 THEN 'infinity'::DOUBLE WHEN i <= 0 THEN 0.0 ELSE i / (1 - i) END AS snr FROM s)
    SELECT seller, round(CASE WHEN snr = 'infinity'::DOUBLE THEN 0.0 ELSE v / (2 * 0.5 * (1 + snr) * (1 + snr)) END, 6) AS gain FROM r
    """,
)
def f15_marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance over (1 + snr) squared, by seller."""
    e = st.estimates(pairs(spark, sf_dir), ["seller"], "hat", "star")
    return e.select("seller", _r(marginal_gain("snr_shortcut", "var_star", 0.5)).alias("gain"))


@core.add(
    "x14_trend",
    f"WITH {PAIRS} SELECT query, 0.0 + round({nn('regr_slope(star, hat)')}, 6) AS slope, 0.0 + round({nn('regr_intercept(star, hat)')}, 6) AS intercept FROM pairs GROUP BY query",
)
def x14_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The straight line through each query's pairs."""
    return pairs(spark, sf_dir).groupBy("query").agg(_r(st.slope("hat", "star")).alias("slope"), _r(st.intercept("hat", "star")).alias("intercept"))


@core.add(
    "x15_count_diagnostics",
    f"""
    WITH {PAIRS}, c AS (SELECT seller, CAST(sum(n) AS BIGINT) AS n FROM pp GROUP BY seller), i AS (SELECT seller, {nn("regr_slope(star, hat)")} AS i FROM pairs GROUP BY seller),
    d AS (SELECT n, i, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rx, rank() OVER (ORDER BY i) + (count(*) OVER (PARTITION BY i) - 1) / 2.0 AS ry FROM c JOIN i USING (seller) WHERE i IS NOT NULL)
    SELECT 0.0 + round({nn("corr(n, i)")}, 6) AS pearson, 0.0 + round({nn("corr(rx, ry)")}, 6) AS spearman, count(*) AS n FROM d
    """,
)
def x15_count_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the slope depend on how many members a seller has?"""
    n = parts(spark, sf_dir).groupBy("seller").agg(F.sum("n").cast("double").alias("members"))
    i = pairs(spark, sf_dir).groupBy("seller").agg(st.slope("hat", "star").alias("i"))
    d = n.join(i, "seller").where("i is not null").withColumn("k", F.lit(0))
    rank = st.rank_correlation(d, ["k"], "members", "i").select(_r("spearman").alias("spearman"), "n", F.lit(0).alias("k"))
    return d.groupBy("k").agg(_r(st.pearson("members", "i")).alias("pearson")).join(rank, "k").drop("k")


@core.add(
    "p15_finite_mask",
    f"WITH {PAIRS} SELECT count(*) AS n FROM pairs WHERE isfinite(1 / nullif(hat - hat, 0)) OR isfinite(CASE WHEN query = 3 THEN 'nan'::DOUBLE WHEN query = 4 THEN 'infinity'::DOUBLE ELSE hat END)",
)
def p15_finite_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only finite values."""
    p = pairs(spark, sf_dir).withColumn("hat", F.when(F.col("query") == 3, float("nan")).when(F.col("query") == 4, float("inf")).otherwise(F.col("hat")))
    return p.where(st.is_finite("hat")).agg(F.count(F.lit(1)).alias("n"))


@core.add(
    "p16_single_method",
    f"WITH {PAIRS} SELECT seller, CAST('sum' AS VARCHAR) AS method, count(*) AS n FROM pp GROUP BY seller",
)
def p16_single_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one method; more than one is an error."""
    from tonearm.operators.matching import require_single

    return require_single(parts(spark, sf_dir).withColumn("method", F.lit("sum")), "method").groupBy("seller", "method").count().withColumnRenamed("count", "n")
