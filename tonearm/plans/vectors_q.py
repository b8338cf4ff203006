"""Queries of vectors and arrays: V1-V30, J12, F16-F26, L1-L13, A11 on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import arrays as ar
from tonearm.functions import scalar as sc
from tonearm.operators import attribution as at
from tonearm.operators import ranking as rk
from tonearm.operators import vectors as vx
from tonearm.plans.bases import EMB, embeddings
from tonearm.plans.registry import core
from tonearm.session import table

D = 64
_DOT = "list_dot_product({}, {})"


def _r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


@core.add("v01_unit_vectors", f"WITH {EMB} SELECT vec_id, round(v[1], 6) + 0.0 AS first, round(v[64], 6) + 0.0 AS last, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM u")
def v01_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length; their ends and norms."""
    e = embeddings(spark, sf_dir).select("vec_id", ar.unit("embedding").alias("v"))
    return e.select("vec_id", _r(F.get("v", 0)).alias("first"), _r(F.get("v", 63)).alias("last"), F.round(ar.norm("v"), 6).alias("norm"))


@core.add(
    "v02_paired_cosine",
    f"WITH {EMB} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS cosine FROM u a JOIN u b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0",
)
def v02_paired_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of vectors paired by position."""
    e = embeddings(spark, sf_dir)
    a = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("x"))
    b = e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", _r(ar.cosine("x", "y")).alias("cosine"))


@core.add(
    "v03_alignment",
    f"""
    WITH {EMB}, p AS (SELECT list_dot_product(a.e, b.e) / ((a.norm + 1e-8) * (b.norm + 1e-8)) AS c FROM emb a JOIN emb b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0)
    SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, count(*) AS n FROM p
    """,
)
def v03_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of paired cosines, without the matrix of all pairs."""
    e = embeddings(spark, sf_dir)
    a = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("x"))
    b = e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    out = vx.alignment(a.join(b, "vec_id"), "x", "y")
    return out.select(_r("mean").alias("mean"), _r("std").alias("std"), "n")


@core.add(
    "v04_query_cosines",
    f"WITH {EMB} SELECT q.vec_id AS query, t.vec_id AS train, round(list_dot_product(q.v, t.v), 6) + 0.0 AS score FROM u q JOIN u t ON q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0",
)
def v04_query_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of a stated set of queries with all train vectors."""
    e = embeddings(spark, sf_dir)
    s = at.gather_products(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "vec_id", "vec_id", "embedding")
    return s.withColumn("score", _r("score"))


_CODES = """
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS x FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, CAST(length(x) % 4 AS INTEGER) AS book, CAST(ascii(x) % 32 AS INTEGER) AS code FROM w)
"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("x"))
    return w.select("doc_id", (F.length("x") % 4).alias("book"), (F.ascii("x") % 32).alias("code"))


@core.add(
    "v05_code_histogram",
    f"""
    WITH {_CODES}, h AS (SELECT doc_id, book, code, count(*) AS n FROM c GROUP BY ALL),
    s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY doc_id, book) AS DOUBLE) AS w FROM h)
    SELECT doc_id, book, code, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 8) AS weight FROM s
    """,
)
def v05_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse histogram features of each document's codes, by code book."""
    return vx.code_histogram(_codes(spark, sf_dir), "doc_id", "book", "code", 32).withColumn("weight", F.round("weight", 8))


@core.add(
    "v06_feature_cosine",
    f"""
    WITH {_CODES}, h AS (SELECT doc_id, code, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT *, CAST(n AS DOUBLE) / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM h)
    SELECT a.doc_id, round(sum(a.w * b.w), 8) AS cosine FROM s a JOIN s b ON a.doc_id + 1 = b.doc_id AND a.code = b.code GROUP BY a.doc_id
    """,
)
def v06_feature_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each document's feature with that of the next id, from the sparse rows."""
    h = vx.code_histogram(_codes(spark, sf_dir), "doc_id", None, "code", 32)
    nxt = h.select((F.col("doc_id") - 1).alias("doc_id"), "code", F.col("weight").alias("w2"))
    return h.join(nxt, ["doc_id", "code"]).groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("w2")), 8).alias("cosine"))


@core.add("j12_similar_pairs", f"WITH {EMB} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4")
def j12_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with a cosine of 0.4 and more, by cells of pivots."""
    return vx.similar_pairs(embeddings(spark, sf_dir), "vec_id", "embedding", 0.4).withColumn("similarity", F.round("similarity", 6))


_GREEDY = """
    pr AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim FROM x a JOIN x b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {least}),
    nb AS (SELECT b AS id, list(a ORDER BY a) AS earlier FROM pr GROUP BY b),
    o AS (SELECT x.id, row_number() OVER (ORDER BY x.id) AS k, coalesce(earlier, []) AS e FROM x LEFT JOIN nb ON nb.id = x.id),
    g(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
                   SELECT o.k, CASE WHEN list_has_any(kept, e) THEN kept ELSE list_append(kept, id) END FROM g JOIN o ON o.k = g.k + 1),
    kp AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1))
    SELECT b AS drop_id, min(a) AS keep_id, round(arg_min(sim, a), 6) AS similarity FROM pr WHERE a IN (SELECT id FROM kp) AND b NOT IN (SELECT id FROM kp) GROUP BY b
"""


def _dropped(d: DataFrame) -> DataFrame:
    return d.select(F.col("drop").alias("drop_id"), F.col("keep").alias("keep_id"), F.round("similarity", 6).alias("similarity"))


@core.add("v07_greedy_dedup", f"WITH RECURSIVE {EMB}, x AS (SELECT u.vec_id AS id, u.v FROM u JOIN emb ON u.vec_id = emb.vec_id WHERE norm > 0), {_GREEDY.format(least=0.4)}")
def v07_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a greedy scan drops at 0.4, and for which earlier row."""
    return _dropped(vx.dedup(embeddings(spark, sf_dir), "vec_id", "embedding", 0.4))


@core.add(
    "v07_track_duplicates",
    f"""
    WITH RECURSIVE r AS (SELECT caption_id, CAST(audio_embedding AS DOUBLE[]) AS e FROM clap_embeddings WHERE len(audio_embedding) = 64 AND caption_id IS NOT NULL),
    q AS (SELECT caption_id, min(e) AS e FROM r WHERE len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y) OR abs(y) >= 1e30)) = 0 GROUP BY caption_id),
    w AS (SELECT caption_id AS id, e, sqrt(list_dot_product(e, e)) AS norm FROM q), x AS (SELECT id, list_transform(e, lambda y: y / norm) AS v FROM w WHERE norm > 0), {_GREEDY.format(least=0.95)}
    """,
)
def v07_track_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at 0.95 over the track vectors, per caption."""
    e = table(spark, sf_dir, "clap_embeddings").where("size(audio_embedding) = 64 and forall(audio_embedding, x -> x is not null and not isnan(x) and abs(x) < 1e30)")
    return _dropped(vx.dedup(e, "caption_id", "audio_embedding", 0.95))


_CENT = f"""
    {EMB}, x AS (SELECT label, unnest(range(64)) AS p, unnest(v) AS x FROM u), m AS (SELECT label, p, avg(x) AS x, count(*) AS n FROM x GROUP BY label, p),
    cn AS (SELECT label, sqrt(sum(x * x)) AS l, max(n) AS n FROM m GROUP BY label), c AS (SELECT m.label, p, x / l AS x, cn.n FROM m JOIN cn USING (label))
"""


def _unit_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label", ar.unit("embedding").alias("v"))


@core.add("v08_centroids", f"WITH {_CENT} SELECT label, p, round(x, 6) + 0.0 AS x FROM c")
def v08_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean directions by label."""
    c = vx.centroids(_unit_embeddings(spark, sf_dir), "label", "v")
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", F.col("p").cast("bigint").alias("p"), _r("x").alias("x"))


@core.add(
    "v09_coherence",
    f"""
    WITH {EMB} SELECT a.label, round(avg(list_dot_product(a.v, b.v)), 6) + 0.0 AS coherence FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label
    """,
)
def v09_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine within labels, by sums."""
    return vx.coherence(embeddings(spark, sf_dir), "label", "embedding").select("label", _r("coherence").alias("coherence"))


@core.add(
    "v11_distinctiveness",
    f"""
    WITH {_CENT}, g0 AS (SELECT p, avg(x) AS x FROM c GROUP BY p), g AS (SELECT p, x / sqrt((SELECT sum(x * x) FROM g0)) AS x FROM g0),
    tg AS (SELECT label, 1 - sum(c.x * g.x) AS to_grand FROM c JOIN g USING (p) GROUP BY label),
    tn AS (SELECT a.label, b.label AS other, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.p = b.p AND a.label <> b.label GROUP BY a.label, b.label)
    SELECT tg.label, round(to_grand, 6) AS to_grand, round(1 - max(s), 6) AS to_nearest FROM tg JOIN tn USING (label) GROUP BY tg.label, to_grand
    """,
)
def v11_distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each centroid from the grand centroid and from the nearest other."""
    d = vx.distinctiveness(vx.centroids(_unit_embeddings(spark, sf_dir), "label", "v"), "label")
    return d.select("label", _r("to_grand").alias("to_grand"), _r("to_nearest").alias("to_nearest"))


@core.add(
    "v12_centroid_scores",
    f"WITH {_CENT}, o AS (SELECT vec_id, unnest(range(64)) AS p, unnest(v) AS y FROM u WHERE vec_id % 10 = 0) SELECT vec_id AS query, label AS seller, round(sum(c.x * o.y), 6) + 0.0 AS a_hat FROM c JOIN o USING (p) GROUP BY vec_id, label",
)
def v12_centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each query with each centroid."""
    c = vx.centroids(_unit_embeddings(spark, sf_dir), "label", "v").select(F.col("label").alias("id"), F.col("centroid").alias("v"))
    q = embeddings(spark, sf_dir).where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    s = at.gather_products(q, c, "id", "id", "v")
    return s.select("query", F.col("train").cast("int").alias("seller"), _r("score").alias("a_hat"))


@core.add(
    "v13_quality_drop",
    f"WITH {EMB} SELECT a.vec_id, round(list_dot_product(a.v, t.v) - list_dot_product(b.v, t.v), 6) + 0.0 AS a_star FROM u a JOIN u b ON a.vec_id + 1 = b.vec_id JOIN u t ON a.vec_id + 2 = t.vec_id WHERE a.vec_id % 3 = 0",
)
def v13_quality_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the full output with its text less that of the reduced one."""
    e = embeddings(spark, sf_dir)
    side = lambda k, name: e.where(f"vec_id % 3 = {k}").select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    j = side(0, "full").join(side(1, "loo"), "vec_id").join(side(2, "text"), "vec_id")
    return j.select("vec_id", _r(ar.cosine("full", "text") - ar.cosine("loo", "text")).alias("a_star"))


# The inverse of the ridge matrix by Gauss-Jordan steps on its rows, with the unit matrix beside it; it needs no pivots.
_KERNEL = f"""
    {EMB}, tr AS (SELECT * FROM emb WHERE vec_id % 10 <> 0), qs AS (SELECT * FROM emb WHERE vec_id % 10 = 0),
    cell AS (SELECT i, j, sum(e[i] * e[j]) + CASE WHEN i = j THEN 1e-3 ELSE 0 END AS x FROM tr, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j),
    rw AS (SELECT i, list_concat(list(x ORDER BY j), list_transform(range(1, 65), lambda k: CASE WHEN k = i THEN 1.0 ELSE 0.0 END::DOUBLE)) AS row FROM cell GROUP BY i),
    gj(i, m) AS (SELECT CAST(1 AS BIGINT), list(row ORDER BY i) FROM rw UNION ALL
                 SELECT i + 1, list_transform(m, lambda row, k: CASE WHEN k = i THEN list_transform(row, lambda x: x / m[i][i])
                               ELSE list_transform(row, lambda x, c: x - row[i] / m[i][i] * m[i][c]) END) FROM gj WHERE i <= 64),
    iv AS (SELECT list_transform(m, lambda row: row[65:128]) AS m FROM gj WHERE i = 65),
    qw AS (SELECT vec_id, e, norm, list_transform(m, lambda row: list_dot_product(row, e)) AS w FROM qs, iv),
    ks AS (SELECT q.vec_id AS query, t.vec_id AS train, list_dot_product(q.w, t.e) AS score, list_dot_product(q.e, t.e) / (q.norm * t.norm) AS cosine FROM qw q, tr t)
"""


@core.add("v14_kernel_scores", f"WITH RECURSIVE {_KERNEL} SELECT query, train, round(score, 8) + 0.0 AS score FROM ks")
def v14_kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge-kernel scores of query vectors against all train vectors."""
    e = embeddings(spark, sf_dir)
    s = at.kernel_scores(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id", "vec_id", "embedding", D, 1e-3)
    return s.withColumn("score", _r("score", 8))


@core.add(
    "v14_rank_vs_cosine",
    f"""
    WITH RECURSIVE {_KERNEL}, rd AS (SELECT cosine, row_number() OVER (PARTITION BY query ORDER BY score DESC, train DESC) - 1 AS rank FROM ks)
    SELECT rank, round(avg(cosine), 6) + 0.0 AS mean, round(stddev_pop(cosine), 6) AS std, count(*) AS n FROM rd WHERE rank < 50 GROUP BY rank
    """,
)
def v14_rank_vs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine at each influence rank: kernel scores ranked, cosines gathered by rank."""
    e = embeddings(spark, sf_dir)
    train, queries = e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0")
    best = at.kernel_scores(train, queries, "vec_id", "vec_id", "embedding", D, most=50)
    ranked = rk.ranked_by_score(best, "query", "train", "score", 50)
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("x"))
    t = train.select(F.col("vec_id").alias("train"), F.col("embedding").alias("y"))
    cos = ranked.join(q, "query").join(t, "train").withColumn("cosine", ar.cosine("x", "y"))
    b = rk.by_rank(cos, "rank", "cosine")
    return b.select(F.col("rank").cast("bigint").alias("rank"), _r("mean").alias("mean"), _r("std").alias("std"), "n")


@core.add("v15_frechet")
def v15_frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two sets of vectors by mean and covariance."""
    e = embeddings(spark, sf_dir)
    d = vx.frechet_distance(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", D)
    return spark.createDataFrame([(d,)], "distance double")


_MMD = f"""
    {EMB}, a AS (SELECT * FROM emb WHERE vec_id % 2 = 0), b AS (SELECT * FROM emb WHERE vec_id % 2 = 1)
"""
_PLANE = """
    v AS (SELECT vec_id % 2 AS side, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
"""


@core.add(
    "v15_frechet_plane",
    f"""
    WITH {_PLANE}, m AS (SELECT side, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM v GROUP BY side),
    p AS (SELECT (l.mx - r.mx) * (l.mx - r.mx) + (l.my - r.my) * (l.my - r.my) AS d, l.a + l.c + r.a + r.c AS t, l.a * r.a + 2 * l.b * r.b + l.c * r.c AS tr,
                 (l.a * l.c - l.b * l.b) * (r.a * r.c - r.b * r.b) AS det FROM m l JOIN m r ON l.side = 0 AND r.side = 1)
    SELECT round(d + t - 2 * sqrt(tr + 2 * sqrt(det)), 9) AS distance FROM p
    """,
)
def v15_frechet_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the first two dimensions, where the root of a matrix has a closed form."""
    e = embeddings(spark, sf_dir)
    d = vx.frechet_distance(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", 2)
    return spark.createDataFrame([(d,)], "distance double").select(F.round("distance", 9).alias("distance"))


_G = "avg(exp(-greatest((x.norm * x.norm + y.norm * y.norm - 2 * list_dot_product(x.e, y.e)) / 64, 0) / 64))"


@core.add("l07_gaussian_discrepancy", f"WITH {_MMD} SELECT round((SELECT {_G} FROM a x, a y) + (SELECT {_G} FROM b x, b y) - 2 * (SELECT {_G} FROM a x, b y), 12) AS mmd")
def l07_gaussian_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a Gaussian kernel."""
    e = embeddings(spark, sf_dir)
    d = vx.discrepancy(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", "gaussian")
    return spark.createDataFrame([(d,)], "mmd double").select(F.round("mmd", 12).alias("mmd"))


@core.add(
    "v17_principal_plane",
    f"""
    WITH {_PLANE}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM v),
    w AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM m),
    n AS (SELECT mx, my, b / sqrt(b * b + (l - a) * (l - a)) AS p, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS q FROM w),
    s AS (SELECT mx, my, p * sign(CASE WHEN abs(p) >= abs(q) THEN p ELSE q END) AS p, q * sign(CASE WHEN abs(p) >= abs(q) THEN p ELSE q END) AS q FROM n)
    SELECT vec_id, round(p * (embedding[1] - mx) + q * (embedding[2] - my), 7) + 0.0 AS first,
           round(CASE WHEN abs(q) >= abs(p) THEN sign(q) * (q * (embedding[1] - mx) - p * (embedding[2] - my)) ELSE sign(p) * (p * (embedding[2] - my) - q * (embedding[1] - mx)) END, 7) + 0.0 AS second FROM embeddings, s
    """,
)
def v17_principal_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two dimensions turned to their directions of largest variance."""
    p = vx.projected(embeddings(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 2).alias("embedding")), "embedding", 2, 2)
    return p.select("vec_id", _r(F.get("projection", 0), 7).alias("first"), _r(F.get("projection", 1), 7).alias("second"))


_K = "avg(1 / (1 + greatest((x.norm * x.norm + y.norm * y.norm - 2 * list_dot_product(x.e, y.e)) / 64, 0) / 2))"


@core.add("v16_discrepancy", f"WITH {_MMD} SELECT round((SELECT {_K} FROM a x, a y) + (SELECT {_K} FROM b x, b y) - 2 * (SELECT {_K} FROM a x, b y), 10) AS mmd")
def v16_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum mean discrepancy of two sets."""
    e = embeddings(spark, sf_dir)
    d = vx.discrepancy(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding")
    return spark.createDataFrame([(d,)], "mmd double").select(F.round("mmd", 10).alias("mmd"))


@core.add("v17_principal_components")
def v17_principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the three directions of largest variance."""
    return vx.projected(embeddings(spark, sf_dir), "embedding", D, 3).select("vec_id", "label", "projection")


@core.add(
    "v18_histogram",
    """
    WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), e AS (SELECT i, a + (b - a) * i / 50 AS low, a + (b - a) * (i + 1) / 50 AS high FROM m, range(50) t(i)),
    c AS (SELECT len(list_filter(list_transform(range(1, 50), lambda i: a + (b - a) * i / 50), lambda x: x <= l_extendedprice)) AS bin FROM lineitem, m)
    SELECT CAST(i AS INTEGER) AS bin, round(low, 4) AS low, count(c.bin) AS n FROM e LEFT JOIN c ON c.bin = i GROUP BY i, low
    """,
)
def v18_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty bins of a column, the last closed on both sides."""
    return vx.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50).select("bin", F.round("low", 4).alias("low"), "n")


_SIG = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:(vec_id % 20 + 1)] AS s FROM embeddings)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 20 + 1).cast("int")).alias("s"))


@core.add(
    "v19_pad_crop",
    f"""
    WITH {_SIG} SELECT vec_id, list_concat(s[1:10], list_transform(range(greatest(10 - len(s), 0)), lambda i: 0.0::DOUBLE)) AS padded,
           CAST(least(len(s), 10) AS INTEGER) AS n_real FROM v
    """,
)
def v19_pad_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten values of each signal, padded, and how many are real."""
    return _signals(spark, sf_dir).select("vec_id", ar.pad_crop("s", 10).alias("padded"), F.size(F.filter(ar.pad_mask("s", 10), lambda x: x == 1)).alias("n_real"))


@core.add(
    "v20_masks",
    f"""
    WITH {_SIG}, m AS (SELECT vec_id, list_transform(s, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM v)
    SELECT vec_id, list_transform(range(7), lambda i: m[CAST(floor(i * len(m) / 7.0) AS BIGINT) + 1]) AS resized,
           CAST(coalesce(list_max(list_filter(list_transform(m, lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda j: j IS NOT NULL)), -1) AS INTEGER) AS last_one FROM m
    """,
)
def v20_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks resized to seven places, and their last one."""
    m = _signals(spark, sf_dir).select("vec_id", F.transform("s", lambda x: F.when(x > 0, 1).otherwise(0)).alias("m"))
    return m.select("vec_id", ar.resize_nearest("m", 7).alias("resized"), ar.last_set("m").cast("int").alias("last_one"))


@core.add(
    "v22_channels",
    f"WITH {_SIG} SELECT vec_id, list_transform(s, lambda x: (x + 2 * x + 3 * x) / 3) AS mono, len(s) AS n, 3 AS channels FROM v",
)
def v22_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels mixed to one, and two tiled to three."""
    three = F.array(F.col("s"), F.transform("s", lambda x: 2 * x), F.transform("s", lambda x: 3 * x))
    s = _signals(spark, sf_dir)
    return s.select("vec_id", F.get(ar.adapt_channels(three, 1), 0).alias("mono"), F.size("s").cast("bigint").alias("n"), F.size(ar.adapt_channels(F.slice(three, 1, 2), 3)).alias("channels"))


@core.add(
    "v23_silence_runs",
    f"""
    WITH {_SIG}, c AS (SELECT vec_id, unnest(range(len(s))) AS p, unnest(s) AS x FROM v), q AS (SELECT vec_id, p, p - row_number() OVER (PARTITION BY vec_id ORDER BY p) AS g FROM c WHERE abs(x) < 0.1)
    SELECT vec_id, CAST(min(p) AS INTEGER) AS start, count(*) AS size FROM q GROUP BY vec_id, g
    """,
)
def v23_silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of quiet samples."""
    return vx.silence_runs(_signals(spark, sf_dir), "vec_id", "s", 0.1)


@core.add(
    "v23_compact_silence",
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings), c AS (SELECT vec_id, unnest(range(64)) AS p, unnest(s) AS x FROM v),
    q AS (SELECT vec_id, p, p - row_number() OVER (PARTITION BY vec_id ORDER BY p) AS g FROM c WHERE abs(x) < 0.15), r AS (SELECT vec_id, min(p) AS a, max(p) + 1 AS b FROM q GROUP BY vec_id, g HAVING count(*) > 3),
    f AS (SELECT vec_id, a, b, a + CASE WHEN b - a > 6 THEN CAST(floor(('0x' || md5('9|' || vec_id || '|' || a)[1:10])::BIGINT / 1099511627776.0 * (b - a - 6 + 1)) AS BIGINT) ELSE 0 END AS f FROM r)
    SELECT v.vec_id, list(x ORDER BY p) AS compact FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN f ON f.vec_id = c.vec_id AND p >= a AND p < b WHERE f.a IS NULL OR (p >= f AND p < f + 6) GROUP BY v.vec_id
    """,
)
def v23_compact_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals of which quiet stretches of more than three values keep six at most."""
    e = embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("compact"))
    return vx.compact_silence(e, "vec_id", "compact", 12, 0.15, 0.5, 0.25, 9)


@core.add(
    "v29_code_matrix",
    """
    SELECT n_nationkey, [[n_nationkey, 2, 5], [1, 3, 6]] AS flat, [[n_nationkey, 2, 5], [1, 3, 6]] AS turned, [[n_nationkey, 1], [2, 3]] AS one_of_many, [[n_nationkey, 2, 5]] AS thin FROM nation
    """,
)
def v29_code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of several shapes as [book][frame]."""
    k, i = F.col("n_nationkey"), lambda x: F.lit(x).cast("bigint")
    m = F.array(F.array(k, i(2), i(5)), F.array(i(1), i(3), i(6)))
    t = F.array(F.array(k, i(1)), F.array(i(2), i(3)), F.array(i(5), i(6)))
    square = F.array(F.array(k, i(1)), F.array(i(2), i(3)))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        ar.code_matrix(m).alias("flat"),
        ar.code_matrix(F.array(t), deep=True).alias("turned"),
        ar.code_matrix(F.array(square, t), deep=True).alias("one_of_many"),
        ar.code_matrix(F.array(F.array(F.array(k)), F.array(F.array(i(2))), F.array(F.array(i(5)))), deep=True).alias("thin"),
    )


@core.add(
    "v24_centred_clip",
    f"""
    WITH {_SIG}, o AS (SELECT vec_id, s, CAST(floor(greatest(len(s) - 6, 0) / 2.0) AS BIGINT) AS a FROM v)
    SELECT vec_id, list_concat(s[a + 1:a + 6], list_transform(range(greatest(6 - len(s), 0)), lambda i: 0.0::DOUBLE)) AS clip FROM o
    """,
)
def v24_centred_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six values around the middle."""
    return _signals(spark, sf_dir).select("vec_id", ar.centred_clip("s", 6).alias("clip"))


@core.add(
    "v25_patches",
    f"""
    WITH {_SIG}, w AS (SELECT vec_id, list_concat(s, list_transform(range((4 - len(s) % 4) % 4), lambda i: 0.0::DOUBLE)) AS s FROM v)
    SELECT vec_id, list_transform(range(4), lambda h: list_transform(range(len(s) // 4), lambda i: s[i * 4 + h + 1])) AS folded, s AS back FROM w
    """,
)
def v25_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals folded into four rows and unfolded again."""
    f = _signals(spark, sf_dir).select("vec_id", ar.fold_patches("s", 4).alias("folded"))
    return f.withColumn("back", ar.unfold_patches("folded"))


@core.add("v26_mixed_radix", "SELECT p_partkey, [CAST(p_partkey % 8 AS INTEGER), CAST(p_partkey // 8 % 5 AS INTEGER), CAST(p_partkey // 40 % 5 AS INTEGER)] AS digits, p_partkey % 200 AS back FROM part")
def v26_mixed_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as digits and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", ar.index_to_digits("p_partkey", [8, 5, 5]).alias("digits"))
    return p.withColumn("back", ar.digits_to_index("digits", [8, 5, 5]))


@core.add(
    "v27_soft_mask",
    """
    WITH a AS (SELECT n_nationkey, floor((n_nationkey + 10)::DOUBLE / 100 * 100) AS a FROM nation),
    m AS (SELECT n_nationkey, list_transform(range(100), lambda i: 0.75 * CASE WHEN i >= 60 AND i < 80 THEN 0.5 - 0.5 * cos(2 * pi() * (i - 40) / 39) WHEN i >= a AND i < a + 10 THEN 0.5 - 0.5 * cos(2 * pi() * (i - a) / 19)
                  WHEN i >= a AND i < 80 THEN 1.0 ELSE 0.0 END) AS m FROM a)
    SELECT n_nationkey, list_transform(m, lambda x: round(x, 9)) AS mask, list_transform(m, lambda x: CAST(CASE WHEN x <= 0.5 THEN 1 ELSE 0 END AS INTEGER)) AS binary FROM m
    """,
)
def v27_soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft masks, and what they are at some step."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", ar.soft_mask(100, (F.col("n_nationkey") + 10).cast("double"), 80, 10, 20, 0.25).alias("mask"))
    n = n.withColumn("binary", ar.binary_mask_at("mask", 4, 10))
    return n.withColumn("mask", F.transform("mask", lambda x: F.round(x, 9)))


_PAIR = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings), p AS (SELECT a.vec_id, a.s AS a, b.s AS b FROM v a JOIN v b ON a.vec_id + 20 = b.vec_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embeddings(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return s.join(s.select((F.col("vec_id") - 20).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@core.add(
    "l01_masked_errors",
    f"""
    WITH {_PAIR}, x AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p)
    SELECT vec_id, round(avg(abs(a - b)), 8) AS l1, round(avg((a - b) * (a - b)), 8) AS mse, round(avg(CASE WHEN a > 0 THEN abs(a - b) END), 8) AS l1_masked,
           round(avg(CASE WHEN a > 0 THEN (a - b) * (a - b) END), 8) AS mse_masked FROM x GROUP BY vec_id
    """,
)
def l01_masked_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute and squared differences, all and masked."""
    mask = F.transform("a", lambda x: x > 0)
    got = {"l1": ar.masked_l1("a", "b"), "mse": ar.masked_mse("a", "b"), "l1_masked": ar.masked_l1("a", "b", mask), "mse_masked": ar.masked_mse("a", "b", mask)}
    return _pairs(spark, sf_dir).select("vec_id", *(F.round(c, 8).alias(n) for n, c in got.items()))


@core.add(
    "l02_image_loss",
    f"WITH {_PAIR} SELECT vec_id, round(0.5 * (1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))), 8) AS loss, round(2.0 * pow(0.9, 3), 8) AS weight FROM p",
)
def l02_image_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of one less the cosine, with a weight that decayed three times (L2, L3)."""
    return _pairs(spark, sf_dir).select("vec_id", F.round(ar.image_loss("a", "b"), 8).alias("loss"), F.round(sc.decayed_weight(2.0, 0.9, F.lit(3)), 8).alias("weight"))


_SDR = """
    WITH {pair}, x AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p), m AS (SELECT vec_id, a - avg(a) OVER (PARTITION BY vec_id) AS a, b - avg(b) OVER (PARTITION BY vec_id) AS b FROM x),
    s AS (SELECT vec_id, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * a) AS aa FROM m GROUP BY vec_id), t AS (SELECT *, ab / (bb + 1e-8) AS k FROM s)
    SELECT vec_id, round(-10 * log10(k * k * bb / (aa - 2 * k * ab + k * k * bb + 1e-8) + 1e-8), 5) + 0.0 AS si_sdr, round(-10 * log10(k * k * bb / (aa - 2 * ab + bb + 1e-8) + 1e-8), 5) + 0.0 AS sd_sdr FROM t
"""


@core.add("l04_distortion_ratios", _SDR.format(pair=_PAIR))
def l04_distortion_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale-invariant and scale-dependent signal-to-distortion ratios."""
    return _pairs(spark, sf_dir).select("vec_id", _r(ar.distortion_ratio("a", "b"), 5).alias("si_sdr"), _r(ar.distortion_ratio("a", "b", scaled=False), 5).alias("sd_sdr"))


@core.add(
    "l05_gaussian_kl",
    f"""
    WITH {_PAIR}, x AS (SELECT vec_id, unnest(a) AS m, ln(1 + exp(unnest(b))) + 1e-4 AS sd FROM p)
    SELECT vec_id, round(sum(m * m + sd * sd - ln(sd * sd) - 1), 6) AS kl FROM x GROUP BY vec_id
    """,
)
def l05_gaussian_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence from the standard normal distribution."""
    return _pairs(spark, sf_dir).select("vec_id", F.round(ar.gaussian_kl("a", "b"), 6).alias("kl"))


@core.add(
    "l06_moment_penalty",
    """
    WITH c AS (SELECT label, vec_id, unnest(range(64)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
    r AS (SELECT avg(x) AS m, greatest(var_samp(x), 1e-4) AS v FROM c GROUP BY label, vec_id), k AS (SELECT avg(x) AS m, greatest(var_samp(x), 1e-4) AS v FROM c GROUP BY label, p),
    t AS (SELECT (SELECT avg(m * m + v - ln(v) - 1) FROM r) AS a, (SELECT avg(m * m + v - ln(v) - 1) FROM k) AS b)
    SELECT round(a, 8) AS along_rows, round(b, 8) AS along_positions, round(a + 0.4 * b, 8) AS penalty FROM t
    """,
)
def l06_moment_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of means and variances from 0 and 1, along rows and positions."""
    m = vx.moment_penalty(embeddings(spark, sf_dir), "label", "embedding")
    return m.select(*(F.round(c, 8).alias(c) for c in m.columns))


@core.add(
    "l08_cross_entropy",
    f"""
    WITH {_PAIR}, x AS (SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS book, a, CAST(vec_id % 64 AS INTEGER) AS target, vec_id % 7 <> 0 AS counted FROM p),
    e AS (SELECT book, counted, ln(list_sum(list_transform(a, lambda v: exp(v)))) - a[target + 1] AS ce FROM x)
    SELECT book, round(avg(ce), 6) AS ce, round(avg(CASE WHEN counted THEN ce END), 6) AS masked, count(CASE WHEN counted THEN 1 END) AS n FROM e GROUP BY book
    """,
)
def l08_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy by code book over all steps and over the unmasked ones."""
    k = F.col("vec_id")
    ce = ar.cross_entropy("a", k % 64)
    masked = F.when(k % 7 != 0, ce)
    return _pairs(spark, sf_dir).groupBy((k % 4).cast("int").alias("book")).agg(F.round(F.avg(ce), 6).alias("ce"), F.round(F.avg(masked), 6).alias("masked"), F.count(masked).alias("n"))


@core.add(
    "l09_inverse_decay",
    "SELECT n_nationkey, round((1 - pow(0.99, n_nationkey + 1)) * greatest(0.00001, 0.001 * pow(1 + n_nationkey / 10.0, -0.5)), 12) AS lr FROM nation",
)
def l09_inverse_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decaying rate with warm-up."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(sc.inverse_decay("n_nationkey", 0.001, 10.0, 0.5, 0.99, 0.00001), 12).alias("lr"))


@core.add("l11_prefix_maps", "SELECT n_nationkey, 1 AS n_own, 2 AS n_rest, n_name AS own FROM nation")
def l11_prefix_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a map by the prefix of their key."""
    m = F.create_map(F.lit("enc_name"), F.col("n_name"), F.lit("dec_x"), F.lit("1"), F.lit("y"), F.lit("2"))
    own, rest = ar.split_by_prefix("m", "enc_")
    n = table(spark, sf_dir, "nation").withColumn("m", m)
    return n.select("n_nationkey", F.size(own).alias("n_own"), F.size(rest).alias("n_rest"), F.try_element_at(own, F.lit("name")).alias("own"))


@core.add(
    "f17_scaling",
    """
    SELECT p_partkey, (least(greatest(p_retailprice, 950), 1200) - 950) / 250 AS scaled, CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 0 END AS BIGINT) AS option_no,
           CASE WHEN p_size <= 0 THEN 30.0 ELSE least(CAST(p_size AS DOUBLE), 30.0) END AS seconds FROM part
    """,
)
def f17_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped and scaled numbers, options as numbers, bounded durations."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        sc.min_max("p_retailprice", 950.0, 1200.0).alias("scaled"),
        sc.option_index("p_type", ["ECONOMY", "STANDARD"]).alias("option_no"),
        sc.seconds_total(F.col("p_size").cast("double"), 30.0).alias("seconds"),
    )


@core.add(
    "f19_samples",
    f"""
    WITH {_SIG} SELECT vec_id, list_transform(s, lambda x: CAST(trunc(least(greatest(x * 8, -1.0), 1.0) * 32767.0) AS SMALLINT)) AS pcm,
           round(list_max(list_transform(s, lambda x: abs(x / list_max(list_transform(s, lambda y: abs(y)))))), 8) AS peak FROM v
    """,
)
def f19_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples clipped to 16 bits, and normalised by their peak."""
    loud = F.transform("s", lambda x: x * 8)
    return _signals(spark, sf_dir).select("vec_id", sc.to_int16(loud).alias("pcm"), F.round(ar.norm(sc.peak_normalise("s"), float("inf")), 8).alias("peak"))


@core.add(
    "f20_schedules",
    """
    WITH t AS (SELECT n_nationkey, n_nationkey / 24.0::DOUBLE AS t FROM nation), g AS (SELECT *, exp(-(0.5 + 0.65 * (least(greatest(n_nationkey * 100, 256), 4096) - 256) / 3840.0)) AS g FROM t)
    SELECT n_nationkey, round(cos(t * pi() / 2), 9) + 0.0 AS alpha, round(sin(t * pi() / 2), 9) + 0.0 AS sigma, round(t, 9) AS back,
           round(CASE WHEN t >= 1 THEN 1.0 ELSE 1 - g / (g + (1 / (1 - t) - 1)) END, 9) + 0.0 AS shifted FROM g
    """,
)
def f20_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine schedule, its inverse, and times shifted by length."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 24.0).alias("t"))
    a, s = sc.cosine_schedule("t")
    shifted = sc.shifted_time("t", F.col("n_nationkey") * 100)
    return n.select("n_nationkey", _r(a, 9).alias("alpha"), _r(s, 9).alias("sigma"), _r(sc.schedule_time(a, s), 9).alias("back"), _r(shifted, 9).alias("shifted"))


@core.add(
    "f22_timesteps",
    """
    SELECT n_nationkey, list_transform(range(0, 1000, greatest(1, CAST(1000 // (n_nationkey + 1) AS BIGINT)))[1:n_nationkey + 1], lambda x: CAST(x AS INTEGER)) AS uniform,
           list_transform(range(n_nationkey + 1), lambda x: CAST(x AS INTEGER)) AS cumulative FROM nation
    """,
)
def f22_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picked timesteps, strided and from the start."""
    k = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").select("n_nationkey", sc.picked_timesteps(k, F.lit(1000)).alias("uniform"), sc.picked_timesteps(k, F.lit(1000), uniform=False).alias("cumulative"))


@core.add(
    "f23_power_db",
    f"""
    WITH {_SIG}, d AS (SELECT vec_id, list_transform(s, lambda x: 10 * log10(greatest(x * x * x * x, 1e-10))) AS d FROM v)
    SELECT vec_id, list_transform(d, lambda x: round(greatest(x, list_max(d) - 80), 6) + 0.0) AS db FROM d
    """,
)
def f23_power_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers in dB with a floor under the largest."""
    d = _signals(spark, sf_dir).select("vec_id", ar.power_to_db(F.transform("s", lambda x: x * x * x * x)).alias("d"))
    return d.select("vec_id", F.transform("d", lambda x: F.round(x, 6) + F.lit(0.0)).alias("db"))


@core.add(
    "f24_functionals",
    f"""
    WITH {_PAIR}, x AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p)
    SELECT vec_id, round(avg(a), 8) + 0.0 AS mean, round(sum(abs(a)), 8) AS l1, round(sqrt(sum(a * a)), 8) AS l2, max(abs(a)) AS linf, round(avg(a * a), 8) AS mean_square, round(avg((a - b) * (a - b)), 8) AS loss FROM x GROUP BY vec_id
    """,
)
def f24_functionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functionals of predictions."""
    got = {"mean": ar.mean("a"), "l1": ar.norm("a", 1.0), "l2": ar.norm("a"), "mean_square": ar.mean_square("a"), "loss": ar.mean_square("a", "b")}
    return _pairs(spark, sf_dir).select("vec_id", *(_r(c, 8).alias(n) for n, c in got.items()), ar.norm("a", float("inf")).alias("linf"))


@core.add(
    "f26_crop_times",
    """
    SELECT p_partkey, p_size / CAST(greatest(p_partkey - 30, 0) + 30 AS DOUBLE) AS t_start, (p_size + 30) / CAST(greatest(p_partkey - 30, 0) + 30 AS DOUBLE) AS t_end,
           CAST(floor(p_size / 10.0) AS BIGINT) AS seconds_start, CAST(ceil(p_partkey / 10.0) AS BIGINT) AS seconds_total FROM part
    """,
)
def f26_crop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a crop."""
    return table(spark, sf_dir, "part").select("p_partkey", *sc.crop_times("p_size", "p_partkey", 30, 10))
