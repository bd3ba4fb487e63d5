"""Sampling, set, memory and fit queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, memory, sampling
from .bind import TRACKS_SQL, embedding_dims, embedding_sql, query, rounded, table, track_table


def _lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.floor(F.col("l_quantity") / 10).alias("cx"), F.floor(F.col("l_discount") * 50).alias("cy"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))


_LINES = "l AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey, l_suppkey, l_quantity, l_extendedprice, floor(l_quantity / 10)::BIGINT AS cx, floor(l_discount * 50)::BIGINT AS cy, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)"


def _distinct_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("id").agg(F.max("l_extendedprice").alias("score"), F.min("cx").alias("cx"), F.min("cy").alias("cy"), F.min("month").alias("month"))


_DISTINCT = f"{_LINES}, u AS (SELECT id, max(l_extendedprice) AS score, min(cx) AS cx, min(cy) AS cy, min(month) AS month FROM l GROUP BY id)"


@query(f"WITH {_DISTINCT} SELECT id, score FROM u ORDER BY score DESC, id LIMIT 100")
def topk_by_score(spark, sf_dir):
    return sampling.top_k(_distinct_lines(spark, sf_dir).select("id", "score"), "score", "id", 100)


@query(f"WITH {_DISTINCT}, r AS (SELECT id, cx, cy, row_number() OVER (PARTITION BY cx, cy ORDER BY score DESC, id) AS k FROM u) SELECT id, cx, cy, k AS rank_in_cell FROM r ORDER BY k, cx, cy LIMIT 100")
def grid_balanced_topk(spark, sf_dir):
    d = sampling.balanced_top_k(_distinct_lines(spark, sf_dir), ["cx", "cy"], "score", "id", 100)
    return d.select("id", "cx", "cy", F.col("rank_in_cell").cast("long").alias("rank_in_cell"))


@query(f"""WITH {_DISTINCT}, f AS (SELECT count(DISTINCT month) AS n, max(month) AS last FROM u), r AS (SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY (id % 2147483647) * 742938285 % 2147483647, id) AS k FROM u)
SELECT id, month FROM r, f WHERE k <= CASE WHEN month = last THEN 1000 - 1000 // n * (n - 1) ELSE 1000 // n END""")
def quota_sample(spark, sf_dir):
    return sampling.quota_sample(_distinct_lines(spark, sf_dir), "month", "id", 1000).select("id", "month")


@query(f"""WITH {_DISTINCT}, r AS (SELECT id, cx, row_number() OVER (PARTITION BY cx ORDER BY (id % 2147483647) * 742938285 % 2147483647, id) AS k FROM u)
SELECT id, cx FROM r WHERE k <= (SELECT ceil(100.0 / count(DISTINCT cx)) FROM u) ORDER BY cx, k LIMIT 100""")
def ceil_quota_sample(spark, sf_dir):
    return sampling.ceil_quota_sample(_distinct_lines(spark, sf_dir), "cx", "id", 100).select("id", "cx")


@query(f"""WITH {_DISTINCT}, r AS (SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY (id % 2147483647) * 742938285 % 2147483647, id) AS k, count(*) OVER (PARTITION BY month) AS n FROM u)
SELECT id, month FROM r WHERE k <= greatest(n // 8, 64)""")
def thinned_sample(spark, sf_dir):
    return sampling.thin(_distinct_lines(spark, sf_dir), "month", "id").select("id", "month")


@query(f"""WITH {_DISTINCT}, r AS (SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY month) AS n FROM u)
SELECT id, month FROM r WHERE i % greatest(1, n // 50) = 0 AND i // greatest(1, n // 50) < 50""")
def stride_cap(spark, sf_dir):
    return sampling.cap_by_stride(_distinct_lines(spark, sf_dir), "month", "id", 50).select("id", "month")


@query("SELECT vec_id AS frame, y * 8 + x AS point_id, x, y FROM embeddings, (SELECT unnest([0, 3, 6]) AS y), (SELECT unnest([0, 3, 6]) AS x) WHERE embedding[y * 8 + x + 1] > 0")
def query_grid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v > 0).alias("m"))
    return sampling.query_grid(e, "m", 3)


_PART = "SELECT p_partkey, ln(p_size + 0.0) AS s, p_size > 40 AS big, p_retailprice % 7 > 4.5 AS high FROM part"


@query(f"""WITH p AS ({_PART}), d AS (SELECT p_partkey, 0 AS copy, s FROM p WHERE NOT (high AND big) UNION ALL SELECT p_partkey, 1, s FROM p WHERE high AND NOT big
UNION ALL SELECT p_partkey, unnest([2, 3]), s - ln(1.6) FROM p WHERE high AND big) SELECT p_partkey, copy, round(s, 5) AS s FROM d WHERE NOT s > 3.8""")
def densify_cull(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.ln(F.col("p_size").cast("double")).alias("s"), (F.col("p_size") > 40).alias("big"), (F.col("p_retailprice") % 7 > 4.5).alias("high"))
    d = sampling.densify(p, F.col("high") & F.col("big"), F.col("high") & ~F.col("big"), ["s"])
    return rounded(sampling.cull(d, F.col("s") > 3.8).select("p_partkey", "copy", "s"))


@query("""SELECT p_partkey, p_retailprice > 1000 AND (p_size > 30 OR p_partkey % 10 > 8) AS should_split, p_retailprice > 1000 AND NOT p_size > 30 AS should_dup,
  p_partkey % 100 < 5 OR p_size > 45 OR p_partkey % 10 > 8 AS should_cull FROM part""")
def control_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = sampling.control_predicates(p, F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 10, F.col("p_partkey") % 100, grad_limit=1000, scale_limit=30, screen_limit=8, least_opacity=5, cull_scale=F.lit(45), by_screen=True, by_scale=True)
    return out.select("p_partkey", "should_split", "should_dup", "should_cull")


@query("""SELECT event_id AS step, event_id > 200 AND event_id % 100 = 0 AND event_id < 4000 AS ready, event_id > 200 AND event_id % 100 = 0 AND event_id < 4000 AND event_id % 3000 > 80 AS densify,
  event_id > 200 AND event_id % 100 = 0 AND event_id < 4000 AND event_id % 3000 > 240 AS cull, event_id > 200 AND event_id % 100 = 0 AND event_id < 4000 AND event_id % 3000 = 0 AS reset FROM events""")
def control_schedule(spark, sf_dir):
    return sampling.control_schedule(table(spark, sf_dir, "events").select(F.col("event_id").alias("step")), frames=80)


@query("""SELECT event_id // 100 AS win, user_id, round(sum(value), 4) AS grad_sum, count(*) AS vis_count, max(event_id % 23) AS max_radius, round(sum(value) / greatest(count(*), 1), 4) AS grad_avg FROM events WHERE event_id % 23 > 0 GROUP BY ALL""")
def step_window_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("radius", F.col("event_id") % 23)
    return rounded(sampling.running_stats(e, "event_id", "user_id", "value", "radius").withColumnRenamed("window", "win").select("win", "user_id", "grad_sum", "vis_count", "max_radius", "grad_avg"), 4)


@query("WITH d AS (SELECT DISTINCT label FROM embeddings), r AS (SELECT label, row_number() OVER (ORDER BY label) AS dense_id FROM d) SELECT vec_id, dense_id FROM embeddings JOIN r USING (label)")
def label_remap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.join(sampling.dense_labels(e, "label"), "label").select("vec_id", F.col("dense_id").cast("long").alias("dense_id"))


@query("SELECT user_id, max((event_type = 'click')::INT) AS is_click, max((event_type = 'error')::INT) AS is_error FROM events GROUP BY ALL")
def one_hot_labels(spark, sf_dir):
    return sampling.one_hot(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error"])


@query("SELECT user_id % 50 AS pixel, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def mask_overlay(spark, sf_dir):
    return sampling.overlay(table(spark, sf_dir, "events").withColumn("pixel", F.col("user_id") % 50), ["pixel"], "event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def worklist_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.missing_work(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return sampling.require_matches(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_nationkey")


@query("SELECT n_nationkey AS id, 'nation' AS part FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def union_parts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("part"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit("region").alias("part")))


@query("SELECT event_id, user_id FROM events WHERE event_id % 7 = 0")
def strided_subsample(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(7)) == 0).select("event_id", "user_id")


@query(f"""WITH {TRACKS_SQL}, d AS (SELECT t AS f, track_id, bool_or(visible) AS v FROM tracks GROUP BY ALL)
SELECT a.f AS src, b.f AS dst, count(*) AS covisible FROM d a JOIN d b ON a.track_id = b.track_id WHERE a.v AND b.v GROUP BY ALL""")
def pair_covisible(spark, sf_dir):
    d = track_table(spark, sf_dir).groupBy(F.col("t").alias("f"), "track_id").agg(F.bool_or("visible").alias("v")).where("v")
    a, b = d.select(F.col("f").alias("src"), "track_id"), d.select(F.col("f").alias("dst"), "track_id")
    out = a.join(b, "track_id").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("covisible"))
    return out.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "covisible")


# --- memory ------------------------------------------------------------------------


def _weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("key"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("key").alias("query_key"))
    best = memory.best_elements(e, q, "vec_id", "key", "query", "query_key", 30)
    return memory.top_k_weights(best, ["query"], "vec_id", "score", 30)


_SCORES = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS k FROM embeddings),
s AS (SELECT q.vec_id AS query, m.vec_id, m.k[1:4] AS v, round((2 * list_inner_product(m.k, q.k) - list_inner_product(m.k, m.k)) / 8, 10) AS score FROM e m JOIN e q ON q.vec_id % 50 = 0 AND m.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k, max(score) OVER (PARTITION BY query) AS top FROM s),
w AS (SELECT *, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY query) AS weight FROM r WHERE k <= 30)"""


@query(f"WITH {_SCORES} SELECT query, {', '.join(f'round(sum(weight * v[{i + 1}]), 5) AS r{i}' for i in range(4))} FROM w GROUP BY query")
def topk_softmax_readout(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("value"))
    r = memory.read_out(_weights(spark, sf_dir).join(values, "vec_id"), ["query"], "value")
    return rounded(r.select("query", *(F.get("read", F.lit(i)).alias(f"r{i}") for i in range(4))))


@query(f"WITH {_SCORES} SELECT vec_id, round(sum(weight), 5) AS use FROM w GROUP BY vec_id")
def memory_usage(spark, sf_dir):
    return rounded(memory.usage(_weights(spark, sf_dir), "vec_id"))


_MEM = "m AS (SELECT event_type AS grp, user_id AS elem, count(*) AS use, 1 + max(event_id) - min(event_id) AS life FROM events GROUP BY ALL)"


def _memory(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("elem")).agg(F.count(F.lit(1)).alias("use"), (1 + F.max("event_id") - F.min("event_id")).alias("life"))


@query(f"""WITH {_MEM}, r AS (SELECT *, use / life AS q, row_number() OVER (PARTITION BY grp ORDER BY use / life) AS k, count(*) OVER (PARTITION BY grp) - 100 AS surplus FROM m),
l AS (SELECT *, max(CASE WHEN k <= surplus THEN q END) OVER (PARTITION BY grp) AS lim FROM r) SELECT grp, elem, use, life FROM l WHERE lim IS NULL OR q > lim""")
def evict_least_used(spark, sf_dir):
    return memory.evict_least_used(_memory(spark, sf_dir), "grp", "use", "life", 100)


@query(f"WITH {_MEM}, p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY elem) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM m) SELECT grp, elem FROM p WHERE i < 10 OR i >= n - 20")
def memory_sieve(spark, sf_dir):
    return memory.sieve(_memory(spark, sf_dir), "grp", "elem", 10, -20).select("grp", "elem")


@query(f"WITH {_MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY use / life DESC, elem) AS k FROM m) SELECT grp, elem, k AS rank FROM r WHERE k <= 16")
def memory_prototypes(spark, sf_dir):
    return memory.prototypes(_memory(spark, sf_dir), "grp", "use", "life", "elem", 16).select("grp", "elem", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id, label AS grp, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS k, (vec_id * 37) % 101 + 1 AS use FROM embeddings),
p AS (SELECT grp, vec_id AS proto, k AS pk FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY use / 1.0 DESC, vec_id) AS r FROM e) WHERE r <= 4),
s AS (SELECT p.grp, proto, e.k, (2 * list_inner_product(e.k, pk) - list_inner_product(e.k, e.k)) / sqrt(8.0) AS sc FROM p JOIN e USING (grp)),
w AS (SELECT *, exp(sc - max(sc) OVER v) / sum(exp(sc)) OVER v * exp(max(sc) OVER v) AS weight FROM s WINDOW v AS (PARTITION BY grp, proto))
SELECT grp, proto AS vec_id, round(sum(weight * k[1]), 5) AS v0, round(sum(weight * k[2]), 5) AS v1 FROM w GROUP BY ALL""")
def memory_consolidation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("grp"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("key"), ((F.col("vec_id") * 37) % 101 + 1).alias("use"), F.lit(1).alias("life"))
    c = memory.consolidate(e.withColumn("value", F.col("key")), "grp", "vec_id", "key", "value", "use", "life", 4)
    return rounded(c.select("grp", "vec_id", F.get("value", F.lit(0)).alias("v0"), F.get("value", F.lit(1)).alias("v1")))


# --- fits --------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", *embedding_dims(6))
    return e.toDF("label", "x", "y", "z", "tx", "ty", "tz")


@query(f"""WITH e AS (SELECT label, {embedding_sql(6)} FROM embeddings) SELECT label, count(*)::DOUBLE AS w, {', '.join(f'round(covar_pop(e{i}, e{j + 3}), 5) AS c_{a}{b}' for i, a in enumerate('xyz') for j, b in enumerate('xyz'))},
  round(var_pop(e0) + var_pop(e1) + var_pop(e2), 5) AS var, round(var_pop(e3) + var_pop(e4) + var_pop(e5), 5) AS tvar FROM e GROUP BY label""")
def procrustes_covariance(spark, sf_dir):
    return rounded(fits.procrustes_sums(_pairs(spark, sf_dir), ["label"]).select("label", "w", *(f"c_{p}" for p in fits.PAIR), "var", "tvar"))


@query("SELECT DISTINCT label, 0.6::DOUBLE AS r00, 0.8::DOUBLE AS r02, 2.5::DOUBLE AS scale, 1::DOUBLE AS t0, -2::DOUBLE AS t1, 0.5::DOUBLE AS t2, 0::DOUBLE AS residual FROM embeddings")
def procrustes_fit(spark, sf_dir):
    """Each label's points turned about y, moved and scaled: the fit must find the motion again."""
    p = table(spark, sf_dir, "embeddings").select("label", *embedding_dims(3)).toDF("label", "x", "y", "z")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    moved = p.withColumns({"tx": 2.5 * (0.6 * x + 0.8 * z + 1.0), "ty": 2.5 * (y - 2.0), "tz": 2.5 * (0.6 * z - 0.8 * x + 0.5)})
    fit = fits.procrustes(moved, ["label"])
    worst = fits.aligned(moved, fit, ["label"]).groupBy("label").agg(F.max("residual").alias("residual"))
    r = lambda c: F.round(c, 5) + 0.0
    out = fit.join(worst, "label")
    return out.select("label", r(F.get("rot", F.lit(0))).alias("r00"), r(F.get("rot", F.lit(2))).alias("r02"), r(F.col("scale")).alias("scale"), *(r(F.get("transl", F.lit(i))).alias(f"t{i}") for i in range(3)), r(F.col("residual")).alias("residual"))


@query(f"""WITH e AS (SELECT vec_id, {embedding_sql(3)} FROM embeddings), d AS (SELECT a.vec_id, sqrt((a.e0-b.e0)^2 + (a.e1-b.e1)^2 + (a.e2-b.e2)^2) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.e0-b.e0)^2 + (a.e1-b.e1)^2 + (a.e2-b.e2)^2, b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, avg(d) AS m FROM d WHERE k <= 3 GROUP BY vec_id), q AS (SELECT quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM m)
SELECT vec_id, round(m, 5) AS mean_distance, round(ln(least(greatest(m, lo), hi)), 5) AS log_scale FROM m, q""")
def knn_scale(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *embedding_dims(3))
    return rounded(fits.neighbour_scale(e, "vec_id", ["e0", "e1", "e2"], 0.05))


@query()
def kmeans_directions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"))
    return fits.kmeans(e, "vec_id", "f", 8)


@query()
def motion_bases_fit(spark, sf_dir):
    t = track_table(spark, sf_dir).withColumn("confidence", F.col("visible").cast("double"))
    labels = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), (F.col("user_id") % 3).alias("label")).distinct()
    out = fits.motion_bases(t, labels, 4, 100)
    return rounded(out.select("label", "t", *(F.get("rot", F.lit(i)).alias(f"r{i}") for i in range(9)), *(F.get("transl", F.lit(i)).alias(f"t{i}") for i in range(3))), 4)


@query(f"""WITH e AS (SELECT vec_id, label, {embedding_sql(3)} FROM embeddings), c AS (SELECT label, quantile_disc(e0, 0.5) AS a, quantile_disc(e1, 0.5) AS b, quantile_disc(e2, 0.5) AS c FROM e GROUP BY label)
SELECT vec_id, c.label, round(10 * exp(-sqrt((e0-a)^2 + (e1-b)^2 + (e2-c.c)^2)), 5) AS logit FROM e, c""")
def motion_logits(spark, sf_dir):
    from ..operators.robust import cluster_centres

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *embedding_dims(3))
    c = cluster_centres(e, "label", ["e0", "e1", "e2"])
    out = fits.motion_logits(e, c, "vec_id", ["e0", "e1", "e2"]).select("vec_id", F.posexplode("coef_logit").alias("label", "logit"))
    return rounded(out)


@query()
def principal_colours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"))
    return fits.principal_colours(e, "vec_id", "f").select("vec_id", *(F.round(F.get("colour", F.lit(i)), 5).alias(f"c{i}") for i in range(3)))


# --- random choice, labels, pairs ----------------------------------------------------


@query(f"""WITH {_DISTINCT}, r AS (SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY (id % 2147483647) * 742938285 % 2147483647, id) AS k, count(*) OVER (PARTITION BY month) AS n FROM u)
SELECT id, month FROM r WHERE k <= greatest(n // 8, 64) ORDER BY ((id % 2147483647) * 742938285 + 1) % 2147483647, id LIMIT 500""")
def thinned_and_capped(spark, sf_dir):
    return sampling.thin_and_cap(_distinct_lines(spark, sf_dir), "month", "id", 500).select("id", "month")


@query(f"WITH {_DISTINCT} SELECT id FROM u ORDER BY ((id % 2147483647) * 742938285 + 1234) % 2147483647, id LIMIT 100")
def shuffled_rows(spark, sf_dir):
    return sampling.shuffled(_distinct_lines(spark, sf_dir).select("id"), "id", 100, 1234)


@query("""WITH t AS (SELECT event_id, f AS target, row_number() OVER (PARTITION BY event_id ORDER BY (((event_id * 30 + f) % 2147483647) * 742938285 + 5) % 2147483647, f) AS k FROM events, (SELECT unnest(range(30)) AS f))
SELECT event_id, target FROM t WHERE k <= 4""")
def random_targets(spark, sf_dir):
    """Four frames of thirty for each training item."""
    out = sampling.random_frames(table(spark, sf_dir, "events").select("event_id"), "event_id", 30, 4, 5)
    return out.select("event_id", F.col("target").cast("long").alias("target"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, l_suppkey % 50 AS f, (l_quantity % 8)::INT AS x, (l_partkey % 8)::INT AS y FROM lineitem) JOIN embeddings ON vec_id = f WHERE x % 2 = 0 AND y % 2 = 0 AND embedding[y * 8 + x + 1] > 0")
def on_masked_grid(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).alias("frame"), (F.col("l_quantity") % 8).cast("int").alias("x"), (F.col("l_partkey") % 8).cast("int").alias("y"))  # noqa: E741
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v > 0).alias("m"))
    return sampling.on_grid(l, e, "m", 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT vec_id, label FROM embeddings")
def label_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    dense = sampling.dense_labels(e, "label")
    return sampling.original_labels(e.join(dense, "label").drop("label"), dense, "label").select("vec_id", "label")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf_dir):
    return sampling.label_counts(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT 'p' || p_partkey AS stem, 'images/p' || p_partkey || '.jpg' AS left, 'depth/x.y/p' || p_partkey || '.npy' AS right FROM part")
def paired_files(spark, sf_dir):
    """Images and depths of the same name in different folders."""
    p = table(spark, sf_dir, "part")
    path = lambda a, b: p.select(F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b)).alias("path"))
    return sampling.paired_by_stem(path("images/p", ".jpg"), path("depth/x.y/p", ".npy"))


@query("SELECT 'rows' AS name, count(*) AS n FROM part WHERE NOT p_size > 40 UNION ALL SELECT 'stats', count(*) FROM part JOIN lineitem ON p_partkey = l_partkey WHERE NOT p_size > 40")
def cull_with_statistics(spark, sf_dir):
    """What is culled goes from the running statistics too."""
    stats = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    kept, rest = sampling.cull_with(table(spark, sf_dir, "part"), F.col("p_size") > 40, [stats], "p_partkey")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return count(kept, "rows").unionAll(count(rest, "stats"))


@query(f"""WITH e AS (SELECT label, vec_id, {embedding_sql(6)} FROM embeddings), s AS (SELECT label, var_pop(e0) + var_pop(e1) + var_pop(e2) AS a, var_pop(e3 + 1e6) + var_pop(e4 - 1e6) + var_pop(e5) AS b FROM e GROUP BY label)
SELECT label, round(sqrt(b / a), 4) AS scale, true AS proper FROM s""")
def procrustes_scale(spark, sf_dir):
    """Unrelated point sets far from the origin: the scale is the ratio of their spreads, the rotation proper."""
    p = _pairs(spark, sf_dir).withColumns({"tx": F.col("tx") + 1e6, "ty": F.col("ty") - 1e6})
    f = fits.procrustes(p, ["label"])
    r = [F.get("rot", F.lit(i)) for i in range(9)]
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    return f.select("label", F.round("scale", 4).alias("scale"), (F.abs(det - 1) < 1e-6).alias("proper"))
