"""Joins and aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.catalog import add
from weftline.functions import text as X
from weftline.operators import aggregates as A
from weftline.operators import blocks as B
from weftline.operators import joins as J
from weftline.operators import topics as G
from weftline.session import table, written


def on(name, tab, build, sql):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


_CL = lambda e: e.where("event_type = 'click'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
_VW = lambda e: e.where("event_type = 'view'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
_C, _V = ("(SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = '%s')" % k for k in ("click", "view"))
on("asof_backward", "events", lambda e: J.asof(_CL(e), _VW(e), "t", ["user_id"]).select("event_id", "r_event_id"), f"SELECT a.event_id, b.event_id AS r_event_id FROM {_C} a ASOF LEFT JOIN {_V} b ON a.user_id = b.user_id AND a.t >= b.t")
on("asof_forward", "events", lambda e: J.asof(_CL(e), _VW(e), "t", ["user_id"], "forward").select("event_id", "r_event_id"), f"SELECT a.event_id, b.event_id AS r_event_id FROM {_C} a ASOF LEFT JOIN {_V} b ON a.user_id = b.user_id AND a.t <= b.t")
on("asof_nearest", "events", lambda e: J.asof(_CL(e), _VW(e), "t", ["user_id"], "nearest").select("event_id", "r_event_id"),
   f"SELECT a.event_id, arg_min(b.event_id, (abs(a.t - b.t), b.t)) AS r_event_id FROM {_C} a LEFT JOIN {_V} b ON a.user_id = b.user_id GROUP BY 1")
_ARR = lambda: F.transform("embedding", lambda x: F.round(x * 100).cast("long"))
_DARR = "list_transform(embedding, lambda x: CAST(CASE WHEN x < 0 THEN -floor(-CAST(x * CAST(100 AS FLOAT) AS FLOAT) + 0.5) ELSE floor(CAST(x * CAST(100 AS FLOAT) AS FLOAT) + 0.5) END AS BIGINT))"
_T = 5
for _n, _f, _c, _o in (("argfind_lte", J.lte, f"a[i] <= {_T}", "(-a[i], i)"), ("argfind_gte", J.gte, f"a[i] >= {_T}", "(a[i], i)"), ("closest_value", J.closest, "true", f"(abs(a[i] - {_T}), i)")):
    on(_n, "embeddings", lambda e, f=_f: e.select("vec_id", f(_ARR(), F.lit(_T)).alias("r")).select("vec_id", F.col("r.i").alias("ix"), F.col("r.v").alias("v")),
       f"WITH x AS (SELECT vec_id, {_DARR} AS a, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT vec_id, coalesce(arg_min(i, {_o}) FILTER (WHERE {_c}) - 1, -1) AS ix, CAST(arg_min(a[i], {_o}) FILTER (WHERE {_c}) AS DOUBLE) AS v FROM x GROUP BY vec_id")
on("bisect_positions", "embeddings", lambda e: e.select("vec_id", J.bisect_left(F.sort_array(_ARR()), F.lit(3)).alias("lo"), J.bisect_right(F.sort_array(_ARR()), F.lit(3)).alias("hi")), f"SELECT vec_id, len(list_filter(a, lambda x: x < 3))::BIGINT AS lo, len(list_filter(a, lambda x: x <= 3))::BIGINT AS hi FROM (SELECT vec_id, {_DARR} AS a FROM embeddings)")
on("search_sorted_position", "part", lambda p: p.groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") <= 1200).alias("pos")), "SELECT p_brand, count(*) FILTER (WHERE p_retailprice <= 1200) AS pos FROM part GROUP BY 1")
on("triangular_nations", "nation", lambda n: J.triangular(n, "n_nationkey", ["n_nationkey", "n_name"]), "SELECT a.n_nationkey AS n_nationkey_a, a.n_name AS n_name_a, b.n_nationkey AS n_nationkey_b, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
add("triangular_indices", lambda s, d: J.triangular(s.range(12).select(F.col("id").alias("i")), "i", ["i"]), "SELECT a.i AS i_a, b.i AS i_b FROM range(12) a(i) JOIN range(12) b(i) ON a.i < b.i")
on("band_pairs", "conversations", lambda c: J.band_join(c.select("conv_id", F.col("turn").alias("a")), c.select("conv_id", F.col("turn").alias("b")), "a", "b", 1, 2, ["conv_id"]), "SELECT x.conv_id, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn BETWEEN x.turn + 1 AND x.turn + 2")
add("window_combinations_indices", lambda s, d: J.band_join(s.range(30).select(F.col("id").alias("a")), s.range(30).select(F.col("id").alias("b")), "a", "b", 1, 3), "SELECT a, b FROM range(30) x(a) JOIN range(30) y(b) ON a < b AND b < a + 4")
add("combination_indices", lambda s, d: J.monotone_indices(s, 4, 5, 6), "SELECT i0, i1, i2 FROM range(4) a(i0), range(5) b(i1), range(6) c(i2) WHERE i0 <= i1 AND i1 <= i2")
add("multi_join_regions", lambda s, d: J.product([table(s, d, "region").select(F.col("r_name").alias("b")), table(s, d, "nation").select(F.col("n_name").alias("a"))]).select(F.concat("a", "b").alias("ab")), "SELECT n_name || r_name AS ab FROM nation, region")
add("product_map_regions", lambda s, d: J.product([table(s, d, "region").select(F.col("r_regionkey").alias(c)) for c in "xyz"]).select((F.col("x") * 100 + F.col("y") * 10 + F.col("z")).cast("long").alias("v")), "SELECT CAST(a.r_regionkey * 100 + b.r_regionkey * 10 + c.r_regionkey AS BIGINT) AS v FROM region a, region b, region c")
add("product_range_repeat", lambda s, d: J.range_product(s, 4, 3), "SELECT a.i AS i0, b.i AS i1, c.i AS i2 FROM range(4) a(i), range(4) b(i), range(4) c(i)")
add("complete_bipartite", lambda s, d: J.product([table(s, d, "region").select("r_name", "r_regionkey"), table(s, d, "nation").select("n_name", "n_nationkey")]).select("r_name", "n_name", (F.col("r_regionkey") + F.col("n_nationkey")).cast("long").alias("weight")), "SELECT r_name, n_name, CAST(r_regionkey + n_nationkey AS BIGINT) AS weight FROM region, nation")
add("metric_range_prices", lambda s, d: J.metric_range(table(s, d, "part").select("p_partkey", "p_retailprice"), table(s, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q_key"), F.col("p_retailprice").alias("q")), "p_retailprice", "q", 1.0, 1000.0).select("p_partkey", "q_key"),
    "SELECT a.p_partkey, b.p_partkey AS q_key FROM part a JOIN part b ON b.p_partkey % 50 = 0 AND abs(a.p_retailprice - b.p_retailprice) <= 1.0")
add("range_join_prices", lambda s, d: J.range_join(table(s, d, "part").select("p_partkey", "p_retailprice"), s.range(20).select(F.col("id"), (F.col("id") * 70 + 900.0).alias("a"), (F.col("id") * 70 + 1000.0).alias("b")), "p_retailprice", "a", "b", 100.0).select("p_partkey", "id"),
    "SELECT p_partkey, id FROM part JOIN range(20) r(id) ON p_retailprice >= id * 70 + 900.0 AND p_retailprice < id * 70 + 1000.0")
on("hamming_pairs", "embeddings", lambda e: J.within_hamming(e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.aggregate(F.slice("embedding", g * 16 + 1, 16), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > 0).cast("long"))).alias("w")), "vec_id", "w", 3, 4),
   "WITH w AS (SELECT vec_id, list_transform(range(4), lambda g: list_sum(list_transform(range(16), lambda k: CASE WHEN embedding[g * 16 + k + 1] > 0 THEN CAST(pow(2, 15 - k) AS BIGINT) ELSE 0 END))) AS w FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(len(list_filter(range(1, 5), lambda i: a.w[i] <> b.w[i])) AS BIGINT) AS distance FROM w a JOIN w b ON a.vec_id < b.vec_id) SELECT * FROM p WHERE distance <= 3")

# ---- aggregations
on("count_distinct_null", "events", lambda e: e.select("user_id", F.expr("nullif(event_type, 'click')").alias("v")).groupBy("user_id").agg(A.count_distinct(F.col("v")).alias("n")), "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
on("iter_len", "events", lambda e: e.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM events")
on("table_exists_rows", "events", lambda e: e.agg((F.count(F.lit(1)) > 0).alias("ok")), "SELECT count(*) > 0 AS ok FROM events")
on("discrete_distribution", "events", lambda e: A.distribution(e, "event_type"), "SELECT event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY 1")
on("shannon_entropy_types", "events", lambda e: A.entropy(e, "event_type").select(F.round("entropy", 9).alias("entropy")), "SELECT round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
on("means_orders", "orders", lambda o: o.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(A.harmonic_mean(F.col("o_totalprice")), 4).alias("harmonic"), F.round(A.geometric_mean(F.col("o_totalprice")), 4).alias("geometric")),
   "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(count(*) / sum(1.0 / o_totalprice), 4) AS harmonic, round(exp(avg(ln(o_totalprice))), 4) AS geometric FROM orders GROUP BY 1")
on("argmin_argmax_events", "events", lambda e: e.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("lo"), F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("hi"), F.max("value").alias("m")), "SELECT user_id, arg_min(event_id, (value, event_id)) AS lo, arg_min(event_id, (-value, event_id)) AS hi, max(value) AS m FROM events GROUP BY 1")
on("last_event", "events", lambda e: e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.coalesce(F.max_by("event_id", F.when(F.col("event_type") == "zzz", F.col("ts"))), F.lit(-1).cast("long")).alias("none")), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, CAST(-1 AS BIGINT) AS none FROM events GROUP BY 1")
on("majority_status", "lineitem", lambda x: A.majority(x.select("l_linestatus"), "l_linestatus"), "SELECT l_linestatus FROM lineitem GROUP BY 1 HAVING count(*) * 2 > (SELECT count(*) FROM lineitem)")
on("median_price", "part", lambda p: p.groupBy("p_brand").agg(F.median("p_retailprice").alias("median")), "SELECT p_brand, median(p_retailprice) AS median FROM part GROUP BY 1")
on("hll_parts", "lineitem", lambda x: x.agg(F.count_distinct("l_partkey").alias("n"), (F.abs(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))) - F.count_distinct("l_partkey")) < 0.03 * F.count_distinct("l_partkey")).alias("near")), "SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
on("hll_union_parts", "lineitem", lambda x: x.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", F.lit(14)).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("est")).crossJoin(x.agg(F.count_distinct("l_partkey").alias("n"))).select("n", (F.abs(F.col("est") - F.col("n")) < 0.03 * F.col("n")).alias("near")), "SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
on("multi_counter", "events", lambda e: A.nested_counts(e.withColumn("u", F.col("user_id") % 10), "u", "event_type"), "SELECT user_id % 10 AS u, event_type, count(*) AS n FROM events GROUP BY 1, 2")
on("bincount_lists", "embeddings", lambda e: e.select("vec_id", F.array_join(A.bincount(F.transform("embedding", lambda x: F.least(F.floor(F.abs(x) * 10), F.lit(4)).cast("int")), 5), ",").alias("bins")), "SELECT vec_id, list_aggregate(list_transform(range(5), lambda b: len(list_filter(embedding, lambda x: least(CAST(floor(abs(x) * CAST(10 AS FLOAT)) AS INT), 4) = b))), 'string_agg', ',') AS bins FROM embeddings")
on("histogram_2d_blocks", "lineitem", lambda x: A.block_histogram(x.select(F.col("l_linenumber").alias("x"), (F.col("l_quantity") % 8).cast("int").alias("y"), F.col("l_returnflag").alias("l")), "x", "y", "l", 3, 4), "SELECT CAST(floor(l_linenumber / 3) AS BIGINT) AS bx, CAST(floor(CAST(floor(l_quantity % 8) AS INT) / 4) AS BIGINT) AS \"by\", l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
on("center_of_mass", "lineitem", lambda x: A.center_of_mass(x, "l_linenumber", "l_quantity", "l_discount").select(F.round("x", 8).alias("x"), F.round("y", 8).alias("y")), "SELECT round(sum(l_discount * l_linenumber) / sum(l_discount), 8) AS x, round(sum(l_discount * l_quantity) / sum(l_discount), 8) AS y FROM lineitem")
on("population_cdf", "lineitem", lambda x: A.cdf(x, "l_quantity", ["l_returnflag"]).withColumn("cdf", F.round("cdf", 9)), "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS cdf FROM lineitem")
on("pmf_cdf", "lineitem", lambda x: A.pmf_to_cdf(x, "l_linenumber", "l_quantity").withColumn("cdf", F.round("cdf", 9)), "SELECT l_linenumber, round(sum(w) OVER (ORDER BY l_linenumber) / sum(w) OVER (), 9) AS cdf FROM (SELECT l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY 1)")
_KSQ = "SELECT row_number() OVER (ORDER BY %s) AS k, cume_dist() OVER (ORDER BY %s) AS c FROM lineitem"
on("ks_by_rank", "lineitem", lambda x: A.ks_by_rank(x.select(F.col("l_discount").alias("v")), x.select(F.col("l_tax").alias("v")), "v").select(F.round("d", 9).alias("d"), F.round("p", 9).alias("p"), "reject"),
   f"WITH a AS ({_KSQ % ('l_discount', 'l_discount')}), b AS ({_KSQ % ('l_tax', 'l_tax')}), d AS (SELECT max(abs(a.c - b.c)) AS d, count(*) / 2 AS h FROM a JOIN b USING (k)) SELECT round(d, 9) AS d, round(exp(-2 * d * d * h), 9) AS p, exp(-2 * d * d * h) < 0.05 AS reject FROM d")
_AB = lambda x, f: x.where(f"l_returnflag = '{f}'")
on("ks_two_sample_pmf", "lineitem", lambda x: A.ks_from_cdfs(A.pmf_to_cdf(_AB(x, "A"), "l_linenumber", "l_quantity"), A.pmf_to_cdf(_AB(x, "R"), "l_linenumber", "l_quantity"), "l_linenumber", 7, 7).select(F.round("d", 9).alias("d"), F.round("p", 9).alias("p"), "reject"),
   "WITH w AS (SELECT l_returnflag AS f, l_linenumber AS k, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2), c AS (SELECT f, k, sum(w) OVER (PARTITION BY f ORDER BY k) / sum(w) OVER (PARTITION BY f) AS c FROM w), d AS (SELECT max(abs(a.c - b.c)) AS d FROM c a JOIN c b ON a.k = b.k AND a.f = 'A' AND b.f = 'R') SELECT round(d, 9) AS d, round(exp(-2 * d * d * 3.5), 9) AS p, exp(-2 * d * d * 3.5) < 0.05 AS reject FROM d")
on("limit_balanced_brands", "part", lambda p: A.limit_balanced(p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand", "n", 120),
   "WITH n AS (SELECT p_brand, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, p_brand DESC) AS k FROM part GROUP BY 1), s AS (SELECT v, sum(least(c, v)) AS t FROM n, range(0, 200) t(v) GROUP BY v), l AS (SELECT max(v) AS level, 120 - max(t) AS rest FROM s WHERE t <= 120) SELECT p_brand, CAST(least(c, level + CASE WHEN k <= rest THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM n, l")
_LINE = ["l_orderkey", "l_linenumber"]
# The members are rows of the table: its rows with one of their 24 keys are looked up.
on("sample_balanced_counts", "lineitem", lambda x: (lambda m: m.join(x.select(*_LINE).join(F.broadcast(m.select(*_LINE)), _LINE, "left_semi"), _LINE, "left_semi"))(written(A.sample_balanced(x.select("l_returnflag", "l_linestatus", *_LINE), ["l_returnflag", "l_linestatus"], 24, _LINE))).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, l_linestatus, least(count(*), 24 // (SELECT count(DISTINCT (l_returnflag, l_linestatus)) FROM lineitem)) AS n FROM lineitem GROUP BY 1, 2")
on("normalize_weights", "lineitem", lambda x: A.with_total(x.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("w")), "w").select("l_linenumber", F.round(F.col("w") / F.col("total"), 9).alias("p")), "SELECT l_linenumber, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 9) AS p FROM lineitem GROUP BY 1")
on("accuracy_labels", "labels", lambda x: x.agg(F.round(F.avg((F.col("quality") != F.col("toxic")).cast("double")), 9).alias("accuracy")), "SELECT round(avg(CASE WHEN quality <> toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labels")
on("same_words_similarity", "conversations", lambda c: c.withColumn("b", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL").select("conv_id", "turn", F.size(F.array_intersect(X.words(F.col("text")), X.words(F.col("b")))).cast("long").alias("n")),
   "SELECT conv_id, turn, len(list_intersect(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda w: w <> '')))::BIGINT AS n FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
_TOK = "(SELECT doc, token FROM (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents) WHERE token <> '')"
on("term_frequency_docs", "documents", lambda x: A.term_frequency(A.tokens(x, "doc_id", "text")).withColumn("tf", F.round("tf", 6)), f"SELECT token, round(-log2(count(*) / sum(count(*)) OVER ()), 6) AS tf FROM {_TOK} GROUP BY 1")
on("idf_docs", "documents", lambda x: A.inverse_document_frequency_of(x, "text").withColumn("idf", F.round("idf", 6)), f"SELECT token, round(log2((SELECT count(DISTINCT doc) FROM {_TOK}) / count(DISTINCT doc)), 6) AS idf FROM {_TOK} GROUP BY 1")
on("pmi_docs", "documents", lambda x: G.term_weights(B.packed(x, "doc_id", "text"), "PMI").select("doc", "token", F.round("weight", 6).alias("pmi")), f"SELECT doc, token, round(greatest(log2(sum(n) OVER (PARTITION BY token) / n), 0.0), 6) AS pmi FROM (SELECT doc, token, count(*) AS n FROM {_TOK} GROUP BY 1, 2)")
on("one_weights", "documents", lambda x: A.tokens(x, "doc_id", "text").select("token").distinct().withColumn("w", F.lit(1.0)), f"SELECT DISTINCT token, CAST(1.0 AS DOUBLE) AS w FROM {_TOK}")
on("count_words", "documents", lambda x: A.tokens(x, "doc_id", "text").agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM {_TOK}")
on("segment_tree_query", "events", lambda e: e.withColumn("at", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).where("at >= 3 AND at < 9").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "SELECT user_id, min(value) AS lo, max(value) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix FROM events) WHERE ix >= 3 AND ix < 9 GROUP BY 1")
