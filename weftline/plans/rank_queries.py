"""Sorts, samples, sets, graphs and prefix trees on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import puzzles
from weftline.operators import graphs as G
from weftline.operators import ranking as R
from weftline.session import table


def on(name, tab, build, sql=None):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


on("external_sort_limit", "orders", lambda o: R.external_sort(o.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 100), "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 100")
on("external_sort_lines", "part", lambda p: R.external_sort(p.select("p_name"), ["p_name"]), "SELECT p_name FROM part ORDER BY 1")
add("sorted_by_list_nations", lambda s, d: R.sorted_by_list(table(s, d, "nation").select("n_name", "n_nationkey"), table(s, d, "region").select("r_name", "r_regionkey"), ["n_nationkey"], ["r_regionkey"], "r_name").select("n_name", "sort_key"),
    "SELECT n_name, r_name AS sort_key FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) USING (k)")
on("sorted_with_keys_parts", "part", lambda p: R.sorted_with_keys(p.select("p_partkey", "p_retailprice"), -F.col("p_retailprice"), ["p_partkey"]).select("p_partkey", "key"), "SELECT p_partkey, -p_retailprice AS key FROM part")
on("optional_order_first", "events", lambda e: e.withColumn("v", F.expr("nullif(event_type, 'click')")).orderBy(*R.nulls_first("v", "event_id")).select("event_id", "v"), "SELECT event_id, nullif(event_type, 'click') AS v FROM events ORDER BY v NULLS FIRST, event_id")
for _n in ("bubble_sort", "selection_sort_min", "selection_sort_max"):
    on(f"{_n}_arrays", "embeddings", lambda e: e.select("vec_id", F.array_join(F.array_sort(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))), ",").alias("v")),
       "SELECT vec_id, array_to_string(list_sort(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT)), ',') AS v FROM embeddings")
add("cycle_sort_swaps", lambda s, d: s.createDataFrame([(1, [3, 1, 2]), (2, [1, 2]), (3, [2, 1, 4, 3]), (4, [])], "k int, x array<int>").select("k", F.array_join(F.transform(R.cycle_swaps("x"), lambda p: F.array_join(p, "-")), " ").alias("v")),
    "SELECT * FROM (VALUES (1, '0-2 0-1'), (2, ''), (3, '0-1 2-3'), (4, '')) t(k, v)")
add("locale_sorted_words", lambda s, d: s.createDataFrame([(w,) for w in ("b", "A", "a", "B", "ab", "Ab", "é", "f")], "w string").orderBy(*R.locale_order("w")).agg(F.array_join(F.collect_list("w"), " ").alias("v")), "SELECT 'a A ab Ab b B é f' AS v")
add("sorted_nested", lambda s, d: s.createDataFrame([([[3, 1], [2], [1, 9]],)], "x array<array<int>>").select(F.to_json(R.sort_nested(F.col("x"), 2)).alias("v")), "SELECT '[[1,3],[1,9],[2]]' AS v")
on("itersort_buffer", "events", lambda e: R.buffer_sort(e.select("user_id", "ts", "event_id", F.round("value", 2).alias("value")), "value", 1000, ["ts", "event_id"], ["user_id"]),
   "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2)) - 1 AS position, round(value, 2) AS value FROM events")
on("randomized_parts", "part", lambda p: R.shuffled(p.select("p_partkey"), ["p_partkey"], 7), "SELECT p_partkey FROM part")
add("sample_range_numbers", lambda s, d: R.sample_range(s, 1000, 50).agg(F.count_distinct("id").alias("n"), ((F.min("id") >= 0) & (F.max("id") < 1000)).alias("ok")), "SELECT CAST(50 AS BIGINT) AS n, true AS ok")
add("sortedsample_numbers", lambda s, d: R.sample_range(s, 100, 10, 3, True).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(10 AS BIGINT) AS n")
on("train_test_split_labels", "labels", lambda x: R.train_test_split(x, "quality", ["doc_id"], 0.25).groupBy("quality").agg(F.count_if("is_test").alias("n")), "SELECT quality, CAST(round(count(*) * 0.25) AS BIGINT) AS n FROM labels GROUP BY 1")
on("top_topics_brands", "part", lambda p: R.top_per_group(p.select("p_brand", "p_retailprice", "p_partkey"), "p_brand", "p_retailprice", 3, "p_partkey"), "SELECT p_brand, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
on("median_of_medians_prices", "part", lambda p: R.median_position(p, "p_retailprice", ["p_brand"]).join(p.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(F.lit(0.3), F.lit(0.7))).alias("q")), "p_brand").select("p_brand", F.col("median").between(F.col("q")[0], F.col("q")[1]).alias("ok")), "SELECT DISTINCT p_brand, true AS ok FROM part")
add("no_dupes_names", lambda s, d: R.no_dupes([table(s, d, "events").select(F.col("event_type").alias("v"), F.col("event_id").alias("k")), table(s, d, "region").select(F.col("r_name").alias("v"), F.col("r_regionkey").alias("k"))], "v", ["k"]),
    "SELECT v, source, k FROM (SELECT event_type AS v, 0 AS source, event_id AS k FROM events UNION ALL SELECT r_name, 1, r_regionkey FROM region) QUALIFY row_number() OVER (PARTITION BY v ORDER BY source, k) = 1")
on("delete_duplicates_sorted", "orders", lambda o: R.drop_adjacent(o.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_custkey", "o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
on("remove_duplicate_rows_table", "lineitem", lambda x: R.drop_adjacent(x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], ["l_orderkey"]).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) IS DISTINCT FROM l_returnflag")
on("pop_many_orders", "orders", lambda o: R.pop_many(o, F.col("o_orderstatus") == "F")[0].select("o_orderkey", F.lit("popped").alias("side")).unionByName(R.pop_many(o, F.col("o_orderstatus") == "F")[1].select("o_orderkey", F.lit("rest").alias("side"))), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'popped' ELSE 'rest' END AS side FROM orders")
on("set_get_any", "events", lambda e: e.groupBy("user_id", "event_type").agg(F.any_value("event_type").alias("v")).select("user_id", "v"), "SELECT DISTINCT user_id, event_type AS v FROM events")
add("row_indices", lambda s, d: R.same_row(s, 40, 9), "SELECT i AS place FROM range(81) t(i) WHERE i // 9 = 4")
add("col_indices", lambda s, d: R.same_column(s, 40, 9), "SELECT i AS place FROM range(81) t(i) WHERE i % 9 = 4")
add("subblock_indices", lambda s, d: R.same_block(s, 40, 9, 3), "SELECT i AS place FROM range(81) t(i) WHERE i // 27 = 1 AND i % 9 // 3 = 1")
add("to_2d_index", lambda s, d: s.range(50).select("id", R.to_2d(F.col("id"), 7).alias("p")).select("id", "p.y", "p.x"), "SELECT i AS id, i // 7 AS y, i % 7 AS x FROM range(50) t(i)")
add("indices_2d", lambda s, d: s.range(12).select(R.to_2d(F.col("id"), 5).alias("p")).select("p.y", "p.x"), "SELECT i // 5 AS y, i % 5 AS x FROM range(12) t(i)")
on("connected_subgraph_parts", "lineitem", lambda x: G.of_size(x.select((F.col("l_partkey") % 400).alias("a"), (F.col("l_partkey") % 400 + F.col("l_linenumber") * 400 % 7).alias("b")), 3).groupBy("component").agg(F.count(F.lit(1)).alias("n")),
   """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 400 AS a, l_partkey % 400 + l_linenumber * 400 % 7 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node)
SELECT component, count(*) AS n FROM (SELECT node, min(c) AS component FROM r GROUP BY 1) GROUP BY 1 HAVING count(*) >= 3""")
add("connected_subgraph_chains", lambda s, d: G.of_size(s.range(2000).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), 2), "SELECT i AS node, i // 10 * 10 AS component FROM range(2000) t(i)")
_TREE = lambda s, d: table(s, d, "nation").select(F.split(F.lower("n_name"), "").alias("k"), F.col("n_nationkey").alias("value")).select(F.slice("k", 1, 4).alias("keys"), "value")
add("trie_longest_prefix", lambda s, d: G.longest_prefix(table(s, d, "nation").select("n_nationkey", F.split(F.lower("n_name"), "").alias("q")), "q", _TREE(s, d).groupBy("keys").agg(F.min("value").alias("value")), ids=["n_nationkey"]).select("n_nationkey", F.array_join("prefix", "").alias("prefix"), "value"),
    "SELECT a.n_nationkey, left(lower(a.n_name), 4) AS prefix, (SELECT min(b.n_nationkey) FROM nation b WHERE left(lower(b.n_name), 4) = left(lower(a.n_name), 4)) AS value FROM nation a")
add("trie_statistics", lambda s, d: G.tree_statistics(s.createDataFrame([([1],), ([1, 2],), ([1, 2, 3],), ([4],)], "keys array<int>")), "SELECT CAST(4 AS BIGINT) AS leaves, CAST(2 AS BIGINT) AS branches, CAST(3 AS BIGINT) AS depth")
add("trie_prefixes", lambda s, d: G.prefixes(_TREE(s, d)).select(F.array_join("prefix", "").alias("p")), "SELECT DISTINCT left(lower(n_name), n::INT) AS p FROM nation, range(1, 5) t(n)")
_BOARD = "530070000600195000098000060800060003400803001700020006060000280000419005000080079"
_SOLVED = "534678912672195348198342567859761423426853791713924856961537284287419635345286179"
add("sudoku_solve", lambda s, d: s.createDataFrame([([int(c) for c in _BOARD],)], "b array<int>").select(F.array_join(puzzles.solved("b"), "").alias("v")), f"SELECT '{_SOLVED}' AS v")
add("sudoku_is_valid", lambda s, d: s.createDataFrame([(k, [int(c) for c in b]) for k, b in enumerate((_SOLVED, _BOARD, _SOLVED[::-1], "1" * 81))], "k int, b array<int>").select("k", puzzles.is_valid(F.col("b")).alias("v")), "SELECT * FROM (VALUES (0, true), (1, false), (2, true), (3, false)) t(k, v)")
