"""Projections, filters, predicates, maps and table helpers on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import logic as L
from weftline.functions import maps as M
from weftline.operators import tables as TB
from weftline.session import table


def on(name, tab, build, sql):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


on("latest_per_key", "orders", lambda o: TB.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice"),
   "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
add("get_latest_many", lambda s, d: TB.latest_many(table(s, d, "orders"), table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name")), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "c_name", "o_orderkey"),
    "SELECT o_custkey, c_name, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
on("get_latest_one", "orders", lambda o: TB.latest(o.where(F.col("o_custkey").eqNullSafe(F.lit(7))), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey"),
   "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT DISTINCT FROM 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
on("filternone_events", "events", lambda e: e.withColumn("v", F.expr("nullif(event_type, 'click')")).where(F.col("v").isNotNull()).select("event_id", "v"), "SELECT event_id, event_type AS v FROM events WHERE event_type <> 'click'")
on("filternone_array", "documents", lambda x: x.select("doc_id", F.size(F.array_compact(F.transform(F.split("text", " "), lambda w: F.when(F.length(w) > 3, w)))).cast("long").alias("n")),
   "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: length(w) > 3)) AS n FROM documents")
on("first_not_none_events", "events", lambda e: e.groupBy("user_id").agg(F.min_by(F.expr("nullif(event_type, 'click')"), F.when(F.col("event_type") != "click", F.struct("ts", "event_id"))).alias("v")),
   "SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'click') AS v FROM events GROUP BY 1")
on("findfirst_words", "documents", lambda x: x.select("doc_id", L.find_first(F.split("text", " "), lambda w: F.length(w) > 8).alias("f")).select("doc_id", F.coalesce("f.index", F.lit(-1).cast("long")).alias("ix"), F.coalesce("f.value", F.lit("")).alias("w")),
   "SELECT doc_id, coalesce(list_position(list_transform(string_split(text, ' '), lambda w: length(w) > 8), true), 0)::BIGINT - 1 AS ix, coalesce(list_filter(string_split(text, ' '), lambda w: length(w) > 8)[1], '') AS w FROM documents")
on("flatten_arrays", "documents", lambda x: x.select("doc_id", F.size(F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, " ")))).cast("long").alias("n")),
   "SELECT doc_id, len(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')))) AS n FROM documents")
on("any_in_words", "documents", lambda x: x.select("doc_id", L.any_in(F.split("text", " "), F.array(F.lit("the"), F.lit("la"))).alias("hit")), "SELECT doc_id, list_has_any(string_split(text, ' '), ['the', 'la']) AS hit FROM documents")
on("any_in_common_words", "documents", lambda x: x.select("doc_id", L.any_in(F.split("text", " "), F.array("lang", "source")).alias("hit")), "SELECT doc_id, list_has_any(string_split(text, ' '), [lang, source]) AS hit FROM documents")
on("all_equal_embeddings", "embeddings", lambda e: e.groupBy("label").agg((F.count_distinct(F.signum(F.get("embedding", 0))) <= 1).alias("same")), "SELECT label, count(DISTINCT sign(embedding[1])) <= 1 AS same FROM embeddings GROUP BY 1")
on("all_equal_to_types", "events", lambda e: e.groupBy("user_id").agg(F.coalesce(F.bool_and(F.col("event_type") == "click"), F.lit(True)).alias("same")), "SELECT user_id, coalesce(bool_and(event_type = 'click'), true) AS same FROM events GROUP BY 1")
on("all_equal_lists", "documents", lambda x: x.select("doc_id", L.all_equal(F.split("text", " ")).alias("same"), L.all_equal_to(F.split("text", " "), F.lit("the")).alias("the")),
   "SELECT doc_id, len(list_distinct(string_split(text, ' '))) <= 1 AS same, len(list_filter(string_split(text, ' '), lambda w: w <> 'the')) = 0 AS the FROM documents")
on("is_empty_events", "events", lambda e: e.where("event_type = 'nothing'").agg((F.count(F.lit(1)) == 0).alias("is_empty")), "SELECT count(*) = 0 AS is_empty FROM events WHERE event_type = 'nothing'")
on("one_region", "region", lambda r: r.where("r_regionkey = 2").agg(F.when(F.count(F.lit(1)) == 1, F.max("r_name")).otherwise(F.raise_error(F.lit("not one row"))).alias("r_name")), "SELECT max(r_name) AS r_name FROM region WHERE r_regionkey = 2")
on("operator_in_types", "events", lambda e: e.select("event_id", L.is_in(F.col("event_type"), ["click", "view"]).alias("a"), L.not_in(F.col("event_type"), ["click", "view"]).alias("b")), "SELECT event_id, event_type IN ('click', 'view') AS a, event_type NOT IN ('click', 'view') AS b FROM events")
_A = lambda: F.col("value") > 50  # noqa: E731  columns need a session
_B = lambda: F.col("event_type") == "click"
on("logical_connectives", "events", lambda e: e.select("event_id", L.xor(_A(), _B()).alias("xor_"), L.xnor(_A(), _B()).alias("xnor_"), L.implies(_A(), _B()).alias("imp"), L.not_implies(_A(), _B()).alias("nimp"), L.implied_by(_A(), _B()).alias("conv"), L.not_implied_by(_A(), _B()).alias("nconv"), L.bit_or(F.col("event_id"), F.col("user_id")).alias("bits")),
   "SELECT event_id, a <> b AS xor_, a = b AS xnor_, NOT a OR b AS imp, a AND NOT b AS nimp, a OR NOT b AS conv, NOT a AND b AS nconv, event_id | user_id AS bits FROM (SELECT *, value > 50 AS a, event_type = 'click' AS b FROM events)")
on("extract_indexes_words", "documents", lambda x: x.select("doc_id", F.get(F.split("text", " "), 0).alias("first"), F.coalesce(F.get(F.split("text", " "), 2), F.lit("")).alias("third")), "SELECT doc_id, string_split(text, ' ')[1] AS first, coalesce(string_split(text, ' ')[3], '') AS third FROM documents")
on("between_wrap", "events", lambda e: e.select("event_id", L.between_wrapped(F.hour("ts"), F.lit(22), F.lit(4)).alias("night"), L.between_wrapped(F.hour("ts"), F.lit(9), F.lit(17)).alias("day"), L.between_wrapped(F.hour("ts"), None, F.lit(12)).alias("morning")),
   "SELECT event_id, h >= 22 OR h <= 4 AS night, h BETWEEN 9 AND 17 AS day, h <= 12 AS morning FROM (SELECT event_id, hour(ts) AS h FROM events)")
_MAP = lambda: F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("none"), F.expr("nullif(lang, lang)"), F.lit("empty"), F.lit(""))
_docs = lambda x: x.select("doc_id", "lang", "source", _MAP().alias("m"))
on("get_one_of_map", "documents", lambda x: _docs(x).select("doc_id", M.get_one_of(F.col("m"), ["title", "source", "lang"]).alias("o")).select("doc_id", "o.key", "o.value"), "SELECT doc_id, 'source' AS key, source AS value FROM documents")
on("get_available_map", "documents", lambda x: _docs(x).select("doc_id", F.array_join(F.map_values(M.get_available(F.col("m"), ["lang", "x", "source"])), "|").alias("v")), "SELECT doc_id, lang || '|' || source AS v FROM documents")
on("subdict_map", "documents", lambda x: _docs(x).select("doc_id", M.subdict(F.col("m"), ["source"])["source"].alias("v"), F.array_join(F.map_values(M.subdict_default(F.col("m"), ["lang", "x"], F.lit("?"))), "|").alias("w")), "SELECT doc_id, source AS v, lang || '|?' AS w FROM documents")
on("hasvalues_map", "documents", lambda x: _docs(x).select("doc_id", F.array_join(F.array_sort(F.map_keys(M.has_values(F.col("m")))), ",").alias("k")), "SELECT doc_id, 'lang,source' AS k FROM documents")
on("valuemap_map", "documents", lambda x: _docs(x).select("doc_id", M.value_map(F.col("m"), F.upper)["lang"].alias("v")), "SELECT doc_id, upper(lang) AS v FROM documents")
on("mapmap_map", "documents", lambda x: _docs(x).select("doc_id", F.array_join(M.map_values(F.col("m"), F.array(F.lit("source"), F.lit("lang"), F.lit("zz"))), ",", "NULL").alias("v")), "SELECT doc_id, source || ',' || lang || ',NULL' AS v FROM documents")
on("itemgetter_cols", "nation", lambda n: n.select("n_name", "n_regionkey"), "SELECT n_name, n_regionkey FROM nation")
on("zipget_arrays", "nation", lambda n: n.select("n_nationkey", F.array_join(M.zip_get(F.array(F.array("n_name", F.lit("b")), F.array(F.lit("c"), F.lit("d"))), F.array((F.col("n_nationkey") % 2).cast("int"), F.lit(1))), "-").alias("v")),
   "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'b' END || '-d' AS v FROM nation")
on("update_map", "documents", lambda x: _docs(x).select("doc_id", M.update(F.col("m"), F.create_map(F.lit("lang"), F.lit("xx"), F.lit("source"), F.expr("nullif('a', 'a')"))).alias("u")).select("doc_id", F.col("u")["lang"].alias("a"), F.col("u")["source"].alias("b")), "SELECT doc_id, 'xx' AS a, source AS b FROM documents")
on("deep_update_map", "nation", lambda n: n.select("n_nationkey", M.deep_update(F.create_map(F.lit("r"), F.create_map(F.lit("x"), F.col("n_name"), F.lit("y"), F.lit("old"))), F.create_map(F.lit("r"), F.create_map(F.lit("y"), F.lit("new")))).alias("u")).select("n_nationkey", F.col("u")["r"]["x"].alias("x"), F.col("u")["r"]["y"].alias("y")),
   "SELECT n_nationkey, n_name AS x, 'new' AS y FROM nation")
on("flatten_keys_map", "nation", lambda n: n.select("n_nationkey", F.explode(M.flatten_keys(F.create_map(F.lit("r"), F.create_map(F.lit("x"), F.col("n_name"), F.lit("y"), F.lit("v"))))).alias("k", "v")).select("n_nationkey", "k.a", "k.b", "v"),
   "SELECT n_nationkey, 'r' AS a, 'x' AS b, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'r', 'y', 'v' FROM nation")
on("flatten_row_struct", "orders", lambda o: M.flatten_struct(o.select("o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("code")).alias("status")).alias("c")), "_"), "SELECT o_orderkey, o_custkey AS c_id, o_orderstatus AS c_status_code FROM orders")
on("soql_columns", "customer", lambda c: M.flatten_struct(c.select("c_custkey", F.struct(F.col("c_name").alias("n"), F.lit("x").alias("attributes")).alias("a")), "_", ["attributes"]).withColumnRenamed("a_n", "name"), "SELECT c_custkey, c_name AS name FROM customer")
add("intersect_columns_pair", lambda s, d: TB.intersect_columns(table(s, d, "nation").withColumnRenamed("n_name", "name"), table(s, d, "region").withColumnRenamed("r_name", "name"))[0], "SELECT n_name AS name FROM nation")
on("dataframe_to_dict_nation", "nation", lambda n: TB.nested_cells(n.withColumn("n_name", F.when(F.col("n_nationkey") > 2, F.col("n_name"))), "n_nationkey", ["n_name", "n_regionkey"]).select("column", F.size("cells").cast("long").alias("n")),
   "SELECT 'n_name' AS \"column\", count(*) FILTER (WHERE n_nationkey > 2) AS n FROM nation UNION ALL SELECT 'n_regionkey', count(*) FROM nation")
on("null_columns_nation", "nation", lambda n: n.sparkSession.createDataFrame([(c,) for c in TB.null_columns(n.withColumn("a", F.lit(None).cast("string")))], "name string"), "SELECT 'a' AS name")
on("drop_null_columns_nation", "nation", lambda n: TB.drop_null_columns(n.select("n_nationkey", F.lit(None).cast("string").alias("a"))), "SELECT n_nationkey FROM nation")
on("lit_array_nation", "nation", lambda n: n.select("n_nationkey", F.element_at(F.array(*[F.lit(x) for x in (5, 6, 7)]), F.lit(2)).cast("long").alias("v")), "SELECT n_nationkey, CAST(6 AS BIGINT) AS v FROM nation")
on("generic_iter_only", "supplier", lambda x: x.select("s_suppkey", "s_name"), "SELECT s_suppkey, s_name FROM supplier")
on("query_by_field_eq", "orders", lambda o: o.where(F.col("o_orderstatus") == "F").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
on("query_by_field_intersect", "documents", lambda x: x.where(F.arrays_overlap(F.split("text", " "), F.array(F.lit("the"), F.lit("der")))).select("doc_id"), "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['the', 'der'])")
on("findone_region", "region", lambda r: r.sparkSession.createDataFrame([(TB.find_one(r.where("r_regionkey = 1"))["r_name"],)], "r_name string"), "SELECT r_name FROM region WHERE r_regionkey = 1")
_NEW = lambda s, d: table(s, d, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.lit("new").alias("s_name"))
_OLD = lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_name")
_SRC = "(SELECT s_suppkey + 50 AS s_suppkey, 'new' AS s_name FROM supplier WHERE s_suppkey % 3 = 0)"
add("upsert_suppliers", lambda s, d: TB.upsert(_OLD(s, d), _NEW(s, d), ["s_suppkey"]), f"SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM {_SRC}) UNION ALL SELECT * FROM {_SRC}")
add("add_files_flags", lambda s, d: TB.upsert_flags(_OLD(s, d), _NEW(s, d), ["s_suppkey"]), f"SELECT n.*, o.s_suppkey IS NULL AS inserted FROM {_SRC} n LEFT JOIN supplier o USING (s_suppkey)")
_DER = lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("data"))
_HALF = lambda s, d: table(s, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise("x").alias("s_name"))
add("add_file_replace", lambda s, d: TB.add_rows(_DER(s, d), _HALF(s, d), ["s_suppkey"], ["s_name"], ["data"], True), "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'x' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END AS data FROM supplier")
add("add_file_keep", lambda s, d: TB.add_rows(_DER(s, d), _HALF(s, d), ["s_suppkey"], ["s_name"], ["data"], False), "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'x' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN NULL ELSE s_nationkey END AS data FROM supplier")
add("add_file_many_last", lambda s, d: TB.last_of_batch(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"]), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
add("add_file_no_dup", lambda s, d: TB.add_no_dup(_OLD(s, d), _NEW(s, d).unionByName(_OLD(s, d)), ["s_suppkey", "s_name"]), f"SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT * FROM {_SRC}")
add("setdefault_values", lambda s, d: TB.set_default(_DER(s, d).withColumn("data", F.when(F.col("s_suppkey") % 2 == 0, F.col("data"))), table(s, d, "supplier").select("s_suppkey", F.lit(-1).alias("data")), ["s_suppkey"], "data").select("s_suppkey", "data"), "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE -1 END AS data FROM supplier")
on("case_variants_types", "events", lambda e: M.case_variants(e.select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("k"), F.length("event_type").alias("v")), "k", "v").select("key", F.array_join(F.map_keys("variants"), ",").alias("names")),
   "SELECT lower(k) AS key, string_agg(DISTINCT k, ',' ORDER BY k) AS names FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS k FROM events) GROUP BY 1")
