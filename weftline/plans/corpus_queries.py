"""Vocabularies, topics, dates, schemas and typed JSON on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.catalog import add
from weftline.functions import dates as D
from weftline.functions import documents as J
from weftline.operators import blocks as B
from weftline.operators import tables as TB
from weftline.operators import texts as X
from weftline.session import table


def on(name, tab, build, sql=None):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


# ---- encoders
_TOK = "(SELECT doc, pos, token FROM (SELECT doc_id AS doc, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)))"
_tok = lambda s, d: X.tokens(table(s, d, "documents"), "doc_id", "text")
_blocks = lambda s, d: B.packed(table(s, d, "documents"), "doc_id", "text")
on("label_encoder_types", "events", lambda e: X.encode(e.select("event_id", "event_type"), "event_type", X.label_ids(e, "event_type", ["event_id"])).select("event_id", "idx"),
   "SELECT event_id, rank_ - 1 AS idx FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS rank_ FROM events GROUP BY 1) USING (event_type)")
on("label_decoder_types", "events", lambda e: X.decode(e.select("event_id", (F.col("event_id") % 3).alias("idx")), X.label_ids(e, "event_type", ["event_id"]), "event_type").select("event_id", "event_type"),
   "SELECT event_id, t.event_type FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY 1) t ON e.event_id % 3 = t.idx")
add("batch_encoder_vocabulary", lambda s, d: X.vocabulary(_blocks(s, d)), f"SELECT token, count(*) AS count, row_number() OVER (ORDER BY min((doc, pos))) - 1 AS idx FROM {_TOK} GROUP BY 1")
add("batch_encoder_finalize", lambda s, d: X.vocabulary(_blocks(s, d), 50), f"SELECT token, n AS count, row_number() OVER (ORDER BY n DESC, token) - 1 AS idx FROM (SELECT token, count(*) AS n FROM {_TOK} GROUP BY 1 ORDER BY n DESC, token LIMIT 50)")
_V20 = f"(SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS idx FROM (SELECT token, count(*) AS n FROM {_TOK} GROUP BY 1 ORDER BY n DESC, token LIMIT 20))"


def _coded(s, d, size=None):
    """(ids of the documents' words, vocabulary of the size or of all words), the vocabulary made once."""
    blocks = _blocks(s, d)
    vocab = X.vocabulary(blocks, size)
    return X.transform(blocks, vocab), vocab


def _words(s, d, size=None):
    ids, vocab = _coded(s, d, size)
    return X.inverse_transform(ids, vocab).select("doc", F.md5(F.array_join("tokens", " ")).alias("words"))


_ALL = f"(SELECT token, row_number() OVER (ORDER BY min((doc, pos))) - 1 AS idx FROM {_TOK} GROUP BY 1)"
for _suffix, _size, _of in (("", 20, _V20), ("_all_words", None, _ALL)):
    add(f"batch_encoder_transform{_suffix}", lambda s, d, n=_size: _coded(s, d, n)[0].select("doc", F.md5(F.array_join("ids", ",")).alias("ids")), f"SELECT doc, md5(string_agg(idx::VARCHAR, ',' ORDER BY pos)) AS ids FROM {_TOK} JOIN {_of} USING (token) GROUP BY 1")
    add(f"batch_encoder_inverse{_suffix}", lambda s, d, n=_size: _words(s, d, n), f"SELECT doc, md5(string_agg(token, ' ' ORDER BY pos)) AS words FROM {_TOK} JOIN {_of} USING (token) GROUP BY 1")
    add(f"gensim_indexer_docs{_suffix}", lambda s, d, n=_size: _coded(s, d, n)[0].select("doc", F.size("ids").cast("long").alias("n")), f"SELECT doc, count(*) AS n FROM {_TOK} JOIN {_of} USING (token) GROUP BY 1")

# ---- topics over assignments that a rule fixes: topic = length of the token modulo 3
_assigned = lambda s, d: _tok(s, d).select("doc", "token", ((F.length("token") + F.col("pos")) % 3).alias("topic"))
_EVERY = f"(SELECT DISTINCT token FROM {_TOK})"
# One scan of the words each: common tables keep the whole-table SQL cheap.
_LDA = f"""WITH v AS MATERIALIZED {_EVERY}, a AS MATERIALIZED (SELECT doc, pos, token, (length(token) + pos) % 3 AS topic FROM {_TOK}),
dk AS (SELECT doc, topic, count(*) AS n FROM a GROUP BY 1, 2), dm AS (SELECT doc, count(*) AS m FROM a GROUP BY 1), tk AS (SELECT token, topic, count(*) AS n FROM a GROUP BY 1, 2), km AS (SELECT topic, count(*) AS m FROM a GROUP BY 1),
theta AS MATERIALIZED (SELECT dm.doc, k.topic, (coalesce(n, 0) + 0.1 / 3) / (m + 0.1) AS theta FROM dm CROSS JOIN range(3) k(topic) LEFT JOIN dk ON dk.doc = dm.doc AND dk.topic = k.topic),
phi AS MATERIALIZED (SELECT k.topic, v.token, (coalesce(tk.n, 0) + 0.01 / (SELECT count(*) FROM v)) / (m + 0.01) AS phi FROM v CROSS JOIN range(3) k(topic) JOIN km ON km.topic = k.topic LEFT JOIN tk ON tk.token = v.token AND tk.topic = k.topic)
"""
add("lda_theta", lambda s, d: X.theta(_assigned(s, d), 3, 0.1).withColumn("theta", F.round("theta", 9)), _LDA + "SELECT doc, topic, round(theta, 9) AS theta FROM theta")
add("lda_phi", lambda s, d: X.phi(_assigned(s, d), 3, 0.01).withColumn("phi", F.round("phi", 9)), _LDA + "SELECT topic, token, round(phi, 9) AS phi FROM phi")
add("lda_perplexity", lambda s, d: X.perplexity(_blocks(s, d), X.theta(_assigned(s, d), 3, 0.1), X.phi(_assigned(s, d), 3, 0.01)).select(F.round("perplexity", 6).alias("perplexity")),
    _LDA + "SELECT round(exp(-sum(n * ln(p)) / sum(n)), 6) AS perplexity FROM (SELECT c.doc, c.token, any_value(c.n) AS n, sum(phi * theta) AS p FROM (SELECT doc, token, count(*) AS n FROM a GROUP BY 1, 2) c JOIN phi f USING (token) JOIN theta t ON t.doc = c.doc AND t.topic = f.topic GROUP BY 1, 2)")
add("lda_docs2topics", lambda s, d: X.main_topics(X.theta(_assigned(s, d), 3, 0.1)), _LDA + "SELECT doc, arg_min(topic, (-theta, topic)) AS topic FROM theta GROUP BY 1")
add("lda_top_words", lambda s, d: X.top_words(X.phi(_assigned(s, d), 3, 0.01), 5, 4), _LDA + "SELECT topic, rank, token, round(phi, 4) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY phi DESC, token) AS rank FROM phi) WHERE rank <= 5")
add("format_topics_lines", lambda s, d: X.format_topics(X.top_words(X.phi(_assigned(s, d), 3, 0.01), 3, 2)), _LDA + "SELECT topic, string_agg('(' || token || ',' || round(phi, 2)::VARCHAR || ')', chr(9) ORDER BY rank) AS line FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY phi DESC, token) AS rank FROM phi) WHERE rank <= 3 GROUP BY 1")


def _lda(s, d):
    model, words, vectors = X.fit_topics(table(s, d, "documents"), "doc_id", "text", 3, 1 << 20, rounds=3)
    return X.infer_topics(model, vectors).select("doc", F.round(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x), 6).isin(0.0, 1.0).alias("ok"))  # zeros for texts without words


add("lda_fit_infer", _lda, "SELECT doc_id AS doc, true AS ok FROM documents")
on("query_based_paragraph", "benchmark", lambda b: X.best_paragraph(b.withColumn("text", F.concat(F.lit("other things\n\n"), F.regexp_replace("text", "\\s+", " "), F.lit("\n"))), "item_id", "text", "the of and other").select("doc", "shared"),
   "SELECT item_id AS doc, greatest(1, len(list_intersect(list_distinct(string_split(trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')), ['the', 'of', 'and', 'other']))) AS shared FROM benchmark")

# ---- dates
on("unixtime_ms_column", "events", lambda e: D.millis_column(e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")), "ts").select("event_id", F.unix_micros("ts").alias("us")), "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us FROM events")
add("utc_timestamp_seconds", lambda s, d: s.range(-5, 6).select("id", F.date_format(D.from_seconds(F.col("id") * 86400.5), "yyyy-MM-dd HH:mm:ss.SSS").alias("v")), "SELECT i AS id, strftime(make_timestamp(CAST(i * 86400500000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%g') AS v FROM range(-5, 6) t(i)")
add("utc_timestamp_ms", lambda s, d: s.range(-5, 6).select("id", F.unix_micros(D.from_millis(F.col("id") * 1001)).alias("v")), "SELECT i AS id, i * 1001000 AS v FROM range(-5, 6) t(i)")
add("utc_timestamp_ns", lambda s, d: s.range(-5, 6).select("id", F.unix_micros(D.from_nanos(F.col("id") * 1500)).alias("v")), "SELECT i AS id, CAST(floor(i * 1.5) AS BIGINT) AS v FROM range(-5, 6) t(i)")
on("naive_to_aware_events", "events", lambda e: e.select("event_id", F.unix_micros(D.to_aware(F.col("ts"), "America/New_York")).alias("us")), "SELECT event_id, epoch_us(ts AT TIME ZONE 'America/New_York') AS us FROM events")
on("is_aware_columns", "events", lambda e: e.sparkSession.createDataFrame([(D.is_aware(e.select(F.col("ts").cast("timestamp").alias("t")), "t"), D.is_aware(e.select(F.col("ts").cast("timestamp_ntz").alias("t")), "t"))], "a boolean, b boolean"), "SELECT true AS a, false AS b")
on("now_is_an_instant", "region", lambda r: r.select("r_regionkey", (D.now() > F.lit("2020-01-01").cast("timestamp")).alias("ok")), "SELECT r_regionkey, true AS ok FROM region")

# ---- schemas
_ROWS = [{"a": 1, "b": "x", "c": [1, 2]}, {"a": 3_000_000_000, "d": {"e": 1.5, "f": True}, "c": []}, {"g": [{"h": "y"}], "a": -1}]
add("get_schema_simple", lambda s, d: s.createDataFrame([(k, str(v)) for k, v in TB.infer_schema(_ROWS).items()], "name string, kind string"), "SELECT * FROM (VALUES ('a', 'int64'), ('b', 'str'), ('c', '[''int32'']'), ('d', '{''e'': ''float'', ''f'': ''bool''}'), ('g', '[{''h'': ''str''}]')) t(name, kind)")
add("schema_simple_to_spark", lambda s, d: s.createDataFrame([(f.name, f.dataType.simpleString()) for f in TB.schema_of({"b": "str", "a": "uint64", "x": [], "c": ["uint32"], "d": {"t": "datetime"}}, True).fields], "name string, kind string"),
    "SELECT * FROM (VALUES ('a', 'decimal(20,0)'), ('b', 'string'), ('c', 'array<bigint>'), ('d', 'struct<t:timestamp>')) t(name, kind)")


def _arrow(s, d):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(TB.schema_of({"a": "int32", "b": ["str"], "c": "uint64"}))
    return s.createDataFrame([(f.name, str(f.type)) for f in schema], "name string, kind string")


add("schema_simple_to_arrow", _arrow, "SELECT * FROM (VALUES ('a', 'int32'), ('b', 'list<element: string>'), ('c', 'decimal128(20, 0)')) t(name, kind)")

# ---- JSON
_typed = lambda o: o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.timestamp_micros(F.col("o_orderkey") * 1_234_567).alias("at"), F.array("o_custkey", F.lit(3).cast("long"), "o_custkey").alias("ids"), F.expr("make_dt_interval(cast(o_orderkey % 5 as int), 3, 4, 5.25)").alias("wait"))
_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("day", T.DateType()), T.StructField("at", T.TimestampType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("wait", T.DayTimeIntervalType())])


def _round_trip(o):
    """What comes back: the values, and whether the interval is the same."""
    back = o.transform(_typed).withColumn("j", J.to_tagged(o.transform(_typed), ("ids",))).withColumn("x", J.from_tagged(F.col("j"), _SCHEMA, ("ids",)))
    return back.select("o_orderkey", F.col("x.day").alias("day"), F.unix_micros("x.at").alias("us"), F.array_join(F.transform(F.array_sort("x.ids"), lambda i: i.cast("string")), ",").alias("ids"), ((F.col("x.wait") == F.col("wait")) & F.col("j").contains('"$dateobj"')).alias("wait"))


on("json_roundtrip_tagged", "orders", _round_trip, "SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey * 1234567 AS us, array_to_string(list_sort(list_distinct([o_custkey, 3])), ',') AS ids, true AS wait FROM orders")
add("json_readable", lambda s, d: (lambda df: df.select(J.readable(df).alias("j")))(s.range(1).select(F.lit("2024-02-03 04:05:06").cast("timestamp").alias("t"), F.lit(b"\x01\x02hello").alias("b"), F.expr("make_dt_interval(1, 0, 0, 2.5)").alias("i"), J.set_of(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("s"))),
    "SELECT '{\"t\":\"2024-02-03T04:05:06\",\"b\":\"0Rm`cY;11\",\"i\":86402.5,\"s\":[1,3]}' AS j")
add("base85_round_trip", lambda s, d: table(s, d, "region").select("r_regionkey", F.decode(J.from_base85(J.base85(F.encode("r_name", "UTF-8"))), "UTF-8").alias("name")), "SELECT r_regionkey, r_name AS name FROM region")
_BIND = '{"head": {"vars": ["item", "label"]}, "results": {"bindings": [{"item": {"value": "Q1", "type": "uri"}, "label": {"value": "one"}}, {"item": {"value": "Q2"}, "label": {"value": "two"}}]}}'
add("query_bindings_table", lambda s, d: s.range(1).select(F.from_json(F.lit(_BIND), "head struct<vars:array<string>>, results struct<bindings:array<struct<item:struct<value:string>,label:struct<value:string>>>>").alias("r")).select(F.explode("r.results.bindings").alias("b")).select(*J.flatten_bindings(F.col("b"), ["item", "label"])),
    "SELECT * FROM (VALUES ('Q1', 'one'), ('Q2', 'two')) t(item, label)")
