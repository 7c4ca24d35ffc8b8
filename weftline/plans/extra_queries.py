"""General metric search, markup, atomic replacement, bounded shuffles, flow control and the last small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import arrays as V
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import blocks as B
from weftline.operators import control as C
from weftline.operators import joins as J
from weftline.operators import ranking as R
from weftline.operators import topics as G
from weftline.session import scratch_dir, table
from weftline.sources import sinks as K

# ---- any metric: edit distance of names, Manhattan distance of vectors
_NAMES = lambda s, d: table(s, d, "part").select("p_partkey", "p_name")
_ASKED = lambda s, d: _NAMES(s, d).where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("q"))
add("metric_search_part_names", lambda s, d: J.metric_search(_NAMES(s, d), _ASKED(s, d), "p_name", "q", F.levenshtein, 1, [F.lit("green widget"), F.lit("")]).select("qid", "p_partkey", F.col("distance").cast("long").alias("distance")),
    "SELECT q.p_partkey AS qid, p.p_partkey, levenshtein(p.p_name, q.p_name) AS distance FROM part p JOIN part q ON q.p_partkey % 50 = 0 AND levenshtein(p.p_name, q.p_name) <= 1")
add("metric_nearest_part_names", lambda s, d: J.metric_nearest(_NAMES(s, d), _ASKED(s, d), "p_partkey", "p_name", "qid", "q", F.levenshtein, 3).select("qid", F.col("rank").cast("long").alias("rank"), "p_partkey", F.col("distance").cast("long").alias("distance")),
    "SELECT qid, rank, p_partkey, distance FROM (SELECT q.p_partkey AS qid, p.p_partkey, levenshtein(p.p_name, q.p_name) AS distance, row_number() OVER (PARTITION BY q.p_partkey ORDER BY levenshtein(p.p_name, q.p_name), p.p_partkey) AS rank FROM part p JOIN part q ON q.p_partkey % 50 = 0) WHERE rank <= 3")
_manhattan = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x), 6)
_VECTORS = lambda s, d: table(s, d, "embeddings").select("vec_id", "embedding")
add("metric_search_vectors", lambda s, d: J.manhattan_search(_VECTORS(s, d), _VECTORS(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "vec_id", "embedding", "qid", "q", 3.0).withColumn("distance", _manhattan(F.col("embedding"), F.col("q"))).where("distance <= 3.0").select("qid", "vec_id", F.round("distance", 4).alias("distance")),
    "SELECT qid, vec_id, round(distance, 4) AS distance FROM (SELECT q.vec_id AS qid, p.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(p.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 6) AS distance FROM embeddings p JOIN embeddings q ON q.vec_id % 50 = 0) WHERE distance <= 3.0")


# ---- markup and words
def cases(name, rows, build, expected):
    q = lambda v: "'" + v.replace("'", "''") + "'"
    add(name, lambda s, d: s.createDataFrame(list(enumerate(rows)), "k int, x string").select("k", build(F.col("x")).alias("v")), "SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(v)})" for k, v in enumerate(expected)) + ") t(k, v)")


cases("detokenize_cases", ["Hello , world !", "I do n't know ( yet ) .", "It 's 5 % of $ 3 ; fine", "`` Yes , '' she said .", "wait ... what ?", "a"], lambda c: X.detokenize(F.split(c, " ")),
      ["Hello, world!", "I don't know (yet).", "It's 5% of $3; fine", '"Yes," she said.', "wait... what?", "a"])
cases("markdown2html_cases", ["hello *a* **b** `c<d`", "# Title\n\ntext & more", "- one\n- two", "1. x\n2. y", "[n](http://a.b/?c=1&d=2)", "> quoted\n> twice", "```\nif a < b:\n```", "a\n\nb\n\n---", ""], X.markdown_to_html,
      ["hello <em>a</em> <strong>b</strong> <code>c&lt;d</code>", "<h1>Title</h1>\n<p>text &amp; more</p>", "<ul>\n<li>one</li>\n<li>two</li>\n</ul>", "<ol>\n<li>x</li>\n<li>y</li>\n</ol>", '<a href="http://a.b/?c=1&amp;d=2">n</a>', "<blockquote>\n<p>quoted\ntwice</p>\n</blockquote>", "<pre><code>if a &lt; b:\n</code></pre>", "<p>a</p>\n<p>b</p>\n<hr />", ""])
add("to_uri_names", lambda s, d: table(s, d, "nation").select("n_nationkey", U.file_uri(F.concat(F.lit("/data//"), "n_name", F.lit("?#%.db")), mode=F.lit("ro"), name=F.col("n_name")).alias("v")),
    "SELECT n_nationkey, 'file:/data/' || n_name || '%3f%23%25.db?mode=ro&name=' || replace(n_name, ' ', '+') AS v FROM nation")
add("quote_identifier_names", lambda s, d: s.createDataFrame([(k, X.quote_identifier(n)) for k, n in enumerate(["a", "a`b", "select x"])], "k int, v string"), "SELECT * FROM (VALUES (0, '`a`'), (1, '`a``b`'), (2, '`select x`')) t(k, v)")

# ---- writers
add("write_json_arrays", lambda s, d: (lambda path: (K.write_json(table(s, d, "nation").select("n_nationkey", "n_name"), path), s.read.schema("n_nationkey long, n_name string").json(path))[1])(scratch_dir(s)), "SELECT n_nationkey, n_name FROM nation")
add("write_file_lines", lambda s, d: (lambda path: (K.write_file(s, ["b", "", "a"], path), s.read.text(path))[1])(scratch_dir(s)), "SELECT * FROM (VALUES ('b'), (''), ('a')) t(value)")


def _replaced(s, d):
    """A table that is replaced twice, and once by a frame that fails half way: the failure leaves what was there."""
    path, rows = scratch_dir(s), table(s, d, "orders").select("o_orderkey", "o_totalprice")
    K.replace_table(rows.limit(0), path)
    K.replace_table(rows, path)
    try:
        K.replace_table(rows.select("o_orderkey", F.when(F.col("o_orderkey") > 100, F.raise_error(F.lit("half way")).cast("double")).otherwise(F.lit(0.0)).alias("o_totalprice")), path)
    except Exception as e:  # the frame's own error
        if "half way" not in str(e):
            raise
    return s.read.parquet(path)


add("replace_table_or_nothing", _replaced, "SELECT o_orderkey, o_totalprice FROM orders")

# ---- order, chance and flow
add("buffer_shuffle_orders", lambda s, d: R.buffer_shuffle(table(s, d, "orders").select("o_orderkey", "o_custkey"), 100, 7), "SELECT o_orderkey, o_custkey FROM orders")
add("random_triangular_rows", lambda s, d: s.range(8).select("id", V.random_triangular(F.col("id"), 5, F.col("id") % 2 == 0).alias("m")).select("id", F.transform("m", lambda r: F.array_join(F.transform(r, lambda x: F.when(x == 0, F.lit("0")).when((x > 0) & (x < 1), F.lit("u")).otherwise(F.lit("?"))), "")).alias("m")).select("id", F.array_join("m", " ").alias("v")),
    "SELECT i AS id, CASE WHEN i % 2 = 0 THEN 'u0000 uu000 uuu00 uuuu0 uuuuu' ELSE 'uuuuu 0uuuu 00uuu 000uu 0000u' END AS v FROM range(8) t(i)")
add("above_all_numbers", lambda s, d: table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") < V.above_all()).alias("below"), F.least(F.col("o_orderkey").cast("double"), V.above_all()).alias("least")), "SELECT o_orderkey, true AS below, o_orderkey::DOUBLE AS least FROM orders")
add("term_weights_rand", lambda s, d: G.term_weights(B.packed_lists(C.array_only(table(s, d, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("w")), "w"), "doc_id", "w"), "RAND").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("weight") >= 0) & (F.col("weight") < 1)).alias("ok")),
    "SELECT doc_id AS doc, count(DISTINCT token) AS n, true AS ok FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1")


def _retried(s, d):
    """Calls, pauses and results of retried, scheduled and refused functions under a clock of our own."""
    calls, pauses, clock = [], [], [0.0]

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "done"

    rows = [("retry", C.retry(fails_twice, 1.0, 5, 2, sleep=pauses.append)), ("pauses", str(pauses)), ("calls", str(len(calls)))]
    f = C.at_most_every(10, lambda: "ran", lambda: clock[0])
    seen = []
    for t in (0, 5, 9.9, 10, 12, 25):
        clock[0] = t
        seen.append(f() or "-")
    rows.append(("every", " ".join(seen)))
    for name, call in (("tfidf", lambda: G.term_weights(s.range(1).select(F.lit(1).alias("doc"), F.lit("a").alias("token")), "TFIDF")), ("string", lambda: C.array_only(s.range(1).select(F.lit("a").alias("x")), "x"))):
        try:
            call()
        except (NotImplementedError, TypeError) as e:
            rows.append((name, type(e).__name__))
    with C.lasting(3, pauses.append, lambda: clock[0]):
        clock[0] += 1
    rows.append(("lasting", str(pauses[-1])))
    rows.append(("ahead", ",".join(map(str, C.prefetched(iter(range(5)), 2)))))
    return s.createDataFrame(rows, "k string, v string")


add("retry_and_schedule", _retried, "SELECT * FROM (VALUES ('retry', 'done'), ('pauses', '[1.0, 2.0]'), ('calls', '3'), ('every', 'ran - - ran - ran'), ('tfidf', 'NotImplementedError'), ('string', 'TypeError'), ('lasting', '2'), ('ahead', '0,1,2,3,4')) t(k, v)")
add("frame_as_json", lambda s, d: C.frame_json(table(s, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]), """SELECT '{"r_regionkey":[' || string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) || '],"r_name":["' || string_agg(r_name, '","' ORDER BY r_regionkey) || '"]}' AS json FROM region""")
add("consume_rows", lambda s, d: s.createDataFrame([(C.consume(table(s, d, "lineitem")),)], "n long"), "SELECT count(*) AS n FROM lineitem")
add("url_pattern_cases", lambda s, d: s.createDataFrame([("see http://a.b/c?d=1 now",), ("ftp://x.y",), ("none",)], "t string").select("t", F.regexp_extract("t", U.url_pattern(("http", "https")), 0).alias("v")), "SELECT * FROM (VALUES ('see http://a.b/c?d=1 now', 'http://a.b/c?d=1'), ('ftp://x.y', ''), ('none', '')) t(t, v)")
