"""Sampled topics, frames, regression and the last of the text and search functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import arrays as V
from weftline.functions import text as X
from weftline.operators import blocks as B
from weftline.operators import images as I
from weftline.operators import joins as J
from weftline.operators import texts as T
from weftline.operators import topics as G
from weftline.session import table

_tok = lambda s, d: B.packed(table(s, d, "documents"), "doc_id", "text")


def _gibbs(scheme):
    def run(s, d):
        tok = _tok(s, d)
        vocab = T.vocabulary(tok)
        found, counts = G.sample_topics(tok, vocab, 3, 2, scheme=scheme)
        return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("topic").between(0, 2)).alias("ok"))

    return run


_WORDS = "(SELECT doc, token FROM (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM documents))"
_IN = f"SELECT doc, count(*) AS n, true AS ok FROM {_WORDS} GROUP BY 1"
add("lda_gibbs", _gibbs("ONE"), _IN)
add("lda_term_weight_gibbs", _gibbs("PMI"), _IN)


def _gibbs_counts(s, d):
    tok = _tok(s, d)
    vocab = T.vocabulary(tok)
    _, counts = G.sample_topics(tok, vocab, 3, 1)
    n = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    return counts.join(vocab, "idx").select("token", n.cast("long").alias("n"), F.size("counts").cast("long").alias("topics"))


add("lda_gibbs_counts", _gibbs_counts, f"SELECT token, count(*) AS n, 3::BIGINT AS topics FROM {_WORDS} GROUP BY 1")
for _w in ("ONE", "TF", "IDF", "PMI"):
    _sql = {"ONE": "1.0::DOUBLE", "TF": "-log2(count(*) OVER (PARTITION BY token) / count(*) OVER ())", "IDF": "log2((SELECT count(DISTINCT doc) FROM w) / count(DISTINCT doc) OVER (PARTITION BY token))", "PMI": "greatest(log2(count(*) OVER (PARTITION BY token) / count(*) OVER (PARTITION BY doc, token)), 0)"}[_w]
    add(f"term_weights_{_w.lower()}", lambda s, d, w=_w: G.term_weights(_tok(s, d), w).withColumn("weight", F.round("weight", 6)), f"WITH w AS (SELECT * FROM {_WORDS}) SELECT DISTINCT doc, token, round({_sql}, 6) AS weight FROM w")


def _infer(s, d):
    tok = _tok(s, d)
    vocab = T.vocabulary(tok)
    _, counts = G.sample_topics(tok, vocab, 3, 1)
    return G.infer(tok, vocab, counts, 3, 2).select("doc", F.size("topics").cast("long").alias("n"), F.forall("topics", lambda t: t.between(0, 2)).alias("ok"))


add("lda_infer_frozen", _infer, _IN)
add("lda_generate", lambda s, d: G.generate(s.createDataFrame([(1, 5), (2, 0), (3, 7)], "doc long, n int"), s.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc long, weights array<double>"), s.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.5, 0.5])], "topic int, weights array<double>")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.when(F.col("topic") == 0, F.col("word") == 0).otherwise(F.col("word") > 0)).alias("ok")),
    "SELECT * FROM (VALUES (1::BIGINT, 5::BIGINT, true), (3, 7, true)) t(doc, n, ok)")
add("categorical_shares", lambda s, d: s.range(20000).select(G.categorical(F.col("id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))).alias("k")).groupBy("k").agg((F.count(F.lit(1)) / 20000).alias("share")).select("k", (F.abs(F.col("share") - F.when(F.col("k") == 0, 0.25).otherwise(0.75)) < 0.02).alias("ok")), "SELECT * FROM (VALUES (0, true), (2, true)) t(k, ok)")
add("sampler_from_cdf", lambda s, d: s.range(1000).select(G.categorical(F.col("id"), F.array(*[F.lit(1.0)] * 4), 5).alias("k")).agg(F.count_distinct("k").alias("n")), "SELECT CAST(4 AS BIGINT) AS n")

# ---- frames: the embeddings as films of 8-level histograms
_FRAMES = lambda s, d: table(s, d, "embeddings").select("label", "vec_id", V.histogram(F.transform("embedding", lambda x: F.least(F.floor(F.abs(x) * 20), F.lit(7)).cast("int")), 8).alias("h"))
_H = "(SELECT label, vec_id, list_transform(range(8), lambda b: len(list_filter(embedding, lambda x: least(floor(abs(x) * 20), 7) = b))::DOUBLE) AS h FROM embeddings)"
_DOT = lambda a, b: f"list_inner_product({a}, {b})"
add("scene_change_correlation", lambda s, d: I.change_by_correlation(_FRAMES(s, d), "h", ["vec_id"], ["label"]).select("vec_id", F.round("correlation", 5).alias("correlation")),
    f"SELECT vec_id, round(({_DOT('h', 'f')} - list_sum(h) * list_sum(f) / 8) / sqrt(({_DOT('h', 'h')} - pow(list_sum(h), 2) / 8) * ({_DOT('f', 'f')} - pow(list_sum(f), 2) / 8)), 5) AS correlation FROM (SELECT *, first_value(h) OVER w AS f, row_number() OVER w AS k FROM {_H} WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE k > 1")
add("scene_change_blocks", lambda s, d: I.change_by_blocks(_FRAMES(s, d), "h", ["vec_id"], ["label"]).select("vec_id", F.aggregate("change", F.lit(0).cast("long"), lambda a, x: a + x).alias("change")),
    f"SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: abs(h[i] - b[i])))::BIGINT AS change FROM (SELECT *, lag(h) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM {_H}) WHERE b IS NOT NULL")
_PIXELS = [[[10, 20, 30], [200, 100, 50]], [[0, 0, 255], [90, 90, 90]]]
add("moment_hash_image", lambda s, d: s.createDataFrame([(_PIXELS,)], "p array<array<array<int>>>").select(F.size(I.moment_hash(I.channels(F.col("p")))).alias("n")), "SELECT 42 AS n")
add("linear_regression_exact", lambda s, d: (lambda df: (lambda w: df.select("id", F.round(I.predict([F.col("a"), F.col("b")], *w), 6).alias("y")))(I.least_squares(df, ["a", "b"], "y")))(s.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")).withColumn("y", F.col("a") * 2.0 - F.col("b") * 3.0 + 1)),
    "SELECT i AS id, (i % 7) * 2.0::DOUBLE - (i % 5) * 3.0::DOUBLE + 1 AS y FROM range(50) t(i)")
add("linear_regression_prices", lambda s, d: (lambda o: s.createDataFrame([I.least_squares(o, ["o_custkey"], "o_totalprice")], "b double, w array<double>").select(F.round("b", 2).alias("b"), F.round(F.get("w", 0), 4).alias("w")))(table(s, d, "orders")),
    "SELECT round(regr_intercept(o_totalprice, o_custkey), 2) AS b, round(regr_slope(o_totalprice, o_custkey), 4) AS w FROM orders")

# ---- the last of the scalar functions
add("bisect_generic", lambda s, d: s.createDataFrame([(J.bisect_predicate(0, 100, lambda i: (i > 37) - (i < 37)), J.bisect_predicate(0, 100, lambda i: (i > 37) - (i < 37), True))], "a long, b long"), "SELECT CAST(37 AS BIGINT) AS a, CAST(38 AS BIGINT) AS b")
add("hamming_distance_bytes", lambda s, d: table(s, d, "nation").select("n_nationkey", X.hamming_bytes(F.encode(F.md5(F.col("n_name").cast("binary")), "UTF-8"), F.encode(F.md5(F.encode(F.lit("x"), "UTF-8")), "UTF-8")).alias("v")),
    "SELECT n_nationkey, list_sum(list_transform(range(1, 33), lambda i: bit_count(xor(ascii(md5(n_name)[i]), ascii(md5('x')[i])))))::BIGINT AS v FROM nation")
add("backslash_escaped_ascii", lambda s, d: s.createDataFrame([("aé\n",), ("x",)], "t string").select("t", X.escaped_ascii(F.encode("t", "UTF-8")).alias("v")), "SELECT * FROM (VALUES ('aé' || chr(10), 'a\\xc3\\xa9' || chr(10)), ('x', 'x')) t(t, v)")
