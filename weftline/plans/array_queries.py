"""Vector, matrix and nested-array functions on the embeddings table and on small generated matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import arrays as A
from weftline.operators import joins as J
from weftline.session import table


def on(name, tab, build, sql):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


def vec(name, build, sql, places=5):
    """A number of the two halves of each embedding: vec_id, v."""
    a = lambda: F.slice("embedding", 1, 32)
    b = lambda: F.slice("embedding", 33, 32)
    add(name, lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(build(a(), b()), places).alias("v")),
        f"SELECT vec_id, round({sql}, {places}) AS v FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)")


def whole(name, build, sql, places=5):
    """A number of each whole embedding: vec_id, v."""
    add(name, lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(build(F.col("embedding")), places).alias("v")),
        f"SELECT vec_id, round({sql}, {places}) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)")


def fixed(name, columns, rows, build, expected):
    """A function of literal rows with fixed results: k, v."""
    def q(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    add(name, lambda s, d: s.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {columns}").select("k", build().alias("v")),
        "SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(e)})" for k, e in enumerate(expected)) + ") t(k, v)")


def text(x, depth=1):
    """Nested arrays of numbers as text."""
    if depth == 1:
        return F.array_join(F.transform(x, lambda v: F.round(v.cast("double"), 4).cast("string")), ",")
    return F.array_join(F.transform(x, lambda v: text(v, depth - 1)), ";" * (depth - 1))


vec("dot_embeddings", A.inner, "list_inner_product(a, b)")
whole("euclidean_norm_embeddings", lambda a: A.norm(a), "sqrt(list_inner_product(a, a))")
vec("cosine_similarity_embeddings", A.cosine, "list_cosine_similarity(a, b)")
vec("batch_inner_embeddings", A.inner, "list_inner_product(a, b)")
vec("vector_distance_embeddings", A.distance, "list_distance(a, b)")
vec("batch_outer_trace", lambda a, b: A.total(F.transform(A.outer(a, b), lambda r, i: F.get(r, i))), "list_inner_product(a, b)")
vec("quadratic_form_embeddings", lambda a, b: A.quadratic(A.outer(a, b), b), "list_inner_product(b, a) * list_inner_product(b, b)")
whole("logtrace_embeddings", lambda a: A.log_trace(A.outer(F.transform(a, lambda x: F.abs(x) + 1), F.transform(a, lambda x: F.abs(x) + 1))), "list_sum(list_transform(a, lambda x: 2 * ln(abs(x) + 1)))", 4)
vec("histogram_correlation_embeddings", lambda a, b: A.histogram_correlation(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))),
    "(list_inner_product(a, b) - list_sum(a) * list_sum(b) / 32) / sqrt((list_inner_product(a, a) - pow(list_sum(a), 2) / 32) * (list_inner_product(b, b) - pow(list_sum(b), 2) / 32))", 4)
vec("hamming_dist_signs", lambda a, b: A.hamming(F.transform(a, F.signum), F.transform(b, F.signum)), "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN sign(a[i]) <> sign(b[i]) THEN 1 ELSE 0 END))::BIGINT")
vec("hamming_packed_embeddings", lambda a, b: A.hamming_packed(F.transform(a, lambda x: F.floor(F.abs(x) * 255).cast("int")), F.transform(b, lambda x: F.floor(F.abs(x) * 255).cast("int"))),
    "list_sum(list_transform(range(1, 33), lambda i: bit_count(xor(floor(abs(a[i]) * 255)::INT, floor(abs(b[i]) * 255)::INT))))::BIGINT")
whole("stochastic_rows", lambda a: A.inner(A.stochastic(a), A.stochastic(a)), "list_inner_product(a, a) / pow(list_sum(list_transform(a, lambda x: abs(x))), 2)")
whole("shiftedexp_rows", lambda a: A.total(A.shifted_exp(F.transform(a, lambda x: x.cast("double")))), "list_sum(list_transform(a, lambda x: exp(x - list_max(a))))")
on("batchtopk_embeddings", "embeddings", lambda e: e.select("vec_id", A.top_k(F.col("embedding"), 3).alias("t")).select("vec_id", F.array_join(F.transform("t", lambda x: x["index"]), ",").alias("at"), F.round(F.get("t", 0)["value"].cast("double"), 6).alias("least")),
   "SELECT vec_id, string_agg((i - 1)::VARCHAR, ',' ORDER BY v, i) FILTER (WHERE k <= 3) AS at, round(min(v)::DOUBLE, 6) AS least FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS k FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY 1")
on("batchtopk_reverse", "embeddings", lambda e: e.select("vec_id", F.array_join(F.transform(A.top_k(F.col("embedding"), 2, True), lambda x: x["index"]), ",").alias("at")),
   "SELECT vec_id, string_agg((i - 1)::VARCHAR, ',' ORDER BY v DESC, i) AS at FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)) WHERE k <= 2 GROUP BY 1")
on("sequence_mask_nations", "nation", lambda n: n.select("n_nationkey", F.array_join(F.transform(A.length_mask(F.col("n_regionkey"), 5), lambda b: b.cast("int")), "").alias("v")), "SELECT n_nationkey, repeat('1', n_regionkey::INT) || repeat('0', (5 - n_regionkey)::INT) AS v FROM nation")
fixed("scatter_by_mask", "m array<boolean>, x array<int>", [([True, False, True], [7, 8]), ([False], []), ([True, True, False, True], [1, 2, 3])], lambda: F.array_join(A.scatter(F.col("m"), F.col("x"), F.lit(-1)), ","), ["7,-1,8", "-1", "1,2,-1,3"])
_M = [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14, 15, 16]]
fixed("unblock_matrix", "m array<array<int>>", [(_M,)], lambda: F.array_join(F.transform(A.split_blocks(F.col("m"), 2, 2), lambda b: F.array_join(b, ",")), ";"), ["1,2,5,6;3,4,7,8;9,10,13,14;11,12,15,16"])
fixed("block_matrix", "m array<array<int>>", [(_M,)], lambda: F.array_join(F.flatten(A.join_blocks(A.split_blocks(F.col("m"), 2, 2), 2, 2, 2)), ","), [",".join(str(i) for i in range(1, 17))])
fixed("sliding_window_2d", "m array<array<int>>", [(_M,)], lambda: F.array_join(F.transform(A.windows_2d(F.col("m"), 3, 2, 1, 2), lambda w: F.array_join(F.flatten(w["window"]), ",")), ";"), ["1,2,5,6,9,10;3,4,7,8,11,12;5,6,9,10,13,14;7,8,11,12,15,16"])
fixed("recmap_nested", "m array<array<int>>", [(_M,)], lambda: F.array_join(F.flatten(A.deep_map(F.col("m"), 2, lambda x: x * 2)), ","), [",".join(str(2 * i) for i in range(1, 17))])
fixed("outermap_nested", "m array<array<int>>", [(_M,)], lambda: A.outer_fold(F.col("m"), 2, lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)), [136])
fixed("multimap_chain", "x array<int>", [([1, 2, 3],)], lambda: F.array_join(A.map_chain(F.col("x"), [lambda v: v + 1, lambda v: v * v]), ","), ["4,9,16"])
fixed("zipmap_functions", "x array<int>", [([1, 2, 3],)], lambda: F.array_join(A.zip_map([lambda v: v + 1, lambda v: v * 10, lambda v: -v], F.col("x")), ","), ["2,20,-3"])
fixed("applymap_pairs", "x array<struct<a:int,b:int>>", [([(1, 2), (3, 4)],)], lambda: F.array_join(A.star_map(F.col("x"), lambda a, b: a * b), ","), ["2,12"])
fixed("powerset_small", "x array<int>", [([1, 2, 3],), ([],)], lambda: F.array_join(F.transform(A.powerset(F.col("x")), lambda p: F.array_join(p, ",")), "|"), ["|1|2|3|1,2|1,3|2,3|1,2,3", ""])
fixed("inf_matrix_power", "m array<array<double>>", [([[0.9, 0.1], [0.5, 0.5]],)], lambda: text(F.flatten(A.stationary(F.col("m")))), ["0.8333,0.1667,0.8333,0.1667"])
fixed("viterbi_dense_path", "e array<array<double>>, t array<array<double>>, f array<double>", [([[0.0, 1.0], [2.0, 0.0], [0.0, 3.0]], [[0.5, 0.0], [0.0, 0.5]], [0.0, 0.0]), ([[1.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]], [0.0, 5.0])],
      lambda: F.array_join(A.viterbi_path("e", "t", "f"), ","), ["1,0,1", "1"])
fixed("viterbi_sparse_path", "e array<array<double>>, t array<array<array<double>>>", [([[1.0, 2.0], [0.0, 0.0, 1.0], [5.0]], [[[0.0, 9.0, 0.0], [0.0, 0.0, 0.0]], [[0.0], [0.0], [0.0]]])], lambda: F.array_join(A.viterbi_ragged("e", "t"), ","), ["0,1,0"])
fixed("linear_assignment", "m array<array<double>>", [([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]],), ([[7.0]],)], lambda: A.assignment_cost("m"), [5.0, 7.0])
fixed("solve_triangular", "m array<array<double>>, v array<double>", [([[2.0, 99.0], [1.0, 4.0]], [2.0, 9.0])], lambda: text(A.solve_lower("m", "v")), ["1.0,2.0"])
fixed("solve_triangular_upper", "m array<array<double>>, v array<double>", [([[2.0, 1.0], [99.0, 4.0]], [4.0, 8.0])], lambda: text(A.solve_upper("m", "v")), ["1.0,2.0"])
fixed("cholesky_update_pair", "m array<array<double>>, v array<double>, s double", [([[2.0, 0.0], [1.0, 3.0]], [1.0, 2.0], 1.0), ([[2.0, 0.0], [1.0, 3.0]], [1.0, 1.0], -1.0)], lambda: text(F.flatten(A.cholesky_update("m", "v", "s"))), ["2.2361,0.0,1.7889,3.2863", "1.7321,0.0,0.5774,2.9439"])
fixed("grayscale_histogram", "p array<array<array<int>>>", [([[[1, 2, 3], [0, 0, 1]], [[3, 3, 3], [2, 2, 2]]],)], lambda: F.array_join(A.histogram(F.flatten(A.gray(F.col("p"))), 4), ","), ["1,0,2,1"])
fixed("block_mean_hash", "m array<array<int>>", [(_M,)], lambda: A.block_mean_bits(F.col("m"), 2), ["0011"])
fixed("hu_moments_image", "m array<array<double>>", [([[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 0.0]],)], lambda: text(A.hu_moments("m")), ["0.1111,0.0,0.0,0.0,0.0,0.0,0.0"])
# COO and ragged matrices are tables of coordinates: a cell is a row, a missing one the default.
on("sparse_matrix_rows", "lineitem", lambda x: x.groupBy((F.col("l_partkey") % 7).alias("i"), (F.col("l_suppkey") % 5).alias("j")).agg(F.sum("l_quantity").cast("double").alias("v")).where("v <> 0"), "SELECT l_partkey % 7 AS i, l_suppkey % 5 AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2")
on("variable_row_matrix", "orders", lambda o: o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("width"), F.max("o_orderkey").alias("last")), "SELECT o_custkey, count(*) AS width, max(o_orderkey) AS last FROM orders GROUP BY 1")
# Distances of a stated query set against all rows.
add("hamming_chunked_queries", lambda s, d: J.sign_distances(table(s, d, "embeddings").select("vec_id", "embedding"), table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("y")), "vec_id", "embedding", "q", "y", "dist"),
    "SELECT b.vec_id AS q, a.vec_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CASE WHEN sign(a.embedding[i]) <> sign(b.embedding[i]) THEN 1 ELSE 0 END))::BIGINT AS dist FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
