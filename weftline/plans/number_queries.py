"""Number functions on generated numbers and on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import numbers as N
from weftline.session import table


def on(name, tab, build, sql):
    add(name, lambda s, d: build(table(s, d, tab)), sql)


def num(name, stop, build, sql, start=0):
    """A function of the numbers from start to stop: n, v."""
    add(name, lambda s, d: s.range(start, stop).select(F.col("id").alias("n"), build(F.col("id")).alias("v")), f"SELECT n, {sql} AS v FROM range({start}, {stop}) t(n)")


on("reciprocal_quantity", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", F.round(N.reciprocal(F.col("l_quantity")), 12).alias("v")), "SELECT l_orderkey, l_linenumber, round(1.0 / l_quantity, 12) AS v FROM lineitem")
num("sqr_numbers", 100, lambda c: c * c, "n * n")
on("minmax_keys", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", N.min_max(F.col("l_partkey"), F.col("l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", "m.low", "m.high"),
   "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem")
num("degree_to_rad", 361, lambda c: F.round(F.radians(c), 12), "round(radians(n), 12)")
on("limit_clamp", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", N.clamp(F.col("l_quantity"), 10, 30).cast("double").alias("v")), "SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_quantity, 10), 30) AS DOUBLE) AS v FROM lineitem")
num("relative_luminance", 256, lambda c: F.round(N.luminance(c / 255, F.lit(0.5), 1 - c / 255), 10), "round(0.2126 * (n / 255) + 0.7152 * 0.5 + 0.0722 * (1 - n / 255), 10)")
num("multinomial_numbers", 9, lambda c: N.multinomial(F.array(c, F.lit(3).cast("long"), F.lit(2).cast("long"))), "CAST(factorial((n + 5)::INT) / (factorial(n::INT) * 12) AS DOUBLE)")
add("unique_permutations_words", lambda s, d: s.createDataFrame([(w,) for w in ("", "a", "aab", "mississippi", "abcdefghij")], "w string").select("w", N.unique_permutations(F.col("w")).cast("long").alias("v")),
    "SELECT * FROM (VALUES ('', 1::BIGINT), ('a', 1), ('aab', 3), ('mississippi', 34650), ('abcdefghij', 3628800)) t(w, v)")
add("fibonacci_numbers", lambda s, d: N.fibonacci_numbers(s, 91).select("n", F.col("value").cast("long").alias("value")),
    "WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::HUGEINT, 1::HUGEINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 90) SELECT n, a::BIGINT AS value FROM f")
add("fibonacci_exact", lambda s, d: s.range(182, 183).select(N.fibonacci(F.col("id")).cast("string").alias("v")), "SELECT '48558529144435440119720805669229197641' AS v WHERE false UNION ALL SELECT a::VARCHAR AS v FROM (WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0::HUGEINT, 1::HUGEINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 182) SELECT a FROM f WHERE n = 182)")
num("floordiv2_numbers", 200, lambda c: F.array_join(N.halvings(c), ","), "array_to_string(list_filter(list_transform(range(0, 63), lambda i: n >> i), lambda x: x > 0), ',')")
num("isintlog_numbers", 1100, lambda c: N.is_power(c, 3), "n IN (3, 9, 27, 81, 243, 729)", 1)
num("byte2size_numbers", 60, lambda c: N.byte_size_text(F.pow(F.lit(2.0), c) * 1.5),
    "printf(CASE WHEN n < 10 THEN '%.0f' ELSE '%.3f' END, pow(2, n) * 1.5 / pow(1024, k)) || ' ' || ['Byte', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'][k + 1]".replace("k)", "floor(n / 10))").replace("[k + 1]", "[floor(n / 10)::INT + 1]"), 1)
add("primes_below", lambda s, d: N.primes(s, 2000), "SELECT n FROM range(2, 2000) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) u(m) WHERE m < n AND n % m = 0)")
num("additaet_numbers", 1000, N.triangle_number, "n * (n + 1) // 2")
on("digitsum_orders", "orders", lambda o: o.select("o_orderkey", N.digit_sum(F.col("o_orderkey")).alias("v")), "SELECT o_orderkey, list_sum(list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: c::BIGINT))::BIGINT AS v FROM orders")
num("digitsum_base16", 600, lambda c: N.digit_sum_base(F.hex(c), 16), "list_sum(list_transform(range(0, 4), lambda i: (n >> (4 * i)) & 15))::BIGINT")
on("euclidean_distance_keys", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", F.abs(F.col("l_partkey") - F.col("l_suppkey")).alias("v")), "SELECT l_orderkey, l_linenumber, abs(l_partkey - l_suppkey) AS v FROM lineitem")
num("int2base_36", 3000, lambda c: N.to_base(c - 1500, 36),
    "CASE WHEN n < 1500 THEN '-' ELSE '' END || CASE WHEN n = 1500 THEN '0' ELSE ltrim(" + " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', (abs(n - 1500) // {36**k}) % 36 + 1, 1)" for k in (2, 1, 0)) + ", '0') END")
add("int2base_62", lambda s, d: s.createDataFrame([(61,), (62,), (3844,), (-10,), (9223372036854775807,)], "n long").select("n", N.to_base(F.col("n"), 62).alias("v")), "SELECT * FROM (VALUES (61::BIGINT, 'Z'), (62, '10'), (3844, '100'), (-10, '-a'), (9223372036854775807, 'aZl8N0y58M7')) t(n, v)")
num("factorial_exact", 27, lambda c: N.factorial(c).cast("string"), "factorial(n::INT)::VARCHAR")
num("ceildiv_numbers", 100, lambda c: N.ceil_div(c, F.lit(7)), "-((-n) // 7) + CASE WHEN false THEN 1 ELSE 0 END".replace("-((-n) // 7)", "(n + 6) // 7"))
num("isqrt_numbers", 3000, N.integer_root, "floor(sqrt(n))::BIGINT")
on("dist_embeddings", "embeddings", lambda e: e.select("vec_id", F.round(F.sqrt(F.aggregate(F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda x, y: x + y)), 6).alias("v")),
   "SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE, 2)))), 6) AS v FROM embeddings")
num("prod_numbers", 12, lambda c: N.product(F.transform(F.sequence(F.lit(1).cast("long"), c + 1), lambda x: x.cast("double"))), "factorial((n + 1)::INT)::DOUBLE")
num("ycbcr_numbers", 256, lambda c: F.array_join(F.transform(N.rgb_to_ycbcr(F.array(c / 255, F.lit(0.25), 1 - c / 255)), lambda x: F.round(x * 1000).cast("long")), ","),
    "concat_ws(',', round((65.481 * (n / 255) + 128.553 * 0.25 + 24.966 * (1 - n / 255) + 16) * 1000)::BIGINT, round((-37.797 * (n / 255) - 74.203 * 0.25 + 112.0 * (1 - n / 255) + 128) * 1000)::BIGINT, round((112.0 * (n / 255) - 93.786 * 0.25 - 18.214 * (1 - n / 255) + 128) * 1000)::BIGINT)")
num("hsi_numbers", 64, lambda c: F.array_join(F.transform(N.rgb_to_hsi(F.array(c / 63, F.lit(0.25), F.lit(0.5))), lambda x: F.round(x * 10000).cast("long")), ","),
    "concat_ws(',', round((2 * pi() - acos(greatest(-1.0, least(1.0, ((n / 63) - 0.375) / sqrt(pow(n / 63 - 0.25, 2) + (n / 63 - 0.5) * (0.25 - 0.5)))))) * 10000)::BIGINT, round((1 - least(n / 63, 0.25) / ((n / 63 + 0.75) / 3)) * 10000)::BIGINT, round((n / 63 + 0.75) / 3 * 10000)::BIGINT)")
add("aspect_ratio_rectangles", lambda s, d: s.createDataFrame([(1, [0.0, 0.0, 200.0, 0.0, 200.0, 100.0, 0.0, 100.0], [100.0, 50.0]), (2, [0.0, 0.0, 90.0, 0.0, 90.0, 90.0, 0.0, 90.0], [45.0, 45.0])], "k int, corners array<double>, center array<double>").select("k", F.round(N.rectangle_ratios("corners", "center"), 9).alias("v")),
    "SELECT * FROM (VALUES (1, 0.5), (2, 1.0)) t(k, v)")
