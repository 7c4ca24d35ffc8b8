"""Operators on small inputs with fixed results: empty, null, single and tied rows too."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregates as A
from weftline.operators import blocks as B
from weftline.operators import control as C
from weftline.operators import graphs as G
from weftline.operators import joins as J
from weftline.operators import ranking as R
from weftline.operators import sequences as S
from weftline.operators import tables as TB
from weftline.operators import texts as TX
from weftline.operators import topics as TP
from weftline.operators.ordering import carried, running_sum, with_index


def seq(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")


def xs(df, column="x"):
    return [r[column] for r in df.orderBy("i").collect()]


PEAKS = [([1, 2, 3, 2, 1], [3], [1, 1]), ([3, 2, 1, 2, 3], [3, 3], [1]), ([], [], []), ([1], [1], [1])]


@pytest.mark.parametrize(("values", "peaks", "valleys"), PEAKS)
def test_peaks_and_valleys(spark, values, peaks, valleys):
    df = seq(spark, values)
    assert xs(S.peaks(df, "x", ["i"])) == peaks
    assert xs(S.valleys(df, "x", ["i"])) == valleys


def test_runs(spark):
    df = seq(spark, [1, 1, 2, 2, 3, 3, 4, 4])
    assert xs(S.collapse_any(df, "x", [1, 2], ["i"])) == [1, 2, 3, 3, 4, 4]
    assert xs(S.collapse_all(df, "x", [1, 2], F.lit(5), ["i"])) == [5, 3, 3, 4, 4]
    assert xs(S.remove_consecutive_dupes(df, "x", ["i"])) == [1, 2, 3, 4]
    assert xs(S.remove_consecutive_dupes(seq(spark, [None, None, 1, None]), "x", ["i"])) == [None, 1, None]
    assert xs(S.asc_peaks(seq(spark, [1, 2, 2, 1, 5]), "x", ["i"])) == [2, 5]
    assert xs(S.asc_peaks(seq(spark, []), "x", ["i"])) == []


def test_pairs_windows_batches(spark):
    df = seq(spark, [1, 2, 3, 4, 5])
    assert [(r["x"], r["x_next"]) for r in S.pairwise(df, "x", ["i"]).orderBy("i").collect()] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert S.pairwise(seq(spark, [1]), "x", ["i"]).count() == 0
    assert [r["window"] for r in S.x_wise(df, "x", 3, ["i"]).orderBy("i").collect()] == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert [r["window"] for r in S.sliding_window(df, "x", 2, 2, ["i"]).orderBy("i").collect()] == [[1, 2], [3, 4]]
    assert [r["values"] for r in S.batch(df, "x", 2, ["i"]).orderBy("batch").collect()] == [[1, 2], [3, 4], [5]]
    assert [r["values"] for r in S.batch(seq(spark, [None, 1, None]), "x", 2, ["i"]).orderBy("batch").collect()] == [[None, 1], [None]]
    with pytest.raises(ValueError):
        S.batch(df, "x", 0, ["i"])
    slices = spark.createDataFrame([(0, list("asd")), (1, list("qw")), (2, list("e"))], "i long, s array<string>")
    assert ["".join(r["values"]) for r in S.resizer(slices, "s", 4, ["i"]).orderBy("batch").collect()] == ["asdq", "we"]
    assert ["".join(r["values"]) for r in S.resizer(slices, "s", 4, ["i"], (), F.lit("_")).orderBy("batch").collect()] == ["asdq", "we__"]


def test_gaps_and_spikes(spark):
    assert xs(S.fill_gaps(seq(spark, [1, 1, 0, 1, 1, 0]), "x", ["i"]), "filled") == [1, 1, 1, 1, 1, 0]
    assert xs(S.remove_spikes(seq(spark, [0, 0, 1, 0, 0, 1]), "x", ["i"]), "smoothed") == [0, 0, 0, 0, 0, 1]


def test_positions(spark):
    df = seq(spark, list(range(10)))
    assert xs(S.every_n(df, 3, ["i"], (), 1)) == [1, 4, 7]
    assert xs(S.select_by_indices(df, [0, 4], ["i"])) == [0, 4]
    assert xs(S.select_by_indices(df, [0, 4], ["i"], (), True)) == [1, 2, 3, 5, 6, 7, 8, 9]
    assert xs(S.positions(df, 7, None, ["i"])) == [7, 8, 9]
    slots = spark.createDataFrame([(0, True), (1, False), (2, True)], "i long, s boolean")
    data = spark.createDataFrame([(0, "A"), (1, "B")], "j long, v string")
    assert xs(S.decompress(slots, "s", data, "v", ["i"], ["j"]), "v") == ["A", None, "B"]


def test_global_index_over_many_partitions(spark):
    rows = list(range(500))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "k long").repartition(7)
    assert all(r["k"] == r["_idx"] for r in with_index(df, ["k"]).collect())
    assert with_index(df.limit(0), ["k"]).count() == 0


def test_global_index_of_wide_rows_and_ties(spark, sf_dir):
    """Small target sizes make adaptive execution coalesce partitions by their bytes; positions must not depend on the columns that are asked for."""
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        got = with_index(rows, ["l_partkey"])
        n = rows.count()
        at = got.select("_idx", "l_partkey", "l_comment" if "l_comment" in rows.columns else "l_orderkey").collect()
        assert sorted(r[0] for r in at) == list(range(n))
        keys = [r[1] for r in sorted(at)]
        assert keys == sorted(keys)
        assert got.select(rows.columns).exceptAll(rows).isEmpty() and got.count() == n
        assert S.every_n(rows, 2, ["l_orderkey", "l_linenumber"]).count() == (n + 1) // 2
        one = spark.range(5000).select(F.lit(1).alias("k"), "id")
        assert with_index(one, ["k"]).agg(F.count_distinct("_idx"), F.max("_idx")).first()[:] == (5000, 4999)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_sums_and_carried_values(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(-5, 5), rng.choice([None, None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, x long, y long").repartition(9)
    sums, last, s, y = {}, {}, 0, None
    for k, x, v in rows:
        s, y = s + x, v if v is not None else y
        sums[k], last[k] = s, y
    assert {r["k"]: r["s"] for r in running_sum(df, "x", ["k"], "s").collect()} == sums
    assert {r["k"]: r["y"] for r in carried(df, ["y"], ["k"]).collect()} == last
    nxt, y = {}, None
    for k, _, v in reversed(rows):
        y = v if v is not None else y
        nxt[k] = y
    assert {r["k"]: r["y"] for r in carried(df, ["y"], ["k"], forward=False).collect()} == nxt
    assert running_sum(df.limit(0), "x", ["k"], "s").count() == carried(df.limit(0), ["y"], ["k"]).count() == 0


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_split_asof_is_the_same(spark, direction, by):
    rng = random.Random(4)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for k in range(200)]
    right = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for k in range(60)]
    a, b = spark.createDataFrame(left, "id long, g string, t long"), spark.createDataFrame(right, "rid long, g string, t long")
    if not by:
        b = b.withColumnRenamed("g", "g2").drop("g2")
    one, two = (J.asof(x, y, "t", w, direction, split=s) for x, y, w, s in ((a, b, by, True), (a.withColumn("_z", F.lit(1)), b.withColumn("_z", F.lit(1)), [*by, "_z"], False)))
    assert one.columns == two.drop("_z").columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.drop("_z").collect()))


def test_metric_search(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string")
    asked = df.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("w").alias("q"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        return row[-1]

    got = {(r["qid"], r["id"], r["distance"]) for r in J.metric_search(df, asked, "w", "q", F.levenshtein, 2, [F.lit("abc"), F.lit("")]).collect()}
    every = [(q, i, edits(words[q], w)) for q in range(0, len(words), 9) for i, w in enumerate(words)]
    assert got == {x for x in every if x[2] <= 2}
    near = [(r["qid"], r["rank"], r["id"], r["distance"]) for r in J.metric_nearest(df, asked, "id", "w", "qid", "q", F.levenshtein, 3).collect()]
    expected = []
    for q in range(0, len(words), 9):
        best = sorted((d, i) for x, i, d in every if x == q)[:3]
        expected += [(q, k, i, d) for k, (d, i) in enumerate(best, 1)]
    assert sorted(near) == sorted(expected)
    assert J.metric_nearest(df, asked.limit(0), "id", "w", "qid", "q", F.levenshtein).count() == 0


def _counted(spark):
    """A metric on numbers that counts how often it is computed."""
    calls = spark.sparkContext.accumulator(0)

    def apart(a, b):
        calls.add(1)
        return None if a is None or b is None else abs(a - b)

    return F.udf(apart, "int"), calls


def _copies(spark):
    df = spark.range(1200).select("id", (F.col("id") % 6 * 2).cast("int").alias("x")).union(spark.createDataFrame([(5000, None)], "id long, x int"))
    return df, df.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("x").alias("q"))


def test_metric_search_computes_equal_values_once(spark):
    distance, calls = _counted(spark)
    df, asked = _copies(spark)
    got = J.metric_search(df, asked, "x", "q", distance, 2, [F.lit(0)]).select("qid", "id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted((q, i, abs(q % 6 - i % 6) * 2) for q in range(0, 1200, 50) for i in range(1200) if abs(q % 6 - i % 6) <= 1)
    assert calls.value < 3000  # of 24 * 1200 pairs; a row may be asked once for its distance from the pivot


def test_metric_nearest_computes_equal_values_once(spark):
    distance, calls = _counted(spark)
    df, asked = _copies(spark)
    got = J.metric_nearest(df, asked, "id", "x", "qid", "q", distance, 3).collect()
    assert sorted(map(tuple, got)) == sorted((q, k + 1, q % 6 + 6 * k, 0) for q in range(0, 1200, 50) for k in range(3))
    assert calls.value < 500


def test_pairs_of_a_hot_key_are_many_tasks_work(spark):
    prices = spark.range(4000).select("id", F.lit(7.5).alias("x"))
    asked = prices.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("x").alias("q"))
    tasks = [r["count"] for r in J.metric_range(prices, asked, "x", "q", 1.0, 0.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 4000 * 80 and max(tasks) < sum(tasks) / 2


def test_manhattan_search_against_brute_force(spark):
    rng = random.Random(5)
    near = [[rng.choice([0.0, 0.5, 1.0, -0.0]) for _ in range(5)] for _ in range(150)]
    odd = [None, [], [None] * 5, [float("nan")] * 5, [1.0] * 4, [float("inf")] * 5, [1.0, None, 1.0, 1.0, 1.0]]
    vectors = near + odd + near[:3]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    asked = df.select(F.col("id").alias("qid"), F.col("v").alias("q")).where("id % 3 = 0 OR id >= 150")
    got = [(r["qid"], r["id"]) for r in J.manhattan_search(df, asked, "id", "v", "qid", "q", 1.5).collect()]
    whole = {i: v for i, v in enumerate(vectors) if v is not None and None not in v}
    apart = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)) <= 1.5
    assert sorted(got) == sorted((q, i) for q, a in whole.items() if q % 3 == 0 or q >= 150 for i, b in whole.items() if len(a) == len(b) and apart(a, b))
    # Blocks are compared by numbers, not pair by pair in an interpreted expression.
    assert "MapInArrow" in J.manhattan_search(df, asked, "id", "v", "qid", "q", 1.5)._jdf.queryExecution().toString()


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_against_brute_force(spark, direction):
    rng = random.Random(3)
    left = [(k, rng.choice("ab"), rng.randint(0, 40)) for k in range(60)]
    right = [(k, rng.choice("ab"), rng.randint(0, 40)) for k in range(25)]
    got = J.asof(spark.createDataFrame(left, "id long, g string, t long"), spark.createDataFrame(right, "rid long, g string, t long"), "t", ["g"], direction)
    for r in got.collect():
        own = [x for x in right if x[1] == r["g"]]
        if direction == "backward":
            own = [x for x in own if x[2] <= r["t"]]
            want = max((x[2] for x in own), default=None)
        elif direction == "forward":
            own = [x for x in own if x[2] >= r["t"]]
            want = min((x[2] for x in own), default=None)
        else:
            want = min(((abs(x[2] - r["t"]), x[2]) for x in own), default=(0, None))[1]
        assert r["r_t"] == want
        assert r["r_rid"] == min((x[0] for x in own if x[2] == want), default=None)
    with pytest.raises(ValueError):
        J.asof(got, got, "t", [], "sideways")


def test_band_and_range_join_against_brute_force(spark):
    rng = random.Random(5)
    a, b = [rng.randint(-30, 30) for _ in range(50)], [rng.randint(-30, 30) for _ in range(50)]
    left, right = (spark.createDataFrame([(x,) for x in v], f"{n} long") for v, n in ((a, "a"), (b, "b")))
    got = sorted((r["a"], r["b"]) for r in J.band_join(left, right, "a", "b", -2, 3).collect())
    assert got == sorted((x, y) for x in a for y in b if -2 <= y - x <= 3)
    ranges = [(k, float(s), s + rng.randint(0, 9) + 0.5) for k, s in enumerate(range(-30, 30, 4))]
    got = sorted((r["a"], r["k"]) for r in J.range_join(left.select(F.col("a").cast("double").alias("a")), spark.createDataFrame(ranges, "k long, s double, e double"), "a", "s", "e", 5.0).collect())
    assert got == sorted((float(x), k) for x in a for k, s, e in ranges if s <= x < e)


def test_latest_and_upserts(spark):
    history = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), (None, 5, "c"), ("q", 1, None)], "k string, v long, d string")
    assert sorted((r["k"] or "", r["d"]) for r in TB.latest(history, ["k"], ["v"]).collect()) == [("", "c"), ("p", "b"), ("q", None)]
    target = spark.createDataFrame([(1, "x", "kept"), (2, "y", "old")], "k long, m string, d string")
    batch = spark.createDataFrame([(1, "x"), (2, "changed"), (3, "new")], "k long, m string")
    kept = {r["k"]: r["d"] for r in TB.add_rows(target, batch, ["k"], ["m"], ["d"], False).collect()}
    assert kept == {1: "kept", 2: None, 3: None}
    assert {r["k"]: r["d"] for r in TB.add_rows(target, batch, ["k"], ["m"], ["d"], True).collect()} == {1: None, 2: None, 3: None}
    with pytest.raises(TB.NoResult):
        TB.find_one(target.where("k = 9"))
    with pytest.raises(TB.InconsistentState):
        TB.find_one(target)


def test_limit_balanced_against_definition(spark):
    rng = random.Random(7)
    for _ in range(4):
        counts = {f"c{i}": rng.randint(0, 12) for i in range(6)}
        total = rng.randint(0, sum(counts.values()))
        df = spark.createDataFrame(list(counts.items()), "c string, n long")
        quota = {r["c"]: r["quota"] for r in A.limit_balanced(df, "c", "n", total).collect()}
        assert sum(quota.values()) == total and all(0 <= quota[c] <= counts[c] for c in counts)
        short = [quota[c] for c in counts if quota[c] < counts[c]]  # those cut are level, and nobody else has more than one above
        assert not short or max(short) - min(short) <= 1 and max(quota.values()) <= max(short) + 1


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree(spark):
    tree = spark.createDataFrame([(["a", "b"], 1), (["a"], 2), (["c", "d", "e"], 3)], "keys array<string>, value int")
    asked = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["a", "x"]), (3, ["c", "d"]), (4, [])], "q long, s array<string>")
    got = {r["q"]: (r["prefix"], r["value"]) for r in G.longest_prefix(asked, "s", tree, ids=["q"]).collect()}
    assert got == {1: (["a", "b"], 1), 2: (["a"], 2), 3: (None, None), 4: (None, None)}
    assert tuple(G.tree_statistics(tree).first()) == (3, 2, 3)


def test_buffer_sort(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(0, 99)) for g in range(4) for i in range(50)]
    got = R.buffer_sort(spark.createDataFrame(rows, "g long, i long, x long"), "x", 5, ["i"], ["g"]).collect()
    for g in range(4):
        assert [r["x"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])] == list(R.buffer_sorted([x for a, _, x in rows if a == g], 5))
    assert list(R.buffer_sorted([3, 1, 2], 5)) == [1, 2, 3]


def test_cycle_swaps(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 5) for _ in range(n)],) for n in range(12)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", R.cycle_swaps("x").alias("s")).collect():
        x = list(r["x"])
        for i, j in r["s"]:
            x[i], x[j] = x[j], x[i]
        assert x == sorted(x)


def test_retry_and_rate(spark):
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 4:
            raise KeyError
        return "done"

    assert C.retry(fails, 1, 5, 2, 3, (KeyError,), waits.append) == "done" and waits == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        C.retry(lambda: 1 / 0, 0, 2, sleep=lambda _: None)
    clock = iter([0.0, 0.5, 2.0])
    f = C.at_most_every(1, lambda: "ran", lambda: next(clock))
    assert [f(), f(), f()] == ["ran", None, "ran"]


def test_cache_expires(spark, tmp_path):
    built, now = [], [1e12]

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert C.cached(spark, str(tmp_path), ("k",), build).count() == 3
    assert len(built) == 1
    assert C.cached(spark, str(tmp_path), ("k",), build, 10, lambda: now[0]).count() == 3 and len(built) == 2
    assert C.compose(lambda x: x + 1, lambda x: x * 2)(5) == 11


def test_split_by_label_and_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "k long, y long")
    assert {r["y"]: r["n"] for r in R.train_test_split(df, "y", ["k"], 0.2).where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 6, 1: 6, 2: 6}
    a, b = (R.sample_range(spark, 100, 10, seed).collect() for seed in (1, 1))
    assert a == b
    with pytest.raises(ValueError):
        R.sample_range(spark, 5, 6)


def test_rectangle_in_perspective():
    """A rectangle of known sides, turned in space and projected through a camera of known focal length."""
    import numpy as np

    from weftline.functions.numbers import rectangle_ratio

    rng = np.random.default_rng(3)
    for _ in range(20):
        w, h, focal = rng.uniform(1, 5), rng.uniform(1, 5), 800.0
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        tilt = np.linalg.qr(np.eye(3) + 0.3 * q)[0]
        points = np.array([[0, 0, 0], [w, 0, 0], [w, h, 0], [0, h, 0]]) @ tilt.T + [0, 0, 20]
        seen = focal * points[:, :2] / points[:, 2:] + [320, 240]
        assert rectangle_ratio(seen, np.array([320, 240]), focal) == pytest.approx(h / w, rel=1e-6)
        assert rectangle_ratio(seen, np.array([320, 240])) == pytest.approx(h / w, rel=1e-3)


def test_rotations_update_a_factor():
    import numpy as np

    from weftline.functions.arrays import rotated

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        m = rng.normal(size=(n, n))
        low, x = np.linalg.cholesky(m @ m.T + n * np.eye(n)), rng.normal(size=n) / 3
        for sign in (1, -1):
            assert rotated(low, x, sign) == pytest.approx(np.linalg.cholesky(low @ low.T + sign * np.outer(x, x)))
    with pytest.raises(ValueError):
        rotated(np.eye(2), np.array([2.0, 0.0]), -1)


def test_shuffle_buffer_and_prefetch():
    values = list(range(1000))
    out = list(R.buffer_shuffled(iter(values), 50, 3))
    assert sorted(out) == values and out != values and all(v <= i + 50 for i, v in enumerate(out))
    assert list(R.buffer_shuffled(iter(values), 1)) == values and list(R.buffer_shuffled(iter([]), 9)) == []
    assert list(C.prefetched(iter(values), 3)) == values

    def fails():
        yield 1
        raise KeyError("x")

    with pytest.raises(KeyError):
        list(C.prefetched(fails(), 2))
    assert next(C.prefetched(iter(int, 1), 2)) == 0  # an endless source ends with its reader


# ---- topics


def _two_subjects(spark, parts=3):
    rows = [(d, p, w) for d in range(24) for p, w in enumerate(random.Random(d).choices("abcd" if d % 2 else "wxyz", k=30))]
    tok = spark.createDataFrame(rows, "doc long, pos int, token string").repartition(parts)
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate("abcdwxyz")], "token string, idx long")
    return tok, vocab


def test_sampled_topics_part_two_subjects(spark):
    tok, vocab = _two_subjects(spark)
    found, counts = TP.sample_topics(tok, vocab, 2, 15, seed=3)
    rows = found.collect()
    assert len(rows) == 24 * 30
    mains = {d: max((0, 1), key=[r["topic"] for r in rows if r["doc"] == d].count) for d in range(24)}
    assert {mains[d] for d in range(0, 24, 2)} != {mains[d] for d in range(1, 24, 2)}
    assert len({mains[d] for d in range(0, 24, 2)}) == len({mains[d] for d in range(1, 24, 2)}) == 1
    brute = {}
    for r in rows:
        brute.setdefault(r["idx"], [0.0, 0.0])[r["topic"]] += 1
    assert {r["idx"]: r["counts"] for r in counts.collect()} == brute
    # New documents take the topic of their subject.
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 2, "unknown"), (2, 0, "z"), (2, 1, "w")], "doc long, pos int, token string")
    told = {r["doc"]: r["topics"] for r in TP.infer(new, vocab, counts, 2).collect()}
    assert told == {1: [mains[1]] * 2, 2: [mains[0]] * 2}


def test_sampled_topics_do_not_depend_on_partitions(spark):
    results = []
    for parts in (1, 7):
        tok, vocab = _two_subjects(spark, parts)
        found, _ = TP.sample_topics(tok, vocab, 2, 2, scheme="RAND")
        results.append(sorted(tuple(r) for r in found.collect()))
    assert results[0] == results[1]


def test_sampled_topics_of_empty_and_odd_rows(spark):
    tok, vocab = _two_subjects(spark)
    found, counts = TP.sample_topics(tok.limit(0), vocab, 2, 1)
    assert found.count() == counts.count() == 0
    assert TP.infer(tok, vocab, counts, 2, 1).count() == 24
    odd = spark.createDataFrame([(None, 0, "a"), (5, 0, None), (6, 0, "a"), (6, 1, "a")], "doc long, pos int, token string")
    assert {(r["doc"], r["pos"], r["idx"]) for r in TP.sample_topics(odd, vocab, 2, 1)[0].collect()} == {(6, 0, 0), (6, 1, 0)}


def test_sweep_is_that_of_one_word_after_another():
    import numpy as np

    rng, topics, size, alpha, beta = np.random.default_rng(4), 3, 9, 0.1, 0.01
    sizes = np.array([5, 1, 12, 3])
    codes, weights = rng.integers(0, size, sizes.sum()), rng.random(sizes.sum())
    for frozen in (False, True):
        now, known, totals = rng.integers(0, topics, sizes.sum()), rng.random((size, topics)) * 9 + 3, np.array([30.0, 40.0, 50.0])
        draws, expected, at = [rng.random(n) for n in sizes], [], 0
        for n, drawn in zip(sizes, draws, strict=True):
            z, seen, every = list(now[at : at + n]), known.copy(), totals.copy()
            own = np.bincount(z, weights[at : at + n], topics)
            for i in range(n):
                t, w = codes[at + i], weights[at + i]
                for sign in (-1, 1):
                    own[z[i]] += sign * w
                    if not frozen:
                        seen[t, z[i]] += sign * w
                        every[z[i]] += sign * w
                    if sign < 0:
                        p = np.cumsum((own + alpha / topics) * (seen[t] + beta / size) / (every + beta))
                        z[i] = int(min(np.searchsorted(p, drawn[i] * p[-1], side="right"), topics - 1))
            expected += z
            at += n
        key, pair = np.unique(np.repeat(np.arange(4), sizes) * size + codes, return_inverse=True)
        TP._swept(now, codes, weights, pair, known if frozen else known[key % size], sizes, draws, totals, size, alpha, beta, frozen)
        assert now.tolist() == expected


# ---- words in blocks


def _texts(spark):
    rows = [(i, " ".join(random.Random(i).choices(["a", "B", "b", f"x{i}"], k=i % 7))) for i in range(40)]
    rows += [(100, None), (101, "\t \n"), (None, "a q"), (102, "a  b\nA")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("repeats", [False, True])
def test_blocks_encode_and_decode(spark, repeats):
    rows, docs = _texts(spark)
    if repeats:
        rows, docs = rows + [(102, "z")], docs.union(spark.createDataFrame([(102, "z")], "doc_id long, text string"))
    blocks = B.packed(docs, "doc_id", "text")
    vocab = TX.vocabulary(blocks)
    plain = {r["token"]: (r["count"], r["idx"]) for r in TX.vocabulary(TX.tokens(docs, "doc_id", "text")).collect()}
    assert {r["token"]: (r["count"], r["idx"]) for r in vocab.collect()} == plain
    words = {}
    for i, t in rows:
        for p, w in enumerate((t or "").lower().split()):
            words.setdefault(i, []).append((p, plain[w][1], w))
    ids = TX.transform(blocks, vocab)
    assert {r["doc"]: r["ids"] for r in ids.collect()} == {i: [k for _, k, _ in sorted(w)] for i, w in words.items()}
    assert {r["doc"]: r["tokens"] for r in TX.inverse_transform(ids, vocab).collect()} == {i: [t for _, _, t in sorted(w)] for i, w in words.items()}
    few = vocab.where("token IN ('a', 'q')")
    assert {r["doc"] for r in TX.transform(blocks, few).collect()} == {i for i, w in words.items() if {"a", "q"} & {t for _, _, t in w}}


def test_blocks_give_the_weights_of_a_table_of_words(spark):
    docs = _texts(spark)[1].where("doc_id IS NOT NULL")
    blocks, tok = B.packed(docs, "doc_id", "text"), TX.tokens(docs, "doc_id", "text")
    for scheme in ("ONE", "TF", "IDF", "PMI", "RAND"):
        got, want = ({(r["doc"], r["token"]): r["weight"] for r in TP.term_weights(t, scheme, 3).collect()} for t in (blocks, tok))
        assert got == pytest.approx(want)


def test_only_distinct_words_of_a_block_meet_a_vocabulary(spark):
    docs = spark.createDataFrame([(i, "the same words " * 50) for i in range(100)], "doc_id long, text string").coalesce(1)
    blocks = B.packed(docs, "doc_id", "text")
    assert B.entries(blocks).count() == 3  # and not 15000 words
    plan = TX.transform(blocks, TX.vocabulary(blocks))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_sampled_topics_of_blocks_are_those_of_words(spark):
    docs = _texts(spark)[1]
    blocks, tok = B.packed(docs, "doc_id", "text"), TX.tokens(docs, "doc_id", "text")
    vocab = TX.vocabulary(blocks).where("token <> 'b'").select("token", "idx")
    for scheme in ("ONE", "PMI"):
        one, two = (sorted(map(tuple, TP.sample_topics(t, vocab, 3, 2, scheme=scheme)[0].collect())) for t in (blocks, tok))
        assert one == two and one


def test_sign_distances_against_hamming(spark):
    from weftline.functions import arrays as V

    rng, nan = random.Random(6), float("nan")
    vectors = [[rng.choice([0.0, -0.0, 1.5, -2.0, nan, None]) for _ in range(rng.choice([0, 3, 64, 70]))] for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    asked = df.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("v").alias("w"))
    got = J.sign_distances(df, asked, "id", "v", "qid", "w")
    one = df.crossJoin(asked).select("qid", "id", V.hamming(F.transform("v", F.signum), F.transform("w", F.signum)).alias("distance"))
    assert sorted(map(str, got.collect())) == sorted(map(str, one.collect()))
    assert "zip_with" not in got._jdf.queryExecution().toString()  # whole numbers, not arrays, are compared


def test_balanced_sample_sorts_few_rows(spark):
    df = spark.range(40000).select("id", (F.col("id") % 10 > 0).alias("often"), F.lit("w" * 50).alias("wide"))
    for total in (1, 30, 9000):
        sample = A.sample_balanced(df, ["often"], total, ["id"], 4)
        want = []
        for often, quota in ((False, min(total // 2, 4000)), (True, total - min(total // 2, 4000))):
            of = df.where(F.col("often") == often).orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(quota)
            want += [tuple(r) for r in of.collect()]
        assert sorted(map(tuple, sample.collect())) == sorted(want)
    small = A.sample_balanced(df, ["often"], 30, ["id"], 4)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and plan.index("Window") < plan.index("_last")  # rows go by their bin below every window
