"""Sequence operators on the events table: one sequence per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.operators import sequences as S
from weftline.session import table

BY, ORDER = ["user_id"], ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(s, d):
    return table(s, d, "events").select("user_id", "ts", "event_id", "event_type", F.round("value", 2).alias("value"))


EVENTS = "(SELECT user_id, ts, event_id, event_type, round(value, 2) AS value FROM events)"
NUMBERED = f"(SELECT *, row_number() {OVER} - 1 AS ix FROM {EVENTS})"


def _seq(name, build, sql):
    add(name, lambda s, d: build(_events(s, d)), sql)


_seq("pairwise_events", lambda e: S.pairwise(e, "event_type", ORDER, BY).select("event_id", "event_type", "event_type_next"),
     f"SELECT event_id, event_type, nxt AS event_type_next FROM (SELECT *, lead(event_type) {OVER} AS nxt, lead(1) {OVER} AS has FROM {EVENTS}) WHERE has = 1")
_seq("x_wise3", lambda e: S.x_wise(e, "event_id", 3, ORDER, BY).select("event_id", F.array_join("window", ",").alias("window")),
     f"SELECT event_id, concat_ws(',', event_id, lead(event_id) {OVER}, lead(event_id, 2) {OVER}) AS \"window\" FROM {EVENTS} QUALIFY lead(1, 2) {OVER} = 1")
_seq("sliding_window_step", lambda e: S.sliding_window(e, "event_id", 4, 3, ORDER, BY).select("event_id", F.array_join("window", ",").alias("win")),
     f"SELECT event_id, win FROM (SELECT event_id, ix, concat_ws(',', event_id, lead(event_id) {OVER}, lead(event_id, 2) {OVER}, lead(event_id, 3) {OVER}) AS win, lead(1, 3) {OVER} AS ok FROM {NUMBERED}) WHERE ok = 1 AND ix % 3 = 0")
_seq("batch_events", lambda e: S.batch(e, "event_id", 4, ORDER, BY).select("user_id", "batch", F.array_join("values", ",").alias("ids")),
     f"SELECT user_id, ix // 4 AS batch, string_agg(event_id::VARCHAR, ',' ORDER BY ix) AS ids FROM {NUMBERED} GROUP BY 1, 2")
_seq("resizer_props", lambda e: S.resizer(e.withColumn("parts", F.split("event_type", "i")), "parts", 5, ORDER, BY, F.lit("_")).select("user_id", "batch", F.array_join("values", "|").alias("parts")),
     f"""WITH f AS (SELECT user_id, ts, event_id, unnest(string_split(event_type, 'i')) AS v, generate_subscripts(string_split(event_type, 'i'), 1) AS pos FROM {EVENTS}),
     n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, pos) - 1 AS ix FROM f)
     SELECT user_id, ix // 5 AS batch, string_agg(v, '|' ORDER BY ix) || repeat('|_', (5 - count(*))::INT) AS parts FROM n GROUP BY 1, 2""")
_seq("pairwise_skip_errors", lambda e: S.pairwise_skip(e, "event_id", F.col("event_type") == "error", ORDER, BY).select("event_id", "event_id_next"),
     f"""WITH r AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {EVENTS})
     SELECT event_id, nxt AS event_id_next FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nxt FROM r WHERE event_type <> 'error') WHERE nxt IS NOT NULL""")
_seq("dedup_consecutive", lambda e: S.remove_consecutive_dupes(e, "event_type", ORDER, BY).select("event_id", "event_type"),
     f"SELECT event_id, event_type FROM {EVENTS} QUALIFY lag(1) {OVER} IS NULL OR event_type IS DISTINCT FROM lag(event_type) {OVER}")
_seq("collapse_any_types", lambda e: S.collapse_any(e, "event_type", ["click", "view"], ORDER, BY).select("event_id", "event_type"),
     f"SELECT event_id, event_type FROM {EVENTS} QUALIFY NOT coalesce(event_type = lag(event_type) {OVER} AND event_type IN ('click', 'view'), false)")
_seq("collapse_all_types", lambda e: S.collapse_all(e, "event_type", ["click", "view"], F.lit("seen"), ORDER, BY).select("event_id", "event_type"),
     f"""SELECT event_id, CASE WHEN i THEN 'seen' ELSE event_type END AS event_type FROM (SELECT *, event_type IN ('click', 'view') AS i, lag(event_type IN ('click', 'view')) {OVER} AS b FROM {EVENTS})
     WHERE NOT (i AND coalesce(b, false))""")
_seq("asc_peaks_value", lambda e: S.asc_peaks(e, "value", ORDER, BY).select("event_id", "value"),
     f"SELECT event_id, value FROM {EVENTS} QUALIFY lead(value) {OVER} IS NULL OR lead(value) {OVER} < value")
_SIGNS = f"(SELECT *, sign(lead(value) {OVER} - value) AS up, sign(value - lag(value) {OVER}) AS down FROM {EVENTS})"
_seq("extrema_value", lambda e: S.extrema(e, "value", ORDER, BY).select("event_id", "value"),
     f"SELECT event_id, value FROM {_SIGNS} WHERE CASE WHEN up IS NULL AND down IS NULL THEN true WHEN down IS NULL THEN up <> 0 WHEN up IS NULL THEN down <> 0 ELSE up <> down AND down <> 0 END")
_seq("peaks_value", lambda e: S.peaks(e, "value", ORDER, BY).select("event_id", "value"),
     f"SELECT event_id, value FROM {_SIGNS} WHERE CASE WHEN up IS NULL AND down IS NULL THEN true WHEN down IS NULL THEN up = -1 WHEN up IS NULL THEN down = 1 ELSE up <> down AND down = 1 END")
_seq("valleys_value", lambda e: S.valleys(e, "value", ORDER, BY).select("event_id", "value"),
     f"SELECT event_id, value FROM {_SIGNS} WHERE CASE WHEN up IS NULL AND down IS NULL THEN true WHEN down IS NULL THEN up = 1 WHEN up IS NULL THEN down = -1 ELSE up <> down AND down = -1 END")
_seq("diffsgn_value", lambda e: S.pairwise(e, "value", ORDER, BY).select("event_id", F.signum(F.col("value_next") - F.col("value")).cast("int").alias("sgn")),
     f"SELECT event_id, CAST(sign(n - value) AS INTEGER) AS sgn FROM (SELECT *, lead(value) {OVER} AS n FROM {EVENTS}) WHERE n IS NOT NULL")
_seq("iter_timer_events", lambda e: S.elapsed(e, "ts", ORDER, BY).select("event_id", "elapsed_us"),
     f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) {OVER} AS elapsed_us FROM {EVENTS}")
_seq("fill_gaps_flags", lambda e: S.fill_gaps(e.withColumn("x", (F.col("value") > 20).cast("int")), "x", ORDER, BY, 2).select("event_id", "filled"),
     f"""WITH x AS (SELECT *, CAST(value > 20 AS INTEGER) AS x FROM {EVENTS}) SELECT event_id, CASE WHEN lag(1, 2) {OVER} = 1 AND lead(1, 2) {OVER} = 1
     AND least(lag(x) {OVER}, lag(x, 2) {OVER}, lead(x) {OVER}, lead(x, 2) {OVER}) = 1 THEN 1 ELSE x END AS filled FROM x""")
_seq("remove_spikes_flags", lambda e: S.remove_spikes(e.withColumn("x", (F.col("value") > 60).cast("int")), "x", ORDER, BY, 2).select("event_id", "smoothed"),
     f"""WITH x AS (SELECT *, CAST(value > 60 AS INTEGER) AS x FROM {EVENTS}) SELECT event_id, CASE WHEN lag(1, 2) {OVER} = 1 AND lead(1, 2) {OVER} = 1
     AND greatest(lag(x) {OVER}, lag(x, 2) {OVER}, lead(x) {OVER}, lead(x, 2) {OVER}) = 0 THEN 0 ELSE x END AS smoothed FROM x""")
_seq("advance_events", lambda e: S.positions(e, 5, None, ORDER, BY).select("event_id"), f"SELECT event_id FROM {NUMBERED} WHERE ix >= 5")
_seq("islice_events", lambda e: S.positions(e, 2, 6, ORDER, BY).select("event_id"), f"SELECT event_id FROM {NUMBERED} WHERE ix >= 2 AND ix < 6")
_seq("reversedzip_events", lambda e: S.zip_right(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "event_id"), ORDER, BY).select("event_id", "event_id_right"),
     f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM {EVENTS})
     SELECT a.event_id, b.event_id AS event_id_right FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.k WHERE a.event_type = 'click' AND b.event_type = 'view'""")
_LINE = "row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1"
_lines = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
_KEYS = ["l_orderkey", "l_linenumber"]
add("every_n_lines", lambda s, d: S.every_n(_lines(s, d), 7, _KEYS, (), 3), f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_LINE} AS ix FROM lineitem) WHERE ix >= 3 AND (ix - 3) % 7 = 0")
add("split_bucket_lines", lambda s, d: S.split(_lines(s, d), 4, _KEYS), f"SELECT l_orderkey, l_linenumber, ({_LINE}) % 4 AS bucket FROM lineitem")
add("select_by_indices_lines", lambda s, d: S.select_by_indices(_lines(s, d), [0, 5, 17, 999], _KEYS), f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_LINE} AS ix FROM lineitem) WHERE ix IN (0, 5, 17, 999)")
add("skip_by_indices_nations", lambda s, d: S.select_by_indices(table(s, d, "nation").select("n_nationkey"), [0, 3, 4], ["n_nationkey"], (), True),
    "SELECT n_nationkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS ix FROM nation) WHERE ix NOT IN (0, 3, 4)")
add("pl_index_lines", lambda s, d: S.select_by_indices(_lines(s, d), [1, 3, 8], _KEYS), f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_LINE} AS ix FROM lineitem) WHERE ix IN (1, 3, 8)")
add("pl_islice_lines", lambda s, d: S.positions(_lines(s, d), 10, 20, _KEYS), f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_LINE} AS ix FROM lineitem) WHERE ix BETWEEN 10 AND 19")
add("switched_enumerate_nations", lambda s, d: S.with_index(table(s, d, "nation").select("n_name", "n_nationkey"), ["n_nationkey"], (), "idx").select("n_name", "idx"),
    "SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation")
add("switch_nations", lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("first"), F.col("n_nationkey").alias("second")), "SELECT n_name AS first, n_nationkey AS second FROM nation")
add("interleave_names", lambda s, d: S.interleave([table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))], ["k"]).select("position", "name"),
    """SELECT a * 2 + i AS position, name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS a, 0 AS i, n_name AS name FROM nation
    UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey) - 1, 1, r_name FROM region) WHERE a < (SELECT least((SELECT count(*) FROM nation), (SELECT count(*) FROM region)))""")
add("decompress_nations", lambda s, d: S.decompress(table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 == 0).alias("sel")), "sel", table(s, d, "region").select("r_regionkey", F.col("r_name").alias("v")), "v", ["n_nationkey"], ["r_regionkey"], F.lit("-")).select("n_nationkey", "v"),
    """WITH n AS (SELECT n_nationkey, n_nationkey % 5 = 0 AS sel, count(*) FILTER (WHERE n_nationkey % 5 = 0) OVER (ORDER BY n_nationkey) AS k FROM nation),
    r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region)
    SELECT n_nationkey, CASE WHEN sel THEN r_name ELSE '-' END AS v FROM n LEFT JOIN r ON n.k = r.k AND sel""")
add("iter_equal_nations", lambda s, d: S.equal_sequences(table(s, d, "nation"), table(s, d, "nation").where("n_nationkey < 20"), "n_name", ["n_nationkey"]), "SELECT false AS equal")
add("iter_different_nations", lambda s, d: S.equal_sequences(table(s, d, "nation"), table(s, d, "nation"), "n_name", ["n_nationkey"]).select((~F.col("equal")).alias("different")), "SELECT false AS different")
add("sorted_index_price", lambda s, d: S.sorted_index(table(s, d, "part"), "p_retailprice", ["p_partkey"], ["p_brand"]).select("p_partkey", "rank"),
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM part")
add("sorted_index_reverse", lambda s, d: S.sorted_index(table(s, d, "part"), "p_retailprice", ["p_partkey"], ["p_brand"], True).select("p_partkey", "rank"),
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
