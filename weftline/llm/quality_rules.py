"""Quality rules as a learned decision list (operator 4), native expressions only.

Statistics of every whole text are computed by built-in functions in one scan, without a shuffle. A decision list is
learned from a bounded sample of labelled statistics by sequential covering (RIPPER style): a rule is grown one
threshold test at a time by FOIL gain on two thirds of the sample, its last tests are pruned by (p - n) / (p + n) on the
remaining third, the rows that it covers are removed, and the next rule is grown. The list is emitted as one ordered
``CASE WHEN`` expression, which Spark evaluates beside the statistics.

Defined results: null and empty texts have zero in all counts and fail the base rule; repeated rows are scored each for
itself (in learning, documents that share an id are one: that of the least statistics); an empty table gives an empty result; without labels of both classes the list is empty and keeps every row that
passes the base rule. Input columns other than the id and the text are ignored by :func:`statistics`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BLANK_RUN, BLANKS

#: Largest number of labelled rows that the list is learned from (smallest hashes of the id first).
FIT_ROWS = 6000
SYMBOLS = "#*$%&|<>"
_SQL_BLANKS = BLANKS.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\x0b", "\\u000b").replace("\x0c", "\\u000c")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines."""
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    ).withColumn("_trimmed", F.expr(f"trim(BOTH '{_SQL_BLANKS}' FROM _text)"))
    words = base.select(
        "doc_id",
        "_text",
        F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", BLANK_RUN)).alias("_words"),
        F.expr(f"filter(split(_text, '\\n'), x -> length(trim(BOTH '{_SQL_BLANKS}' FROM x)) > 0)").alias("_lines"),
    )
    counted = words.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.translate("_text", "!?;:{}[]()=_~^@\\/", ""))).cast("long").alias("n_marks"),
    )
    shingled = counted.withColumn(
        "_tri",
        F.expr(
            "CASE WHEN n_words >= 3 THEN transform(sequence(1, int(n_words) - 2),"
            " i -> concat_ws(' ', _words[i - 1], _words[i], _words[i + 1])) ELSE cast(array() AS array<string>) END"
        ),
    ).drop("_words")
    # Equal windows become neighbours; texts in which all windows differ skip the sort.
    ordered = shingled.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(_tri) > 1 AND size(array_distinct(_tri)) < size(_tri)"
            " THEN sort_array(transform(_tri, (t, i) -> named_struct('t', t, 'i', i))) END"
        ),
    ).drop("_tri")
    places = ordered.withColumn(
        "_at",
        F.expr(
            "sort_array(filter(transform(_sorted, (x, k) -> CASE WHEN (k > 0 AND _sorted[k - 1].t = x.t)"
            " OR (k < size(_sorted) - 1 AND _sorted[k + 1].t = x.t) THEN x.i END), p -> p IS NOT NULL))"
        ),
    ).drop("_sorted")
    # The row number, never negative, is a barrier: a filter on what follows from this column must not be pushed below the
    # projections above, where Catalyst would repeat their arrays inside the lambdas.
    return places.withColumn(
        "n_repeat_words",
        F.expr(
            "CASE WHEN size(_at) > 0 THEN aggregate(zip_with(slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1),"
            " (a, b) -> least(3, b - a)), 3L, (s, x) -> s + x) ELSE 0L END + CASE WHEN monotonically_increasing_id() < 0 THEN 1L ELSE 0L END"
        ),
    ).drop("_at")


#: Rates that the tests of a rule look at; each is defined for every row.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "line_rate": "n_lines / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Test:
    """feature >= threshold, or feature < threshold."""

    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>=' if self.at_least else '<'} {self.threshold!r}D)"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the row, and rows that none covers are kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        if not self.rules:
            return F.lit(True)
        cases = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN false" for rule in self.rules)
        return F.expr(f"CASE {cases} ELSE true END")


def learn(
    rows: list[dict], target: str = "bad", cuts: int = 48, most_tests: int = 4, most_rules: int = 12, precision: float = 0.95, support: int = 3
) -> DecisionList:
    """Sequential covering over labelled rows; rows: a value for each of FEATURES, and whether the row is bad.

    Row sets are bits of Python integers, so that a candidate test costs one AND and one bit count.
    """
    n = len(rows)
    bad = sum(1 << i for i, r in enumerate(rows) if r[target])
    every = (1 << n) - 1
    if not bad or bad == every:
        return DecisionList()
    prune_set = sum(1 << i for i in range(n) if i % 3 == 2)
    grow_set = every & ~prune_set
    tests: dict[Test, int] = {}
    for name in FEATURES:
        order = sorted(range(n), key=lambda i: rows[i][name])
        values = [rows[i][name] for i in order]
        places = {round(k * n / cuts) for k in range(1, cuts)}
        # Also where the class changes between neighbours: the useful thresholds of rare classes.
        changes = [k for k in range(1, n) if values[k] > values[k - 1] and rows[order[k]][target] != rows[order[k - 1]][target]]
        places |= set(changes[:: max(1, len(changes) // cuts)])
        seen: set[float] = set()
        below, k = 0, 0
        for p in sorted(places):
            if not 0 < p < n:
                continue
            while p < n and values[p] == values[p - 1]:
                p += 1
            if p >= n:
                continue
            t = (values[p] + values[p - 1]) / 2
            if t in seen or not math.isfinite(t):
                continue
            seen.add(t)
            while k < n and values[k] < t:
                below |= 1 << order[k]
                k += 1
            tests[Test(name, True, t)] = every & ~below
            tests[Test(name, False, t)] = below
    left, found = every, []
    while len(found) < most_rules and (left & bad).bit_count() >= support:
        rule, covered = [], left & grow_set
        while len(rule) < most_tests:
            p0, n0 = (covered & bad).bit_count(), (covered & ~bad).bit_count()
            if not n0 or not p0:
                break
            now, best, chosen = math.log2(p0 / (p0 + n0)), 1e-9, None
            for t, holds in tests.items():
                c = covered & holds
                p = (c & bad).bit_count()
                if p and (gain := p * (math.log2(p / c.bit_count()) - now)) > best:
                    best, chosen = gain, t
            if chosen is None:
                break
            rule.append(chosen)
            covered &= tests[chosen]
        if not rule:
            break

        def worth(k: int) -> tuple[float, int]:
            c = left & prune_set
            for t in rule[:k]:
                c &= tests[t]
            p, m = (c & bad).bit_count(), c.bit_count()
            return ((2 * p - m) / m if m else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        covered = left
        for t in rule:
            covered &= tests[t]
        p = (covered & bad).bit_count()
        if p < support or p < precision * covered.bit_count():
            break
        found.append(tuple(rule))
        left &= ~covered
    return DecisionList(found)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learn the list from at most fit_rows labelled documents; the statistics are computed by Spark, rows of numbers come back."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # At most fit_rows pairs of numbers: a proven bound for the broadcast.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    features = F.struct(*[F.expr(e).alias(k) for k, e in FEATURES.items()])
    # Documents that share an id are one row, so that no more than fit_rows come back.
    once = statistics(known).groupBy("doc_id").agg(F.min(features).alias("f"))
    rows = once.join(F.broadcast(sample), "doc_id").select("doc_id", "f.*", (F.col("_quality") < 1).alias("bad")).collect()
    return learn([r.asDict() for r in sorted(rows, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics of every row with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.verdict())


def passing(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns; the text is carried beside its statistics, not joined."""
    own = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_id"), "text")
    return score(held, rules).where("kept").select(*[F.col("doc_id").getField(c).alias(c) for c in own])


#: DuckDB SQL of the counts and the base rule; what the learned list says has no SQL.
STATISTICS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM k CROSS JOIN range(3) s(j) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
