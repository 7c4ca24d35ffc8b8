"""Secret scans with trigram queries (operator 5), native expressions only.

Each rule is a regular expression. :func:`trigram_query` derives from it the Boolean query of the trigrams that every match
must hold (AND of ORs over literal alternatives). One pass over a text (:func:`indexed`), led by a tree of the trigrams' characters, finds
which of all queries' trigrams occur in it. These postings are partitioned by document, as the shards of a
distributed index are: a document's stand beside its text as bits, one a trigram, so postings are intersected and united by bitwise AND
and OR where the text lies, and neither postings nor texts are shuffled. Only candidates are verified by the regular
expression; a rule without mandatory trigrams scans every text. :func:`postings` lays the same index out as rows (trigram, doc_id).

Spans count code points, end exclusive. A match's start is the sum of the lengths of the gaps and matches before it, which
``split`` and ``regexp_extract_all`` deliver; sums are taken by blocks of 256, so texts with very many matches stay cheap.

Defined results: a null text is an empty one; repeated rows are scanned each for itself; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literal alternatives that a query follows at most; beyond, the node counts as unknown text (a wider query, never a narrower).
MOST_LITERALS = 64
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """kind; pattern in the syntax that Java, Python and RE2 share; group whose length must reach least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's rules, in its order.
BASE = (
    Rule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need no match of their own
)
#: What the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D:@/]{6,}@"),
)
RULES = BASE + MORE

# ---- Boolean trigram queries: ("all",), ("tri", "abc"), ("and", ...), ("or", ...)

ALL = ("all",)


def _and(*qs: tuple) -> tuple:
    flat = {x for q in qs for x in (q[1:] if q[0] == "and" else [q]) if x != ALL}
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *sorted(flat))


def _or(*qs: tuple) -> tuple:
    flat = {x for q in qs for x in (q[1:] if q[0] == "or" else [q])}
    own = {q: set(q[1:] if q[0] == "and" else [q]) for q in flat}
    flat = {q for q in flat if not any(own[p] < own[q] for p in flat)}  # A or (A and B) is A
    return ALL if ALL in flat or not flat else next(iter(flat)) if len(flat) == 1 else ("or", *sorted(flat))


def _of_words(words: set[str]) -> tuple:
    """Some word of the set occurs."""
    return _or(*[_and(*[("tri", w[i : i + 3]) for i in range(len(w) - 2)]) if len(w) > 2 else ALL for w in words]) if words else ALL


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """(all texts that the nodes can match, lower-cased, or None if too many; a query that any match satisfies)."""
    query, words, exact = ALL, {""}, True
    for op, arg in nodes:
        own, q = _node(op, arg)
        query = _and(query, q)
        joined = {a + b for a in words for b in own} if own is not None and len(own) * len(words) <= MOST_LITERALS else None
        if joined is None:
            query, words, exact = _and(query, _of_words(words), _of_words(own or set())), {""}, False
            if own:
                words = own
        else:
            words = joined
    return (words, query) if exact else (None, _and(query, _of_words(words)))


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MOST_LITERALS:
                chars |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        found = [_walk(x) for x in arg[1]]
        query = _or(*[_and(q, _of_words(w) if w is not None else ALL) for w, q in found])
        words = set().union(*[w for w, _ in found]) if all(w is not None for w, _ in found) else None
        return (words, ALL if words is not None else query)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        words, query = _walk(inner)
        if (low, high) == (0, 1) and words is not None:
            return words | {""}, ALL
        if low == high == 1:
            return words, query
        if low and words is not None and high == low and len(words) ** low <= MOST_LITERALS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in words}
            return out, ALL
        return None, _and(query, _of_words(words) if words else ALL) if low else ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """The Boolean query of lower-case trigrams that every match of the pattern satisfies; ALL if none is mandatory."""
    words, query = _walk(P.parse(pattern))
    return _and(query, _of_words(words)) if words is not None else query


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else {t for q in query[1:] for t in trigrams(q)}


def holds(query: tuple, has) -> bool | Column:
    """Evaluate the query; has(trigram) is a truth value or a column."""
    if query == ALL:
        return has(None)
    if query[0] == "tri":
        return has(query[1])
    out = None
    for q in query[1:]:
        x = holds(q, has)
        out = x if out is None else out & x if query[0] == "and" else out | x
    return out


def _literal(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _index(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for t in trigrams(trigram_query(r.pattern))})


def _tree(words: list[str]) -> str:
    """A pattern of the words, alternatives that begin alike joined, so that a place of a text is left at its first unlike character."""
    if "" in words or not words:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    quoted = {c: c if c.isalnum() else "\\" + c for c in heads}
    if all(rest == [""] for rest in heads.values()):
        return "[" + "".join(quoted.values()) + "]" if len(heads) > 1 else next(iter(quoted.values()))
    out = [quoted[c] + _tree(rest) for c, rest in heads.items()]
    return "(?:" + "|".join(out) + ")" if len(out) > 1 else out[0]


def indexed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text, _posted: the trigrams of the rules' queries that the lower-cased text holds, each once."""
    index = _index(rules)
    held = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    first = "[" + "".join(sorted({c if c.isalnum() else "\\" + c for t in index for c in t[:1]})) + "]"
    # Trigrams overlap, so they are looked at and not consumed; the class in front skips the other places in one step.
    found = F.expr(f"array_distinct(regexp_extract_all(lower(_text), {_literal(f'(?={first})(?=({_tree(index)}))')}, 1))") if index else F.array().cast("array<string>")
    return held.withColumn("_posted", found)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of the rules' trigrams as (trigram, doc_id) rows."""
    return indexed(docs, rules, id_col, text_col).select(F.explode("_posted").alias("trigram"), "doc_id")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, per rule, an array of (start, end) spans named after its kind."""
    index = _index(rules)
    place = {t: i for i, t in enumerate(index)}
    bits = []
    for w in range((len(index) + 62) // 63):
        own = [t for t in index if place[t] // 63 == w]
        cases = " ".join(f"WHEN {_literal(t)} THEN {1 << (place[t] - 63 * w)}L" for t in own)
        bits.append(F.expr(f"aggregate(_posted, 0L, (b, t) -> b | CASE t {cases} ELSE 0L END)").alias(f"_bits{w}"))
    listed = indexed(docs, rules, id_col, text_col).select("doc_id", "_text", *bits)

    def has(t: str | None) -> Column:
        return F.lit(True) if t is None else F.col(f"_bits{place[t] // 63}").bitwiseAND(F.lit(1 << (place[t] % 63))) != 0

    found = []
    for r in rules:
        p = _literal(r.pattern)
        pairs = f"zip_with(split(_text, {p}, -1), regexp_extract_all(_text, {p}, 0), (g, m) -> named_struct('gap', length(g), 'len', length(m), 'own', length(m)))"
        if r.group:
            pairs = (
                f"zip_with(zip_with(split(_text, {p}, -1), regexp_extract_all(_text, {p}, 0), (g, m) -> named_struct('gap', length(g), 'len', length(m))),"
                f" regexp_extract_all(_text, {p}, {r.group}), (x, k) -> named_struct('gap', x.gap, 'len', x.len, 'own', length(k)))"
            )
        # A plain rlike first: most candidates of a wide query end there, with one pass.
        sure = has(None) if trigram_query(r.pattern) == ALL else holds(trigram_query(r.pattern), has)
        found.append(F.when(sure & F.expr(f"_text RLIKE {p}"), F.expr(f"filter({pairs}, x -> x.len IS NOT NULL)")).alias(f"_m_{r.kind}"))
    matched = listed.select("doc_id", *found)
    sums = matched.select(
        "doc_id",
        *[f"_m_{r.kind}" for r in rules],
        *[
            F.expr(
                f"transform(sequence(0, (size(_m_{r.kind}) - 1) div {BLOCK}), c -> aggregate(slice(_m_{r.kind}, int(c * {BLOCK} + 1), {BLOCK}), 0L, (s, x) -> s + x.gap + x.len))"
            ).alias(f"_s_{r.kind}")
            for r in rules
        ],
    )
    spans = []
    for r in rules:
        m, s = f"_m_{r.kind}", f"_s_{r.kind}"
        start = (
            f"aggregate(slice({s}, 1, i div {BLOCK}), 0L, (a, y) -> a + y)"
            f" + aggregate(slice({m}, int((i div {BLOCK}) * {BLOCK} + 1), i % {BLOCK}), 0L, (a, y) -> a + y.gap + y.len) + x.gap"
        )
        spans.append(
            F.expr(
                f"CASE WHEN {m} IS NULL THEN cast(array() AS array<struct<start:bigint,end:bigint>>) ELSE"
                f" transform(filter(transform({m}, (x, i) -> named_struct('start', {start}, 'len', x.len, 'own', x.own)), z -> z.own >= {r.least}),"
                " z -> named_struct('start', z.start, 'end', z.start + z.len)) END"
            ).alias(r.kind)
        )
    return sums.select("doc_id", *spans)


def _joined(rules: tuple[Rule, ...]) -> str:
    """All spans of the rules as kind:start:end by start, then kind as listed."""
    arrays = ", ".join(
        f"transform(`{r.kind}`, x -> named_struct('s', x.start, 'k', {k}, 't', concat('{r.kind}:', x.start, ':', x.end)))" for k, r in enumerate(rules)
    )
    return f"array_join(transform(sort_array(concat({arrays})), x -> x.t), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return scan(docs).select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.expr(_joined(BASE)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined(RULES)).alias("spans"),
    )


def spans_of(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The same for one text in plain Python; for tests and for small tools."""
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, r.kind, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every longest run of characters inside spans of :func:`scan` replaced by the mark and n_chars, where present, counted anew; other columns as they are.

    Spans are those of the original text, whatever rules they are of; spans that overlap or touch share one mark. Pieces are
    cut from the text of a block of spans, so texts with very many spans stay cheap.
    """
    m = _literal(mark)
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_own")), id_col="_row", text_col="_own")
    found = found.select(F.col("doc_id").alias("_row"), F.expr(f"sort_array(concat({', '.join(f'`{r.kind}`' for r in RULES)}))").alias("_spans"))
    cut = (
        "aggregate(b, named_struct('at', a.at, 'parts', cast(array() AS array<string>)), (c, x) -> named_struct('at', greatest(c.at, x.end), 'parts',"
        f" CASE WHEN x.start > c.at THEN concat(c.parts, array(substring(t, int(c.at - a.at + 1), int(x.start - c.at)), {m})) ELSE c.parts END))"
    )
    block = f"transform(array(substring(_row.text, int(a.at + 1), int(greatest(element_at(b, -1).start - a.at, 0L)))), t -> {cut})[0]"
    text = (
        f"aggregate(transform(sequence(0, (size(_spans) - 1) div {BLOCK}), i -> slice(_spans, i * {BLOCK} + 1, {BLOCK})),"
        f" named_struct('at', 0L, 'parts', CASE WHEN _spans[0].start = 0 THEN array({m}) ELSE cast(array() AS array<string>) END),"
        f" (a, b) -> transform(array({block}), z -> named_struct('at', z.at, 'parts', concat(a.parts, array(array_join(z.parts, '')))))[0],"
        " a -> concat(array_join(a.parts, ''), substring(_row.text, int(a.at + 1))))"
    )
    text = F.expr(f"CASE WHEN size(_spans) > 0 THEN {text} ELSE _row.text END")
    docs = found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _oracle_sql() -> str:
    """DuckDB SQL of :func:`digest`: starts come from a window sum over gaps and matches."""

    def q(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    kinds = "\nUNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {k} AS k, {r.least} AS least, string_split_regex(text, {q(r.pattern)}) AS g,"
        f" regexp_extract_all(text, {q(r.pattern)}, 0) AS m, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS o"
        f" FROM b WHERE regexp_matches(text, {q(r.pattern)})"
        for k, r in enumerate(RULES)
    )
    return f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({kinds}),
u AS (SELECT doc_id, kind, k, least, unnest(range(1, len(m) + 1)) AS i, g, m, o FROM f),
p AS (SELECT doc_id, kind, k, least, length(m[i]) AS n, length(o[i]) AS own,
  CAST(sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, k ORDER BY i) - length(m[i]) AS BIGINT) AS s FROM u),
a AS (SELECT doc_id, k, s, kind, kind || ':' || s || ':' || (s + n) AS t FROM p WHERE own >= least)
SELECT b.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256(coalesce(string_agg(t, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(t, ',' ORDER BY s, k), '') AS spans
FROM b LEFT JOIN a ON a.doc_id = b.doc_id GROUP BY b.doc_id
"""


ORACLE_SQL = _oracle_sql()
