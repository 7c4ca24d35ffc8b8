"""Text functions as columns; all stay in the JVM but for the few that no built-in expression can state."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(s: str) -> str:
    """A literal as a Java regular expression."""
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and c.isascii() else c for c in s)


def _dollar(s: str) -> str:
    """A literal as a Java replacement."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def truncate(c: Column, width: int, placeholder: str = "...") -> Column:
    if width < len(placeholder):
        raise ValueError("the placeholder is wider than the text may be")
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(width - len(placeholder))), F.lit(placeholder)))


def to_int(c: Column, default: int | None = None) -> Column:
    """A whole number or the default; underscores between digits are allowed."""
    clean = F.regexp_replace(F.trim(c), r"(?<=\d)_(?=\d)", "")
    return F.coalesce(F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("bigint")), F.lit(default).cast("bigint"))


def try_int(c: Column) -> Column:
    """The number's canonical text, or the text as it is."""
    return F.coalesce(to_int(c).cast("string"), c)


def remove_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """Without the first of the prefixes that it has."""
    out = c
    for p in reversed(prefixes):
        out = F.when(c.startswith(p), F.substr(c, F.lit(len(p) + 1))).otherwise(out)
    return out


def remove_suffixes(c: Column, suffixes: Sequence[str]) -> Column:
    """Without the first of the suffixes that it has; an empty suffix takes nothing."""
    out = c
    for s in reversed(suffixes):
        out = F.when(c.endswith(s), F.left(c, F.length(c) - len(s))).otherwise(out)
    return out


def replace_all(c: Column, pairs: dict[str, str], ignore_case: bool = False, longest_first: bool = False) -> Column:
    """Replace all keys in one pass: nothing is replaced twice. The first alternative that matches wins."""
    keys = sorted(pairs, key=len, reverse=True) if longest_first else list(pairs)
    if not keys:
        return c
    flags = "(?is)" if ignore_case else "(?s)"
    pieces = F.regexp_extract_all(c, F.lit(f"{flags}({'|'.join(map(quote, keys))}|.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for k in keys for x in ((k.lower() if ignore_case else k), pairs[k])])
    return F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at(table, F.lower(t) if ignore_case else t), t)), "")


def replace_list(c: Column, old: Sequence[str], new: str, ignore_case: bool = False, longest_first: bool = False) -> Column:
    """Replace any of the texts by one."""
    keys = sorted(old, key=len, reverse=True) if longest_first else list(old)
    return F.regexp_replace(c, ("(?i)" if ignore_case else "") + "|".join(map(quote, keys)), _dollar(new))


def replace_characters(c: Column, pairs: dict[str, str | None]) -> Column:
    """Map single characters to one character, or to none."""
    kept = {k: v for k, v in pairs.items() if v}
    gone = [k for k, v in pairs.items() if not v]
    return F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))


def escape_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r'([\\"])', r"\\$1")


def unescape_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r'\\([\\"])', "$1")


_CONTROL = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}


def escape_control(c: Column) -> Column:
    out = c
    for k, v in _CONTROL.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def unescape_control(c: Column) -> Column:
    """One pass over escapes, so an escaped backslash before a letter stays one."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\[\\tnr]|.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for k, v in _CONTROL.items() for x in (v, k)])
    return F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def mysql_to_sqlite(c: Column) -> Column:
    """Backslash escapes of quotes and backslashes as the other dialect writes them."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\\\|\\'|.)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda t: F.when(t == "\\\\", F.lit("\\")).when(t == "\\'", F.lit("''")).otherwise(t)), "")


def filter_join(values: Column, separator: str) -> Column:
    """Join what is neither null nor empty."""
    return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), separator)


def surrounding_join(values: Column, separator: str, left: str = "", right: str = "") -> Column:
    """Join elements, each between left and right; all-empty input gives an empty text."""
    joined = F.array_join(F.transform(values, lambda x: F.concat(F.lit(left), x, F.lit(right))), separator)
    return F.when(F.coalesce(F.exists(values, lambda x: x != ""), F.lit(False)), joined).otherwise("")


def contains_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def all_splits(c: Column, include_start: bool = False, include_end: bool = True) -> Column:
    """Array of (prefix, suffix) at every place."""
    low, high = (0 if include_start else 1), F.length(c) - (0 if include_end else 1)
    places = F.when(high >= low, F.sequence(F.lit(low), F.greatest(high, F.lit(low)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.left(c, i).alias("prefix"), F.substr(c, i + 1).alias("suffix")))


def brackets_match(c: Column, opening: str = "([{", closing: str = ")]}") -> Column:
    """Whether brackets are balanced: a stack of open ones is folded over the text's brackets."""
    only = F.regexp_extract_all(c, F.lit("([" + "".join("\\" + x for x in opening + closing) + "])"), F.lit(1))
    pairs = F.create_map(*[F.lit(x) for o, e in zip(opening, closing, strict=True) for x in (e, o)])

    def step(stack: Column, b: Column) -> Column:
        wanted = F.try_element_at(pairs, b)
        return (
            F.when(stack == "!", stack)
            .when(wanted.isNull(), F.concat(stack, b))
            .when(F.right(stack, F.lit(1)) == wanted, F.left(stack, F.length(stack) - 1))
            .otherwise("!")
        )

    return F.aggregate(only, F.lit(""), step) == ""


_TYPOGRAPHIC = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "‐": "-"}


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes and ellipses in ASCII."""
    out = F.translate(c, "".join(_TYPOGRAPHIC), "".join(_TYPOGRAPHIC.values()))
    return F.replace(F.replace(out, F.lit("—"), F.lit("--")), F.lit("…"), F.lit("..."))


def newlines_to_spaces(c: Column) -> Column:
    return F.translate(c, "\n\x85\r", "  ")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\x0b\x0c]+", " ")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def collapse_punctuation(c: Column) -> Column:
    """Repeats of one punctuation mark or symbol as one."""
    return F.regexp_replace(c, r"([\p{P}\p{S}])\1+", "$1")


def split_paragraphs(c: Column) -> Column:
    """Texts between blank lines, each with its line feed. Split at what follows a line feed: a repeated group would recurse on long texts."""
    return F.filter(F.split(F.regexp_replace(c, r"^\n+", ""), r"(?<=\n)\n+"), lambda p: p != "")


def resembles_english_word(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z'\-]*$")


def words(c: Column) -> Column:
    """Lower-case words between white space; none of an empty text."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def split_or_empty(c: Column, separator: str) -> Column:
    """Split; an empty text has no parts."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, quote(separator)))


def markdown_newline(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\n])\n([^\n])", "$1  \n$2")


def markdown_urls(c: Column) -> Column:
    """Bare addresses in angle brackets; a last full stop stays outside, and bracketed ones stay."""
    return F.regexp_replace(c, r"(?<![<(\w])(https?://[^\s<>]*[^\s<>.])", "<$1>")


def unescape_entities(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def markdown_to_text(c: Column) -> Column:
    """The text of common markdown: headings, emphasis, code, links, images, quotes and lists lose their marks."""
    out = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    return F.regexp_replace(out, r"(\*\*|__|\*|`+|~~)(?=\S)(.+?)(?<=\S)\1", "$2")


def escape_sosl(c: Column) -> Column:
    return F.regexp_replace(c, r"""([?&|!{}\[\]()^~*:\\"'+\-])""", r"\\$1")


def escape_latex(c: Column) -> Column:
    return F.regexp_replace(c, r"([%$_&#}{])", r"\\$1")


def is_ipv4(c: Column) -> Column:
    """Four numbers from 0 to 255 between points."""
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(F.trim(p).try_cast("int").between(0, 255), F.lit(False)))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z")


def quote_identifier(name: str) -> str:
    """A Spark identifier."""
    if "\0" in name:
        raise ValueError("an identifier holds no NUL")
    return "`" + name.replace("`", "``") + "`"


def case_bits(c: Column) -> Column:
    """The upper-case letters of a text as a string of bits."""
    marked = F.regexp_replace(F.regexp_replace(c, r"\p{Lu}", "\x01"), r"(?s)[^\x01]", "0")
    return F.translate(marked, "\x01", "1")


def apply_case_bits(c: Column, bits: Column) -> Column:
    """Upper case where the bits say so."""
    chars = F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(chars, lambda x, i: F.when(F.substr(bits, i + 1, F.lit(1)) == "1", F.upper(x)).otherwise(x)), "")


def pack_bits(bits: Column, pad: str = "0") -> Column:
    """Bits as bytes; the last byte is padded."""
    full = F.concat(bits, F.repeat(F.lit(pad), F.pmod(-F.length(bits), F.lit(8))))
    pieces = F.regexp_extract_all(full, F.lit("([01]{8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.lpad(F.conv(p, 2, 16), 2, "0")), ""))


def unpack_bits(data: Column) -> Column:
    """Bytes as bits."""
    pieces = F.regexp_extract_all(F.hex(data), F.lit("([0-9A-F]{2})"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.lpad(F.conv(p, 16, 2), 8, "0")), "")


@F.pandas_udf(T.StringType())
def unescape_backslash(s: pd.Series) -> pd.Series:
    r"""Decode \n, \xNN, \uNNNN and their kind. Python's codec knows them all; no built-in does."""
    pattern = re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[0-7]{1,3}|N\{[^}]+\}|[\\'\"abfnrtv])")
    return s.map(lambda t: None if t is None else pattern.sub(lambda m: m[0].encode().decode("unicode_escape"), t))


def hamming_bytes(a: Column, b: Column) -> Column:
    """Differing bits of two binary values of one length; other lengths raise."""
    pairs = F.zip_with(F.split(F.hex(a), "(?<=\\G..)(?!$)"), F.split(F.hex(b), "(?<=\\G..)(?!$)"), lambda x, y: F.bit_count(F.conv(x, 16, 10).cast("int").bitwiseXOR(F.conv(y, 16, 10).cast("int"))))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x).cast("long")
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("lengths differ")).cast("long")).when(F.length(a) == 0, F.lit(0).cast("long")).otherwise(total)


def escaped_ascii(data: Column) -> Column:
    """Bytes as text, those above 127 as backslash, x and two hex digits."""
    digits = F.filter(F.split(F.lower(F.hex(data)), "(?<=\\G..)"), lambda x: x != "")
    return F.array_join(F.transform(digits, lambda x: F.when(x < "80", F.char(F.conv(x, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\x"), x))), "")


def detokenize(tokens: Column) -> Column:
    """A sentence from words in the Penn Treebank's style: clitics, closing marks and units go to the word before, opening marks to the one after."""
    out = F.array_join(tokens, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(^| )`` ?", '$1"'), r" ?''(?= |$)", '"')
    out = F.regexp_replace(out, r" (n't|'(?:s|m|d|ll|re|ve|S|M|D|LL|RE|VE))(?= |$)", "$1")
    out = F.regexp_replace(out, r"([(\[{$#]) ", "$1")
    return F.regexp_replace(out, r" ((?:\.\.\.|[.,;:!?%)\]}])+)", "$1")


_INLINE = re.compile(r"(`+)(.+?)\1|\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|(?<!\w)_(.+?)_(?!\w)|\[([^\]]*)\]\(([^)\s]*)\)|<(https?://[^>\s]+)>|\\([!-/:-@\[-`{-~])", re.S)


def _inline(t: str) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(t):
        out.append(html.escape(t[at : m.start()]))
        code, strong, em = m[2], m[3] or m[4], m[5] or m[6]
        if code:
            out.append(f"<code>{html.escape(code)}</code>")
        elif strong:
            out.append(f"<strong>{_inline(strong)}</strong>")
        elif em:
            out.append(f"<em>{_inline(em)}</em>")
        elif m[8] is not None:
            out.append(f'<a href="{html.escape(m[8])}">{_inline(m[7])}</a>')
        elif m[9]:
            out.append(f'<a href="{html.escape(m[9])}">{html.escape(m[9])}</a>')
        else:
            out.append(html.escape(m[10]))
        at = m.end()
    return "".join(out) + html.escape(t[at:])


_BULLET, _NUMBER = re.compile(r"[-*+] +(.*)"), re.compile(r"\d+[.)] +(.*)")


def _blocks_to_html(lines: list[str]) -> str:
    out, i = [], 0

    def taken(test) -> list[str]:
        nonlocal i
        first = i
        while i < len(lines) and test(lines[i]):
            i += 1
        return lines[first:i]

    def starts(x: str) -> bool:
        return bool(re.match(r"#{1,6} |```|>|(?:-{3,}|\*{3,}|_{3,})\s*$", x) or _BULLET.match(x) or _NUMBER.match(x))

    while i < len(lines):
        x = lines[i]
        if not x.strip():
            i += 1
        elif x.startswith("```"):
            i += 1
            code = taken(lambda y: not y.startswith("```"))
            i += 1
            out.append("<pre><code>" + "".join(html.escape(y) + "\n" for y in code) + "</code></pre>")
        elif m := re.match(r"(#{1,6}) +(.*?)\s*#*$", x):
            i += 1
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif re.match(r"(?:-{3,}|\*{3,}|_{3,})\s*$", x):
            i += 1
            out.append("<hr />")
        elif x.startswith(">"):
            out.append("<blockquote>\n" + _blocks_to_html([re.sub(r"^> ?", "", y) for y in taken(lambda y: y.startswith(">"))]) + "\n</blockquote>")
        elif kind := next((k for k in (_BULLET, _NUMBER) if k.match(x)), None):
            name = "ul" if kind is _BULLET else "ol"
            items = "".join(f"<li>{_inline(kind.match(y)[1])}</li>\n" for y in taken(kind.match))
            out.append(f"<{name}>\n{items}</{name}>")
        else:
            first = i
            i += 1
            taken(lambda y: y.strip() and not starts(y))
            out.append("<p>" + _inline("\n".join(y.strip() for y in lines[first:i])) + "</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_to_html(s: pd.Series) -> pd.Series:
    """Headings, paragraphs, lists, quotes, rules, fenced and inline code, emphasis and links as HTML; a single paragraph stands without its tags."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        made = _blocks_to_html(t.splitlines())
        return made[3:-4] if made.count("<p>") == made.count("</p>") == 1 and made.startswith("<p>") and made.endswith("</p>") else made

    return s.map(one)
