"""Text, URL and hash functions on documents, pages and small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import hashing as H
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.session import table


def doc(name, build, sql, tab="documents", key="doc_id", col="text"):
    """A scalar function of one column: key, v."""
    add(name, lambda s, d: table(s, d, tab).select(key, build(F.col(col)).alias("v")), f"SELECT {key}, {sql} AS v FROM {tab}")


def lit(name, values, build, expected):
    """A scalar function on fixed values with fixed results, as rows of SQL values."""
    def q(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"
    rows = ", ".join(f"({i}, {q(e)})" for i, e in enumerate(expected))
    add(name, lambda s, d: s.createDataFrame(list(enumerate(values)), "k int, t string").select("k", build(F.col("t")).alias("v")), f"SELECT * FROM (VALUES {rows}) AS t(k, v)")


doc("truncate_text", lambda c: X.truncate(c, 20), "CASE WHEN length(text) <= 20 THEN text ELSE left(text, 17) || '...' END")
doc("toint_source", lambda c: X.to_int(F.regexp_replace(c, "^src", ""), -1), "coalesce(TRY_CAST(replace(source, 'src', '') AS BIGINT), -1)", col="source")
lit("toint_cases", ["12", " 7 ", "x", "", "1_000", "-3"], lambda c: X.to_int(c), [12, 7, None, None, 1000, -3])
lit("tryint_cases", ["12", " 7 ", "x", "007"], X.try_int, ["12", "7", "x", "7"])
doc("removeprefix_source", lambda c: X.remove_prefixes(c, ["src"]), "CASE WHEN starts_with(source, 'src') THEN substr(source, 4) ELSE source END", col="source")
lit("removeprefixes_cases", ["abc", "bc", "c", "ab"], lambda c: X.remove_prefixes(c, ["a", "ab", "b"]), ["bc", "c", "c", "b"])
lit("removesuffix_cases", ["abc", "bc", "c", ""], lambda c: X.remove_suffixes(c, ["bc"]), ["a", "", "c", ""])
lit("removesuffixes_cases", ["abc", "bc", "c", "xb"], lambda c: X.remove_suffixes(c, ["c", "bc", ""]), ["ab", "b", "", "xb"])
lit("case_bits_cases", ["aBc", "ABCDEFGHi", ""], X.case_bits, ["010", "111111110", ""])
lit("case_roundtrip_cases", ["aBc", "Hello World", "é"], lambda c: X.apply_case_bits(F.lower(c), X.case_bits(c)), ["aBc", "Hello World", "é"])
lit("multiple_replace_cases", ["foobarfoo", "xx", "barbaz"], lambda c: X.replace_all(c, {"foo": "bar", "bar": "foo"}), ["barfoobar", "xx", "foobaz"])
lit("multiple_replace_longest", ["aab", "AAb"], lambda c: X.replace_all(c, {"a": "1", "aa": "2"}, True, True), ["2b", "2b"])
doc("multiple_replace_text", lambda c: X.replace_all(c, {"the": "THE", "th": "TH", "e": "3"}), "replace(replace(replace(replace(replace(text, 'the', chr(1)), 'th', chr(2)), 'e', '3'), chr(1), 'THE'), chr(2), 'TH')")
doc("multiple_replace_list_text", lambda c: X.replace_list(c, ["the", "and"], "$1"), "regexp_replace(text, 'the|and', '$1', 'g')")
doc("replace_characters_text", lambda c: X.replace_characters(c, {"a": "4", "e": "3", "\n": None}), "translate(text, 'ae' || chr(10), '43')")
doc("backslashquote_escape_text", lambda c: X.escape_quotes(c), r"""replace(replace(text, '\', '\\'), '"', '\"')""")
doc("backslashquote_roundtrip", lambda c: F.md5(X.unescape_quotes(X.escape_quotes(c))), "md5(text)")
doc("backslashcontrol_escape_text", lambda c: X.escape_control(c), r"replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')")
lit("backslashcontrol_unescape_cases", ["a\\nb", "a\\\\nb", "\\t\\r"], X.unescape_control, ["a\nb", "a\\nb", "\t\r"])
lit("backslash_unescape_cases", ["a\\nb", "\\u00e9", "\\x41\\\\", "é"], X.unescape_backslash, ["a\nb", "é", "A\\", "é"])
lit("mysql_to_sqlite_cases", ["it\\'s", "a\\\\b"], X.mysql_to_sqlite, ["it''s", "a\\b"])
lit("parentheses_cases", ["([])", "([)]", "", "(", "a{b}c", ")("], X.brackets_match, [True, False, True, False, True, False])
lit("filter_join_cases", ["a,,b", ",", "a"], lambda c: X.filter_join(F.split(c, ","), "-"), ["a-b", "", "a"])
lit("surrounding_join_cases", ["a,b", "", "a,"], lambda c: X.surrounding_join(F.split(c, ","), ", ", "(", ")"), ["(a), (b)", "", "(a), ()"])
doc("contains_digit_text", X.contains_digit, "regexp_matches(text, '[0-9]')")
lit("all_splits_cases", ["abc", "a", ""], lambda c: F.array_join(F.transform(X.all_splits(c), lambda x: F.concat(x["prefix"], F.lit("/"), x["suffix"])), " "), ["a/bc ab/c abc/", "a/", ""])
doc("typographic_text", X.plain_punctuation, "replace(replace(translate(text, '‘’‚‛“”„‟–‐', '''''''''\"\"\"\"--'), '—', '--'), '…', '...')")
doc("newlines_to_spaces_text", X.newlines_to_spaces, "translate(text, chr(10) || chr(133) || chr(13), '  ')")
doc("collapse_whitespace_text", X.collapse_whitespace, r"regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g')")
doc("collapse_space_text", X.collapse_space, "regexp_replace(text, ' +', ' ', 'g')")
lit("collapse_punctuation_cases", ["asdaassdd.,..,,", "a!!b??", "--x$$"], X.collapse_punctuation, ["asdaassdd.,.,", "a!b?", "-x$"])
doc("split_paragraphs_text", lambda c: F.size(X.split_paragraphs(c)).cast("long"), "len(regexp_extract_all(text, '((?:[^\\n]\\n?)+)'))::BIGINT")
doc("resembles_english_words", lambda c: F.size(F.filter(F.split(c, " "), X.resembles_english_word)).cast("long"), "len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[A-Za-z''-]*')))::BIGINT")
doc("default_tokenizer_text", lambda c: F.size(X.words(c)).cast("long"), r"len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))::BIGINT")
lit("strlist_cases", ["a,b", "", "x"], lambda c: F.size(X.split_or_empty(c, ",")).cast("long"), [2, 0, 1])
lit("markdown_newline_cases", ["a\nb", "a\n\nb", "a"], X.markdown_newline, ["a  \nb", "a\n\nb", "a"])
lit("markdown_urls_cases", ["see http://a.b/c.", "<http://a.b>", "x"], X.markdown_urls, ["see <http://a.b/c>.", "<http://a.b>", "x"])
lit("unescape_entities_cases", ["a &lt;b&gt; &amp;lt;"], X.unescape_entities, ["a <b> &lt;"])
lit("markdown2plaintext_cases", ["# Title", "a **b** [c](http://d)", "- item `x`"], X.markdown_to_text, ["Title", "a b c", "item x"])
lit("sosl_escape_cases", ["a?b", "x-y"], X.escape_sosl, ["a\\?b", "x\\-y"])
doc("escape_latex_text", X.escape_latex, r"regexp_replace(text, '([%$_&#}{])', '\\\1', 'g')")
lit("is_ipv4_cases", ["1.2.3.4", "256.1.1.1", "1.2.3", "a.b.c.d", "01.2.3.4"], X.is_ipv4, [True, False, False, False, True])
lit("is_email_cases", ["a@b.c", "a@b", "a b@c.d", "a@b.c\n"], X.is_email, [True, False, False, False])
lit("pack_bits_cases", ["0100000101000010", "01", ""], lambda c: F.hex(X.pack_bits(c)), ["4142", "40", ""])
lit("unpack_bits_cases", ["AB", ""], lambda c: X.unpack_bits(F.encode(c, "UTF-8")), ["0100000101000010", ""])
lit("locale_sorted_keys", ["a", "B", "Aa"], lambda c: F.lower(c), ["a", "b", "aa"])
lit("replace_urls_cases", ["asd http://localhost qwe ftp://google.com/ncr zxc", "filename"], lambda c: U.replace_urls(c, "[u]"), ["asd [u] qwe [u] zxc", "filename"])
doc("urls_extract_pages", lambda c: F.array_join(U.extract_urls(c), " "), r"coalesce(array_to_string(regexp_extract_all(url, 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+;=]+'), ' '), '')", "pages", "page_id", "url")
doc("url_filename", U.file_name, "regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/]*$')", "pages", "page_id", "url")
doc("url_argument", lambda c: U.argument(c, "page"), "nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '')", "pages", "page_id", "url")
doc("url_replace_query", lambda c: U.replace_query(c, F.lit("a=1")), "regexp_extract(url, '^[^?#]*') || '?a=1'", "pages", "page_id", "url")
doc("url_ext", U.url_extension, "lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/]\\.([^./]*)$', 1))", "pages", "page_id", "url")
lit("path_ext_cases", ["a/b.TXT", ".bashrc", "x/.y", "a.b.c", "a"], U.path_extension, ["txt", "", "", "c", ""])
doc("md5_docs", lambda c: H.digest(c, "md5"), "md5(text)")
doc("sha256_docs", lambda c: H.digest(c.cast("binary"), "sha256"), "sha256(text)")
doc("sha1_docs", lambda c: H.digest(c.cast("binary"), "sha1"), "sha1(text)")
doc("hashsum_line_docs", lambda c: H.sum_line(H.digest(c, "md5"), F.col("source")), "md5(text) || ' *' || source")
lit("crc32_cases", ["abcdefghijklmnopqrstuvwxyz", ""], lambda c: H.crc32_hex(F.encode(c, "UTF-8")), ["4c2750bd", "00000000"])
lit("ed2k_cases", ["", "abc"], lambda c: H.ed2k_hex(F.encode(c, "UTF-8")), ["31d6cfe0d16ae931b73c59d7e0c089c0", "a448017aaf21d8525fc10ae87aa6729d"])
lit("py2_hash_cases", ["asd", ""], H.string_hash_64, [1453079729203098327, 0])
doc("key_to_hash_docs", lambda c: H.hash_of_json(F.struct(F.col("lang"), F.col("source"))), "md5('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')")
