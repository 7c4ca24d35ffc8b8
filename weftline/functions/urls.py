"""URL functions as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an address; the per cent sign and the comma end one, which is part of the definition.
_VALID = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+;=]"


def url_pattern(schemes: Sequence[str] = ("http", "https")) -> str:
    return f"(?:{'|'.join(schemes)})://{_VALID}+"


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(https?://{_VALID}+)"), F.lit(1))


def replace_urls(c: Column, replacement: str, schemes: Sequence[str] = ("http", "https", "ftp")) -> Column:
    return F.regexp_replace(c, url_pattern(schemes), replacement.replace("\\", "\\\\").replace("$", "\\$"))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][\w+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """The last segment of the path."""
    return F.regexp_extract(path_of(url), r"[^/]*$", 0)


def argument(url: Column, name: str, path: str | None = None) -> Column:
    """The first decoded value of a query argument; null without one, where it is blank, or where the path differs."""
    raw = F.regexp_extract(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), rf"(?:^|&){name}=([^&]+)", 1)
    value = F.when(raw != "", F.try_url_decode(raw))
    return value if path is None else F.when(path_of(url) == path, value)


def replace_query(url: Column, query: Column, drop_fragment: bool = True) -> Column:
    tail = F.lit("") if drop_fragment else F.regexp_extract(url, r"#.*$", 0)
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("?"), query, tail)


def path_extension(path: Column) -> Column:
    """Lower-case extension without its point; none for names that only begin with one."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]*)$", 1))


def url_extension(url: Column) -> Column:
    return path_extension(path_of(url))


def file_uri(path: Column, **parameters: Column) -> Column:
    """A file: URI of an embedded database: reserved characters of the path are written by their codes, parameters follow as a query."""
    for mark, code in (("%", "%25"), ("?", "%3f"), ("#", "%23")):  # the per cent sign first
        path = F.replace(path, F.lit(mark), F.lit(code))
    query = [F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v)) for k, v in parameters.items()]
    return F.concat(F.lit("file:"), F.regexp_replace(path, "/+", "/"), F.lit("?"), F.concat_ws("&", *query))
