"""Subtitles, word vectors, word counts, user-agent patterns and embedded item data."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.sources.files import numbered_lines

_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)"


def to_millis(c: Column) -> Column:
    """HH:MM:SS,mmm as milliseconds."""
    part = lambda k: F.regexp_extract(c, f"^{_TIME}$", k).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def to_time(c: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    whole = lambda n: F.floor(c / n).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, (c % 1000).cast("long"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """path, num, start, end (milliseconds), lines of SubRip files; a block that is none fails the read.

    Blocks are found by their blank lines: a running count per file gives each block its number.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.rtrim(F.regexp_replace("line", "^\\x{feff}", ""), F.lit(" \t\r\n")))
    from pyspark.sql import Window as W

    block = F.count_if(F.col("line") == "").over(W.partitionBy("path").orderBy("at"))
    grouped = lines.withColumn("block", block).where("line <> ''").groupBy("path", "block").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    texts = grouped.select("path", F.transform("l", lambda x: x["line"]).alias("t"), F.get("l", 0)["at"].alias("first"))
    times = F.split(F.get("t", 1), " --> ")
    num, start, end = F.get("t", 0).try_cast("int"), to_millis(F.get(times, 0)), to_millis(F.get(times, 1))
    bad = num.isNull() | start.isNull() | end.isNull()
    broken = F.raise_error(F.concat(F.lit("no subtitle in line "), (F.col("first") + 1).cast("string"))).cast("int")
    return texts.select("path", F.when(F.coalesce(bad, F.lit(True)), broken).otherwise(num).alias("num"), start.alias("start"), end.alias("end"), F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0))).alias("lines"))


def srt_text(num: Column, start: Column, end: Column, lines: Column) -> Column:
    """A subtitle block as its file has it."""
    return F.concat(num.cast("string"), F.lit("\n"), to_time(start), F.lit(" --> "), to_time(end), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))


def merge_lines(lines: Column, mark: str) -> Column:
    """Lines that begin with the mark start anew, others continue the one before."""
    begin = F.transform(lines, lambda x, i: F.when(x.startswith(mark) | (i == 0), i).otherwise(F.lit(-1)))
    starts = F.filter(begin, lambda i: i >= 0)

    def one(a: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        text = F.array_join(F.slice(lines, a + 1, stop - a), " ")
        return F.when(F.get(lines, a).startswith(mark), F.substr(text, F.lit(len(mark) + 1), F.length(text))).otherwise(text)

    return F.transform(starts, one)


def read_microdvd(spark: SparkSession, path: str) -> DataFrame:
    """path, at, start, end (frames), lines of MicroDVD files."""
    lines = numbered_lines(spark, path).withColumn("line", F.rtrim(F.regexp_replace("line", "^\\x{feff}", ""), F.lit(" \t\r\n"))).where("line <> ''")
    part = lambda k: F.regexp_extract("line", r"^\{(\d+)\}\{(\d+)\}(.*)$", k)
    start = F.when(part(1) == "", F.raise_error(F.concat(F.lit("no subtitle in line "), (F.col("at") + 1).cast("string"))).cast("string")).otherwise(part(1))
    return lines.select("path", "at", start.cast("int").alias("start"), part(2).try_cast("int").alias("end"), F.split(part(3), r"\|").alias("lines"))


def read_vectors(spark: SparkSession, path: str, header: bool, limit: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """word, idx, count, vector of word-vector text files; with header the first line (count, size) is left out.

    Numbers follow the lines that are kept; a word that occurs twice fails the read.
    """
    from weftline.operators.ordering import with_index

    lines = numbered_lines(spark, path).where(F.col("at") >= (1 if header else 0))
    if limit is not None:
        lines = lines.where(F.col("at") < limit + (1 if header else 0))
    parts = lines.withColumn("line", F.rtrim("line")).select("at", F.substring_index("line", " ", 1).alias("word"), F.split(F.expr("substring(line, locate(' ', line) + 1)"), " +").alias("v"))
    if keep is not None:
        parts = parts.where(keep(F.col("word")))
    rows = with_index(parts.select("at", "word", F.transform("v", lambda x: x.cast("float")).alias("vector")), ["at"], (), "idx")
    twice = rows.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("word")
    checked = rows.join(twice.withColumn("_twice", F.lit(True)), "word", "left")
    word = F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("duplicate word "), "word")).cast("string")).otherwise(F.col("word"))
    size = rows.agg(F.count(F.lit(1)).alias("_size"))
    return checked.crossJoin(F.broadcast(size)).select(word.alias("word"), "idx", (F.col("_size") - F.col("idx")).alias("count"), "vector")


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new words (word, place, count, vector) numbered after the old ones."""
    top = vectors.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("_top"))
    added = new.crossJoin(F.broadcast(top)).select("word", (F.col("_top") + F.col("place")).alias("idx"), "count", "vector")
    return vectors.unionByName(added)


def read_counts(spark: SparkSession, path: str, normalize: bool = False, limit: int | None = None) -> DataFrame:
    """word, count (or its share of all) of files with a word and a number a line."""
    lines = numbered_lines(spark, path)
    if limit is not None:
        lines = lines.where(F.col("at") < limit)
    parts = lines.select("at", F.split(F.trim("line"), r"\s+").alias("p")).where("size(p) = 2")
    rows = parts.groupBy(F.get("p", 0).alias("word")).agg(F.max_by(F.get("p", 1).cast("long"), "at").alias("count"))
    if not normalize:
        return rows
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("count").alias("_t")))).select("word", (F.col("count") / F.col("_t")).alias("count"))


def glob_regex(pattern: Column) -> Column:
    """A wildcard pattern as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([^A-Za-z0-9*?])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*")), F.lit("$"))


def match_patterns(df: DataFrame, column: str, patterns: DataFrame, pattern: str, most: int = 5000) -> DataFrame:
    """Rows with each pattern that they match, in either case; the pattern table is counted before it is broadcast."""
    if patterns.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} patterns")
    listed = patterns.withColumn("_regex", F.concat(F.lit("(?i)"), glob_regex(F.col(pattern))))
    return df.join(F.broadcast(listed), F.expr(f"`{column}` RLIKE _regex")).drop("_regex")


class _Items(HTMLParser):
    """Items of schema.org microdata as nested dicts of lists."""

    void = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.root: dict = {}
        self.stack: list[list] = [["", self.root, None, []]]  # tag, dict to fill, property name, text

    def handle_starttag(self, tag, attrs):
        a, into = dict(attrs), self.stack[-1][1]
        name = None
        if "itemscope" in a and "itemtype" in a:
            own: dict = {}
            key = a["itemtype"] if "itemprop" not in a else f"{a['itemtype']}#{a['itemprop']}"
            into.setdefault(key, []).append(own)
            into = own
        elif "itemprop" in a and "itemscope" not in a and "itemtype" not in a:
            if tag == "meta":
                into.setdefault(a["itemprop"], []).append(a.get("content") or "")
            elif a["itemprop"] == "url":
                into.setdefault("url", []).append(a.get("href") or "")
            else:
                name = a["itemprop"]
        if tag not in self.void:
            self.stack.append([tag, into, name, []])

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.stack[1:]):
            while True:
                own, into, name, text = self.stack.pop()
                if name is not None and text:
                    self.stack[-1][1].setdefault(name, []).append("".join(text).strip())
                if own == tag:
                    break

    def handle_data(self, data):
        for e in self.stack:
            if e[2] is not None:
                e[3].append(data)


@pandas_udf(T.StringType())
def microdata(pages: pd.Series) -> pd.Series:
    """Items of each page as JSON."""
    import json

    def one(page):
        p = _Items()
        p.feed(page or "")
        return json.dumps(p.root, ensure_ascii=False)

    return pages.map(one)
