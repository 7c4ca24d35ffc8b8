"""Results as sorted rows of text, columns in order of name; floats to nine digits."""

from __future__ import annotations

import datetime
import decimal
import math


def plain(v) -> str:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def of_spark(df) -> tuple[list[str], list[list[str]]]:
    names = sorted(df.columns)
    return names, sorted([plain(r[n]) for n in names] for r in (x.asDict() for x in df.collect()))


def of_duck(con, sql: str) -> tuple[list[str], list[list[str]]]:
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted([plain(r[i]) for i in order] for r in cursor.fetchall())
