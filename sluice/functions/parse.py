"""Scalar expressions: parsing, splitting, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sensor_fields(line: Column) -> list[Column]:
    """id, ts and vc of a line "id,ts,vc". Further fields are ignored; a missing field or a bad number fails, as ANSI casts do."""
    parts = F.split(line, ",")
    return [F.element_at(parts, 1).alias("id"), F.element_at(parts, 2).cast("long").alias("ts"), F.element_at(parts, 3).cast("int").alias("vc")]


def words(line: Column, separator: str = " ") -> Column:
    """Array of the pieces of line between separators, which are taken as they are; empty ones at its end are dropped, those inside are kept."""
    plain = re.sub(r"([^A-Za-z0-9])", r"\\\1", separator)
    return F.split(F.regexp_replace(line, f"(?:{plain})+$", ""), plain)


def event_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def routed_values(id_: Column, ts: Column, vc: Column, first, second) -> Column:
    """Array of no, one or two numbers: vc for the first id; ts, then vc, for the second; none for others. explode() it."""
    return F.when(id_ == first, F.array(vc.cast("long"))).when(id_ == second, F.array(ts.cast("long"), vc.cast("long"))).otherwise(F.array().cast("array<long>"))


def user_to_bytes(name: Column, id_: Column, age: Column) -> Column:
    """Big-endian age, then name and id, each a big-endian length and UTF-8 bytes; null if age, name or id is."""
    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))
    text = lambda c: F.concat(number(F.octet_length(c)), F.encode(c, "UTF-8"))
    return F.concat(number(age), text(name), text(id_))


def user_from_bytes(raw: Column) -> Column:
    """struct(name, id, age) of what user_to_bytes() makes; null for null."""
    number = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("long")
    signed = lambda n: F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int")
    part = lambda at, n: raw.substr(F.lit(at) if isinstance(at, int) else at, n)
    n_name = number(F.lit(5)).cast("int")
    id_at = F.lit(9) + n_name
    n_id = F.conv(F.hex(part(id_at, F.lit(4))), 16, 10).cast("int")
    decoded = F.struct(F.decode(part(9, n_name), "UTF-8").alias("name"), F.decode(part(id_at + 4, n_id), "UTF-8").alias("id"), signed(number(F.lit(1))).alias("age"))
    return F.when(raw.isNotNull(), decoded)
