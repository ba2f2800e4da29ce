"""Spans in texts: all matches with places, overlap elimination, replacement.

A span is ``struct<text, start, end, confidence, method>`` with places in code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<text:string,start:int,end:int,confidence:double,method:string>"


def matches(text: Column, pattern: str) -> Column:
    """Array of ``struct<text, start, end>`` of all matches; the pattern must not match empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    start = F.expr("struct(0 as at, cast(array() as array<struct<text:string,start:int,end:int>>) as out)")

    def add(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("text"), at.alias("start"), end.alias("end")))).alias("out"))

    none = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    return F.when(text.isNull(), none).otherwise(F.coalesce(F.aggregate(step, start, add, lambda acc: acc["out"]), none))


def spans(text: Column, pattern: str, confidence: float, method: str) -> Column:
    return F.transform(matches(text, pattern), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))


def group_spans(text: Column, pattern: str, group: int, confidence: float, method: str) -> Column:
    """Spans of one capture group of every match (its first place inside the match)."""
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(matches(text, pattern), groups, lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def make(x):
        at = x["m"]["start"] + F.greatest(F.instr(x["m"]["text"], x["g"]) - 1, F.lit(0))
        return F.struct(x["g"].alias("text"), at.alias("start"), (at + F.length(x["g"])).alias("end"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    return F.coalesce(F.transform(F.filter(both, lambda x: x["g"].isNotNull() & (x["g"] != "")), make), F.expr(f"cast(array() as array<{SPAN}>)"))


def _greedy(ordered: Column, kind: str) -> Column:
    start = F.expr(f"cast(array() as array<{kind}>)")
    return F.aggregate(ordered, start, lambda acc, x: F.when(F.exists(acc, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(x))))


def earliest_longest(found: Column, kind: str = SPAN) -> Column:
    """Without overlaps: the earliest span wins, of equal starts the longest."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    return _greedy(F.array_sort(found, order), kind)


def by_priority(found: Column, kind: str) -> Column:
    """Without overlaps: higher priority first, then longer, then earlier; ordered by start."""
    length = lambda s: s["end"] - s["start"]
    order = lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).when(length(a) != length(b), length(b) - length(a)).otherwise(a["start"] - b["start"])
    return F.array_sort(_greedy(F.array_sort(found, order), kind), lambda a, b: a["start"] - b["start"])


def replace_spans(text: Column, found: Column) -> Column:
    """The text with each span (with ``start``, ``end``, ``replacement``, ordered) replaced."""
    start = F.expr("struct('' as out, 0 as at)")

    def put(acc, x):
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, x["replacement"]).alias("out"), x["end"].alias("at"))

    return F.aggregate(found, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def first_per_key(found: Column, key, kind: str = SPAN) -> Column:
    """One span a key: the highest confidence, of equals the first; in order of first sight."""
    start = F.expr(f"cast(array() as array<{kind}>)")
    better = lambda acc, x: F.transform(acc, lambda k: F.when((key(k) == key(x)) & (x["confidence"] > k["confidence"]), x).otherwise(k))
    return F.aggregate(found, start, lambda acc, x: F.when(F.exists(acc, lambda k: key(k) == key(x)), better(acc, x)).otherwise(F.concat(acc, F.array(x))))
