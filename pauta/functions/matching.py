"""Places of pattern matches, in Arrow batches.

Spark's regular expressions give the texts of matches, not their places, and one scan a
pattern. These functions run compiled patterns over the texts of a batch once, and return
arrays of ``struct<text, start, end, confidence, method>`` with places in code points from 0.
``per_row`` wraps a function of plain values as a column expression; all such expressions of
one projection share one trip to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pauta.functions.text import ACCENTS

Span = dict
ARROW_SPAN = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("method", pa.string())])
SPANS = "array<struct<text:string,start:int,end:int,confidence:double,method:string>>"
_BLANKS = re.compile(r"\s+")
_FOLD = str.maketrans(*ACCENTS)


def plain(text: str) -> str:
    """What ``text.plain_key`` gives: lower case, no accents, single blanks, trimmed."""
    if not text.isascii():
        text = text.translate(_FOLD)
        if not text.isascii():
            text = "".join(c for c in text if unicodedata.category(c)[0] != "M")
    return _BLANKS.sub(" ", text.lower()).strip(" ")


def squeezed(text: str) -> str:
    return _BLANKS.sub(" ", text)


def compiled(patterns: list[str], any_case: bool = True) -> list[re.Pattern]:
    return [re.compile(p, re.IGNORECASE if any_case else 0) for p in patterns]


def spans(text: str, pattern: re.Pattern, confidence: float, method: str, group: int = 0) -> list[Span]:
    """Spans of all matches, or of a group's text at its first place inside each match."""
    out = []
    for m in pattern.finditer(text):
        found = m.group(group)
        if found:
            at = m.start() + (m.group().find(found) if group else 0)
            out.append({"text": found, "start": at, "end": at + len(found), "confidence": confidence, "method": method})
    return out


def earliest_longest(found: list[Span]) -> list[Span]:
    """Without overlaps: the earliest span wins, of equal starts the longest."""
    out: list[Span] = []
    for x in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if not out or x["start"] >= out[-1]["end"]:
            out.append(x)
    return out


def first_per_key(found: list[Span], key: Callable[[Span], str]) -> list[Span]:
    """One span a key: the highest confidence, of equals the first; in order of first sight."""
    best: dict[str, Span] = {}
    for x in found:
        k = key(x)
        if k not in best or x["confidence"] > best[k]["confidence"]:
            best[k] = x
    return list(best.values())


by_start = itemgetter("start")


def per_row(function: Callable, returns: str, kind: pa.DataType, *columns: Column) -> Column:
    """``function`` of the columns' values, row by row inside Arrow batches, as one column."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([function(*row) for row in zip(*(a.to_pylist() for a in arrays))], kind)

    return F.arrow_udf(_as_arity(run, len(columns)), returns)(*columns)


def _as_arity(run: Callable, n: int) -> Callable:
    """``run`` with ``n`` annotated parameters, as Spark reads the kind of function from them."""
    if n == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return one
    if n == 2:

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return two

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return three
