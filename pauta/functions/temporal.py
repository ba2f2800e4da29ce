"""Temporal expressions in Portuguese, normalised against a reference date.

``normalize(expression, reference)`` is one column expression: a struct with the type, the
normalised date, time or interval as ISO text, the precision and a confidence. Rules are
tried in a fixed order, the first that fits wins: explicit date, day of the month, weekday
or relative day with a period, numeric offset, weekday, relative day, period, clock time.

What an expression states (:class:`Stated`) doesn't depend on the reference, and collections
of mails repeat few expressions, so it is read once a worker and expression; what remains a
row is arithmetic on whole days and seconds. As a tree of column expressions the rules took
the driver seconds to build and were interpreted inside lambdas; here they run in Arrow
batches, together with the search of the spans.

The reference is a timestamp without zone. Null and empty expressions are of type
``unknown``; a null reference gives null.
"""

from __future__ import annotations

import datetime as dt
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pauta.functions.matching import per_row, plain
from pauta.functions.text import let

#: The recognised notations.
TIME = r"(?:(?:as?|pelas?)\s*)?(\d{1,2})(?:h(?:(\d{2}))?|[:\.](\d{1,2})|\s*horas?)(?:\s*min)?(?!\s*de)"
DATE = r"\b(?:(\d{1,2})\s+de\s+([a-z]+)(?:\s+de\s+(\d{4}))?|(\d{1,2})\s*([/-])\s*(\d{1,2})(?:\s*[/-]\s*(\d{2,4}))?)\b"
DAY = r"\bdia\s+(\d{1,2})\b"
WEEKDAY = r"(?:(proxima|proximo|esta|este)\s+)?(segunda(?:-feira)?|terca(?:-feira)?|quarta(?:-feira)?|quinta(?:-feira)?|sexta(?:-feira)?|sabado|domingo)"
RELATIVE = r"(depois de amanha|depois amanha|amanha|hoje|ontem|agora|para a semana|esta semana|na proxima semana|proxima semana|proximo mes|este mes|em breve|final desta semana|final da semana|fim desta semana|fim da semana)"
PERIOD = r"\b(durante\s+a\s+manha|ao\s+final\s+do\s+dia|final\s+do\s+dia|pela\s+manha|de\s+manha|manha|pela\s+tarde|de\s+tarde|tarde|pela\s+noite|de\s+noite|noite|apos\s+almoco|depois\s+de\s+almoco|pos\s+almoco|apos\s+cafe|depois\s+do\s+cafe|pos\s+cafe)\b"
OFFSET = r"(?:em|daqui\s+a|dentro\s+de)\s+(\d+)\s+(dias?|semanas?|horas?)"
MONTHS = {"janeiro": 1, "jan": 1, "fevereiro": 2, "fev": 2, "marco": 3, "mar": 3, "abril": 4, "abr": 4, "maio": 5, "mai": 5, "junho": 6, "jun": 6, "julho": 7, "jul": 7, "agosto": 8, "ago": 8, "setembro": 9, "set": 9, "outubro": 10, "out": 10, "novembro": 11, "nov": 11, "dezembro": 12, "dez": 12}
#: Monday is 0. The hyphenated third day has no entry: it stays unknown, as in the original rules.
WEEKDAYS = {"segunda": 0, "segunda-feira": 0, "terca": 1, "quarta": 2, "quarta-feira": 2, "quinta": 3, "quinta-feira": 3, "sexta": 4, "sexta-feira": 4, "sabado": 5, "domingo": 6}
DAYS = {"hoje": 0, "agora": 0, "amanha": 1, "depois de amanha": 2, "depois amanha": 2, "ontem": -1}
#: A part of the period's name, and start and end in minutes of the day.
PERIODS = [("manha", 360, 720), ("tarde", 720, 1080), ("noite", 1080, 1439), ("final do dia", 1020, 1140), ("almoco", 750, 840), ("cafe", 540, 630)]

RESULT = "struct<type:string,datetime:string,date:string,time:string,interval_start:string,interval_end:string,precision:string,confidence:double>"
FIELDS = ("type", "datetime", "date", "time", "interval_start", "interval_end", "precision", "confidence")
ARROW_RESULT = pa.struct([(f, pa.float64() if f == "confidence" else pa.string()) for f in FIELDS])
DAY_S = 86400
_EPOCH = dt.date(1970, 1, 1).toordinal()
_RE = {k: re.compile(p, re.ASCII) for k, p in {"time": TIME, "date": DATE, "day": DAY, "weekday": WEEKDAY, "relative": RELATIVE, "period": PERIOD, "offset": OFFSET}.items()}


class Stated:
    """What an expression states, whatever the reference."""

    def __init__(self, expression: str | None) -> None:
        e = plain(expression or "")
        self.clock = self._clock(e)
        found = m.group() if (m := _RE["period"].search(e)) else ""
        self.period = next(((a, b) for part, a, b in PERIODS if part in found), None)
        self.date = self._date(m) if (m := _RE["date"].search(e)) else None
        self.day = int(m.group(1)) if (m := _RE["day"].search(e)) else None
        self.weekday = (m.group(1) or "", WEEKDAYS.get(m.group(2))) if (m := _RE["weekday"].search(e)) else None
        self.relative = m.group(1) if (m := _RE["relative"].search(e)) else None
        m = _RE["offset"].search(e)
        self.offset = (int(m.group(1)), m.group(2)) if m and len(m.group(1)) < 8 and int(m.group(1)) < 2_000_000 else None
        self.dated = bool(_RE["date"].search(e)) or self.weekday is not None or self.relative is not None

    @staticmethod
    def _clock(e: str) -> int | None:
        """Minutes of the day of the first clock time, None where there is none or it is out of range."""
        if not (m := _RE["time"].search(e)):
            return None
        h, minute = int(m.group(1)), int(m.group(2) or m.group(3) or 0)
        return h * 60 + minute if h < 24 and minute < 60 else None

    @staticmethod
    def _date(m: re.Match) -> tuple[int | None, int | None, int]:
        """(year, month, day) as written; a year of two digits is of this century."""
        month = MONTHS.get(m.group(2)) if m.group(1) else int(m.group(6))
        year = m.group(3) or m.group(7)
        year = int(year) if year else None
        return (year + 2000 if year is not None and year < 100 else year), month, int(m.group(1) or m.group(4))


stated = functools.lru_cache(maxsize=200_000)(Stated)


class Reference:
    """Whole numbers of a moment without zone."""

    def __init__(self, moment: int) -> None:
        self.moment = moment
        self.day = moment // DAY_S
        self.weekday = (self.day + 3) % 7
        date = dt.date.fromordinal(self.day + _EPOCH) if -719162 <= self.day <= 2932896 else dt.date(1, 1, 1)
        self.year, self.month = date.year, date.month


def _days(year: int, month: int | None, day: int) -> int | None:
    try:
        return dt.date(year, month, day).toordinal() - _EPOCH
    except (ValueError, TypeError):
        return None


def _date_text(day: int) -> str:
    text = str(np.datetime64(day, "D"))
    return text if day <= 2932896 else f"+{text}"


def _clock_text(seconds: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def _iso(moment: int) -> str:
    return f"{_date_text(moment // DAY_S)}T{_clock_text(moment % DAY_S)}"


def _at(kind: str, precision: str, confidence: float, moment: int) -> tuple:
    return kind, _iso(moment), _date_text(moment // DAY_S), _clock_text(moment % DAY_S), None, None, precision, confidence


def _between(precision: str, confidence: float, start: int, end: int) -> tuple:
    return "interval", None, _date_text(start // DAY_S), None, _iso(start), _iso(end), precision, confidence


def _dated(kind: str, day: int, clock: int | None, period: tuple[int, int] | None, confidence: float) -> tuple:
    """A day with a clock time, else with a period, else alone."""
    if clock is not None:
        return _at("datetime", "exact", confidence, day * DAY_S + clock * 60)
    if period is not None:
        return _between("time_of_day", confidence, day * DAY_S + period[0] * 60, day * DAY_S + period[1] * 60)
    return kind, None, _date_text(day), None, None, None, "day", confidence


def _next_day_of_month(s: Stated, ref: Reference) -> int | None:
    """The first such day from the reference on, within a year."""
    for i in range(13):
        month = ref.year * 12 + ref.month - 1 + i
        day = _days(month // 12, month % 12 + 1, s.day)
        if day is not None and (day * DAY_S + s.clock * 60 > ref.moment if s.clock is not None else day >= ref.day):
            return day
    return None


def _weekday(s: Stated, ref: Reference) -> int | None:
    """The day that a weekday expression denotes."""
    which, wanted = s.weekday
    if wanted is None:
        return None
    ahead = wanted - ref.weekday
    if which in ("proxima", "proximo"):
        return ref.day + (ahead + 7 if ahead <= 0 else ahead)
    week = ahead % 7
    if week == 0 and which == "":
        later = s.clock is not None and s.clock * 60 > ref.moment - ref.day * DAY_S
        return ref.day + (0 if later else 7)
    return ref.day + week


def _relative(s: Stated, ref: Reference, with_period: bool) -> tuple | None:
    x = s.relative
    if x is None:
        return None
    period = s.period if with_period else None
    monday = (ref.day - ref.weekday) * DAY_S
    if x in DAYS:
        return _dated("relative", ref.day + DAYS[x], s.clock, period, 0.85)
    if x in ("esta semana", "para a semana", "na proxima semana", "proxima semana"):
        start = monday + (0 if x == "esta semana" else 7 * DAY_S)
        return _between("week", 0.75, start, start + 7 * DAY_S - 1)
    if x in ("este mes", "proximo mes"):
        month = ref.year * 12 + ref.month - 1 + (x == "proximo mes")
        first, end = (_days(k // 12, k % 12 + 1, 1) for k in (month, month + 1))
        return _between("month", 0.75, first * DAY_S, end * DAY_S - 1)
    if x == "em breve":
        return _between("vague", 0.75, ref.moment, ref.moment + 3 * DAY_S)
    sunday = ref.day - ref.weekday + 6
    if period is not None and s.clock is None:
        return _between("time_of_day", 0.85, sunday * DAY_S + period[0] * 60, sunday * DAY_S + period[1] * 60)
    return "date", None, _date_text(sunday), None, None, None, "day", 0.85


def _offset(s: Stated, ref: Reference) -> tuple:
    n, unit = s.offset
    target = ref.moment + n * (7 * DAY_S if unit.startswith("semana") else 3600 if unit.startswith("hora") else DAY_S)
    if s.clock is not None:
        return _at("datetime", "exact", 0.9, target // DAY_S * DAY_S + s.clock * 60)
    if unit.startswith("hora"):
        return _at("datetime", "hour", 0.9, target // 60 * 60)
    return "relative", None, _date_text(target // DAY_S), None, None, None, "day", 0.9


def resolve(expression: str | None, ref: Reference) -> tuple:
    """The values of ``FIELDS`` of an expression against a reference."""
    s = stated(expression)
    if s.date is not None:
        year, month, day = s.date
        found = _days(ref.year if year is None else year, month, day)
        if found is not None:
            return _dated("date", found, s.clock, s.period, 0.95)
    if s.day is not None and (day := _next_day_of_month(s, ref)) is not None:
        return _dated("date", day, s.clock, s.period, 0.88)
    if s.weekday is not None and s.period is not None:
        if (day := _weekday(s, ref)) is not None:
            if s.clock is not None:
                return _at("datetime", "exact", 0.9, day * DAY_S + s.clock * 60)
            return _between("time_of_day", 0.75, day * DAY_S + s.period[0] * 60, day * DAY_S + s.period[1] * 60)
    elif out := _relative(s, ref, True):
        return out
    if s.offset is not None:
        return _offset(s, ref)
    if s.weekday is not None and (day := _weekday(s, ref)) is not None:
        return _dated("date", day, s.clock, None, 0.9)
    if out := _relative(s, ref, False):
        return out
    if s.period is not None and not s.dated:
        return _between("time_of_day", 0.75, ref.day * DAY_S + s.period[0] * 60, ref.day * DAY_S + s.period[1] * 60)
    if s.clock is not None:
        return _at("time", "time_only", 0.8, ref.day * DAY_S + s.clock * 60)
    return "unknown", None, None, None, None, None, "", 0.0


def canonical_text(values: tuple) -> str | None:
    """Interval ``a/b``, else date-time, else date, else time, of the values of ``FIELDS``."""
    _, moment, date, time, start, end, _, _ = values
    return f"{start}/{end}" if start is not None else moment if moment is not None else date if date is not None else time


def reference_of(value: dt.datetime | None) -> Reference | None:
    return None if value is None else Reference((value.toordinal() - _EPOCH) * DAY_S + value.hour * 3600 + value.minute * 60 + value.second)


def _normalized(expression: str | None, reference: dt.datetime | None) -> dict | None:
    ref = reference_of(reference)
    return None if ref is None else dict(zip(FIELDS, resolve(expression, ref)))


def normalize(expression: Column, reference: Column) -> Column:
    """The struct ``RESULT`` of an expression against a ``timestamp_ntz`` reference."""
    return per_row(_normalized, RESULT, ARROW_RESULT, expression, reference)


def canonical(n: Column) -> Column:
    """Interval ``a/b``, else date-time, else date, else time."""
    return let(n, lambda x: F.coalesce(F.concat(x["interval_start"], F.lit("/"), x["interval_end"]), x["datetime"], x["date"], x["time"]))


#: The keys under which a mail may hold its date, in this order.
DATE_KEYS = ("sent_datetime", "sent_at", "email_date", "date", "Date", "created_at", "timestamp")
_RFC_2822 = r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+(?:[+-]\d{4}|[A-Za-z]{1,5}))?(?:\s*\([^)]*\))?$"


def _iso_moment(value: Column) -> Column:
    return F.regexp_replace(value, r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def _mail_moment(value: Column) -> Column:
    """A date as mail headers write it."""
    part = lambda k: F.regexp_extract(value, _RFC_2822, k)
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(2))) + 2) / 3
    whole = F.when((part(2) != "") & (month == F.floor(month)) & (month >= 1), month.cast("int").cast("string"))
    two = lambda c: F.lpad(c, 2, "0")
    text = F.concat(part(3), F.lit("-"), two(whole), F.lit("-"), two(part(1)), F.lit(" "), two(part(4)), F.lit(":"), part(5), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)))
    return text.try_cast("timestamp_ntz")


def parse_reference(*values: Column) -> Column:
    """First value that reads as ISO date-time or as a mail header's date (zone dropped), as ``timestamp_ntz``."""
    one = lambda v: F.coalesce(_iso_moment(v), _mail_moment(v))
    return F.coalesce(*[one(F.trim(v.cast("string"))) for v in values])


def mail_reference(columns: list[str], fallback: Column | None = None) -> Column:
    """The moment of a mail: of its columns named in ``DATE_KEYS`` the first, in that order, that reads as one."""
    have = [F.col(f"`{k}`") for k in DATE_KEYS if k in columns]
    found = [parse_reference(*have)] if have else []
    return F.coalesce(*found, *([fallback] if fallback is not None else []), F.lit(None).cast("timestamp_ntz"))
