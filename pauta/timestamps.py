"""Mixed timestamp notations and time zones, brought to UTC instants.

A value is matched once against a grammar of the
notations people and programs write, its groups are checked, and the instant is computed
in seconds, so nothing depends on the session's time zone. Where neither an offset nor a
zone stands in the value, the wall clock of a given zone counts; ``zone_violations``
estimates that zone where it is unknown, by aligning the local times of rows with their
ingestion times under the offset history of every candidate zone.

Defined results: null, empty, unreadable and impossible values, days without a clock time,
expressions that need another date, and wall-clock times that a change of the clocks skips
or repeats give null.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISBON = "Europe/Lisbon"

#: Offsets of zone names in hours, month names, weekday names.
ZONE_NAMES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "cet": 1, "cest": 2, "azot": -1, "azost": 0}
MONTHS = [
    "janeiro|january|jan", "fevereiro|february|fev|feb", "março|marco|march|mar", "abril|april|abr|apr", "maio|may|mai", "junho|june|jun",
    "julho|july|jul", "agosto|august|ago|aug", "setembro|september|set|sep|sept", "outubro|october|out|oct", "novembro|november|nov", "dezembro|december|dez|dec",
]
WEEKDAYS = "(?:segunda|ter[çc]a|quarta|quinta|sexta)(?:-feira)?|s[áa]bado|domingo|seg|ter|qua|qui|sex|s[áa]b|dom|mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
PLACES = {"açores": "Atlantic/Azores", "acores": "Atlantic/Azores", "madeira": "Atlantic/Madeira", "lisboa": LISBON, "portugal continental": LISBON, "madrid": "Europe/Madrid"}


def _zones() -> list[str]:
    known = {z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))}
    return sorted(known | {LISBON, "Atlantic/Azores", "Atlantic/Madeira", "Europe/Madrid", "Europe/Paris", "Europe/London", "Europe/Berlin"})


_MARK = "\x01"
_MONTH = "|".join(MONTHS)
_DATE = rf"(?:(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})|(\d{{1,2}})([-/.])(\d{{1,2}})\6(\d{{4}}|\d{{2}})|(\d{{1,2}})(?:\s+de\s+|\s*-\s*|\s+)({_MONTH})\.?(?:\s+de\s+|\s*-\s*|,?\s+)(\d{{4}}))"
_TIME = r"(\d{1,2})(?:(?:\s?[:h]\s?)(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|\s?h)\s?(am|pm|a\.\s?m\.|p\.\s?m\.)?"
_ZONE = r"(?:\s*([+-]\d{2}(?::?\d{2})?)(?:\s*[\[(][^\])]*[\])])?|\s*[\[(]?(z|utc|gmt|ut|west|wet|cest|cet|azost|azot)[\])]?|\s*[\[(]?([a-z]+(?:/[a-z_+-]+)+)[\])]?|\s*\(?hora\s+(?:d[oae]s?\s+)?([a-zç ]+?)\)?)?"
_DAY_FIRST = rf"(?iu)^(?:({WEEKDAYS})\.?,?\s+)?(?:dia\s+)?{_DATE}(?:t|\s+t?|,\s*|,?\s+(?:[àa]s|pelas)\s+){_TIME}{_ZONE}$"
_TIME_FIRST = rf"(?iu)^(?:[àa]s\s+|pelas\s+)?{_TIME}(?:\s+d[eo]\s+(?:dia\s+)?|,?\s+(?:dia\s+)?){_DATE}{_ZONE}$"
_COMPACT = rf"(?iu)^(\d{{4}})(\d{{2}})(\d{{2}})(?:t|\s)?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$"
#: Parts of a value, in this order, between marks.
_PARTS = ("year", "month", "day", "name", "hour", "minute", "second", "half", "offset", "abbr", "region", "place")


def _shift(pattern: str, by: int) -> str:
    """Back references of a date pattern when ``by`` groups stand before it."""
    return pattern.replace("\\2", f"\\{2 + by}").replace("\\6", f"\\{6 + by}")


def _groups(value: Column, pattern: str, order: list[str]) -> Column:
    return F.regexp_replace(value, pattern, _MARK + _MARK.join(order))


def parts_of(value: Column) -> Column:
    """Array of the value's written parts (see ``_PARTS``), null where no notation fits."""
    v = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^ | $", "")
    # group numbers: the weekday is 1, the date 2-12, the time 13-16, the zone 17-20
    day_first = _groups(v, _shift(_DAY_FIRST, 1), ["$2$9$12", "$4$8", "$5$6$10", "$11", "$13", "$14", "$15", "$16", "$17", "$18", "$19", "$20"])
    time_first = _groups(v, _shift(_TIME_FIRST, 4), ["$5$12$15", "$7$11", "$8$9$13", "$14", "$1", "$2", "$3", "$4", "$16", "$17", "$18", "$19"])
    compact = _groups(v, _COMPACT, ["$1", "$2", "$3", "", "$4", "$5", "$6", "", "$7", "$8", "$9", "$10"])
    marked = F.when(v.rlike(r"^[0-9]{9,11}$|^[0-9]{13}$"), F.lit(None)).when(day_first.startswith(_MARK), day_first).when(time_first.startswith(_MARK), time_first).when(compact.startswith(_MARK), compact)
    return F.slice(F.split(marked, _MARK), 2, len(_PARTS))


def _number(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _wall(p: dict[str, Column]) -> Column:
    """Seconds since 1970 of the written wall clock, null where date or clock are impossible."""
    year = F.when(F.length(p["year"]) == 2, F.concat(F.lit("20"), p["year"])).otherwise(p["year"])
    named = F.element_at(F.create_map(*[x for k, names in enumerate(MONTHS, 1) for n in names.split("|") for x in (F.lit(n), F.lit(str(k)))]), F.lower(p["name"]))
    month = F.when(p["name"] != "", named).otherwise(p["month"])
    date = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(p["day"], 2, "0")).try_cast("date")
    half = F.lower(F.substring(p["half"], 1, 1))
    raw, minute, second = _number(p["hour"]), F.coalesce(_number(p["minute"]), F.lit(0)), F.coalesce(_number(p["second"]), F.lit(0))
    hour = F.when(half == "", raw).when(raw.between(1, 12), raw % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when((month != "") & (hour < 24) & (minute < 60) & (second < 60), F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second)


def _region(p: dict[str, Column], zone: Column) -> Column:
    regions = F.create_map(*[x for z in _zones() for x in (F.lit(z.lower()), F.lit(z))])
    places = F.create_map(*[x for k, v in PLACES.items() for x in (F.lit(k), F.lit(v))])
    place = F.regexp_replace(F.lower(p["place"]), "^(?:dos|das|do|da|de) ", "")
    return F.when(p["region"] != "", F.element_at(regions, F.lower(p["region"]))).when(place != "", F.element_at(places, place)).otherwise(zone)


def _fixed_offset(p: dict[str, Column]) -> Column:
    o = F.regexp_replace(p["offset"], ":", "")
    hours, minutes = _number(F.substring(o, 2, 2)), F.coalesce(_number(F.substring(o, 4, 2)), F.lit(0))
    written = F.when((hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(F.substring(o, 1, 1) == "-", -1).otherwise(1))
    abbr = F.element_at(F.create_map(*[x for k, v in ZONE_NAMES.items() for x in (F.lit(k), F.lit(v * 3600))]), F.lower(p["abbr"]))
    return F.when(p["offset"] != "", written).otherwise(abbr)


def with_seconds(df: DataFrame, value: str, name: str, zone: Column | str = LISBON) -> DataFrame:
    """``df`` with ``name``: seconds since 1970 UTC of the instant that ``value`` denotes, else null.

    Every step is a column of its own, so the optimiser evaluates it once a row.
    """
    at = lambda k: f"__{name}_{k}"
    p = {k: F.get(at("parts"), F.lit(i)) for i, k in enumerate(_PARTS)}
    digits = F.regexp_replace(F.col(value), r"(?U)\s+", "")
    given = zone if isinstance(zone, Column) else F.lit(zone)
    out = df.withColumn(at("parts"), parts_of(F.col(value)))
    out = out.withColumns({at("wall"): _wall(p), at("fixed"): _fixed_offset(p), at("zoned"): (p["offset"] != "") | (p["abbr"] != ""), at("region"): _region(p, given)})
    wall, region = F.col(at("wall")), F.col(at("region"))
    out = out.withColumns({at("before"): wall - offset_at(wall - 86400, region), at("after"): wall - offset_at(wall + 86400, region)})
    before, after = F.col(at("before")), F.col(at("after"))
    out = out.withColumns({at("first"): F.when(before + offset_at(before, region) == wall, before), at("second"): F.when(after + offset_at(after, region) == wall, after)})
    first, second = F.col(at("first")), F.col(at("second"))
    local = F.when(first.isNull(), second).when(second.isNull() | (first == second), first)  # two instants: the clocks repeat it
    number = digits.try_cast("bigint")
    # twelve digits are a date with a clock time where they can be one, else milliseconds of before September 2001
    short = digits.rlike("^[0-9]{12}$") & (wall.isNull() | ~digits.rlike("^(?:19|20)"))
    epoch = F.when(digits.rlike("^[0-9]{9,11}$"), number).when(digits.rlike("^[0-9]{13}$") | short, F.floor(number / 1000))
    instant = F.coalesce(epoch, F.when(F.col(at("zoned")), wall - F.col(at("fixed"))).otherwise(local))
    # the partition's number keeps a filter on the result from being copied into all steps below
    out = out.withColumn(name, F.when(F.spark_partition_id() >= 0, instant))
    return out.drop(*[at(k) for k in ("parts", "wall", "fixed", "zoned", "region", "before", "after", "first", "second")])


def offset_at(seconds: Column, zone: Column) -> Column:
    """The zone's offset from UTC in seconds at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)) - seconds


def iso_utc(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of an instant; null outside the years 1 to 9999."""
    day = F.floor(seconds / 86400)
    rest = seconds - day * 86400
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.when(day.between(-719162, 2932896), F.date_from_unix_date(day.cast("int")))
    return F.concat(F.lpad(date.cast("string"), 10, "0"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def with_utc(df: DataFrame, column: str, name: str, zone: Column | str = LISBON) -> DataFrame:
    """``df`` with column ``name``: the UTC text of the instant of the text column ``column``, or null."""
    sec = f"__{name}_seconds"
    return with_seconds(df, column, sec, zone).withColumn(name, iso_utc(F.col(sec))).drop(sec)


def instants(df: DataFrame, key: str, fields: list[str], zone: Column | str = LISBON) -> DataFrame:
    """Distinct (id, field, utc) of the named fields' values that denote one instant."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    long = df.select(F.col(key).alias("id"), pairs).select("id", "x.field", "x.value").where("value is not null")
    return with_utc(long, "value", "utc", zone).where("utc is not null").select("id", "field", "utc").distinct()


def zone_violations(df: DataFrame, local: str, ingested: str, zones: list[str], group: str | None = None) -> DataFrame:
    """For every group and candidate zone: rows without a written zone, violations, mean lag.

    A violation is a local time that under the zone's offset history lies after the row's
    ingestion, or that the history skips or repeats. ``chosen`` marks the zone with fewest
    violations (then the smaller mean lag, then the name). Counts are combined on the map
    side; there are as many result rows as groups times candidates.
    """
    value = F.col(local).cast("string")
    g = F.col(group) if group else F.lit("all")
    bare = df.select(g.alias("grp"), value.alias("value"), F.unix_seconds(F.col(ingested)).alias("at")).withColumn("parts", parts_of(F.col("value")))
    unzoned = (F.get("parts", F.lit(8)) == "") & (F.get("parts", F.lit(9)) == "") & (F.get("parts", F.lit(10)) == "") & (F.get("parts", F.lit(11)) == "")
    each = bare.where(unzoned).withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    each = with_seconds(each.drop("parts"), "value", "sec", F.col("zone"))
    bad = F.col("sec").isNull() | (F.col("sec") > F.col("at"))
    votes = each.groupBy("grp", "zone").agg(F.count("*").alias("rows"), F.count_if(bad).alias("violations"), F.round(F.avg(F.when(~bad, F.col("at") - F.col("sec"))), 3).alias("mean_lag"))
    best = votes.groupBy("grp").agg(F.min(F.struct("violations", F.coalesce("mean_lag", F.lit(1e18)).alias("l"), "zone")).alias("b"))
    return votes.join(best, "grp").select("grp", "zone", "rows", "violations", "mean_lag", (F.col("zone") == F.col("b.zone")).alias("chosen"))
