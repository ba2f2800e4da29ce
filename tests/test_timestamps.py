import pytest
from pauta.timestamps import instants, with_utc, zone_violations

CASES = [
    ("2026-01-05T10:20:30", "2026-01-05T10:20:30Z"),
    ("2026-07-05T10:20:30", "2026-07-05T09:20:30Z"),
    ("2026-07-05T10:20:30.987654321Z", "2026-07-05T10:20:30Z"),
    ("2026-07-05 10:20:30,5+02:00", "2026-07-05T08:20:30Z"),
    ("Fri, 21 Aug 2026 14:22:10 +0100 (WEST)", "2026-08-21T13:22:10Z"),
    ("2 Oct 2025 19:40:32 GMT", "2025-10-02T19:40:32Z"),
    ("2026/09/04 17:43:51 UTC", "2026-09-04T17:43:51Z"),
    ("14 de maio de 2026 às 17h18", "2026-05-14T16:18:00Z"),
    ("quarta-feira, 1 de Julho de 2026, 22:11", "2026-07-01T21:11:00Z"),
    ("às 8:00 do dia 23/10/2025", "2025-10-23T07:00:00Z"),
    ("21-jun-2026 18:55", "2026-06-21T17:55:00Z"),
    ("18 ago. 2026, 17h59", "2026-08-18T16:59:00Z"),
    ("24-07-2026 12:17 AM", "2026-07-23T23:17:00Z"),
    ("24-07-2026 12:17 p.m.", "2026-07-24T11:17:00Z"),
    ("15/10/25 08:32:20", "2025-10-15T07:32:20Z"),
    ("1757161535", "2025-09-06T12:25:35Z"),
    ("1775742150434", "2026-04-09T13:42:30Z"),
    ("20260106T111842Z", "2026-01-06T11:18:42Z"),
    ("20251007093708", "2025-10-07T08:37:08Z"),
    ("14/04/2026 18:34:06 WEST", "2026-04-14T17:34:06Z"),
    ("2026-07-17 09:22:47 AZOST", "2026-07-17T09:22:47Z"),
    ("2026-02-01T11:04:35 Europe/Madrid", "2026-02-01T10:04:35Z"),
    ("2026-10-15 21:59:22[Atlantic/Azores]", "2026-10-15T21:59:22Z"),
    ("31/08/2026 11:45 (hora dos Açores)", "2026-08-31T11:45:00Z"),
    ("2026-02-11T08:03:27-03:30", "2026-02-11T11:33:27Z"),
    ("  04/08/2026 15:58 ", "2026-08-04T14:58:00Z"),
    # skipped and repeated wall clocks, impossible and incomplete values
    ("2026-03-29T01:20:00", None),
    ("2025-10-26T01:38:23", None),
    ("2025-10-26T01:38:23Z", "2025-10-26T01:38:23Z"),
    ("2026-02-30T10:00:00", None),
    ("2026-13-05 11:20:00", None),
    ("2026-03-30 T25:10:00", None),
    ("2026-05-05T10:00:60", None),
    ("13:75", None),
    ("2026-07-09", None),
    ("16 de abril às 15h", None),
    ("segunda às 15h", None),
    ("de manhã, dia 21/7/2026", None),
    ("s/d", None),
    ("", None),
    (None, None),
    ("2026-05-05 10:00 Mars/Base", None),
    ("2026-05-05 10:00+99:00", None),
    ("x" * 100_000, None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    got = {r["i"]: r["utc"] for r in with_utc(df, "v", "utc").collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][1]} == {}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        test_notations(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_instants_are_distinct_and_ignore_other_columns(spark):
    rows = [(1, "2026-01-05T10:20:30", None, "a"), (1, "2026-01-05T10:20:30", None, "a"), (2, None, "2026-05-18T16:15Z", "b")]
    df = spark.createDataFrame(rows, "id bigint, sent_datetime string, time_expression string, utc string")
    got = sorted(map(tuple, instants(df, "id", ["sent_datetime", "time_expression"]).collect()))
    assert got == [(1, "sent_datetime", "2026-01-05T10:20:30Z"), (2, "time_expression", "2026-05-18T16:15:00Z")]
    assert instants(df.limit(0), "id", ["sent_datetime"]).collect() == []


def test_zone_estimate(spark):
    # written on Madrid clocks, ingested five minutes later
    rows = [(f"2026-{m:02d}-11T12:00:00", f"2026-{m:02d}-11T{11 if m in (1, 2) else 10}:05:00Z") for m in (1, 2, 6, 7)]
    df = spark.createDataFrame(rows, "sent string, at string").selectExpr("sent", "cast(at as timestamp) as at")
    got = zone_violations(df, "sent", "at", ["Europe/Lisbon", "Europe/Madrid", "UTC"]).where("chosen").collect()
    assert [(r["zone"], r["violations"]) for r in got] == [("Europe/Madrid", 0)]


def test_values_of_digits(spark):
    """Seconds of 9 to 11 digits, milliseconds of 12 and 13, compact dates of 12 and 14; eight digits are a day without a clock."""
    want = {
        "999999999": "2001-09-09T01:46:39Z", "1709377900": "2024-03-02T11:11:40Z", "10000000000": "2286-11-20T17:46:40Z", "1711840873965": "2024-03-30T23:21:13Z", "946684800000": "2000-01-01T00:00:00Z",
        "202603011530": "2026-03-01T15:30:00Z", "20260301153045": "2026-03-01T15:30:45Z", "202699011530": "1976-06-04T01:16:51Z", "20260301": None, "20269901153045": None,
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "id bigint, v string")
    got = {r["id"]: r["utc"] for r in instants(df, "id", ["v"]).collect()}
    assert {v: got.get(i) for i, v in enumerate(want)} == want
