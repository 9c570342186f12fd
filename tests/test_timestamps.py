"""Mixed timestamps against hand-made cases, a brute force over zones, and clashing columns."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sheafline.operators import timestamps as T
from sheafline.operators.timestamps import find_dates, normalise_timestamps

DAY = {
    "17/04/2023": "2023-04-17", "19/122024": "2024-12-19", "04/13/2025": "2025-04-13", "2023-09-23": "2023-09-23", "23 APR 25": "2025-04-23", "Wednesday 17 August 2022": "2022-08-17", "February 24, 2025": "2025-02-24",
    "Mon, 10th Jan '22": "2022-01-10", "5th of August, 2024": "2024-08-05", ": 28 / 12 / 2022": "2022-12-28", "20230910": "2023-09-10", "06-Jun-2024": "2024-06-06", "06.04.2023": "2023-04-06", "9/10/22": "2022-10-09",
}
INSTANT = {
    "Sun, 26 Mar 2023 00:27:47 +0000": "2023-03-26T00:27:47.000000Z", "1735518056": "2024-12-30T00:20:56.000000Z", "1749811020576": "2025-06-13T10:37:00.576000Z", "2025-06-04T20:14+01:00": "2025-06-04T19:14:00.000000Z",
    "2023-04-17T20:29+05:45": "2023-04-17T14:44:00.000000Z", "2025-12-02T04:21:37.435852838+0530": "2025-12-01T22:51:37.435852Z", "05/08/2023 23:05:29 BST": "2023-08-05T22:05:29.000000Z", "16:32:06 on 16/10/2022": "2022-10-16T15:32:06.000000Z",
    "30/05/2025 8:03pm CEST": "2025-05-30T18:03:00.000000Z", "12/01/2026 1415hrs": "2026-01-12T14:15:00.000000Z", "2025-04-25 12:09:23 America/New_York": "2025-04-25T16:09:23.000000Z", "18/02/2024 Time: 01:30:52": "2024-02-18T01:30:52.000000Z",
    "13/03/2025 8:36 AM": "2025-03-13T08:36:00.000000Z", "12.29 am on 26/08/2025": "2025-08-25T23:29:00.000000Z", "Wed, 31 Jan 2024 15:30:00 +0000 (UTC)": "2024-01-31T15:30:00.000000Z", "2023-10-18 22:27Z": "2023-10-18T22:27:00.000000Z",
    "2024-08-01 19:50:09 [Europe/London]": "2024-08-01T18:50:09.000000Z",
}
NONE = [
    None, "", "   ", "yesterday", "TBC", "see attached", "00/00/0000", "2025-13-40", "31 September 2024", "30-02-2024", "between 3 and 5 June 2025", "??/07/2025", "May 2025", "week commencing 14/10", "x" * 50_000,
    "26/10/2025 Time: 01:56:06", "30/03/2025 01:30", "17/04/2023 25:00", "17/04/2023 13:61", "12345", "17/04/2023 10:00 XYZ", "2024-01-01 10:00 Nowhere/Atlantis",
]


@pytest.fixture(scope="module")
def results(spark):
    texts = [*DAY, *INSTANT, *NONE]
    df = spark.createDataFrame([(t, "Europe/London") for t in texts], "t string, z string")
    return {r["t"]: r["normal_form"] for r in normalise_timestamps(df, "t", "z").collect()}


def test_days_and_instants(results):
    assert {k: results[k] for k in DAY} == DAY
    assert {k: results[k] for k in INSTANT} == INSTANT


def test_no_cases(results):
    assert {k for k in NONE if results[k] is not None} == set()


def test_against_brute_force_over_zones(spark):
    zones = ["Europe/London", "Europe/Paris", "America/New_York", "Asia/Karachi", "Australia/Lord_Howe", "Asia/Kathmandu"]
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7.25 * k), z) for k in range(0, 1210, 3) for z in zones]
    rows += [(dt.datetime(2024, m, d, h, mi), z) for m, d in ((3, 10), (3, 31), (4, 7), (10, 6), (10, 27), (11, 3)) for h in range(4) for mi in (0, 15, 45) for z in zones]
    df = spark.createDataFrame([(t.strftime("%d/%m/%Y %H:%M"), z) for t, z in rows], "t string, z string")
    got = {(r["t"], r["z"]): r["normal_form"] for r in normalise_timestamps(df, "t", "z").collect()}
    for t, z in rows:
        utc = {t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(dt.UTC) for f in (0, 1)}
        real = {u for u in utc if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == t}
        want = next(iter(real)).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(real) == 1 else None
        assert got[(t.strftime("%d/%m/%Y %H:%M"), z)] == want, (t, z)


def test_alignment(spark):
    u = dt.datetime(2024, 10, 27, 0, 30, 10)
    rows = [("27/10/2024 01:30", "Europe/London", u, None), ("27/10/2024 01:30", "Europe/London", None, dt.datetime(2024, 10, 27, 1, 0)), ("27/10/2024 01:30", "Europe/London", None, None), ("01/07/2024 14:15:09", None, dt.datetime(2024, 7, 1, 8, 30, 9), None)]
    df = spark.createDataFrame(rows, "t string, z string, s timestamp, a timestamp")
    got = [(r["normal_form"], r["zone_from"]) for r in normalise_timestamps(df, "t", "z", "s", "a", estimate_missing=True).collect()]
    assert got == [("2024-10-27T00:30:00.000000Z", "aligned"), ("2024-10-27T00:30:00.000000Z", "aligned"), (None, None), ("2024-07-01T08:30:09.000000Z", "estimated")]


def test_tables_with_repeats_nulls_and_clashing_columns(spark):
    fe = spark.createDataFrame([(1, 10, "incident_date", "01/02/2024 10:00", "x"), (1, 10, "incident_date", "01/02/2024 10:00", "x"), (2, 10, "vrm", "01/02/2024", "x"), (3, None, "inspection_date", "1 May 2024", "x"), (4, 10, "incident_date", None, "x")], "record_id long, model_id long, field_key string, raw_value string, normal_form string")
    fx = spark.createDataFrame([(9, 10, {"incident_date": "5/6/24"}), (8, 11, {"vrm": "x"}), (7, 11, None)], "record_id long, model_id long, expected_values map<string,string>")
    m = spark.createDataFrame([(10, "Europe/Paris", dt.datetime(2024, 3, 1), None), (10, "Europe/Paris", dt.datetime(2024, 3, 1), None)], "model_id long, tz_name string, imported_at timestamp, metadata map<string,string>")
    got = {(r["record_id"], r["normal_form"]) for r in find_dates(fe, fx, m).collect()}
    assert got == {(1, "2024-02-01T09:00:00.000000Z"), (3, "2024-05-01"), (9, "2024-06-05")}
    assert find_dates(fe.limit(0), fx.limit(0), m.limit(0)).count() == 0
    assert find_dates(fe, fx, m).groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").count() == 0


def test_zones_by_offset_history(spark):
    """The history with the fewest violations is the group's zone, changes of clock included; a group that does not tell gets none."""
    import datetime as dt
    from zoneinfo import ZoneInfo

    zones = ("Europe/London", "Europe/Madrid", "America/New_York", "Asia/Kolkata")
    rows = []
    for g, z in (("a", "Europe/Madrid"), ("b", "America/New_York"), ("c", "Asia/Kolkata")):
        for i in range(40):
            u = dt.datetime(2024, 1, 3, 5, 0, tzinfo=dt.UTC) + dt.timedelta(days=9 * i, hours=i % 7)
            late = i % 10 == 9  # some are sent much later
            rows.append((g, u.astimezone(ZoneInfo(z)).strftime("%d/%m/%Y %H:%M"), i, u.replace(tzinfo=None) + dt.timedelta(hours=30 * late), u.replace(tzinfo=None) + dt.timedelta(days=2)))
    rows += [("d", "01/02/2024 10:00", 1, None, None), (None, "01/02/2024 10:00", 1, None, None), ("a", None, 2, None, None), ("a", "01/02/2024", 3, None, None), ("a", "01/02/2024 10:00 GMT", 4, None, None)]
    df = spark.createDataFrame(rows, "g string, t string, n long, sent timestamp, arrived timestamp")
    got = {r["g"]: r for r in T.estimate_zones(df, "g", "t", order="n", sent="sent", arrived="arrived", zones=zones).collect()}
    assert {g: r["zone"] for g, r in got.items()} == {"a": "Europe/Madrid", "b": "America/New_York", "c": "Asia/Kolkata", "d": None}
    assert got["a"]["times"] == 40 and got["a"]["violations"] < 10 <= got["a"]["next_violations"]
    by_order = {r["g"]: r["zone"] for r in T.estimate_zones(df.where("g <> 'd'"), "g", "t", sent="sent", zones=zones[1:2]).collect()}
    assert by_order["a"] == "Europe/Madrid"
    assert T.estimate_zones(df.limit(0), "g", "t", zones=zones).count() == 0


def _tables(spark, docs):
    """docs: model_id, sender, zone, sent, arrived, {field: spelling}."""
    fe = spark.createDataFrame([(10 * i + k, i, f, t) for i, *_, dates in docs for k, (f, t) in enumerate(dates.items())], "record_id long, model_id long, field_key string, raw_value string")
    fx = spark.createDataFrame([], "record_id long, model_id long, expected_values map<string,string>")
    m = spark.createDataFrame([(i, p, z, a, {"sent": s and s.isoformat(), "from_address": p if "@" in p else None}) for i, p, z, s, a, _ in docs], "model_id long, provider_id string, tz_name string, imported_at timestamp, metadata map<string,string>")
    return fe, fx, m


def _utc(text, zone, fold=0):
    return dt.datetime.strptime(text, "%d/%m/%Y %H:%M").replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def test_dates_without_zone_by_the_histories_of_their_sender(spark):
    """Times that no sending time places are read by the histories that their sender's times leave; where these disagree there is no result."""
    docs, want = [], {}
    other = ("01/07/2024 14:15", "15/01/2024 10:00")
    senders = [("ny@x.test", ["America/New_York"], True), ("KA@x.test", ["Asia/Kathmandu"], True), ("mixed@x.test", ["Europe/London", "Asia/Karachi"], True), ("late@x.test", ["America/New_York"], False)]
    for g, (sender, zones, sent) in enumerate(senders):
        for j in range(24):
            u = dt.datetime(2024, 1, 3, 5, 0, tzinfo=dt.UTC) + dt.timedelta(days=15 * j, hours=j % 7)
            zone, i, t = zones[j % len(zones)], 100 * g + j, other[j % 2]
            at = u.replace(tzinfo=None) + dt.timedelta(hours=30 * (j == 5))  # one is sent much later than it says
            own = u.astimezone(ZoneInfo(zone)).strftime("%d/%m/%Y %H:%M")
            docs.append((i, sender.upper() if j % 3 else sender, None if j % 4 else "Nowhere/Atlantis", at if sent else None, at + dt.timedelta(hours=40), {"instruction_date": own, "incident_date": t, "inspection_date": "3 May 2024"}))
            want[10 * i + 2] = "2024-05-03"
            if sent and j != 5 or len(zones) == 1 and sent:
                want[10 * i] = _utc(own, zone)
            if sent and len(zones) == 1:
                want[10 * i + 1] = _utc(t, zone)
    for i in [i for i in want if i % 10 == 1]:  # no event after the arrival of its document
        arrived = next(d[4] for d in docs if d[0] == i // 10)
        if want[i] > arrived.strftime("%Y-%m-%dT%H:%M:%S.%fZ"):
            del want[i]
    tables = _tables(spark, docs)
    assert {r["record_id"]: r["normal_form"] for r in find_dates(*tables, estimate_missing=True).collect()} == want
    assert {r["record_id"] for r in find_dates(*tables).collect()} == {i for i in want if i % 10 == 2}  # nothing is estimated unless asked for


def test_doubled_hours_by_the_order_of_the_sender(spark):
    """The place at which the clock went back is found from an order that is kept; an order that is not kept, and the dates of other events, tell nothing."""
    docs, want, start = [], {}, dt.datetime(2024, 10, 26, 14, 0, tzinfo=dt.UTC)
    for g, lag in enumerate((lambda j: 300, lambda j: 20 + 97 * (7 * j % 10) % 600)):
        for j in range(60):
            u = start + dt.timedelta(minutes=20 * j + 7 * (j % 2))
            local, i = u.astimezone(ZoneInfo("Europe/London")), 100 * g + j
            text = local.strftime("%d/%m/%Y %H:%M")
            docs.append((i, f"s{g}", "Europe/London", None, (u + dt.timedelta(minutes=lag(j) if g else 300)).replace(tzinfo=None), {"instruction_date": text, "incident_date": "27/10/2024 01:30"}))
            if not (twice := _utc(text, "Europe/London") != _utc(text, "Europe/London", 1)) or not g:
                want[10 * i] = _utc(text, "Europe/London", local.fold)
    assert sum(x.startswith("2024-10-27T0") for x in want.values()) > 40
    got = {r["record_id"]: r["normal_form"] for r in find_dates(*_tables(spark, docs)).collect()}
    assert {i: x for i, x in got.items() if i % 10 == 0 and i < 1000} == {i: x for i, x in want.items() if i < 1000}
    assert all(want.get(i, x) == x for i, x in got.items())
    # of other events, and out of order, only what arrival tells is placed
    late = {10 * d[0] + 1 for d in docs if d[4] >= dt.datetime(2024, 10, 27, 1, 30) or d[4] < dt.datetime(2024, 10, 27, 0, 30)}
    assert not late & set(got)
