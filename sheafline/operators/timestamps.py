"""Mixed timestamp spellings and zones to one unambiguous form (problem 1).

Everything is a Column expression: no Python runs per row. What is shuffled: the join with the documents' zones, the documents' own
times in the order of their senders, and the removal of repeated rows.

Missing zones are estimated by group (a sender, a device, a source): every zone that may be meant is an offset history, and the one is
chosen whose instants violate least what is known of the order of things, the sending and arrival times of the documents and
their order (``estimate_zones``). ``find_dates`` reads a time without a zone by all histories of its sender that are not clearly
worse than the best (``zone_histories``), and takes the instant on which they agree. An hour that a zone had twice has as many histories as
there are places in the sender's order at which the clock may have gone back (``_by_order``).

Defined results: null, empty and blank texts, texts that name no full day, an
impossible day, more than one day or a relative day give no row; a text that
stands in several rows of one record gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafline.functions.binding import Env, let
from sheafline.session import cut

#: Month names by their first three letters, and the offsets in minutes of zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "pkt": 300, "npt": 345, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "sgt": 480, "hkt": 480, "jst": 540, "aest": 600, "aedt": 660,
}
#: Of no fixed meaning: Irish, Indian or Israeli time; the zone of the document decides.
LOCAL_ABBREVIATIONS = {
    "ist": {"Europe/Dublin": 60, "Asia/Kolkata": 330, "Asia/Calcutta": 330, "Asia/Jerusalem": 120},
}

_MON = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b[,.]? ?)?"
#: Each shape of a day with its groups of year, month and day; "dm" means numbers in doubtful order.
_DAYS: tuple[tuple[str, tuple[int, int, int], str], ...] = (
    (r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])", (1, 3, 4), "n"),
    (r"([0-9]{1,2}) ?([-/.]) ?([0-9]{1,2}) ?\2 ?((?:[0-9]{2})?[0-9]{2})(?![0-9])", (4, 3, 1), "dm"),
    (r"([0-9]{1,2})([-/.])([0-9]{2})((?:19|20)[0-9]{2})(?![0-9])", (4, 3, 1), "dm"),
    (r"((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])", (1, 2, 3), "n"),
    (rf"([0-9]{{1,2}})(?:st|nd|rd|th)?(?: of)?[- .]{{0,2}}({_MON})[-,. ]{{0,2}}'?((?:[0-9]{{2}})?[0-9]{{2}})(?![0-9])", (3, 2, 1), "w"),
    (rf"({_MON})\.? ?([0-9]{{1,2}})(?:st|nd|rd|th)?,? ?'?([0-9]{{4}})(?![0-9])", (3, 1, 2), "w"),
)
_TIME = r"([0-9]{1,2})(?:[:.]([0-9]{2})(?:[:.]([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)? ?([ap]\.?m\.?(?![a-z]))?"
_HHMM = r"([0-9]{2})([0-9]{2}) ?(?:hrs?|hours|h)\b"
_ZONE = r"(?: ?\[?([a-z]+(?:/[a-z_+-]+)+)\]?| ?([+-][0-9]{2}:?(?:[0-9]{2})?)(?: ?\(?(?!on\b)([a-z]{1,5})\)?)?| ?\(?(?!on\b|at\b)([a-z]{1,5})\)?)?"
_GAP = r"(?:t|[ ,]+(?:at |@ ?|time:? ?)?)"


def _g(text: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def _day_of(y: Column, m: Column, d: Column) -> Column:
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _month(word: Column) -> Column:
    short = F.substring(word, 1, 3)
    return reduce(lambda c, m: c.when(short == m[1], F.lit(f"{m[0]:02d}")), enumerate(MONTHS[1:], 2), F.when(short == MONTHS[0], F.lit("01")))


_START = r"(?<![0-9a-z+.:/])"
_AFTER, _BEFORE = f"^§{_GAP}{_TIME}{_ZONE}$", f"^{_TIME}{_ZONE} ?(?:on|,)? ?§$"
_HHMM_AFTER, _HHMM_BEFORE = f"^§{_GAP}{_HHMM}{_ZONE}$", f"^{_HHMM}{_ZONE} ?(?:on|,)? ?§$"


def _clean(e: Env) -> Env:
    text = F.regexp_replace(F.regexp_replace(F.lower(e["text"]), "[\\s\u00a0\u2007\u202f]+", " "), "[\u2018\u2019\u02bc`]", "'")
    return {"t": F.trim(F.btrim(text, F.lit(" :;,.|-\u2013")))}


def _kind(e: Env) -> Env:
    kinds = reduce(lambda c, k: c.when(e["t"].rlike(_START + _DAYS[k][0]), k), range(1, len(_DAYS)), F.when(e["t"].rlike(_START + _DAYS[0][0]), 0))
    epoch = F.when(e["t"].rlike("^[0-9]{10}$"), e["t"].try_cast("bigint") * 1_000_000).when(e["t"].rlike("^[0-9]{13}$"), e["t"].try_cast("bigint") * 1_000)
    return {"kind": kinds, "epoch": epoch}


def _day_and_rest(e: Env) -> Env:
    day, rest = F.when(F.lit(False), F.lit(None).cast("date")), F.when(F.lit(False), F.lit(None).cast("string"))
    for k, (pattern, (y, m, d), order) in enumerate(_DAYS):
        year, first, second = (_g(e["t"], _START + pattern, i) for i in (y, m, d))
        got = _day_of(year, _month(first) if order == "w" else first, second)
        if order == "dm":  # day first unless only month first gives a day
            got = F.coalesce(got, _day_of(year, second, first))
        day = day.when(e["kind"] == k, got)
        rest = rest.when(e["kind"] == k, F.trim(F.regexp_replace(e["t"], _START + _WEEKDAY + pattern, "§")))
    return {"day": day, "rest": rest}


def _form(e: Env) -> Env:
    r = e["rest"]
    return {"form": F.when(r == "§", 0).when(r.rlike(_HHMM_AFTER), 3).when(r.rlike(_HHMM_BEFORE), 4).when(r.rlike(_AFTER), 1).when(r.rlike(_BEFORE), 2)}


def _parts(e: Env) -> Env:
    def part(of_time: int | None, of_hhmm: int | None) -> Column:
        c = F.when(F.lit(False), F.lit(None).cast("string"))
        for f, p, g in ((1, _AFTER, of_time), (2, _BEFORE, of_time), (3, _HHMM_AFTER, of_hhmm), (4, _HHMM_BEFORE, of_hhmm)):
            if g is not None:
                c = c.when(e["form"] == f, _g(e["rest"], p, g))
        return c

    offset = part(7, 4)
    return {
        "h": part(1, 1).try_cast("int"), "m": part(2, 2).try_cast("int"), "s": F.coalesce(part(3, None).try_cast("int"), F.lit(0)),
        "f": F.rpad(F.substring(F.coalesce(part(4, None), F.lit("0")), 1, 6), 6, "0").try_cast("bigint"),
        "ap": F.substring(part(5, None), 1, 1), "named": part(6, 3), "offset": offset, "abbr": F.coalesce(part(9, 6), F.when(offset.isNull(), part(8, 5))),
    }


def _numbers(e: Env) -> Env:
    hour = F.when(e["ap"].isNull(), e["h"]).when(~e["h"].between(1, 12), F.lit(None)).otherwise(e["h"] % 12 + F.when(e["ap"] == "p", 12).otherwise(0))
    minute = F.coalesce(e["m"], F.when(e["ap"].isNotNull(), 0))
    digits = F.regexp_replace(e["offset"], "[^0-9]", "")
    off = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))) * F.when(e["offset"].startswith("-"), -1).otherwise(1)
    us = F.when((hour < 24) & (minute < 60) & (e["s"] < 60), ((hour * 60 + minute) * 60 + e["s"]).cast("bigint") * 1_000_000 + e["f"])
    return {"us": us, "off": off, "timed": e["form"] > 0}


def _utc(local: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def _local(utc: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))


def iso_utc(us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of microseconds since 1970, whatever the session's zone."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    rest = F.pmod(us, F.lit(86_400_000_000))
    sec = F.floor(rest / F.lit(1_000_000))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60), F.lit("."),
        F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"),
    )


def known_zone(zone: Column, zones: tuple[str, ...]) -> Column:
    """``zone`` in its canonical spelling if this Spark knows it, else null (ANSI mode would fail on an unknown zone)."""
    return F.element_at(F.create_map(*(F.lit(x) for z in zones for x in (z.lower(), z))), F.lower(zone))


def zone_names(df: DataFrame) -> tuple[str, ...]:
    """The zones this session's Java knows by name; about 600, fixed."""
    ids = df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return tuple(sorted(z for z in ids if not z.startswith("SystemV")))


def zone_rules(df: DataFrame) -> tuple[str, ...]:
    """One name for each offset history that this session's Java knows."""
    jvm = df.sparkSession._jvm
    first = jvm.java.util.HashMap()
    return tuple(z for z in zone_names(df) if first.putIfAbsent(jvm.java.time.ZoneId.of(z).getRules(), z) is None)


#: Numbers of documents whose order is looked at together.
ORDER_RANGE = 10_000
#: A step back of more than this against the order of documents is a violation.
STEP_BACK_S = 3_600
#: The order of a sender's documents speaks on doubled hours if it tells known times from those an hour off: so many rightly, and so many for each wrongly.
ORDERLY = 20


def local_times(df: DataFrame, text: str) -> DataFrame:
    """``df`` with local_us: the time that a text names without saying in which zone, in microseconds on the clock; null for all other texts."""
    clock = lambda e: {"local": F.when(e["timed"] & e["off"].isNull() & e["abbr"].isNull() & e["named"].isNull() & e["epoch"].isNull(), F.unix_date(e["day"]).cast("bigint") * 86_400_000_000 + e["us"])}
    got = let([_clean, _kind, _day_and_rest, _form, _parts, _numbers, clock], {"text": F.col(text)})
    return df.withColumn("_clock", got).withColumn("local_us", F.col("_clock.local")).drop("_clock")


def estimate_zones(df: DataFrame, group: str, text: str, order: str | None = None, sent: str | None = None, arrived: str | None = None, zones: tuple[str, ...] = (), tolerance_s: int = 60, sure: float = 2.0) -> DataFrame:
    """group, zone, times, violations, next_violations: for each group the zone whose offset history is violated least, null where the next best is not ``sure`` times worse (of zones that give the same instants the first by name).

    zones: the histories in question, a fixed list. Only local times without a stated zone speak. A time violates a history if it then
    falls after ``arrived``, more than ``tolerance_s`` from ``sent``, in an hour that the zone skipped, or, in the order of ``order``
    within the group, more than ``STEP_BACK_S`` before the time that precedes it. Violations are summed by group and zone
    before they move; no group is held in one task but for the order, which is looked at in ranges of neighbours.
    """
    sums = _violations(df, group, text, order, sent, arrived, zones, tolerance_s)
    best = sums.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("violations", "zone", "times", "same"))).alias("s"))  # as many entries as there are zones
    first = F.get("s", F.lit(0))
    second = F.get(F.filter("s", lambda x: x["same"] != F.get("s", F.lit(0))["same"]), F.lit(0))
    clear = second.isNull() | (second["violations"] >= F.greatest(first["violations"] * sure, first["violations"] + 1))
    return best.select(F.col("_g").alias(group), F.when(clear, first["zone"]).alias("zone"), first["times"].alias("times"), first["violations"].alias("violations"), second["violations"].alias("next_violations"))


def zone_histories(df: DataFrame, group: str, text: str, order: str | None = None, sent: str | None = None, arrived: str | None = None, zones: tuple[str, ...] = (), tolerance_s: int = 60, sure: float = 2.0) -> DataFrame:
    """group, histories: for each group the zones that ``estimate_zones`` leaves in question, the best and all that are not ``sure`` times worse."""
    sums = _violations(df, group, text, order, sent, arrived, zones, tolerance_s)
    each = sums.groupBy("_g").agg(F.collect_list(F.struct("violations", "zone")).alias("s"), F.min("violations").alias("least"))  # as many entries as there are zones
    left = F.filter("s", lambda x: x["violations"] < F.greatest(F.col("least") * sure, F.col("least") + 1))
    return each.select(F.col("_g").alias(group), F.transform(left, lambda x: x["zone"]).alias("histories"))


def _violations(df: DataFrame, group: str, text: str, order: str | None, sent: str | None, arrived: str | None, zones: tuple[str, ...], tolerance_s: int) -> DataFrame:
    """_g, zone, times, violations, same: the violations of each group's times by each zone, summed; ``same`` is equal for zones that give the group the same instants."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c else F.lit(None).cast("bigint")
    rows = local_times(df.where(F.col(group).isNotNull() & F.col(text).isNotNull()), text).where(F.col("local_us").isNotNull())
    rows = rows.select(F.col(group).alias("_g"), "local_us", us(sent).alias("_sent"), us(arrived).alias("_arrived"), (F.col(order) if order else F.lit(0)).alias("_order"))
    each = rows.withColumn("zone", F.explode(F.array(*(F.lit(z) for z in zones)))).withColumn("_u", _utc(F.col("local_us"), F.col("zone")))
    late = F.coalesce(F.col("_u") > F.col("_arrived"), F.lit(False))
    far = F.coalesce(F.abs(F.col("_u") - F.col("_sent")) > tolerance_s * 1_000_000, F.lit(False))
    skipped = _local(F.col("_u"), F.col("zone")) != F.col("local_us")
    each = each.withColumn("_bad", late.cast("int") + far.cast("int") + skipped.cast("int"))
    if order:
        # neighbours within ranges of the order, so that a group of any size is spread
        span = F.floor(F.col("_order") / F.lit(ORDER_RANGE))
        before = F.lag("_u").over(Window.partitionBy("_g", "zone", span).orderBy("_order", "local_us"))
        each = each.withColumn("_bad", F.col("_bad") + F.coalesce(F.col("_u") < before - STEP_BACK_S * 1_000_000, F.lit(False)).cast("int"))
    # zones that give a group the same instants are one history
    return each.groupBy("_g", "zone").agg(F.count("*").alias("times"), F.sum("_bad").alias("violations"), F.bit_xor(F.xxhash64("_u", "_order", "local_us")).alias("same"))


def normalise_timestamps(df: DataFrame, text: str, zone: str, sent: str | None = None, arrived: str | None = None, tolerance_s: int = 60, estimate_missing: bool = False) -> DataFrame:
    """Adds ``normal_form`` (null: no day or instant named) and ``zone_from`` (day, epoch, stated, document, aligned, estimated).

    text: the column of spellings; zone: the column with the zone of the document, null if unknown.
    sent, arrived: timestamps in UTC that the event cannot follow, the first one exact for the document's own date.
    A local time that occurred twice, or (with ``estimate_missing``) one without a zone, is placed by alignment: of
    the offset histories in question those are kept that put the time within ``tolerance_s`` of ``sent``, else those
    that do not put it after ``arrived``; if the remaining ones agree on one instant, that is the result, else none.
    """
    got = _normal(df, text, zone, sent, arrived, tolerance_s, estimate_missing)
    return df.withColumn("_normal", got).withColumns({c: F.col(f"_normal.{c}") for c in ("normal_form", "zone_from")}).drop("_normal")


def _normal(df: DataFrame, text: str, zone: str, sent: str | None, arrived: str | None, tolerance_s: int = 60, estimate_missing: bool = False, histories: str | None = None) -> Column:
    """A struct, in it the columns of ``normalise_timestamps``, ``instant``, ``local`` (on the clock), ``z`` (the zone that rules) and ``left``, the instants in question of a doubled time.

    histories: the column with the zones in question for a time without any, which is placed by its own sending time first.
    """
    zones = zone_names(df)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c else F.lit(None).cast("bigint")
    shifts = [s * 60_000_000 for s in (-120, -60, -30, 30, 60, 120)]

    def zoned(e: Env) -> Env:
        fixed = reduce(lambda c, a: c.when(e["abbr"] == a[0], a[1]), list(ABBREVIATIONS.items())[1:], F.when(e["abbr"] == "z", 0))
        for abbr, by in LOCAL_ABBREVIATIONS.items():
            for z, minutes in by.items():
                fixed = fixed.when((e["abbr"] == abbr) & (e["zone"] == z), minutes)
        return {
            "local": F.unix_date(e["day"]).cast("bigint") * 86_400_000_000 + e["us"], "o": F.coalesce(e["off"], fixed),
            "z": F.when(e["named"].isNotNull(), known_zone(e["named"], zones)).otherwise(known_zone(e["zone"], zones)),
        }

    def placed(e: Env) -> Env:
        strange = (e["abbr"].isNotNull() & e["o"].isNull()) | (e["named"].isNotNull() & e["z"].isNull())
        return {"u": F.when(e["o"].isNull() & e["z"].isNotNull(), _utc(e["local"], e["z"])), "timed": e["timed"] & e["us"].isNotNull() & ~strange}

    def checked(e: Env) -> Env:
        twice = F.filter(F.array(*(e["u"] + s for s in shifts)), lambda u: _local(u, e["z"]) == e["local"])
        return {"real": _local(e["u"], e["z"]) == e["local"], "twice": F.when(e["u"].isNotNull(), twice)}

    def aligned(e: Env, candidates: Column) -> Column:
        near = F.filter(candidates, lambda u: F.abs(u - e["sent"]) <= tolerance_s * 1_000_000)
        early = F.filter(candidates, lambda u: u <= F.coalesce(e["arrived"], u))
        return F.array_distinct(F.when(F.size(near) > 0, near).otherwise(early))

    def narrowed(e: Env) -> Env:
        return {"left": F.when(e["timed"] & e["o"].isNull() & e["epoch"].isNull() & e["real"] & (F.size(e["twice"]) > 0), aligned(e, F.concat(F.array(e["u"]), e["twice"])))}

    def resolved(e: Env) -> Env:
        only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
        once = F.size(e["twice"]) == 0
        instant = (
            F.when(e["epoch"].isNotNull(), e["epoch"])
            .when(e["timed"] & e["o"].isNotNull(), e["local"] - e["o"].cast("bigint") * 60_000_000)
            .when(e["timed"] & e["real"] & once, e["u"])
            .when(e["timed"] & e["real"], only(e["left"]))
        )
        source = (
            F.when(e["epoch"].isNotNull(), F.lit("epoch")).when(e["form"] == 0, F.lit("day")).when(e["o"].isNotNull() | e["named"].isNotNull(), F.lit("stated"))
            .when(once, F.lit("document")).when(e["z"].isNotNull(), F.lit("aligned"))
        )
        if estimate_missing:
            # every whole quarter hour that some zone uses is a candidate history; the alignment leaves one instant or none
            quarters = F.transform(F.sequence(F.lit(-48), F.lit(56)), lambda q: e["local"] - q.cast("bigint") * 900_000_000)
            near = F.filter(quarters, lambda u: F.abs(u - e["sent"]) <= tolerance_s * 1_000_000)
            instant = instant.when(e["timed"] & e["z"].isNull() & (F.size(near) == 1), F.get(near, F.lit(0)))
            if histories:
                read = lambda z: F.filter(F.transform(F.array(*(F.lit(s) for s in (0, *shifts))), lambda s: _utc(e["local"], z) + s), lambda u: _local(u, z) == e["local"])
                instant = instant.when(e["timed"] & e["z"].isNull(), only(aligned(e, F.flatten(F.transform(e["histories"], read)))))
            source = source.when(e["z"].isNull(), F.lit("estimated"))
        return {"instant": instant, "source": source}

    def worded(e: Env) -> Env:
        form = F.when(e["instant"].isNotNull(), iso_utc(e["instant"])).when((e["form"] == 0) & e["day"].isNotNull(), e["day"].cast("string"))
        return {"normal_form": form, "zone_from": F.when(form.isNotNull(), e["source"])}

    env = {"text": F.col(text), "zone": F.col(zone), "sent": us(sent), "arrived": us(arrived)} | ({"histories": F.col(histories)} if histories else {})
    return let([_clean, _kind, _day_and_rest, _form, _parts, _numbers, zoned, placed, checked, narrowed, resolved, worded], env)


def _by_order(rows: DataFrame) -> DataFrame:
    """``rows`` with those times placed that stand in an hour that the zone had twice, where the order of the sender's documents tells which it was.

    rows: sender, z, arrived and id give the order, instant the times that are known, left the two instants in question of the others.
    A history is a place in the order at which the clock went back: the times before it are of the first pass, the others of the second. Steps back
    violate it, within the hour and against the nearest known times; those with the fewest violations are kept, and a time that
    all of them read alike is placed. An order that does not tell the sender's known times from those an hour off (``ORDERLY``) is no evidence.
    """
    by, hour = ["arrived", "id", "local"], 3_600_000_000
    order = Window.partitionBy("sender").orderBy(*by)
    number = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    bad = lambda u: number(u < F.col("_before")) + number(F.col("_after") < u)
    known, shifted = bad(F.col("instant")), [bad(F.col("instant") + s) for s in (-hour, hour)]
    told = {"_right": sum((number(x > known) for x in shifted), F.lit(0)), "_wrong": sum((number(x < known) for x in shifted), F.lit(0))}
    seen = rows.withColumns({"_before": F.expr("lag(instant) ignore nulls").over(order), "_after": F.expr("lead(instant) ignore nulls").over(order)})
    seen = seen.withColumns({c: F.sum(v).over(Window.partitionBy("sender")) for c, v in told.items()})
    orderly = F.col("_right") >= F.greatest(F.lit(ORDERLY), F.col("_wrong") * ORDERLY)
    doubled = seen.where(F.col("instant").isNull()).withColumns({"_first": F.array_min("left"), "_second": F.array_max("left"), "_day": F.floor(F.col("local") / F.lit(24 * hour))})
    night = Window.partitionBy("sender", "z", "_day")
    on, back = night.orderBy(*by), night.orderBy(*(F.desc(c) for c in by))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    cost = (
        doubled.withColumn("_step", number(F.col("local") < F.lag("local").over(on)))
        .withColumn("_as_first", F.sum(bad(F.col("_first")) + F.col("_step")).over(on.rowsBetween(*so_far)))  # up to this time
        .withColumn("_as_second", F.sum(bad(F.col("_second")) + F.col("_step")).over(back.rowsBetween(*so_far)) - F.col("_step"))  # from this time on
        .withColumn("_turn", F.col("_as_first") + F.coalesce(F.lead("_as_second").over(on), F.lit(0)))  # the clock goes back after this time
        .withColumn("_if_first", F.min("_turn").over(back.rowsBetween(*so_far)))
        .withColumn("_if_second", F.least(F.first("_as_second").over(on.rowsBetween(*so_far)), F.min("_turn").over(on.rowsBetween(Window.unboundedPreceding, -1))))
    )
    told_by = F.when(orderly & (F.col("_if_first") < F.col("_if_second")), F.col("_first")).when(orderly & (F.col("_if_first") > F.col("_if_second")), F.col("_second"))
    placed = cost.withColumn("instant", told_by).withColumns({"normal_form": iso_utc(F.col("instant")), "zone_from": F.when(F.col("instant").isNotNull(), F.lit("aligned"))})
    return placed.select(*rows.columns)


#: The fields of a record that hold dates.
DATE_FIELDS = ("incident_date", "instruction_date", "inspection_date")


def date_cases(extractions: DataFrame, fixtures: DataFrame, models: DataFrame) -> DataFrame:
    """record_id, field, spelling, and the zone, sending and arrival time and sender (mail address, else provider) of its document (null if there is none)."""
    a = extractions.where(F.col("field_key").isin(*DATE_FIELDS) & F.col("raw_value").isNotNull()).select("record_id", "model_id", F.col("field_key").alias("field"), F.col("raw_value").alias("spelling"))
    b = fixtures.select("record_id", "model_id", F.lit("incident_date").alias("field"), F.get(F.map_values(F.map_filter("expected_values", lambda k, _: k == "incident_date")), F.lit(0)).alias("spelling"))
    of = lambda key: F.get(F.map_values(F.map_filter("metadata", lambda k, _: k == key)), F.lit(0))
    sender = F.coalesce(F.lower(of("from_address").cast("string")), *([F.col("provider_id")] if "provider_id" in models.columns else []))
    m = models.select("model_id", "tz_name", of("sent").try_cast("timestamp").alias("sent_at"), F.col("imported_at").alias("arrived_at"), sender.alias("sender")).dropDuplicates(["model_id"])
    cases = a.unionByName(b.where(F.col("spelling").isNotNull())).dropDuplicates(["record_id", "spelling"])
    return cases.join(m, "model_id", "left")


def dates_of(extractions: DataFrame, fixtures: DataFrame, models: DataFrame, estimate_missing: bool = False, zones: tuple[str, ...] = ()) -> DataFrame:
    """record_id, field, normal_form, zone_from of each date case (null: it names no day or instant, or nothing tells which).

    Only the date of the instruction is the document's own: it alone is held against the sending time and stands in the order of the sender's documents,
    which is that of their arrival. zones: what the histories are chosen from with ``estimate_missing``; all that are known, unless given.
    """
    cases = date_cases(extractions, fixtures, models)
    own = F.col("field") == "instruction_date"
    cases = cases.withColumn("sent_at", F.when(own, F.col("sent_at")))
    if estimate_missing:
        known = known_zone(F.col("tz_name"), zone_names(cases)).isNotNull()
        bare = cases.where(~known)
        ordered = bare.where(own).withColumn("_arrival", F.unix_micros(F.col("arrived_at").cast("timestamp")) / F.lit(3_600_000_000))  # in hours: a range is about a year
        found = zone_histories(ordered, "sender", "spelling", "_arrival", "sent_at", "arrived_at", zones or zone_rules(cases))
        cases = cases.where(known).withColumn("histories", F.lit(None).cast("array<string>")).unionByName(bare.join(found, "sender", "left"))
    got = _normal(cases, "spelling", "tz_name", "sent_at", "arrived_at", estimate_missing=estimate_missing, histories="histories" if estimate_missing else None)
    n = lambda c: F.col(f"_normal.{c}").alias(c)
    rows = cut(cases.withColumn("_normal", got).select(F.col("record_id").alias("id"), "field", "sender", F.col("arrived_at").alias("arrived"), n("normal_form"), n("zone_from"), n("instant"), n("local"), n("z"), n("left")))
    placed = own & F.col("sender").isNotNull() & F.col("arrived").isNotNull()
    doubled = F.coalesce(F.col("instant").isNull() & (F.size("left") == 2), F.lit(False))
    rest = rows.where(~(placed & doubled))
    told = _by_order(rows.where(placed & (F.col("instant").isNotNull() | doubled)))
    return rest.unionByName(told).select(F.col("id").alias("record_id"), "field", "normal_form", "zone_from")


def find_dates(extractions: DataFrame, fixtures: DataFrame, models: DataFrame, estimate_missing: bool = False) -> DataFrame:
    """record_id, normal_form, zone_from of each date case that names one day or one instant."""
    got = dates_of(extractions, fixtures, models, estimate_missing)
    return got.where(F.col("normal_form").isNotNull()).select("record_id", "normal_form", "zone_from").dropDuplicates(["record_id", "normal_form"])
