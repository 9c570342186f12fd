"""Records of one postal address written differently (problem 3).

Method: each address is expanded into its plausible normalised forms (parts in any order, abbreviations spelled out, the numbers of
a slash both ways round, a misspelt street as it stands and as the frequent name it misspells, a missing postcode made
good by the area of the post town), combinations of the components are hashed, the hashes exploded and equi-joined, and
pairs with conflicting parts rejected: another house number, letter, flat or unit, another postcode, another kind of
street, or another street.

Every step works on classes of equal normalised forms, so that copies of an address meet no bucket; only the result,
which is pairs of records, expands them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.session import cut

#: Kinds of streets with their abbreviations, words for a part of a building, words that mark a business.
STREET_KINDS = {
    "street": "st str", "road": "rd", "avenue": "ave av aven", "lane": "ln la", "close": "cl clo cls", "drive": "dr drv", "court": "ct crt",
    "crescent": "cres cresc cr crs", "gardens": "gdns gdn gds garden", "grove": "gr grv gro", "place": "pl plc", "square": "sq sqr", "terrace": "ter terr tce",
    "way": "wy", "hill": "hl", "park": "pk", "walk": "wlk", "mews": "mws", "parade": "pde", "rise": "", "row": "", "boulevard": "blvd",
}
UNIT_WORDS = ("flat", "flt", "fl", "apartment", "apt", "appt", "unit", "ut", "u", "suite", "ste", "room", "rm", "f")
BUSINESS_WORDS = ("garage", "bodyshop", "coachworks", "autocare", "motor", "works", "accident", "repair", "repairs", "centre", "recovery", "yard", "storage", "compound", "ltd", "limited", "services", "motors", "cars")
#: Least count and least share of one postcode area for a word to stand for a post town.
TOWN_COUNT, TOWN_SHARE = 3, 0.75
#: Least count of a street name that rare misspellings are put right to.
USUAL_TIMES = 8

_KIND = {a: k for k, abbr in STREET_KINDS.items() for a in (k, *abbr.split())}
_POSTCODE = re.compile(r"(?<![a-z0-9])([a-z]{1,2})([0-9][0-9a-z]?) ?([0-9][a-z]{2})(?![a-z0-9])")
_UNIT = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(UNIT_WORDS, key=len, reverse=True))})(?![a-z])\.? ?(?:no\.? ?)?#?([0-9]+[a-z]?|[a-z])(?![a-z0-9])[ ,;/\n]*")
_SLASH = re.compile(r"(?<![0-9a-z])([0-9]+[a-z]?) ?/ ?([0-9]+[a-z]?)(?![0-9])")
_NUMBER = re.compile(r"(?:no\.? ?|number |nr\.? ?|#)?(?<![a-z0-9])([0-9]+)([a-z]?)(?![a-z0-9])")
FIELDS = ("unit", "house", "street", "kind", "area", "code", "turned", "rest")


def parse(text: str | None) -> tuple | None:
    """(unit, house with letter, street, kind, postcode area, postcode, turned, other words) of one address; None without a house number or street.

    turned: the house number if the two numbers of a slash are read the other way round.
    """
    if not text:
        return None
    t = re.sub(r"['’`]", "", text.lower()).replace("\r", "\n").replace("\t", " ")
    t = re.sub(r" {2,}", " ", t)
    area = code = None
    hits = list(_POSTCODE.finditer(t))
    if hits:
        m = hits[-1]
        area, code = m[1], m[1] + m[2] + m[3]
        t = t[: m.start()] + "\n" + t[m.end() :]
    unit = turned = None
    m = _UNIT.search(t)
    if m:
        unit = m[1]
        t = t[: m.start()] + "\n" + t[m.end() :]
    else:
        m = _SLASH.search(t)
        if m:
            unit, turned = m[1], m[1]
            t = t[: m.start()] + m[2] + t[m.end() :]
    m = _NUMBER.search(t)
    if not m:
        return None
    t = t[: m.start()] + " \x00 " + t[m.end() :]
    house = m[1].lstrip("0") + m[2]
    parts = [p.split() for p in re.split(r"[,;/\n|]", re.sub(r"[.\-–—()]", " ", t).replace("-", " "))]
    parts = [p for p in parts if p]
    k = next(i for i, p in enumerate(parts) if "\x00" in p)
    p = parts[k]
    i = p.index("\x00")
    before, after = p[:i], p[i + 1 :]
    street, kind, used = [], None, set()
    if before and before[-1] in _KIND and len(before) > 1:
        kind, street = _KIND[before[-1]], before[-2:-1]
        rest = before[:-2] + after
    elif before and not after and before[-1] not in BUSINESS_WORDS:
        street, rest = before[-1:], before[:-1]
    else:
        if not after and k + 1 < len(parts):
            after = parts[k + 1]
            used.add(k + 1)
        n = next((j for j, w in enumerate(after[:4]) if w in _KIND and j), None)
        if n is None:
            street, rest = after[:1], before + after[1:]
        else:
            kind, street, rest = _KIND[after[n]], after[:n], before + after[n + 1 :]
    if not street:
        return None
    others = rest + [w for j, q in enumerate(parts) if j != k and j not in used for w in q]
    words = sorted({w for w in others if len(w) > 3 and w.isalpha() and w not in BUSINESS_WORDS and w not in _KIND})
    return unit, house, "".join(street), kind, area, code, turned, words


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the parts of each address; rows that name no house and street are left out, null and empty ones among them."""
    src = df.select(F.col(key), F.col(text).alias("_text"))
    kind = dict(src.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(t) for t in b.column(1).to_pylist()]
            keep = pa.array([g is not None for g in got], pa.bool_())
            cols = [pa.array([g[i] for g in got if g is not None], pa.list_(pa.string()) if f == "rest" else pa.string()) for i, f in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), *cols], names=[key, *FIELDS])

    return src.mapInArrow(run, f"`{key}` {kind}, unit string, house string, street string, kind string, area string, code string, turned string, rest array<string>")


def towns(parts: DataFrame) -> DataFrame:
    """word, area: the words that mostly stand beside the postcodes of one area."""
    pairs = parts.where(F.col("area").isNotNull()).select(F.explode("rest").alias("word"), "area").groupBy("word", "area").count()
    best = pairs.groupBy("word").agg(F.max_by("area", F.struct("count", "area")).alias("area"), F.max("count").alias("most"), F.sum("count").alias("all"))
    return best.where((F.col("most") >= TOWN_COUNT) & (F.col("most") >= TOWN_SHARE * F.col("all"))).select("word", "area", "most")


def _halves(word: Column) -> Column:
    """Two pieces of a word of which one survives any single wrong, lost, added or swapped letter."""
    n = F.least(F.lit(4), F.floor(F.length(word) / 2).cast("int"))
    return F.array(F.concat(F.lit("^"), F.substr(word, F.lit(1), n)), F.concat(F.lit("$"), F.right(word, n)))


def with_area(parts: DataFrame) -> DataFrame:
    """``parts`` with the postcode area of the post town where the address has no postcode, misspelt towns included."""
    known = towns(parts)
    lost = parts.where(F.col("area").isNull())
    words = lost.select("record_id", F.explode("rest").alias("word"))
    same = words.join(known, "word")
    near = (
        words.join(same.select("record_id").distinct(), "record_id", "left_anti").withColumn("half", F.explode(_halves(F.col("word"))))
        .join(known.select(F.col("word").alias("town"), "area", "most").withColumn("half", F.explode(_halves(F.col("town")))), "half")
        .where(F.levenshtein("word", "town") <= 2).select("record_id", "area", "most")
    )
    found = same.select("record_id", "area", "most").unionByName(near).groupBy("record_id").agg(F.max_by("area", F.struct("most", "area")).alias("town_area"))
    joined = parts.join(found, "record_id", "left")
    return joined.withColumn("area", F.coalesce("area", "town_area")).drop("town_area")


def with_usual_streets(parts: DataFrame) -> DataFrame:
    """``parts`` with usual: the frequent street name that a rare one misspells, or the name itself."""
    names = parts.groupBy("street").agg(F.count("*").alias("times"))
    usual = names.where(F.col("times") >= USUAL_TIMES).withColumn("half", F.explode(_halves(F.col("street"))))
    rare = names.where(F.length("street") >= 5).withColumn("half", F.explode(_halves(F.col("street"))))
    r, u = rare.alias("r"), usual.alias("u")
    near = F.levenshtein(F.col("r.street"), F.col("u.street"))
    fixed = (
        r.join(u, (F.col("r.half") == F.col("u.half")) & (F.col("r.times") * 8 <= F.col("u.times")) & (near <= 2)).groupBy(F.col("r.street").alias("street"))
        .agg(F.min_by(F.col("u.street"), F.struct(near, -F.col("u.times"), F.col("u.street"))).alias("usual"))
    )
    return parts.join(fixed, "street", "left").withColumn("usual", F.coalesce("usual", "street"))


def classes(parts: DataFrame) -> DataFrame:
    """record_id, class_id and the components; without postcode and known town, the other words stand for the place."""
    place = F.coalesce("area", F.array_join("rest", " "))
    parts = parts.withColumn("area", place)
    return parts.withColumn("class_id", F.xxhash64(*(F.coalesce(F.col(c), F.lit("\x00")) for c in ("unit", "house", "street", "kind", "area", "code", "turned")))).drop("rest")


def forms(cls: DataFrame) -> DataFrame:
    """A row for each plausible form of each class: class_id, unit, house, street, main, times, kind, area, code.

    The street as it is written and as the frequent name that it misspells (the main form, with how often that name stands), the two
    numbers of a slash as unit and house and as house and unit.
    """
    counts = cls.groupBy(F.col("usual").alias("street")).agg(F.count("*").alias("times"))
    c = cls.dropDuplicates(["class_id"])
    numbers = F.array_compact(F.array(F.struct("unit", "house"), F.when(F.col("turned").isNotNull(), F.struct(F.col("house").alias("unit"), F.col("turned").alias("house")))))
    streets = F.array_compact(F.array(F.struct(F.col("usual").alias("street"), F.lit(True).alias("main")), F.when(F.col("street") != F.col("usual"), F.struct(F.col("street"), F.lit(False).alias("main")))))
    each = c.select("class_id", "kind", "area", "code", F.explode(numbers).alias("n"), streets.alias("s")).select("class_id", "kind", "area", "code", "n.unit", "n.house", F.explode("s").alias("s"))
    return each.select("class_id", "kind", "area", "code", "unit", "house", "s.street", "s.main").join(counts, "street", "left")


def linked(cls: DataFrame) -> DataFrame:
    """a, b: the classes of which some forms denote one place, the smaller first, each pair once."""
    c = forms(cls)
    head = lambda *more: F.xxhash64(F.coalesce("unit", F.lit("")), "house", *more)
    by_code = F.when(F.col("code").isNotNull(), F.array(head(F.lit("c"), "code")))
    by_street = F.transform(_halves(F.col("street")), lambda h: head(F.lit("s"), "area", h))
    keyed = c.withColumn("hash", F.explode(F.concat(F.coalesce(by_code, F.array().cast("array<bigint>")), by_street)))
    a, b = keyed.alias("a"), keyed.alias("b")
    x, y = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    either = lambda n: x(n).isNull() | y(n).isNull() | (x(n) == y(n))
    rarer, oftener = F.least(x("times"), y("times")), F.greatest(x("times"), y("times"))
    both_real = (rarer >= 4) & (rarer * 5 >= oftener)
    near = F.levenshtein(x("street"), y("street")) <= F.when(F.least(F.length(x("street")), F.length(y("street"))) >= 5, 2).otherwise(1)
    street = (x("street") == y("street")) | (x("main") & y("main") & near & ~both_real)
    # a postcode with two characters swapped is a slip, if all else agrees
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (letters(x("code")) == letters(y("code"))) & (F.levenshtein(x("code"), y("code")) <= 2) & (x("street") == y("street")) & (x("kind") == y("kind"))
    one_place = x("unit").eqNullSafe(y("unit")) & (x("house") == y("house")) & (x("area") == y("area")) & (either("code") | swapped) & either("kind") & street
    return a.join(b, (x("hash") == y("hash")) & (x("class_id") < y("class_id")) & one_place).select(x("class_id").alias("a"), y("class_id").alias("b")).distinct()


def place_classes(records: DataFrame, key: str = "record_id", text: str = "address") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): record_id, class_id of every record that names a house and a street; a, b of the classes that denote one place.

    Copies of an address are one class, so nothing here grows with the square of their number. Repeated rows of a record count
    once. Addresses without a house number or street are in no class.
    """
    parts = cut(parsed(records.select(F.col(key).alias("record_id"), F.col(text).alias("address")).dropDuplicates(["record_id"]), "record_id", "address"))
    cls = cut(classes(with_usual_streets(with_area(parts))))
    return cls.select("record_id", "class_id"), cut(linked(cls))


def linked_records(records: DataFrame, key: str = "record_id", text: str = "address") -> DataFrame:
    """record_id, class_id, links: with how many other records each record shares its place. Copies are counted, not expanded."""
    members, pairs = place_classes(records, key, text)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both.join(sizes.select(F.col("class_id").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("m").alias("m"))
    links = sizes.join(across, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return members.join(links, "class_id").select("record_id", "class_id", "links")


#: Records of a class from which on its pairs are made in ``SPLIT`` tasks.
LARGE, SPLIT = 1_000, 16


def same_places(records: DataFrame, key: str = "record_id", text: str = "address") -> DataFrame:
    """record_a, record_b (smaller first) of all pairs of records whose addresses denote one place, each pair once.

    The pairs of classes are expanded to pairs of their records; large classes are split, so that no task makes all pairs of one.
    """
    members, pairs = place_classes(records, key, text)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    m = members.join(sizes, "class_id").withColumn("parts", F.when(F.col("n") > LARGE, SPLIT).otherwise(1))
    # a record of the first side goes to one part of its class, a record of the second side to all parts of the first side's class
    left = m.select(F.col("class_id").alias("a"), F.col("record_id").alias("ra"), F.pmod(F.xxhash64("record_id"), "parts").cast("int").alias("part"), "parts")
    every = pairs.unionByName(members.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    wide = every.join(m.select(F.col("class_id").alias("a"), "parts").distinct(), "a").join(members.select(F.col("class_id").alias("b"), F.col("record_id").alias("rb")), "b")
    right = wide.select("a", "b", "rb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = left.select("a", "ra", "part").join(right, ["a", "part"]).where((F.col("a") != F.col("b")) | (F.col("ra") < F.col("rb")))
    return met.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))


def address_records(extractions: DataFrame, fixtures: DataFrame) -> DataFrame:
    a = extractions.where(F.col("field_key") == "inspection_address").select("record_id", F.col("raw_value").alias("address"))
    b = fixtures.select("record_id", F.get(F.map_values(F.map_filter("expected_values", lambda k, _: k == "inspection_address")), F.lit(0)).alias("address"))
    return a.unionByName(b).where(F.col("address").isNotNull())
