"""Text stamps of many formats, precisions and zones to unambiguous UTC instants.

Every value gets all its valid interpretations (order of day and month x zone of a wall time) as an array, built by expressions inside the
JVM. The interpretation that counts is chosen by Viterbi over the records of a source in their order: breaking a declared convention costs
most, then switching the convention between neighbouring records, then a jump back in time. Chunks of the record order are solved side by
side, in a task as across tasks: each contributes a small (min, +) matrix, one best path is walked through the chain of matrices, and every
chunk is then decoded between the states which that path has at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.session import cut, ship

# Zone names as stamps write them. Letters for a region mean its wall time, the others are fixed offsets.
WALL_ZONES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
FIXED_ZONES = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "AST": "-04:00", "ADT": "-03:00", "NST": "-03:30", "NDT": "-02:30", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00",
}
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

_MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DATE = (
    rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})|(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})|(?:[A-Z]{{3,9}},\s+)?{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})|(?:[A-Z]{{3,9}},?\s+)?(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})"
)
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AP])\.?M\.?)?"
_ZONE = r"(?:\s*(Z|[+-]\d{1,2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5}))?(?:\s*\[([A-Z0-9_/+-]+)\])?"
STAMP = rf"(?i)^(?:(?:{_DATE})(?:T|,?\s+))?{_TIME}{_ZONE}$"
DATE = rf"(?i)^(?:{_DATE}|(\d{{4}})(\d{{2}})(\d{{2}}))(?:(?:T|,?\s+){_TIME}{_ZONE})?$"
COMPACT = r"(?i)^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})([.,]\d+)?(Z|[+-].*)?$"
SEP = "\u0001"
PENALTY = {"prior": 1000.0, "switch": 4.0, "back": 1.0}


def _split(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a full match as an array, '' where a group took no part; a text that does not match stays one piece."""
    return F.split(F.regexp_replace(text, pattern, SEP.join(f"${i}" for i in range(1, groups + 1))), SEP)


def _int(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def _month(name: Column) -> Column:
    return ((F.instr(F.lit(MONTHS), F.upper(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def _written_dates(df: DataFrame, p: str, ok: Column) -> DataFrame:
    """Columns __y, __m, __d, __slash of the date in the twelve date groups of `p`; of a slash date __m and __d as written, __slash true."""
    g = lambda i: F.when(ok, F.col(p)[i])
    kind = F.when(g(0) != "", 0).when(g(3) != "", 1).when(g(6) != "", 2).when(g(9) != "", 3)
    df = df.withColumn("__kind", kind)
    pick = lambda *i: F.when(F.col("__kind") == 0, F.col(p)[i[0]]).when(F.col("__kind") == 1, F.col(p)[i[1]]).when(F.col("__kind") == 2, F.col(p)[i[2]]).when(F.col("__kind") == 3, F.col(p)[i[3]])
    df = df.withColumns({"__yt": pick(0, 5, 8, 11), "__mt": pick(1, 3, 6, 10), "__dt": pick(2, 4, 7, 9)})
    month = F.when(F.col("__kind") < 2, _int(F.col("__mt"))).otherwise(_month(F.col("__mt")))
    year = _int(F.col("__yt")) + F.when(F.length("__yt") == 2, 2000).otherwise(0)
    return df.withColumns({"__y": year, "__m": month, "__d": _int(F.col("__dt")), "__slash": F.col("__kind") == 1})


def with_date_readings(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with `out`: array<struct<ord, day>> of all valid dates that the text may denote.

    ord is 'mdy' or 'dmy' for slash dates, else ''. A possible time of day behind the date is ignored, an impossible one is not. NULL,
    placeholders and impossible dates have an empty array. Every step is a column of its own, so that no regular expression runs twice.
    """
    names = df.columns
    df = df.withColumn("__p", _split(_trim(F.col(text)), DATE, 22)).withColumn("__ok", F.coalesce(F.size("__p") == 22, F.lit(False)))
    df = _written_dates(df, "__p", F.col("__ok"))
    p = lambda i: F.when(F.col("__ok"), F.col("__p")[i])
    time_ok = (p(15) == "") | F.coalesce((_int(p(15)) < 24) & (_int(p(16)) < 60) & (F.coalesce(_int(p(17)), F.lit(0)) < 60), F.lit(False))
    day = lambda y, m, d: F.when(time_ok, F.to_date(F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0))))
    plain = F.coalesce(day(F.col("__y"), F.col("__m"), F.col("__d")), day(_int(p(12)), _int(p(13)), _int(p(14))))
    df = df.withColumns({"__a": plain, "__b": F.when(F.col("__slash"), day(F.col("__y"), F.col("__d"), F.col("__m")))})
    one = lambda o, c: F.when(F.col(c).isNotNull(), F.struct(o.alias("ord"), F.col(c).alias("day")))
    first = F.when(F.col("__slash"), "mdy").otherwise("")
    return df.withColumn(out, F.array_compact(F.array(one(first, "__a"), one(F.lit("dmy"), "__b")))).select(*names, out)


def with_instant_readings(df: DataFrame, text: str, out: str, venue_zone: str | None = None, day: str | None = None) -> DataFrame:
    """`df` with `out`: array<struct<ord, zone, at>> of all valid readings of a stamp as UTC micros since 1970.

    zone is 'own' where the stamp says it, else 'utc', 'ny' or 'venue'. `venue_zone` (a column of IANA names) and `day` (a column of dates for
    times without one) may be missing or NULL; the readings that need them then do not exist. NULL, placeholders, impossible dates and times,
    unknown zones and stamps without time of day have an empty array. Every step is a column of its own, so that no regular expression runs
    twice, and all of it stays in generated code.
    """
    names = df.columns
    df = df.withColumn("__s", F.regexp_replace(_trim(F.col(text)), COMPACT, "$1-$2-$3T$4:$5:$6$7$8"))
    df = df.withColumn("__p", _split(F.col("__s"), STAMP, 19)).withColumn("__ok", F.coalesce(F.size("__p") == 19, F.lit(False)))
    df = _written_dates(df, "__p", F.col("__ok"))
    p = lambda i: F.when(F.col("__ok"), F.col("__p")[i])
    df = df.withColumns({
        "__hh": _int(p(12)), "__mi": _int(p(13)), "__ss": F.coalesce(_int(p(14)), F.lit(0)), "__half": F.upper(p(16)), "__name": F.regexp_replace(F.upper(p(17)), r"^(?:UTC|GMT)(?=[+-])", ""), "__bracket": p(18),
        "__us": F.when(p(15) == "", 0).otherwise(F.rpad(F.substring(p(15), 1, 6), 6, "0").cast("int")),
    })
    hour = F.when(F.col("__half") == "", F.col("__hh")).when(F.col("__hh").between(1, 12), F.col("__hh") % 12 + F.when(F.col("__half") == "P", 12).otherwise(0))
    digits = F.regexp_replace("__name", "[^0-9]", "")
    df = df.withColumns({"__hour": hour, "__digits": F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)})
    if day is not None:
        own = F.col("__kind").isNull() & F.col("__ok")
        df = df.withColumns({c: F.when(own, f(F.col(day))).otherwise(F.col(c)) for c, f in (("__y", F.year), ("__m", F.month), ("__d", F.dayofmonth))})
    hours, minutes = _int(F.substring("__digits", 1, 2)), F.coalesce(_int(F.substring("__digits", 3, 2)), F.lit(0))
    fits = F.col("__name").rlike("^[+-]") & ((hours < 18) | ((hours == 18) & (minutes == 0))) & (minutes < 60)
    offset = F.when(fits, F.concat(F.substring("__name", 1, 1), F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0")))
    table = F.create_map(*[F.lit(x) for pair in {**WALL_ZONES, **FIXED_ZONES}.items() for x in pair])
    bracket = F.when(F.col("__bracket").rlike(r"^(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)(/[A-Za-z0-9_+-]+)+$|^(?:Etc/)?UTC$"), F.col("__bracket"))
    second = F.concat(F.col("__ss").cast("string"), F.lit("."), F.lpad(F.col("__us").cast("string"), 6, "0")).try_cast("decimal(8,6)")
    wall = lambda m, d: F.try_make_timestamp_ntz(F.col("__y"), F.col(m), F.col(d), F.col("__hour"), F.col("__mi"), second)
    zone = F.when(F.col("__name") != "", F.coalesce(offset, F.try_element_at(table, F.col("__name")))).when(F.col("__bracket") != "", bracket)
    ok_time = (F.col("__mi") < 60) & (F.col("__ss") < 60) & (F.col("__hour") < 24)
    df = df.withColumns({"__zone": zone, "__a": F.when(ok_time, wall("__m", "__d")), "__b": F.when(ok_time & F.col("__slash"), wall("__d", "__m"))})
    pair = lambda tag, z: F.struct(F.lit(tag).alias("zone"), z.alias("name"))
    free = [pair("utc", F.lit("UTC")), pair("ny", F.lit("America/New_York")), *([pair("venue", F.col(venue_zone))] if venue_zone else [])]
    zones = F.when((F.col("__name") != "") | (F.col("__bracket") != ""), F.array(pair("own", F.col("__zone")))).otherwise(F.array(*free))
    walls = F.array(F.struct(F.when(F.col("__slash"), "mdy").otherwise("").alias("ord"), F.col("__a").alias("w")), F.struct(F.lit("dmy").alias("ord"), F.col("__b").alias("w")))
    df = df.withColumns({"__zones": F.filter(zones, lambda z: z["name"].isNotNull()), "__walls": F.filter(walls, lambda x: x["w"].isNotNull())})
    size = F.length("__s")
    scale = F.when(size == 10, F.lit(1000000)).when(size == 13, F.lit(1000)).when(size == 16, F.lit(1))
    df = df.withColumn("__epoch", F.when(F.col("__s").rlike(r"^[0-9]+$"), F.col("__s").try_cast("long") * scale))
    at = lambda x, z: F.struct(x["ord"].alias("ord"), z["zone"].alias("zone"), _ntz_micros(F.convert_timezone(z["name"], F.lit("UTC"), x["w"])).alias("at"))
    read = F.flatten(F.transform("__walls", lambda x: F.transform("__zones", lambda z: at(x, z))))
    epoch = F.array(F.struct(F.lit("").alias("ord"), F.lit("own").alias("zone"), F.col("__epoch").alias("at")))
    return df.withColumn(out, F.when(F.col("__epoch").isNotNull(), epoch).otherwise(F.coalesce(read, F.array().cast("array<struct<ord:string,zone:string,at:bigint>>")))).select(*names, out)


def _ntz_micros(w: Column) -> Column:
    """Micros since 1970 of a zoneless timestamp, whatever the session's zone."""
    day = F.to_date(w)
    of_day = (F.hour(w) * 3600 + F.minute(w) * 60).cast("long") * 1000000 + (F.extract(F.lit("SECOND"), w) * 1000000).cast("long")
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400000000 + of_day


def utc_text(micros: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS.ffffff of UTC micros, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros.cast("decimal(20,0)") / F.lit(86400000000)).cast("int"))
    rest = F.pmod(micros, F.lit(86400000000))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    div = lambda a, b: ((a - F.pmod(a, F.lit(b))) / b).cast("long")
    hour, minute, sec, micro = div(rest, 3600000000), F.pmod(div(rest, 60000000), F.lit(60)), F.pmod(div(rest, 1000000), F.lit(60)), F.pmod(rest, F.lit(1000000))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":"), two(sec), F.lit("."), F.lpad(micro.cast("string"), 6, "0"))


@dataclass(frozen=True)
class Convention:
    """What a source declares about its stamps: order 'mdy' or 'dmy' of slash dates, and zone 'utc', 'ny' or 'venue' of wall times.

    None leaves the question to the Viterbi search over the source's records. A reading that breaks what is declared costs PENALTY["prior"] for
    each part; with `strict` it is impossible.
    """

    order: str | None = None
    zone: str | None = None
    strict: bool = True


ORDERS, ZONES = ("mdy", "dmy"), ("utc", "ny", "venue")
STATES = [(o, z) for o in ORDERS for z in ZONES]
K = len(STATES)
#: Stands for "this state does not read the value" among the instants.
NONE = -(1 << 63)


def per_state(readings: Column) -> list[Column]:
    """The instant that each state reads, or NONE: the columns at0, at1, ... of the states in order."""
    fits = lambda o, z: F.filter(readings, lambda x: ((x["ord"] == "") | (x["ord"] == o)) & ((x["zone"] == "own") | (x["zone"] == z)))
    return [F.coalesce(F.try_element_at(fits(o, z), F.lit(1))["at"], F.lit(NONE)).alias(f"at{s}") for s, (o, z) in enumerate(STATES)]


def _costs(source: str, at: np.ndarray, conventions: dict[str, Convention], default: Convention) -> np.ndarray:
    """(n x states) emission costs of the records of one source, infinite where a state does not read the value."""
    c = conventions.get(source, default)
    wrong = np.array([(c.order not in (None, o)) + (c.zone not in (None, z)) for o, z in STATES], float)
    prior = np.where(wrong > 0, np.inf, 0.0) if c.strict else wrong * PENALTY["prior"]
    return np.where(at == NONE, np.inf, prior[None, :])


#: Cost of the convention switches between two states.
SWITCHES = PENALTY["switch"] * np.array([[(a[0] != b[0]) + (a[1] != b[1]) for b in STATES] for a in STATES], float)


def _steps(at_before: np.ndarray, at_now: np.ndarray) -> np.ndarray:
    """Cost of going from each state of one record to each state of the next; leading axes are records."""
    return SWITCHES + PENALTY["back"] * (at_now[..., None, :] < at_before[..., :, None])


def _bounds(n: int) -> np.ndarray:
    """Cuts of n records into chunks whose number is about their length."""
    size = max(int(np.ceil(np.sqrt(n))), 1)
    return np.append(np.arange(0, n, size), n)


def _matrices(cost: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(chunks x states x states): cost from each state of a chunk's first record to each state of its last, all chunks side by side."""
    lo, size = bounds[:-1], np.diff(bounds)
    d = np.full((len(lo), K, K), np.inf)
    d[:, np.arange(K), np.arange(K)] = cost[lo]
    for j in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > j)
        i = lo[on] + j
        d[on] = (d[on][:, :, :, None] + _steps(at[i - 1], at[i])[:, None]).min(2) + cost[i][:, None, :]
    return d


def _walk(matrices: np.ndarray, joints: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) states of every chunk on one best path through all of them: ties are settled once, so that chunks fit together."""
    n = len(matrices)
    reach, after = np.zeros((n, K)), np.zeros((n, K))  # best cost of arriving in a chunk's first state, and of its last state
    reach[0] = entry
    for c in range(n):
        if c:
            reach[c] = (after[c - 1][:, None] + joints[c - 1]).min(0)
        after[c] = (reach[c][:, None] + matrices[c]).min(0)
        after[c] -= after[c].min() if np.isfinite(after[c].min()) else 0.0
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c in range(n - 1, -1, -1):
        last[c] = np.argmin(after[c] + (leave if c == n - 1 else joints[c][:, first[c + 1]]))
        first[c] = np.argmin(reach[c] + matrices[c][:, last[c]])
    return first, last


def _fill(cost: np.ndarray, at: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best state of every record of all chunks side by side, between the given states at their ends."""
    lo, size = bounds[:-1], np.diff(bounds)
    best = np.full((len(lo), K), np.inf)
    best[np.arange(len(lo)), first] = cost[lo, first]
    back = np.zeros(cost.shape, np.int64)
    for j in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > j)
        i = lo[on] + j
        reach = best[on][:, :, None] + _steps(at[i - 1], at[i])
        back[i] = reach.argmin(1)
        best[on] = reach.min(1) + cost[i]
    state, now = np.zeros(len(cost), np.int64), last.copy()
    for j in range(int(size.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(size > j)
        i = lo[on] + j
        state[i] = now[on]
        now[on] = back[i, now[on]]
    return state


def _transfer(cost: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(min, +) matrix from the state of the first record to the state of the last."""
    bounds = _bounds(len(cost))
    parts = _matrices(cost, at, bounds)
    d = parts[0]
    for m, i in zip(parts[1:], bounds[1:-1]):
        over = (d[:, :, None] + _steps(at[i - 1], at[i])[None]).min(1)
        d = (over[:, :, None] + m[None]).min(1)
    return d


def _decode(cost: np.ndarray, at: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Best state of every record, given the cost of being in each state at the first record and after the last."""
    bounds = _bounds(len(cost))
    inner = bounds[1:-1]
    first, last = _walk(_matrices(cost, at, bounds), _steps(at[inner - 1], at[inner]), entry, leave)
    return _fill(cost, at, bounds, first, last)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition as one frame for each source; a batch may hold several sources and a source several batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for _, part in pdf.groupby((pdf["source"] != pdf["source"].shift()).cumsum(), sort=False):
            if held and held[-1]["source"].iloc[-1] != part["source"].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def choose_readings(df: DataFrame, source: str, order: Sequence[str], readings: str, conventions: dict[str, Convention], default: Convention = Convention(), unread: bool = False) -> DataFrame:
    """`df` with the chosen reading of every value: columns read_order, read_zone and read_at (UTC micros) instead of `readings`.

    Records of a source are taken in the order of `order` (make it total; ties fall to the engine). Values without any possible reading
    denote no instant: they are left out, or with `unread` come out with NULLs where no state reads them. A NULL source is a source of its own. One source may hold any share of all rows: the order is cut into
    ranges of even size, each range is solved in its own task, and the driver only chains one matrix of len(STATES) x len(STATES) for each
    end of a range and fixes one state on either side of every joint.
    """
    ship(df.sparkSession)
    names = df.columns
    keep = [c for c in names if c != readings]
    src = F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))
    # The readings are written down first: the range partitioner samples its input, and a filter over them would be pushed into their making.
    work = cut(df.select(src.alias("source"), F.struct(*order).alias("ord"), F.struct(*keep).alias("row"), *per_state(F.col(readings))))
    some = reduce(lambda a, b: a | b, [F.col(f"at{s}") != NONE for s in range(K)])
    placed = cut(work.filter(some).repartitionByRange("source", "ord").sortWithinPartitions("source", "ord").withColumn("part", F.spark_partition_id()))
    slim = ["part", "source", *[f"at{s}" for s in range(K)]]

    def solved(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = g[slim[2:]].to_numpy(np.int64)
        cost = _costs(g["source"].iloc[0], at, conventions, default)
        able = np.isfinite(cost).any(1)
        return able, cost[able], at[able]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = None, None
        for g in _groups(batches):  # only the sources at the two ends of a range can go on in another
            first, last = (g, None) if first is None else (first, g)
        for g in (x for x in (first, last) if x is not None):
            able, cost, at = solved(g)
            if able.any():
                yield pd.DataFrame({"part": [int(g["part"].iloc[0])], "source": [g["source"].iloc[0]], "matrix": [_transfer(cost, at).ravel().tolist()], "first": [at[0].tolist()], "last": [at[-1].tolist()]})

    pieces = placed.select(*slim).mapInPandas(ends, "part int, source string, matrix array<double>, first array<long>, last array<long>").collect()
    known = _chain(pieces)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            able, cost, at = solved(g)
            if not able.any():
                continue
            entry, leave = known.get((int(g["part"].iloc[0]), g["source"].iloc[0]), ([0.0] * K, [0.0] * K))
            state = _decode(cost, at, np.asarray(entry), np.asarray(leave))
            g = g[able].copy()
            g["read_order"], g["read_zone"] = np.array([o for o, _ in STATES], object)[state], np.array([z for _, z in STATES], object)[state]
            g["read_at"] = at[np.arange(len(g)), state]
            yield g[["row", "read_order", "read_zone", "read_at"]]

    row_type = placed.schema["row"].dataType.simpleString()
    done = placed.select(*slim, "row").mapInPandas(decode, f"row {row_type}, read_order string, read_zone string, read_at long")
    if unread:
        done = done.unionByName(work.filter(~some).select("row", *[F.lit(None).cast(t).alias(c) for c, t in (("read_order", "string"), ("read_zone", "string"), ("read_at", "long"))]))
    return done.select("row.*", "read_order", "read_zone", "read_at")


def as_declared(source: Column, conventions: dict[str, Convention]) -> Column:
    """Whether a chosen reading (read_order, read_zone) is one that its source declares: the exact check behind conventions that are not strict."""
    told = [(name, part, value) for name, c in conventions.items() for part, value in (("read_order", c.order), ("read_zone", c.zone)) if value is not None]
    broken = [(source == name) & (F.col(part) != value) for name, part, value in told]
    return ~F.coalesce(reduce(lambda a, b: a | b, broken, F.lit(False)), F.lit(False))


def _chain(pieces: Sequence) -> dict[tuple[int, str], tuple[list[float], list[float]]]:
    """Per piece of a source: costs of its first and of its last states, infinite but for the ones on one best path through all its pieces."""
    by_source: dict[str, list] = {}
    for p in sorted(pieces, key=lambda r: r["part"]):
        by_source.setdefault(p["source"], []).append(p)
    only = lambda s: np.where(np.arange(K) == s, 0.0, np.inf).tolist()
    out = {}
    for source, parts in by_source.items():
        matrices = np.array([p["matrix"] for p in parts]).reshape(len(parts), K, K)
        joints = _steps(np.array([p["last"] for p in parts[:-1]], np.int64).reshape(-1, K), np.array([p["first"] for p in parts[1:]], np.int64).reshape(-1, K))
        first, last = _walk(matrices, joints, np.zeros(K), np.zeros(K))
        for p, a, b in zip(parts, first, last):
            out[p["part"], source] = (only(a), only(b))
    return out
