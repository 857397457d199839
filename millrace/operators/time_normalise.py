"""One UTC instant from times written in many ways (problem 4).

A value is parsed by built-in expressions into local date and time, and whatever it says of its zone. Where it gives no offset,
an as-of join with the zone's offset intervals decides: a local time inside one interval has that interval's offset, inside two
it is ambiguous, inside none it does not exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import durable
from millrace.sources.tables import newest

# Names of the months in the languages read, as written in full or shortened.
MONTHS = {
    1: ["january", "jan", "januar", "jänner", "janvier", "janv"],
    2: ["february", "feb", "februar", "février", "fevrier", "févr", "fév"],
    3: ["march", "mar", "märz", "maerz", "mär", "mars"],
    4: ["april", "apr", "avril", "avr"],
    5: ["may", "mai"],
    6: ["june", "jun", "juni", "juin"],
    7: ["july", "jul", "juli", "juillet", "juil"],
    8: ["august", "aug", "août", "aout"],
    9: ["september", "sep", "sept", "septembre"],
    10: ["october", "oct", "oktober", "okt", "octobre"],
    11: ["november", "nov", "novembre"],
    12: ["december", "dec", "dezember", "dez", "décembre", "decembre", "déc"],
}
# Names of the days of the week, which add nothing to a date.
WEEKDAYS = "mon|monday|tue|tues|tuesday|wed|wednesday|thu|thur|thurs|thursday|fri|friday|sat|saturday|sun|sunday|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonnabend|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|mo|di|mi|do|fr|sa|so"
#: Numeric dates of these locales put the month first.
MONTH_FIRST = ["en-us"]
#: Local years for which intervals are made. No zone of the database changes before the first; after the last, the rules that hold then recur,
#: so a later year has the offsets of the year before LAST_YEAR that has the same calendar (`_recurring`).
FIRST_YEAR, LAST_YEAR = 1800, 2100
WEEK, NEVER = 7 * 86_400, 1 << 62

_W = r"[a-zà-ÿ]+"
_SPLIT = [  # a date and what follows it, as year|month|day|rest
    (r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})(.*))$", "$1|$2|$3|$4:$5:$6$7"),
    (r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(z|[+-].*)?)?$", "$1|$2|$3|$4:$5$6"),
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?:t|,? )(.*))?$", "$1|$3|$4|$5"),
    (rf"^({_W})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?(.*))?$", "$3|$1|$2|$4"),
    (rf"^(\d{{1,2}})(?:st|nd|rd|th|er|\.)?[ -](?:of )?({_W})\.?,?[ -](\d{{4}}|\d{{2}})(?:,? (?:at |à |um )?(.*))?$", "$3|$2|$1|$4"),
]
_NUMERIC = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?:,? (?:at |à |um )?(.*))?$"
_TIME = r"^(\d{1,2})(?:[:.h](\d{2})|h|(?= ?[ap]\.?m(?![a-z])))(?:[:.](\d{2})(?:[.,](\d+))?)? ?((?:am|pm|a\.m\.|p\.m\.)(?![a-z]))?(?: ?(?:uhr|hrs)(?![a-z]))? ?(.*)$"


def _recurring() -> list[int]:
    """For each year of the 400 of a cycle a year up to LAST_YEAR with the same calendar."""
    import datetime as dt

    known = {}
    for y in range(LAST_YEAR - 28, LAST_YEAR + 1):
        known[dt.date(y, 1, 1).weekday(), dt.date(y, 12, 31).timetuple().tm_yday] = y
    return [known[dt.date(2000 + r, 1, 1).weekday(), dt.date(2000 + r, 12, 31).timetuple().tm_yday] for r in range(400)]


def _cleaned(value: Column) -> Column:
    """A value in lower case without what says nothing of the time."""
    s = F.lower(F.trim(F.regexp_replace(value, r"[\s\u00a0\u2007\u2009\u202f\u3000]+", " ")))
    s = F.regexp_replace(s, r"^(?:[a-z]+(?: [a-z]+){0,3} ?: ?|(?:posted|published|updated|apply|applications?|closes?|closing|due|deadline|open|ends?|starts?)(?: (?:on|by|until|before|from|due|close))? )", "")
    s = F.regexp_replace(s, rf"^(?:{WEEKDAYS})[.,]? ", "")
    return s


def _normalised(df: DataFrame, value: str, zone: str, locale: str) -> DataFrame:
    """`df` and what each value says: _epoch, _local (microseconds), _offset (microseconds), _abbr, _zone."""
    s = _cleaned(F.col(value))
    df = df.withColumn("_s", s)
    d = F.col("_s")
    for pattern, to in _SPLIT:
        d = F.regexp_replace(d, pattern, to)
    month_first = F.lower(F.translate(F.coalesce(F.col(locale), F.lit("")), "_", "-")).isin(MONTH_FIRST)
    d = F.when(month_first, F.regexp_replace(d, _NUMERIC, "$4|$1|$3|$5")).otherwise(F.regexp_replace(d, _NUMERIC, "$4|$3|$1|$5"))
    df = df.withColumn("_p", F.split(d, r"\|", 4)).withColumn("_p", F.when(F.size("_p") == 4, F.col("_p")))
    rest = F.trim(F.element_at("_p", 4))
    df = df.withColumn("_t", F.when(F.regexp_replace(rest, "^:$", "") == "", F.array(*[F.lit("")] * 6)).otherwise(
        F.transform(F.split(F.regexp_replace(rest, _TIME, "$1|$2|$3|$4|$5|$6"), r"\|", 6), lambda x: x)))
    names = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words for x in (w, m)])
    year, mon, day = (F.element_at("_p", i) for i in (1, 2, 3))
    part = lambda i: F.try_element_at(F.col("_t"), F.lit(i))
    num = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int"), F.lit(0))
    half = F.regexp_replace(part(5), r"\.", "")
    hour = F.when(half.isin("am", "pm"), F.when(num(part(1)).between(1, 12), num(part(1)) % 12 + F.when(half == "pm", 12).otherwise(0))).otherwise(num(part(1)))
    df = df.withColumns({
        "_y": F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int")),
        "_m": F.coalesce(mon.try_cast("int"), F.try_element_at(names, mon)),
        "_d": day.try_cast("int"), "_h": hour, "_mi": num(part(2)),
        "_sec": num(part(3)), "_us": num(F.substring(F.rpad(part(4), 6, "0"), 1, 6)),
        "_z": F.when(F.size("_t") == 6, F.trim(F.regexp_replace(part(6), r"[\[\]()]", " "))),
    })
    # A time that the pattern doesn't know makes the whole value unreadable.
    at = F.expr("CASE WHEN _z IS NOT NULL THEN try_make_timestamp_ntz(_y, _m, _d, _h, _mi, CAST(_sec AS DECIMAL(16, 6))) END")
    local = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _at)") + F.col("_us")
    sign = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?(?: .*)?$"
    hours, minutes = (F.regexp_extract("_z", sign, i).try_cast("int") for i in (2, 3))
    offset = F.when(F.col("_z").rlike(sign), F.when(F.regexp_extract("_z", sign, 1) == "-", -1).otherwise(1) * (hours * 3600 + F.coalesce(minutes, F.lit(0)) * 60).cast("bigint") * 1_000_000)
    offset = offset.when(F.col("_z").isin("z", "utc", "gmt", "zulu"), F.lit(0).cast("bigint"))
    n = F.col("_s").try_cast("decimal(38,9)")
    digits = F.length(F.regexp_extract("_s", r"^-?(\d+)", 1))
    unit = F.when(digits.between(9, 11), 1_000_000).when(digits.between(12, 14), 1_000).when(digits.between(15, 17), 1).when(digits.between(18, 19), F.lit(0.001).cast("decimal(4,3)"))
    epoch = F.when(F.col("_s").rlike(r"^-?\d{9,19}(\.\d+)?$"), F.floor(n * unit).try_cast("bigint"))
    return (
        df.withColumn("_at", at).withColumns({"_local": local, "_offset": offset, "_epoch": epoch})
        .withColumns({
            "_abbr": F.when(F.col("_offset").isNull() & F.col("_z").rlike("^[a-z]{2,5}$"), F.col("_z")),
            "_zone": F.when(F.col("_z").contains("/"), F.col("_z")).otherwise(F.lower(F.trim(F.col(zone)))),
        })
    )


def changes(zone: str) -> list[int]:
    """The seconds since 1970 at which the offset or name of a zone changes, as far as its file lists them; none where it isn't found."""
    import struct
    import zoneinfo
    from pathlib import Path

    for folder in zoneinfo.TZPATH:
        file = Path(folder, *zone.split("/"))
        if file.is_file():
            raw = file.read_bytes()
            if raw[:4] != b"TZif":
                return []
            utc, std, leap, times, types, chars = struct.unpack(">6l", raw[20:44])
            at, wide = 44, raw[4:5] >= b"2"
            if wide:  # the second block has times of 64 bits
                at += times * 5 + types * 6 + chars + leap * 8 + std + utc
                _, _, _, times, _, _ = struct.unpack(">6l", raw[at + 20 : at + 44])
                at += 44
            return list(struct.unpack(f">{times}{'q' if wide else 'l'}", raw[at : at + times * (8 if wide else 4)]))
    return []


def offset_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals of the zones in the column `zone` (lower case), exploded to the local years they touch.

    Columns: zone, year, starts, ends (local microseconds, ends exclusive), off (microseconds), abbr. The first and last
    interval of a zone are open. Names that the time zone database doesn't know give no row.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect
        import datetime as dt
        import zoneinfo

        known = {z.lower(): z for z in zoneinfo.available_timezones()}
        first, last = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in (FIRST_YEAR, LAST_YEAR + 1))
        years = [int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
        for pdf in batches:
            rows = []
            for key in pdf["zone"]:
                if key not in known:
                    continue
                tz = zoneinfo.ZoneInfo(known[key])

                def at(t, tz=tz):
                    d = dt.datetime.fromtimestamp(t, tz)
                    return int(d.utcoffset().total_seconds()), d.tzname().lower()

                cuts, t, now = [(first, *at(first))], first, at(first)
                for change in changes(known[key]):  # those that the database lists; its rules give the later ones
                    if first < change < last and (new := at(change)) != now:
                        cuts.append((change, *new))
                        t, now = change, new
                while t < last:
                    u = min(t + WEEK, last)
                    if (new := at(u)) != now:  # bisect to the second of the change
                        lo, hi = t, u
                        while hi - lo > 1:
                            mid = (lo + hi) // 2
                            lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
                        now = at(hi)
                        cuts.append((hi, *now))
                        t = hi
                        continue
                    t, now = u, new
                for i, (start, off, abbr) in enumerate(cuts):
                    s = start + off if i else -NEVER
                    e = cuts[i + 1][0] + off if i + 1 < len(cuts) else NEVER
                    a = max(0, bisect.bisect_right(years, s - 86_400) - 1) if i else 0
                    b = min(len(years) - 2, bisect.bisect_left(years, e + 86_400)) if e < NEVER else len(years) - 2
                    us = lambda x: x if abs(x) == NEVER else x * 1_000_000
                    rows += [(key, FIRST_YEAR + k, us(s), us(e), off * 1_000_000, abbr) for k in range(a, b + 1)]
            yield pd.DataFrame(rows, columns=["zone", "year", "starts", "ends", "off", "abbr"])

    return zones.mapInPandas(build, "zone string, year int, starts bigint, ends bigint, off bigint, abbr string")


def normalise_times(df: DataFrame, value: str, zone: str, locale: str) -> DataFrame:
    """`df` with epoch_us (BIGINT) and time_status (STRING) for the time written in `value`.

    `zone` names the column with the IANA zone that holds for times without one, `locale` the column with the locale
    (`en-US`), which gives the order of numeric dates. Finer digits than microseconds are cut off.

    time_status: `epoch` (a number of seconds, milli-, micro- or nanoseconds), `offset` (an offset was written), `zone` (one
    interval of the zone holds it), `ambiguous` (two do; the first instant is given), `nonexistent` (none does; it is moved
    forward by the gap), `unknown_zone` (epoch_us null), `unreadable` (not an instant; epoch_us null), or null for a null value.
    Null, empty and blank values give null epoch_us; very long texts are unreadable; repeated rows stay; an empty table gives an
    empty table; other columns stay as they are unless they are named epoch_us or time_status, which are replaced.

    The intervals are a table of one row for each zone that occurs and year, of the time zone database's (some 600); it is broadcast where its
    size, known as it is written first, allows that.
    """
    spec = {"_v": F.col(value), "_iz": F.col(zone), "_il": F.col(locale)}
    kept = [c for c in df.columns if c not in ("epoch_us", "time_status")]
    box = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *[c.cast("string").alias(n) for n, c in spec.items()]) if kept else df
    said = _normalised(box, "_v", "_iz", "_il")
    zones = df.select(F.lower(F.trim(F.col(zone))).alias("zone")).union(
        df.select(F.lower(F.regexp_extract(F.col(value), r"(?<![A-Za-z_])([A-Za-z_]++/[A-Za-z0-9_+/-]+)", 1)))
    ).filter("zone <> ''").distinct()
    by_year = offset_intervals(zones).groupBy("zone", "year").agg(F.sort_array(F.collect_list(F.struct("starts", "ends", "off", "abbr"))).alias("_iv"))
    by_year = durable(by_year.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "_iv"), "intervals")
    later = F.element_at(F.array(*[F.lit(y) for y in _recurring()]), F.col("_y") % 400 + 1)
    year = F.when(F.col("_y") > LAST_YEAR, later).otherwise(F.greatest(F.lit(FIRST_YEAR), F.col("_y")))
    said = said.withColumn("_year", F.when(F.col("_local").isNotNull() & F.col("_offset").isNull(), year))
    days = F.date_diff(F.make_date("_y", F.lit(1), F.lit(1)), F.make_date("_year", F.lit(1), F.lit(1)))
    said = said.withColumn("_place", F.when(F.col("_y") > LAST_YEAR, F.col("_local") - days.cast("bigint") * 86_400_000_000).otherwise(F.col("_local")))
    both = said.join(by_year, ["_zone", "_year"], "left")
    inside = F.filter("_iv", lambda x: (x["starts"] <= F.col("_place")) & (F.col("_place") < x["ends"]))
    both = both.withColumn("_in", inside)
    off = lambda a: F.transform(a, lambda x: x["off"])
    named = lambda a: F.try_element_at(off(F.filter(a, lambda x: x["abbr"] == F.col("_abbr"))), F.lit(1))
    before = F.try_element_at(off(F.filter("_iv", lambda x: x["ends"] <= F.col("_place"))), F.lit(-1))
    used = (
        F.when(F.col("_offset").isNotNull(), F.col("_offset"))
        .when(F.col("_abbr").isNotNull(), F.coalesce(named(F.col("_in")), named(F.col("_iv"))))
        .when(F.size("_in") > 0, F.array_max(off(F.col("_in"))))
        .otherwise(before)
    )
    both = both.withColumn("_used", used)
    status = (
        F.when(F.col("_v").isNull(), F.lit(None).cast("string"))
        .when(F.col("_epoch").isNotNull(), "epoch")
        .when(F.col("_local").isNull(), "unreadable")
        .when(F.col("_offset").isNotNull() | F.col("_abbr").isNotNull() & F.col("_used").isNotNull(), "offset")
        .when(F.col("_used").isNull(), "unknown_zone")
        .when(F.size("_in") > 1, "ambiguous")
        .when(F.size("_in") == 1, "zone")
        .otherwise("nonexistent")
    )
    return both.select("_row.*", F.coalesce(F.col("_epoch"), F.col("_local") - F.col("_used")).alias("epoch_us"), status.alias("time_status"))


def page_times(pages: DataFrame) -> DataFrame:
    """posted_at and deadline_at of web pages as instants: page_id, field, value, epoch_us, time_status.

    A page's newest crawl counts (see `newest`); one row for each page and field, also where the value is null.
    """
    return times_of(newest(pages, "page_id", "last_crawled_at", ["posted_at", "deadline_at", "site_zone", "site_locale"])).drop("site_zone", "site_locale")


def times_of(one: DataFrame) -> DataFrame:
    """The same of pages that have one row each: with site_zone and site_locale."""
    long = one.select(
        "page_id", "site_zone", "site_locale",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("posted_at", "deadline_at")])).alias("f"),
    ).select("page_id", "f.field", "f.value", "site_zone", "site_locale")
    return normalise_times(long, "value", "site_zone", "site_locale")
