"""Points in time as epoch milliseconds (long, UTC) and durations as structs of months, days, millis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlark.functions.scalar import add, int_divide, multiply, subtract

DAY = 86_400_000
#: The calendar repeats after 400 years. Spark's own dates serve the years 2000..2399; others are moved there and back.
CYCLE_YEARS, CYCLE_DAYS, DAY_OF_2000 = 400, 146_097, 10_957
FAR_YEAR = 300_000_000
_DATE = r"^([+-]?\d{1,9})-(\d{1,2})-(\d{1,2})"
_ISO = _DATE + r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"


def _floor(a: Column, n: int) -> Column:
    """Whole multiples of n at or below a, in long arithmetic; a may lie n * 2^37 from 0."""
    return F.call_function("div", a + n * 2**37, F.lit(n).cast("long")) - 2**37


def _day(millis: Column) -> Column:
    return _floor(F.shiftright(millis.cast("long"), 10), DAY >> 10)


def _date(day: Column) -> tuple[Column, Column]:
    """Whole cycles from 2000 on, and the date of that day within one."""
    cycles = _floor(day.cast("long") - DAY_OF_2000, CYCLE_DAYS)
    return cycles, F.date_from_unix_date((day - cycles * CYCLE_DAYS).cast("int"))


def component(millis: Column, unit: str) -> Column:
    """year month day hour minute second millisecond epochMillis epochSeconds; floors before 1970."""
    day, within = _day(millis), F.pmod(millis, F.lit(DAY))
    cycles, date = _date(day)
    return {
        "year": F.year(date).cast("long") + cycles * CYCLE_YEARS, "month": F.month(date).cast("long"), "day": F.dayofmonth(date).cast("long"),
        "hour": F.floor(within / 3_600_000), "minute": F.floor(within / 60_000) % 60, "second": F.floor(within / 1000) % 60,
        "millisecond": within % 1000, "epochMillis": millis, "epochSeconds": F.call_function("div", millis - F.pmod(millis, F.lit(1000)), F.lit(1000).cast("long")),
    }[unit]


def from_parts(year, month, day, hour=0, minute=0, second=0, millisecond=0) -> Column:
    """Epoch milliseconds; null for parts out of range, or beyond 64 bits. Days up to 31 pass in every month and run over."""
    y, m, d, h, mi, s, ms = ((c if isinstance(c, Column) else F.lit(c)).cast("long") for c in (year, month, day, hour, minute, second, millisecond))
    fine = m.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & ms.between(0, 999) & y.between(-FAR_YEAR, FAR_YEAR)
    y, m = F.when(fine, y), F.when(fine, m)
    cycles = _floor(y - 2000, CYCLE_YEARS)
    day = F.unix_date(F.make_date((y - cycles * CYCLE_YEARS).cast("int"), m.cast("int"), F.lit(1))) + cycles * CYCLE_DAYS + d - 1
    return add(multiply(day, F.lit(DAY).cast("long")), h * 3_600_000 + mi * 60_000 + s * 1000 + ms)


def parse_iso(text: Column) -> Column:
    """Epoch milliseconds of an ISO date or date-time; a zone is read over. Null for anything else."""
    t = F.trim(text)
    part = lambda i, empty: F.when(F.regexp_extract(t, _ISO, i) == "", F.lit(empty)).otherwise(F.regexp_extract(t, _ISO, i)).try_cast("int")
    millis = F.rpad(F.substring(F.regexp_extract(t, _ISO, 7), 1, 3), 3, "0").try_cast("int")
    return F.when(t.rlike(_ISO), from_parts(part(1, "0"), part(2, "0"), part(3, "0"), part(4, "0"), part(5, "0"), part(6, "0"), millis))


def render_date(millis: Column) -> Column:
    """YYYY-MM-DD; years before 0 have a sign, those after 9999 more digits."""
    return F.when(millis.isNotNull(), F.format_string("%04d-%02d-%02d", *[component(millis, unit) for unit in ("year", "month", "day")]))


def render_datetime(millis: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS, with .mmm where it is not 0."""
    clock = F.format_string("T%02d:%02d:%02d", component(millis, "hour"), component(millis, "minute"), component(millis, "second"))
    ms = component(millis, "millisecond")
    return F.concat(render_date(millis), clock, F.when(ms > 0, F.format_string(".%03d", ms)).otherwise(""))


def date_of(millis: Column) -> Column:
    """Midnight of the day, in UTC."""
    return _day(millis) * DAY


def duration(years=0, months=0, weeks=0, days=0, hours=0, minutes=0, seconds=0, milliseconds=0) -> Column:
    y, mo, w, d, h, mi, s, ms = (c if isinstance(c, Column) else F.lit(c).cast("long") for c in (years, months, weeks, days, hours, minutes, seconds, milliseconds))
    return F.struct((y * 12 + mo).cast("long").alias("months"), (w * 7 + d).cast("long").alias("days"), (h * 3_600_000 + mi * 60_000 + s * 1000 + ms).cast("long").alias("millis"))


_DURATION = r"^([+-]?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:[.,](\d{1,9}))?S)?)?$"


def parse_duration(text: Column) -> Column:
    """An ISO duration, with an optional sign; null for anything else, and for one without a part."""
    sign = F.when(F.regexp_extract(text, _DURATION, 1) == "-", F.lit(-1)).otherwise(F.lit(1)).cast("long")
    part = lambda i: sign * F.coalesce(F.regexp_extract(text, _DURATION, i).try_cast("long"), F.lit(0))
    fraction = sign * F.coalesce(F.rpad(F.substring(F.regexp_extract(text, _DURATION, 9), 1, 3), 3, "0").try_cast("long"), F.lit(0))
    fine = text.rlike(_DURATION) & text.rlike(r"\d[A-Z]")
    return F.when(fine, duration(part(2), part(3), part(4), part(5), part(6), part(7), part(8), fraction))


def duration_component(d: Column, unit: str) -> Column:
    """Each unit of its own group: months, days and millis do not run into each other."""
    months, days, millis = d["months"], d["days"], d["millis"]
    whole = lambda a, n: F.when(a >= 0, F.floor(a / n)).otherwise(-F.floor(-a / n))
    return {"years": whole(months, 12), "quarters": whole(months, 3), "months": months, "weeks": whole(days, 7), "days": days, "hours": whole(millis, 3_600_000), "minutes": whole(millis, 60_000), "seconds": whole(millis, 1000), "milliseconds": millis}[unit]


def plus(millis: Column, d: Column, sign: int = 1) -> Column:
    """A point moved by a duration: months first, the day held to the month's end, then days, then milliseconds."""
    cycles, date = _date(_day(millis))
    months = d["months"] * sign
    turns = _floor(months, CYCLE_YEARS * 12)
    moved = F.unix_date(F.add_months(date, (months - turns * CYCLE_YEARS * 12).cast("int"))) + (cycles + turns) * CYCLE_DAYS
    return (moved + d["days"] * sign) * DAY + F.pmod(millis, F.lit(DAY)) + d["millis"] * sign


def between(a: Column, b: Column) -> Column:
    """a - b as a duration of milliseconds."""
    return duration(milliseconds=a - b)


def _each(part) -> Column:
    """A duration of the parts that `part` makes of each unit; null if one of them is."""
    parts = [part(unit) for unit in ("months", "days", "millis")]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(whole, F.struct(*[p.cast("long").alias(unit) for p, unit in zip(parts, ("months", "days", "millis"), strict=True)]))


def add_durations(a: Column, b: Column) -> Column:
    """Unit by unit; null beyond 64 bits."""
    return _each(lambda unit: add(a[unit], b[unit]))


def subtract_durations(a: Column, b: Column) -> Column:
    return _each(lambda unit: subtract(a[unit], b[unit]))


def scale_duration(d: Column, n) -> Column:
    """Each unit times a whole number; null beyond 64 bits."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    return _each(lambda unit: multiply(d[unit], n))


def divide_duration(d: Column, n) -> Column:
    """Each unit divided by a whole number, cut towards 0; null by 0. Nothing is carried from unit to unit."""
    return _each(lambda unit: int_divide(d[unit], n))
