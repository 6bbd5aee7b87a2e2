"""Expressions with graph-query semantics, as Columns.

Comparison is three-valued: null, and NaN, compare with nothing. Arithmetic
never fails: overflow and division by zero are null. Lists and strings count
from 0. All of it stays in the JVM, but for Unicode normalisation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_LEAST = -(2**63)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Comparison and logic


def compare(op: str, a, b, floats: bool = False) -> Column:
    """a op b for = <> < <= > >=; floats: the sides may be NaN."""
    a, b = _c(a), _c(b)
    out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(None).cast("boolean")).otherwise(out) if floats else out


def equatable(op: str, a, b) -> Column:
    """= or <> of maps, paths and durations (structs): what is not equal is unknown."""
    same = _c(a) == _c(b)
    return F.when(same, F.lit(op == "="))


def list_equal(a, b) -> Column:
    """= of lists: a null element makes it unknown, unless the lists differ elsewhere."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(a, b, lambda x, y: x == y)
    return F.when(F.size(a) != F.size(b), F.lit(False)).when(F.exists(pairs, lambda x: ~x), F.lit(False)).when(F.exists(pairs, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(True)))


def xor(a: Column, b: Column) -> Column:
    return a != b


def is_true(a: Column) -> Column:
    """IS TRUE: null is not."""
    return F.coalesce(a, F.lit(False))


def is_false(a: Column) -> Column:
    return F.coalesce(~a, F.lit(False))


def is_in(x, values) -> Column:
    """x IN list: a miss among elements of which one is null is unknown."""
    if isinstance(values, Column):
        x = _c(x)
        return F.when(x.isNotNull(), F.exists(values, lambda v: v == x))
    return _c(x).isin(*values) if values else F.when(_c(x).isNotNull(), F.lit(False))


_TYPES = {"integer": "tinyint|smallint|int|bigint", "float": "float|double", "string": "string", "boolean": "boolean", "list": "array<.*>"}


def is_typed(x, kind: str) -> Column:
    """IS TYPED integer, float, string, boolean or list; a null is of none. Points in time are integers here."""
    x = _c(x)
    return F.typeof(x).rlike(f"^({_TYPES[kind.lower()]})$") & x.isNotNull()


def element_id(c, rel: bool = False) -> Column:
    """Text of a node's id; of a relationship's position with an r before it."""
    text = _c(c).cast("long").cast("string")
    return F.concat(F.lit("r"), text) if rel else text


def all_of(values: Column, holds) -> Column:
    return F.forall(values, holds)


def any_of(values: Column, holds) -> Column:
    return F.exists(values, holds)


def none_of(values: Column, holds) -> Column:
    return ~F.exists(values, holds)


def single(values: Column, holds) -> Column:
    """Whether exactly one element holds; unknown if nulls leave it open."""
    yes = F.size(F.filter(values, lambda v: F.coalesce(holds(v), F.lit(False))))
    open_ = F.size(F.filter(values, lambda v: holds(v).isNull()))
    return F.when(values.isNotNull(), F.when(yes > 1, F.lit(False)).when(open_ > 0, F.lit(None).cast("boolean")).otherwise(yes == 1))


# Numbers


def add(a, b) -> Column:
    return F.try_add(_c(a), _c(b))


def subtract(a, b) -> Column:
    return F.try_subtract(_c(a), _c(b))


def multiply(a, b) -> Column:
    return F.try_multiply(_c(a), _c(b))


def divide(a, b) -> Column:
    """Float division; null by 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def int_divide(a, b) -> Column:
    """Division of integers, cut towards 0; null by 0 and where it leaves 64 bits."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    fine = (b != 0) & ~((a == _LEAST) & (b == -1))
    safe = F.when(fine, b)
    whole = (a - a % safe).cast("decimal(38,0)") / safe.cast("decimal(38,0)")
    return F.when(fine, whole.cast("long"))


def modulo(a, b) -> Column:
    """Remainder with the sign of the dividend; null by 0."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.try_mod(a, b))


def negate(a) -> Column:
    a = _c(a)
    return F.try_subtract(F.lit(0), a)


def absolute(a) -> Column:
    """Null for the least 64-bit integer."""
    a = _c(a)
    return F.when(a != F.lit(_LEAST), F.abs(F.when(a != F.lit(_LEAST), a)))


def ceiling(a) -> Column:
    return F.ceil(_c(a)).cast("double")


def floor(a) -> Column:
    return F.floor(_c(a)).cast("double")


def round_half_away(a) -> Column:
    return F.round(_c(a).cast("double"))


def sign(a) -> Column:
    return F.signum(_c(a).cast("double")).cast("long")


def square_root(a) -> Column:
    return F.sqrt(_c(a).cast("double"))


def power(a, b) -> Column:
    return F.pow(_c(a).cast("double"), _c(b).cast("double"))


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


_GUARDED = {"exp": F.exp, "ln": F.log, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "degrees": F.degrees, "radians": F.radians}


def guarded(name: str, a) -> Column:
    """exp ln log10 sin cos tan asin acos atan degrees radians, null where they have no finite value."""
    return finite(_GUARDED[name](_c(a).cast("double")))


# Strings


def text_length(a) -> Column:
    return F.char_length(_c(a))


def left(s, n) -> Column:
    """First n characters; null for a negative n."""
    n = _c(n)
    return F.when(n >= 0, F.substring(_c(s), F.lit(1), F.greatest(n, F.lit(0))))


def right(s, n) -> Column:
    s, n = _c(s), _c(n)
    return F.when(n == 0, F.when(s.isNotNull(), F.lit(""))).when(n > 0, F.right(s, n))


def substring(s, start, length=None) -> Column:
    """From a start counted from 0; empty beyond the end, null for negatives."""
    s, start = _c(s), _c(start)
    length = F.char_length(s) if length is None else _c(length)
    return F.when((start >= 0) & (length >= 0), F.substring(s, F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))))


_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def trim(s) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(_c(s), f"^{_BLANKS}|{_BLANKS}$", "")


def trim_left(s) -> Column:
    """Without spaces, tabs and line ends at the start."""
    return F.ltrim(_c(s), F.lit(" \t\n\r"))


def trim_right(s) -> Column:
    return F.rtrim(_c(s), F.lit(" \t\n\r"))


@pandas_udf(T.StringType())
def _normalised(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or f not in ("NFC", "NFD", "NFKC", "NFKD") else unicodedata.normalize(f, t) for t, f in zip(text, form, strict=True)], dtype=object)


def normalize(s, form: str = "NFC") -> Column:
    """Unicode normalisation; null for an unknown form. Every text goes through a Pandas UDF: the engine has no such function."""
    s = _c(s)
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        return F.lit(None).cast("string")
    return _normalised(s, F.lit(form))


def is_normalized(s, form: str = "NFC") -> Column:
    return normalize(s, form) == _c(s)


def concat(a, b) -> Column:
    """Strings or lists; null if either is."""
    return F.concat(_c(a), _c(b))


# Lists


def item(values, i) -> Column:
    """Element i from 0, negative from the end; null beyond."""
    values, i = _c(values), _c(i).cast("int")
    return F.when(i >= 0, F.get(values, i)).otherwise(F.get(values, F.size(values) + i))


def items(values, low=None, high=None) -> Column:
    """Elements low up to high, which is left out; held to the list, negatives from the end."""
    values = _c(values)
    n = F.size(values)
    place = lambda x, empty: F.lit(empty) if x is None else _c(x).cast("int")
    hold = lambda x: F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n)
    a, b = hold(place(low, 0)), n if high is None else hold(place(high, 0))
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def number_range(low, high, step=1) -> Column:
    """low..high, both in; empty if the step leads away, null for a step of 0."""
    low, high, step = _c(low).cast("long"), _c(high).cast("long"), _c(step).cast("long")
    leads = ((step > 0) & (low <= high)) | ((step < 0) & (low >= high))
    some = F.sequence(F.when(leads, low), F.when(leads, high), F.when(leads, step))
    return F.when(step == 0, F.lit(None)).when(leads, some).otherwise(F.when(low.isNotNull() & high.isNotNull() & step.isNotNull(), F.expr("cast(array() as array<bigint>)")))


def head(values) -> Column:
    return F.get(_c(values), F.lit(0))


def last(values) -> Column:
    values = _c(values)
    return F.get(values, F.size(values) - 1)


def tail(values) -> Column:
    values = _c(values)
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


# Conversion


def to_float(a, text: bool = False) -> Column:
    a = _c(a)
    return F.trim(a).try_cast("double") if text else a.cast("double")


def to_integer(a, text: bool = False) -> Column:
    """Cut towards 0; a text that is no integer is read as a float first."""
    a = _c(a)
    if not text:
        return a.try_cast("long")
    return F.coalesce(F.trim(a).try_cast("long"), F.trim(a).try_cast("double").try_cast("long"))


def to_boolean(a) -> Column:
    """true or false, in any case, with blanks around; else null."""
    t = F.lower(F.trim(_c(a)))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def float_text(a) -> Column:
    """A float as text: shortest digits, no exponent, a .0 on whole numbers, inf -inf NaN."""
    a = _c(a).cast("double")
    plain = a.cast("string")
    mantissa, exponent = F.regexp_extract(plain, r"^-?([\d.]+)E", 1), F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    digits, point = F.regexp_replace(mantissa, r"\.0?$|\.", ""), F.lit(1)
    sign_ = F.when(a < 0, "-").otherwise("")
    big = F.concat(F.rpad(digits, F.greatest(exponent + point, F.length(digits)), "0"), F.lit(""))
    whole = F.concat(sign_, F.when(F.length(digits) <= exponent + 1, F.concat(big, F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))))
    small = F.concat(sign_, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return (
        F.when(F.isnan(a), "NaN").when(a == float("inf"), "inf").when(a == float("-inf"), "-inf")
        .when(F.contains(plain, F.lit("E")), F.when(exponent > 0, whole).otherwise(small)).otherwise(plain)
    )


# Order


def ascending(c) -> Column:
    """Nulls last."""
    return F.asc_nulls_last(c)


def descending(c) -> Column:
    """The reverse of ascending: nulls first."""
    return F.desc_nulls_first(c)
