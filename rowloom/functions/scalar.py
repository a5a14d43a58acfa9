"""Scalar functions of the dialect: name -> function of Columns. Everything is a Catalyst expression.

Durations are BIGINT milliseconds. Null in gives null out unless said otherwise. Functions whose argument is outside their
domain raise, as the dialect asks, instead of Spark's null or NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Function = Callable[..., Column]
UNIT_MS = {"MILLISECONDS": 1, "SECONDS": 1000, "MINUTES": 60_000, "HOURS": 3_600_000, "DAYS": 86_400_000}
DAY_MS = UNIT_MS["DAYS"]
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def _within(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok.isNull(), None).when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("double"))


def millis(t: Column) -> Column:
    """Epoch milliseconds of a date or timestamp, read as UTC."""
    return F.unix_millis(t.cast("timestamp"))


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n.cast("bigint")).cast("timestamp_ntz")


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def divide(x: Column, y: Column) -> Column:
    """Integral division: truncated quotient; a zero divisor raises."""
    return F.call_function("div", x, y)


def substring(s: Column, start: Column, count: Column | None = None) -> Column:
    return F.substring(s, start, F.length(s) if count is None else count)


def _replace_first(s: Column, pattern: Column, new: Column) -> Column:
    """The first match alone is replaced; $1 and so on in `new` stand for its groups."""
    start, found = F.regexp_instr(s, pattern), F.regexp_substr(s, pattern)
    replaced = F.regexp_replace(found, F.concat(F.lit("^(?:"), pattern, F.lit(")$")), new)
    tail = F.substring(s, start + F.length(found), F.length(s))
    return F.when(start > 0, F.concat(F.substring(s, F.lit(1), start - 1), replaced, tail)).otherwise(s)


def clock_millis(t: Column) -> Column:
    """Milliseconds of a time of day since midnight."""
    return F.call_function("time_diff", F.lit("MILLISECOND"), F.lit("00:00:00").cast("time"), t)


def clock(ms: Column) -> Column:
    """The time of day so many milliseconds after midnight; days are left out."""
    ms = F.pmod(ms.cast("bigint"), F.lit(DAY_MS))
    seconds = (F.pmod(ms, F.lit(60_000)) / 1000).cast("decimal(16,6)")
    return F.call_function("make_time", F.floor(ms / 3_600_000).cast("int"), F.pmod(F.floor(ms / 60_000), F.lit(60)).cast("int"), seconds)


def strictly(pick: Function) -> Function:
    """GREATEST and LEAST are null if any argument is."""

    def build(*xs: Column) -> Column:
        nothing = reduce(lambda a, b: a | b, [x.isNull() for x in xs])
        return F.when(~nothing, pick(*xs) if len(xs) > 1 else xs[0])

    return build


def month_number(m: Column) -> Column:
    """A month's number from its English name (three letters are enough) or its number."""
    names = F.array(*[F.lit(x[:3]) for x in MONTHS])
    position = F.array_position(names, F.substring(F.upper(m.cast("string")), 1, 3))
    return F.when(position > 0, position.cast("int")).otherwise(m.try_cast("int"))


def date_part(field: str, d: Column) -> Column:
    """The named part; weeks start on Sunday, hours run from 0 to 11, months from 1."""
    first = F.dayofweek(F.trunc(d, "month"))
    parts = {
        "QUARTER": lambda: F.quarter(d), "MONTH": lambda: F.month(d), "YEAR": lambda: F.year(d), "DAY_OF_MONTH": lambda: F.dayofmonth(d), "DAY_OF_WEEK": lambda: F.dayofweek(d),
        "DAY_OF_YEAR": lambda: F.dayofyear(d), "WEEK_OF_MONTH": lambda: F.floor((F.dayofmonth(d) + first - 2) / 7) + 1, "HOUR": lambda: F.hour(d) % 12, "MINUTE": lambda: F.minute(d),
        "SECOND": lambda: F.second(d), "MILLISECOND": lambda: F.pmod(millis(d), F.lit(1000)),
    }
    return parts[field.upper()]().cast("int")


def date_partstr(field: str, d: Column, style: str = "LONG") -> Column:
    """A part as its display name; parts without names give their number."""
    long, name = style.upper() == "LONG", field.upper()
    if name == "QUARTER":
        return F.concat(F.lit("QUARTER" if long else "Q"), F.quarter(d).cast("string"))
    if name in ("MONTH", "DAY_OF_WEEK"):
        letter = "M" if name == "MONTH" else "E"
        return F.date_format(d, letter * (4 if long else 3))
    return date_part(name, d).cast("string")


def units(ms: int) -> Function:
    return lambda n=None: (F.lit(1) if n is None else n).cast("bigint") * F.lit(ms).cast("bigint")


FUNCTIONS: dict[str, Function] = {
    # numbers
    "ABS": F.abs,
    "ROUND": lambda x: F.round(x, 0),
    "FLOOR": lambda x: F.floor(x).cast("double"),
    "CEIL": lambda x: F.ceil(x).cast("double"),
    "TRUNC": truncate,
    "POWER": F.pow,
    "SQRT": F.sqrt,
    "SIGN": lambda x: F.signum(x).cast("smallint"),
    "DIV": lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(truncate(x / F.nullif(y, F.lit(0))).cast("bigint")),
    "MOD": lambda x, y: x % y,
    "EXP": F.exp,
    "LN": lambda x: _within(x > 0, F.ln(x), "logarithm of a number that is not positive"),
    "LOG10": lambda x: _within(x > 0, F.log10(x), "logarithm of a number that is not positive"),
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "ASIN": lambda x: _within(F.abs(x) <= 1, F.asin(x), "arc sine of a number outside -1 .. 1"),
    "ACOS": lambda x: _within(F.abs(x) <= 1, F.acos(x), "arc cosine of a number outside -1 .. 1"),
    "ATAN": F.atan,
    "ATAN2": F.atan2,
    "PI": F.pi,
    "RANDOM": lambda: F.rand(),
    "RANDGAUSSIAN": lambda dev=None: F.randn() * (F.lit(1.0) if dev is None else dev),
    "RANDOMINT": lambda n: F.floor(F.rand() * n).cast("int"),
    "RANDOMSTR": lambda n: F.randstr(n),
    "SCALE": lambda x, s: F.round(x.cast("double"), s),
    # text
    "CONCAT": lambda *xs: F.concat(*[x.cast("string") for x in xs]),
    "CHAR_LENGTH": F.char_length,
    "LOWER": F.lower,
    "UPPER": F.upper,
    "TRIM": lambda s: F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
    "SUBSTRING": substring,
    "SUBSTRING_REGEX": F.regexp_substr,
    "STRPOS": lambda s, part: F.call_function("instr", s, part),
    "REPLACE": F.replace,
    "REPLACEALL": F.regexp_replace,
    "REPLACEFIRST": lambda s, pattern, new: _replace_first(s, pattern, new),
    # choice
    "COALESCE": F.coalesce,
    "NULLIF": F.nullif,
    "GREATEST": strictly(F.greatest),
    "LEAST": strictly(F.least),
    # dates and times
    "CURRENT_DATE": F.current_date,
    "CURRENT_TIMESTAMP": F.current_timestamp,
    "CURRENT_TIME": lambda: F.call_function("current_time"),
    "DATE_ADD": lambda d, n: F.date_add(d, n.cast("int")),
    "TIMESTAMP_ADD": lambda t, n: from_millis(millis(t) + n),
    "TIME_ADD": lambda t, n: from_millis(millis(t) + n),
    "CLOCK_ADD": lambda t, n: clock(clock_millis(t) + n),
    "CLOCK_DIFF": lambda a, b: clock_millis(a) - clock_millis(b),
    "DATE_DIFF": lambda a, b: F.datediff(a, b).cast("bigint") * DAY_MS,
    "TIMESTAMP_DIFF": lambda a, b: millis(a) - millis(b),
    "TIME_DIFF": lambda a, b: millis(a) - millis(b),
    "TIMESTAMP_UNIX": millis,
    "TODATE": lambda s, fmt: F.call_function("to_date", s, fmt),
    "TODATE_PARTS": lambda y, m, d: F.make_date(y, month_number(m), d),
    "TOTIMESTAMP": lambda s, fmt: F.call_function("to_timestamp", s, fmt).cast("timestamp_ntz"),
    "TOTIMESTAMP_PARTS": lambda y, m, d, h, mi, s, ms: from_millis(millis(F.make_date(y, month_number(m), d)) + ((h * 60 + mi) * 60 + s).cast("bigint") * 1000 + ms),
    "TOTIME": lambda s, fmt: F.call_function("to_time", s, fmt),
    "TOTIME_PARTS": lambda h, m, s, ms: F.call_function("make_time", h, m, (s + ms / 1000).cast("decimal(16,6)")),
    "TOTIMEZONE": lambda zone, t: F.from_utc_timestamp(t.cast("timestamp"), zone).cast("timestamp_ntz"),
    "TOUTC": lambda zone, t: F.to_utc_timestamp(t.cast("timestamp"), zone).cast("timestamp_ntz"),
    **{name: units(ms) for name, ms in UNIT_MS.items()},
}
for alias, name in {"CEILING": "CEIL", "TRUNCATE": "TRUNC", "LOG": "LN", "RANDUNIFORM": "RANDOM", "RANDNORMAL": "RANDGAUSSIAN", "WHITENOISE": "RANDGAUSSIAN", "RANDINTUNIFORM": "RANDOMINT", "CHARACTER_LENGTH": "CHAR_LENGTH", "NOW": "CURRENT_TIMESTAMP"}.items():
    FUNCTIONS[alias] = FUNCTIONS[name]


def scalar(name: str, *arguments: Column) -> Column:
    if name.upper() not in FUNCTIONS:
        raise ValueError(f"unknown function {name}")
    return FUNCTIONS[name.upper()](*arguments)


# Predicates that Spark's own operators do not spell.


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return ((x >= a) & (x <= b)) | ((x >= b) & (x <= a))


def similar_to(s: Column, pattern: str) -> Column:
    """The whole string matches the regular expression."""
    return s.rlike(f"^(?:{pattern})$")


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def quantified(x: Column, op: Callable[[Column, Column], Column], values: list[Column], every: bool) -> Column:
    """x op ALL (values) or x op ANY (values), with three-valued logic."""
    tests = [op(x, v) for v in values]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests, F.lit(every))


def shift(moment: Column, kind: str, n: Column) -> Column:
    """date + n is n days later, timestamp + n is n milliseconds later."""
    return F.date_add(moment, n.cast("int")) if kind == "date" else FUNCTIONS["TIMESTAMP_ADD"](moment, n)
