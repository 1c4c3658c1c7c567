"""Column helpers shared by the operators: text, numbers, dates, exact money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import DATE_FORMATS, PLACEHOLDERS

EPS = 1e-6
TICK = 10_000

#: How known dates are read without a formatter: a shape that only texts with a possible day and month have, and the places of
#: year, month and day in it. A formatter costs several times as much, and an exception for each text that it cannot read.
_DAY, _MONTH = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])"
_NUMERIC = {
    DATE_FORMATS[0]: (rf"^{_DAY}/{_MONTH}/(\d{{4}})\z", "$3-$2-$1T"),
    DATE_FORMATS[1]: (rf"^{_DAY}-{_MONTH}-(\d{{4}})\z", "$3-$2-$1T"),
    DATE_FORMATS[2]: (rf"^(\d{{4}})-{_MONTH}-{_DAY}\z", "$1-$2-$3T"),
}
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAMED = {DATE_FORMATS[3]: ",".join(m[:3] for m in _MONTHS), DATE_FORMATS[4]: ",".join(_MONTHS)}


def ticks(price: Column) -> Column:
    """Price in ten-thousandths. Whole numbers add up exactly whatever order tasks finish in."""
    return F.round(price * TICK).cast("bigint")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def name_key(c: Column | str) -> Column:
    """Match key of a name: case and outer blanks do not count."""
    return F.lower(F.trim(c))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\w]", "")


def is_placeholder(c: Column | str) -> Column:
    return F.coalesce(name_key(c).isin(*PLACEHOLDERS), F.lit(True))


def contains_ci(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(text)))


def to_number(c: Column | str, default: float | None = None) -> Column:
    """Number out of a price text: only digits, dots and commas survive, commas are dropped."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), ",", "")
    value = digits.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def to_int(c: Column | str, default: int | None = None) -> Column:
    value = F.floor(to_number(c)).cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default))


def _date_of(text: Column, shape: str, form: str) -> Column:
    """Date of a text that has the shape, by the format. The known formats are put as ISO text, which casts by itself; the T
    ends the day, so that a line end behind it is no part of a date."""
    if (shape, form) in _NUMERIC:
        strict, iso = _NUMERIC[shape, form]
        return F.when(text.rlike(strict), F.regexp_replace(text, strict, iso).try_cast("date"))
    if (shape, form) in _NAMED:
        month = F.find_in_set(F.lower(F.split_part(text, F.lit(" "), F.lit(2))), F.lit(_NAMED[shape, form]))
        iso = F.concat(F.split_part(text, F.lit(" "), F.lit(3)), F.lit("-"), month.cast("string"), F.lit("-"), F.split_part(text, F.lit(" "), F.lit(1)), F.lit("T"))
        return F.when(text.rlike(shape) & (month > 0), iso.try_cast("date"))
    return F.when(text.rlike(shape), F.try_to_date(text, form))


def to_date_any(c: Column | str, as_of: str | None = None, formats: tuple[tuple[str, str], ...] = DATE_FORMATS) -> Column:
    """Date by the first format that reads the text, else ``as_of``.

    A format is only tried on text of its shape: a failed parse costs far more than the check.
    """
    text = F.trim(c)
    tries = [_date_of(text, shape, f) for shape, f in formats]
    if as_of is not None:
        tries.append(F.lit(as_of).cast("date"))
    return F.coalesce(*tries)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def substrings(c: Column) -> Column:
    """Every distinct substring of a short name, so that containment becomes an equality."""
    size = F.length(c)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(c, i, n)),
    )))


def one_of(df: DataFrame, *names: str) -> Column:
    """First non-NULL among the columns of ``df`` that match the alias list; case does not count."""
    wanted = list(dict.fromkeys(n.lower() for n in names))
    present = [F.col(f"`{c}`") for n in wanted for c in df.columns if c.lower() == n]
    return F.coalesce(*present) if present else F.lit(None)


def one_row(df: DataFrame) -> dict[str, Column]:
    """The row of a one-row frame as typed literals, so that a plan which uses many of its fields does not hold as many copies of the frame's."""
    row = df.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in df.schema.fields}
