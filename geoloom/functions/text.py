"""Text and number functions with the rendering rules of layer attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "<nil>"


def _number_text(value: Column) -> Column:
    """Shortest digits; an exponent of two digits or more below 1e-4 and from 1e6 on (1e+06, 1.5e-07)."""
    plain = value.cast("double").cast("string")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(plain, "^-", "")
    trimmed = F.regexp_replace(bare, r"\.0$", "")
    mantissa = F.regexp_replace(F.regexp_extract(bare, r"^([0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(bare, r"E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0.000"), F.replace(mantissa, F.lit("."), F.lit("")))
    digits = F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), "0+$", "")
    million = F.concat(
        F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.expr("''"), F.substring(digits, 2, 400))).otherwise(""), F.lit("e+06")
    )
    size = F.abs(value.cast("double"))
    text = (
        F.when(bare == "NaN", "NaN")
        .when(bare == "Infinity", F.when(sign == "-", "Inf").otherwise("+Inf"))
        .when(bare.contains("E") & (size >= 1e-4) & (size < 1), small)
        .when(bare.contains("E"), F.concat(mantissa, exponent))
        .when(size >= 1e6, million)
        .otherwise(trimmed)
    )
    return F.concat(sign, text)


def value_text(value: Column, kind: str) -> Column:
    """A value as text: ``true``/``false``, integers in decimals, doubles shortest, null as ``<nil>``."""
    if kind in ("double", "float"):
        text = _number_text(value)
    elif kind == "boolean":
        text = F.when(value, "true").otherwise("false")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), NIL).otherwise(text)


def kind_of(df, name: str) -> str:
    return dict(df.dtypes)[name]


def format_number(value: Column, decimals: int = 0) -> Column:
    """Thousands separated by commas; null for null, text that is no number, NaN and infinities."""
    if not 0 <= decimals <= 6:
        raise ValueError("decimals must be 0 to 6")
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, F.format_number(number, decimals))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty text."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])


def trim_space(value: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(value, r"^[\p{Z}\s\u0085]+", ""), r"[\p{Z}\s\u0085]+$", "")


def has_part(value: Column, part: Column | str, ignore_case: bool = False) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    a, b = (F.lower(value), F.lower(part)) if ignore_case else (value, part)
    return F.coalesce(F.contains(a, b), F.lit(False))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_space(text) == "")
