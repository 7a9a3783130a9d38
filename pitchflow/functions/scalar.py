"""Scalar rules that several operators share, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters_with_accents() -> tuple[str, str]:
    """The lower-case letters that are a letter and accents, from the rule of canonical decomposition, and those letters."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(base) == 1 and base != c and c == c.lower():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _letters_with_accents()


def safe_div(n: Column, d: Column) -> Column:
    """n / d, 0 when d is 0 or null."""
    return F.when((d == 0) | d.isNull(), F.lit(0.0)).otherwise(n / d)


def third(x: Column, names: tuple[str, str, str]) -> Column:
    """Thirds of the pitch; a missing place counts as the middle."""
    return F.when(x.isNull(), names[1]).when(x < 100 / 3, names[0]).when(x < 200 / 3, names[1]).otherwise(names[2])


def cell(v: Column, n: int) -> Column:
    """Grid cell of a coordinate in 0..100."""
    return F.least(F.floor(v / 100 * n), F.lit(n - 1)).cast("bigint")


def in_box(x: Column, y: Column) -> Column:
    return (x >= 83) & y.between(21.1, 78.9)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clip_range(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(x: Column, *steps: tuple[float, str], default: str) -> Column:
    """The first label whose threshold x reaches, from the highest down."""
    out = None
    for limit, label in steps:
        out = F.when(x >= limit, label) if out is None else out.when(x >= limit, label)
    return out.otherwise(default)


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def to_number(text: Column) -> Column:
    """Trimmed text as a double: decimal commas accepted; empty, unreadable and non-finite values are null."""
    v = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def normal_name(name: Column) -> Column:
    """Lower case, single spaces, letters without their accents."""
    plain = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clip_text(text: Column, n: int) -> Column:
    """Single spaces, cut to n characters with '...' behind what was cut."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def clock(period: Column, minute: Column, second: Column, offset_2h: int = 0) -> Column:
    """Absolute second of a match; offset_2h minutes are added in the second half."""
    return (minute + F.when(period == "2H", offset_2h).otherwise(0)) * 60 + second


def to_sentence(items: Column, most: int = 5) -> Column:
    """The first items as 'a, b, and c'; 'none' without any."""
    i = F.slice(items, 1, most)
    n = F.size(i)
    head = F.concat(F.array_join(F.slice(i, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(i, -1))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "none").when(n == 1, F.get(i, F.lit(0))).when(n == 2, F.array_join(i, " and ")).otherwise(head)


def iso_parts(date: Column) -> dict[str, Column]:
    """ISO year, ISO week and weekday (Monday is 0)."""
    return {"iso_year": F.extract(F.lit("YEAROFWEEK"), date).cast("bigint"), "iso_week": F.weekofyear(date).cast("bigint"), "weekday": F.weekday(date).cast("bigint")}


def all_integers(value: Column) -> Column:
    """Aggregate: whether every value that is there is a whole number."""
    return F.coalesce(F.bool_and(value == F.floor(value)), F.lit(True))


def metric_label(name: Column, labels: dict[str, str] | None = None) -> Column:
    """A camelCase name as words with a capital first, unless the labels give another."""
    spaced = F.trim(F.regexp_replace(name, r"(?<!^)([A-Z])", " $1"))
    label = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), name), label) if labels else label


def number_text(x: Column, digits: int, default: str = "n/a") -> Column:
    """A number with so many digits, half up; the default where there is none."""
    return F.coalesce(F.round(x + 3.3 * 10.0 ** (-digits - 4), digits).cast(f"decimal(38,{digits})").cast("string"), F.lit(default))


def text_or(text: Column, default: str = "n/a") -> Column:
    """Trimmed text, the default where there is none."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))
