"""Number and unit rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv
from factloom.functions.text import as_col, let, none_if_empty, quote, record, strip

FULL_WIDTH, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, ASCII_DIGITS)


def to_double(c: Column) -> Column:
    """Plain decimal text to double, NULL when it is not a number."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def number_pattern(units=fv.CELL_UNITS) -> str:
    return f"(-?\\d[\\d,]*(?:\\.\\d+)?)(?U:\\s*)({'|'.join(quote(u) for u in units)})?"


def number_unit(c: Column | str, units=fv.CELL_UNITS) -> Column:
    """First number in a text with its unit: struct<value double, unit string>."""
    # The match is found once; its parts are then read from a few characters.
    found = F.regexp_extract(
        F.replace(ascii_digits(as_col(c)), F.lit("，"), F.lit(",")), number_pattern(units), 0
    )
    return let(found, lambda m: split_number(m, units))


def split_number(match: Column, units) -> Column:
    """(value, unit) of a matched number; both NULL for an empty match."""
    pattern = number_pattern(units)
    # The digits of a match hold no white space and are not empty, so they are cast as they are.
    value = F.replace(F.regexp_extract(match, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = let(F.regexp_extract(match, pattern, 2), none_if_empty)
    return F.when(match != "", record(value=value, unit=unit)).otherwise(
        record(value=F.lit(None).cast("double"), unit=F.lit(None).cast("string")))


def canonical_value(value: Column, unit: Column, known: Column, canonical: Column,
                    to_unit: Column, mul: Column, div: Column) -> Column:
    """Converted (value, unit) given the joined vocabulary and factor columns of the row.

    ``known`` tells whether the field has an entry, ``canonical`` is its unit (maybe empty),
    the last three come from the factor row of (field, unit), NULL where there is none.
    """
    target = F.when(known, canonical).otherwise(unit)
    as_is = (
        value.isNull() | unit.isNull() | (unit == "") | target.isNull() | (target == "")
        | (unit == target)
    )
    out_value = F.when(as_is | to_unit.isNull(), value).otherwise(value * mul / div)
    out_unit = F.when(as_is, target).when(to_unit.isNull(), unit).otherwise(to_unit)
    return record(value=out_value, unit=out_unit)


def unit_compatible(unit: Column, canonical: Column, money=fv.MONEY_UNITS,
                    population=fv.POPULATION_UNITS, base="元", too_big=("亿元", "万亿元")) -> Column:
    """Whether a detected unit can belong to a field with the given canonical unit."""
    clash = (
        ((unit == "%") & (canonical != "%"))
        | (canonical.isin(*money) & unit.isin(*population))
        | (canonical.isin(*population) & unit.isin(*money))
        | ((canonical == base) & unit.isin(*too_big))
    )
    missing = unit.isNull() | (unit == "") | canonical.isNull() | (canonical == "")
    return F.when(missing, F.lit(True)).otherwise(~clash)


def find_num(c: Column | str, keyword: str, target: str = "", alternatives=(),
             magnitude=fv.UNIT_MAGNITUDE) -> Column:
    """Number next to a keyword (a regex without groups), scaled to the target unit."""
    text = ascii_digits(as_col(c))
    scale = magnitude.get(target, 1.0)
    units = list(dict.fromkeys([u for u in (target, *alternatives) if u] + [""]))
    number = "([\\d,]+\\.?\\d*)"
    found = []
    for unit in units:
        tail = quote(unit) if unit else "(?![\\u4e00-\\u9fff\\d])"
        after = f"{keyword}[^\\d]{{0,12}}{number}(?U:\\s*){tail}"
        before = f"{number}(?U:\\s*){tail}[^。；\\n]{{0,12}}?{keyword}"
        for pattern in (after, before):
            raw = to_double(none_if_empty(F.regexp_extract(text, pattern, 1)))
            found.append(raw * F.lit(magnitude.get(unit, 1.0)) / F.lit(scale))
    return F.coalesce(*found)


def format_value(c: Column | str) -> Column:
    """Integers without decimals, everything else with at most four."""
    v = as_col(c).cast("double")
    whole = v.cast("decimal(38,0)").cast("string")
    short = F.regexp_replace(F.format_string("%.4f", v), "\\.?0+$", "")
    return F.when(v.isNull(), F.lit("")).when(v == F.floor(v), whole).otherwise(short)


def numeric_text(c: Column) -> Column:
    """Cell text as a number when all of it is one (percent signs divide by 100)."""
    text = strip(c)
    percent = text.endswith("%")
    body = F.when(percent, F.left(text, F.length(text) - 1)).otherwise(text)
    body = F.replace(body, F.lit("，"), F.lit(""))
    value = to_double(body)
    return F.when(percent, value / 100.0).otherwise(value)


def cell_ref(row: Column, col: Column) -> Column:
    """A1 address; columns up to ZZZ."""
    n = col.cast("int")
    letter = lambda k: F.chr(65 + k)
    one = letter(n - 1)
    two = F.concat(letter(((n - 27) / 26).cast("int")), letter((n - 1) % 26))
    three = F.concat(
        letter(((n - 703) / 676).cast("int")),
        letter((((n - 703) % 676) / 26).cast("int")),
        letter((n - 1) % 26),
    )
    letters = F.when(n <= 26, one).when(n <= 702, two).otherwise(three)
    return F.concat(letters, row.cast("string"))
