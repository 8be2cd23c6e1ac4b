"""Date, year and requirement-text rules as Column expressions. Dates are ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv
from factloom.functions.numbers import ascii_digits, to_double
from factloom.functions.text import as_col, let, none_if_empty, quote, record, strip

ISO_LIKE = "((?:19|20)\\d{2})[/\\-](\\d{1,2})[/\\-](\\d{1,2})"
YEAR_MARK = "((?:19|20)\\d{2})年"
EPOCH = "1899-12-30"


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def iso_of(c: Column) -> Column:
    """ISO date of the first Y-M-D or Y/M/D in a text; NULL without one."""
    found = none_if_empty(F.regexp_extract(c, ISO_LIKE, 0))
    padded = F.regexp_replace(found, "([/\\-])(\\d)(?=[/\\-]|$)", "$10$2")
    return F.translate(padded, "/", "-")


def serial_to_iso(days: Column) -> Column:
    """Spreadsheet day number 1–200 000 to an ISO date."""
    ok = (days >= 1) & (days <= 200000)
    date = F.date_add(F.lit(EPOCH).cast("date"), F.when(ok, F.floor(days)).cast("int"))
    return F.when(ok, date.cast("string"))


def infer_year(c: Column | str, pattern: str = YEAR_MARK) -> Column:
    text = as_col(c)
    # Only texts with full-width digits are rewritten.
    plain = F.when(text.rlike("[０-９]"), ascii_digits(text)).otherwise(text)
    return none_if_empty(F.regexp_extract(plain, pattern, 1)).try_cast("int")


def parse_date(c: Column | str) -> Column:
    return let(
        ascii_digits(strip(c)),
        lambda t: F.coalesce(iso_of(t), serial_to_iso(to_double(none_if_empty(t)))),
    )


def date_range(c: Column | str) -> Column:
    """struct<lo, hi>: smallest and largest ISO date mentioned."""
    text = ascii_digits(F.coalesce(as_col(c), F.lit("")))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({ISO_LIKE})"), 1), iso_of)
    return let(found, lambda days: record(lo=F.array_min(days), hi=F.array_max(days)))


def year_range(c: Column | str) -> Column:
    """struct<lo, hi>: an explicit year range, else the extremes of the years mentioned."""
    text = ascii_digits(F.coalesce(as_col(c), F.lit("")))
    span = "((?:19|20)\\d{2})(?U:\\s*)[-~至到—](?U:\\s*)((?:19|20)\\d{2})"
    lo, hi = (none_if_empty(F.regexp_extract(text, span, g)).try_cast("int") for g in (1, 2))
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR_MARK), 1), lambda y: y.cast("int"))
    return record(lo=F.coalesce(lo, F.array_min(years)), hi=F.when(lo.isNotNull(), hi).otherwise(F.array_max(years)))


def date_constraint(c: Column | str) -> Column:
    """struct<lo, hi>: the date range, else the year range widened to whole years."""
    days, years = date_range(c), year_range(c)
    lo = F.coalesce(days["lo"], F.concat(years["lo"].cast("string"), F.lit("-01-01")))
    hi = F.coalesce(days["hi"], F.concat(years["hi"].cast("string"), F.lit("-12-31")))
    return record(lo=lo, hi=hi)


def entity_list(c: Column | str, list_labels=fv.LIST_LABELS, single_labels=fv.SINGLE_LABELS,
                single="[\\u4e00-\\u9fff]{2,6}(?:市|县|区|省)?",
                suffix_chars: str = fv.TRAILING_SUFFIX_CHARS) -> Column:
    """Entities named after a label and a colon, cleaned and distinct in order."""
    text = F.coalesce(as_col(c), F.lit(""))
    word = "[\\u4e00-\\u9fff\\w]+"
    listed = F.regexp_extract(
        text,
        f"(?U)(?:{'|'.join(list_labels)})[：:]\\s*({word}(?:[,，、/ \\t]+{word})*)",
        1,
    )
    singles = F.regexp_extract_all(
        text, F.lit(f"(?U)(?:{'|'.join(single_labels)})[：:]\\s*({single})"), 1
    )
    raw = F.concat(F.split(strip(listed), "[,，、/ \\t]+"), singles)
    clean = F.transform(raw, lambda e: F.regexp_replace(strip(e), f"[{suffix_chars}]+$", ""))
    return F.array_distinct(F.filter(clean, lambda e: F.length(e) >= 2))


def row_date(c: Column | str) -> Column:
    """ISO date of a raw time cell: Y-M-D, Y/M/D, Y年M月D日 or a day number above 2500."""
    raw = ascii_digits(strip(c))
    dashed = strip(F.regexp_replace(F.translate(raw, "/年月", "---"), "[-日]+$", ""))
    head = F.get(F.split(dashed, "(?U)\\s+"), F.lit(0))
    return let(F.split(head, "-"), date_of_parts)


def date_of_parts(parts: Column) -> Column:
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    y = part(0)
    m = F.when(F.size(parts) > 1, part(1)).otherwise(1)
    d = F.when(F.size(parts) > 2, part(2)).otherwise(1)
    serial = (y > 2500) & (F.size(parts) == 1)
    span = F.when(serial & (y < 2900000), y)
    from_serial = F.date_add(F.lit(EPOCH).cast("date"), span).cast("string")
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    # A missing part makes the whole date NULL.
    plain = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(m), F.lit("-"), two(d))
    return F.when(serial, from_serial).otherwise(plain)


def within(date: Column, lo: str | None, hi: str | None) -> Column:
    """Inside the range, or undated: undated rows pass every date filter."""
    ok = F.lit(True)
    if lo:
        ok = ok & (date >= lo)
    if hi:
        ok = ok & (date <= hi)
    return date.isNull() | ok


def hour_of(c: Column | str) -> Column:
    return none_if_empty(F.regexp_extract(as_col(c), "(\\d{2}):\\d{2}", 1)).try_cast("int")


def table_context(c: Column | str, candidates, labels=fv.TIME_LABELS, city_label: str = "城市",
                  suffix: str = "(?:市|县|区)?", city_suffix: str = fv.CITY_SUFFIX) -> Column:
    """Primary entity, date and hour of the text before a table.

    ``candidates`` is a short Python list (the entities of one source table); NULL marks
    a value the text does not settle.
    """
    text = F.coalesce(as_col(c), F.lit(""))
    direct = []
    for name in candidates:
        q = quote(name)
        pattern = "|".join([
            f"{city_label}[：:]\\s*{q}{suffix}",
            f"{q}{suffix}(?:各|的)(?:监测|站点|数据)",
            f"记录.*?{q}{suffix}(?:各|的)",
            f"{q}{suffix}(?:的|各)\\S*?(?:检测|质量|监测|数据|信息)",
        ])
        direct.append(F.when(text.rlike(f"(?U){pattern}"), F.lit(name)))
    first_sentence = F.substring_index(text, "。", 1)
    named = F.array_compact(F.array(*[
        F.when(F.contains(first_sentence, F.lit(n)), F.lit(n)) for n in candidates
    ]))
    entity = F.coalesce(*direct, F.when(F.size(named) == 1, F.get(named, F.lit(0))))
    labelled = (
        f"(?:{'|'.join(labels)})[：:](?U:\\s*)(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})"
        "(?:(?U:\\s+)(\\d{2})[:\\d.]*)?"
    )
    plain = "(\\d{4})年(\\d{1,2})月(\\d{1,2})日(?:(?U:\\s*)(\\d{2})[:：]\\d{2})?"
    digits = ascii_digits(text)
    use = F.regexp_extract(digits, labelled, 1) != ""
    part = lambda g: F.when(use, F.regexp_extract(digits, labelled, g)).otherwise(
        F.regexp_extract(digits, plain, g))
    date = F.when(part(1) != "", iso(part(1), part(2), part(3)))
    return record(primary_entity=entity, date=date, hour=none_if_empty(part(4)))
