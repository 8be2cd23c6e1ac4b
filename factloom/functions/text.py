"""Text rules as Column expressions; all stay in the JVM."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv

# Line ends as a Unicode-aware splitter sees them; the last three of the C0 separators never
# survive inside a line, so they are free to be used as marks in split texts.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
MARK_A, MARK_B, MARK_C = "\u001d", "\u001e", "\u001c"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    """A literal array of strings (one literal, folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def record(**cols: Column) -> Column:
    """A struct with the given field names; safe inside array lambdas."""
    return F.named_struct(*[part for name, c in cols.items() for part in (F.lit(name), c)])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote(value: str) -> str:
    """A regex that matches ``value`` literally, for the Java engine."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", value)


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# What (?U)\\s matches (the property White_Space), and the C0 separators that Python strips as well.
WHITE_SPACE = "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STRIPPED = WHITE_SPACE + "\u001c\u001d\u001e\u001f"


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space, not only U+0020. Looks at both ends only, not at each character as a regex does."""
    return F.btrim(as_col(c), F.lit(STRIPPED))


def lines(c: Column | str) -> Column:
    """Stripped lines of a text."""
    return F.transform(F.split(as_col(c), LINE_BREAK), strip)


def normalize_header(c: Column | str) -> Column:
    """Header without bracketed hints (also an unclosed one) and white space."""
    no_hint = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), "[（(].*?[)）]|[（(][^)）]*$", "")
    return F.regexp_replace(no_hint, "(?U)\\s+", "")


def header_key(c: Column | str) -> Column:
    return F.lower(normalize_header(c))


def is_entity_header(c: Column | str, extra=()) -> Column:
    return header_key(c).isin(*fv.ENTITY_HEADERS, *extra)


def is_date_header(c: Column | str, extra=(), row_numbers: bool = False) -> Column:
    names = [*fv.DATE_HEADERS, *extra, *(fv.ROW_NUMBER_HEADERS if row_numbers else ())]
    return header_key(c).isin(*names)


def header_unit(c: Column | str) -> Column:
    """Unit hint in the first closed bracket of a header."""
    hint = F.regexp_extract(as_col(c), "[（(](.*?)[)）]", 1)
    closed = as_col(c).rlike("[（(].*?[)）]")
    return F.when(closed, strip(hint))


def passthrough_name(c: Column | str) -> Column:
    """Cleaned raw header usable as a field name: not a number and at most 40 characters."""
    name = normalize_header(c)
    return F.when((name != "") & ~name.rlike("(?U)^\\d+$") & (F.length(name) <= 40), name)


def normalize_entity(c: Column | str, suffixes=fv.ENTITY_SUFFIXES) -> Column:
    """Entity name without separators and without one of each trailing suffix."""
    plain = F.translate(F.coalesce(as_col(c), F.lit("")), WHITE_SPACE + ":：-_/", "")
    if not suffixes:
        return plain

    def cut(name: Column) -> Column:
        some = functools.reduce(Column.__or__, [name.endswith(suffix) for suffix in suffixes])
        shorter = name
        for suffix in suffixes:
            # Cut only where at least two characters are left.
            shorter = F.regexp_replace(shorter, f"^(.{{2,}}){quote(suffix)}$", "$1")
        return F.when(some, shorter).otherwise(name)

    return let(plain, cut)


def strip_one_suffix(c: Column | str, chars: str = fv.TRAILING_SUFFIX_CHARS) -> Column:
    """Lower-cased name without one trailing administrative character when three or longer."""
    return F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), f"(?s)^(.{{2,}})[{chars}]$", "$1")


def clean_entity_value(c: Column | str, breaks=fv.ENTITY_BREAKS, run="[\\u4e00-\\u9fff]{2,6}",
                       only_if="[\\u4e00-\\u9fff]") -> Column:
    """Cut an entity cell at the first connective and keep its leading run of characters."""
    text = strip(c)
    cut = F.get(F.split(text, "|".join(breaks), 2), F.lit(0))
    lead = none_if_empty(F.regexp_extract(cut, f"^({run})", 1))
    return F.when(text.rlike(only_if), F.coalesce(lead, cut)).otherwise(text)


def collapse_cjk_spaces(c: Column | str) -> Column:
    """Drop white space between CJK characters and ASCII letters, digits or percent signs."""
    cjk, asc = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]", "[A-Za-z0-9%]"
    # White space is looked for first, so that the look behind is not made at every character.
    return F.regexp_replace(
        as_col(c), f"(?U)(?=\\s)(?:(?<={cjk})\\s+(?={asc})|(?<={asc})\\s+(?={cjk}))", ""
    )


def keyword_tokens(c: Column | str, stop_words=fv.GENERIC_TOKENS) -> Column:
    """All 2–24 character tokens in order, without numbers and generic words."""
    spaced = F.translate(F.coalesce(as_col(c), F.lit("")), "_-", "  ")
    tokens = F.regexp_extract_all(spaced, F.lit("([A-Za-z0-9\\u4e00-\\u9fff]{2,24})"), 1)
    return F.filter(
        tokens, lambda t: ~t.rlike("^[0-9]+$") & ~F.lower(t).isin(*stop_words)
    )


def keywords(c: Column | str, stop_words=fv.GENERIC_TOKENS) -> Column:
    """Case-insensitively distinct tokens in first-seen order, for short texts.

    Long texts go through ``operators.profiles.keyword_table``, which is linear.
    """
    tokens = keyword_tokens(c, stop_words)
    lowered = F.transform(tokens, F.lower)
    return F.filter(
        tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1
    )


def filename_keywords(c: Column | str, stop_words=fv.FILENAME_STOP_WORDS) -> Column:
    """Meaningful parts of a template name (extension dropped)."""
    stem = F.regexp_replace(as_col(c), "(?<=.)\\.[^./]*$", "")
    parts = F.regexp_extract_all(
        stem, F.lit("([\\u4e00-\\u9fff]+|[a-zA-Z](?U:[\\w-])*(?U:\\d)*|[0-9]+)"), 1
    )
    return F.filter(
        parts,
        lambda t: ~F.lower(t).isin(*stop_words) & (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"),
    )


NUMBER_TOKEN = "(\\d[\\d,]*\\.?\\d*)"


def number_tokens(c: Column) -> Column:
    """Numeric tokens of two or more characters."""
    return F.filter(F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), 1), lambda n: F.length(n) > 1)


def compress_text(c: Column | str, min_numbers: int = 3, keep_keywords=(),
                  clause_break: str = "[，；。]", joiner: str = "，") -> Column:
    """Number-bearing clauses of a paragraph (and its first clause); NULL when it is dropped."""
    text = strip(c)
    rescue = F.lit(False)
    for word in keep_keywords:
        rescue = rescue | F.contains(F.lower(text), F.lit(word.lower()))
    clauses = F.transform(F.split(text, clause_break), strip)
    kept = F.filter(
        clauses,
        lambda part, i: (part != "") & ((i == 0) | (F.size(number_tokens(part)) > 0)),
    )
    dense = none_if_empty(F.array_join(kept, joiner))
    return F.when(F.size(number_tokens(text)) >= min_numbers, dense).when(
        rescue & (text != ""), text
    )


def replace_counted(c: Column | str, pairs, first_only: bool = False) -> tuple[Column, Column]:
    """Apply literal (old, new) pairs in order; returns (text, number of changes)."""
    text, changes = as_col(c), F.lit(0).cast("long")
    for old, new in pairs:
        if first_only:
            at = F.instr(text, old)
            hit = at > 0
            replaced = F.concat(
                F.left(text, at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text))
            )
            changes = changes + hit.cast("long")
            text = F.when(hit, replaced).otherwise(text)
        else:
            gone = F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))
            changes = changes + (gone / len(old)).cast("long")
            text = F.replace(text, F.lit(old), F.lit(new))
    return text, changes


def file_stem_key(c: Column | str) -> Column:
    """Lower-cased file name without extension and common separators."""
    bare = F.regexp_replace(F.lower(as_col(c)), "\\.[^.]+$", "")
    return F.regexp_replace(bare, "(?U)[\\s_\\-—·()（）【】\\[\\]]+", "")


def trigrams(c: Column | str) -> Column:
    """Distinct character trigrams of a cleaned file name; the whole name when it is shorter."""
    name = file_stem_key(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, 3))
    return (
        F.when(F.length(name) == 0, F.array().cast("array<string>"))
        .when(F.length(name) < 3, F.array(name))
        .otherwise(F.array_distinct(grams))
    )


def name_tokens(c: Column | str) -> Column:
    """Letter fragments of a template name, two characters or longer."""
    bare = F.regexp_replace(F.lower(as_col(c)), "\\.[^.]+$", "")
    parts = F.split(bare, "(?U)[\\s_\\-—·()（）【】\\[\\]0-9]+")
    return F.filter(parts, lambda t: F.length(t) >= 2)
