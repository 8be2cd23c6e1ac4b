"""The same rules callable from SQL: native SQL functions, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from factloom.functions import fixed_values as fv
from factloom.functions.text import LINE_BREAK
from factloom.sources.blocks import TEXT_HEADING


def _literal(text: str) -> str:
    """A raw SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_num_sql() -> str:
    """``find_num(text, keyword, target, 'alt1,alt2')``: number next to a keyword (a regex), scaled to the target unit.

    The target is tried first, then the alternatives, then no unit; after the keyword before in front of it.
    """
    sizes = ", ".join(f"{_literal(u)}, {float(m)!r}D" for u, m in fv.UNIT_MAGNITUDE.items())
    size = lambda unit: f"coalesce(try_element_at(map({sizes}), {unit}), 1.0D)"
    number, space, gap = r"[\d,]+\.?\d*", r"(?U:\s*)", r"[^\d]{0,12}"
    tail = f"if(u = '', {_literal(r'(?![\u4e00-\u9fff\d])')}, concat({_literal(chr(92) + 'Q')}, u, {_literal(chr(92) + 'E')}))"
    # One pattern takes, from the start of the text, the units in turn, each after and then before the keyword, where the text has the
    # unit at all; groups of other places stay empty. It is the same for all rows of a call, so it is compiled once and not for each
    # unit of each row. A find without a number (',') does not count: only then are all places looked at, hit or not.
    look = lambda parts: f"concat('(?=(?s:.*?)(?:', {parts}, '))')"
    group = lambda side: f"'(?<{side}', cast(i AS STRING), {_literal('>' + number + ')' + space)}"
    after = look(f"keyword, {_literal(gap)}, {group('a')}, {tail}")
    before = look(f"{group('b')}, {tail}, {_literal('[^。；' + chr(92) + 'n]{0,12}?')}, keyword")
    has_unit = f"if(u = '', '', concat('(?=(?s:.*?)', {_literal(chr(92) + 'Q')}, u, {_literal(chr(92) + 'E')}, ')'))"
    begin = _literal(chr(92) + "A")
    places = f"array_join(transform(us, (u, i) -> concat({has_unit}, '(?:', {after}, '|', {before}, ')')), '|')"
    first, some = f"concat({begin}, '(?:', {places}, '|)(?s:.*)')", f"concat({begin}, '(?:', {places}, ')')"
    every = f"concat({begin}, array_join(transform(us, (u, i) -> concat('(?:', {after}, '|)(?:', {before}, '|)')), ''), '(?s:.*)')"
    shown = f"array_join(transform(us, (u, i) -> concat('${{a', cast(i AS STRING), '}};${{b', cast(i AS STRING), '}}')), ';')"
    digits = "translate(text, '０１２３４５６７８９', '0123456789')"
    value = (f"if(n = '', CAST(NULL AS DOUBLE), try_cast(replace(n, ',', '') AS DOUBLE) * {size('us[CAST(i DIV 2 AS INT)]')} / "
             f"{size('coalesce(target, ' + _literal('') + ')')})")
    units = "array_distinct(concat(filter(concat(array(coalesce(target, '')), split(coalesce(alternatives, ''), ',')), u -> u <> ''), array('')))"
    pick = lambda hits: f"get(filter(transform(split({hits}, ';'), (n, i) -> {value}), v -> v IS NOT NULL), 0)"
    hits = lambda pattern: f"regexp_replace({digits}, {pattern}, {shown})"
    return (
        "CREATE OR REPLACE TEMPORARY FUNCTION find_num(text STRING, keyword STRING, target STRING, alternatives STRING) RETURNS DOUBLE "
        f"RETURN get(transform(array({units}), us -> get(transform(array({hits(first)}), hit -> coalesce({pick('hit')}, "
        f"if(NOT {digits} RLIKE {some}, CAST(NULL AS DOUBLE), {pick(hits(every))}))), 0)), 0)")


def text_blocks_sql() -> str:
    """``LATERAL text_blocks(text)``: one document row to its block rows."""
    strip = lambda c: f"regexp_replace({c}, {_literal('(?U)^[' + chr(92) + 's\u001c-\u001f]+|[' + chr(92) + 's\u001c-\u001f]+$')}, '')"
    heading = _literal(TEXT_HEADING)
    lines = f"transform(split(coalesce(text, ''), {_literal(LINE_BREAK)}), x -> {strip('x')})"
    marked = f"array_join(transform({lines}, x -> if(x rlike {heading}, concat('\u001d', regexp_extract(x, {heading}, 1), '\u001e'), x)), '\\n')"
    paragraphs = ("filter(transform(split(if(i = 0, part, substring_index(part, '\u001e', -1)), '\\n{2,}'), "
                  "p -> replace(regexp_replace(p, '^\\n|\\n$', ''), '\\n', ' ')), p -> p <> '')")
    title = "if(i = 0, CAST(NULL AS STRING), substring_index(part, '\u001e', 1))"
    items = (f"flatten(transform(split({marked}, '\u001d'), (part, i) -> concat("
             f"if(i = 0, array(), array(named_struct('kind', 'heading', 'body', {title}, 'section', {title}))), "
             f"transform({paragraphs}, p -> named_struct('kind', 'paragraph', 'body', p, 'section', {title})))))")
    return (
        "CREATE OR REPLACE TEMPORARY FUNCTION text_blocks(text STRING) "
        "RETURNS TABLE (block_index INT, block_type STRING, text STRING, section STRING) "
        f"RETURN SELECT pos + 1, b.kind, b.body, b.section FROM (SELECT posexplode({items}) AS (pos, b))")


def register(spark: SparkSession) -> None:
    """Make ``find_num`` and ``text_blocks`` callable from SQL in this session."""
    spark.sql(find_num_sql())
    spark.sql(text_blocks_sql())
