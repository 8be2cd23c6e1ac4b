"""Conversations from quoting messages: quotes are linked to the messages they repeat, and left out.

Native column expressions throughout. A line that begins with ``>`` is a quote, one level per ``>``; a run of lines of one
level without an empty one is a passage. Passages, their sentences and their lines are normalised (lower case, white space and line ends to one
blank) and hashed. A quoted passage links to the latest earlier message of the conversation that wrote it itself, however either is
wrapped; where nobody wrote it whole, its sentences link, and lines that lie in no linked sentence link by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import stored
from factloom.operators.common import carry_forward, numbered

MARK = r"^(?:[ \t]*>)+[ \t]?"  # the quote marks at the start of a line
SENTENCE_END = r"(?<=[.!?…])(?=\s)|(?<=[。！？])"
PASSAGE, SENTENCE, LINE = 0, 1, 2  # kinds of units, those that link first come first
NOBODY = "null"  # key of the messages without a conversation


def _level(line: Column) -> Column:
    """Quote level of a line: number of marks it begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def _unit(line: Column) -> Column:
    """Normalised line without its marks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"\s+", " "))


def _hash(text: Column) -> Column:
    """Hash of normalised lines with line feeds between them."""
    return F.xxhash64(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))))


def _passages() -> Column:
    """Runs of ``lines`` of one level that are not empty: level, first and last place, normalised lines with line feeds between them."""

    def edge(step: int):
        def at_edge(x: Column) -> Column:
            beside = F.when(x["place"] + step >= 0, F.get("lines", x["place"] + step))
            return (x["unit"] != "") & (F.coalesce(beside["unit"], F.lit("")).eqNullSafe("") | (beside["level"] != x["level"]))
        return F.filter("lines", at_edge)

    def passage(first: Column, last: Column) -> Column:
        text = F.array_join(F.transform(F.slice("lines", first["place"] + 1, last["place"] - first["place"] + 1), lambda x: x["unit"]), "\n")
        return F.struct(first["level"].alias("level"), first["place"].alias("place"), last["place"].alias("last"), text.alias("text"))

    return F.zip_with(edge(-1), edge(1), passage)


def _units(passage: Column) -> Column:
    """Units of a passage. A sentence carries its number and line feeds instead of its places; units equal to a bigger one are left out."""

    def unit(kind: int, text: Column, place: Column, last: Column, number: Column, feeds: Column, led: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), passage["level"].alias("level"), _hash(text).alias("hash"), place.alias("place"), last.alias("last"),
                        number.alias("number"), feeds.alias("feeds"), led.alias("led"))

    none = F.lit(0)
    whole = F.array(unit(PASSAGE, passage["text"], passage["place"], passage["last"], none, none, none))
    sentences = F.transform(passage["sentences"], lambda x, n: unit(
        SENTENCE, x, passage["place"], passage["last"], n, F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))), F.startswith(x, F.lit("\n")).cast("int")))
    lines = F.transform(F.split(passage["text"], "\n"), lambda x, n: unit(LINE, x, passage["place"] + n, passage["place"] + n, none, none, none))
    return F.concat(whole, F.when((passage["level"] > 0) | (F.size(passage["sentences"]) > 1), sentences).otherwise(F.slice(whole, 1, 0)),
                    F.when(passage["last"] > passage["place"], lines).otherwise(F.slice(whole, 1, 0)))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` with ``body`` (own lines, outer blank lines off), ``quote_depth`` and ``units`` (see ``_units``).

    Levels are those of the lines; empty lines are in no unit. A null text has an empty body.
    """
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")
    read = messages.withColumn("lines", F.transform(lines, lambda x, n: F.struct(
        _level(x).alias("level"), x.alias("line"), _unit(x).alias("unit"), n.alias("place"))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return (read.withColumn("body", F.regexp_replace(own, r"^\s*\n|\s+$", ""))
            .withColumn("quote_depth", F.array_max(F.transform("lines", lambda x: x["level"])))
            .withColumn("passages", F.transform(_passages(), lambda x: x.withField("sentences", F.filter(F.split(x["text"], SENTENCE_END), lambda s: s != ""))))
            .withColumn("units", F.flatten(F.transform("passages", _units)))
            .drop("lines", "passages"))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """``(conv, turn, level, place, source_turn)`` of each quoted line whose source an earlier message is.

    ``parsed(row, conv, turn, units)``, with ``row`` unique. Only units that somebody of the conversation quotes are compared; the latest earlier
    turn is carried forward over the turns in slices, so a unit that everybody writes or a conversation that holds most messages is no hot
    task. Quoted passages and lines look for passages and lines, quoted sentences for sentences as well.
    """
    units = parsed.select("row", "conv", "turn", F.explode("units").alias("u")).select("row", "conv", "turn", "u.*")
    of_passage = Window.partitionBy("row", "place", "kind").orderBy("number")
    upto = F.sum("feeds").over(of_passage)
    is_sentence = F.col("kind") == SENTENCE
    quoted = stored(units.where("level > 0").withColumn("upto", upto).select(
        "row", "conv", "turn", "kind", "level", "hash", (~is_sentence).alias("whole"),
        F.when(is_sentence, F.col("place") + F.col("upto") - F.col("feeds") + F.col("led")).otherwise(F.col("place")).alias("first"),
        F.when(is_sentence, F.col("place") + F.col("upto")).otherwise(F.col("last")).alias("last")), "quoted")
    asked = quoted.select("conv", "hash").distinct()
    written = units.where("level = 0").select("conv", "hash", "turn", "kind").join(asked, ["conv", "hash"], "leftsemi").select(
        "conv", "hash", "turn", F.explode(F.when(is_sentence, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("whole")).distinct()
    # A quote comes before what its own message writes: even positions ask, odd ones answer.
    both = (quoted.select("conv", "hash", "whole", "turn").distinct().withColumn("pos", F.col("turn") * 2).withColumn("source", F.lit(None).cast("long"))
            .unionByName(written.withColumn("pos", F.col("turn") * 2 + 1).withColumn("source", F.col("turn"))))
    found = carry_forward(both, ["conv", "hash", "whole"], "pos", {"source_turn": F.col("source")}).where("source is null and source_turn is not null")
    linked = quoted.join(found.select("conv", "hash", "whole", "turn", "source_turn"), ["conv", "hash", "whole", "turn"])
    best = F.min_by("source_turn", F.struct("kind", -F.col("source_turn")))
    return (linked.select("row", "conv", "turn", "level", "kind", "source_turn", F.explode(F.sequence("first", "last")).alias("place"))
            .groupBy("row", "conv", "turn", "level", "place").agg(best.alias("source_turn")).drop("row"))


def reply_parents(links: DataFrame) -> DataFrame:
    """``(conv, turn, parent_turn, linked)``: the message whose lines a message quotes most on the outermost level that links.

    Ties go to the later message; ``linked`` counts the quoted lines with a source, of all levels.
    """
    votes = links.groupBy("conv", "turn", "source_turn").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("source_turn", F.struct(-F.col("level"), F.col("n"), F.col("source_turn")))
    return votes.groupBy("conv", "turn").agg(best.alias("parent_turn"), F.sum("n").alias("linked"))


def branch_paths(branches: DataFrame) -> DataFrame:
    """``(conv, start, path)`` of ``branches(conv, start, above)``: the starts from the first branch down to each one.

    Paths double in length each round, so the rounds follow the logarithm of the nesting.
    """
    state = stored(branches.select("conv", "start", "above", F.array("start").alias("path")), "branches")
    while not state.where("above is not null").isEmpty():
        upper = state.select(F.col("conv").alias("u_conv"), F.col("start").alias("u_start"), F.col("above").alias("u_above"), F.col("path").alias("u_path"))
        state = stored(
            state.join(upper, (F.col("conv") == F.col("u_conv")) & (F.col("above") == F.col("u_start")), "left")
            .select("conv", "start", F.col("u_above").alias("above"), F.concat(F.coalesce("u_path", F.array().cast("array<bigint>")), "path").alias("path")),
            "branches")
    return state.select("conv", "start", "path")


def reply_ordered(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Reply-ordered conversations without quotes: one row per message of ``messages(conv_id, turn, role, text)``.

    ``reply_order`` numbers the messages of a conversation from 0. A message that quotes an earlier one other than the message
    just before it opens a branch below that message's branch; all others continue the branch they stand in. A branch is followed by its
    sub-branches in the order of their first turn. ``parent_turn`` is the quoted message, else the turn before (null for the first).
    Messages without a conversation form one of their own; a null turn comes last; repeated rows and turns are kept, in the order of role,
    text and depth of quotes. Texts without quotes stay as they are but for outer blank lines.
    """
    spark = messages.sparkSession
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit(NOBODY)).alias("conv"),
        F.col("turn").cast("long").alias("own_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(1 << 60)).alias("turn"), "role", "text")
    parsed = parse_quotes(rows)
    # The narrow table of turns is what all linking reads; texts are read again for the result.
    turns = stored(parsed.select(F.monotonically_increasing_id().alias("row"), "conv", "turn", "units"), "turns")
    parents = stored(reply_parents(link_quotes(turns)), "parents")
    known = turns.select("conv", "turn").distinct().join(parents, ["conv", "turn"], "left")
    earlier = carry_forward(
        known.select("conv", (F.col("turn") * 2 + 1).alias("pos"), "turn", "parent_turn", "linked", F.col("turn").alias("at"))
        .unionByName(known.select("conv", (F.col("turn") * 2).alias("pos"), "turn", "parent_turn", "linked", F.lit(None).cast("long").alias("at"))),
        ["conv"], "pos", {"before": F.col("at")}).where("at is null")
    opens = F.col("before").isNull() | (F.col("parent_turn") != F.col("before"))
    placed = stored(
        carry_forward(earlier.select("conv", "turn", "parent_turn", "linked", "before",
                                     F.when(opens, F.col("turn")).alias("opening")),
                      ["conv"], "turn", {"start": F.col("opening")})
        .select("conv", "turn", F.coalesce("parent_turn", "before").alias("parent_turn"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "opening", "start"),
        "placed")
    heads = placed.where("opening is not null").select("conv", "start", "parent_turn")
    of_parent = placed.select(F.col("conv").alias("p_conv"), F.col("turn").alias("p_turn"), F.col("start").alias("above"))
    branches = heads.join(of_parent, (F.col("conv") == F.col("p_conv")) & (F.col("parent_turn") == F.col("p_turn")), "left").select("conv", "start", "above")
    paths = branch_paths(branches)
    threaded = placed.join(paths, ["conv", "start"]).select("conv", "turn", "parent_turn", "linked", "path")
    whole = (parsed.select("conv_id", "conv", "own_turn", "turn", "role", "body", "quote_depth")
             .join(threaded, ["conv", "turn"]))
    count = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = numbered(whole, ["conv"], ["path", "turn", "role", "body", "quote_depth"], "reply_order", count)
    return ordered.select(
        "conv_id", "reply_order", F.col("own_turn").alias("turn"), "role", F.col("body").alias("text"),
        "parent_turn", (F.size("path") - 1).alias("branch_depth"), "quote_depth", F.col("linked").alias("linked_lines"))
