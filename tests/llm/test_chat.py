import re

from pyspark.sql import functions as F

from factloom.llm import chat
from tests.llm import cases

MESSAGES = "conv_id long, turn long, role string, text string"


def parse(text):
    """(level, unit) of every line, own text, deepest level."""
    lines = re.sub(r"\r\n?", "\n", text or "").split("\n")
    read = []
    for line in lines:
        mark = re.match(r"^(?:[ \t]*>)+[ \t]?", line)
        level = mark[0].count(">") if mark else 0
        read.append((level, re.sub(r"\s+", " ", line[len(mark[0]) if mark else 0:].lower()).strip(" "), line))
    own = "\n".join(line for level, _, line in read if level == 0)
    return read, re.sub(r"^\s*\n|\s+$", "", own), max(level for level, *_ in read)


def brute(rows):
    """Reply order by walking each conversation from the first turn to the last."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = list(dict.fromkeys(r[1] for r in own))
        written, start_of, parent_of, linked_of, path_of = {}, {}, {}, {}, {}
        for place, turn in enumerate(turns):
            votes = {}
            for _, _, _, text in (r for r in own if r[1] == turn):
                for level, unit, _ in parse(text)[0]:
                    if level and unit and unit in written:
                        votes.setdefault(written[unit], []).append(level)
            for _, _, _, text in (r for r in own if r[1] == turn):
                for level, unit, _ in parse(text)[0]:
                    if not level and unit:
                        written[unit] = place
            parent = max(votes, key=lambda t: (-min(votes[t]), len(votes[t]), t), default=None)
            linked_of[turn] = sum(map(len, votes.values()))
            if place == 0 or (parent is not None and parent != place - 1):
                start_of[place] = place
                path_of[place] = (path_of[start_of[parent]] if parent is not None else ()) + (place,)
            else:
                start_of[place] = start_of[place - 1]
            parent_of[place] = parent if parent is not None else (place - 1 if place else None)
        ordered = sorted(own, key=lambda r: (path_of[start_of[turns.index(r[1])]], turns.index(r[1])))
        for n, (_, turn, role, text) in enumerate(ordered):
            place = turns.index(turn)
            parent = parent_of[place]
            out.append((conv, n, turn, role, parse(text)[1], None if parent is None else turns[parent], len(path_of[start_of[place]]) - 1, parse(text)[2], linked_of[turn]))
    return out


THREAD = [
    (1, 0, "user", "How do I install it?\nOn which system?"),
    (1, 1, "assistant", "> How do I install it?\nWith the installer."),
    (1, 2, "user", "Something else."),
    (1, 3, "user", ">> how  do I INSTALL it?\n> With the installer.\n\nIt fails."),
    (1, 4, "assistant", ">With the installer.\nSo  do it by hand."),
    (1, 5, "user", "> On which system?\n>\n> nobody wrote this\nLinux"),
    (1, 6, "user", "  >  >  It fails.\n> So do it by hand.\nDone"),
    (1, 7, "user", "> Done\nGreat"),
    (2, 5, "user", "> How do I install it?\nno such message here"),
    (2, 9, None, None), (2, 11, "user", ""), (2, 12, "user", "> Later\nme"), (2, 13, "user", "Later"), (2, 14, "x", "\n\n> only a quote\n\n"),
    (None, 1, "user", "Lost"), (None, 2, "user", "> Lost\nFound"), (3, None, "user", "no turn"), (3, 0, "user", "first"),
]


def run(spark, rows, **how):
    return sorted((tuple(r) for r in chat.reply_ordered(spark.createDataFrame(rows, MESSAGES), **how).collect()), key=str)


def test_threads_equal_the_walk(spark):
    want = brute(THREAD)
    got = run(spark, THREAD, partitions=3)
    assert got == sorted(want, key=str)
    order = [r[2] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])]
    assert order != sorted(order)  # branches come out of turn
    assert not any(">" in (r[4] or "") for r in got)


LONG = "The first half of a long paragraph, which somebody wrote on one line, and its second half. Then one more sentence."
QUOTING = [
    (1, 0, "u", f"Hello.\n\n{LONG}\n\nBye"), (1, 1, "u", "ok"), (1, 2, "u", "other! Really?  Yes.\nAnd a line without an end\nthat goes on."),
    (1, 3, "u", "> The first half of a long paragraph, which\n> somebody wrote on one line,\n> and its second half. Then one\n> more sentence.\nYes"),
    (1, 4, "u", "> The first half of a long\n> paragraph, which somebody wrote on one line, and its\n> second half. And something new.\n>\n>> ok\n> Yes\nNo"),
    (1, 5, "u", "first line\nok\nlast line"), (1, 6, "u", "ok"), (1, 7, "u", "> first line\n> ok\n> last line\nfine\n> Really?\n> and a line\n> without an end that goes on."),
    (1, 8, "u", ">> Then one more\n>> sentence.\n> fine\nhm"), (1, 8, "u", ">> Then one more\n>> sentence.\n> fine\nhm"),
    (2, 0, "u", "你好。我们明天见！"), (2, 1, "u", "> 我们明天见！\n好。"), (2, 2, "u", "> 没有人写过这句。\n> 好。\n再见。"), (2, 3, "u", "x. . y"), (2, 4, "u", "> 谁也没说。\n> . y"),
    (None, 0, None, "lost. found"), (None, None, None, "> lost.\n> found"), (None, None, None, None),
]


def test_end_of_a_sentence_is_no_link(spark):
    rows = [(1, 0, "u", "你好。"), (1, 1, "u", "其他。"), (1, 2, "u", "好"), (1, 3, "u", "> 没有人写过这句。\n是")]
    assert parents(spark, rows)[3] == (2, 0)


def parents(spark, rows):
    return {r[2]: (r[5], r[8]) for r in run(spark, rows)}


def test_wrapped_quotes_link_by_passage(spark):
    long = "The first half of a long paragraph, which somebody wrote on one line, and its second half. Then one more sentence."
    rows = [(1, 0, "u", f"Hello.\n\n{long}\n\nBye"), (1, 1, "u", "ok"), (1, 2, "u", "other"),
            (1, 3, "u", "> The first half of a long paragraph, which\n> somebody wrote on one line,\n> and its second half. Then one\n> more sentence.\nYes"),
            (1, 4, "u", "> The first half of a long\n> paragraph, which somebody wrote on one line, and its\n> second half. And something new.\nNo"),
            (1, 5, "u", "first line\nok\nlast line"), (1, 6, "u", "ok"), (1, 7, "u", "> first line\n> ok\n> last line\nfine"),
            (1, 8, "u", "> Then one more\n> sentence.\nhm")]
    got = parents(spark, rows)
    assert got[3] == (0, 4)  # re-wrapped whole paragraph
    assert got[4] == (0, 3)  # a sentence of it over three lines
    assert got[7] == (5, 3)  # the common line goes with its passage, not to its latest writer
    assert got[8] == (0, 2)


def test_deep_nesting(spark):
    rows = [(1, 0, "u", "m0"), (1, 1, "u", "x")]
    for n in range(2, 24, 2):
        rows += [(1, n, "u", f"> m{n - 2}\nm{n}"), (1, n + 1, "u", f"other {n}")]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_hot_conversation_and_line(spark):
    rows = [(1, n, "u", f"Same line\nown {n}" + (f"\n> own {n // 3}\n> same LINE" if n % 5 == 4 else "")) for n in range(300)] + [(n, 0, "u", "Same line") for n in range(2, 50)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_given_conversations_and_native(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = chat.reply_ordered(given)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(brute([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]), key=str)


def test_repeated_rows_empty_and_clashing(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "user", "> a\nc")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert chat.reply_ordered(cases.empty(spark, MESSAGES)).collect() == []
    more = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit(1) for c in ("conv", "start", "path", "body", "units", "pos", "_tie", "reply_order", "level")})
    assert chat.reply_ordered(more).count() == 4


def test_sql_twin(spark):
    import duckdb
    import pandas as pd
    from factloom.llm.queries import OP4_SQL
    from tests.oracle import rows_of
    hot = [(1, n, "u", f"Same line\nown {n}" + (f"\n> own {n // 3}\n> same LINE" if n % 5 == 4 else "")) for n in range(60)]
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for rows in (THREAD, QUOTING, hot, given):
        con = duckdb.connect()
        frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
        con.register("conversations", frame)
        want = con.execute(OP4_SQL)
        names, out = [d[0] for d in want.description], chat.reply_ordered(spark.createDataFrame(rows, MESSAGES))
        assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(names, want.fetchall())
