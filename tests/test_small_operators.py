import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, profiles, selection, transform
from factloom.sources import office
from factloom.sources.vocabulary import Field, Vocabulary


@pytest.mark.parametrize("seed", range(3))
def test_nearest_hours_of_many_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"2024-01-0{rng.randrange(1, 4)}" + (f" {rng.randrange(24):02d}:00" if rng.random() < 0.8 else ""), rng.choice("ab")) for i in range(60)]
    rows += [(100, "2024-01-09", "a"), (101, "no date", "a"), (102, None, "a")]
    targets = [(f"t{i}", f"2024-01-0{rng.randrange(1, 5)}", rng.randrange(24), rng.choice("ab")) for i in range(20)] + [("none", "2024-01-09", 5, "a"), ("gone", "2023-01-01", 5, "a")]
    got = selection.nearest_hour_targets(spark.createDataFrame(rows, "id int, stamp string, kind string"), "stamp",
                                         spark.createDataFrame(targets, "target string, date string, hour int, kind string"), ["kind"])
    want = []
    for name, date, hour, kind in targets:
        there = [(i, int(s[11:13]) if len(s) > 10 else None) for i, s, k in rows if s and s.startswith(date) and k == kind]
        known = [abs(h - hour) for _, h in there if h is not None]
        want += [(name, i) for i, h in there if (abs(h - hour) == min(known) if h is not None and known else h is None and not known)]
    assert sorted((r["target"], r["id"]) for r in got.collect()) == sorted(want)
    assert set(got.columns) == {"id", "stamp", "kind", "date", "target", "hour"}


def test_profile_by_sketch_and_in_full(spark):
    df = spark.range(5_000).select(
        F.col("id").alias("key"), (F.col("id") % 30).alias("thirty"), (F.col("id") % 31).alias("more"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit("c").alias("one col"))
    full = {r["column"]: r for r in profiles.table_profile(df).collect()}
    sketched = {r["column"]: r for r in profiles.table_profile(df, sketch=True).collect()}
    assert {c: r["n_distinct"] for c, r in full.items()} == {"key": 5000, "thirty": 30, "more": 31, "none": 0, "half": 1, "one col": 1}
    assert full["thirty"]["values"].count(",") == 14 and full["more"]["values"] is None and full["half"]["values"] is None
    assert abs(sketched["key"]["n_distinct"] - 5000) < 5000 * 5 * profiles.RSD and not sketched["key"]["exact"]
    for c in ("thirty", "more", "none", "half", "one col"):
        assert tuple(sketched[c]) == tuple(full[c])
    assert full["half"]["non_null"] == 2500 and full["none"]["rows"] == 5000
    assert profiles.table_profile(df.where("false")).count() == 6


def test_enrich_repeats_rows_of_repeated_keys(spark):
    main, extra = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert sorted(tuple(r) for r in transform.enrich(main, extra, "k").collect()) == [(1, "a", "p"), (1, "a", "q"), (2, "b", None)]


VOCAB = Vocabulary(fields=(Field("GDP", "", "city"), Field("area", "", "city")), names=("Lyon",), entity_required=())


def hook(chunks):
    import pandas as pd
    rows = [(d, b, "Lyon", w.split("=")[0], w.split("=")[1], None, t) for d, b, t in zip(chunks["doc_id"], chunks["block_id"], chunks["text"]) for w in t.split() if "=" in w]
    return pd.DataFrame(rows, columns=["doc_id", "block_id", "entity_name", "field_name", "value", "unit", "evidence"])


def test_hooked_facts_keep_their_places(spark):
    blocks = spark.createDataFrame([("d", "d#2", 2, "b=1 a=2", "f"), ("d", "d#1", 1, "c=3 GDP=4 d=5", "f"), ("e", "e#1", None, "x=1", "f")],
                                   "doc_id string, block_id string, page_or_index int, text string, file_name string")
    facts = extraction.run_extractor(blocks, hook, VOCAB, "fallback")
    got = {r["field_name"]: r["pos"] for r in facts.collect()}
    assert got == {"c": (1 << 20), "GDP": (1 << 20) + 1, "d": (1 << 20) + 2, "b": 2 << 20, "a": (2 << 20) + 1, "x": 0}
    ordered = extraction.running_positions(facts).orderBy("pos").collect()
    assert [r["field_name"] for r in ordered] == ["c", "GDP", "d", "b", "a", "x"]


def test_fields_as_a_table_and_gaps(spark):
    blocks = spark.createDataFrame([("d", "d#1", "paragraph", 1, "Lyon GDP 5, area=7 other=9", "f", [])],
                                   "doc_id string, block_id string, block_type string, page_or_index int, text string, file_name string, section_path array<string>")
    blocks = blocks.withColumns({"headers": F.lit(None).cast("array<string>"), "cells": F.lit(None).cast("array<string>")})
    wanted = spark.createDataFrame([("AREA",), ("none",)], "field string")
    for fields in (wanted, ["AREA", "none"]):
        assert [r["field_name"] for r in extraction.run_extractor(blocks, hook, VOCAB, "intent", fields).collect()] == ["area"]
    required = spark.createDataFrame([("GDP", False), ("other", False)], "field string, is_computed boolean")
    told = lambda df: {(r["field_name"], r["metadata"]["extraction_method"]) for r in df.collect()}
    rule = {("GDP", "rule"), ("area", "rule")}
    assert told(extraction.extract_by_intent(blocks, VOCAB, required, hook)) == rule | {("other", "intent")}
    assert told(extraction.extract_by_intent(blocks, VOCAB, required.where("field = 'GDP'"), hook)) == rule


def test_stray_and_repeated_cells_of_a_row(spark):
    row = '<row r="2"><c r="B2"><v>b</v></c><c r="XFD2"><v>far</v></c><c r="A2"><v>a</v></c><c r="B2"><v>later</v></c></row>'
    got = spark.createDataFrame([(row,)], "x string").select(office._row(F.col("x"), F.lit(0), F.array().cast("array<string>")).alias("r")).first()["r"]
    assert got["values"][:3] == ["a", "later", ""] and len(got["values"]) == 16384 and got["values"][-1] == "far"
