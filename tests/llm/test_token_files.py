import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import token_files
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = 2


def brute(rows):
    """Ids by one call per text, in ascending order of id (nulls first), then of what is left to chance."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        out.append((doc, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_digests_equal_one_call_per_text(spark):
    rows = [(n, t) for n, t in enumerate(cases.ODD_TEXTS)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_files.token_digests(spark, docs, PATH, END, shard_bytes=4000, part_keys=5)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(sorted(rows, key=lambda r: r[0]))
    assert got.select("shard").distinct().count() > 1


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = token_files.token_digests(spark, docs, PATH, END)
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows)


def test_repeated_and_null_ids_are_records_of_their_own(spark):
    docs = cases.documents(spark)
    got = token_files.token_digests(spark, docs, PATH, END, shard_bytes=500, part_keys=4).collect()
    assert len(got) == docs.count()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [0, *np.cumsum([r["n_tokens"] for r in by_start])[:-1]]
    ids = [r["doc_id"] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(r["occurrence"] for r in got if r["doc_id"] == 4) == [0, 1, 2]
    assert sorted(r["occurrence"] for r in got if r["doc_id"] is None) == [0, 1, 2]
    want = {(d, n, c) for d, _, n, c in brute([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_one_id_over_many_shards(spark):
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    got = token_files.token_digests(spark, docs, PATH, END, shard_bytes=500, part_keys=50)
    assert sorted(r["occurrence"] for r in got.collect()) == list(range(400))
    assert got.select("shard").distinct().count() > 3


def test_lookup_finds_the_stored_keys_only(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(200)], "doc_id long, text string")
    store = token_files.write_store(docs, PATH, None, part_keys=40)
    asked = spark.createDataFrame([(n, 0) for n in range(150, 260)] + [(3, 1)], "doc_id long, occurrence long")
    found = token_files.lookup(store, asked)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(150, 200))
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_payloads(store, found, 2).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert ids == {n: tokenizer.encode(f"text {n}").ids for n in range(150, 200)}


def test_empty_table_and_clashing_columns(spark):
    assert token_files.token_digests(spark, cases.empty(spark), PATH, END).collect() == []
    assert token_files.token_digests(spark, cases.clashing(spark), PATH, END).count() == 3


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    prints = np.arange(n, dtype=np.uint64)
    function, slots = token_files.PerfectHash.build(keys, prints)
    assert sorted(slots) == list(range(n))
    assert (function.slots(keys, prints) == slots).all()


def test_perfect_hash_with_equal_hashes():
    keys, prints = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    function, slots = token_files.PerfectHash.build(keys, prints)
    assert sorted(slots) == [0, 1, 2] and len(function.rest) == 2


def test_index_file_round_trip(tmp_path):
    keys = np.array([3, 3, 8, 11], np.uint64)
    entries = np.zeros(4, token_files.ENTRY)
    entries["print"], entries["offset"] = [1, 2, 3, 4], [10, 20, 30, 40]
    token_files.write_index(f"file://{tmp_path}", "i.mph", keys, entries)
    function, back = token_files.read_index(f"file://{tmp_path}", "i.mph")
    assert back["offset"][function.slots(keys, entries["print"])].tolist() == [10, 20, 30, 40]


def test_fragments_of_every_script_equal_whole_texts():
    coder, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    for at in [*range(0, 0xD800, 64), *range(0xE000, 0x12000, 64), *range(0x1D400, 0x1FB00, 64)]:
        chars = [chr(c) for c in range(at, at + 64)]
        text = "a".join(chars) + " " + "".join(chars) + " " + " ".join(f"{c}." for c in chars) + "\n" + "\n".join(chars)
        assert np.frombuffer(coder.raw(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, hex(at)
