import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import bpe
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_documents(spark, library):
    docs = cases.documents(spark)
    got = sorted((tuple(r) for r in bpe.bpe_digests(docs, PATH).collect()), key=str)
    assert got == sorted(((d, *digests(library, t)) for d, t in docs.select("doc_id", "text").collect()), key=str)


def test_given_documents_and_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = bpe.bpe_encode(docs, PATH)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    decoded = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(encoded, PATH).collect()}
    assert decoded == {d: library.decode(ids, skip_special_tokens=False) for d, ids in want.items()}


def test_cuts_are_forced_and_change_nothing(library):
    coder = bpe.ForcedBpe(PATH)
    cut = coder.forced_cuts("".join(coder.letters[b] for b in "ñêñçxqzjkß".encode()))
    assert len(cut) > 1
    tokens = [t.removesuffix("</w>") for t in library.get_vocab()]
    for left, right in zip(cut, cut[1:]):
        assert not any(left[-1] + right[0] in t for t in tokens)
    for word in ("ñêñçxqzjkß", "thereationñing", "Ωωﬁ", "a" * 300):
        assert coder.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_every_character_of_the_first_planes(library):
    coder = bpe.ForcedBpe(PATH)
    for at in [*range(0, 0xD800, 64), *range(0xE000, 0x12000, 64), *range(0x1D400, 0x1FB00, 64)]:
        text = "a".join(chr(c) for c in range(at, at + 64)) + " " + "".join(chr(c) for c in range(at, at + 64))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_empty_clashing_and_null_ids(spark):
    assert bpe.bpe_digests(cases.empty(spark), PATH).collect() == []
    assert bpe.bpe_digests(cases.clashing(spark), PATH).count() == 3
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["text"] for r in bpe.bpe_decode(rows, PATH).collect()} == {""}
