"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged across, so the text may be cut
between them: the fragments are encoded each on its own and their ids concatenated. Fragments repeat, so a worker encodes
each once. The vocabulary file (JSON) is read where the task runs; its path is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from factloom.llm.shared import in_batches, texts

LATIN_END = "\u0250"
MARKS = ".,;:!?"
CACHED = 150_000  # stretches of text in each generation of a worker's cache


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Recent(dict):
    """A cache of two generations: an entry used since the last turn survives the next one."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class ForcedBpe:
    """Encoder and decoder of one vocabulary file with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError(f"{path} is not a vocabulary of the kind that this operator encodes")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = BPE(self.ids, self.merges, end_of_word_suffix=self.suffix)
        self.tokens = {n: t for t, n in self.ids.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {n: t for t, n in special.items()}
        self.special = special
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(pattern)
        self.letters = byte_letters()
        self.path = path
        bare = (t.removesuffix(self.suffix) for t in self.ids)
        self.joined = {pair for t in bare for pair in pairwise(t)}
        self.fragment_ids = _Recent(self._merge, CACHED // 4)
        self.chunks = _Recent(self._chunk, CACHED)
        self.marks = {m: self._spelled(self._any_ids(m)) for m in MARKS}

    def forced_cuts(self, word: str) -> list[str]:
        """A word (in byte letters) cut wherever two letters stand side by side in no token."""
        joined, start, out = self.joined, 0, []
        if joined.issuperset(pairwise(word)):
            return [word]
        for at, pair in enumerate(pairwise(word), 1):
            if pair not in joined:
                out.append(word[start:at])
                start = at
        out.append(word[start:])
        return out

    def _merge(self, fragment: tuple[str, bool]) -> list[int]:
        """Ids of one fragment on its own: merges of the lowest rank first, with or without the word end."""
        letters, ends = fragment
        model = self.model if ends else self._inner_model
        return [t.id for t in model.tokenize(letters)]

    @functools.cached_property
    def _inner_model(self) -> BPE:
        return BPE(self.ids, self.merges)

    @functools.cached_property
    def _library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _words(self, text: str) -> list[str]:
        """Pieces of a text in byte letters."""
        if text and max(text) >= LATIN_END:
            # Beyond Latin, what is a letter depends on the Unicode version: there the library's own rules cut the pieces.
            rules = self._library
            return [piece for piece, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text).lower()
        return ["".join([self.letters[b] for b in piece.encode()]) for piece in self.pieces.findall(text)]

    def _word_ids(self, word: str) -> list[int]:
        *inner, last = self.forced_cuts(word)
        ids = self.fragment_ids[last, True] if inner else self._merge((last, True))
        return [n for fragment in inner for n in self.fragment_ids[fragment, False]] + ids if inner else ids

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, int]:
        """Decimal ids, decoded text and number of ids of a stretch without blank or line feed."""
        if chunk[-1] in MARKS and chunk[-2:-1].isalpha() and chunk[-2] < LATIN_END:
            # A mark after a letter is a piece of its own, as the stretch before it is.
            ids, decoded, n = self.chunks[chunk[:-1]]
            more, text, one = self.marks[chunk[-1]]
            return ids + b" " + more, decoded + b" " + text, n + one
        if chunk.isalpha() and max(chunk) < LATIN_END and (low := chunk.lower()).isalpha():
            # Latin letters only: one piece, and composed already.
            return self.chunks[low] if low != chunk else self._spelled(self._word_ids(self._in_letters(low)))
        return self._spelled(self._any_ids(chunk))

    def _in_letters(self, piece: str) -> str:
        return piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])

    def _any_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for word in self._words(part):
                    ids += self._word_ids(word)
        return ids

    def _spelled(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        return " ".join(map(str, ids)).encode(), self.decode(ids).encode(), len(ids)

    def _stretches(self, text: str) -> list[tuple[bytes, bytes, int]]:
        chunks = self.chunks
        return [x for x in [chunks[c] for c in text.replace("\n", " ").split(" ") if c] if x[2]]

    def encode(self, text: str) -> list[int]:
        return [int(n) for ids, _, _ in self._stretches(text) for n in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space: the file names no decoder."""
        return " ".join([self.tokens[n] for n in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids joined by spaces, sha256 of the decoded text."""
        parts = self._stretches(text)
        return (sum([p[2] for p in parts]), hashlib.sha256(b" ".join([p[0] for p in parts])).hexdigest(),
                hashlib.sha256(b" ".join([p[1] for p in parts])).hexdigest())


@functools.lru_cache(maxsize=2)
def coder(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``; null and empty texts have no ids."""

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = coder(vocabulary)
        return {"doc_id": batch.column("doc_id"), "ids": pa.array([bpe.encode(t) for t in texts(batch)], pa.list_(pa.int32()))}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; ids that are null or empty give an empty text."""

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = coder(vocabulary)
        return {"doc_id": batch.column("doc_id"), "text": pa.array([bpe.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())}

    return in_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), rows, "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_tokens, and digests of the ids and of the text decoded from them.

    Repeated rows are encoded each, null texts count as empty, texts of any length are encoded whole.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = coder(vocabulary)
        n, ids, decoded = zip(*map(bpe.digests, texts(batch)))
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
