"""Language identification by n-gram filters that hold a bitmask of languages per slot.

The filter is one Bloom filter per language, bit-sliced: slot i holds a mask with one bit per language, and AND-ing
the slots of an n-gram gives all languages whose filter contains it at once; more than 64 languages take several planes of
such masks. N-grams are windows of bytes over the lower-cased text with every other character than a letter or a mark on a
letter as one separator, in all scripts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches, kept_rows, remainder, small_batches

UNKNOWN = "und"
WIDTHS = (3, 5)  # bytes of an n-gram
SLOTS = 1 << 21
HASHES = 2
PER_LANGUAGE = 4_000  # labelled documents that a language is learned from, in expectation
RATIO = 0.25  # an n-gram belongs to a language where it is at least this frequent, relative to its most frequent language
LEAST = 1e-5  # and makes up at least this part of the language's n-grams
RUN = 1 << 20  # bytes hashed at once
PENDING, HELD = 1 << 20, 1 << 20  # hashes that wait to be counted, and different ones that a task holds of a language

_MULTIPLIERS = np.random.default_rng(6).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class LanguageFilters:
    """Bit-sliced filters: one mask of languages per slot, and the false positive rate of each language.

    Where there are more languages than a mask has bits, ``masks`` has one row of slots for each ``PLANE`` of them.
    """

    languages: list[str]
    masks: np.ndarray
    false_rates: np.ndarray

    def planes(self) -> np.ndarray:
        return self.masks if self.masks.ndim == 2 else self.masks[None]


PLANE = 64  # languages of a plane of masks
_NO_LETTER = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FEW = 24  # different separators beyond ASCII that are worth a pass over the text each


@functools.cache
def _separates(character: str) -> bool:
    """Whether a character beyond ASCII is no letter and no mark on one."""
    return unicodedata.category(character)[0] not in "LM"


def letters(text: str) -> bytes:
    """The text as the n-grams see it: lower-cased words of letters in UTF-8, with one blank before, between and after them."""
    lowered = text.lower()
    if not lowered.isascii():
        between = [c for c in set(lowered) if c > "\x7f" and _separates(c)]
        if len(between) > _FEW:
            lowered = re.sub(f"[{re.escape(''.join(between))}]", " ", lowered)
        else:
            for c in between:
                lowered = lowered.replace(c, " ")
    return b" " + b" ".join(lowered.encode("utf-8", "replace").translate(_NO_LETTER).split()) + b" "


def gram_hashes(raw: bytes, width: int) -> np.ndarray:
    """64-bit hash of each byte window (polynomial, then mixed)."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = data.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out *= _MULTIPLIERS[0]
        out += data[k:k + n]
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[1]
    return out ^ (out >> np.uint64(32))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Slots of an n-gram: disjoint bits of its hash."""
    bits = SLOTS.bit_length() - 1
    return [((hashes >> np.uint64(k * bits)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def _windows(text: str) -> Iterator[np.ndarray]:
    """Hashes of all windows of a text; a long text in runs that overlap by the widest window less one."""
    raw = letters(text)
    if len(raw) < 3:
        return
    for at in range(0, len(raw), RUN):
        for width in WIDTHS:
            yield gram_hashes(raw[at:at + RUN + width - 1], width)


# ---------------------------------------------------------------- learning


def train_filters(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageFilters:
    """Filters from ``labelled(doc_id, text, lang)``; rows without text or language teach nothing.

    Of each language about ``per_language`` documents are read, chosen by the hash of their id (all of them where
    there are fewer): the counts of n-grams per language that come out are bounded by that, so filters are built
    from one small table per language. The false positive rate of a filter is its share of set bits to the number of hashes.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros(SLOTS, np.uint64), np.zeros(0))

    def of_language(values: dict):
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))

    share = of_language({name: min(1.0, per_language / n) for name, n in sizes.items()})
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)

    grams = _gram_counts(rows.where(drawn)).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilters(languages, np.zeros(SLOTS, np.uint64), np.zeros(len(languages)))
    frequency = F.col("n") / of_language({name: float(n) for name, n in totals.items()})
    place = of_language({name: place for place, name in enumerate(languages)})
    member = grams.select("gram", frequency.alias("f"), place.alias("p")).groupBy("gram").agg(F.max("f").alias("top"), F.collect_list(F.struct("f", "p")).alias("by"))
    own = F.filter("by", lambda x: (x["f"] >= RATIO * F.col("top")) & (x["f"] >= LEAST))
    n_planes = -(-len(languages) // PLANE)

    def mask(plane: int):
        inside = F.filter(own, lambda x: F.floor(x["p"] / PLANE) == plane)
        return F.aggregate(inside, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x["p"], F.lit(PLANE)).cast("int"))))

    table = member.select("gram", *(mask(k).alias(f"m{k}") for k in range(n_planes))).where(" or ".join(f"m{k} <> 0" for k in range(n_planes))).toArrow()
    small = next((kind for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= bits), np.uint64)
    masks = np.zeros((n_planes, SLOTS), small)
    gram = table.column("gram").to_numpy().view(np.uint64)
    for k in range(n_planes):
        mask_of = table.column(f"m{k}").to_numpy().view(np.uint64).astype(small)
        for at in slots(gram):
            np.bitwise_or.at(masks[k], at, mask_of)
    filled = np.array([np.count_nonzero(masks[p // PLANE] & small(1 << p % PLANE)) / SLOTS for p in range(len(languages))])
    return LanguageFilters(languages, masks if n_planes > 1 else masks[0], filled ** HASHES)


class _Tally:
    """Counts of hashes in two sorted arrays; new hashes wait until there are ``PENDING`` of them."""

    def __init__(self):
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += hashes.size
        if self.size >= PENDING:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.grams, place = np.unique(np.concatenate([self.grams, new]), return_inverse=True)
            self.counts = np.bincount(place, np.concatenate([self.counts, n])).astype(np.int64)
            self.waiting, self.size = [], 0


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, lang, n), counted in each task before they are shuffled; a task holds a bounded number of grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Tally] = {}

        def passed_on(lang: str) -> pa.RecordBatch:
            tally = held.pop(lang)
            tally.settle()
            return pa.RecordBatch.from_arrays([pa.array(tally.grams.view(np.int64)), pa.array([lang] * tally.grams.size, pa.string()), pa.array(tally.counts)],
                                              names=["gram", "lang", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                for hashes in _windows(text.as_py()):
                    held.setdefault(lang, _Tally()).add(hashes)
                if lang in held and held[lang].grams.size > HELD:
                    yield passed_on(lang)
        for lang in [*held]:
            yield passed_on(lang)

    return small_batches(rows.select("text", "lang")).mapInArrow(count, "gram long, lang string, n long")


# ---------------------------------------------------------------- deciding


def identify(text: str | None, filters: LanguageFilters) -> tuple[str, float]:
    """Language and score of one text; ``und`` with score 0 where it is null or has no letter."""
    if not text or not filters.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    hits, total = np.zeros(len(filters.languages)), 0
    for hashes in _windows(text):
        places = slots(hashes)
        total += hashes.size
        for k, masks in enumerate(filters.planes()):
            found = masks[places[0]]
            for at in places[1:]:
                found = found & masks[at]
            of_plane = range(k * PLANE, min(len(filters.languages), (k + 1) * PLANE))
            hits[of_plane.start:of_plane.stop] += [np.count_nonzero(found & found.dtype.type(1 << p % PLANE)) for p in of_plane]
    # Of the n-grams that a filter does not hold, its false positive rate passes all the same.
    spare = 1 - filters.false_rates
    true = np.where(spare > 0, np.maximum(0.0, hits - total * filters.false_rates) / np.where(spare > 0, spare, 1), 0)
    if not true.sum():
        return filters.languages[int(np.argmax(hits))], 1.0 / len(filters.languages)
    best = int(np.argmax(true))
    return filters.languages[best], float(min(1.0, true[best] / true.sum()))


def predict_language(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row of ``docs(doc_id, text)``; a tie goes to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows(batch: pa.RecordBatch) -> dict:
        lang, score = zip(*(identify(t, shared.value) for t in batch.column("text").to_pylist()))
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, lang_pred string, score double")


def held_out():
    """Documents that filters never learn from: crc32 of the id leaves 2 (of 4); a null id is not held out."""
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict for all.

    Null texts, empty ones and those without a letter get ``und`` and score 0, as do all texts where no row teaches a language.
    Repeated rows teach and are predicted each.
    """
    filters = train_filters(docs.where(~held_out()))
    return predict_language(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` without the documents whose language is ``und``, or none of ``wanted`` where that is given.

    The filters learn from the labels of ``docs`` itself. ``und`` are null and empty texts and those without a letter; that alone is
    what goes where ``wanted`` is None. Where no row teaches a language none can be told, so every text with a letter stays;
    with ``wanted`` that is an error. All columns stay, repeated rows are judged each, and rows are judged where they lie.
    """
    filters = train_filters(docs.where(~held_out()))
    if wanted is not None and not filters.languages:
        raise ValueError("no document teaches a language")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(text: str | None) -> bool:
        if not shared.value.languages:
            return bool(text) and any(map(str.isalpha, text))
        told = identify(text, shared.value)[0]
        return told != UNKNOWN and (wanted is None or told in wanted)

    return kept_rows(docs, ["text"], lambda batch: [keep(t) for t in batch.column("text").to_pylist()])
