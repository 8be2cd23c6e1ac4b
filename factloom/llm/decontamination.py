"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Texts and items meet in a join on seeds, hashed windows of ``min_match`` words. A text is read once however large the benchmark is:
a bit filter over all seeds says which of its windows may be one, and only their hashes and places travel. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches, small_side, stored, words

MIN_MATCH = 5  # words of a tile
COVERAGE = 0.8  # part of an item's words that tiles must cover
FILTER_BITS = 1 << 27  # at most so many bits, 16 MB, tell the tasks which windows may be seeds
BITS_PER_SEED = 64  # where that fits; with fewer the filter lets more windows pass to the join

_BASE = 0x9E3779B97F4A7C15
_FEW_POWERS = 1 << 16


@functools.cache
def _few_powers() -> np.ndarray:
    out = np.full(_FEW_POWERS, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(n: int) -> np.ndarray:
    """Powers of the base up to the ``n``-th."""
    if n < _FEW_POWERS:
        return _few_powers()[:n + 1]
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefix_hashes(ids: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of every prefix, weighted so that windows compare after one multiplication."""
    return np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[:ids.size], dtype=np.uint64)])


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` ids (wrapping 64-bit; the multiplication moves all windows to the same power)."""
    if ids.size < length:
        return np.zeros(0, np.uint64)
    powers = _powers(ids.size)
    sums = _prefix_hashes(ids, powers)
    raw = sums[length:] - sums[:-length]
    return raw * powers[:raw.size][::-1] * np.uint64(pow(_BASE, _TOP - raw.size + 1, 1 << 64))


_TOP = 1 << 40  # common power: larger than the number of words of any text


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (place in doc, place in item, length), longest matches first.

    For a search length, hashes of the unmarked windows of the item are looked up among those of the document; hits are
    compared and extended. Matches are marked from the longest on; then the search length shrinks down to ``min_match``.
    Negative ids never match. Ties go to the first place in the document, then in the item.
    """
    free_doc, free_item, out = doc >= 0, item >= 0, []
    length = item.size
    while length >= min_match:
        found = _matches(doc, item, free_doc, free_item, length)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for d, i, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if free_doc[d:d + n].all() and free_item[i:i + n].all():
                free_doc[d:d + n] = free_item[i:i + n] = False
                out.append((d, i, n))
        # What an earlier tile cut short may still leave a match of this length.
        if not (found and _matches(doc, item, free_doc, free_item, length)):
            length = max(min_match, length // 2) if length > min_match else 0
    return out


def _matches(doc, item, free_doc, free_item, length) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``length``."""
    of_item = window_hashes(item, length)
    of_doc = window_hashes(doc, length)
    open_item = np.flatnonzero(_all_free(free_item, length))
    open_doc = np.flatnonzero(_all_free(free_doc, length))
    places = defaultdict(list)
    for i in open_item:
        places[int(of_item[i])].append(int(i))
    hits = open_doc[np.isin(of_doc[open_doc], of_item[open_item])]
    found = []
    for d in map(int, hits):
        for i in places[int(of_doc[d])]:
            if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                continue  # part of the match that begins before
            n, most = 0, min(doc.size - d, item.size - i)
            while n < most and free_doc[d + n] and free_item[i + n] and doc[d + n] == item[i + n]:
                n += 1
            if n >= length:
                found.append((d, i, n))
    return found


def _all_free(free: np.ndarray, length: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[length:] == taken[:-length] if free.size >= length else np.zeros(0, bool)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words of late."""

    MOST = 1 << 17  # about 25 MB of a worker, which lives on through the stages of a pipeline

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    return np.array([_HASHES[w] for w in words(text)], np.uint64)


# ---------------------------------------------------------------- seeds


def _digest(text: Column) -> Column:
    """Key of a text: equal texts are judged once."""
    return F.unhex(F.sha2(text, 256))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``(item, words)``: digest and word hashes of every different text of ``benchmark(item_id, text)`` that has words."""

    def read(batch: pa.RecordBatch) -> dict:
        found = [word_hashes(t) for t in batch.column("text").to_pylist()]
        some = [k for k, ids in enumerate(found) if ids.size]
        return {"item": batch.column("item").take(pa.array(some, pa.int64())), "words": pa.array([found[k].view(np.int64) for k in some], pa.list_(pa.int64()))}

    texts = benchmark.where("text is not null").select(_digest(F.col("text")).alias("item"), "text").dropDuplicates(["item"])
    return stored(in_batches(texts, read, "item binary, words array<bigint>"), "items")


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """``(item, hash, length, size)``: one row per window of an item of ``size`` words; an item shorter than a seed is its own seed."""

    def cut(batch: pa.RecordBatch) -> dict:
        out = [window_hashes(ids, min(min_match, ids.size)).view(np.int64) for ids in _lists(batch.column("words"))]
        sizes = [min(min_match, len(w)) for w in batch.column("words")]
        return {"item": batch.column("item"), "hashes": pa.array(out, pa.list_(pa.int64())), "length": pa.array(sizes, pa.int32()),
                "size": pa.array([len(w) for w in batch.column("words")], pa.int32())}

    cuts = in_batches(items, cut, "item binary, hashes array<bigint>, length int, size int")
    return stored(cuts.select("item", F.explode("hashes").alias("hash"), "length", "size"), "seeds")


def rare_seeds(seeds: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """``(hash, item)`` without the seeds of an item that most items share.

    Tiles that cover ``coverage`` of an item hold at least ``coverage * size / min_match`` of its windows. So all but one of that many
    may be left out, and a text that holds the item still meets it at one of the others.
    """
    needed = F.ceil(F.col("size") * F.lit(coverage) / F.least("size", F.lit(min_match)) - F.lit(1e-9))
    shared = seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("everywhere"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("everywhere"), "hash"))
    return seeds.join(shared, "hash").withColumn("rank", rank).where(F.col("rank") >= needed).select("hash", "item").distinct()


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for row in column:
        yield row.values.to_numpy().view(np.uint64)


class SeedFilter:
    """Two bits per seed in one array of a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (bits.size * 64).bit_length() + 1)

    @staticmethod
    def slots(hashes: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return tuple((hashes * np.uint64(m)) >> shift for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be seeds."""
        at = np.arange(hashes.size)
        for slot in self.slots(hashes, self.shift):
            slot = slot[at]
            at = at[(self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
        return at


def seed_filter(seeds: DataFrame, count: int, most_bits: int = FILTER_BITS) -> SeedFilter:
    """The filter over ``count`` seeds. Tasks set the bits, the driver gets their words: 16 MB of them at most, whatever the benchmark."""
    bits = min(max(10, (count * BITS_PER_SEED - 1).bit_length()), most_bits.bit_length() - 1)
    shift = np.uint64(64 - bits)

    def setting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for slot in SeedFilter.slots(batch.column("hash").to_numpy().view(np.uint64), shift):
                np.bitwise_or.at(held, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], names=["word", "bits"])

    words_of = seeds.select("hash").mapInArrow(setting, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words_of.column("word").to_numpy()] = words_of.column("bits").to_numpy().view(np.uint64)
    return SeedFilter(out)


# ---------------------------------------------------------------- texts


def seed_hits(docs: DataFrame, shared, lengths: list[int], min_match: int) -> DataFrame:
    """``(digest, hashes, places)`` of each different text: its windows that may be seeds. ``shared`` is a broadcast ``SeedFilter``.

    Of a window shorter than ``min_match`` (a whole item) the first occurrence counts.
    """

    def read(batch: pa.RecordBatch) -> dict:
        some, hashes, places = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            ids = word_hashes(text)
            found = []
            for length in lengths:
                windows = window_hashes(ids, length)
                at = shared.value.may_hold(windows)
                if length < min_match:
                    at = at[np.unique(windows[at], return_index=True)[1]]
                found.append((windows[at], at))
            if any(at.size for _, at in found):
                some.append(k)
                hashes.append(np.concatenate([h for h, _ in found]).view(np.int64))
                places.append(np.concatenate([at for _, at in found]))
        return {"digest": batch.column("digest").take(pa.array(some, pa.int64())), "hashes": pa.array(hashes, pa.list_(pa.int64())),
                "places": pa.array(places, pa.list_(pa.int64()))}

    texts = docs.where(F.col("text").isNotNull()).select(_digest(F.col("text")).alias("digest"), "text")
    return in_batches(texts, read, "digest binary, hashes array<bigint>, places array<bigint>").dropDuplicates(["digest"])


def _stretches(hashes: np.ndarray, places: np.ndarray, item: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """The parts of a text that windows of the item make up, in order, as words of ``item`` with -1 between them."""
    order = np.argsort(windows, kind="stable")
    at = np.minimum(np.searchsorted(windows[order], hashes), order.size - 1)
    there = windows[order][at] == hashes
    span = np.arange(length)
    of_doc = (places[there][:, None] + span).ravel()
    of_item = item[(order[at[there]][:, None] + span).ravel()]
    places, first = np.unique(of_doc, return_index=True)
    return np.insert(of_item[first], np.flatnonzero(np.diff(places) > 1) + 1, -1)


def covered(hashes: np.ndarray, places: np.ndarray, item: np.ndarray, min_match: int, coverage: float) -> tuple[float, int, int] | None:
    """(coverage, tiles, words covered) of an item of word hashes by a text of which these windows are seeds, where it reaches ``coverage``."""
    length = min(min_match, item.size)
    windows = window_hashes(item, length)
    at = np.flatnonzero(np.isin(windows, hashes))
    if np.unique(at[:, None] + np.arange(length)).size < coverage * item.size:
        return None
    own = np.unique(item, return_inverse=True)[1].astype(np.int64)
    found = tiles(_stretches(hashes, places, own, windows, length), own, length)
    n = sum(m for *_, m in found)
    return (n / item.size, len(found), n) if n / item.size >= coverage else None


def matched(docs: DataFrame, benchmark: DataFrame, *, min_match: int, coverage: float, filter_bits: int) -> DataFrame | None:
    """``(digest, item, coverage, tiles, matched_words)`` for each different text that holds an item; None where no item has words."""
    items = benchmark_items(benchmark)
    seeds = item_seeds(items, min_match)
    counts = {r["length"]: r["n"] for r in seeds.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, sum(counts.values()), filter_bits))
    hits = stored(seed_hits(docs, shared, sorted(counts), min_match), "seed-hits")
    rare = stored(rare_seeds(seeds, min_match, coverage), "rare-seeds")
    pairs = hits.select("digest", F.explode(F.array_distinct("hashes")).alias("hash")).join(small_side(rare, 64), "hash").select("digest", "item").distinct()
    of_text = pairs.join(items, "item").groupBy("digest").agg(F.collect_list(F.struct("item", "words")).alias("items"))

    def tile(batch: pa.RecordBatch) -> dict:
        out = []
        columns = zip(batch.column("digest").to_pylist(), _lists(batch.column("hashes")), batch.column("places"), batch.column("items"))
        for digest, hashes, places, candidates in columns:
            places, rows = places.values.to_numpy(), candidates.values
            for item, ids in zip(rows.field("item").to_pylist(), _lists(rows.field("words"))):
                found = covered(hashes, places, ids, min_match, coverage)
                if found:
                    out.append((digest, item, *found))
        kinds = (pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32())
        return {c: pa.array(list(v), k) for c, v, k in zip(("digest", "item", "coverage", "tiles", "matched_words"), zip(*out) if out else [[]] * 5, kinds)}

    return stored(in_batches(hits.join(of_text, "digest"), tile, "digest binary, item binary, coverage double, tiles int, matched_words int"), "matched")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, item_id, coverage, tiles, matched_words)`` of every document that holds a benchmark item.

    Tiles of at least ``min_match`` words, in any order, must cover ``coverage`` of the item's words. Items shorter than that
    must occur whole, items without words never match. Null texts hold nothing; repeated documents and items are
    reported each. ``filter_bits`` bounds the filter that is sent to the tasks; the result does not depend on it.
    """
    schema = "doc_id long, item_id long, coverage double, tiles int, matched_words int"
    found = matched(docs, benchmark, min_match=min_match, coverage=coverage, filter_bits=filter_bits)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    ids = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), _digest(F.col("text")).alias("item"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"))
    return rows.join(small_side(found, 128), "digest").join(ids, "item").select("doc_id", "item_id", "coverage", "tiles", "matched_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; null and empty texts hold none, an empty benchmark keeps all."""
    found = matched(docs, benchmark, min_match=min_match, coverage=coverage, filter_bits=filter_bits)
    if found is None:
        return docs
    gone = small_side(stored(found.select(F.col("digest").alias("gone")).distinct(), "gone"), 64)
    return docs.join(gone, _digest(docs["text"]) == gone["gone"], "left_anti")
