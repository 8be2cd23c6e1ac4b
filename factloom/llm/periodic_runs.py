"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch whose smallest period q repeats at least three times. An aligned block of 2^k words inside it with
2^k <= q < 2^(k+1) comes again q words later, so its occurrences in the window just behind it give every period in question.
All copies of a block are one interval of the suffix array; a wavelet tree over that array tells the next occurrence at or
after a word (range successor). Occurrences in a window no longer than the block form an arithmetic progression, so three
numbers describe them. Each candidate period is extended to both sides by ranks of dyadic substrings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches

LEAST = 24  # words of a run
REPEATS = 3  # periods of a run
FIRST = 3  # log2 of the smallest block; blocks of 8 words serve every period below 16, since a run has at least 24 words
CHUNK = 1 << 18  # words of documents searched together; a longer document is searched by itself
_SEED = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- wavelet tree


class WaveletTree:
    """Numbers below 2^bits in a level-wise wavelet tree; queries take arrays of intervals [left, right) of places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []  # bit, zeros before each place, number of zeros
        for bit in reversed(range(bits)):
            ones = (values >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than its limit."""
        count = np.zeros(left.size, np.int64)
        if self.levels:
            over = limit >= 1 << (self.levels[0][0] + 1)
            count[over] = (right - left)[over]
        else:
            over = limit > 0
            count[over] = (right - left)[over]
        for bit, zeros, n in self.levels:
            one = (limit >> bit) & 1 == 1
            l0, r0 = zeros[left], zeros[right]
            count += np.where(one & ~over, r0 - l0, 0)
            left, right = np.where(one, n + left - l0, l0), np.where(one, n + right - r0, r0)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each interval; k is less than the interval's length."""
        out = np.zeros(left.size, np.int64)
        for bit, zeros, n in self.levels:
            l0, r0 = zeros[left], zeros[right]
            one = k >= r0 - l0
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - (r0 - l0), k)
            left, right = np.where(one, n + left - l0, l0), np.where(one, n + right - r0, r0)
        return out


# ---------------------------------------------------------------- suffix array


@dataclass
class Suffixes:
    """Those places of a chunk where eight words stand that stand elsewhere in the same document too, ordered by what follows.

    ``ranks[k]`` numbers the substrings of 2^(FIRST + k) words at those places: the rank is where their interval of the suffix
    array begins, ``sizes[k]`` how long it is. All other places have substrings of their own, which no block needs.
    """

    places: np.ndarray
    array: np.ndarray
    ranks: list[np.ndarray]
    sizes: list[np.ndarray]
    number: np.ndarray  # of each place of the chunk among ``places``, -1 where it is none

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ranks at places of the chunk; a negative number of its own where the substring stands nowhere else."""
        inside = (at >= 0) & (at < self.number.size)
        index = np.where(inside, self.number[np.clip(at, 0, self.number.size - 1)], -1)
        return np.where(index >= 0, self.ranks[level][index], -2 - at) if self.places.size else -2 - at


def _repeated_eights(code: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places with eight words of their document whose hash another place of the chunk has too (all real repeats among them)."""
    width = 1 << FIRST
    at = np.flatnonzero(room >= width)
    hashed = np.zeros(at.size, np.uint64)
    for k in range(width):
        hashed = (hashed ^ code[at + k].astype(np.uint64)) * _SEED
        hashed ^= hashed >> np.uint64(29)
    order = np.sort(hashed)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not again.size:
        return at[:0]
    found = np.searchsorted(again, hashed)
    return at[again[np.minimum(found, again.size - 1)] == hashed]


def suffixes(code: np.ndarray, room: np.ndarray) -> Suffixes:
    """Prefix doubling over the repeated places. ``code`` numbers words, apart in each document; ``room`` counts the words up to its end."""
    at = _repeated_eights(code, room)
    reached = [at]
    for step in (4, 2, 1):
        reached.append(np.unique(np.concatenate([reached[-1], reached[-1] + step])))
    rank = np.zeros(code.size, np.int64)
    rank[reached[-1]] = code[reached[-1]]
    for step, seats in zip((1, 2, 4), (reached[2], reached[1], reached[0])):
        key = np.stack([rank[seats], rank[seats + step]])
        _, numbered = np.unique(key[0] * (code.max(initial=0) + code.size + 1) + key[1], return_inverse=True)
        rank = np.zeros(code.size, np.int64)
        rank[seats] = numbered
    eights = rank[at]
    count = np.bincount(eights, minlength=1)
    at, eights = at[count[eights] > 1], eights[count[eights] > 1]

    number = np.full(code.size, -1, np.int64)
    number[at] = np.arange(at.size)
    array = np.argsort(eights, kind="stable")
    out = Suffixes(at, array, [], [], number)
    if not at.size:
        return out
    opens = np.concatenate([[True], np.diff(eights[array]) > 0])
    longest = int(room[at].max())
    # Blocks of 2^k words serve runs of at least three times as many; beyond that the order of suffixes decides nothing.
    while True:
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, at.size))
        rank, sizes = np.empty(at.size, np.int64), np.empty(at.size, np.int64)
        rank[array], sizes[array] = np.repeat(start, size), np.repeat(size, size)
        out.ranks.append(rank)
        out.sizes.append(sizes)
        width = 1 << (FIRST + len(out.ranks) - 1)
        open_places = np.flatnonzero(np.repeat(size, size) > 1)
        if not open_places.size or 2 * width * REPEATS > longest:
            return out
        moving = array[open_places]
        here, there = rank[moving], at[moving] + width
        next_rank = np.where(there < at[moving] + room[at[moving]], out.rank(len(out.ranks) - 1, np.minimum(there, code.size - 1)), -1)
        # Ranks of places on their own lie beyond all others; equal ones cannot meet.
        next_rank = np.where(next_rank < -1, at.size - next_rank, next_rank) + 1
        order = np.argsort(here * (2 * code.size + at.size + 8) + next_rank, kind="stable")
        array[open_places] = moving[order]
        here, next_rank = here[order], next_rank[order]
        opens[open_places] = np.concatenate([[True], (np.diff(here) != 0) | (np.diff(next_rank) != 0)])


def extension(s: Suffixes, code: np.ndarray, first: np.ndarray, last: np.ndarray, one: np.ndarray, two: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``one`` on (or just before it) equal those from ``two`` on, inside the document [first, last)."""
    length = np.zeros(one.size, np.int64)
    top = len(s.ranks) - 1

    def step(level: int, width: int) -> np.ndarray:
        a, b = (one - length - width, two - length - width) if back else (one + length, two + length)
        fits = a >= first if back else b + width <= last
        if level >= 0:
            same = s.rank(level, a) == s.rank(level, b)
        else:
            same = code[np.clip(a, 0, code.size - 1)] == code[np.clip(b, 0, code.size - 1)]
        return fits & same

    active = np.ones(one.size, bool)
    while top >= 0 and active.any():  # as many steps of the widest block as fit
        active &= step(top, 1 << (FIRST + top))
        length[active] += 1 << (FIRST + top)
    for level in reversed(range(top)):
        length[step(level, 1 << (FIRST + level))] += 1 << (FIRST + level)
    active[:] = True
    for _ in range((1 << FIRST) - 1):
        active &= step(-1, 1)
        length[active] += 1
    return length


def runs(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of a chunk of documents as rows (first word, word after the last, period), by their first word, places counted in the chunk.

    ``code`` numbers the words of all documents one after the other, so that only equal words of one document have one number;
    ``sizes`` are the numbers of words.
    """
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    last = np.repeat(ends, sizes)
    s = suffixes(code, last - np.arange(code.size))
    if not s.places.size:
        return np.zeros((0, 3), np.int64)
    tree = WaveletTree(s.array, max(1, int(s.places.size - 1).bit_length()))
    found = []
    for level, (rank, size) in enumerate(zip(s.ranks, s.sizes)):
        width = 1 << (FIRST + level)
        aligned = ((s.places - first[s.places]) % width == 0) & (size > 1)
        block, left = s.places[aligned], rank[aligned]
        right = left + size[aligned]
        # Windows of starts behind a block that are less than a block long.
        windows = ((1, width - 1), (width, 2 * width - 1)) if level == 0 else ((width, 2 * width - 1),)
        for low, high in windows:
            before = tree.below(left, right, np.searchsorted(s.places, block + low))
            upto = tree.below(left, right, np.searchsorted(s.places, block + high + 1))
            hit = np.flatnonzero(upto > before)
            if not hit.size:
                continue
            here, l, r, at, number = block[hit], left[hit], right[hit], before[hit], (upto - before)[hit]
            successor = s.places[tree.smallest(l, r, at)]
            second = s.places[tree.smallest(l, r, np.minimum(at + 1, upto[hit] - 1))]
            # All members of the progression are candidates; a window before the block's own length has its period first.
            number = np.ones_like(number) if low == 1 else number
            member = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            other = np.repeat(successor, number) + member * np.repeat(second - successor, number)
            here = np.repeat(here, number)
            begin = here - extension(s, code, first[here], last[here], here, other, True)
            stop = other + extension(s, code, first[here], last[here], here, other, False)
            period = other - here
            good = stop - begin >= np.maximum(LEAST, REPEATS * period)
            found.append(np.stack([begin, stop, period], 1)[good])
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The smallest period of a stretch comes first; others of the same stretch are its multiples.
    fresh = np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)]) if len(rows) else np.zeros(0, bool)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


# ---------------------------------------------------------------- documents


def repeated_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the id asks for: one id in ten repeats a stretch of its words up to the end (null: none)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * times)[:n - a]


def word_codes(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, one document after the other (words of different documents never share one), and the sizes."""
    sizes = np.array([len(d) for d in documents], np.int64)
    coded = pa.array([w for d in documents for w in d], pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return code + np.repeat(np.arange(sizes.size), sizes) * len(coded.dictionary), sizes


def document_runs(documents: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """Of each document the runs as (start, length, period), by start, then period."""
    if not documents:
        return
    code, sizes = word_codes(documents)
    rows = runs(code, sizes)
    edges = np.searchsorted(rows[:, 0], np.concatenate([[0], np.cumsum(sizes)]))
    offset = 0
    for i, size in enumerate(sizes.tolist()):
        yield [(b - offset, e - b, q) for b, e, q in rows[edges[i]:edges[i + 1]].tolist()]
        offset += size


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length to period, exactly; the first one on a tie."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]


def _searched(documents: Iterator[tuple[int | None, list[bytes]]]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each document, ``CHUNK`` words at a time."""
    held: list[list[bytes]] = []
    total = 0
    for words in documents:
        held.append(words)
        total += len(words)
        if total >= CHUNK:
            yield from zip(held, document_runs(held))
            held, total = [], 0
    yield from zip(held, document_runs(held))


def _words(text: bytes | None) -> list[bytes]:
    """Runs of bytes that are no blank, tab, line break, vertical tab, form feed or return."""
    return (text or b"").split()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, length, period)``: every run of every text of ``docs(doc_id, text)``, as it stands; null and short texts have none."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = _searched(_words(t) for t in batch.column("text").cast(pa.binary()).to_pylist())
        out = [(d, *run) for d, (_, of_doc) in zip(batch.column("doc_id").to_pylist(), found) for run in of_doc]
        return {c: pa.array(list(v), pa.int64()) for c, v in zip(("doc_id", "start", "length", "period"), zip(*out) if out else [[]] * 4)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, start long, length long, period long")


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``, after ``repeated_words``: number of runs, the strongest one, digests of runs and of what is left.

    Null and empty texts have no word and no run; a null id repeats nothing; repeated rows and ids are searched row by row.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        best, n_runs, lines, left = [], [], [], []
        for words, found in _searched(repeated_words(_words(t), d) for t, d in zip(texts, ids)):
            n_runs.append(len(found))
            best.append(strongest(found) or (None, None, None))
            lines.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest())
            left.append(hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
        start, length, period = zip(*best)
        return {"doc_id": batch.column("doc_id"), "n_runs": pa.array(n_runs, pa.int64()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "period": pa.array(period, pa.int64()),
                "exponent_milli": pa.array([None if n is None else 1000 * n // q for n, q in zip(length, period)], pa.int64()),
                "runs_sha256": pa.array(lines), "collapsed_sha256": pa.array(left)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                      "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
