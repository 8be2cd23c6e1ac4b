"""Quality of a text by a factorisation machine over hashed words, structure statistics and metadata.

The machine scores ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs are summed in linear time, since for each
factor f the sum over pairs is half of ``(sum v_if x_i)^2 - sum v_if^2 x_i^2``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches, remainder, small_batches, words

PER_CLASS = 4_000  # labelled documents of each class that the machine is fitted on, in expectation
WORDS = 1 << 14  # slots of hashed words
BINS = 32  # slots of a statistic
FACTORS = 8
EPOCHS, MINI, RATE, RIDGE = 12, 128, 0.1, 1e-5
CHUNK = 1 << 19  # words of which features are held at once; a longer text is a chunk by itself

_CLASSES = ("letter", "upper", "digit", "space", "mark", "symbol", "beyond")  # classes of bytes
STATISTICS = ("words", "mean word", "distinct words", "top word", "repeated word", "lines", "mean line", "distinct lines", *_CLASSES, "marks a word", "symbols a word", "stated length")
SLOTS = WORDS + BINS * len(STATISTICS)


def _byte_classes() -> np.ndarray:
    def kind(b: int) -> str:
        c = chr(b)
        if b >= 128:
            return "beyond"
        if c.isalpha():
            return "upper" if c.isupper() else "letter"
        if c.isdigit():
            return "digit"
        if c in " \t\n\x0b\x0c\r":
            return "space"
        return "mark" if c in ".,;:!?'\"()-" else "symbol"

    return np.array([_CLASSES.index(kind(b)) for b in range(256)], np.uint8)


_CLASS_OF = _byte_classes()


@dataclass
class Features:
    """Sparse rows: the slots and values of row i are those from ``starts[i]`` up to the next start; no row is empty."""

    starts: np.ndarray
    slots: np.ndarray
    values: np.ndarray


def _share(part, whole) -> np.ndarray:
    """Shares from 0 to 1 in equal bins."""
    return np.minimum(BINS - 1, np.asarray(part, float) / np.maximum(whole, 1) * BINS).astype(np.int64)


def _size(n) -> np.ndarray:
    """Sizes in bins of half a power of two."""
    return np.minimum(BINS - 1, 2 * np.log2(1 + np.asarray(n, float))).astype(np.int64)


def features(texts: list[str], stated: list[int | None]) -> Features:
    """Slots and values of each text; null and empty texts have their statistics. ``stated`` is the length the table gives.

    The words of a text share the squared length 1, and so do its statistics; each word counts by the logarithm of its number.
    """
    read = [words(t) for t in texts]
    n = np.array([len(r) for r in read], np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    coded = pa.array([w for r in read for w in r], pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary.to_pylist()
    slot_of = np.array([zlib.crc32(w) & (WORDS - 1) for w in vocabulary], np.int64)
    length_of = np.array([len(w) for w in vocabulary], np.int64)
    pair, count = np.unique(row * max(1, len(vocabulary)) + code, return_counts=True)
    pair_row = pair // max(1, len(vocabulary))
    # Different words of one slot add up.
    key, place = np.unique(pair_row * WORDS + (slot_of[pair % len(vocabulary)] if len(vocabulary) else pair), return_inverse=True)
    value = np.log1p(np.bincount(place, count, key.size))
    word_row, word_slot = key // WORDS, key % WORDS
    value /= np.sqrt(np.bincount(word_row, value * value, len(texts)))[word_row]

    distinct, top = np.bincount(pair_row, minlength=len(texts)), np.zeros(len(texts), np.int64)
    np.maximum.at(top, pair_row, count)
    repeated = np.bincount(row[1:][(code[1:] == code[:-1]) & (row[1:] == row[:-1])], minlength=len(texts))
    letters = np.bincount(row, length_of[code] if code.size else None, len(texts))
    raw = [t.encode("utf-8", "replace") for t in texts]
    bytes_of = np.stack([np.bincount(_CLASS_OF[np.frombuffer(r, np.uint8)], minlength=len(_CLASSES)) for r in raw]).astype(float)
    size = bytes_of.sum(1)
    lines = [t.splitlines() or [""] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    by_class = dict(zip(_CLASSES, bytes_of.T))
    length = np.array([-1 if s is None else max(0, s) for s in stated], float)
    binned = {
        "words": _size(n), "mean word": _size(letters / np.maximum(n, 1)), "distinct words": _share(distinct, n), "top word": _share(top, n),
        "repeated word": _share(repeated, n), "lines": _size(n_lines), "mean line": _size(size / n_lines),
        "distinct lines": _share([len(set(x)) for x in lines], n_lines),
        **{c: _share(np.sqrt(by_class[c] * size), size) for c in _CLASSES},
        "marks a word": _share(by_class["mark"], 4 * n), "symbols a word": _share(by_class["symbol"], 4 * n),
        "stated length": np.where(length < 0, 0, _size(np.maximum(length, 0))),
    }
    statistic_slot = np.stack([WORDS + BINS * i + binned[name] for i, name in enumerate(STATISTICS)], 1).ravel()
    rows = np.concatenate([word_row, np.repeat(np.arange(len(texts)), len(STATISTICS))])
    order = np.argsort(rows, kind="stable")
    slots = np.concatenate([word_slot, statistic_slot])[order]
    values = np.concatenate([value, np.full(statistic_slot.size, len(STATISTICS) ** -0.5)])[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])[:-1]
    return Features(starts, slots.astype(np.int32), values.astype(np.float32))


def chunks(texts: list[str | None], stated: list[int | None]) -> Iterator[Features]:
    """Features of runs of texts that are about ``6 * CHUNK`` characters together."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= 6 * CHUNK or at + 1 == len(texts):
            yield features([t or "" for t in texts[start:at + 1]], stated[start:at + 1])
            start, held = at + 1, 0


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # one weight a slot
    factors: np.ndarray  # FACTORS numbers a slot

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, and the factor sums of each row and each feature."""
        each = self.factors[f.slots] * f.values[:, None]
        total = np.add.reduceat(each, f.starts)
        squares = np.add.reduceat(each * each, f.starts)
        linear = np.add.reduceat(self.linear[f.slots] * f.values, f.starts)
        return self.bias + linear + 0.5 * (total * total - squares).sum(1), total, each

    def probability(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0].astype(float), -500, 500)))


def fit(f: Features, label: np.ndarray, weight: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss by AdaGrad over small batches; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SLOTS, np.float32), rng.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32))
    seen_bias, seen_linear, seen_factors = 1e-6, np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6)
    ends = np.append(f.starts[1:], f.slots.size)
    weight = weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(label.size)
        for at in range(0, label.size, MINI):
            rows = order[at:at + MINI]
            sizes = ends[rows] - f.starts[rows]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            source = np.repeat(f.starts[rows] - starts, sizes) + np.arange(sizes.sum())
            batch = Features(starts, f.slots[source], f.values[source])
            raw, total, each = machine.parts(batch)
            slope = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / rows.size
            by_feature = np.repeat(slope, sizes) * batch.values
            touched, place = np.unique(batch.slots, return_inverse=True)
            linear = np.bincount(place, by_feature, touched.size) + RIDGE * machine.linear[touched]
            pulls = by_feature[:, None] * (np.repeat(total, sizes, 0) - each)
            factors = np.stack([np.bincount(place, pulls[:, k], touched.size) for k in range(FACTORS)], 1) + RIDGE * machine.factors[touched]
            bias = float(slope.sum())
            seen_bias += bias * bias
            seen_linear[touched] += linear * linear
            seen_factors[touched] += factors * factors
            machine.bias -= RATE * bias / seen_bias ** 0.5
            machine.linear[touched] -= RATE * linear / np.sqrt(seen_linear[touched])
            machine.factors[touched] -= RATE * factors / np.sqrt(seen_factors[touched])
    return machine


# ---------------------------------------------------------------- learning


def _with_length(docs: DataFrame):
    """The length the table states (null where it has no such column)."""
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Fit on ``docs(doc_id, text[, n_chars])`` with ``labels(doc_id, quality)``.

    Only ids whose crc32 leaves no 1 modulo 3 teach; of several labels of an id the highest counts, of several rows of an id the
    smallest text; null ids and labels other than 0 and 1 are passed over. About ``per_class`` documents of each label are drawn
    by the hash of their id and weighted back to their share, so the sample (at most ``SLOTS`` numbers a document) is bounded
    and fitted in one place. Where a label has no document, every text scores the share of label 1 (0 without labels).
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("quality").alias("quality"))
    marks = marks.where(remainder("_doc", 3) != 1)
    sizes = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Machine(500.0 if 1 in sizes else -500.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32))
    share = F.when(F.col("quality") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    drawn = marks.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("weight", 1 / share)
    # At most about 2 * per_class narrow rows, whatever the tables hold.
    rows = (docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct("text", _with_length(docs)).alias("seen")).join(F.broadcast(drawn), "_doc")
            .groupBy("_doc").agg(F.min("seen").alias("seen"), F.first("quality").alias("quality"), F.first("weight").alias("weight"))
            .select("_doc", "quality", "weight", "seen.text", "seen.n_chars"))

    def sparse(batch: pa.RecordBatch) -> dict:
        slots, values = [], []
        for f in chunks(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()):
            slots += np.split(f.slots, f.starts[1:])
            values += np.split(f.values, f.starts[1:])
        return {"doc": batch.column("_doc"), "quality": batch.column("quality"), "weight": batch.column("weight"),
                "slots": pa.array(slots, pa.list_(pa.int32())), "x": pa.array(values, pa.list_(pa.float32()))}

    sample = in_batches(rows, sparse, "doc long, quality int, weight double, slots array<int>, x array<float>").toArrow().sort_by("doc").combine_chunks()
    if not sample.num_rows:
        return Machine(0.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32))
    sizes = pa.compute.list_value_length(sample.column("slots")).to_numpy()
    flat = [pa.compute.list_flatten(sample.column(c)).to_numpy() for c in ("slots", "x")]
    f = Features(np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), *flat)
    return fit(f, sample.column("quality").to_numpy().astype(float), sample.column("weight").to_numpy())


# ---------------------------------------------------------------- scoring


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text[, n_chars])``, whole texts; null and empty texts get a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rows(batch: pa.RecordBatch) -> dict:
        score = np.concatenate([shared.value.probability(f) for f in chunks(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())])
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return in_batches(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", _with_length(docs)), rows,
                      "doc_id long, score double, predicted int")


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out, score all; a null id is not held out, repeated rows score alike."""
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score_quality(docs, train_quality(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
