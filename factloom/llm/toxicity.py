"""Toxic passages as maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches, remainder, small_batches, words

PER_CLASS = 8_000  # labelled documents of each class that the model is learned from, in expectation
STEMS = (9, 8, 7, 6, 5, 4)  # letters of the word beginnings that stand in for words the model does not know
PRIOR = 0.05  # weight of the Dirichlet prior, as a part of all counts
LEAST = 3  # documents with a token that gets a score of its own
SIGNIFICANT = 3.0  # standard deviations of its log-odds
PASSAGE = 0.05  # chance that a clean document holds such a passage somewhere
CACHED = 200_000


def tokens_of(word: bytes) -> Iterator[bytes]:
    """The word, then its beginnings marked by an asterisk, in the order in which their scores are looked up."""
    yield word
    letters = word.decode("utf-8", "replace")
    for n in STEMS:
        if len(letters) > n:
            yield letters[:n].encode() + b"*"


@dataclass
class ToxicModel:
    """Token scores with the score of all other tokens, extreme-value parameter, and the final curve.

    Scores are natural log-odds of the toxic against the clean token distribution, so the decay rate lambda of the largest
    segment score of clean texts is 1; only K is fitted.
    """

    scores: dict[bytes, float]
    other: float
    scale: float = 1.0  # K
    slope: float = 0.0
    offset: float = 0.0
    _known: dict = field(default_factory=dict, repr=False)

    def score_of(self, word: bytes) -> float:
        found = self._known.get(word)
        if found is None:
            found = next((self.scores[t] for t in tokens_of(word) if t in self.scores), self.other)
            if len(self._known) >= CACHED:
                self._known.clear()
            self._known[word] = found
        return found

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Every significant toxic passage: first word, word after the last, bits above chance."""
        read, get = words(text or ""), self._known.get
        found = [get(w) or self.score_of(w) for w in read]
        if not read:
            return []
        out = []
        chance = math.log(self.scale * len(read))
        for start, end, score in segments(found):
            bits = score - chance  # -log of the expected number of such passages in a clean text
            if -math.expm1(-math.exp(-bits)) <= PASSAGE:
                out.append((start, end, bits))
        return out

    def statistic(self, text: str | None) -> float:
        return sum(bits for *_, bits in self.passages(text))

    def probability(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * self.statistic(text)))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, left to right, as (start, end, score); linear in the number of scores."""
    stack: list[list[float]] = []  # start, end, total before it, total with it
    total = 0.0
    for place, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [place, place + 1, before, total]
        while stack:
            # The nearest earlier segment that begins at a lower total; those between can no longer grow.
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= new[2]:
                at = stack[at][4] if len(stack[at]) > 4 else at - 1
            if at < 0 or stack[at][3] >= new[3]:
                new.append(at)
                break
            new[0], new[2] = stack[at][0], stack[at][2]
            del stack[at:]
        if len(new) == 4:
            new.append(-1)
        stack.append(new)
    return [(int(s), int(e), after - before) for s, e, before, after, _ in stack]


# ---------------------------------------------------------------- learning


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(toxic, weight, text) of the learning documents: about ``per_class`` of each label, drawn by the hash of their id."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(remainder("_doc", 5) != 0)
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    drawn = marks.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("weight", 1 / share)
    # At most about 2 * per_class narrow rows, whatever the tables hold.
    return docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(F.broadcast(drawn), "_doc").select("toxic", "weight", "text")


def _token_counts(rows: DataFrame) -> DataFrame:
    """Documents of each class that hold a token: words that one document repeats count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_token = (Counter(), Counter())
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                by_token[toxic].update({t for w in set(words(text or "")) for t in tokens_of(w)})
            tokens = [*dict.fromkeys([*by_token[0], *by_token[1]])]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), *(pa.array([c[t] for t in tokens], pa.int64()) for c in by_token)],
                                             names=["token", "clean", "toxic"])

    return small_batches(rows.select("toxic", "text")).mapInArrow(count, "token binary, clean long, toxic long")


def log_odds(clean, toxic, all_clean: float, all_toxic: float):
    """Log-odds ratio of a token between the classes under a Dirichlet prior, and its standard deviation (columns).

    The prior gives a token the part of the prior weight that it has of all counts.
    """
    weight = PRIOR * (all_clean + all_toxic)
    prior = F.lit(PRIOR) * (clean + toxic)
    t, c = toxic + prior, clean + prior
    ratio = F.log(t / (F.lit(all_toxic + weight) - t)) - F.log(c / (F.lit(all_clean + weight) - c))
    return ratio, F.sqrt(1 / t + 1 / c)


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    """Learn from ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``.

    Only ids whose crc32 leaves no 0 modulo 5 teach; of several labels of an id the highest counts; null ids and labels are
    passed over. The tokens that get a score come from a bounded number of documents, so the model is small. Without
    both classes every text scores 0.
    """
    rows = _labelled(docs, labels, per_class).persist()
    sums = _token_counts(rows).groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    is_word = ~F.col("token").cast("string").endswith("*")
    totals = sums.where(is_word).agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    all_clean, all_toxic = float(totals["c"] or 0), float(totals["t"] or 0)
    if not all_clean or not all_toxic:
        rows.unpersist()
        return ToxicModel({}, -1.0, 1.0, 0.0, -500.0)
    ratio, deviation = log_odds(F.col("clean"), F.col("toxic"), all_clean, all_toxic)
    scored = (sums.where(F.col("clean") + F.col("toxic") >= LEAST).withColumn("score", ratio)
              .where(F.abs(F.col("score")) >= SIGNIFICANT * deviation).select("token", "clean", "toxic", "score").toArrow().to_pylist())
    known = [r for r in scored if not r["token"].endswith(b"*")]
    rest_toxic = max(1.0, all_toxic - sum(r["toxic"] for r in known))
    rest_clean = max(1.0, all_clean - sum(r["clean"] for r in known))
    other = min(-0.01, math.log(rest_toxic / all_toxic) - math.log(rest_clean / all_clean))
    model = ToxicModel({bytes(r["token"]): r["score"] for r in scored}, other)
    _calibrate(model, rows)
    rows.unpersist()
    return model


def _calibrate(model: ToxicModel, rows: DataFrame) -> None:
    """Fit K on the clean documents, then the curve from statistic to probability, both on the learning documents."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def largest(batch: pa.RecordBatch) -> dict:
        n, best = [], []
        for text in batch.column("text").to_pylist():
            read = words(text or "")
            n.append(len(read))
            best.append(max((s for *_, s in segments([shared.value.score_of(w) for w in read])), default=0.0))
        return {"n": pa.array(n, pa.int64()), "best": pa.array(best, pa.float64())}

    clean = in_batches(rows.where("toxic = 0").select("text"), largest, "n long, best double").where("n > 0").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.exp(-F.col("best"))).alias("z")).first()
    # Largest likelihood of K where P(S < x) = exp(-K n exp(-x)); half a document more keeps it above 0.
    model.scale = (clean["m"] + 0.5) / max((clean["z"] or 0.0) + 0.5, 1e-9)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def statistics(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch.column("toxic"), "weight": batch.column("weight"),
                "x": pa.array([shared.value.statistic(t) for t in batch.column("text").to_pylist()], pa.float64())}

    found = in_batches(rows.select("toxic", "weight", "text"), statistics, "toxic int, weight double, x double").toArrow()
    x, y, w = (found.column(c).to_numpy().astype(float) for c in ("x", "toxic", "weight"))
    model.slope, model.offset = logistic_curve(np.minimum(x, 50.0), y, w)


def logistic_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression (Newton steps, ridge on both)."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - ridge * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


# ---------------------------------------------------------------- scoring


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``, whole texts; null and empty texts get a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict:
        score = np.array([shared.value.probability(t) for t in batch.column("text").to_pylist()], float)
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double, predicted int")


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, first_word, last_word, bits)``: every significant passage of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict:
        out = [(d, s, e - 1, b) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
               for s, e, b in shared.value.passages(t)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return {c: pa.array(list(v), k) for c, v, k in zip(("doc_id", "first_word", "last_word", "bits"), zip(*out) if out else [[]] * 4, kinds)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, first_word long, last_word long, bits double")


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, score all.

    Null and empty texts hold no passage and score what the curve gives for none; a null id is not held out and has no label; of
    several labels of an id the highest teaches; repeated rows score alike.
    """
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score_toxicity(docs, train_toxicity(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
