"""Token-id files with a minimal perfect hash index from document keys to places in the shards.

Layout of a store (a folder in the shared file system):

* ``tokens-NNNNN.bin``: 16 bytes of header (magic, bytes per id), then the ids of the shard's documents, raw and
  little-endian, in ascending document order. An id takes 2 bytes while the vocabulary allows it, else 4.
* ``index-NNNNN.mph``: the keys whose hash falls into this part. A cascade of bit arrays is the minimal perfect hash:
  a key is placed on the first level where no other key shares its bit, and its slot is the rank of that bit. Per slot
  the file keeps a 32-bit fingerprint, shard, offset, number of ids and the running number of its first id.

A key is (doc_id, occurrence), so repeated ids are separate records; a null id is a key like any other and sorts first.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm.bpe import LATIN_END, byte_letters
from factloom.llm.shared import atomic_file, file_system, qualified, small_batches, stored
from factloom.session import scratch_path

MAGIC = b"FLTOKEN1"
INDEX_MAGIC = b"FLINDEX1"
HEADER = 16
LEVELS = 48
CACHED = 400_000  # fragments in each generation of a worker's cache


# ---------------------------------------------------------------- encoding

# The letter that stands for each byte in a byte-level vocabulary.
BYTE_LETTERS = dict(enumerate(byte_letters()))
BLANK = BYTE_LETTERS[ord(" ")]


class _Fragments(dict):
    """Ids of text fragments as raw bytes, each encoded by the tokenizer on first use.

    A cache of two generations: when it is full, the older entries go unless they were used since the last turn.
    """

    def __init__(self, tokenizer: Tokenizer, code: str, before: str):
        super().__init__()
        self.tokenizer, self.model, self.code, self.before, self.old = tokenizer, tokenizer.model, code, before, {}
        self.marks = {m: self._encode(m) for m in ".,;:!?"}

    def __missing__(self, fragment: str) -> bytes:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        raw = self.old.get(fragment)
        if raw is None:
            if fragment[-1:] in self.marks and fragment[-2:-1].isalpha() and fragment[-2] < LATIN_END:
                # A mark after a letter is a piece of its own.
                raw = self[fragment[:-1]] + self.marks[fragment[-1]]
            else:
                raw = self._encode(self.before + fragment)
        self[fragment] = raw
        return raw

    def _encode(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and max(word) < LATIN_END:
            # Latin letters after at most one blank are a single piece: only the model has work to do.
            if word.isascii():
                letters = word if word is text else BLANK + word
            else:
                letters = text.encode().decode("latin-1").translate(BYTE_LETTERS)
            return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Whole texts to raw ids, equal to encoding each text in one call.

    The byte-level pre-tokenizer starts a piece at every single space between two characters that are no white
    space, and keeps a single line feed between two such characters as a piece of its own. Cutting there changes
    nothing, and the fragments repeat, so each is encoded once per worker.
    """

    single_space = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else "I"
        self.width = array(self.code).itemsize
        self.first = _Fragments(self.tokenizer, self.code, "")
        self.later = _Fragments(self.tokenizer, self.code, " ")

    def raw(self, text: str) -> bytes:
        if not text:
            return b""
        if self._plain(text):
            lines = text.split("\n")
            # Printable characters are no white space but the blank.
            if all(map(str.isprintable, lines)):
                later, feed, parts = self.later.__getitem__, self.first["\n"], []
                for line in lines:
                    first, *words = line.split(" ")
                    parts += [feed, self.first[first], *map(later, words)]
                return b"".join(parts[1:])
        words = self.single_space.split(text)
        return self.first[words[0]] + b"".join([self.later[w] for w in words[1:]])

    @staticmethod
    def _plain(text: str) -> bool:
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text
                    or text[0].isspace() or text[-1].isspace())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- minimal perfect hash


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of each key per level (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bit arrays, slot = rank of the key's bit.

    Keys with equal 64-bit hashes can never be told apart by the levels; they follow in ``rest`` (hash, fingerprint).
    """

    def __init__(self, levels: list[np.ndarray], rest: list[tuple[int, int]]):
        self.levels, self.rest = levels, rest
        self.ranks, self.before, total = [], [], 0
        for bits in levels:
            self.before.append(total)
            self.ranks.append(np.cumsum(bits, dtype=np.int64))
            total += int(self.ranks[-1][-1]) if bits.size else 0
        self.placed = total

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The function and the slot of each key."""
        levels, left = [], np.arange(keys.size)
        for level in range(LEVELS):
            if not left.size:
                break
            size = max(8, 2 * left.size)
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        made = cls(levels, [(int(keys[i]), int(prints[i])) for i in left])
        return made, made.slots(keys, prints)

    def slots(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Slot per key, -1 for keys that are certainly absent."""
        out, left = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for level, bits in enumerate(self.levels):
            if not left.size:
                break
            at = (_mix(keys[left], level) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]] - 1
            left = left[~hit]
        if self.rest:
            places = {k: self.placed + n for n, k in enumerate(self.rest)}
            for i in left:
                out[i] = places.get((int(keys[i]), int(prints[i])), -1)
        return out


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("start", "<u8")])


def write_index(folder: str, name: str, keys: np.ndarray, entries: np.ndarray) -> None:
    function, slots = PerfectHash.build(keys, entries["print"])
    placed = np.zeros(keys.size, ENTRY)
    placed[slots] = entries
    with atomic_file(folder, name) as out:
        out.write(INDEX_MAGIC + struct.pack("<QII", keys.size, len(function.levels), len(function.rest)))
        for bits in function.levels:
            out.write(struct.pack("<Q", bits.size) + np.packbits(bits).tobytes())
        for key, fingerprint in function.rest:
            out.write(struct.pack("<QI", key, fingerprint))
        out.write(placed.tobytes())


def read_index(folder: str, name: str) -> tuple[PerfectHash, np.ndarray]:
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{name}") as src:
        raw = src.read()
    if raw[:8] != INDEX_MAGIC:
        raise ValueError(f"{name} is no index file")
    n, levels, rest = struct.unpack_from("<QII", raw, 8)
    at, bits = 24, []
    for _ in range(levels):
        (size,) = struct.unpack_from("<Q", raw, at)
        packed = (size + 7) // 8
        bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, packed, at + 8), count=size).astype(bool))
        at += 8 + packed
    pairs = [struct.unpack_from("<QI", raw, at + 12 * i) for i in range(rest)]
    return PerfectHash(bits, pairs), np.frombuffer(raw, ENTRY, n, at + 12 * rest)


# ---------------------------------------------------------------- store


def key_columns(doc_id: Column, occurrence: Column) -> list[Column]:
    """64-bit key hash and 32-bit fingerprint of a document key."""
    parts = [F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), occurrence.cast("long")]
    return [F.xxhash64(*parts).alias("key"),
            F.xxhash64(F.lit("fingerprint"), *parts).bitwiseAND(F.lit(0xFFFFFFFF)).alias("print")]


def write_store(docs: DataFrame, tokenizer: str, end_id: int | None = None, *, shard_bytes: int = 16 << 20,
                part_keys: int = 16_384, path: str | None = None) -> dict:
    """Encode ``docs(doc_id, text)`` into a new token store and index it; returns its description.

    Rows are dealt by ranges of (doc_id, hash of the text, row), so equal ids may span shards; a shard is one
    task, one file. ``shard_bytes`` and ``part_keys`` size shards and index parts. Null texts are empty documents
    (only the end id). An empty table gives an empty store.
    """
    spark = docs.sparkSession
    folder = qualified(spark, path or scratch_path(spark, "tokens"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = ["doc_id", "tie", "row"]
    dealt = (
        rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(max(1, -(-size // shard_bytes)), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder, offset, last, seen = TaskContext.get().partitionId(), encoder(tokenizer), HEADER, object(), 0
        end = array(coder.code, [] if end_id is None else [end_id]).tobytes()
        batch = next(batches, None)
        if batch is None:
            return
        with atomic_file(folder, f"tokens-{shard:05d}.bin") as out:
            out.write(MAGIC + struct.pack("<II", coder.width, 0))
            while batch is not None:
                places = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = coder.raw(text.as_py()) + end
                    out.write(raw)
                    seen = seen + 1 if doc == last else 0
                    last = doc
                    places.append((doc, seen, shard, offset, len(raw) // coder.width))
                    offset += len(raw)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*places), kinds)] if places else [pa.array([], k) for k in kinds],
                    names=["doc_id", "seen", "shard", "offset", "n"])
                batch = next(batches, None)

    places = stored(small_batches(dealt).mapInArrow(write, "doc_id long, seen long, shard int, offset long, n long"), "places")
    width = encoder(tokenizer).width
    return {"folder": folder, "width": width, **index_store(places, folder, width, part_keys)}


def index_store(places: DataFrame, folder: str, width: int, part_keys: int) -> dict:
    """Write the index parts of a store from the places of its records."""
    shards = places.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard: running totals over shards are the only thing ordered as a whole.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(F.col("shard").alias("s_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s_start"))
    # A repeated id that continues in the next shard goes on counting there.
    runs = places.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("r_n"))
    earlier = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("doc_id").alias("r_doc"), F.col("shard").alias("r_shard"),
                       F.sum("r_n").over(earlier).alias("r_before")).where("r_before is not null")
    total = places.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ids")).first()
    parts = max(1, -(-total["n"] // part_keys))
    occurrence = F.col("seen") + F.coalesce("r_before", F.lit(0))
    start = F.col("s_start") + ((F.col("offset") - HEADER) / width).cast("long")
    located = (
        places.join(runs, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("shard") == F.col("r_shard")), "left")
        .join(starts, F.col("shard") == F.col("s_shard"))
        .select(*key_columns(F.col("doc_id"), occurrence), "shard", "offset", "n", start.alias("start"))
        .withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    )

    def build(keys: pa.Table) -> pa.Table:
        part = keys.column("part")[0].as_py()
        entries = np.zeros(keys.num_rows, ENTRY)
        for name in ENTRY.names:
            entries[name] = keys.column(name).to_numpy()
        write_index(folder, f"index-{part:05d}.mph", keys.column("key").to_numpy().view(np.uint64), entries)
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([keys.num_rows], pa.int64())})

    written = stored(located.groupBy("part").applyInArrow(build, "part int, keys long"), "index")
    built = written.agg(F.sum("keys").alias("n")).first()["n"] or 0
    if built != total["n"]:
        raise RuntimeError(f"the index holds {built} of {total['n']} records")
    return {"parts": parts, "records": total["n"], "ids": total["ids"] or 0}


def lookup(store: dict, keys: DataFrame) -> DataFrame:
    """Places of ``keys(doc_id, occurrence)``; keys that the store lacks give no row.

    Each key is hashed to its index part, its slot is computed and the fingerprint there compared.
    """
    folder, parts = store["folder"], store["parts"]
    hashed = keys.select("doc_id", "occurrence", *key_columns(F.col("doc_id"), F.col("occurrence"))).withColumn(
        "part", F.pmod("key", F.lit(parts)).cast("int"))

    def find(asked: pa.Table) -> pa.Table:
        function, entries = read_index(folder, f"index-{asked.column('part')[0].as_py():05d}.mph")
        prints = asked.column("print").to_numpy()
        slots = function.slots(asked.column("key").to_numpy().view(np.uint64), prints)
        found = np.flatnonzero(slots >= 0)
        found = found[entries["print"][slots[found]] == prints[found]]
        at = entries[slots[found]]
        return pa.table({
            "doc_id": asked.column("doc_id").take(pa.array(found)), "occurrence": asked.column("occurrence").take(pa.array(found)),
            "shard": pa.array(at["shard"].astype(np.int32)),
            **{c: pa.array(at[c].astype(np.int64)) for c in ("offset", "n", "start")},
        })

    if not store["records"]:
        return keys.sparkSession.createDataFrame([], "doc_id long, occurrence long, shard int, offset long, n long, start long")
    return hashed.groupBy("part").applyInArrow(
        find, "doc_id long, occurrence long, shard int, offset long, n long, start long")


def read_payloads(store: dict, places: DataFrame, partitions: int) -> DataFrame:
    """Read the ids of records from the shards: ``places`` with ``ids`` (binary, little-endian unsigned 32-bit).

    Records of a shard are read by one task in the order of the file.
    """
    folder = store["folder"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            rows, ids, held = [], [], 0
            for n, (shard, offset, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n")))):
                if shard != name:
                    fs, base = file_system(folder)
                    opened, name = fs.open_input_file(f"{base}/tokens-{shard:05d}.bin"), shard
                    head = opened.read(HEADER)
                    if head[:8] != MAGIC:
                        raise ValueError(f"shard {shard} is no token file")
                    width = struct.unpack_from("<I", head, 8)[0]
                opened.seek(offset)
                raw = opened.read(count * width)
                ids.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                rows.append(n)
                held += len(raw)
                if held > 8 << 20:
                    yield _with_ids(batch, rows, ids)
                    rows, ids, held = [], [], 0
            if rows:
                yield _with_ids(batch, rows, ids)

    schema = "doc_id long, occurrence long, shard int, n long, start long, ids binary"
    return places.repartition(partitions, "shard").sortWithinPartitions("shard", "offset").mapInArrow(read, schema)


def _with_ids(batch: pa.RecordBatch, rows: list[int], ids: list[bytes]) -> pa.RecordBatch:
    names = ["doc_id", "occurrence", "shard", "n", "start"]
    taken = pa.array(rows)
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in names), pa.array(ids, pa.binary())],
                                      names=[*names, "ids"])


def keys_of(docs: DataFrame) -> DataFrame:
    """Every key of a table: each doc_id with the occurrences it has."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("copies"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("occurrence"))


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, **sizes) -> DataFrame:
    """Write ``docs`` as a token store, then look every document up in it and digest the ids read from the files."""
    store = write_store(docs, tokenizer, end_id, **sizes)
    partitions = max(1, store["ids"] * store["width"] // (16 << 20), spark.sparkContext.defaultParallelism)
    return read_payloads(store, lookup(store, keys_of(docs)), partitions).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "occurrence", "shard")
