"""Helpers that the training-data operators share: stage tables, file writes, Arrow batches."""

from __future__ import annotations

import contextlib
import functools
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import materialised as stored  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BROADCAST_BYTES = 16 << 20


def small_side(side: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table as the side of a join: broadcast where its rows, counted here, fit the bound, else left to be shuffled."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, as tasks need it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def atomic_file(folder: str, name: str):
    """A file that appears under its name only when whole; a repeated task replaces it by the same bytes."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        yield out
    target = f"{base}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(target).type != pafs.FileType.NotFound:
        fs.delete_file(target)
    fs.move(part, target)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are set to 2 000 rows where nobody has set them: texts are long rows."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, "2000")
    return df


def in_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply a function from an Arrow batch to columns, batch by batch; nothing is kept between batches."""

    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = rows(batch)
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on; what Arrow keeps aside would add up over its stages

    return small_batches(df).mapInArrow(run, schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def remainder(key: str, divisor: int):
    """crc32 of an id's decimal text, modulo: which fold a document is in (null: no fold)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


def kept_rows(df: DataFrame, columns: list[str], keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows of ``df`` that a function of some of its columns, batch by batch, wants to keep; nothing is shuffled."""
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen = pa.RecordBatch.from_arrays([batch.column(p) for p in places], names=columns)
                yield batch.filter(pa.array(keep(seen), pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

# Scripts without spaces between words (ideographs, kana, Bopomofo, Thai, Lao, Burmese, Khmer), as first and last character.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def _beyond_ascii() -> re.Pattern:
    """Characters beyond ASCII that end a word; those that are a word each are the group. Others are letters, digits and marks."""

    def spans(chosen: Callable[[int], bool], first: int, last: int) -> str:
        out, start = [], None
        for code in range(first, last + 2):
            if code <= last and chosen(code):
                start = code if start is None else start
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        return "".join(out)

    def of_word(code: int) -> bool:
        return unicodedata.category(chr(code))[0] in "LNM"

    alone = "".join(spans(of_word, first, last) for first, last in _UNSPACED)
    between = spans(lambda code: not of_word(code), 0x80, 0x1FFFF) + r"\U000e0000-\U0010ffff"
    return re.compile(f"([{alone}])|[{between}]")


_BEYOND_ASCII = _beyond_ascii()
_FEW = 24  # different characters that are worth a pass over the text each


@functools.cache
def _set_off(character: str) -> str:
    """What stands for a character beyond ASCII: itself, itself between blanks, or blanks."""
    return _BEYOND_ASCII.sub(r" \1 ", character)


def words(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8: runs of letters, digits and marks; in scripts without spaces each character is a word."""
    lowered = text.lower()
    if not lowered.isascii():
        changed = [c for c in set(lowered) if c > "\x7f" and _set_off(c) != c]
        if len(changed) > _FEW:
            lowered = _BEYOND_ASCII.sub(r" \1 ", lowered)
        else:
            for c in changed:
                lowered = lowered.replace(c, _set_off(c))
    return lowered.encode("utf-8", "replace").translate(_WORD_BYTES).split()
