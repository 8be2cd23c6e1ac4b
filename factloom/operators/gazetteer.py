"""Dictionary names in texts: one automaton over all names reads each text once, however many names there are.

The automaton (Aho-Corasick) is built once per Python worker from a broadcast list of names. A list longer than
``BLOCK_BYTES`` is cut into blocks by the hash of the name, and each block is one pass over the texts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20  # of names in one automaton
NAME_BYTES = 16  # what a name takes besides its text
_BUILT: dict[str, ahocorasick.Automaton] = {}  # of this worker, by the digest of the names
_KEPT = 2


@functools.lru_cache(maxsize=8)
def _shared(context_id: str, names: tuple[str, ...]) -> tuple[str, Broadcast]:
    """The names, sent to the executors once per application, with their digest."""
    digest = hashlib.sha256("\0".join(names).encode("utf-8", "surrogatepass")).hexdigest()
    return digest, SparkSession.active().sparkContext.broadcast(names)


def _automaton(digest: str, names: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a list of names: a name's value is its first place in the list."""
    built = _BUILT.get(digest)
    if built is None:
        built = ahocorasick.Automaton()
        for place, name in enumerate(names.value):
            if name and name not in built:
                built.add_word(name, place)
        if len(built):
            built.make_automaton()
        while len(_BUILT) >= _KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[digest] = built
    return built


def _places(automaton: ahocorasick.Automaton, text: str | None) -> list[int]:
    """Places of the names that occur in a text, ascending."""
    return sorted({place for _, place in automaton.iter(text)}) if text and len(automaton) else []


def _of_names(names: Sequence[str]) -> tuple[str, Broadcast]:
    return _shared(SparkSession.active().sparkContext.applicationId, tuple(names))


def normalised_names_in(c: Column, names: Sequence[str], normal: Sequence[str]) -> Column:
    """The normal forms of the names that a text contains, in the order of the list: array<string>; a null text contains none.

    ``normal`` has one form for each name. An empty name is in no text; a name given twice has its first place.
    """
    digest, shared = _of_names(names)
    _, forms = _of_names(normal)

    @F.arrow_udf("array<string>")
    def search(texts: pa.Array) -> pa.Array:
        automaton, form = _automaton(digest, shared), forms.value
        return pa.array([[form[p] for p in _places(automaton, t)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return search(c)


def first_name_in(c: Column, names: Sequence[str], normal: Sequence[str]) -> Column:
    """Of an array of texts, the first non-empty form, in list order, in the first text that contains any (null: none, or no array)."""
    digest, shared = _of_names(names)
    _, forms = _of_names(normal)

    @F.arrow_udf("string")
    def search(lists: pa.Array) -> pa.Array:
        automaton, form = _automaton(digest, shared), forms.value
        found = ([form[p] for t in texts or () for p in _places(automaton, t) if form[p]] for texts in lists.to_pylist())
        return pa.array([f[0] if f else None for f in found], pa.string())

    return search(c)


def contained(names: Sequence[str]) -> list[list[int]]:
    """For each name the places of the names that it contains: every name, of several equal ones each."""
    places: dict[str, list[int]] = {}
    for place, name in enumerate(names):
        places.setdefault(name, []).append(place)
    automaton = ahocorasick.Automaton()
    for name in places:
        if name:
            automaton.add_word(name, name)
    if not len(automaton):
        return [[] for _ in names]
    automaton.make_automaton()
    return [sorted({p for _, found in automaton.iter(name) for p in places[found]}) if name else [] for name in names]


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_in(c: Column, entries: Sequence[tuple[str, dict, tuple[str, ...]]], around: int, span: str) -> Column:
    """Where lower-case names stand in a text, in any case: array of ``span`` (start, end, then the columns of the entry), by start.

    An entry is (name, columns, names that hide it where one is within ``around`` characters of it).
    """
    names = tuple(dict.fromkeys(name for name, *_ in entries))
    digest, shared = _of_names(names)
    kinds = _span_types(span)
    of_name: dict[str, list] = {}
    for row, (name, columns, hiding) in enumerate(entries):
        of_name.setdefault(name, []).append((columns["ord"], row, hiding))
    # The columns of the entries are Arrow arrays from which spans take their rows, so no struct is built value by value.
    taken = [pa.array([columns[c] for _, columns, _ in entries], kind) for c, kind in kinds[2:]]
    table = SparkSession.active().sparkContext.broadcast(([of_name[n] for n in names], taken))

    @F.arrow_udf(f"array<{span}>")
    def search(texts: pa.Array) -> pa.Array:
        automaton, words = _automaton(digest, shared), shared.value
        of_place, taken = table.value

        def spans(text: str | None) -> list[tuple[int, int, int, int]]:
            out = []
            if text and len(automaton):
                low = lowered(text)
                for last, place in automaton.iter(low):
                    start, end = last + 1 - len(words[place]), last + 1
                    near = low[max(0, start - around):end + around]
                    out += [(start, ord_, end, row) for ord_, row, hiding in of_place[place] if not any(h in near for h in hiding)]
            return sorted(out, key=lambda s: s[:2])

        per_text = [spans(t) for t in texts.to_pylist()]
        offsets = pa.array([0, *itertools.accumulate(map(len, per_text))], pa.int32())
        flat = list(itertools.chain.from_iterable(per_text))
        rows = pa.array([row for *_, row in flat], pa.int32())
        places = [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32())]
        values = pa.StructArray.from_arrays([*places, *[t.take(rows) for t in taken]], fields=[pa.field(c, kind) for c, kind in kinds])
        return pa.ListArray.from_arrays(offsets, values)

    return search(c)


def _span_types(span: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(":") for f in span.removeprefix("struct<").removesuffix(">").split(",")]
    return [(name, kinds[kind]) for name, kind in fields]


def _blocks(names: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The names cut into blocks that stay below ``block_bytes`` on average."""
    size = names.agg(F.sum(F.octet_length("name") + NAME_BYTES)).first()[0] or 0
    n = 1 + int(size) // block_bytes
    return [names] if n == 1 else [names.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i) for i in range(n)]


def mentioned(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, ord, name)``: every name of ``names(name, ord)`` in every text of ``texts`` that contains it.

    Null and empty names and texts give no row; of equal names the smallest ``ord`` counts; repeated texts are searched row by row.
    Each block of names is one pass over the texts and is all that a worker holds.
    """
    single = names.where("name is not null and name <> ''").groupBy("name").agg(F.min("ord").alias("ord"))
    parts = []
    for block in _blocks(single, block_bytes):
        rows = block.toArrow()
        found = texts.select(id_col, F.explode(_named(F.col(text_col), rows)).alias("_at")).select(id_col, "_at.*")
        parts.append(found)
    return functools.reduce(DataFrame.unionByName, parts)


def _named(c: Column, rows: pa.Table) -> Column:
    """The names of a block that a text contains, with their ``ord``: array<struct<ord, name>>."""
    names = tuple(rows.column("name").to_pylist())
    digest, shared = _of_names(names)
    ords = SparkSession.active().sparkContext.broadcast(rows.column("ord").combine_chunks().cast(pa.int64()))

    @F.arrow_udf("array<struct<ord:bigint,name:string>>")
    def search(texts: pa.Array) -> pa.Array:
        automaton = _automaton(digest, shared)
        per_text = [_places(automaton, t) for t in texts.to_pylist()]
        flat = pa.array(itertools.chain.from_iterable(per_text), pa.int32())
        offsets = pa.array([0, *itertools.accumulate(map(len, per_text))], pa.int32())
        values = pa.StructArray.from_arrays([ords.value.take(flat), pa.array([shared.value[p] for p in flat.to_pylist()], pa.string())], ["ord", "name"])
        return pa.ListArray.from_arrays(offsets, values)

    return search(c)
