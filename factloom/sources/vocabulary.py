"""The domain vocabulary: an input of the engine, given as tables or as plain tuples."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from factloom.functions import fixed_values as fv
from factloom.session import parameter_table, take_bounded

# A vocabulary is read as configuration by ``from_tables``; longer lists of names are joined as tables
# (``extraction.find_mentions_join``).
MAX_ENTRIES = 200_000


def header_key(text: str) -> str:
    """Driver-side twin of ``functions.text.header_key`` for vocabulary entries."""
    return re.sub(r"\s+", "", re.sub(r"[（(].*?[)）]|[（(][^)）]*$", "", text)).lower()


@dataclass(frozen=True)
class Field:
    name: str
    unit: str | None = None
    entity_type: str | None = None
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    """Fields in catalog order, entity names in dictionary order, unit factors."""

    fields: tuple[Field, ...] = ()
    names: tuple[str, ...] = ()
    factors: tuple[tuple[str, str, str, float, float], ...] = fv.UNIT_FACTORS
    entity_headers: tuple[str, ...] = ()
    date_headers: tuple[str, ...] = ()
    cell_units: tuple[str, ...] = fv.CELL_UNITS
    prose_units: tuple[str, ...] = fv.PROSE_UNITS
    text_fields: tuple[str, ...] = fv.PARTY_FIELDS
    date_fields: tuple[str, ...] = (fv.SIGNING_DATE_FIELD,)
    entity_required: tuple[str, ...] = ("city",)
    name_suffixes: tuple[str, ...] = fv.ENTITY_SUFFIXES
    alias_rows: tuple[tuple[str, str, str, int], ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        rows = [
            (alias, header_key(alias), f.name, ord_)
            for ord_, f in enumerate(self.fields)
            for alias in dict.fromkeys((f.name, *f.aliases))
        ]
        object.__setattr__(self, "alias_rows", tuple(rows))
        for name in ("entity_headers", "date_headers"):
            object.__setattr__(self, name, tuple(header_key(h) for h in getattr(self, name)))

    @property
    def header_lookup(self) -> dict[str, str]:
        """Alias key → field; a later field overwrites an earlier one."""
        return {key: name for _, key, name, _ in self.alias_rows}

    def header_table(self, spark: SparkSession) -> DataFrame:
        rows = list(self.header_lookup.items())
        return parameter_table(spark, rows, "alias_key string, field string")

    def field_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.name, f.unit, f.entity_type) for f in self.fields]
        schema = "field string, canonical_unit string, field_entity_type string"
        return parameter_table(spark, rows, schema)

    def factor_table(self, spark: SparkSession) -> DataFrame:
        schema = "field string, from_unit string, to_unit string, mul double, div double"
        return parameter_table(spark, self.factors, schema)

    @classmethod
    def from_tables(cls, aliases: DataFrame, fields: DataFrame, names: DataFrame | None = None,
                    factors: DataFrame | None = None, **options) -> Vocabulary:
        """Read a vocabulary stored as tables.

        ``aliases(alias, field)``, ``fields(field, unit, entity_type, ord)``,
        ``names(name, ord)``, ``factors(field, from_unit, to_unit, mul, div)``.
        """
        by_field: dict[str, list[str]] = {}
        for row in take_bounded(aliases.select("alias", "field"), MAX_ENTRIES, "aliases"):
            by_field.setdefault(row["field"], []).append(row["alias"])
        rows = sorted(take_bounded(fields, MAX_ENTRIES, "fields"), key=lambda r: r["ord"])
        built = tuple(
            Field(r["field"], r["unit"], r["entity_type"], tuple(sorted(by_field.get(r["field"], ()))))
            for r in rows
        )
        if names is not None:
            name_rows = sorted(take_bounded(names, MAX_ENTRIES, "names"), key=lambda r: r["ord"])
            options["names"] = tuple(r["name"] for r in name_rows)
        if factors is not None:
            cols = ("field", "from_unit", "to_unit", "mul", "div")
            options["factors"] = tuple(
                tuple(r[c] for c in cols) for r in take_bounded(factors, MAX_ENTRIES, "factors")
            )
        return cls(fields=built, **options)
