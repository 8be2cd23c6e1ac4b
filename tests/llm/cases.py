"""Documents that every operator has to survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with what operators return or use inside.
CLASHING = ("keep_id string, kept int, digest string, fp string, fingerprint string, component_id string, shard string, slot string, "
            "start string, n string, part string, host string, score string, toxic string, held_out string, label string, _slice int, _n int, body string")

ODD_TEXTS = [
    None, "", " ", "\n", "a", "a  b", "a b", "a\tb", "x y   z", "The cat, the cat; the cat!", "don't WE'RE I'll 12345",
    "<|endoftext|> x<|endoftext|>y <|startoftext|>", "Ünï É Σας ΟΔΟΣ İstanbul é", "日本語 テスト 😀😀 ​.", "a\n\nb c\n d \n e\t f\x1cg\x85h",
    " leading", "trailing ", "x   y    z", "--- *** ...", "0 1 2", "q" * 5000, "word " * 3000,
]


def documents(spark):
    """Odd texts under ids of their own, then repeated rows, a repeated id with another text, and null ids."""
    rows = [(n, text, "en", "s", None) for n, text in enumerate(ODD_TEXTS)]
    rows += [(4, "a", "en", "s", None), (4, "another text under the same id", None, None, 3), (None, "a text without an id", "en", None, 1),
             (None, "a text without an id", "en", None, 1), (None, None, None, None, None), (100, "a  b", None, "t", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    """Two equal rows and one more, with columns named like those of the operators."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(n, t, "en", "s", 1, *[None] * len(names)) for n, t in ((1, "one two three four"), (2, "one two three four"), (3, "five six"))]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


def empty(spark, schema: str = SCHEMA):
    return spark.createDataFrame([], schema)


def table(df) -> list[tuple]:
    """Rows in a fixed order, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(type(v)), v) if not isinstance(v, list) else (True, "", str(v)) for v in r])
