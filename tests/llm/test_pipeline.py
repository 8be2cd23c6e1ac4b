"""The pipeline, stage by stage, beside brute force over the given documents."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm.queries import QUERIES
from tests.llm import cases
from tests.llm.test_decontamination import naive_tiles
from tests.llm.test_simhash import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def brute(docs, items):
    """doc_id to text of what stays after each stage."""
    from factloom.llm.shared import words
    stages = [{d: t for d, t in docs.items() if t and any(map(str.isalpha, t))}]
    seen = {}
    for doc in sorted(stages[-1]):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[doc]), doc)
    stages.append({d: docs[d] for d in seen.values()})
    ids = sorted(stages[-1])
    component = brute_components(ids, [brute_fingerprint(docs[d]) for d in ids])
    stages.append({d: docs[d] for d, c in zip(ids, component) if d == c})

    def leaked(text):
        read = words(text)
        for own in items:
            shared = set(own) & set(read)
            if len(shared) >= 0.8 * len(set(own)):
                known = {w: n for n, w in enumerate(dict.fromkeys(own))}
                if naive_tiles([known.get(w, -1) for w in read if w in known or True], [known[w] for w in own], 5) >= 0.8 * len(own):
                    return True
        return False

    stages.append({d: t for d, t in stages[-1].items() if not leaked(t)})
    return stages


def test_stages_and_run(spark):
    from factloom.llm.shared import words
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {d: t for d, t in table.select("doc_id", "text").collect()}
    items = [words(t) for _, t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute(docs, items)
    now = table
    for (_, stage), kept in zip(corpus_pipeline.STAGES, want):
        now = stage(spark, now, FOLDER)
        assert now.columns == table.columns
        assert {d: t for d, t in now.select("doc_id", "text").collect()} == kept
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(want[-1]) and len(rows) == len(want[-1])
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_survive_odd_and_empty_tables(spark):
    for docs in (cases.documents(spark), cases.empty(spark), cases.clashing(spark)):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER)
        rows = now.collect()
        assert len(rows) <= docs.count()


def test_contract():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(QUERIES, key=lambda n: (len(n.split("_")[0]), n))[-1] and {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
