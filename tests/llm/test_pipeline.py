"""The stages on a whole small table, each against a plain version on its own input."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from tests.llm.brute import jaccard_components
from tests.llm.test_secrets import plain as plain_secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    inputs = {}
    for name, function in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        made = function(spark, docs, FOLDER)
        if name != "packing":
            assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
    packed = docs.collect()

    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    after = inputs["near_duplicates"]
    clean = [d for d in inputs["quality"] if labels.get(d) == 1]
    assert sum(d in after for d in clean) >= 0.97 * len(clean)

    found = jaccard_components([(d, r["text"]) for d, r in after.items()], 5, 80)
    assert set(inputs["decontamination"]) == {c for _, c in found.values()}

    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    before = inputs["decontamination"]
    leaked = {d for d, r in before.items() if any(t in r["text"] for t in items)}
    assert set(inputs["secrets"]) == set(before) - leaked

    assert set(inputs["packing"]) == set(inputs["secrets"])
    for doc, row in inputs["packing"].items():
        assert not plain_secrets(row["text"])
        same = not plain_secrets(inputs["secrets"][doc]["text"])
        assert not same or row["text"].count("[SECRET]") or row == inputs["secrets"][doc]
        assert row["n_chars"] == len(row["text"]) or row == inputs["secrets"][doc]

    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
    assert sizes == {d: len(r["text"].encode()) + 1 for d, r in inputs["packing"].items()}
