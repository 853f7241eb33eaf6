"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import ast
from collections import Counter
from pathlib import Path

import pytest
from oracle import differences
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm.decontaminate import leaks
from marginalia.llm.minhash import near_duplicates
from marginalia.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], FOLDER) is None


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    # Rows without doc_id and with one that others have: each is judged by itself.
    long = docs.filter("doc_id = 0").first()["text"]
    odd = [
        (9001, "12 34", "en", "x", 5), (9002, None, None, None, None), (None, None, "en", "y", 0),
        (None, f"{long}\n{leak}", "en", "x", 10), (None, docs.filter("doc_id = 1").first()["text"], "en", "x", 11), (0, "12 34", "en", "x", 5),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.filter("doc_id = 2"))
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert after.filter(F.col("offset") + F.col("length") > 2048).count() == 0
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert after.columns == corpus_pipeline.COLUMNS
        before, left = Counter(map(tuple, docs.collect())), Counter(map(tuple, after.collect()))
        assert not left - before
        numbered = spark.createDataFrame([(k, *row[1:]) for k, row in enumerate(sorted(before, key=str))], docs.schema)
        own = dict(enumerate(sorted(before, key=str)))
        rows[name] = left
        gone = {row for row in before if not left[row]}
        if name == "language":
            assert {row[:2] for row in map(tuple, odd) if row[1] in (None, "12 34")} == {row[:2] for row in gone if row[1] in (None, "12 34")}
            assert all(left[row] == before[row] for row in left)
        elif name == "near_duplicates":
            # One document of every group is left, and one of equal rows.
            groups = {own[r["doc_id"]]: r["component_id"] for r in near_duplicates(numbered).collect()}
            assert Counter(groups[row] for row in left) == Counter(set(groups.values()))
            assert max(left.values()) == 1 and max(before.values()) == 2
        elif name == "decontamination":
            found = leaks(numbered, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert gone == {own[r["doc_id"]] for r in found.collect()}
            assert not any(row[1] is not None and leak in row[1] for row in left)
        docs = after
    # The row without doc_id, a copy of a document, is one of its group.
    assert len([row for row in rows["near_duplicates"] if row[1] == odd[4][1]]) <= 1


def test_stages_of_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "marginalia").rglob("*.py"):
        if path.parent.name != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in (getattr(node, "module", None) or "") + " ".join(a.name for a in node.names)
