"""Guards on the physical plans: what must not appear at scale, and what must be pushed down."""

from __future__ import annotations

import ast
import re
from pathlib import Path

import pytest

from marginalia.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parents[1] / "marginalia"


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def parent_of(lines: list[str], number: int) -> str:
    """The operator above one in the printed plan tree."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    return next(line for line in reversed(lines[:number]) if depth(line) < depth(lines[number]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_single_task_stage(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "rangepartitioning" not in text, "a result is sorted as a whole"
    lines = [line for line in text.splitlines() if line.strip()]
    for number, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = parent_of(lines, number)
            # One task may end an aggregate of partial results, or sum up partition sizes.
            assert "Aggregate(" in above or "[_part#" in above, above


@pytest.mark.parametrize("name", ["coarse_search", "incremental_messages"])
def test_date_bound_reaches_the_scan(spark, name):
    text = plan(spark, name)
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "events" in line]
    assert any("DataFilters: [isnotnull(ts" in line and "ts#" in line for line in scans), scans
    assert any(">= " in line and "ubquery" in line for line in scans), scans


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("created_per_source", "events", {"event_id", "ts", "event_type", "value"}),
        ("tag_merge", "documents", {"doc_id", "lang", "source"}),
        ("batch_status", "documents", {"doc_id"}),
        ("domains", "pages", {"page_id", "url"}),
        ("results_dedup", "labels", {"doc_id", "quality", "toxic"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, table, columns):
    read = [
        set(re.findall(r"(\w+):", schema))
        for path, schema in re.findall(r"FileScan parquet .*?Location: \S+\(1 paths\)\[(\S+?)\].*?ReadSchema: struct<(.*?)>", plan(spark, name))
        if f"/{table}.parquet" in path
    ]
    assert read and all(found <= columns for found in read), read


@pytest.mark.parametrize("name", ["top_k_per_source", "notes_upsert", "results_dedup"])
def test_ranked_queries_prune_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


@pytest.mark.parametrize("name", ["clean_urls", "rule_scores", "takeaway_repair", "parse_results", "sane_dates", "safe_filenames", "mime_bodies", "page_metadata", "page_titles", "render_notes", "pdf_notes"])
def test_native_queries_do_not_use_python(spark, name):
    assert "EvalPython" not in plan(spark, name)


def test_yaml_writer_runs_once_per_note(spark):
    # One line of the plan holds the block; the layouts refer to its result.
    assert plan(spark, "render_notes").count("newsletter: ") == 1


def test_library_does_not_gather_rows_on_the_driver():
    found = []
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":  # has tests of its own
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute) and node.attr in ("collect", "toPandas", "toArrow", "localCheckpoint", "crossJoin"):
                found.append((path.name, node.attr))
    assert found == []


@pytest.mark.parametrize("name", ["unprocessed_notes", "inbox_scan", "parse_notes"])
def test_headers_are_parsed_once(spark, name):
    assert plan(spark, name).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["page_text", "page_markdown", "page_articles", "service_messages"])
def test_pages_go_to_python_in_small_groups(spark, name):
    text = plan(spark, name)
    # An Arrow batch would hold thousands of whole pages in each worker.
    assert "BatchEvalPython" in text and "ArrowEvalPython" not in text


def test_mails_are_parsed_once_and_not_searched_character_by_character(spark):
    text = plan(spark, "service_messages")
    # The join by message_id filters on it; that must not parse every line again.
    assert text.count("parseJson(invoke(StructsToJsonEvaluator") == 1
    assert "regexp_extract_all" not in text
