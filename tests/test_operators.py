from __future__ import annotations

import datetime as dt
import time

import pytest
from helpers import FixedScorer, message, messages, sources, taxonomy
from pyspark.sql import functions as F

from marginalia.operators import batches, enrich, incremental, keyed, notes, report, scoring
from marginalia.sources import registry


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_sender_match(spark):
    mail = messages(
        spark,
        [
            message(1, "Alice Blog <noreply@wp.com>", "2026-03-01"),
            message(2, "BOB digest <noreply@wp.com>", "2026-03-01"),
            message(3, "noreply@wp.com", "2026-03-01"),
            message(4, "Other <Plain@x.com>", "2026-03-01"),
            message(5, "alice blog weekly <elsewhere@y.com>", "2026-03-01"),
        ],
    )
    registered = sources(
        spark,
        ("noreply@wp.com", "A", "Alice Blog"),
        ("noreply@wp.com", "B", "Bob"),
        ("plain@x.com", "P", None),
        ("nobody@z.com", "A2", "alice"),
        ("nobody@z.com", "long", "x" * 40),
    )
    assert rows(incremental.match_senders(mail, registered), "message_id", "source") == [
        ("m1", "A"), ("m1", "A2"), ("m2", "B"), ("m4", "P"), ("m5", "A"), ("m5", "A2"),
    ]


def test_sender_match_without_named_sources(spark):
    mail = messages(spark, [message(1, "a@b.com", "2026-03-01")])
    assert rows(incremental.match_senders(mail, sources(spark, ("A@b.com", "S", None))), "source") == [("S",)]


def test_cutoffs_and_new_messages(spark):
    day = lambda s: dt.datetime.fromisoformat(s)
    marks = spark.createDataFrame([("known", day("2026-03-05T10:00:00"))], "source string, last_sync timestamp")
    registered = sources(spark, ("k@x", "known", None), ("n@x", "new", None)).select("name")
    cutoffs = incremental.source_cutoffs(registered, marks, F.lit("2026-03-10 15:00:00").cast("timestamp"))
    mail = spark.createDataFrame(
        [
            ("at-mark", "known", day("2026-03-05T10:00:00")),
            ("after", "known", day("2026-03-05T10:00:01")),
            ("midnight", "new", day("2026-03-03T00:00:00")),
            ("too-old", "new", day("2026-03-02T23:59:59")),
            ("undated", "new", None),
        ],
        "message_id string, source string, internal_ts timestamp",
    )
    assert rows(incremental.new_messages(mail, cutoffs), "message_id") == [("after",), ("midnight",)]


def test_marks_never_move_back(spark):
    day = lambda d: dt.datetime(2026, 3, d)
    schema = "source string, last_sync timestamp"
    old = spark.createDataFrame([("a", day(9)), ("b", day(1))], schema)
    found = spark.createDataFrame([("a", day(5)), ("b", day(4)), ("c", day(2))], schema)
    assert rows(incremental.advance_marks(old, found), "source", "last_sync") == [
        ("a", day(9)), ("b", day(4)), ("c", day(2)),
    ]


def test_mark_passes_a_failed_message(spark):
    done = spark.createDataFrame(
        [("a", dt.datetime(2026, 3, 1), "failed"), ("a", dt.datetime(2026, 3, 2), None), ("b", dt.datetime(2026, 3, 3), "failed")],
        "source string, internal_ts timestamp, error string",
    )
    assert rows(incremental.new_marks(done, F.col("error").isNull()), "source", "last_sync") == [
        ("a", dt.datetime(2026, 3, 2))
    ]


def test_top_k_with_one_hot_key(spark):
    """The salted ranking equals a plain sort, also when one key holds most rows."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))).alias("source"),
        F.col("id").cast("string").alias("message_id"),
        (F.col("id") * 7919 % 1009).alias("internal_ts"),
    )
    got = incremental.newest_per_source(df, 50).orderBy("source", "rank").collect()
    wanted: dict[str, list] = {}
    for r in df.collect():
        wanted.setdefault(r["source"], []).append((r["internal_ts"], r["message_id"]))
    expected = [(s, *pair) for s in sorted(wanted) for pair in sorted(wanted[s], reverse=True)[:50]]
    assert [(r["source"], r["internal_ts"], r["message_id"]) for r in got] == expected


def test_dense_ordinals(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("same"))
    got = keyed.dense_ordinals(df, ["same", "k"]).collect()
    assert sorted((r["k"], r["ordinal"]) for r in got) == [(i, i) for i in range(1000)]


def test_last_result_wins_and_missing_results(spark):
    results = spark.createDataFrame(
        [("b", "1", "errored", 1), ("b", "1", "succeeded", 2), ("b", "2", "canceled", 1)],
        "batch_id string, custom_id string, type string, seq int",
    ).withColumns({"message": F.lit("{}"), "error": F.lit(None).cast("string")})
    pending = spark.createDataFrame([("b", "1"), ("b", "2"), ("b", "3")], "batch_id string, custom_id string")
    got = batches.reconcile(pending, results)
    assert rows(got, "custom_id", "error") == [
        ("1", "No classify_content tool use in response"), ("2", "Request canceled"), ("3", "no result returned by provider"),
    ]


@pytest.mark.parametrize(
    ("status", "kinds", "state", "counts"),
    [
        ("ended", ["succeeded", "errored"], "complete", (2, 1, 1)),
        ("ended", ["errored", "expired"], "error", (2, 0, 2)),
        ("ended", ["canceled"], "cancelled", (1, 0, 0)),
        ("ended", ["expired", "expired"], "complete", (2, 0, 2)),
        ("ended", [], "complete", (0, 0, 0)),
        ("canceling", ["canceled"], "in_progress", (3, 0, 0)),
    ],
)
def test_batch_state(spark, status, kinds, state, counts):
    known = spark.createDataFrame([("b", status)], "batch_id string, processing_status string")
    items = spark.createDataFrame([("b", str(i)) for i in range(3)], "batch_id string, custom_id string")
    results = spark.createDataFrame(
        [("b", str(i), kind, 1) for i, kind in enumerate(kinds)], "batch_id string, custom_id string, type string, seq int"
    )
    got = batches.batch_status(known, items, results).first()
    assert got["state"] == state and (got["total"], got["succeeded"], got["failed"]) == counts


def test_expiry_is_inclusive(spark):
    df = spark.createDataFrame([("b", dt.datetime(2026, 3, 1))], "batch_id string, expires_at timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    assert batches.live(df, at("2026-03-01 00:00:00")).isEmpty()
    assert batches.live(df, at("2026-02-28 23:59:59")).count() == 1


def test_longest_text(spark):
    items = spark.createDataFrame(
        [
            (1, "https://e.com/a?utm_source=x", "short", False),
            (2, "https://e.com/a", "a longer captured text", False),
            (3, "", "none", False),
            (4, "https://e.com/a", "pdf", True),
            (5, "https://gone.com/?ref=1", None, False),
            (6, "https://e.com/a", "equal len!", False),
        ],
        "item_id int, source_url string, content string, is_pdf boolean",
    )
    found = spark.createDataFrame(
        [
            (7, "https://e.com/a?ref=1", "0123456789", "Jane", None),
            (8, "https://e.com/a", "tiny", "Other", "2026-01-01"),
            (9, "https://e.com/a", "9876543210", "Late", None),
        ],
        "page_id int, url string, text string, author string, date string",
    )
    got = enrich.keep_longest(items, enrich.one_per_url(found))
    assert rows(got, "item_id", "source_url", "content", "web_author") == [
        (1, "https://e.com/a", "0123456789", "Jane"),
        (2, "https://e.com/a", "a longer captured text", "Jane"),
        (3, "", "none", None),
        (4, "https://e.com/a", "pdf", None),
        (5, "https://gone.com/", None, None),
        (6, "https://e.com/a", "equal len!", "Jane"),
    ]
    off = enrich.keep_longest(items, enrich.one_per_url(found), enabled=False)
    assert off.filter("item_id = 1").first()["source_url"] == "https://e.com/a?utm_source=x"


def test_scorer_failures_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "fine", "h"), (2, "boom", None)], "id int, content string, hint string")
    got = {r["id"]: r for r in scoring.score(df, FixedScorer(), "prompt").collect()}
    assert got[1]["analysis"]["summary"] == "sum of h" and got[1]["error"] is None
    assert got[2]["analysis"] is None and got[2]["error"] == "scorer failed"


def test_scorer_sees_whole_texts_unless_limited(spark):
    class LastWords:
        def open(self, system_prompt):
            return lambda content, hint: FixedScorer().reply | {"summary": content[-40:], "description": system_prompt}

    df = spark.createDataFrame([("x" * 20000 + " decisive", "h")], "content string, hint string")
    whole = scoring.score(df, LastWords(), "told").first()["analysis"]
    assert whole["summary"].endswith(" decisive") and whole["description"] == "told"
    cut = scoring.score(df, LastWords(), "told", limit=6000).first()["analysis"]
    assert cut["summary"].endswith("[... truncated, 14009 chars omitted]")


def test_replies_of_a_wrong_type_are_repaired_or_errors(spark):
    class Loose:
        def open(self, system_prompt):
            kinds = {
                "text": {"tags": "ai/x, ai/y", "key_takeaways": "- one\n- two"},
                "number": {"tags": [1]},
                "kind": {"content_type": "poem"},
            }
            return lambda content, hint: FixedScorer().reply | kinds[hint]

    df = spark.createDataFrame([("c", "text"), ("c", "number"), ("c", "kind")], "content string, hint string")
    got = {r["hint"]: r for r in scoring.score(df, Loose(), "told").collect()}
    assert got["text"]["analysis"]["tags"] == ["ai/x", "ai/y"] and got["text"]["analysis"]["key_takeaways"] == ["one", "two"]
    assert got["number"]["error"] == "Missing or invalid fields: tags" and got["number"]["analysis"] is None
    assert got["kind"]["error"] == "Missing or invalid fields: content_type"


class _Clock:
    """A clock that a pause moves on."""

    def __init__(self) -> None:
        self.now, self.pauses = 0.0, []

    def __call__(self) -> float:
        return self.now

    def pause(self, seconds: float) -> None:
        self.pauses.append(seconds)
        self.now += seconds


def test_retry_waits_longer_and_gives_up():
    clock, calls = _Clock(), []

    def limited(content, hint):
        calls.append(content)
        raise scoring.RateLimited("slow down")

    assert scoring.Window(limited, clock=clock, pause=clock.pause).ask([("c", None)]) == [(None, "slow down")]
    assert (clock.pauses, len(calls)) == ([2.0, 4.0], 3)

    def broken(content, hint):
        calls.append(content)
        raise ValueError("no")

    calls.clear()
    assert scoring.Window(broken, clock=clock, pause=clock.pause).ask([("c", None), (None, "h")]) == [(None, "no"), (None, None)]
    assert calls == ["c"]


def test_other_calls_go_on_while_a_limited_one_waits():
    clock, calls = _Clock(), []

    def analyze(content, hint):
        calls.append(content)
        if content == "limited" and calls.count("limited") < 3:
            raise scoring.RateLimited("later")
        if content == "bad":
            raise ValueError("bad text")
        return {"of": content}

    rows = [("limited", None), ("a", None), ("bad", None), ("b", None)]
    got = scoring.Window(analyze, clock=clock, pause=clock.pause).ask(rows)
    assert got == [({"of": "limited"}, None), ({"of": "a"}, None), (None, "bad text"), ({"of": "b"}, None)]
    assert calls == ["limited", "a", "bad", "b", "limited", "limited"] and sum(clock.pauses) == 6.0


def test_calls_overlap_and_keep_their_order():
    begun = time.monotonic()

    def slow(content, hint):
        time.sleep(0.2 if content % 2 else 0.1)
        return {"n": content}

    got = scoring.Window(slow, in_flight=8).ask([(n, None) for n in range(16)])
    assert [reply["n"] for reply, _ in got] == list(range(16))
    # One after the other they would take 2.4 seconds.
    assert time.monotonic() - begun < 1.6


def test_calls_begin_at_the_rate_that_is_allowed():
    clock = _Clock()
    starts = []

    def analyze(content, hint):
        starts.append(clock.now)
        return {}

    scoring.Window(analyze, in_flight=2, per_second=4, clock=clock, pause=clock.pause).ask([("c", None)] * 8)
    assert len(starts) == 8 and clock.now >= 6 / 4 - 1e-9


def test_upsert_and_collisions(spark):
    schema = "folder string, filename string, body string, run_ts int, seq int"
    old = spark.createDataFrame([("n", "a.md", "old", 1, 0), ("n", "b.md", "kept", 1, 1)], schema)
    new = spark.createDataFrame([("n", "a.md", "first", 2, 0), ("n", "a.md", "second", 2, 1)], schema)
    assert rows(notes.upsert(old, new), "filename", "body") == [("a.md", "second"), ("b.md", "kept")]
    assert rows(notes.collisions(new), "filename", "written") == [("a.md", 2)]


def test_labels_are_added_once(spark):
    mail = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("",), (None,)], "message_id string")
    had = spark.createDataFrame([("m2", "Newsletters"), ("m1", "Other")], "message_id string, label string")
    assert rows(notes.label_messages(had, mail, "Newsletters"), "message_id", "label") == [("m1", "Newsletters")]


def test_registry_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("sources:\n  - {email: a@b.c, name: A}\n  - {email: x@y.z, sender_name: X}\n")
    checked = registry.checked(registry.read_sources(spark, tmp_path / "s.yaml"))
    assert rows(checked, "ord", "sender_name", "problem") == [(0, None, None), (1, "X", "missing: name")]
    (tmp_path / "t.yaml").write_text(
        "descriptive: {z/one: First, both: D}\nfunctional: {both: F}\nclassification_rules: [Rule one, Rule two]\n"
    )
    tags, rules = registry.read_taxonomy(spark, tmp_path / "t.yaml")
    prompt = registry.system_prompt(tags, rules).first()["prompt"]
    assert "  - z/one: First\n  - both: D\n  - both: F\n" in prompt and "  - Rule one\n  - Rule two\n" in prompt
    assert spark.range(1).select(registry.vocabulary(tags).alias("v")).first()["v"] == ["both", "z/one"]
    (tmp_path / "bad.yaml").write_text("descriptive: {}\n")
    with pytest.raises(ValueError, match="functional"):
        registry.read_taxonomy(spark, tmp_path / "bad.yaml")


def test_vocabulary_of_the_shared_fixture(spark):
    assert spark.range(1).select(registry.vocabulary(taxonomy(spark)).alias("v")).first()["v"] == ["ai/news", "func/teach"]


def test_sender_names_are_found_by_one_gram(spark):
    names = ["Ann Weekly", "ann", "An", "The Weekly Ann Report", "Bob", "xyz", "ΣΑΣ news", "A.B. Daily", "", "weekly weekly weekly"]
    wanted = ["ann", "Weekly", "an", "a", "news", "Daily", "nothing of that", "report", "e w", "aily"]
    mail = messages(spark, [message(k, f"{name} <u{k}@x.com>", "2026-03-08T10:00:00") for k, name in enumerate(names)])
    registered = sources(spark, *((f"s{k}@y.com", f"S{k}", name) for k, name in enumerate(wanted)))
    got = rows(incremental.match_senders(mail, registered), "message_id", "source")
    assert got == sorted((f"m{k}", f"S{n}") for k, name in enumerate(names) for n, piece in enumerate(wanted) if piece.lower() in name.lower())


def test_lookup_rows_grow_with_the_names_only(spark):
    name = "abcdefghij" * 5
    names = spark.createDataFrame([(name,)], "key string")
    for count in (1, 30):
        named = spark.createDataFrame([(f"S{k}", "abc" + "defghij"[: k % 7] ) for k in range(count)], "source string, _piece string")
        assert incremental._named_lookup(names, named).count() == count
    # Ten distinct grams of three characters; each sender name is looked up by one of them.
    assert spark.range(1).select(F.size(incremental._grams(F.lit(name), 3)).alias("n")).first()["n"] == 10


def test_messages_without_a_date_move_no_mark(spark):
    df = spark.createDataFrame([("a", dt.datetime(1970, 1, 1)), ("b", dt.datetime(2026, 1, 1)), ("b", None)], "source string, internal_ts timestamp")
    assert rows(incremental.new_marks(df, F.lit(True)), "source") == [("b",)]


def test_errors_are_numbered_in_order(spark):
    letters = spark.createDataFrame([("b", 2, "x"), ("a", None, "y"), ("a", 1, "z")], "source string, at int, message string")
    assert rows(report.in_order(letters, ["source", "at"]), "position", "message") == [(1, "y"), (2, "z"), (3, "x")]
