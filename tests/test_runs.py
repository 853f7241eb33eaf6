"""End to end: newsletter run, inbox run, two-phase scoring, state, streams."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from pathlib import Path

import pytest
from helpers import FixedScorer, message, messages, sources, taxonomy
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.operators import incremental
from marginalia.plans import inbox, moves, newsletter, purge, replay, runs, twophase
from marginalia.settings import JobSettings
from marginalia.sources import files, registry, state, vault
from marginalia.sources.messages import land, read_landed
from marginalia.streaming import intake

NOW = "2026-03-10 12:00:00"


@pytest.fixture
def folder(tmp_path):
    return runs.StateFolder(str(tmp_path / "state"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def mail(spark):
    return messages(
        spark,
        [
            message(1, "Ann <ann@x.com>", "2026-03-08T10:00:00"),
            message(2, "Ann <ann@x.com>", "2026-03-09T10:00:00", body="boom"),
            message(3, "Ann <ann@x.com>", "2026-03-09T11:00:00", subject="Same"),
            message(4, "Ann <ann@x.com>", "2026-03-09T12:00:00", subject="Same"),
            message(5, "Ann <ann@x.com>", "2026-02-01T10:00:00"),
            message(6, "Bob Weekly <list@y.com>", "2026-03-03T00:00:00"),
            message(7, "Carl <list@y.com>", "2026-03-09T00:00:00"),
        ],
    )


def registered(spark):
    return sources(spark, ("ann@x.com", "Ann News", None), ("list@y.com", "Bob", "bob weekly"))


def run_letters(spark, folder, run_id="r1", write=True, scorer=None, **settings):
    return newsletter.run(
        spark, mail(spark), registered(spark), folder, scorer or FixedScorer(), "prompt", NOW, run_id,
        JobSettings(**settings), write,
    )


def test_newsletter_run(spark, folder):
    result = run_letters(spark, folder)
    assert rows(result.report, "pipeline", "items_processed", "items_created", "items_skipped", "errors") == [
        ("newsletters", 5, 4, 0, 1)
    ]
    notes = state.current_notes(spark, folder.path("notes"))
    assert rows(notes, "folder", "filename", "gmail_url") == [
        ("01 Notes", "Same.md", "https://mail.google.com/mail/u/0/#all/m4"),
        ("01 Notes", "Subject 1.md", "https://mail.google.com/mail/u/0/#all/m1"),
        ("01 Notes", "Subject 6.md", "https://mail.google.com/mail/u/0/#all/m6"),
    ]
    first = notes.filter("filename = 'Subject 1.md'").first()
    # Tags of newsletters are taken as they are, also those outside the taxonomy.
    assert first["tags"] == ["ai/news", "ai/unknown"] and first["author"] == ["[[Ann]]"]
    assert "plain body" in first["rendered"] and "type: newsletter" in first["rendered"]
    assert first["published"] == dt.date(2026, 3, 8) and first["created"] == dt.date(2026, 3, 10)
    assert rows(folder.labels(spark), "message_id") == [("m1",), ("m3",), ("m4",), ("m6",)]
    assert rows(folder.sync_state(spark), "source", "last_sync") == [
        ("Ann News", dt.datetime(2026, 3, 9, 12)), ("Bob", dt.datetime(2026, 3, 3)),
    ]
    assert rows(result.dead_letters, "message_id", "message") == [("m2", "[Ann News] Subject 2: scorer failed")]
    assert runs.global_last_run(spark, folder).first()[0] == dt.datetime(2026, 3, 10, 12)


def test_second_run_finds_nothing_new(spark, folder):
    run_letters(spark, folder)
    again = run_letters(spark, folder, "r2")
    assert again.report.first()["items_processed"] == 0
    assert state.current_notes(spark, folder.path("notes")).count() == 3
    assert folder.labels(spark).count() == 4


def test_run_that_died_before_its_marks_can_be_repeated(spark, folder):
    result = run_letters(spark, folder, write=False)
    state.append_increment(result.notes, folder.path("notes"), ["folder"])
    run_letters(spark, folder)
    run_letters(spark, folder, "r1")
    assert state.current_notes(spark, folder.path("notes")).count() == 3
    assert spark.read.parquet(folder.path("dead_letters")).count() <= 1


def test_dry_run_scores_but_stores_nothing(spark, folder, tmp_path):
    assert run_letters(spark, folder, write=False).report.first()["items_created"] == 4
    assert not (tmp_path / "state").exists()


def test_page_limit_per_source(spark, folder):
    result = run_letters(spark, folder, write=False, max_per_source=1)
    assert rows(result.scored, "message_id") == [("m4",), ("m6",)]


def test_unreadable_message_is_a_dead_letter(spark, folder):
    broken = messages(spark, [("m9", "t", 1773000000000, [("From", "ann@x.com")], "{broken")])
    result = newsletter.run(
        spark, broken, registered(spark), folder, FixedScorer(), "p", NOW, "r", write=False
    )
    assert rows(result.dead_letters, "message_id", "stage", "error") == [
        ("m9", "extract", "unreadable message payload")
    ]
    assert result.report.first()["items_processed"] == 0


def note(title="T", extra="", body="Body."):
    return f"---\ntitle: {title}\n{extra}---\n\n{body}"


@pytest.fixture
def vault_folder(tmp_path):
    box = tmp_path / "00 Inbox"
    (box / "sub").mkdir(parents=True)
    files = {
        "a plain+1%.md": note("Plain", "tags:\n  - clippings\nrating: 5\ntype: paper\n"),
        "done.md": note("Done", "status: classified\n"),
        "broken.md": "---\ntitle: [x\n---\nbody",
        "stub.md": note(
            "Stub Clip",
            "source: https://example.com/post?utm_source=news&id=9\nauthor:\npublished: 2000-06-11\ncreated: 2026-02-14\n",
            "short stub",
        ),
        "boom.md": note("Boom", "status: needs-tags\n", "boom"),
        "UPPER.MD": note("Upper"),
        "other.txt": "ignored",
    }
    for name, text in files.items():
        (box / name).write_text(text, encoding="utf-8")
    (box / "sub" / "deep.md").write_text(note("Deep"))
    (box / "my.paper.pdf").write_bytes(b"fake pdf")
    return str(box)


def pages(spark):
    body = "This is the full recovered article body, far longer than the stub. " * 5
    html = (
        '<html><head><meta name="author" content="Jane Doe"><meta property="article:published_time" '
        f'content="2026-01-11T08:00:00Z"></head><body><nav>menu</nav><article><p>{body}</article></body></html>'
    )
    return spark.createDataFrame([(1, "https://example.com/post?id=9", html)], "page_id int, url string, html string")


def run_inbox(spark, folder, box, crawled=None, write=True, run_id="r1", **settings):
    return inbox.run(
        spark, vault.read_notes(spark, box), vault.read_pdfs(spark, box), crawled, taxonomy(spark), folder,
        FixedScorer(), "prompt", NOW, run_id, JobSettings(**settings), write,
    )


def test_inbox_run(spark, folder, vault_folder):
    result = run_inbox(spark, folder, vault_folder, pages(spark))
    assert rows(result.report, "pipeline", "items_processed", "items_created", "items_skipped", "errors") == [
        ("inbox", 4, 3, 0, 1)
    ]
    notes = {r["filename"]: r for r in state.current_notes(spark, folder.path("notes")).collect()}
    assert sorted(notes) == ["a plain+1%.md", "my.paper.md", "stub.md"]
    plain, stub, pdf = notes["a plain+1%.md"], notes["stub.md"], notes["my.paper.md"]
    assert plain["tags"] == ["clippings", "ai/news"] and plain["status"] == "classified"
    assert (plain["type"], plain["rating"], plain["title"]) == ("paper", 5, "Plain")
    assert "Body." not in plain["rendered"] and plain["content"] == "Body."
    assert stub["source"] == "https://example.com/post?id=9" and stub["author"] == ["[[Jane Doe]]"]
    assert (stub["published"], stub["created"]) == (dt.date(2026, 1, 11), dt.date(2026, 2, 14))
    assert "full recovered article body" in stub["rendered"] and "menu" not in stub["content"]
    assert stub["summary"] == "sum of Stub Clip (example.com)"
    assert pdf["type"] == "paper" and "![[my.paper.pdf]]" in pdf["rendered"]
    assert rows(result.dead_letters, "message") == [("Boom: scorer failed",)]
    assert spark.read.parquet(folder.path("quarantine")).count() == 1
    asset = spark.read.parquet(folder.path("assets")).first()
    assert (asset["folder"], asset["filename"], asset["length"]) == ("04 Assets", "my.paper.pdf", 8)
    # The next run finds only what failed; the same run, repeated, finds everything again.
    for run_id, count in (("r2", 1), ("r1", 4)):
        again = run_inbox(spark, folder, vault_folder, pages(spark), write=False, run_id=run_id)
        assert again.report.first()["items_processed"] == count


def test_inbox_without_enrichment(spark, folder, vault_folder):
    result = run_inbox(spark, folder, vault_folder, pages(spark), write=False, enrich_from_web=False)
    stub = result.notes.filter("filename = 'stub.md'").first()
    assert stub["source"].endswith("?utm_source=news&id=9") and stub["content"] == "short stub"
    cleaned = run_inbox(spark, folder, vault_folder, None, write=False).notes.filter("filename = 'stub.md'").first()
    assert cleaned["source"].endswith("?id=9") and cleaned["content"] == "short stub"


def test_missing_or_empty_inbox(spark, folder, tmp_path):
    report = run_inbox(spark, folder, str(tmp_path / "nothing"), write=False).report.first()
    assert (report["items_processed"], report["errors"]) == (0, 0)


def run_moving(spark, folder, box, root, run_id="r1"):
    return inbox.run(spark, box, box, None, taxonomy(spark), folder, FixedScorer(), "prompt", NOW, run_id, JobSettings(), vault_root=root)


def files_under(root) -> list[str]:
    return sorted(str(path.relative_to(root)) for path in Path(root).rglob("*") if path.is_file() and not path.name.endswith(".crc"))


LEFT = ["UPPER.MD", "boom.md", "broken.md", "done.md", "other.txt", "sub/deep.md"]
MOVED = ["01 Notes/a plain+1%.md", "01 Notes/my.paper.md", "01 Notes/stub.md", "04 Assets/my.paper.pdf"]


def test_processed_files_are_moved(spark, folder, vault_folder, tmp_path):
    root = tmp_path / "vault"
    result = run_moving(spark, folder, vault_folder, str(root))
    assert files_under(vault_folder) == LEFT and files_under(root) == MOVED
    rendered = {r["filename"]: r["rendered"] for r in result.notes.collect()}
    for name in ("a plain+1%.md", "my.paper.md", "stub.md"):
        assert (root / "01 Notes" / name).read_text(encoding="utf-8") == rendered[name]
    assert (root / "04 Assets" / "my.paper.pdf").read_bytes() == b"fake pdf"
    # The second run finds what failed, and nothing else.
    again = run_moving(spark, folder, vault_folder, f"file://{root}", "r2")
    assert again.report.first()["items_processed"] == 1 and files_under(root) == MOVED


@pytest.mark.parametrize("step", ["intent", "copied", "committed", "removed"])
def test_moves_go_on_after_a_crash(spark, folder, vault_folder, tmp_path, monkeypatch, step):
    """The job dies before the named step is written; the next run finishes the move, once."""
    root = tmp_path / "vault"
    write = moves.materialise

    def dying(df, path):
        if path.endswith(f"/{step}"):
            if step in ("copied", "removed"):
                write(df, path + "-half")  # the tasks have done their work, but nobody wrote it down
            raise KeyboardInterrupt
        return write(df, path)

    monkeypatch.setattr(moves, "materialise", dying)
    with pytest.raises(KeyboardInterrupt):
        run_moving(spark, folder, vault_folder, str(root))
    monkeypatch.setattr(moves, "materialise", write)
    run_moving(spark, folder, vault_folder, str(root), "r1" if step == "intent" else "r2")
    assert files_under(vault_folder) == LEFT and files_under(root) == MOVED


def test_edited_originals_stay(spark, folder, vault_folder, tmp_path, monkeypatch):
    monkeypatch.setattr(inbox.moves, "finish", lambda *args: None)
    run_moving(spark, folder, vault_folder, str(tmp_path / "vault"))
    monkeypatch.undo()
    Path(vault_folder, "stub.md").write_text("edited since")
    gone = moves.finish(spark, folder, str(tmp_path / "vault"), "r1")
    assert [r["path"].rsplit("/", 1)[1] for r in gone.filter("NOT removed").collect()] == ["stub.md"]
    assert "stub.md" in files_under(vault_folder) and "my.paper.pdf" not in files_under(vault_folder)


def test_dead_letters_are_replayed_until_they_succeed(spark, folder):
    run_letters(spark, folder, "r1")
    assert rows(replay.open_letters(spark, folder), "message_id", "attempt") == [("m2", 1)]
    for run_id, tries in (("p1", 2), ("p2", 3)):
        replay.replay(spark, folder, FixedScorer(), "prompt", NOW, run_id)
        assert rows(replay.open_letters(spark, folder), "message_id", "attempt") == [("m2", tries)]
    assert replay.replay(spark, folder, FixedScorer(), "prompt", NOW, "p3", most_attempts=3) is None

    class Patient:
        def open(self, system_prompt):
            return lambda content, hint: FixedScorer().reply

    before = rows(folder.sync_state(spark), "source", "last_sync")
    result = replay.replay(spark, folder, Patient(), "prompt", NOW, "p4")
    assert rows(result.report, "items_processed", "items_created", "errors") == [(1, 1, 0)]
    assert replay.open_letters(spark, folder).isEmpty() and rows(folder.sync_state(spark), "source", "last_sync") == before
    assert "Subject 2.md" in {r["filename"] for r in state.current_notes(spark, folder.path("notes")).collect()}
    assert ("m2",) in rows(folder.labels(spark), "message_id")


def test_labels_are_created_by_the_run(spark, folder):
    run_letters(spark, folder, "r1")
    first = rows(folder.label_names(spark), "label", "label_id")
    assert [label for label, _ in first] == ["Newsletters"]
    run_letters(spark, folder, "r2", newsletter_label="Letters")
    assert set(first) < set(rows(folder.label_names(spark), "label", "label_id")) and folder.label_names(spark).count() == 2


def test_a_source_that_could_not_be_fetched_is_an_error(spark, folder):
    failures = spark.createDataFrame([("Bob", "timed out")], "source string, error string")
    result = newsletter.run(spark, mail(spark), registered(spark), folder, FixedScorer(), "prompt", NOW, "r1", fetch_failures=failures)
    assert rows(result.report, "items_processed", "items_created", "errors") == [(5, 4, 2)]
    stored = spark.read.parquet(folder.path("dead_letters")).filter("stage = 'fetch'")
    assert rows(stored, "source", "message") == [("Bob", "Gmail fetch failed for Bob: timed out")]


def test_purge_keeps_what_is_still_needed(spark, folder):
    run_letters(spark, folder, "r1")
    items = letters(spark, folder)
    for batch_id, now in (("b1", "2026-01-01 00:00:00"), ("b2", NOW)):
        twophase.submit(items, folder, "newsletters", batch_id, now)
    for path in Path(folder.root).rglob("*=*"):
        os.utime(path, (0, 0))
    # r1 has an open dead letter, b2 waits; b1 is over.
    assert [path.rsplit("/", 1)[1] for path in purge.purge(spark, folder, NOW)] == ["batch_id=b1", "batch=b1"]

    class Patient:
        def open(self, system_prompt):
            return lambda content, hint: FixedScorer().reply

    replay.replay(spark, folder, Patient(), "prompt", NOW, "p1")
    for path in Path(folder.root).rglob("*=*"):
        os.utime(path, (0, 0))
    assert [path.rsplit("/", 1)[1] for path in purge.purge(spark, folder, NOW)] == ["run_id=p1", "run_id=r1"]
    assert purge.purge(spark, folder, NOW) == []


def test_broken_pending_entries_are_set_aside(spark, folder):
    at = dt.datetime(2026, 3, 1)
    entries = spark.createDataFrame([("b1", "inbox", at, at), (None, "inbox", at, at), ("b3", "inbox", at, None)], schemas.PENDING_BATCH)
    state.write_snapshot(entries, folder.path("pending_batches"))
    assert rows(folder.pending_batches(spark), "batch_id") == [("b1",)]
    assert sorted(r["problem"] for r in folder.broken_batches(spark).collect()) == ["missing: batch_id", "missing: expires_at"]


def test_landed_messages_are_read_by_source(spark, folder, tmp_path):
    path = str(tmp_path / "landed")
    many = [message(100 + k, f"Other <o{k}@z.com>", f"2026-03-0{1 + k % 9}T08:00:00") for k in range(40)]
    landed_mail = mail(spark).unionByName(messages(spark, many))
    land(landed_mail.filter("message_id <= 'm3'"), path)
    land(landed_mail.filter("message_id > 'm3'"), path)
    table = read_landed(spark, path)
    plain = newsletter.new_items(landed_mail, registered(spark), folder.sync_state(spark), NOW, JobSettings())
    pruned = newsletter.new_items(table, registered(spark), folder.sync_state(spark), NOW, JobSettings())
    assert rows(pruned, "item_id", "content") == rows(plain, "item_id", "content") and plain.count() == 5
    # A stale source widens the scan of its own part of the days only.
    stale = spark.createDataFrame([("Ann News", dt.datetime(2025, 1, 1)), ("Fresh", dt.datetime(2026, 3, 9))], schemas.SYNC_STATE)
    both = sources(spark, ("ann@x.com", "Ann News", None), ("o1@z.com", "Fresh", None))
    cutoffs = incremental.source_cutoffs(both.select("name"), stale, runs.run_time(NOW))
    slices = {r["slice"] for r in incremental.wanted_slices(both, cutoffs, runs.run_time(NOW)).collect()}
    days = {}
    for name in slices:
        days.setdefault(name.rsplit("_", 1)[1], set()).add(name[:8])
    assert sorted(map(len, days.values())) == [3, 435]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning[^\]]*slice", plan)


def results_for(spark, requests, types, seq=1):
    data = {"summary": "s", "key_takeaways": "- a", "tags": ["ai/news"], "content_type": "note", "description": "d"}
    reply = json.dumps({"content": [{"type": "tool_use", "name": "classify_content", "input": data}]})
    made = [
        (r["batch_id"], r["custom_id"], kind, reply if kind == "succeeded" else None, "e" if kind == "errored" else None, seq)
        for r, kind in zip(requests.orderBy("prompt").collect(), types)
        if kind
    ]
    return spark.createDataFrame(made, schemas.RESULT)


def letters(spark, folder):
    items = newsletter.new_items(mail(spark), registered(spark), folder.sync_state(spark), NOW, JobSettings())
    return items.filter("error IS NULL").withColumn("hint", F.col("newsletter_name"))


def resume(spark, folder, statuses, results, run_id="z1", now=NOW):
    known = spark.createDataFrame(statuses, "batch_id string, processing_status string")
    return twophase.resume(
        spark, folder, known, results, registry.vocabulary(taxonomy(spark)), None, now, run_id
    )


def test_submit_and_resume(spark, folder):
    requests = twophase.submit(letters(spark, folder), folder, "newsletters", "b1", NOW)
    assert requests.count() == 5
    # Nothing is submitted twice while it waits.
    assert twophase.submit(letters(spark, folder), folder, "newsletters", "b2", NOW).count() == 0
    results = results_for(spark, requests, ["succeeded", "errored", "succeeded", None, "succeeded"])
    waiting = resume(spark, folder, [("b1", "in_progress"), ("b2", "in_progress")], results)
    assert rows(waiting, "batch_id", "state") == [("b1", "in_progress"), ("b2", "in_progress")]
    assert state.current_notes(spark, folder.path("notes")) is None
    done = resume(spark, folder, [("b1", "ended"), ("b2", "in_progress")], results, "z2")
    assert rows(done.filter("batch_id = 'b1'"), "state", "succeeded", "failed") == [("complete", 3, 1)]
    assert rows(folder.pending_batches(spark), "batch_id") == [("b2",)]
    letters_left = spark.read.parquet(folder.path("dead_letters"))
    assert {r["error"] for r in letters_left.collect()} == {"API error: e", "no result returned by provider"}
    assert folder.labels(spark).count() == 3
    assert state.current_notes(spark, folder.path("notes")).count() in (2, 3)


def test_failed_batch_leaves_the_queue_without_notes(spark, folder):
    requests = twophase.submit(letters(spark, folder), folder, "newsletters", "b1", NOW)
    results = results_for(spark, requests, ["errored"] * 5)
    assert resume(spark, folder, [("b1", "ended")], results).first()["state"] == "error"
    assert folder.pending_batches(spark).isEmpty() and folder.sync_state(spark).isEmpty()


def test_expired_and_cancelled_batches(spark, folder):
    requests = twophase.submit(letters(spark, folder), folder, "newsletters", "b1", NOW)
    late = "2026-04-08 12:00:00"
    assert resume(spark, folder, [("b1", "ended")], results_for(spark, requests, ["succeeded"]), now=late).isEmpty()
    assert folder.pending_batches(spark).isEmpty()
    twophase.submit(letters(spark, folder), folder, "newsletters", "b2", NOW)
    with pytest.raises(ValueError, match="no pending batch"):
        twophase.cancel(spark, folder, "unknown")
    twophase.cancel(spark, folder, "b2")
    assert folder.pending_batches(spark).isEmpty()
    with pytest.raises(ValueError, match="must match"):
        twophase.submit(letters(spark, folder), folder, "newsletters", "2026/03", NOW)


def test_inbox_in_two_phases(spark, folder, vault_folder):
    items, _ = inbox.inbox_items(
        vault.read_notes(spark, vault_folder), vault.read_pdfs(spark, vault_folder), None, JobSettings()
    )
    requests = twophase.submit(items, folder, "inbox", "box1", NOW)
    resume(spark, folder, [("box1", "ended")], results_for(spark, requests, ["succeeded"] * 4))
    notes = state.current_notes(spark, folder.path("notes"))
    assert rows(notes, "filename") == [("a plain+1%.md",), ("boom.md",), ("my.paper.md",), ("stub.md",)]


def test_offline_scorer_serves_as_the_provider(spark, folder):
    twophase.submit(letters(spark, folder), folder, "newsletters", "b1", NOW)
    results = twophase.score_requests(spark, folder, "b1", FixedScorer(), "prompt")
    assert rows(results.groupBy("type").count(), "type", "count") == [("errored", 1), ("succeeded", 4)]
    resume(spark, folder, [("b1", "ended")], results)
    notes = state.current_notes(spark, folder.path("notes"))
    assert notes.filter("filename = 'Subject 1.md'").first()["summary"] == "sum of Ann News"
    assert folder.labels(spark).count() == 4


def test_vault_files(spark, folder, vault_folder, tmp_path):
    run_inbox(spark, folder, vault_folder, pages(spark))
    root = tmp_path / "vault"
    notes = state.current_notes(spark, folder.path("notes"))
    for _ in range(2):
        assert sum(r["files"] for r in files.write_notes(notes, f"file://{root}").collect()) == 3
    assert "![[my.paper.pdf]]" in (root / "01 Notes" / "my.paper.md").read_text(encoding="utf-8")
    pdfs = vault.read_pdfs(spark, vault_folder).select(F.lit("04 Assets").alias("folder"), vault.file_name(F.col("path")).alias("filename"), "content")
    files.write_files(pdfs, f"file://{root}", F.col("content")).collect()
    assert (root / "04 Assets" / "my.paper.pdf").read_bytes() == b"fake pdf"
    # What was written can be read back as notes that are done.
    again = vault.parse_notes(vault.read_notes(spark, str(root / "01 Notes")))
    assert vault.unprocessed(again).isEmpty() and again.count() == 3


def test_messages_from_json_files(spark, tmp_path):
    from marginalia.sources.messages import read_messages

    mail(spark).select("message_id", "thread_id", "internal_date", "headers", "payload").write.json(str(tmp_path / "m"))
    read = read_messages(spark, str(tmp_path / "m"), "json")
    assert rows(read, "message_id", "from_header", "internal_ts") == rows(mail(spark), "message_id", "from_header", "internal_ts")


def test_snapshots_ignore_half_written_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "source string, last_sync timestamp"
    assert state.read_snapshot(spark, path, schemas.SYNC_STATE).isEmpty()
    first = spark.createDataFrame([("a", None)], schema)
    assert state.write_snapshot(first, path) == 1
    (tmp_path / "s" / "v=2").mkdir()
    (tmp_path / "s" / "v=2" / "part-0.parquet").write_bytes(b"half")
    current = state.read_snapshot(spark, path, schemas.SYNC_STATE)
    assert rows(current, "source") == [("a",)]
    # A state may be derived from the snapshot it replaces.
    assert state.write_snapshot(current.unionByName(spark.createDataFrame([("b", None)], schema)), path) == 2
    assert rows(state.read_snapshot(spark, path, schemas.SYNC_STATE), "source") == [("a",), ("b",)]


def test_compacted_notes_are_the_same(spark, folder):
    run_letters(spark, folder)
    run_letters(spark, folder, "r2", scorer=FixedScorer(description="later"))
    path = folder.path("notes")
    before = rows(state.current_notes(spark, path), "folder", "filename", "description")
    version = state.compact_notes(spark, path)
    assert state.Versions(spark, path).since_full() == [version]
    assert rows(state.current_notes(spark, path), "folder", "filename", "description") == before
    rewritten = state.current_notes(spark, path).filter("filename = 'Same.md'").withColumn("description", F.lit("again"))
    state.append_increment(rewritten, path, ["folder"])
    after = {r["filename"]: r["description"] for r in state.current_notes(spark, path).collect()}
    assert len(after) == len(before) and after["Same.md"] == "again" and "again" not in {
        d for name, d in after.items() if name != "Same.md"
    }


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_id").cast("string").alias("message_id"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("internal_ts"),
    )
    drop = tmp_path / "drop"
    middle = dt.datetime(2024, 1, 15)
    names = events.select(F.col("source").alias("name")).distinct()
    events.filter(F.col("internal_ts") < middle).coalesce(1).write.parquet(str(drop / "1"))
    later = F.lit("2024-02-15 00:00:00").cast("timestamp")

    def consume():
        stream = intake.message_stream(spark, str(drop / "*"), events.schema)
        query = intake.incremental_stream(
            stream, names, later, str(tmp_path / "out"), str(tmp_path / "ckpt"), lookback_days=60
        )
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / "items"))

    assert consume().count() == events.filter(F.col("internal_ts") < middle).count()
    # The second delivery repeats old messages: they are late, not new.
    events.coalesce(1).write.parquet(str(drop / "2"))
    assert rows(consume(), "message_id") == rows(events, "message_id")
    assert consume().count() == events.count()
    late = spark.read.parquet(str(tmp_path / "out" / "late"))
    assert late.count() == events.filter(F.col("internal_ts") < middle).count()
    version = intake.publish_marks(spark, str(tmp_path / "out"), 1, str(tmp_path / "marks"))
    marks = state.read_snapshot(spark, str(tmp_path / "marks"), schemas.SYNC_STATE)
    assert version == 1 and rows(marks, "source", "last_sync") == rows(
        events.groupBy("source").agg(F.max("internal_ts").alias("m")), "source", "m"
    )


def test_stream_dedup(spark, tmp_path):
    rows_in = [("m1", dt.datetime(2026, 1, 1)), ("m2", dt.datetime(2026, 1, 1, 1)), ("m1", dt.datetime(2026, 1, 1, 2))]
    df = spark.createDataFrame(rows_in, "message_id string, internal_ts timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = intake.distinct_messages(intake.message_stream(spark, str(tmp_path / "in"), df.schema))
    query = stream.writeStream.format("memory").queryName("distinct_mail").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")
    ).start()
    query.awaitTermination()
    assert rows(spark.table("distinct_mail"), "message_id") == [("m1",), ("m2",)]
