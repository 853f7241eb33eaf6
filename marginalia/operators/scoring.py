"""Scoring: the plug-in contract, a runner with error isolation, a rule scorer."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from heapq import heappop, heappush
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import replies, text
from marginalia.functions.lists import empty_list
from marginalia.functions.planning import once

# Attempts per item, and the base of the waits between them (2 s, 4 s).
ATTEMPTS = 3
WAIT_BASE = 2.0


class RateLimited(Exception):
    """Raised by a scorer that should be asked again after a pause."""


class Scorer(Protocol):
    """Scores one text. ``open`` runs once per task and may build clients or models."""

    def open(self, system_prompt: str) -> Callable[[str, str | None], dict]: ...


class Window:
    """Calls of a scorer that are under way at the same time, in one task.

    Up to ``in_flight`` calls run at once, at most ``per_second`` of them begin in a second (with bursts
    of the window's size). A call that was rate-limited waits in a queue of its own, longer each
    time, while the others go on; the last failure counts. Answers come in the order of the rows.
    """

    def __init__(
        self, analyze: Callable[[str, str | None], dict], in_flight: int = 1, per_second: float | None = None,
        clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep,
    ) -> None:
        self.analyze, self.in_flight, self.per_second = analyze, in_flight, per_second
        self.clock, self.pause = clock, pause
        self.pool = ThreadPoolExecutor(in_flight)
        self.tokens, self.filled = float(in_flight), clock()

    def _token_due(self) -> float:
        """Seconds until the next call may begin."""
        if self.per_second is None:
            return 0.0
        now = self.clock()
        self.tokens = min(float(self.in_flight), self.tokens + (now - self.filled) * self.per_second)
        self.filled = now
        return 0.0 if self.tokens >= 1 else (1 - self.tokens) / self.per_second

    def ask(self, rows: Sequence[tuple[str | None, str | None]]) -> list[tuple[dict | None, str | None]]:
        """(reply, error) of every row; a row without content has neither."""
        answers: list[tuple[dict | None, str | None]] = [(None, None)] * len(rows)
        ready = deque((k, 1) for k, (content, _) in enumerate(rows) if content is not None)
        later: list[tuple[float, int, int]] = []
        running: dict[Future, tuple[int, int]] = {}
        while ready or later or running:
            while later and later[0][0] <= self.clock():
                _, k, attempt = heappop(later)
                ready.append((k, attempt))
            while ready and len(running) < self.in_flight and self._token_due() <= 0:
                k, attempt = ready.popleft()
                self.tokens -= 1
                running[self.pool.submit(self.analyze, *rows[k])] = (k, attempt)
            # When something may begin next, unless a running call ends before.
            waits = [later[0][0] - self.clock()] if later else []
            if ready and len(running) < self.in_flight:
                waits.append(self._token_due())
            if not running:
                self.pause(max(0.0, min(waits, default=0.0)))
                continue
            done, _ = wait(running, timeout=max(0.0, min(waits)) if waits else None, return_when=FIRST_COMPLETED)
            for call in done:
                k, attempt = running.pop(call)
                try:
                    answers[k] = (call.result(), None)
                except RateLimited as limited:
                    if attempt < ATTEMPTS:
                        heappush(later, (self.clock() + WAIT_BASE**attempt, k, attempt + 1))
                    else:
                        answers[k] = (None, str(limited))
                except Exception as problem:
                    answers[k] = (None, str(problem))
        return answers

    def close(self) -> None:
        self.pool.shutdown(cancel_futures=True)


def score(
    items: DataFrame,
    scorer: Scorer,
    system_prompt: str,
    content: str = "content",
    hint: str = "hint",
    failed: Column | None = None,
    limit: int | None = None,
    in_flight: int = 1,
    per_second: float | None = None,
) -> DataFrame:
    """Items with ``analysis`` and ``error``, exactly one of them set in each row.

    ``failed`` is the error of rows that failed earlier; they keep it and are not scored.
    Only the text to score and its hint cross into Python, the whole text unless a ``limit``
    is given. The reply comes back as JSON text and is repaired and checked like the reply of
    a batch. A failing item gives an error value, not a failed task.

    With ``in_flight`` over 1 a task has so many calls under way (the scorer must allow that), and
    begins at most ``per_second`` of them in a second.
    """

    @once
    @F.pandas_udf("reply string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        window = Window(scorer.open(system_prompt), in_flight, per_second)
        try:
            for contents, hints in batches:
                asked = list(zip(contents, hints))
                rows = []
                for reply, problem in window.ask(asked):
                    try:
                        rows.append((None if reply is None else json.dumps(reply), problem))
                    except (TypeError, ValueError) as unfit:
                        rows.append((None, str(unfit)))
                yield pd.DataFrame(rows, columns=["reply", "error"], dtype=object)
        finally:
            window.close()

    prompt = text.analysis_prompt(F.col(content), F.lit(None).cast("string"), limit)
    earlier = F.lit(None).cast("string") if failed is None else failed
    asked = items.withColumn("_scored", run(F.when(earlier.isNull(), prompt), F.col(hint)))
    reply = F.col("_scored.reply")
    read = asked.withColumn("_read", F.when(reply.isNotNull(), replies.read_analysis(reply)))
    error = F.coalesce(earlier, F.col("_scored.error"), F.col("_read.error"))
    analysis = F.when(error.isNull(), F.col("_read.analysis"))
    return read.withColumns({"analysis": analysis, "error": error}).drop("_scored", "_read")


def rule_analysis(
    content: Column, rules: Sequence[tuple[str, str]], types: Sequence[tuple[str, str]], sentences: int = 3
) -> Column:
    """Deterministic native scorer: a summary of the first sentences, all lines, key words.

    ``rules`` are (key word, tag) and ``types`` (key word, content type), tried in order;
    key words are looked up in the whole text, in lower case.
    """
    low = F.lower(content)
    body = text.strip(content)
    lines = F.filter(F.transform(F.split(body, "\n"), text.strip), lambda line: line != "")
    tags = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(word)), F.lit(tag)) for word, tag in rules)))
    kind = F.coalesce(
        *(F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in types), F.lit("note")
    )
    return F.struct(
        F.regexp_extract(body, rf"^(?:[^.!?]*[.!?]*){{1,{sentences}}}", 0).alias("summary"),
        lines.alias("key_takeaways"),
        F.coalesce(F.array_distinct(tags), empty_list()).alias("tags"),
        kind.alias("content_type"),
        F.regexp_extract(body, r"^[^.!?]*[.!?]*", 0).alias("description"),
    )
