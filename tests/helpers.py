"""Scorers and fixtures shared by the run tests."""

from __future__ import annotations

import base64
import datetime as dt
import json

from marginalia import schemas


class FixedScorer:
    """Gives every text the same analysis; fails for texts that contain `boom`."""

    def __init__(self, **changes) -> None:
        self.reply = {
            "summary": "sum", "key_takeaways": ["k1", "k2"], "tags": ["ai/news", "ai/unknown"],
            "content_type": "clipping", "description": "desc",
        } | changes

    def open(self, system_prompt):
        def analyze(content, hint):
            if "boom" in content:
                raise ValueError("scorer failed")
            return self.reply | {"summary": f"sum of {hint}"}

        return analyze


def encode(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode()


def millis(text: str) -> int:
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp() * 1000)


def message(number: int, sender: str, when: str, body: str = "plain body", subject: str | None = None):
    headers = [("From", sender), ("Subject", subject or f"Subject {number}")]
    payload = {"mimeType": "text/plain", "body": {"data": encode(body)}}
    return (f"m{number}", f"t{number}", millis(when), headers, json.dumps(payload))


def messages(spark, rows):
    from marginalia.sources.messages import with_headers

    return with_headers(spark.createDataFrame(rows, schemas.MESSAGE))


def sources(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schemas.SOURCE)


def taxonomy(spark):
    return spark.createDataFrame(
        [("descriptive", 0, "ai/news", "News"), ("functional", 0, "func/teach", "Courses")],
        "kind string, ord int, tag string, scope string",
    )
