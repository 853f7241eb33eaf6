"""Allow and block rules for URLs in a trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with
the rule's path. The most labels win, then the longest path; of equal rules the block wins.
URLs that no rule fits get the method's default verdict.

A list of up to `MOST_RULES` rules is a trie sent to every task, once per task. A longer one is
never broadcast: distinct URLs are then joined to the rules on every host suffix and every
path length that rules have.

Cases: a null URL or one without `://` has an empty host and path; a host keeps port and user
part; empty labels are labels; repeated rows are judged each; no rules: the default for all;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST_RULES = 200_000
JUDGED = "page_id long, host string, path string, rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nodes are dicts from a label or segment to the next node; None holds a node's path tree,
    and in path trees () holds {beginning of the next segment: rule}."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, begun = path.split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            held = node.setdefault((), {})
            if held.get(begun, ("",))[-1] != "block":
                held[begun] = (host + path, verdict)

    def _on_path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            held = node.get(())
            if held:
                fitting = [begun for begun in held if segment.startswith(begun)] if len(held) < 8 else [segment[:n] for n in range(len(segment) + 1) if segment[:n] in held]
                if fitting:
                    best = held[max(fitting, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the best rule."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._on_path(node[None], segments) or best
        return best


def _split(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def _parts() -> tuple[Column, Column]:
    """Host and path as expressions."""
    inside = F.coalesce(F.regexp_extract("url", r"(?s)://([^/?#]*)([^?#]*)", 1), F.lit(""))
    return F.translate(inside, UPPER, LOWER), F.coalesce(F.regexp_extract("url", r"(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judged(batches):
        known = trie.value
        for batch in batches:
            parts = [_split(url) for url in batch.column("url").to_pylist()]
            found = [known.judge(*part) or (None, default) for part in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            columns = [batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(judged, JUDGED)


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    host, path = _parts()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = rules.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("verdict").alias("verdict"))
    sizes = ruled.agg(F.collect_set(F.length("_path"))).scalar()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    keys = split.select("host", "path").distinct().withColumn("_sizes", sizes)
    keys = keys.withColumn("_host", F.explode(suffixes)).withColumn("_size", F.explode("_sizes"))
    keys = keys.filter(F.col("_size") <= F.length("path")).withColumn("_path", F.expr("substring(path, 1, _size)"))
    best = F.max(F.struct(F.length("_host"), F.length("_path"), F.concat("_host", "_path").alias("rule"), "verdict")).alias("_b")
    found = keys.join(ruled, ["_host", "_path"]).groupBy("host", "path").agg(best)
    rows = split.join(found, ["host", "path"], "left")
    verdict = F.coalesce("_b.verdict", F.lit(default))
    return rows.select("page_id", "host", "path", F.col("_b.rule").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`; rules: verdict, host, path.

    A rule with a null host or path is void.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna()
    few = rules.limit(most_rules + 1).toArrow().to_pylist()
    if len(few) <= most_rules:
        return _by_trie(pages, [(r["verdict"], r["host"], r["path"]) for r in few], default)
    return _by_join(pages, rules, default)
