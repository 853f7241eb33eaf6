"""Source registry and taxonomy: configuration files as small tables."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia import schemas

# What each field of an analysis is asked for: (form, least, most); the limits are the contract's.
ASKED = {
    "summary": ("sentences of English prose", 2, 4),
    "key_takeaways": ("points worth keeping, each a text of its own", 3, 7),
    "tags": ("tags of the vocabulary for the subject, and as many as 2 for the use", 0, 3),
    "content_type": (f"of {' / '.join(schemas.CONTENT_TYPES)}", 1, 1),
    "description": ("sentence about the whole text", 1, 1),
}


def _asked(field: str) -> str:
    form, least, most = ASKED[field]
    amount = str(most) if least == most else f"at most {most}" if not least else f"{least} to {most}"
    return f"- `{field}` holds {amount} {form}"


# Wording of the scorer's instructions around the taxonomy; users may pass their own.
INSTRUCTIONS = "\n".join(
    [
        "Catalogue the text you are given so that it can be found again later.",
        "",
        "Vocabulary. A tag may be used only if it is in this list, with the meaning stated there:",
        "{tags}",
        "",
        "How to choose among tags:",
        "{rules}",
        "",
        "Answer through the classify_content tool alone, with these fields:",
        *map(_asked, schemas.ANALYSIS.fieldNames()),
    ]
)


def _load(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_sources(spark: SparkSession, path: str | Path) -> DataFrame:
    """Registered sources in file order. Rows may lack required fields, see ``checked``."""
    rows = [
        (number, entry.get("email"), entry.get("name"), entry.get("sender_name"))
        for number, entry in enumerate(_load(path).get("sources") or [])
    ]
    return spark.createDataFrame(rows, schemas.SOURCE)


def checked(sources: DataFrame) -> DataFrame:
    """Sources with ``problem``: what a row lacks, or null."""
    lacks = F.concat_ws(
        ", ",
        F.when(F.col("email").isNull(), F.lit("email")),
        F.when(F.col("name").isNull(), F.lit("name")),
    )
    return sources.withColumn(
        "problem", F.when(lacks != "", F.concat(F.lit("missing: "), lacks))
    )


def read_taxonomy(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(kind, ord, tag, scope) and (ord, rule), both in file order."""
    data = _load(path)
    absent = [k for k in ("descriptive", "functional", "classification_rules") if k not in data]
    if absent:
        raise ValueError("taxonomy lacks: " + ", ".join(absent))
    tags = [
        (kind, number, tag, scope)
        for kind in ("descriptive", "functional")
        for number, (tag, scope) in enumerate(data[kind].items())
    ]
    rules = list(enumerate(data["classification_rules"]))
    return (
        spark.createDataFrame(tags, "kind string, ord int, tag string, scope string"),
        spark.createDataFrame(rules, "ord int, rule string"),
    )


def vocabulary(taxonomy: DataFrame) -> Column:
    """All valid tags as one array value, computed once per query."""
    return taxonomy.agg(F.array_sort(F.collect_set("tag"))).scalar()


def tag_lines(taxonomy: DataFrame) -> DataFrame:
    """One row: the tag list of the instructions, descriptive tags first, in order."""
    line = F.struct("kind", "ord", F.concat(F.lit("  - "), "tag", F.lit(": "), "scope").alias("line"))
    return taxonomy.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"]), "\n").alias("tags")
    )


def rule_lines(rules: DataFrame) -> DataFrame:
    line = F.struct("ord", F.concat(F.lit("  - "), "rule").alias("line"))
    return rules.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"]), "\n").alias("rules")
    )


def system_prompt(taxonomy: DataFrame, rules: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """One row with the instructions; taxonomy and rules are configuration-sized."""
    filled = F.replace(
        F.replace(F.lit(instructions), F.lit("{tags}"), tag_lines(taxonomy).scalar()),
        F.lit("{rules}"),
        F.col("rules"),
    )
    return rule_lines(rules).select(filled.alias("prompt"))
