"""Inbox folders: Markdown notes and PDF files → items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import frontmatter, lists

DONE = ("classified", "processed")
TEXT_ENTRIES = (
    "title", "source", "created", "type", "description", "newsletter", "published", "journal", "doi", "isbn",
)
NUMBER_ENTRIES = ("rating", "year")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; no folder has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(where)) if system.exists(where) else []


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the `.md` files directly in a folder; no folder gives no rows."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    # The metadata column states the path as an encoded URI, in which `+` stands for itself.
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return files.select(plain.alias("path"), F.col("value").alias("text"))


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """binaryFile rows of the `.pdf` files; `content` is read only where it is selected."""
    if not path_exists(spark, folder):
        return spark.createDataFrame(
            [], "path string, modificationTime timestamp, length bigint, content binary"
        )
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parse_notes(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """(path, text) → body, front matter entries by type, ``error`` for bad notes."""
    split = frontmatter.split_note(F.col(content))
    header = files.select(F.col(path).alias("original_path"), split.alias("_note"))
    parsed = header.withColumn("_yaml", frontmatter.yaml_to_json(F.col("_note.header")))
    meta = parsed.select(
        "original_path",
        F.col("_note.body").alias("content"),
        F.try_parse_json("_yaml.json").alias("fm"),
        F.col("_yaml.error").alias("_problem"),
    )
    fm = F.col("fm")
    title = F.try_variant_get(fm, "$.title", "variant")
    kind = F.schema_of_variant(title)
    bad_title = title.isNotNull() & (kind != "STRING")
    bad_number = F.lit(None).cast("string")
    for name in NUMBER_ENTRIES:
        given = F.try_variant_get(fm, f"$.{name}", "variant")
        whole = F.try_variant_get(fm, f"$.{name}", "string").rlike(r"^\s*[+-]?\d+\s*$")
        wrong = given.isNotNull() & (F.schema_of_variant(given) != "VOID") & ~F.coalesce(whole, F.lit(False))
        bad_number = F.coalesce(bad_number, F.when(wrong, F.lit(f"front matter: {name} is not a whole number")))
    return meta.select(
        "original_path",
        file_name(F.col("original_path")).alias("filename"),
        F.when(title.isNull(), file_stem(F.col("original_path")))
        .when(kind == "STRING", F.try_variant_get(fm, "$.title", "string"))
        .alias("title"),
        "content",
        frontmatter.source_url_of(fm).alias("source_url"),
        F.coalesce(frontmatter.text_value(fm, "status"), F.lit("inbox")).alias("existing_status"),
        lists.variant_list(F.try_variant_get(fm, "$.tags", "variant")).alias("existing_tags"),
        lists.variant_list(F.try_variant_get(fm, "$.author", "variant")).alias("existing_author"),
        F.struct(
            *(frontmatter.text_value(fm, name).alias(name) for name in TEXT_ENTRIES),
            *(F.try_variant_get(fm, f"$.{name}", "int").alias(name) for name in NUMBER_ENTRIES),
        ).alias("existing"),
        F.coalesce("_problem", F.when(bad_title, F.lit("front matter: title is not text")), bad_number).alias("error"),
    )


def existing_entries(existing: Column) -> dict[str, Column]:
    """The entries of a note as columns, null when absent."""
    return {name: existing[name] for name in (*TEXT_ENTRIES, *NUMBER_ENTRIES)}


def unprocessed(notes: DataFrame) -> DataFrame:
    """Readable notes that are not done yet; a note without status is in the inbox."""
    return notes.filter(F.col("error").isNull() & ~F.col("existing_status").isin(*DONE))


def quarantined(notes: DataFrame) -> DataFrame:
    """Notes whose front matter cannot be read. They do not stop the scan."""
    return notes.filter(F.col("error").isNotNull()).select("original_path", "error")


def pdf_items(files: DataFrame) -> DataFrame:
    """PDF files as items; only their names are used."""
    name = file_name(F.col("path"))
    return files.select(
        F.col("path").alias("original_path"),
        name.alias("filename"),
        file_stem(F.col("path")).alias("title"),
        F.concat(F.lit("[PDF file: "), name, F.lit("]")).alias("content"),
        F.lit("").alias("source_url"),
        lists.empty_list().alias("existing_tags"),
        lists.empty_list().alias("existing_author"),
        F.lit(True).alias("is_pdf"),
    )


def scan_inbox(notes: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Unprocessed notes and PDF stubs as one frame of items."""
    listed = unprocessed(notes).drop("error").withColumn("is_pdf", F.lit(False))
    both = listed.unionByName(pdf_items(pdfs), allowMissingColumns=True)
    return both.withColumn("item_id", F.col("original_path"))
