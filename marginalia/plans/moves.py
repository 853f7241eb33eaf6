"""Moving processed inbox files: notes and assets into the vault, then the originals away.

A move is four written steps, each in a folder of its own under ``moves/run_id=…``:

1. ``intent``: what shall be written where, with the digest of every original;
2. ``copied``: tasks write each file beside its place, read it back, compare digests and rename it;
3. ``committed``: the manifest, written only when every file arrived whole;
4. ``removed``: tasks delete originals that still have the digest of the intent.

Each step reads only what the one before has written, and doing a step again changes nothing. So
after a crash between any two of them ``finish`` goes on where the run stopped. An original that
was edited meanwhile stays. Large files are streamed by the tasks; no content is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.plans.runs import StateFolder, materialise
from marginalia.sources import vault
from marginalia.sources.files import opened

CHUNK = 1 << 20
INTENT = "source string, sha256 string, folder string, filename string, body string"
COPIED = "folder string, filename string, source string, sha256 string, whole boolean"
REMOVED = "path string, removed boolean"


def intents(notes: DataFrame, originals: DataFrame, pdf_digests: DataFrame, assets_folder: str) -> DataFrame:
    """Rows of ``INTENT``: notes with their text, originals to remove, PDF files to copy and remove.

    ``originals`` (path, sha256) are the Markdown files that became notes, ``pdf_digests`` (path,
    sha256) the PDF files that did.
    """
    nothing = F.lit(None).cast("string")
    written = notes.select(nothing.alias("source"), nothing.alias("sha256"), "folder", "filename", F.col("rendered").alias("body"))
    gone = originals.select(F.col("path").alias("source"), "sha256", nothing.alias("folder"), nothing.alias("filename"), nothing.alias("body"))
    name = vault.file_name(F.col("path"))
    copied = pdf_digests.select(
        F.col("path").alias("source"), "sha256", F.lit(assets_folder).alias("folder"), name.alias("filename"), nothing.alias("body")
    )
    return written.unionByName(gone).unionByName(copied)


def _digest(system, path: str) -> str:
    found = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while part := stream.read(CHUNK):
            found.update(part)
    return found.hexdigest()


def _copy(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Every file written beside its place, read back, and renamed if it is whole."""
    target, base = opened(root)
    for batch in batches:
        rows = []
        for source, sha256, folder, filename, body in batch[["source", "sha256", "folder", "filename", "body"]].itertuples(index=False):
            path = f"{base}/{folder}/{filename}"
            target.create_dir(f"{base}/{folder}", recursive=True)
            if source is None:
                content = body.encode()
                wanted = hashlib.sha256(content).hexdigest()
                with target.open_output_stream(f"{path}.part") as out:
                    out.write(content)
            else:
                origin, place = opened(source)
                wanted = sha256
                with origin.open_input_stream(place) as stream, target.open_output_stream(f"{path}.part") as out:
                    while part := stream.read(CHUNK):
                        out.write(part)
            whole = _digest(target, f"{path}.part") == wanted
            if whole:
                target.move(f"{path}.part", path)
            rows.append((folder, filename, source, wanted, whole))
        yield pd.DataFrame(rows, columns=["folder", "filename", "source", "sha256", "whole"])


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileType

    for batch in batches:
        rows = []
        for source, sha256 in batch[["source", "sha256"]].itertuples(index=False):
            system, path = opened(source)
            there = system.get_file_info(path).type != FileType.NotFound
            same = there and _digest(system, path) == sha256
            if same:
                system.delete_file(path)
            rows.append((source, same or not there))
        yield pd.DataFrame(rows, columns=["path", "removed"])


def _done(spark: SparkSession, path: str) -> bool:
    return vault.path_exists(spark, f"{path}/_SUCCESS")


def log(wanted: DataFrame, folder: StateFolder, run_id: str) -> None:
    """Step 1. A run that is repeated after its copies were committed keeps its first intent."""
    place = folder.path(f"moves/run_id={run_id}")
    if not _done(wanted.sparkSession, f"{place}/committed"):
        materialise(wanted, f"{place}/intent")


def finish(spark: SparkSession, folder: StateFolder, root: str, run_id: str) -> DataFrame | None:
    """Steps 2 to 4 of a run, as far as they are not done; (path, removed) of its originals."""
    place = folder.path(f"moves/run_id={run_id}")
    if not _done(spark, f"{place}/intent"):
        return None
    wanted = spark.read.schema(INTENT).parquet(f"{place}/intent")
    if not _done(spark, f"{place}/committed"):
        copies = wanted.filter("filename IS NOT NULL").mapInPandas(lambda batches: _copy(batches, root), COPIED)
        copied = materialise(copies, f"{place}/copied")
        if not copied.filter("NOT whole").isEmpty():
            raise OSError(f"files of run {run_id} did not arrive whole, see {place}/copied")
        materialise(copied.drop("whole"), f"{place}/committed")
    if not _done(spark, f"{place}/removed"):
        gone = wanted.filter("source IS NOT NULL").select("source", "sha256")
        return materialise(gone.mapInPandas(_remove, REMOVED), f"{place}/removed")
    return spark.read.schema(REMOVED).parquet(f"{place}/removed")


def finish_all(spark: SparkSession, folder: StateFolder, root: str) -> None:
    """What earlier runs have left undone, before a new run lists the inbox."""
    path = folder.path("moves")
    if not vault.path_exists(spark, path):
        return
    for name in vault.children(spark, path):
        if name.startswith("run_id="):
            finish(spark, folder, root, name.removeprefix("run_id="))
