"""Notes and assets as files of a vault folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

WRITTEN = T.StructType([T.StructField("folder", T.StringType()), T.StructField("files", T.LongType())])


def opened(path: str):
    """The file system of a path and the path in it. Local paths may hold any characters."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith(("/", "file:")):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


def write_files(rows: DataFrame, root: str, content: Column) -> DataFrame:
    """Write ``root/folder/filename`` for every row; returns how many files each task wrote.

    The tasks write, through the file system of the root's address, so nothing passes the
    driver. A file of the same name is replaced, so a repeated task changes nothing; names
    must be unique, as they are in the notes table.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for batch in batches:
            for folder in batch["folder"].unique():
                system.create_dir(f"{base}/{folder}", recursive=True)
            for folder, filename, body in batch.itertuples(index=False):
                with system.open_output_stream(f"{base}/{folder}/{filename}") as out:
                    out.write(body)
            counts = batch.groupby("folder").size()
            yield pd.DataFrame({"folder": counts.index, "files": counts.to_numpy()})

    return rows.select("folder", "filename", content.alias("body")).mapInPandas(write, WRITTEN)


def write_notes(notes: DataFrame, root: str) -> DataFrame:
    """Rendered notes as Markdown files."""
    return write_files(notes, root, F.encode("rendered", "UTF-8"))
