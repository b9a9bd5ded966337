"""Sinks (SNK2, SNK3, SNK6, SNK7): documents to a folder, results as JSON, events as frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T


def write_documents(files: DataFrame, folder: str, prefix: str, at: Column | None = None) -> DataFrame:
    """SNK2, SNK3: each content as a file of a stamped name below a folder that executors share; gives path, target, bytes."""
    named = files.filter("content IS NOT NULL").select("path", "content", T.file_stamp(F.lit(prefix), F.regexp_replace(T.basename(F.col("path")), r"\.[^.]*$", ""), at if at is not None else F.current_timestamp()).alias("target"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for frame in frames:
            out = []
            for path, content, target in zip(frame["path"], frame["content"], frame["target"]):
                place = f"{root.rstrip('/')}/{target}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as f:
                    f.write(bytes(content))
                out.append((path, target, len(content)))
            yield pd.DataFrame(out, columns=["path", "target", "bytes"])

    return named.mapInPandas(run, "path string, target string, bytes long")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """SNK6: rows as JSON, letters as they are."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def event_frames(df: DataFrame, event: Column, data: Column) -> DataFrame:
    """SNK7: server-sent event frames."""
    return df.select(F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))
