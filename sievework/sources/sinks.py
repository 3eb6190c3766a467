"""Sinks: CSV reports, JSON summaries, metric tables, copies of file trees."""

from __future__ import annotations

import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; booleans as True/False, null and empty both as nothing."""
    cells = [F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def summary_json(sections: dict[str, Column], df: DataFrame, pretty: bool = True) -> DataFrame:
    """One row with one JSON document: each section an aggregate of ``df``."""
    row = df.agg(*[c.alias(k) for k, c in sections.items()])
    return row.select(F.to_json(F.struct(*sections), {"pretty": str(pretty).lower()}).alias("value"))


def write_summary(sections: dict[str, Column], df: DataFrame, path: str, pretty: bool = True) -> None:
    """The document of ``summary_json`` as a text file in the folder ``path``."""
    summary_json(sections, df, pretty).coalesce(1).write.mode("overwrite").text(path)


def metric_rows(row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``metric`` and ``value`` (text) for the columns of a one-row table, in the order given."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics])
    return row.select(F.inline(pairs))


def copy_tree(manifest: DataFrame, source: str, target: str) -> None:
    """Copy the files of ``manifest.file`` from one shared folder to another, on any file system that Arrow knows.

    Between folders without a scheme the times are copied as well. The
    target must not lie in the source (compared without case).
    """
    inside, outside = (str(Path(x).resolve()).lower() if "://" not in x else x.rstrip("/").lower() for x in (target, source))
    if inside == outside or inside.startswith(outside + "/"):
        raise ValueError("the target lies in the source")
    local = "://" not in source + target

    def copy(rows) -> None:
        from pyarrow import fs

        if not local:
            (read, at), (write, to) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
        for r in rows:
            if local:
                new = Path(target, r["file"])
                new.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(Path(source, r["file"]), new)
            else:
                new = f"{to}/{r['file']}"
                write.create_dir(new.rsplit("/", 1)[0], recursive=True)
                with read.open_input_stream(f"{at}/{r['file']}") as data, write.open_output_stream(new) as out:
                    shutil.copyfileobj(data, out, 1 << 20)

    manifest.select("file").foreachPartition(copy)
