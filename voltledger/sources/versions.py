"""Commits by name, and tables made of what several commits wrote.

Data is written to folders of its own first; it counts once a small file that names it is there.
Such a file appears whole or not at all and never replaces another one, so readers see what was
committed before or after, and of two writers of one name only the first succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commit(spark: SparkSession, folder: str, name: str, content: Mapping[str, Any]) -> bool:
    """Make ``content`` known under ``name``; False if the name is taken, and then nothing changes."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    draft, final = fs.Path(at, f"_{uuid.uuid4().hex}"), fs.Path(at, name)
    out = store.create(draft)
    out.write(json.dumps(content).encode())
    out.close()
    try:
        files = fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
        files.rename(store.makeQualified(draft), store.makeQualified(final), spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
            raise
        store.delete(draft, False)
        return False
    return True


def committed(spark: SparkSession, folder: str) -> dict[str, dict[str, Any]]:
    """Content by name of what was committed to ``folder``: a row per commit, not per file or row of data."""
    if not exists(spark, folder):
        return {}
    files = spark.read.schema("value string").option("wholetext", True).text(folder)
    rows = files.select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return {r.name: json.loads(r.value) for r in sorted(rows)}


def entry(
    df: DataFrame, path: str, by: str | None = None, values: Sequence[str] | None = None, older: Mapping[str, Any] | None = None
) -> dict[str, Any]:
    """What a commit says of a table: its schema and folders, newest first.

    With ``values`` the folder ``path`` holds only rows whose column ``by`` has one of them; for the
    rest the folders of the ``older`` entry stay valid, but for those that have no value left.
    """
    parts = [{"path": path, "values": list(values) if values is not None else None}]
    if values is not None and older is not None:
        parts += [p for p in older["parts"] if p["values"] is None or set(p["values"]) - set(values)]
    return {"schema": df.schema.jsonValue(), "by": by, "parts": parts}


def read_entry(spark: SparkSession, table: Mapping[str, Any]) -> DataFrame:
    """The table of an entry: of each value of ``by`` the newest folder that has it."""
    schema = T.StructType.fromJson(table["schema"])
    taken: list[str] = []
    out = None
    for part in table["parts"]:
        rows = spark.read.schema(schema).parquet(part["path"]).select(*schema.names)
        if part["values"] is not None:
            rows = rows.where(F.col(table["by"]).isin([v for v in part["values"] if v not in taken]))
        elif taken:
            rows = rows.where(~F.coalesce(F.col(table["by"]).isin(taken), F.lit(False)))
        taken += part["values"] or []
        out = rows if out is None else out.unionByName(rows)
    return out
