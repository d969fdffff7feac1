"""Reading exported sheets: every column as text, typed by the specs later."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger.session import ends_with_session, shared_folder


def read_extract(
    spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """CSV sheet with a heading line, all text; no pass over the data to guess types.

    ``multi_line`` is for sheets with line breaks in headings or cells; Spark then
    reads each file in one task, so give it sheet-sized files only.
    """
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .csv(path)
    )


def read_positional(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Sheet whose headings are unusable: columns named by position, all text.

    Heading lines arrive as rows; the census sources drop them by content, which
    does not depend on the order in which files and splits are read.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("sep", sep).csv(path)


def land_lines(spark: SparkSession, path: str, folder: str, quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """The lines of the files under ``path`` and their blocks, stored below ``folder``.

    Lines have file, block (where the split begins in the file), at (rising within a block), odd
    (whether the line's quotes don't pair) and value. Blocks have n_odd and inside: whether
    the block begins inside a quoted cell, which the quotes of all blocks before it decide. The
    text is scanned once, in splits; lines end with a line feed.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote)))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (quotes % 2 == 1).alias("odd"),
        "value",
    )

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lines = stored(lines, "lines")
    # One row per split of a file; from here on splits are those of the stored lines.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("long")).alias("n_odd"))
    inside = F.coalesce(F.sum("n_odd").over(before), F.lit(0)) % 2 == 1
    return lines, stored(blocks.withColumn("inside", inside), "blocks")


def records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, at, value): the records of landed lines, with line breaks inside quoted cells.

    A line is a record of its own unless its block has or continues a quoted cell with a
    break; only lines of such blocks are shuffled and put together. ``at`` rises with the records of a
    block. A file whose quotes don't pair is an error: no line of it can be told to be whole.
    """
    torn = blocks.groupBy("file").agg(F.sum("n_odd").alias("n")).where("n % 2 = 1").first()
    if torn:
        raise ValueError(f"{torn.file}: a quoted cell is never closed")
    plain = ("file", "block", "at", "value")
    if blocks.where("n_odd > 0").isEmpty():
        out = lines.select(*plain)
    else:
        broken = blocks.where("n_odd > 0 OR inside")
        here = Window.partitionBy("file", "block").orderBy("at")
        passed = F.sum(F.col("odd").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, -1))
        begins = (F.col("inside").cast("long") + F.coalesce(passed, F.lit(0))) % 2 == 0
        cut = lines.join(broken, ["file", "block"]).withColumn("begins", begins.cast("long"))
        cut = cut.withColumn("run", F.sum("begins").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        # Records are numbered through the file, so that one that began in an earlier block gets its lines.
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        begun = cut.groupBy("file", "block").agg(F.sum("begins").alias("n")).select(
            "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun")
        )
        parts = cut.join(begun, ["file", "block"]).groupBy("file", (F.col("begun") + F.col("run")).alias("record")).agg(
            F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts")
        )
        whole = parts.select(
            "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
            F.array_join(F.col("parts.value"), "\n").alias("value"),
        )
        out = lines.join(broken, ["file", "block"], "left_anti").select(*plain).unionByName(whole)
    return out.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _plain(heading: str) -> str:
    """A heading without differences of case, spacing and line breaks."""
    return " ".join(heading.replace("\ufeff", "").split()).lower()


def read_sheet(
    spark: SparkSession,
    path: str,
    headings: Sequence[str],
    sep: str = ",",
    width: int = 64,
    folder: str | None = None,
) -> DataFrame:
    """The columns under ``headings``, as text, of a sheet with lines above its heading.

    The heading of a file is its first record that holds all ``headings``; it must begin in
    the file's first split. Headings and data may have line breaks and empty lines in
    quoted cells. What lies down to the heading is dropped by place, whatever it
    holds; so is nothing below it but rows empty in all these columns. A file
    without a heading has data only. All files of the path have one layout of at most ``width``
    columns; files that differ, and a path without any heading, are errors. The files are scanned
    once, in splits, into ``folder`` (by default below the session's shared folder) and read from there.
    """
    if folder is None:
        top = shared_folder(spark)
        if top is None:
            raise ValueError("give a folder, or set spark.checkpoint.dir to one that all executors share")
        own = ends_with_session(spark, f"{top}/sheets-{spark.sparkContext.applicationId}")
        folder = f"{own}/{uuid.uuid4().hex}"
    rows = records(*land_lines(spark, path, folder))
    names = [f"c{i}" for i in range(width)]
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    cells = rows.withColumn("cells", F.from_csv("value", ", ".join(f"{n} string" for n in names), options))
    want = [_plain(h) for h in headings]
    # Few records have the headings' words; of those the cells are compared.
    words = sorted({w for h in want for w in re.findall("[a-z0-9]+", h)})
    likely = reduce(and_, [F.lower("value").contains(w) for w in words], F.col("block") == 0)
    found = F.array(*[F.coalesce(F.col(f"cells.{n}"), F.lit("")) for n in names])
    found = F.transform(found, lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s\x{FEFF}]+", " "))))
    place = F.array(*[F.array_position(found, h).cast("int") for h in want])
    heads = cells.where(likely).select("file", "at", place.alias("place")).where(~F.array_contains("place", 0))
    # One row per file, of which the driver has a list anyway.
    heads = heads.groupBy("file").agg(F.min_by("place", "at").alias("place"), F.min("at").alias("at")).collect()
    if not heads:
        raise ValueError(f"{path}: no heading with {sorted(want)}")
    places = {tuple(h.place) for h in heads}
    if len(places) > 1:
        raise ValueError(f"{path}: files have their columns in different places")
    kept = [f"cells.{names[i - 1]}" for i in places.pop()]
    tops = spark.createDataFrame([(h.file, h.at) for h in heads], "file string, top long")
    below = F.col("top").isNull() | (F.col("block") > 0) | (F.col("at") > F.col("top"))
    filled = reduce(or_, [F.col(c).isNotNull() for c in kept])
    return cells.join(tops, "file", "left").where(below & filled).select(
        *[F.col(c).alias(h) for c, h in zip(kept, headings, strict=True)]
    )
