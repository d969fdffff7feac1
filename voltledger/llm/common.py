"""What the corpus operators share: row keys, stored steps, free column names, block broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltledger.session import ends_with_session, shared_folder

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words of letters, digits and non-ASCII characters in lower-cased text.
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; removed when the session's JVM ends."""
    top = shared_folder(spark)
    if top is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = ends_with_session(spark, f"{top}/corpus-{spark.sparkContext.applicationId}")
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: Paths of stored steps by application, until they are dropped.
_steps: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str, step: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no earlier step.

    It goes with the session, or, being a ``step`` of a result, once that is written: see ``drop_steps``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if step:
        _steps.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_steps(spark: SparkSession) -> None:
    """Delete the steps stored so far; every result that reads them must have been written by now."""
    for path in _steps.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, by: list[Column], number: str) -> DataFrame:
    """``df``, a stored table, with a dense ``number`` from 0 in the order of ``by``.

    Range partitions are sorted and counted; each row's number is its place in its partition
    after the rows of the partitions before. ``by`` must tell rows apart.
    """
    part, place, ahead = fresh(df, f"{number}_part", f"{number}_place", f"{number}_ahead")
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {part: F.shiftright(at, 33), place: at.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed = stored(placed, "placed")
    # One row per partition.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(ahead))
    return placed.join(F.broadcast(starts), part).withColumn(number, F.col(ahead) + F.col(place)).drop(part, place, ahead)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from the given ones."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def terms(text: Column) -> Column:
    """Words of a lower-cased text without punctuation. Splitting is far faster here than extracting.

    Lower-casing beyond A-Z moves no border: a character stays on its side of them.
    """
    return F.array_remove(F.split(F.lower(text), BETWEEN_TERMS, -1), "")


def row_keys(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two longs that tell rows apart by id and text, never null.

    Rows with equal keys have the same id and, but for a 64-bit collision under
    one id, the same text, so whatever follows from the text is theirs alike.
    """
    own = df[id_col].cast("long")
    return (
        F.coalesce(own, F.lit(-(2**63))),
        F.xxhash64(own, df[text].cast("string")),
    )


def blocks(df: DataFrame, key: str, most_rows: int) -> list[DataFrame]:
    """``df`` in parts of about ``most_rows`` rows at most, each marked for broadcast.

    ``df`` must be stored. The rows are counted first; a table of any size gives
    more parts, not larger ones. ``key`` must be spread evenly (a hash).
    """
    n = max(1, -(-df.count() // most_rows))
    if n == 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.where(F.pmod(F.col(key), F.lit(n)) == i)) for i in range(n)]


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A stored table marked for broadcast if it has at most ``most_rows`` rows, else itself."""
    return F.broadcast(df) if df.count() <= most_rows else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
