"""Token counts as rollups that deltas maintain.

Totals of documents and tokens by source, language and tokenizer version are
never counted anew: batches of changes are added to them. An insert adds its
document and tokens, a delete takes them off, a revised count adds the difference.
A batch is first summed by key and then committed as a folder of its own, which
counts once its success marker is there. Committing the same batch again, after a
failure or a replay, changes nothing. ``compact`` folds committed batches into a
base, so that reading totals stays cheap.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, scratch, stored, text_of

KEYS = ("source", "lang", "tokenizer")
TOKENIZERS = "/opt/tokenizers"  # folder of vocabulary files, on every executor


class Rollup:
    """Additive totals below ``folder`` on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self) -> list[str]:
        """Committed folders."""
        top = self._path(".")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n for n in names if fs.exists(self._path(f"{n}/_SUCCESS")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before.

        ``changes``: source, lang, tokenizer, kind (insert, delete or revise),
        n_tokens and, for revise, old_tokens. Null counts are 0; another kind is an error.
        """
        name = f"batch-{batch}"
        if name in self._names() or batch in self._folded():
            return False
        sign = (
            F.when(F.col("kind") == "insert", 1)
            .when(F.col("kind") == "delete", -1)
            .when(F.col("kind") == "revise", 0)
            .otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("int"))
        )
        new = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
        old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
        signed = changes.withColumn("docs", sign.cast("long")).withColumn(
            "tokens", F.when(F.col("docs") == 0, new - old).otherwise(F.col("docs") * new)
        )
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # What a failed attempt has left is replaced; the marker is written last.
        sums.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def _base(self) -> str | None:
        return max((n for n in self._names() if n.startswith("base-")), key=lambda n: int(n[5:]), default=None)

    def _folded(self) -> set[str]:
        base = self._base()
        if base is None:
            return set()
        rows = self.spark.read.parquet(f"{self.folder}/folded-{base[5:]}").collect()  # batch names
        return {r.batch for r in rows}

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys whose totals are all zero are gone."""
        base, folded = self._base(), self._folded()
        parts = [n for n in self._names() if n.startswith("batch-") and n[6:] not in folded]
        parts += [base] if base else []
        if not parts:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        rows = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in parts])
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base. Batches stay until the base counts."""
        names, base = self._names(), self._base()
        batches = sorted({n[6:] for n in names if n.startswith("batch-")} | self._folded())
        if not batches:
            return
        k = int(base[5:]) + 1 if base else 0
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.folder}/folded-{k}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base-{k}")


def bpe_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a string column under a byte-level BPE vocabulary in rank format."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import public_tokenizers
        import tiktoken

        lines = Path(vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding(
            Path(vocabulary).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        for s in batches:
            yield pd.Series([len(own.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return count(text)


def counted(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Stored sizes of every row: doc_id, source, lang, guess (n_chars / 4), words, bpe. Null texts have none."""
    text = text_of(docs)
    return stored(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            docs["lang"].cast("string").alias("lang"),
            F.coalesce(F.floor(docs["n_chars"] / 4), F.lit(0)).cast("long").alias("guess"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            bpe_count(text, f"{tokenizers}/byte_bpe_50k.tiktoken").alias("bpe"),
        ),
        "counted",
    )


def ingest(docs: DataFrame, labels: DataFrame, folder: str | None = None, tokenizers: str = TOKENIZERS) -> Rollup:
    """Totals of a corpus through its changes.

    * load: every row under ``words/1``, and under ``byte_bpe_50k/1`` with a guess from n_chars;
    * count: every guess is revised to the tokenizer's count;
    * takedown: rows labelled toxic are deleted, under both tokenizers.

    Load and count are committed twice, as a replay would; the second time they don't count.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, folder or scratch(spark, "rollup"))
    rows = counted(docs, tokenizers)
    none = F.lit(None).cast("long")

    def change(rows: DataFrame, tokenizer: str, kind: str, n: str, old: Column = none) -> DataFrame:
        return rows.select(
            "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("kind"),
            F.col(n).alias("n_tokens"), old.alias("old_tokens"),
        )

    def both(rows: DataFrame, kind: str, bpe: str) -> DataFrame:
        return change(rows, "words/1", kind, "words").unionByName(change(rows, "byte_bpe_50k/1", kind, bpe))

    toxic = labels.where(F.col("toxic") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    batches = {
        "load": both(rows, "insert", "guess"),
        "count": change(rows, "byte_bpe_50k/1", "revise", "bpe", F.col("guess")),
        "takedown": both(rows.join(toxic, "doc_id", "left_semi"), "delete", "bpe"),
    }
    for name in ("load", "count", "load", "takedown", "count"):
        rollup.commit(name, batches[name])
    return rollup
