"""Quality rules: robust multivariate outliers within each language and source.

Every text gives a vector of transformed statistics. For each (lang, source) a
minimum-covariance-determinant estimate of centre and spread is fitted to the rows
that pass the base rule: from medians and scaled median deviations, concentration
steps refit mean and covariance to the ``SHARE`` of rows with the smallest
Mahalanobis distances, which never raises the determinant. A row is rejected if
its distance exceeds ``CUT``.

All of it is built-in expressions. Texts are read once, into a stored table of
statistics; the steps run on that. Each step is a map-side-combined aggregate per
group, so a source with a third of all rows costs a task one row. Steps are taken until no
determinant moves any more. An estimate from n rows counts n / (n + ``PRIOR``), the rest is the estimate
of the group's language, and that of a language is mixed with the one of all rows in the same way; so
verdicts change gradually as a group grows.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, row_keys, small, stored, text_of

SHARE = 0.75  # of a group's rows that a concentration step keeps
STEPS = 10  # at most
SETTLED = 0.02  # change of a determinant's logarithm that counts as none
PRIOR = 60  # rows that the estimate of the level above counts as
CUT = 28.0  # squared distance beyond which a row is an outlier
#: Statistics and the spread that even a group of equal texts is granted, in transformed units.
AXES = {
    "log_words": 0.25,
    "word_length": 0.08,
    "symbols": 0.05,
    "capitals": 0.05,
    "dup_lines": 0.2,
    "repeats": 0.15,
}
ANY_WORD = r"[^\x20\x09-\x0D]"


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, by place."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _ranked(hashes: Column) -> Column:
    """Hashes with their places, sorted, so that equal ones are neighbours; null if all differ."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), F.sort_array(pairs))


def _covered(ranked: Column) -> Column:
    """Words inside windows whose hash has an equal neighbour."""
    twice = F.filter(
        ranked,
        lambda x, i: (x.h == F.get(ranked, i - 1).h) | (x.h == F.get(ranked, i + 1).h),
    )
    at = F.transform(twice, lambda x: x.i)
    words = F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
    return F.coalesce(F.size(F.array_distinct(words)).cast("long"), F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, row keys k1, k2 and the counts.

    Null texts count as empty, null languages and sources are groups of their own.
    Repeated windows are found by 64-bit hashes within one text.
    """
    k1, k2 = row_keys(docs)
    text = F.col("text")
    lines = F.col("lines")
    return (
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["lang"].cast("string").alias("lang"),
            docs["source"].cast("string").alias("source"),
            k1.alias("k1"),
            k2.alias("k2"),
            text_of(docs).alias("text"),
        )
        .withColumns(
            {
                "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(ANY_WORD)),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_capitals": F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long"),
            }
        )
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length(F.array_join("words", "")).cast("long"),
                "n_lines": F.size(lines).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                "hashes": _window_hashes(F.col("words")),
            }
        )
        .withColumn("ranked", _ranked(F.col("hashes")))
        .withColumn("n_repeat_words", F.when(F.col("ranked").isNull(), 0).otherwise(_covered(F.col("ranked"))))
        .drop("text", "words", "lines", "hashes", "ranked")
    )


def base_failed() -> Column:
    """Too short, or mostly repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _axes() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.sqrt(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)))

    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.coalesce(F.log1p(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double"))), F.lit(0.0)),
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def _chi2_cdf(x: float, degrees: int) -> float:
    """Of an even number of degrees."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= (x / 2) / (i + 1)
    return 1 - exp(-x / 2) * total


def consistency(share: float, degrees: int) -> float:
    """What makes the covariance of the innermost ``share`` of normal rows unbiased."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, degrees) < share else (low, mid)
    return share / _chi2_cdf(low, degrees + 2)


def _with_distance(rows: DataFrame, names: list[str], name: str) -> DataFrame:
    """The forward substitution one column at a time, which keeps expressions small."""
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    total = F.col("z_0") * F.col("z_0")
    for i in range(1, len(names)):
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return rows.withColumn(name, total).drop(*[f"z_{i}" for i in range(len(names))])


def _cholesky(groups: DataFrame, p: int) -> DataFrame:
    """Columns c_i_j (lower covariances) to l_i_j."""
    for j in range(p):
        own = F.col(f"c_{j}_{j}")
        for k in range(j):
            own = own - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(1e-9))))
        for i in range(j + 1, p):
            off = F.col(f"c_{i}_{j}")
            for k in range(j):
                off = off - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", off / F.col(f"l_{j}_{j}"))
    return groups


def _lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """MCD estimates by ``g``: columns g, n, m_i, c_i_j (lower covariances), a stored table.

    ``rows``: a stored table with lang, source and the axes. A row counts in its group,
    its language and the whole, keyed by ``level``.
    """
    names, floors = list(AXES), list(AXES.values())
    p = len(names)
    grow = consistency(share, p)
    levels = rows.withColumn(
        "grp", F.explode(F.array(F.struct("lang", "source", F.lit(0).alias("level")),
                                 F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(1).alias("level")),
                                 F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(2).alias("level"))))
    )
    levels = levels.select(F.xxhash64("grp.level", "grp.lang", "grp.source").alias("g"), *names)

    start = levels.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{i}") for i, a in enumerate(names)],
    )
    start = stored(start, "starts")
    params = start.select(
        "g",
        *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)],
        *[
            F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(floors[i])).alias(f"l_{i}_{i}")
            if i == j else F.lit(0.0).alias(f"l_{i}_{j}")
            for i, j in _lower(p)
        ],
    )
    centre = stored(
        start.select("g", *[F.col(f"q_{i}")[1].alias(f"o_{i}") for i in range(p)]), "medians"
    )
    params = stored(params, "mcd")
    for _ in range(steps):
        far = _with_distance(levels.join(small(params), "g"), names, "d2").select("g", "d2", *names)
        edge = stored(
            far.groupBy("g").agg(F.percentile_approx("d2", share, 1000).alias("edge")), "edges"
        )
        inner = far.join(small(edge), "g").where("d2 <= edge").join(small(centre), "g")
        x = [F.col(a) - F.col(f"o_{i}") for i, a in enumerate(names)]
        sums = inner.groupBy("g").agg(
            *[F.avg(x[i]).alias(f"a_{i}") for i in range(p)],
            *[F.avg(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in _lower(p)],
        )
        cov = sums.join(small(centre), "g").select(
            "g",
            *[F.round(F.col(f"a_{i}") + F.col(f"o_{i}"), 9).alias(f"m_{i}") for i in range(p)],
            *[
                F.round(
                    grow * (F.col(f"s_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}"))
                    + (floors[i] ** 2 if i == j else 0.0),
                    9,
                ).alias(f"c_{i}_{j}")
                for i, j in _lower(p)
            ],
        )
        cov = stored(cov, "covariances")
        before = params.select("g", _log_det(p).alias("before"))
        params = stored(
            _cholesky(cov, p).select("g", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i, j in _lower(p)]),
            "mcd",
        )
        # The first step leaves the spreads of medians, which are no covariances yet.
        moved = params.join(before, "g").agg(F.max(F.abs(_log_det(p) - F.col("before"))).alias("most")).first().most
        if moved is None or moved < SETTLED:
            break
    return stored(cov.join(start.select("g", "n"), "g"), "estimates")


def _log_det(p: int) -> Column:
    return sum((2 * F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))


def mixed(groups: DataFrame, estimates: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(own, m_i, l_i_j): each (lang, source) of ``groups`` with its estimate, pulled towards the levels above.

    A group, or a language, without rows of its own has that of the level above; without any rows there is none.
    """
    p = len(AXES)
    names = [*[f"m_{i}" for i in range(p)], *[f"c_{i}_{j}" for i, j in _lower(p)]]
    none = F.lit(None).cast("string")
    keys = [
        F.xxhash64(F.lit(2), none, none),
        F.xxhash64(F.lit(1), F.col("lang"), none),
        F.xxhash64(F.lit(0), F.col("lang"), F.col("source")),
    ]
    out = groups.select(*[k.alias(f"key_{i}") for i, k in enumerate(keys)])
    for level in range(3):
        own = estimates.select(F.col("g").alias(f"key_{level}"), F.col("n").alias("n_"), *[F.col(c).alias(f"{c}_") for c in names])
        weight = F.coalesce(F.col("n_") / (F.col("n_") + prior), F.lit(0.0)) if level else F.lit(1.0)
        above = [F.col(c) if level else F.lit(None).cast("double") for c in names]
        out = out.join(small(own), f"key_{level}", "left")
        pulled = [
            F.coalesce(F.round(weight * F.col(f"{c}_") + (1 - weight) * a, 9), a if level else F.col(f"{c}_")).alias(c)
            for c, a in zip(names, above, strict=True)
        ]
        out = out.select("key_0", "key_1", "key_2", *pulled)
    out = stored(out.where(F.col(names[0]).isNotNull()).withColumnRenamed("key_2", "own"), "mixed")
    return _cholesky(out, p).select("own", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i, j in _lower(p)])


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Per row of ``docs``: ids, row keys, counts, base_failed, distance and kept.

    Without any row that passes the base rule there is no estimate, and ``distance`` is null.
    """
    names = list(AXES)
    table = stored(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    rows = table.withColumns(_axes())
    estimates = fit(rows.where(~F.col("base_failed")).select("lang", "source", *names))
    chosen = stored(mixed(stored(rows.select("lang", "source").distinct(), "groups"), estimates), "chosen")
    own = F.xxhash64(F.lit(0), F.col("lang"), F.col("source"))
    far = _with_distance(
        rows.withColumn("own", own).join(small(chosen), "own", "left"), names, "distance"
    )
    return far.select(
        *table.columns,
        "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that pass; equal rows share their verdict."""
    gone = judge(docs, cut).where(~F.col("kept")).select("k1", "k2").distinct()
    k1, k2 = fresh(docs, "k1", "k2")
    a, b = row_keys(docs)
    gone = gone.toDF("g1", "g2")
    return (
        docs.withColumns({k1: a, k2: b})
        .join(gone, (F.col(k1) == gone.g1) & (F.col(k2) == gone.g2), "left_anti")
        .select(*docs.columns)
    )
