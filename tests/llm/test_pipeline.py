"""The pipeline against brute force, stage by stage on each stage's own input."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from voltledger.llm import robust_rules  # noqa: E402
from voltledger.llm.common import stored  # noqa: E402

from .test_operators import classes, removed  # noqa: E402


def test_stages(spark, given, sf_dir):
    steps = [given]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf_dir), "stage", step=False))
    raw, good, single, stripped, clean, mixed = steps
    for df in steps[:5]:
        assert df.columns == given.columns
    verdict = {r.doc_id: r.kept for r in robust_rules.judge(raw).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, k in verdict.items() if k}
    rows = [tuple(r) for r in good.collect()]
    ids, _ = classes(rows)
    assert {r.doc_id for r in single.collect()} == {i[2] for i in ids}
    before = [tuple(r) for r in single.collect()]
    after = {r.doc_id: r for r in stripped.collect()}
    for doc_id, n, gone, _ in removed(before, 35):
        assert (doc_id in after) == (gone < n or n == 0)
        if gone and doc_id in after:
            assert len(after[doc_id].text.split()) == n - gone and after[doc_id].n_chars == len(after[doc_id].text)
    assert {r.doc_id for r in clean.collect()} <= set(after)
    assert set(mixed.columns) == {*given.columns, "copy", "position"}
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3


def test_registered(spark, sf_dir):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) >= 10 and "pipeline" in entry.queries()
