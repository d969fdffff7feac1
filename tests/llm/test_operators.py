"""Every operator against a brute-force version over odd rows, and over no rows."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltledger.llm import (
    curriculum,
    decontaminate,
    hmm,
    html_density,
    license_scan,
    robust_rules,
    simhash,
    substring,
    token_rollup,
    weak_labels,
)

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 1


def test_estimate_finds_bad_patterns():
    draw = np.random.default_rng(3)
    truth = draw.random(4000) < 0.85
    votes = np.stack([np.where(draw.random(4000) < 0.3, 2, np.where(truth, draw.random(4000) > 0.02, draw.random(4000) > 0.5)) for _ in range(6)], axis=1).astype(int)
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy = weak_labels.estimate(patterns, count.astype(float))
    assert ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.93
    assert (accuracy > 0.7).all()


def test_classifier_on_labelled_rows(spark, given, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", F.col("toxic").alias("t"))
    rows = weak_labels.classify(given).join(labels, "doc_id").where("t = 0").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9


def test_classifier_on_odd_rows(odd, none, odd_rows):
    rows = weak_labels.classify(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
    assert not any(r.kept for r in rows if r.doc_id in (1000, 1001, 1002))
    assert weak_labels.classify(none).count() == 0


# 2


def test_license_scan(odd, none, odd_rows):
    want = Counter()
    for doc_id, text, *_ in odd_rows:
        words = TERM.findall(lower(text))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            part = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(part)] == part]
            places += at
            labels |= {label} if at else set()
        want[(doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    got = license_scan.scan(odd)
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect())
    assert license_scan.scan(none).count() == 0


def test_notices_are_found_by_their_key_phrases(spark):
    texts = [n[1] for n in license_scan.NOTICES] + ["licensed under the license of nobody", license_scan.NOTICES[9][1].replace("conditions", "clauses")]
    docs = spark.createDataFrame([(i, f"x y {t} z") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(docs).collect()}
    for i, (label, _, _) in enumerate(license_scan.NOTICES):
        assert label in got[i]
    assert got[len(texts) - 2] == [""] and got[len(texts) - 1] == [""]


def scanned(texts):
    """Labels and score by text, each start of each template tried."""
    words = [TERM.findall(lower(t)) for t in texts]
    weights = {w: math.log((len(texts) + 1) / (sum(w in set(ws) for ws in words) + 0.5)) for w in license_scan.vocabulary()}
    templates = [(label, phrase.split(), [phrase], True) for phrase, label in license_scan.BASE.items()]
    templates += [(label, text.split(), keys, False) for label, text, keys in license_scan.NOTICES]
    out = []
    for ws in words:
        labels, score = set(), 0.0
        for label, want, keys, base in templates:
            total = sum(weights[w] for w in want)
            rare = sorted(range(len(want)), key=lambda i: (-weights[want[i]], i))[: 1 if base else license_scan.RARE]
            must = [(i, k.split()) for k in keys for i in [f" {' '.join(want)} ".index(f" {k} ")]]
            must = [(len(" ".join(want)[:i].split()), k) for i, k in must]
            for start in range(-len(want), len(ws)):
                same = [0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(want)]
                share = sum(weights[w] for w, s in zip(want, same) if s) / total
                if not all(all(same[i : i + len(k)]) for i, k in must) or sum(same[i] for i in rare) < (1 if base else license_scan.AGREE):
                    continue
                if base or share >= license_scan.COVER:
                    labels.add(label)
                    score = max(score, 1.0 if base else min(share, 1.0))
        out.append((",".join(sorted(labels)), round(score, 6)))
    return out


@pytest.mark.parametrize("part", [5, 256])
def test_notices_are_those_of_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(license_scan, "PART", part)
    draw = np.random.default_rng(5)
    filler = [*license_scan.vocabulary()[:40], "x", "y", "z"]
    texts = ["", "license", "mit license " * 9]
    for _ in range(60):
        words = []
        for _ in range(draw.integers(1, 4)):
            words += draw.choice(filler, draw.integers(0, 30)).tolist()
            notice = license_scan.NOTICES[draw.integers(len(license_scan.NOTICES))][1].split()
            words += [w if draw.random() > 0.06 else "odd" for w in notice]
        texts.append(" ".join(words[draw.integers(0, 4) :]))  # some are cut at the start
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    want = scanned(texts)
    assert [got[i][0] for i in range(len(texts))] == [w[0] for w in want] and any("," in w[0] for w in want)
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_a_text_of_a_million_words_is_scanned_in_linear_time(spark):
    docs = spark.sql("select 1L as doc_id, repeat('mit license a b ', 250000) as text")
    since = time.monotonic()
    (row,) = license_scan.scan(docs).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (1000000, 250000, 0, 999996)
    assert time.monotonic() - since < 60


# 3


def test_contamination(spark, given, sf_dir, none):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: TERM.findall(r.text.lower()) for r in bench.collect()}
    long = max(items, key=lambda i: len(items[i]))
    words = items[long]
    swapped = [w if i % 6 else "zz" for i, w in enumerate(words)]  # one in six substituted
    torn = [w if i % 3 else "zz" for i, w in enumerate(words)]  # one in three: too many
    more = [(9001, "before " + " ".join(swapped).upper() + " after"), (9002, " ".join(torn)), (9003, None), (9004, ""), (None, " ".join(words))]
    docs = given.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = decontaminate.contamination(docs, bench).collect()
    flagged = {r.doc_id for r in got if r.contaminated}
    text = {r.doc_id: " " + " ".join(TERM.findall(r.text.lower())) + " " for r in given.collect()}
    whole = {d for d, t in text.items() if any(f" {' '.join(i)} " in t for i in items.values() if len(i) >= decontaminate.SPAN)}
    assert whole and whole <= flagged and {9001, None} <= flagged
    assert not flagged & {9002, 9003, 9004}
    # Nothing else: a flagged text shares most words with an item on one diagonal.
    assert flagged - whole - {9001, None} == set()
    assert len(got) == docs.count()
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)


@pytest.mark.parametrize("length", range(decontaminate.SEEDED, decontaminate.OVERLAP + 1))
def test_a_mask_survives_any_substitutions_that_are_allowed(length):
    from itertools import combinations

    shifts = [
        sum(1 << (k + i) for i, c in enumerate(m) if c == "1")
        for m in decontaminate.MASKS
        for k in range(length - len(m) + 1)
    ]
    for gone in combinations(range(length), length - math.ceil(decontaminate.AGREE * length)):
        hole = sum(1 << i for i in gone)
        assert any(not s & hole for s in shifts)


def contaminated(words, item):
    """Brute force: some 20 consecutive item words, or all of a shorter one, of which four fifths agree on a diagonal."""
    if len(item) < decontaminate.SEEDED:
        if len(item) < decontaminate.WITHIN:
            return words == item
        return any(words[i : i + len(item)] == item for i in range(len(words)))
    need = min(len(item), decontaminate.OVERLAP)
    for start in range(-len(item), len(words)):
        same = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(item)]
        if any(sum(same[i : i + need]) >= decontaminate.AGREE * need for i in range(len(item) - need + 1)):
            return True
    return False


def test_contamination_is_that_of_brute_force(spark):
    draw = np.random.default_rng(8)
    items = [[f"q{k}w{i}" for i in range(n)] for k, n in enumerate([*range(1, 24), 30, 41])]
    docs = []
    for item in items * 6:
        words = [w if draw.random() > draw.choice([0, 0.1, 0.2, 0.25, 0.3]) else "zz" for w in item]
        at = int(draw.integers(0, len(words))) if draw.random() < 0.3 else 0
        around = int(draw.integers(0, 150)) * int(draw.integers(0, 2))
        docs.append([f"a{i}" for i in range(around)] + words[at:] + [f"b{i}" for i in range(around % 7)])
    docs += [items[3], items[3] + ["x"], items[0], [*items[0], "x"], []]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([*items, []])], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    have = {r.doc_id: r.item_ids for r in got if r.contaminated}
    want = {i: ",".join(map(str, [k for k, item in enumerate(items) if contaminated(d, item)])) for i, d in enumerate(docs)}
    assert have == {i: ks for i, ks in want.items() if ks}
    assert len(have) > 40


# 4


def test_scores(odd, none, odd_rows):
    tokens = [lower(r[1]).encode().split() + [b""] for r in odd_rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in odd_rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter(
        (r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4))
        for r, t, h in zip(odd_rows, tokens, held, strict=True)
    )
    rows = hmm.score(odd, rounds=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert hmm.score(none, rounds=1).count() == 0


def test_frequent_words_are_filtered_not_sorted(spark):
    draw = np.random.default_rng(1)
    c = draw.zipf(1.2, 5000) % 10**9 + 1
    words = spark.createDataFrame([(f"w{i}".encode(), int(n)) for i, n in enumerate(c)], "word binary, c long")
    for most in (1, 50, 700, 5000, 9000):
        got = sorted(r.c for r in hmm.frequent(words, most).collect())
        assert len(got) <= most and got == sorted(map(int, c))[5000 - len(got):]
        assert len(got) > 0.9 * min(most, 5000) or c.tolist().count(sorted(c)[-len(got) - 1]) > 1


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(0)
    k = 3
    emit = draw.random((hmm._CLASSES, k))
    model = hmm.Model(np.full(k, 1 / k), draw.dirichlet(np.ones(k), k), emit / emit.sum(axis=0))
    flat = np.array([5, 9, 5, 1, 2, 7], "<i2")
    got = hmm.forward(model, flat, np.array([0, 4]), np.array([4, 2]))
    from itertools import product

    for i, seq in enumerate((flat[:4], flat[4:])):
        total = 0.0
        for path in product(range(k), repeat=len(seq)):
            p = model.start[path[0]]
            for t, s in enumerate(path):
                p *= model.emit[seq[t], s] * (model.move[path[t - 1], s] if t else 1)
            total += p
        assert math.isclose(got[i], math.log(total))


def test_model_beats_single_words_on_held_out_texts(given):
    rows = hmm.score(given, rounds=3).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# 5


def removed(rows, window):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [1, 300])
def test_substrings(odd, none, odd_rows, monkeypatch, crowd):
    monkeypatch.setattr(substring, "CROWD", crowd)  # 1: all open anchors take the way of the crowded ones
    got = substring.dedup(odd).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(got.collect()) == removed(odd_rows, 35)
    assert substring.dedup(none).count() == 0
    left = substring.strip_repeats(odd)
    assert left.columns == odd.columns and left.where("text is null").count() == 2


def test_automaton_counts_places():
    a = substring.Automaton()
    for t in ([1, 2, 3, 4], [9, 2, 3, 4], [1, 2, 3, 5]):
        a.add(t, 1)
    a.finish()
    assert a.repeated([1, 2, 3, 4], 3) == 0b11
    assert a.repeated([9, 2, 3, 4], 3) == 0b10
    assert a.repeated([7, 2, 3, 5], 3) == 0


# 6


def test_rollup(spark, tmp_path):
    roll = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    schema = "source string, lang string, tokenizer string, kind string, n_tokens long, old_tokens long"

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    assert roll.totals().count() == 0
    first = batch(("a", "en", "t/1", "insert", 10, None), ("a", "en", "t/1", "insert", 5, None), (None, None, "t/1", "insert", None, None))
    assert roll.commit("1", first) and not roll.commit("1", first)
    roll.commit("2", batch(("a", "en", "t/1", "revise", 7, 10), ("b", "fr", "t/2", "insert", 3, None)))
    roll.compact()
    assert not roll.commit("2", first)
    roll.commit("3", batch(("b", "fr", "t/2", "delete", 3, None)))
    assert bag(roll.totals().collect()) == bag([("a", "en", "t/1", 2, 12), (None, None, "t/1", 1, 0)])
    with pytest.raises(Exception, match="unknown kind"):
        roll.commit("4", batch(("a", "en", "t/1", "replace", 1, None)))
    assert roll.totals().count() == 2


def test_ingest_is_the_sum_of_what_stays(spark, given, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1}
    want = defaultdict(lambda: [0, 0])
    import public_tokenizers
    import tiktoken

    ranks = {}
    import base64

    for line in open(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"):
        a, b = line.split()
        ranks[base64.b64decode(a)] = int(b)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in given.collect():
        if r.doc_id not in toxic:
            for name, n in (("words/1", len(SPACE.findall(r.text))), ("byte_bpe_50k/1", len(own.encode_ordinary(r.text)))):
                want[(r.source, r.lang, name)][0] += 1
                want[(r.source, r.lang, name)][1] += n
    got = token_rollup.ingest(given, labels).totals()
    assert bag(got.collect()) == bag((*k, *v) for k, v in want.items())


# 7


def test_rules(odd, none, odd_rows):
    want = Counter()
    for doc_id, text, *_ in odd_rows:
        words = SPACE.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(three)
        repeat = len({i + j for i, t in enumerate(three) if seen[t] > 1 for j in range(3)})
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        want[(doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed)] += 1
    got = robust_rules.judge(odd)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(got.select(*columns).collect()) == want
    assert got.where("base_failed and kept").count() == 0
    assert robust_rules.judge(none).count() == 0
    kept = robust_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == got.where("kept").count()


def test_outliers_go_and_the_rest_stays(spark, given, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = robust_rules.judge(given).where("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97
    assert 1.2 < robust_rules.consistency(0.75, 6) < 1.5


# 8


def test_main_text():
    page = (
        "<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='ad'>Buy now, buy now</div>"
        "<article><h1>Title &amp; more</h1><p>First   paragraph\nwith <b>bold</b> text &eacute;.<br><p>Second one."
        "<ul><li>a<li>b</ul><script>var t='</p>';</script></article><div id=comments><p>Great post</div>"
        "<footer>&copy; x</footer>"
    )
    assert html_density.main_text(page) == "Title & more\nFirst paragraph with bold text é.\nSecond one.\na\nb"
    assert html_density.main_text(None) == html_density.main_text("") == html_density.main_text("<p>") == ""
    assert html_density.main_text("just text") == "just text"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert html_density.main_text(deep) == "deep text"


LONG = " ".join(f"Sentence {i} of the story has some words in it." for i in range(12))


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><main><h1>T</h1><article><p>{LONG}</article><article><p>More {LONG}</article></main>", f"T\n{LONG}\nMore {LONG}"),
        (f"<body><main><h1>T</h1><p>Lead<article><p>{LONG}</article></main>", f"T\nLead\n{LONG}"),
        (f"<body><h1>T</h1><article><p>{LONG}</article><article><p>More {LONG}</article>", f"T\n{LONG}\nMore {LONG}"),
        (f"<body><article><div class='entry-header'><h1>T</h1></div><p>{LONG}</article>", f"T\n{LONG}"),
        (f"<body><article><div class='header'><h1>T</h1></div><p>{LONG}</article>", f"T\n{LONG}"),
        (f"<body><article><h1>T</h1><p>{LONG}<h2 id='related-work'>W</h2><p>w<section id='sharing-data'><p>s</section></article>", f"T\n{LONG}\nW\nw\ns"),
        (f"<body><article><h1>T</h1><p>{LONG}<div class='share'>S</div><div id=comments><p>c</div></article>", f"T\n{LONG}"),
        (f"<body><article><h1>T</h1><p>{LONG}<div class='comments-area'><p>c</div><aside>x</aside></article>", f"T\n{LONG}"),
        (f"<body><div id=nav><a href=x>Home</a></div><div><h2>T</h2><p>{LONG}<p>{LONG}</div><div class=sidebar-left>s</div>", f"T\n{LONG}\n{LONG}"),
        (f"<body><article><p title='a > b <i>'>{LONG}</article>", LONG),
        (f"<body><article><p>1 < 2 and a<b {LONG}</article>", f"1 < 2 and a<b {LONG}"),
    ],
)
def test_what_belongs_to_the_main_text(page, text):
    assert html_density.main_text(page) == text


def densities(root):
    """Composite densities by their definition, node by node."""

    def count(n, linked=False):
        linked = linked or n.tag == "a"
        c = [0, 0, 0, int(linked)]  # characters, tags below, those in links
        for p in () if n.tag in ("script", "style", "noscript", "template", "head") else n.parts:
            if isinstance(p, str):
                size = sum(not x.isspace() for x in p)
                c[0] += size
                c[2] += size * linked
            else:
                below = count(p, linked)
                c[0] += below[0]
                c[1] += below[1] + 1
                c[2] += below[2]
                c[3] += below[3]
        return c

    chars, _, links, _ = count(root)

    def density(n):
        c, t, lc, lt = count(n)
        if not c:
            return 0.0
        base = math.log(c * lc / max(1, c - lc) + links / max(1, chars) * c + math.e)
        ratio = c / max(1, lc) * max(1, t) / max(1, lt)
        return c / max(1, t) * math.log(max(1.0, ratio)) / max(math.log(base), 0.05)

    return density


def test_density_on_pages_without_an_article():
    draw = np.random.default_rng(4)

    def element(depth):
        kind = draw.choice(["div", "p", "section", "b", "a"] if depth else ["div"])
        inner = "".join(f"t{draw.integers(99)} " * int(draw.integers(0, 12)) if draw.random() < 0.5 or depth > 3 else element(depth + 1) for _ in range(4))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(60):
        root = html_density.parse(f"<html><body>{element(0)}{element(0)}</body></html>")
        html_density.measure(root)
        of = densities(root)
        nodes = html_density._walk(root)
        for n in nodes:
            if n.tag != "a" and not any(u.tag == "a" for u in ancestors(n)):
                assert math.isclose(n.density, of(n), rel_tol=1e-9, abs_tol=1e-12), n.tag
        # The subtree of the largest sum is taken, and nothing twice.
        roots = html_density.main_nodes(root)
        best = max((n for n in nodes if n.chars), key=lambda n: n.total, default=None)
        if best is not None and best.total > 0:
            assert any(r.total == best.total or r in ancestors(best) for r in roots)
        assert not any(r in ancestors(q) for r in roots for q in roots)


def ancestors(n):
    out = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


@pytest.mark.parametrize("page", ['<a title="x ' * 80_000, "<a " * 300_000, "<div class=x>" * 60_000 + "</b>" * 60_000, "<p><div>" * 60_000, "<!x" * 200_000])
def test_malformed_pages_take_linear_time(page):
    import time

    started = time.process_time()
    html_density.main_text(page + "end")
    assert time.process_time() - started < 8


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = spark.createDataFrame([(None, None, None), (5, "u", "")], pages.schema)
    rows = html_density.extract(pages.unionByName(more)).collect()
    assert len(rows) == pages.count() + 2 and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text for r in rows if r.url not in (None, "u"))
    assert html_density.extract(pages.limit(0)).count() == 0


# 9


def classes(rows):
    prints = []
    for r in rows:
        words = lower(r[1]).encode().split()
        parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(top(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))], [top(i) for i in range(len(rows))]


def test_near_duplicates(odd, none, odd_rows):
    rows = [r for r in odd_rows if r[0] != 1003] + [r for r in odd_rows if r[0] == 1003]
    want, roots = classes(rows)
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id")
    assert bag(got.collect()) == bag(want)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))


@pytest.mark.parametrize("segments,distance", [(3, 4), (2, 4), (5, 4)])
def test_links(spark, segments, distance):
    draw = np.random.default_rng(2)
    base = draw.integers(-(2**63), 2**63 - 1, 40)
    near = [int(x) ^ sum(1 << int(b) for b in set(draw.integers(0, 63, 4))) for x in base for _ in range(4)]
    values = sorted({int(x) for x in base} | set(near))
    mask = 2**64 - 1
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= distance}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, segments).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (150, 200), (50, 400)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100, 50: 50, 400: 50}


# 10


def shares(sizes, most=3.0):
    """Target words by source: what a source would get above ``most`` times its size is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weights = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in full]
        left, by = total - sum(full.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / by for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_shares_are_poured_until_none_is_above(spark):
    draw = np.random.default_rng(6)
    for n in (1, 4, 300):
        sizes = {f"s{i:03d}": int(draw.zipf(1.3) % 100_000) for i in range(n)}
        order = sorted(sizes)
        rows = [(s, sizes[s], float(i % 3 + 1)) for i, s in enumerate(order)]
        got = curriculum.shares(spark.createDataFrame(rows, "source string, size long, weight double"))
        assert {r.source: r.target for r in got.collect()} == pytest.approx(shares(sizes))


def test_sources_may_be_as_many_as_documents(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', int(id % 9)) AS text", "concat('s', id) AS source", "'en' AS lang")
    rows = curriculum.plan(docs).select("taken", "size").collect()
    assert len(rows) == 20_000 and all(r.taken <= 3 * r.size for r in rows)


def test_mix(odd, none, odd_rows):
    rows = curriculum.plan(odd).collect()
    size = Counter()
    for r in odd_rows:
        size[r[3]] += len(SPACE.findall(r[1] or ""))
    target = shares(size)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == target[r.source] and r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    key = lambda rs: Counter(json.dumps([r.doc_id, r.source, r.taken, r.positions]) for r in rs)
    assert key(rows) == key(curriculum.plan(odd.repartition(5)).collect())
    mixed = curriculum.mix(odd)
    assert mixed.columns == [*odd.columns, "copy", "position_"]
    assert mixed.count() == sum(r.copies for r in rows)
    assert curriculum.plan(none).count() == 0 and curriculum.mix(none).count() == 0


def test_mix_tells_rows_of_two_sources_with_equal_keys_apart(spark):
    rows = [(i, f"w{i} " * (3 + i % 5), "en", s, 9) for i in range(40) for s in ("s0", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({(r.doc_id, r.source): r.copies for r in curriculum.plan(docs).collect() if r.copies})
    assert len({n for n in want.values()}) > 1
    assert Counter((r.doc_id, r.source) for r in curriculum.mix(docs).collect()) == want
