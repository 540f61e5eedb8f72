"""Operators across documents, against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import prose

from graphloom.llm import op01_substring_dedup as op1
from graphloom.llm import op02_minhash_dedup as op2
from graphloom.llm import op03_decontaminate as op3
from graphloom.llm import op04_line_dedup as op4
from graphloom.llm import op08_quality_classifier as op8
from graphloom.llm.bwt import repeated_starts
from graphloom.llm.components import connected_components
from graphloom.llm.dartminhash import signatures
from graphloom.llm.textops import mix


def test_bwt_expansion_finds_all_repeats():
    rnd = random.Random(5)
    for _ in range(400):
        n = rnd.choice([1, 2, 3, 5, 8])
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 8))]
        strings.append(strings[0][2:20] + b"x")
        counts = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if counts[s[i : i + n]] > 1] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, n)] == want


def plain_removal(rows, n):
    counts = Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
    out = []
    for doc, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"max_together": 2}, {"max_run": 50, "batch_bytes": 1000}])
def test_substring_removal_is_exact(spark, options):
    rnd = random.Random(2)
    p = "".join(rnd.choice("abcd ") for _ in range(150))
    rows = [(0, None), (1, ""), (2, "a" * 500), (3, "a" * 300), (4, "ab" * 200), (5, p), (6, "zz" + p + "é" * 30), (7, p[:60] + "x" + p[60:]), (8, p), (8, p + "q"), (9, p * 4), (10, "é" * 100)]
    rows += [(20 + i, "".join(rnd.choice("xyz") for _ in range(40)) + p + "".join(rnd.choice("uvw") for _ in range(40))) for i in range(30)]
    found = op1.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=8, **options)
    assert sorted(tuple(r)[:5] for r in found.collect()) == plain_removal([(d, (t or "").encode()) for d, t in rows], 40)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for t in range(30):
        keys = mix(np.arange(t * 1000, t * 1000 + 150, dtype=np.uint64))
        a = rng.exponential(2, 150)
        b = a * rng.uniform(0.3, 1.4, 150) * (rng.random(150) < 0.9)
        some = b > 0
        s = signatures(np.repeat([0, 1], [150, some.sum()]), np.concatenate([keys, keys[some]]), np.concatenate([a, b[some]]), 2, 256)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.06


def plain_classes(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else None
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, text = sorted(sets), dict(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            same = len(x & y) >= 0.8 * len(x | y) if x and y else (x is y is None and text[a] is not None and text[a] == text[b])
            if same:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(7)
    rows, n = [(0, None), (1, ""), (2, ""), (3, "!?"), (4, "one two"), (5, "One, two."), (6, None)], 10
    for g in range(12):
        base = prose(g, 80).split()
        for _ in range(rnd.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"w{rnd.random()}"
            rows.append((n, " ".join(words)))
            n += 1
    found = {r.doc_id: r.class_id for r in op2.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_classes(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 90)]
    found = {r.id: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k for k, v in found.items() if v == 1} == {*range(1, 41), 90} and {k for k, v in found.items() if v == 100} == {100, 101, 102}


def plain_leaks(rows, items):
    words_of = lambda t: re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", t.lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    texts = [(d, words_of(t or "")) for d, t in rows]
    found = set()
    for i, item in items:
        parts = [words_of(p) for p in op3.question_and_answer(item)]
        wanted = [(min(5, len(w)), grams(w, min(5, len(w)))) for w in parts]
        for d, w in texts:
            if all(k and len(g & grams(w, k)) >= 0.8 * len(g) for k, g in wanted):
                found.add((d, i))
    return found


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_leaks_equal_brute_force(spark, part_bytes):
    items = [(i, prose(100 + i, 20 + i).capitalize() + ". " + prose(200 + i, 4).capitalize() + ".") for i in range(12)]
    rows = []
    for d in range(40):
        words = [prose(300 + d, 150)]
        if d % 3 == 0:
            words.append(items[d % 12][1])
        if d % 5 == 0:
            words.append(items[d % 12][1].split(". ")[0])  # a question without its answer
        rows.append((d, " ".join([*words, prose(400 + d, 90)])))
    want = plain_leaks(rows, items)
    found = op3.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want


@pytest.mark.parametrize("seed", range(3))
def test_scattered_leaks_equal_brute_force(spark, seed):
    """Items of several sentences whose pieces stand far apart, with words changed and shingles missing."""
    rnd = random.Random(seed)
    items = []
    for i in range(20):
        sentences = [prose(1000 * seed + 10 * i + k, rnd.choice([2, 4, 7, 15])).capitalize() + "." for k in range(rnd.randint(1, 5))]
        items.append((i, " ".join(sentences)))
    items += [(20, "The the the the the the the. The the the the the the."), (21, "One two three one two three one two three one two. Four."), (22, "!? ..")]
    rows = [(0, prose(5, 400).join(s + ". " for s in items[3][1].split(". ")))]
    for d in range(1, 150):
        words = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "changed"
        pieces, at = [prose(d, 30)], 0
        while at < len(words):
            n = rnd.choice([4, 9, 30])
            pieces += [" ".join(words[at : at + n]), prose(7000 + d, rnd.choice([0, 0, 250]))]
            at += n
        rows.append((d, " ".join(pieces)))
    want = plain_leaks(rows, items)
    found = op3.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 20


def test_texts_without_doc_id_are_texts(spark):
    p, q = prose(1, 100), prose(2, 100)
    rows = [(None, p), (None, p), (1, q), (None, "x" + q), (None, prose(3, 100)), (None, None)]
    found = op1.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in found)
    assert got == sorted([(True, len(p), len(p))] * 2 + [(False, len(q), len(q)), (True, len(q) + 1, len(q)), (True, len(prose(3, 100)), 0), (True, 0, 0)])


def test_recurring_lines_go_from_all_but_the_first(spark):
    notice = "Page {} of the archive, updated daily by the editors of this site, see the terms."
    rows = [(d, f"{prose(d, 12)}\n{notice.format(d)}\n\n{prose(50 + d, 12)}") for d in range(6)] + [(20 + d, prose(99, 30)) for d in range(7)] + [(40, None), (41, "")]
    found = {r.doc_id: r for r in op4.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].text == rows[0][1]
    for d in range(1, 6):
        assert found[d].text == f"{prose(d, 12)}\n\n{prose(50 + d, 12)}" and (found[d].n_lines, found[d].n_dropped) == (4, 1)
    assert all(found[20 + d].n_dropped == 0 for d in range(7))  # copies of one text are no template
    assert found[40].text is None and found[41].text == ""


def test_free_thirds_generalise(spark):
    line = "the shop at {} is open every day of the week from early morning to midnight"
    rows = [(d, prose(d, 12) + "\n" + line.format(" ".join(random.Random(d).choices("red blue green oak elm ash".split(), k=3)))) for d in range(8)]
    found = {r.doc_id: r.n_dropped for r in op4.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == 0 and all(found[d] == 1 for d in range(1, 8))


def test_short_lines_recur(spark):
    names = "Anna Bert Cleo Dora Emil Finn".split()
    short = lambda d: ["Les.", f"Page {d}", f"Posted by {names[d]} in News", "本网站版权所有未经许可不得转载", f"第{d}页共九页", "สงวนลิขสิทธิ์"]
    stay = lambda d: ["", f"{d} 12", " \t", f"{names[d]} is away"]
    rows = [(d, "\n".join([prose(d, 12), *short(d), *stay(d)])) for d in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in op4.drop_recurring_lines(docs).collect()}
    assert found[0].text == rows[0][1]
    for d in range(1, 6):
        assert found[d].text == "\n".join([prose(d, 12), *stay(d)]) and found[d].n_dropped == 6
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    kept = {r[0]: r[2] for r in con.sql(op4.ORACLE_SQL).fetchall()}
    assert kept == {d: r.n_dropped for d, r in found.items()}


def test_classifier_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = op8.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 1].is_good.mean() > 0.95
    assert out[out.quality == 0].is_good.mean() < 0.2


def test_each_stage_of_the_pipeline_equals_brute_force(spark):
    """Every stage on what the one before it kept: languages by label, lines by SQL, classes and leaks by all pairs, pieces by ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from graphloom.llm import op07_language_id as op7

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    columns = list(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        source = spark.createDataFrame(docs)
        out = stage(spark, source, sf).toPandas()
        if name == "packing":
            tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
            want = {d: len(e.ids) + 1 for d, e in zip(docs.doc_id, tokenizer.encode_batch([t or "" for t in docs.text], add_special_tokens=False), strict=True)}
            assert out.groupby("doc_id").length.sum().to_dict() == want
            continue
        assert list(out.columns) == columns
        kept = dict(zip(out.doc_id, out.text, strict=True))
        if name == "language_id":
            seen = {r.doc_id: r for r in op7.identify(source, op7.train(source)).collect()}
            assert set(kept) == {d for d, r in seen.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
            worded = {d for d, t in zip(docs.doc_id, docs.text, strict=True) if t and len(re.findall(r"[^\W\d_]+", t)) >= 5}
            assert len(worded & set(kept)) >= 0.99 * len(worded)
        elif name == "line_dedup":
            con = duckdb.connect()
            con.register("documents", docs)
            want = {r[0]: r[3] for r in con.sql(op4.ORACLE_SQL).fetchall()}
            assert {d: hashlib.md5(t.encode()).hexdigest() for d, t in kept.items()} == want
        elif name == "near_dedup":
            classes = plain_classes(list(zip(docs.doc_id, docs.text, strict=True)))
            assert set(kept) == {d for d, c in classes.items() if d == c} and len(kept) < len(docs)
        else:
            assert set(docs.doc_id) - set(kept) == {d for d, _ in plain_leaks(list(zip(docs.doc_id, docs.text, strict=True)), benchmark)}
        docs = out
