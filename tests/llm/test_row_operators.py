"""Mixing, the manifest and vector codes against brute force, and on odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from helpers import empty_docs, odd_docs, prose
from pyspark.sql import functions as F

from graphloom.llm import op11_mixing as op11
from graphloom.llm import op12_merkle_manifest as op12
from graphloom.llm import op13_vector_codes as op13

DOC = "doc_id long, source string, lang string, n_chars long, text string, target double, pos long"


def words(n):
    return " ".join(["w"] * n)


# Mixing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing until none is above: the contract, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / w > most * sizes[s]]
        if not over:
            return target | {s: total * weight[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_the_excess(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 3, 50, 700, 9000]) for s in ["", "a", "b", "é", "z", None][: rnd.randint(1, 6)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op11.targets(df).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def mix_docs(spark, seed, n=600):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", None, "hot", "hot", "hot"]), words(min(400, int(rnd.paretovariate(0.9))))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("fan", [2, 7, 64])
def test_mix_comes_near_its_targets(spark, fan):
    rows = op11.mixture(mix_docs(spark, 5), fan=fan).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        ratio = own[0].target / own[0].source_size
        assert {r.copies for r in own} <= {math.floor(ratio), math.ceil(ratio)} and all(r.taken == r.copies * r.size <= 2 * r.size for r in own)


def test_mix_is_the_same_however_rows_are_dealt(spark):
    docs = mix_docs(spark, 6)
    a, b = (sorted(op11.mixture(d).collect(), key=lambda r: r.doc_id) for d in (docs.repartition(1), docs.repartition(7)))
    assert a == b


def test_expected_copies_are_the_ratio(spark, monkeypatch):
    """Over many seeds a document is taken as often as its source's ratio says, be it large or small."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], words(n)) for i, n in enumerate([30, 200, 10, 10, 40, 20, 5, 60, 25, 80])], "doc_id long, source string, text string")
    total, runs = dict.fromkeys(range(10), 0), 25
    ratio = {}
    for seed in range(runs):
        monkeypatch.setattr(op11, "SEED", f"s{seed}")
        for r in op11.mixture(docs, fan=3).collect():
            total[r.doc_id] += r.copies
            ratio[r.doc_id] = r.target / r.source_size
    for i, n in total.items():
        assert abs(n / runs - ratio[i]) < 4 * 0.5 / math.sqrt(runs), i


def test_repeated_rows_share_what_they_are_taken(spark):
    rows = [(None, None, words(7))] * 200 + [(1, "a", words(5))] * 50 + [(i, "a", words(i)) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = op11.mixture(docs, run=16)
    got = plan.collect()
    assert len(got) == len(rows)
    same = [r.copies for r in got if r.doc_id is None]
    assert len(same) == 200 and max(same) - min(same) <= 1
    mixed = op11.mixed_documents(docs.withColumn("copies", F.lit("x")), plan)
    assert mixed.columns == [*docs.columns, "copies"]
    unique = {r.doc_id: r.copies for r in got if (r.doc_id or 0) > 1}
    counts = {r.doc_id: r["count"] for r in mixed.where("doc_id > 1").groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in unique.items() if v}


def test_mixing_takes_odd_rows(spark):
    rows = op11.mixture(odd_docs(spark)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    assert {r.doc_id: r.size for r in rows} | {0: 60} == {0: 60, 1: 0, 2: 0, 3: 60, 4: 2, 5: 0, 6: 9000, 7: 32, 8: 1}
    assert op11.mixture(empty_docs(spark)).count() == 0
    no_words = op11.mixture(odd_docs(spark).where("doc_id in (1, 2, 5)")).collect()
    assert [(r.taken, r.target) for r in no_words] == [(0, 0.0)] * 3


def test_sizes_are_words_between_ascii_blanks(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0cd\re\nf ", "a\xa0b", "\x1ca \x85 b", "x" * 3_000_000, "yy " * 500_000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(op11.text_size(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 6, 1, 3, 1, 500_000]


# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes, at):
    """Root of nodes, and the siblings of node ``at`` as (before, after) by level."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        k = at % 16
        path.append(("".join(runs[at // 16][:k]), "".join(runs[at // 16][k + 1 :])))
        nodes, at = [H(*r) for r in runs], at // 16
    return nodes[0], path


def by_hand(docs):
    rows = []
    for r in docs.collect():
        lower = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        head = "".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars)))
        rows.append((r.source, r.doc_id, H(head + enc(r.text)), H(head + enc(lower if tampered else r.text))))
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in sources}
    subroots = [up([r[2] for r in leaves[s]], 0)[0] for s in sources]
    out = []
    for k, s in enumerate(sources):
        for i, (_, doc_id, leaf, copy) in enumerate(leaves[s]):
            path = up([r[2] for r in leaves[s]], i)[1] + up(subroots, k)[1]
            root, node = up(subroots, k)[0], copy
            for before, after in path:
                node = H(before, node, after)
            out.append((doc_id, leaf, subroots[k], root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(map(str, out))


def manifest(docs, **more):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return op12.manifest(docs, {"text": F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}, **more)


def leaf_docs(spark, sizes):
    rows = [(i, s, "en", i, f"Text {i} É" if i % 7 else None, 1.0, 5) for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.mark.parametrize(
    "sizes, deep, most_top",
    [
        ({None: 1}, 3, 100),
        ({"a": 17}, 3, 100),
        ({None: 16, "a": 257, "é": 1}, 1, 100),
        ({f"s{i:02}": 1 + i % 4 for i in range(40)} | {"z": 300}, 1, 3),
        ({"a": 700, "b": 5}, 1, 2),
        ({"a": 600, None: 33}, 2, 1),
    ],
)
def test_manifest_equals_brute_force(spark, sizes, deep, most_top):
    docs = leaf_docs(spark, sizes)
    got = manifest(docs, deep=deep, most_top=most_top).collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(docs)


def test_manifest_takes_odd_rows(spark):
    docs = odd_docs(spark).union(odd_docs(spark).where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = manifest(docs).collect()
    assert len(got) == 11 and sorted(str(tuple(r)) for r in got) == by_hand(docs)
    assert manifest(empty_docs(spark)).count() == 0
    assert all(r.verified for r in op12.manifest(docs).collect())
    long = spark.createDataFrame([(0, "a", None, None, "É" * 3_000_000), (0, "a", None, None, "É" * 3_000_000)], "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(str(tuple(r)) for r in manifest(long).collect()) == by_hand(long)


def test_many_equal_rows_are_ranked_apart(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "same")] * 900 + [(i, "b", "en", 1, "x") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = op12.ranked(docs.repartition(8), "source", ["doc_id", "text"])
        got = rows.select("source", "pos", "n", "grp").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == [("a", i, 900, 0) for i in range(900)] + [("b", i, 100, 1) for i in range(100)]
    assert sorted(str(tuple(r)) for r in manifest(docs).collect()) == by_hand(docs)


# Vector codes


def lloyd(vectors, rounds=op13.ROUNDS):
    """Codes, errors and books by full search; vectors in order of id."""
    v = np.array(vectors, np.int64)
    parts = np.split(v, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def nearest(p, b):
        return ((p[:, None] - b[None]) ** 2).sum(2)

    for _ in range(rounds):
        for p, b in zip(parts, books, strict=True):
            code = nearest(p, b).argmin(1)
            for c in set(code.tolist()):
                own = p[code == c]
                b[c] = own.sum(0) // len(own)
    d = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    return ["".join(f"{x.argmin(1)[i]:02x}" for x in d) for i in range(len(v))], sum(x.min(1) for x in d).tolist(), books


@pytest.mark.parametrize("seed, n, spread, width", [(0, 700, 1.0, 16), (1, 400, 0.004, 8), (2, 30, 3.0, 4), (3, 600, 90.0, 8)])
def test_codes_equal_full_search(spark, seed, n, spread, width):
    rnd = np.random.default_rng(seed)
    x = (rnd.normal(size=(n, width)) * spread).astype(np.float32)
    x[n // 2 :: 5] = x[0]  # ties and a common vector
    ids = rnd.permutation(n)
    rows = [(int(i), [float(e) for e in x[i]], int(i) % 3 if i % 4 else None) for i in ids]
    df, books = op13.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    codes, errors, want = lloyd(np.floor(x.astype(np.float64) * 1024))
    got = sorted(df.collect(), key=lambda r: r.vec_id)
    assert [r.code for r in got] == codes and [r.error for r in got] == errors
    assert all((a == b).all() for a, b in zip(books, want, strict=True))
    by_label = {}
    for i, e in enumerate(errors):
        by_label[i % 3 if i % 4 else None] = by_label.get(i % 3 if i % 4 else None, 0) + e
    assert all(r.label_error == by_label[r.label] for r in got)
    text = ",".join(str(e) for b in want for e in b.ravel().tolist())
    assert {r.codebooks_sha256 for r in got} == {H(text)}
    near = op13.decoded(df, books).where("vec_id = 0").first()
    assert [round(e * 1024) for e in near.approximate] == [int(e) for p, b in enumerate(books) for e in b[int(near.code[2 * p : 2 * p + 2], 16)]]


def test_bounds_spare_distances():
    rnd = np.random.default_rng(4)
    rows = np.floor(rnd.normal(size=(3000, 16)) * 100 + 1000 * rnd.integers(0, 40, (3000, 1))).astype(np.int64)
    books = rows[:256].copy()
    state, full, pruned = None, 0, 0
    for r in range(5):
        search = op13.Search(books, None if r == 0 else before)
        state = search.first(rows) if r == 0 else search.again(rows, *state)
        squares = op13.all_squares(rows, books)
        assert (state[0] == squares.argmin(1)).all()
        assert (state[1] ** 2 >= squares.min(1)).all() and (state[2].astype(np.int64) ** 2 <= squares).all()
        full, pruned = full + squares.size, pruned + search.looked_at
        before, books = books, np.array([rows[state[0] == c].sum(0) // (state[0] == c).sum() if (state[0] == c).any() else books[c] for c in range(256)])
    assert pruned < 0.4 * full


def test_vector_codes_take_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, -0.2, 0.3, 1.0], 1, "x", "y") for i in range(5)]
    bad = [(10, None, 1, "x", "y"), (11, [0.1, None, 0.0, 0.0], 1, "x", "y"), (12, [nan, 0.0, 0.0, 0.0], None, "x", "y"), (13, [0.0, inf, 0.0, 0.0], None, "x", "y"), (14, [], 1, "x", "y"), (15, [1.0], 1, "x", "y")]
    odd = [(3, [0.3, -0.2, 0.3, 1.0], None, "x", "y"), (None, [0.5, 0.5, 0.5, 0.5], 2, "x", "y")]
    df = spark.createDataFrame(good + bad + odd, "vec_id long, embedding array<double>, label int, code string, upper string")
    rows, books = op13.vector_codes(df)
    got = rows.collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == [-1, 0, 1, 2, 3, 3, 4]
    assert all(r.error == 0 for r in got) and len(books[0]) == 7
    assert op13.vector_codes(df.limit(0))[0].count() == 0 and op13.vector_codes(df.where("embedding is null"))[0].count() == 0
    with pytest.raises(ValueError):
        op13.vector_codes(spark.createDataFrame([(0, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int"))


def test_very_long_texts_are_mixed(spark):
    docs = spark.createDataFrame([(0, "a", prose(0, 20) * 20_000), (1, "a", "b c"), (2, "b", None)], "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in op11.mixture(docs).collect()}
    assert rows[0].taken in (rows[0].size, 2 * rows[0].size) and rows[2].taken == 0
