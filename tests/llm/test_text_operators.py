"""Operators that read each text by itself, against the libraries and plain code."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import op05_pii as op5
from graphloom.llm import op06_token_counts as op6
from graphloom.llm import op07_language_id as op7
from graphloom.llm import op08_quality_classifier as op8
from graphloom.llm import op09_packing as op9
from graphloom.llm import op10_quality_rules as op10

P = pytest.importorskip("public_tokenizers")
TABLE = "/root/testdata/sf0.01/documents.parquet"
ODD = ["", " ", "  a  b ", "\n\n x\n y", "▁▁a ▁b", "<s> </s> <unk> <0x41> hi", "日本語 ñ é́ 𝕏  \t tab", "I'LL don't 's 12345 !!!??", "<|endoftext|> x", "İstanbul ΣΑΣ ẞ", "\x00a\x1c b\x85c", "a" * 5000]


def texts():
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("ab ▁\n\t'sé1!<>|İΣ́​\U0001f600 ") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    return pq.read_table(TABLE).column("text").to_pylist()[:200] + ODD + noise


def test_token_counts_equal_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [len(ids) for ids in model.encode(texts(), num_threads=1)]
    assert op6.count_tokens(texts(), path) == want
    both = [n for i in range(0, len(texts()), 7) for n in op6.count_tokens(texts()[i : i + 7], path, 4000)]
    assert both == want


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    assert op9.encode(texts(), path) == want
    assert op9.encode(texts(), path, 1000, 500) == want
    both = [x for i in range(0, len(texts()), 7) for x in op9.encode(texts()[i : i + 7], path, 20_000, 9_000)]
    assert both == want


def test_pieces_rebuild_documents(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.read.parquet(TABLE)
    rows = op9.packed_sequences(docs, path).collect()
    ids = {r.doc_id: b + np.array([2], "<u4").tobytes() for r, b in zip(docs.collect(), op9.encode([r.text for r in docs.collect()], path), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
    for groups, whole in ((by_doc, lambda d, n: n == len(ids[d]) // 4), (by_sequence, lambda s, n: n == 4096 or n & (n - 1) == 0)):
        for key, parts in groups.items():
            end = 0
            for start, n in sorted(parts):
                assert start == end
                end += n
            assert whole(key, end)
    assert set(by_doc) == set(ids)


def test_costs_are_balanced():
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 3000) for _ in range(3000)]
    costs = defaultdict(float)
    for _, _, n, s, _ in op9.pack(lengths):
        costs[s] += op9.cost(n)
    full = sorted(costs.values())[20:]
    assert max(full) <= 1.6 * (sum(full) / len(full))


def plain_pack(lengths, capacity):
    """The rule of packing by looking at every sequence."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(12, -1, -1) if total % capacity >> b & 1]
    used, costs, out, whole, rests = [0] * len(sizes), [0.0] * len(sizes), [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, whole, 0))
            used[whole] = capacity
            whole += 1
        if n % capacity:
            rests.append((-(n % capacity), d, n - n % capacity))
    for minus, d, start in sorted(rests):
        left = -minus
        while left:
            room = [(costs[s], sizes[s] - used[s], s) for s in range(whole, len(sizes)) if sizes[s] - used[s] >= left]
            most = max(sizes[s] - used[s] for s in range(whole, len(sizes)))
            s = min(room or [(costs[s], most, s) for s in range(whole, len(sizes)) if sizes[s] - used[s] == most])[-1]
            n = min(left, sizes[s] - used[s])
            out.append((d, start, n, s, used[s]))
            used[s] += n
            costs[s] += op9.cost(n)
            start, left = start + n, left - n
    return out


def test_documents_are_cut_only_where_no_sequence_has_room():
    rnd = random.Random(8)
    for lengths in ([rnd.randint(1, 4096) for _ in range(400)], [rnd.choice([1, 7, 7, 300, 4096, 9000]) for _ in range(300)], [5], []):
        assert sorted(op9.pack(lengths)) == sorted(plain_pack(lengths, op9.CAPACITY))


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, rule in RULES.items():
        out[kind] = []
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out[kind].append(m.span())
    return out


def test_plain_spans_equal_the_rules():
    rnd = random.Random(3)
    for _ in range(20000):
        text = "".join(rnd.choice("a.@1 -+(2.%@9.0é\n4") for _ in range(rnd.randint(0, 40)))
        assert op5.detect(text) == plain(text), text
    for text in pq.read_table(TABLE).column("text").to_pylist():
        assert op5.find(text)[0] == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("write j.doe at mail.example.com ok", "email", "j.doe at mail.example.com"),
        ("x ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ y", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("so jоhn@exаmple.com здравствуйте", "email", "jоhn@exаmple.com"),
        ("call plus one five five five two three four five six seven eight now", "phone", "plus one five five five two three four five six seven eight"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("ip 192 dot 168 dot 1 dot 20.", "ip", "192 dot 168 dot 1 dot 20"),
        ("ip 192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
    ],
)
def test_disguises_map_back(text, kind, found):
    base, added = op5.find(text)
    assert [text[a:b] for a, b in added[kind]] == [found]
    assert not base[kind]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john dot smith at gmail dot com now", "john dot smith at gmail dot com"),
        ("mail john dot smith at gmail.com now", "john dot smith at gmail.com"),
        ("mail jane at acme.ch.", "jane at acme.ch"),
        ("mail jane at mail.acme.it, or", "jane at mail.acme.it"),
        ("mail jane at acme.museum", "jane at acme.museum"),
        ("MAIL JANE AT ACME.NL", "JANE AT ACME.NL"),
    ],
)
def test_bare_at_takes_local_dots_and_every_top_level_name(text, found):
    base, added = op5.find(text)
    assert [text[a:b] for a, b in added["email"]] == [found] and not base["email"]


@pytest.mark.parametrize("text", ["he was at home.It rained", "look at a.b1 and at that.thing", "she is at work.So am I"])
def test_bare_at_before_missing_blanks_is_prose(text):
    base, added = op5.find(text)
    assert not any(base.values()) and not any(added.values())


@pytest.mark.parametrize("text", ["look at that. It is at dot", "the at that.\nIn dot", "five six seven apples", "m² and 10³", "at the point of no return"])
def test_prose_has_no_personal_data(text):
    base, added = op5.find(text)
    assert not any(base.values()) and not any(added.values())


@pytest.mark.parametrize(
    ("text", "kind", "base_found", "found"),
    [
        ("jοhn@example.com", "email", "hn@example.com", "jοhn@example.com"),
        ("mail x@b.de at noon dot", "email", "x@b.de", None),
        ("ip 10.0.0.1 and 1０.0.0.12.", "ip", "10.0.0.1", "1０.0.0.12"),
    ],
)
def test_wider_spans_stand_beside_plain_ones(text, kind, base_found, found):
    base, added = op5.find(text)
    assert base_found in [text[a:b] for a, b in base[kind]]
    assert [text[a:b] for a, b in added[kind]] == ([found] if found else [])
    assert all(not (x <= a and b <= y) for a, b in added[kind] for x, y in base[kind])


def test_local_part_has_no_limit():
    text = "write " + " dot ".join(["part"] * 400) + " at gmail dot com"
    _, added = op5.find(text)
    assert [text[a:b] for a, b in added["email"]] == [text[6:]]


@pytest.mark.parametrize("unit", ["1", "1.", "@", "a@", "a.", " at a", "+1 ", "one ", "1 ", "  ", "a@b.c ", "1.2.3.4 ", "(", " dot a", "é", "０", "a [at] b [dot] c "])
def test_personal_data_is_linear_in_the_text(unit):
    def seconds(n):
        text = "a@b.cd 1.2.3.4 one two three. " + unit * (n // len(unit)) + " x at y dot com"
        began = time.process_time()
        op5.find(text)
        return time.process_time() - began

    small, large = seconds(40_000), seconds(400_000)
    assert large < 30 * max(small, 0.02)


def test_personal_data_digest(spark):
    row = op5.personal_data(spark.createDataFrame([(1, "é a@b.cd and x [at] y [dot] zz")], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert row.spans == "email:2:8,email:13:30" and row.n_email == 2


def test_language_spans(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog and then it rests " * 3, "en") for i in range(8)]
    rows += [(10 + i, "der schnelle braune fuchs springt über den faulen hund und dann ruht er ", "de") for i in range(8)]
    rows += [(20 + i, "быстрая бурая лиса прыгает через ленивую собаку ", "ru") for i in range(8)]
    model = op7.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "the lazy dog jumps over the quick fox and rests. der faule hund springt über den braunen fuchs. лиса прыгает."
    row = op7.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [mixed[s.start : s.end].split()[0] + ":" + s.lang for s in row.spans] == ["the:en", "der:de", "лиса:ru"]


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 30, 60)
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 4, (at[-1], 3))
    got = op7.viterbi(scores, at, 5.0)

    def value(own, path):
        return own[np.arange(len(path)), path].sum() - 5.0 * (np.diff(path) != 0).sum()

    for a, b in zip(at[:-1], at[1:], strict=True):
        own = scores[a:b]
        if not len(own):
            continue
        best = own[0].copy()
        for s in own[1:]:
            best = np.maximum(best, best.max() - 5.0) + s
        assert np.isclose(value(own, got[a:b]), best.max())


def test_marks_alone_are_no_language(spark):
    model = op7.train(spark.createDataFrame([(1, "das ist ein satz", "de")], "doc_id long, text string, lang string"))
    texts = ["\u0301\u0302", "12 \u0301", "a\u0301", None, "", "!"]
    rows = op7.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)] == ["und", "und", "de", "und", "und", "und"]
    assert all(r.score == 0 and not r.spans for r in rows if r.lang_pred == "und")


def test_languages_are_found_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op7.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for w in windows.values() if len(w) > 1 for i in w for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_features_equal_plain_code():
    rnd = random.Random(9)
    sample = texts() + [" ".join(rnd.choice("abc") for _ in range(60)) + "\nx\n x\nx\n\n" for _ in range(50)]
    found = op10.text_features(pa.array(sample))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, text in enumerate(sample):
        assert tuple(int(found[n][i]) for n in names) == plain_features(text), text


def test_letters_are_letters():
    sample = ["aé—中🙂1", "", "。、！…", "Straße 12 日本", None, "\U00020000x́"]
    assert op10.text_features(pa.array(sample))["n_letters"].tolist() == [sum(c.isalpha() for c in t or "") for t in sample]


def test_accuracies_of_known_voters_come_back():
    """Good texts and two kinds of junk; each voter abstains on its own, and some good texts get bad votes."""
    rng = np.random.default_rng(3)
    n, share = 60_000, np.array([0.85, 0.1, 0.05])
    alarm = np.array([[0.01, 0.95, 0.02], [0.03, 0.9, 0.05], [0.02, 0.03, 0.9], [0.01, 0.05, 0.85], [0.2, 0.3, 0.25]])
    kind = rng.choice(3, n, p=share)
    votes = np.where(rng.random((n, 5)) < alarm[:, kind].T, -1, 1) * (rng.random((n, 5)) < [0.9, 0.7, 0.8, 0.9, 0.5])
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    prior, bad = op10.estimate([(tuple(map(int, v)), int(c)) for v, c in zip(seen, counts, strict=True)], 5)
    assert abs(prior[0] - 0.85) < 0.02
    assert np.abs(bad[:4, 0] - alarm[:4, 0]).max() < 0.01 and abs(bad[4, 0] - 0.2) < 0.02
    kept = op10.class_posteriors(votes, prior, bad)[:, 0] >= 0.5
    assert (kept == (kind == 0)).mean() > 0.96
    assert (kept & (votes.min(axis=1) < 0)).mean() > 0.05  # one bad vote is no veto


def test_rules_keep_clean_and_drop_junk(spark):
    sf = "/root/testdata/sf0.01"
    out = op10.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98
    assert out[out.quality == 0].kept.mean() < 0.05
    every = op10.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))
    worst = F.least(*[c for c in every.columns if c.startswith("vote_")])
    assert every.where("kept").where(worst < 0).count() > 0


def plain_em(rows, n_rules):
    """Priors and chances of a bad vote by EM over rows one by one, classes dropped by the same criterion; plain numbers and loops."""

    def chance(row, prior, bad, c):
        p = prior[c]
        for r, v in enumerate(row):
            p *= bad[r][c] if v < 0 else 1 - bad[r][c] if v > 0 else 1
        return p

    def fitted(prior, bad):
        for _ in range(op10.EM_ROUNDS):
            total, failed, passed = [1.0] * len(prior), [[1.0] * len(prior) for _ in bad], [[1.0] * len(prior) for _ in bad]
            for row, k in rows.items():
                p = [chance(row, prior, bad, c) for c in range(len(prior))]
                for c, x in enumerate(p):
                    share = k * x / sum(p)
                    total[c] += share
                    for r, v in enumerate(row):
                        if v:
                            (failed if v < 0 else passed)[r][c] += share
            was, prior = prior, [t / sum(total) for t in total]
            bad = [[f / (f + g) for f, g in zip(fs, gs, strict=True)] for fs, gs in zip(failed, passed, strict=True)]
            if max(abs(a - b) for a, b in zip(prior, was, strict=True)) < op10.EM_CHANGE:
                break
        return prior, bad, sum(k * math.log(sum(chance(row, prior, bad, c) for c in range(len(prior)))) for row, k in rows.items())

    prior = [0.8] + [0.2 / n_rules] * n_rules
    state = fitted(prior, [[0.02] + [0.8 if c == r else 0.1 for c in range(n_rules)] for r in range(n_rules)])
    worth = (n_rules + 1) / 2 * math.log(sum(rows.values()) + 1)
    going = True
    while len(state[0]) > 2 and going:
        going = False
        for c in sorted(range(1, len(state[0])), key=lambda c: state[0][c]):
            rest = [p / (1 - state[0][c]) for i, p in enumerate(state[0]) if i != c]
            less = fitted(rest, [[x for i, x in enumerate(b) if i != c] for b in state[1]])
            if less[2] >= state[2] - worth:
                state, going = less, True
                break
    prior, bad, _ = state
    return {row: chance(row, prior, bad, 0) / sum(chance(row, prior, bad, c) for c in range(len(prior))) for row in rows}


def test_verdicts_equal_plain_em(spark, monkeypatch):
    """kept of the rules and posteriors of the labellers, from votes to verdict."""
    monkeypatch.setattr(op10, "EM_ROUNDS", 40)
    monkeypatch.setattr(op10.estimate, "__defaults__", (40,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = op10.quality_rules(docs).collect()
    names = [f"vote_{k}" for k in op10.rules()]
    votes = {r.doc_id: tuple(r[v] for v in names) for r in rows}
    want = plain_em(Counter(votes.values()), len(names))
    for r in rows:
        assert abs(r.posterior - want[votes[r.doc_id]]) < 1e-6
        assert r.kept == (not r.base_failed and want[votes[r.doc_id]] >= op10.KEEP_FROM)
    named = op10.rules(op8.MIN_WORDS)
    other = {r.doc_id: tuple(r[k] for k in named) for r in op10.features(docs).select("doc_id", *(v.cast("int").alias(k) for k, v in named.items())).collect()}
    want = plain_em(Counter(other.values()), len(named))
    for r in op8.labelled(docs)[0].collect():
        assert abs(r.posterior - want[other[r.doc_id]]) < 1e-6
