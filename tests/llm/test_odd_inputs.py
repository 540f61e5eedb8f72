"""Each operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from helpers import empty_docs, odd_docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import op01_substring_dedup as op1
from graphloom.llm import op02_minhash_dedup as op2
from graphloom.llm import op03_decontaminate as op3
from graphloom.llm import op04_line_dedup as op4
from graphloom.llm import op05_pii as op5
from graphloom.llm import op06_token_counts as op6
from graphloom.llm import op07_language_id as op7
from graphloom.llm import op08_quality_classifier as op8
from graphloom.llm import op09_packing as op9
from graphloom.llm import op10_quality_rules as op10
from graphloom.llm import op11_mixing as op11
from graphloom.llm import op12_merkle_manifest as op12

public_tokenizers = pytest.importorskip("public_tokenizers")


def benchmark(spark, n=1):
    return spark.createDataFrame([(0, "one two three four five six seven. Eight nine ten eleven twelve."), (1, None), (2, "")][: 3 * n], "item_id long, text string")


OPERATORS = {
    "op1": lambda d: op1.remove_repeats(d),
    "op2": lambda d: op2.near_duplicate_classes(d),
    "op4": lambda d: op4.drop_recurring_lines(d),
    "op5": lambda d: op5.personal_data(d),
    "op6": lambda d: op6.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op7": lambda d: op7.identify(d, op7.train(d)),
    "op8": lambda d: op8.quality_scores(d, op8.fit(d, op8.labelled(d)[0])),
    "op10": lambda d: op10.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_per_row(spark, name):
    docs = odd_docs(spark)
    rows = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    assert OPERATORS[name](empty_docs(spark)).count() == 0


LONG = (prose(9, 300) + "\n") * 700


def rows_without_ids(spark):
    """Null and tied ids, texts of megabytes, and columns with the names operators use inside."""
    texts = [(None, prose(0, 60)), (None, prose(0, 60)), (None, prose(1, 60)), (None, None), (1, prose(0, 60)), (2, LONG), (3, "x" * 2_000_000), (4, "\n" * 1_000_000), (5, "tie"), (5, "tie")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    inner = ("__lost", "__id", "__kept", "n_lines", "n_dropped", "body", "own_id", "runs", "key", "size", "copies", "digest", "grp", "pos")
    return docs.select("*", *(F.lit(7).alias(c) for c in inner))


@pytest.mark.parametrize("name", [*OPERATORS, "op11", "op12"])
def test_null_ids_long_texts_and_inner_names(spark, name):
    of = {**OPERATORS, "op11": op11.mixture, "op12": op12.manifest}[name]
    rows = of(rows_without_ids(spark)).select("doc_id").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, -1, -1, 1, 2, 3, 4, 5, 5]


def test_rows_without_ids_keep_their_meaning(spark):
    docs = rows_without_ids(spark)
    classes = op2.near_duplicate_classes(docs).collect()
    assert all(r.is_kept for r in classes if r.doc_id is None)
    lines = op4.drop_recurring_lines(docs)
    assert set(lines.columns) == set(docs.columns)
    assert {r.doc_id: r.n_lines for r in lines.where("doc_id in (2, 4)").collect()} == {2: 701, 4: 1_000_001}
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in op1.remove_repeats(docs).collect()}
    assert cut[2, len(LONG)] == len(LONG) and cut[3, 2_000_000] == 2_000_000 and cut[4, 1_000_000] == 1_000_000
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = op9.packed_sequences(docs, path).collect()
    assert sum(r.doc_id is None for r in packed) >= 4
    item = spark.createDataFrame([(0, prose(9, 300))], "item_id long, text string")
    assert [r.doc_id for r in op3.leaks(docs, item).collect()] == [2]
    assert op3.without_leaks(docs, item).count() == 9


def test_leaks_take_odd_rows(spark):
    assert op3.leaks(odd_docs(spark), benchmark(spark)).count() == 0
    assert op3.leaks(empty_docs(spark), benchmark(spark)).count() == 0
    assert op3.leaks(odd_docs(spark), benchmark(spark, 0)).count() == 0


def test_packing_takes_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = op9.packed_sequences(odd_docs(spark), path).collect()
    assert {r.doc_id for r in rows} == set(range(9))
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert op9.packed_sequences(empty_docs(spark), path).count() == 0
    ties = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "one two"), (5, "one two"), (5, None)], "doc_id long, text string")
    stage = corpus_pipeline.STAGES[-1][1]
    for rows in (op9.packed_sequences(ties, path).collect(), stage(spark, ties, "").collect()):
        assert [sum(r.length for r in rows if (r.doc_id is None) == none) for none in (True, False)] == [6, 7]
    assert stage(spark, odd_docs(spark), "").count() > 0


def test_stages_take_odd_rows(spark, tmp_path):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs(spark)
    left = {"language_id": {0, 3, 6, 7, 8}, "line_dedup": {*range(9)}, "near_dedup": {0, 1, 2, 4, 5, 6, 7, 8}, "decontaminate": {*range(9)}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(found) == left[name], name
        if name == "near_dedup":
            assert len(found) == len(set(found))
        assert stage(spark, empty_docs(spark), str(tmp_path)).count() == 0, name
