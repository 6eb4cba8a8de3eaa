"""The corpus pipeline on a small corpus whose survivors are known, and the registered queries."""

import random

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.helpers import docs

EN = "the and of to in that is was for with house water morning people thing another should river stone garden paper light".split()


def clean(seed, n=50):
    rng = random.Random(seed)
    return " ".join(rng.choice(EN) + rng.choice(["", "", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, clean(k), "en", "s") for k in range(80)]
    rows += [(100, "1234 5678 !!", "en", "s"), (101, None, "en", "s"), (102, "too short a text", "en", "s"), (103, " ".join(["again and"] * 40), "en", "s")]
    rows += [(104, " ".join(w + "%%%" for w in clean(104).split()), "en", "s")]
    near = clean(5).split()
    near[20] = "changed"
    rows += [(110, clean(3), "en", "s"), (111, " ".join(near), "en", "t"), (112, clean(3), None, None)]
    item = clean(900, 30)
    half = item.split()
    rows += [(120, f"{clean(120)} {item} {clean(121)}", "en", "s"), (121, f"{' '.join(half[15:])} {clean(122)} {' '.join(half[:15])}", "en", "s")]
    random.Random(1).shuffle(rows)
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_drops_what_it_should(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = table.columns, {r.doc_id for r in table.collect()}
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == columns
        kept = {r.doc_id for r in table.collect()}
        gone[name], left = left - kept, kept
    assert gone == {"language": {100, 101}, "quality": {102, 103, 104}, "near_copies": {110, 111, 112}, "decontamination": {120, 121}}
    assert left == set(range(80))


def test_run_returns_the_ids_of_what_is_left(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    found = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {k: library.encode(clean(k)) for k in range(80)}


def test_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert {"op2_chat", "op3_warc", "op13_lexical"} <= set(entry.oracle_sql())
