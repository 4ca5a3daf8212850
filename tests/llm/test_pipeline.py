import hashlib

import pytest
from pyspark.sql import functions as F
from test_decontamination import QUESTION, template
from test_native import brute_counts
from test_ngram_join import brute

import corpus_pipeline
from brindle.llm import decontamination, quality_rules, toxicity
from brindle.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(what went in, what came out) of every stage, through Parquet."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_rows_whole(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "decontamination", "bpe"]
    for name, (before, after) in stages.items():
        if name != "bpe":
            assert after.columns == before.columns and set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))
            assert after.count() < before.count() or name == "decontamination"


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    rows = quality_rules.judge(before, quality_rules.language_references(before)).collect()
    assert ids(after) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert all(not brute_counts(r["text"])[5] for r in after.collect())


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == sorted(r["doc_id"] for r in toxicity.score_toxicity(before, model).collect() if r["predicted"] == 0)


def test_join_stage(stages):
    before, after = stages["ngram_jaccard_join"]
    groups = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted(k for k, (_, c) in groups.items() if c == k)


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], template(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.BenchmarkIndex(items)
    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if not index.leaks(template(r["text"])))
    assert QUESTION


def test_bpe_stage_and_run(spark, stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    before, after = stages["bpe"]
    expected = {r["doc_id"]: hashlib.sha256(" ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest() for r in before.collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in after.collect()} == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, after.collect()))


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, documents):
    text = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst") + " the of and to in is that for the of"
    odd = documents([(None, None), (None, text), (1, ""), (2, text), (2, text), (3, "x " * 100)], kept="k", score=1.0, _row="r", leaks=2, rep=5, n_shingles=1)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            if name != "bpe":
                assert after.columns == docs.columns
                docs = spark.createDataFrame(after.collect(), docs.schema)
        assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and after.count() <= 6
    assert odd.select(F.col("kept")).first()[0] == "k"
