"""The pipeline's stages: each one's input and output, its decisions, and hard rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumatab.llm import fair_mix, quality_rules, queries, rule_ensemble

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=240):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(r.randint(60, 150))]
        good = r.random() < 0.7
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) + "." if good else " | ".join(words)
        docs.append((i, text, "en", r.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1], "en", "c", docs[i][4]) for i in range(40)]  # copies
    docs += [(docs[0][0], docs[0][1], *docs[0][2:]), (None, docs[1][1], None, None, None), (2000, None, "en", "a", 0), (2001, "", "en", "a", 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    model = rule_ensemble.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tables)
        docs = spark.createDataFrame(made.collect(), made.schema)
        outs.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    first, second, third, fourth, last = outs
    whole = spark.read.parquet(f"{tables}/documents.parquet").collect()
    want = [d for d in whole if model.score(np.array([rule_ensemble.statistics(d.text)]))[0] >= 0.5]
    assert sorted(map(repr, first.collect())) == sorted(map(repr, want))
    kept = [quality_rules.judge(d.text) for d in want]
    assert second.count() == sum(k[6] for k in kept) and first.where("text LIKE '%|%|%|%'").count() == 0
    texts = [r.text for r in third.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in second.collect()}
    passes = {r.doc_id: r.passes for r in fair_mix.queue(third).collect()}
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {k: v for k, v in passes.items() if v}
    assert last.count() == fourth.count() and last.where("size(ids) <> n_tokens").count() == 0


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() > 50 and got.where("n_tokens = 0").count() == 0


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    assert [q for q in queries.QUERIES] == sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) and len(queries.QUERIES) == 10
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "mixing", "bpe encoding"]


def test_clean(spark):
    from lumatab.llm import shared

    _, path = shared.written(spark.range(3), "x")
    shared.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path)
