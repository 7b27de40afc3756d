"""Weighted fair queueing against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumatab.llm import fair_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shares(sizes: dict, limit: int = 3) -> dict:
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total_w = sum(w[s] for s in free)
        above = {s for s in free if left * w[s] / total_w > limit * sizes[s]}
        if not above:
            return target | {s: left * w[s] / total_w for s in free}
        for s in above:
            target[s] = float(limit * sizes[s])
        free -= above
        left -= sum(limit * sizes[s] for s in above)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    names = [None, "a", "b", "c", "dé", "z"][: r.randint(2, 6)]
    rows = [(i, " ".join(["w"] * min(400, int(r.paretovariate(0.8)))), "en", r.choice(names + names[:1] * 5), 0) for i in range(400)]
    got = fair_mix.queue(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes: dict = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + len(row[1].split())
    want = shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    source = {row[0]: row[3] for row in rows}
    for g in got:
        assert g.source_size == sizes[source[g.doc_id]]
        assert g.target == pytest.approx(want[source[g.doc_id]])
        assert g.taken in (0, g.size, 2 * g.size, 3 * g.size)
        taken[source[g.doc_id]] += g.taken
    assert sum(taken.values()) <= sum(sizes.values())
    for s, t in taken.items():
        assert abs(t - want[s]) <= 450 * 2
    again = fair_mix.queue(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_edge_rows(spark):
    rows = [(1, None, None, "a", None), (None, "", "en", None, 0), (2, "x y z", "en", "a", 5), (2, "x y z", "en", "a", 5), (3, "q " * 5000, "en", "b", 1)]
    got = fair_mix.queue(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 5
    assert {(x.doc_id, x["size"]) for x in got.collect()} == {(1, 0), (None, 0), (2, 3), (3, 5000)}
    assert fair_mix.queue(spark.createDataFrame([], SCHEMA)).count() == 0
    zero = fair_mix.queue(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert [x.taken for x in zero] == [0, 0]
    mixed = fair_mix.mixed_documents(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "key"))
    assert mixed.columns == ["doc_id", "text", "size", "source", "key"]


def test_mixed_rows_add_up(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), "en", r.choice("aab"), i) for i in range(80)] * 2 + [(5, "other text", "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for q in fair_mix.queue(docs).collect():
        want[q.doc_id] = want.get(q.doc_id, 0) + q.passes
    got = {x.doc_id: x["count"] for x in fair_mix.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_mixed_rows_are_those_of_the_queue(spark, seed):
    """Equal rows at a last place, rows alike but for another column, null ids and sources, texts without words, and columns with the names of steps."""
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, "", " ", "a b c", "d e", "f " * 7]), r.choice(["x", "y", None]), r.choice([None, "a", "b", "c"]), r.choice([1, 2])) for _ in range(300)]
    rows += [(9, "the same " * 3, "x", s, 0) for s in (None, "a", "b") for _ in range(60)] + [(i, "w " * r.randint(1, 9), "x", r.choice("abc"), 0) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "place").withColumnRenamed("n_chars", "passes")
    whole = F.xxhash64(*docs.columns)
    queued = fair_mix.queue(docs.withColumn("whole", whole), keep=("whole",)).collect()
    want: dict = {}
    for q in queued:
        if q.passes:
            want[q.doc_id, q["_keep_0"]] = want.get((q.doc_id, q["_keep_0"]), 0) + q.passes
    mixed = fair_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(x.doc_id, x.whole): x["count"] for x in mixed.groupBy("doc_id", whole.alias("whole")).count().collect()} == want


def test_one_id_on_a_third_of_the_rows(spark):
    """A null id with different texts is spread over buckets; with one text it is one group before anything is shuffled."""
    r = random.Random(2)
    rows = [(None, " ".join(["w"] * r.randint(1, 30)) + f" {i}", "en", "a", 0) for i in range(200)] + [(None, "the same text", "en", "b", 0)] * 200 + [(i, "x " * r.randint(0, 40), "en", r.choice("abc"), 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = docs.where("doc_id IS NULL AND source = 'a'").select(F.substring(fair_mix.order_key(F.col("doc_id"), F.col("text")), 1, 1).alias("k")).groupBy("k").count()
    assert keys.count() == 16 and keys.agg(F.max("count")).first()[0] < 40
    got = fair_mix.queue(docs).collect()
    assert len(got) == len(rows) and sum(g.taken for g in got) <= sum(len(x[1].split()) for x in rows)
    same = [g.passes for g in got if g.doc_id is None and g.mix_source == "b"]
    assert len(same) == 200 and max(same) - min(same) <= 1
    mixed = fair_mix.mixed_documents(docs)
    assert mixed.where("text = 'the same text'").count() == sum(same)
    assert mixed.count() == sum(g.passes for g in got)


def test_expand(spark):
    groups = spark.createDataFrame([(1, 1), (2, 3), (3, 10), (4, 8)], "g long, n long")
    got = fair_mix.expand(groups, "n", "k", chunk=4).collect()
    assert sorted((x.g, x.k) for x in got) == sorted((g, k) for g, n in ((1, 1), (2, 3), (3, 10), (4, 8)) for k in range(1, n + 1))
    assert all(x.n >= x.k for x in got)
