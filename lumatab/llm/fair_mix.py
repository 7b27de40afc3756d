"""Mixing sources to target weights by weighted fair queueing (operator 6). DataFrame functions only.

Every source's documents are put in a hashed order. A document's virtual finish time is the words of its
source up to and including it, divided by the source's target; a source goes around at most `max_passes`
times. All passes are ordered by finish time over all sources and cut where the total budget is used up.

No table of rows is sorted in one task: running sums go through buckets of the order key, whose number is about the
square root of the number of rows, so that neither a bucket nor the table of buckets is large and a source
that holds a third of all rows is spread over many tasks. The key is a hash of id and text, so one id on many rows is
spread too, and rows alike in both are added up before anything is shuffled. The cut is found in a histogram of
finish times; only the one bin it falls in is ordered row by row. Sources are ranked in one task, a row each.

Defined cases: a null source is one source, the last; a null or empty text has size 0 and is never taken; all
sizes 0 gives targets 0; a null id is ordered like the empty string; rows alike in source, id and text are
interchangeable, so reruns agree; an empty table gives no rows; other columns are not read (`mixed_documents` keeps them all).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatab.llm import shared

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Weighted shares of all words, none above max_passes times its source: with sources by rising
    size per weight, the first k are at their limit and the rest share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("limit", F.lit(float(max_passes)) * F.col("source_size"))
    every = Window.partitionBy()
    rising = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.coalesce(F.sum("limit").over(rising), F.lit(0.0)).alias("limits_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0.0))).alias("w_from"),
    )
    level = (F.col("total") - F.col("limits_before")) / F.col("w_from")  # a word budget per weight, if this and all later sources share
    # passing a source that its limit holds back raises the level of the rest, passing any other lowers it
    per = per.withColumn("level", F.max(level).over(every))
    target = F.least(F.col("limit"), F.col("level") * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def order_key(id_col: Column, text_col: Column) -> Column:
    """The shuffled order: md5 of the id and the text, so that rows with one id, or null ids, are spread too."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))))


def expand(groups: DataFrame, count: str, number: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row of groups `count` times, numbered from 1 in column `number`. Rows with more than `chunk` copies are dealt over tasks in chunks."""
    few = groups.where(F.col(count) <= chunk).withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count))))
    chunks = groups.where(F.col(count) > chunk).agg(F.sum(F.ceil(F.col(count) / chunk))).first()[0]
    if not chunks:
        return few
    many = groups.where(F.col(count) > chunk).withColumn("_from_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(chunk).cast("bigint"))))
    many = many.repartition(min(int(chunks), 4096))  # few rows now, many afterwards
    many = many.withColumn(number, F.explode(F.sequence(F.col("_from_") + 1, F.least(F.col("_from_") + chunk, F.col(count)))))
    return few.unionByName(many.drop("_from_"))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, passes, mix_source) per row; passes says how often the mix takes it. The columns in keep follow as _keep_0, _keep_1, ..."""
    with shared.steps(docs.sparkSession) as tables:
        return shared.written(_queue(tables, docs, id_col, text_col, source_col, weights, max_passes, keep).drop("_order_"), "mix-queue")[0]


def _queue(tables: shared.Steps, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_passes: int, keep: tuple[str, ...]) -> DataFrame:
    text = F.col(text_col).cast("string")
    kept = [f"_keep_{i}" for i in range(len(keep))]
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        order_key(F.col(id_col), text).alias("key"),
        *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)),
    )
    # the texts are read once; rows alike in all of this are one group, added up before they are shuffled
    groups = tables.write(sized.groupBy("source", "key", "id", "size", *kept).agg(F.count("*").alias("copies")), "mix-groups")
    n = groups.count()
    bits = min(24, max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    groups = groups.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), 24 - bits)).withColumn("words", F.col("size") * F.col("copies"))
    per_bucket = groups.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    before = per_bucket.select("source", "bucket", (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *kept).rowsBetween(Window.unboundedPreceding, 0)
    s, b = F.col("s.source"), F.col("b.source")
    ranged = (
        groups.withColumn("within", F.sum("words").over(inner) - F.col("words")).alias("s")
        .join(before.alias("b"), s.eqNullSafe(b) & (F.col("s.bucket") == F.col("b.bucket")))
        .select("s.source", "key", "id", "size", *kept, "copies", (F.col("before") + F.col("within")).alias("start"))
        .alias("s")
        .join(targets(groups.select("source", F.col("words").alias("size")), weights, max_passes).alias("b"), s.eqNullSafe(b))
        .select("s.*", "source_size", "target")
    )
    ranged = tables.write(ranged, "mix-ranges")
    placed = expand(ranged, "copies", "copy").withColumn("upto", (F.col("start") + F.col("copy") * F.col("size")).cast("double"))
    return _taken(placed, bits, max_passes, id_col, kept)


def _taken(placed: DataFrame, bits: int, max_passes: int, id_col: str, kept: list[str]) -> DataFrame:
    """The queue's rows with the passes that the cut leaves them."""

    def finish(turn: Column) -> Column:
        """Virtual finish time of a row's pass (0, 1, ...)."""
        return F.when(F.col("size") > 0, (turn * F.col("source_size").cast("double") + F.col("upto")) / F.col("target"))

    # the cut: the last pass, in order of (finish, key, id, size, source), with all up to it in the budget
    bins = 1 << bits
    turns = placed.select("id", "source", "size", "key", F.explode(F.array(*(F.struct(finish(F.lit(float(p))).alias("f")) for p in range(max_passes)))).alias("t")).select("id", "source", "size", "key", "t.f").where("f IS NOT NULL")
    bin_of = F.least(F.floor(F.col("f") * bins), F.lit(max_passes * max_passes * bins + 1)).cast("bigint")
    budget = placed.agg(F.sum("size")).first()[0] or 0
    filled = turns.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
    first = filled.where(F.col("upto") > budget).orderBy("bin").select("bin", (F.col("upto") - F.col("words")).alias("used")).first()
    if first is None:  # every pass fits
        taken = [finish(F.lit(float(p))).isNotNull() for p in range(max_passes)]
    else:
        order = ["f", "key", "id", "size", "source"]
        last = (
            turns.where(bin_of == first["bin"])
            .withColumn("upto", F.lit(first["used"]) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
            .where(F.col("upto") <= budget).orderBy(F.desc("upto")).select(*order).first()
        )
        taken = []
        for p in range(max_passes):
            f = finish(F.lit(float(p)))
            below = F.floor(f * bins) < F.lit(first["bin"])
            if last is not None:
                at = F.struct(f.alias("f"), "key", "id", "size", "source")
                id_kind = placed.schema["id"].dataType
                cut = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["key"]).alias("key"), F.lit(last["id"]).cast(id_kind).alias("id"), F.lit(last["size"]).cast("bigint").alias("size"), F.lit(last["source"]).cast("string").alias("source"))
                below = below | ((F.floor(f * bins) == F.lit(first["bin"])) & (at <= cut))
            taken.append(F.coalesce(below, F.lit(False)))
    passes = sum((t.cast("bigint") for t in taken), F.lit(0).cast("bigint"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * passes).alias("taken"), passes.alias("passes"), F.col("source").alias("mix_source"), *kept, F.col("key").alias("_order_"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns.

    Within a source each pass takes the rows up to a last one, in the shuffled order. So the queue, which runs on ids, sizes and
    row hashes, comes down to a last row a source and pass, and every row's passes follow from its own place: whole rows are not
    shuffled. Only of fully equal rows can the cut take some and leave some; a last row that has equals is taken apart, as
    one row that goes as often as all of them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, text = F.xxhash64(*columns), F.col(text_col).cast("string")
    lasts = [f"last_{p}" for p in range(max_passes)]
    with shared.steps(docs.sparkSession) as tables:
        got = _queue(tables, docs.withColumn("_row_", row), id_col, text_col, source_col, weights, max_passes, ("_row_",))
        got = got.where("passes > 0").select("mix_source", F.struct(F.col("_order_").alias("key"), F.col(id_col).alias("id"), F.col("_keep_0").alias("row")).alias("place"), "passes")
        ends = shared.written(got.groupBy("mix_source").agg(*(F.max(F.when(F.col("passes") > p, F.col("place"))).alias(c) for p, c in enumerate(lasts))), "mix-ends")[0]
        edges = ends.select(F.col("mix_source").alias("edge_source"), F.explode(F.array_distinct(F.array_compact(F.array(*lasts)))).alias("edge"))
        at_edge = got.join(edges, F.col("mix_source").eqNullSafe(F.col("edge_source")) & (F.col("place") == F.col("edge")))
        equal = at_edge.groupBy("edge_source", "edge").agg(F.sum("passes").alias("all"), F.count("*").alias("rows"))
        equal = shared.written(equal.where("rows > 1"), "mix-equal")[0]
    place = F.struct(order_key(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), row.alias("row"))
    placed = docs.where(text.rlike(WORDS)).select(F.struct(*columns).alias("doc"), F.col(source_col).cast("string").alias("source"), place.alias("place"))
    passes = sum((F.when(F.col("place") <= F.col(c), 1).otherwise(0) for c in lasts), F.lit(0)).cast("bigint")
    inner = placed.join(ends, F.col("source").eqNullSafe(F.col("mix_source")))
    if equal.isEmpty():
        out = inner.select("doc", passes.alias("passes"))
    else:
        same = F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("place") == F.col("edge"))
        out = inner.join(equal, same, "left_anti").select("doc", passes.alias("passes"))
        out = out.unionByName(placed.join(equal, same).select("doc", F.col("all").alias("passes")).distinct())  # combined before the shuffle
    return out.where("passes > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes")))).select("doc.*")


SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM t GROUP BY source),
lim AS (SELECT source, source_size, w, 3.0::DOUBLE * source_size AS lim, (sum(source_size) OVER ())::DOUBLE AS total FROM per),
pre AS (SELECT *, coalesce(sum(lim) OVER r, 0) AS limits_before, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_from FROM lim
    WINDOW r AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, (total - limits_before) / w_from AS level FROM pre),
tgt AS (SELECT source, source_size, least(lim, max(level) OVER () * w) AS target FROM lev),
q AS (SELECT t.*, source_size, target, (sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS upto
    FROM t JOIN tgt ON t.source IS NOT DISTINCT FROM tgt.source),
turns AS (SELECT rid, size, key, doc_id, source, (p * source_size::DOUBLE + upto) / target AS f FROM q, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS v(p) WHERE size > 0),
cut AS (SELECT rid, size, sum(size) OVER (ORDER BY f, key, doc_id, size, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= (SELECT sum(size) FROM t) AS ok FROM turns),
got AS (SELECT rid, count(*)::BIGINT AS passes FROM cut WHERE ok GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(passes, 0))::BIGINT AS taken, coalesce(passes, 0)::BIGINT AS passes, source AS mix_source
FROM q LEFT JOIN got USING (rid)
"""
