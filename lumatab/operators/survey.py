"""Questionnaires: scales, skipped questions, modules answered by the same people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def likert_columns(df: DataFrame, columns: list[str], scales: list[list[str]], unanswered: str = "미응답") -> DataFrame:
    """(column_name, scale, overlap, has_unanswered): the scale that shares most answers with a column, three at least and 70 % of its answers."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns)))
    values = df.select(cells.alias("p")).select("p.*").where("v IS NOT NULL").distinct()
    per = values.groupBy("column_name").agg(F.max(F.col("v") == unanswered).alias("has_unanswered"), F.count_if(F.col("v") != unanswered).alias("n"), *(F.count_if(F.col("v").isin(s)).alias(f"s{i}") for i, s in enumerate(scales)))
    best = F.array_max(F.array(*(F.struct(F.col(f"s{i}").alias("overlap"), F.lit(-i).alias("i")) for i in range(len(scales)))))
    out = per.withColumn("b", best).where((F.col("b.overlap") >= 3) & (F.col("b.overlap") / F.col("n") >= 0.7))
    return out.select("column_name", (-F.col("b.i")).alias("scale"), F.col("b.overlap").alias("overlap"), "has_unanswered")


def encode_likert(df: DataFrame, scales: dict[str, list[str]], unanswered: str = "미응답") -> DataFrame:
    """df with answers as ranks from 1, the middle for others, and `<column>_unanswered`."""
    put = {}
    for c, scale in scales.items():
        rank = F.create_map(*(x for i, v in enumerate(scale) for x in (F.lit(v), F.lit(float(i + 1)))))
        put[f"{c}_unanswered"] = F.coalesce(F.col(c) == unanswered, F.lit(False))
        put[c] = F.coalesce(F.try_element_at(rank, F.col(c)), F.lit(float(len(scale) // 2 + 1)))
    return df.withColumns(put)


def decode_likert(df: DataFrame, scales: dict[str, list[str]], unanswered: str = "미응답") -> DataFrame:
    """Ranks back to answers, half-even and within the scale; unanswered ones as they were."""
    out = df
    for c, scale in scales.items():
        at = F.least(F.greatest(F.bround(F.col(c), 0), F.lit(1.0)), F.lit(float(len(scale)))).cast("int")
        text = F.element_at(F.array(*map(F.lit, scale)), at)
        flag = f"{c}_unanswered"
        out = out.withColumn(c, F.when(F.col(flag), unanswered).otherwise(text) if flag in out.columns else text)
    return out.drop(*(f"{c}_unanswered" for c in scales))


def skip_rules(df: DataFrame, columns: list[str], answers: tuple[str, ...] = ("아니오", "아니오(미참여)"), unanswered: str = "미응답", at_least: float = 0.98, support: int = 5) -> DataFrame:
    """(condition_column, condition_value, target_column, confidence, support): questions left out by nearly all who said no."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns)))
    flags = [(F.col(c).cast("string") == unanswered).alias(f"u{i}") for i, c in enumerate(columns)]
    tall = df.select(cells.alias("p"), *flags).where(F.col("p.v").isin(list(answers)))
    counts = tall.groupBy("p.c", "p.v").agg(F.count("*").alias("n"), *(F.count_if(f"u{i}").alias(f"k{i}") for i in range(len(columns))))
    targets = F.explode(F.array(*(F.struct(F.lit(c).alias("t"), F.col(f"k{i}").alias("k")) for i, c in enumerate(columns))))
    out = counts.where(F.col("n") >= support).select("c", "v", "n", targets.alias("x")).select("c", "v", "n", "x.t", "x.k").where((F.col("c") != F.col("t")) & (F.col("k") / F.col("n") >= at_least))
    return out.select(F.col("c").alias("condition_column"), F.col("v").alias("condition_value"), F.col("t").alias("target_column"), F.round(F.col("k") / F.col("n"), 4).alias("confidence"), F.col("n").alias("support"))


def apply_skips(df: DataFrame, rules: list[tuple[str, str, str]], unanswered: str = "미응답") -> DataFrame:
    """rules: (condition column, value, target column)."""
    out = df
    for a, v, b in rules:
        out = out.withColumn(b, F.when(F.coalesce(F.col(a).cast("string") == v, F.lit(False)), unanswered).otherwise(F.col(b)))
    return out


def skip_compliance(df: DataFrame, rules: list[tuple[str, str, str]], unanswered: str = "미응답") -> DataFrame:
    """(rule, applicable_rows, violations, compliance_rate, status): without applicable rows a rule is not evaluated."""
    one = df.agg(*(x for i, (a, v, b) in enumerate(rules) for x in (F.count_if(F.col(a).cast("string") == v).alias(f"n{i}"), F.count_if((F.col(a).cast("string") == v) & ~F.col(b).cast("string").eqNullSafe(F.lit(unanswered))).alias(f"x{i}"))))
    cells = [
        F.struct(F.lit(f"{a}={v} -> {b}").alias("rule"), F.col(f"n{i}").alias("applicable_rows"), F.col(f"x{i}").alias("violations"), F.when(F.col(f"n{i}") > 0, F.round(1 - F.col(f"x{i}") / F.col(f"n{i}"), 4)).alias("compliance_rate"),
                 F.when(F.col(f"n{i}") == 0, "NOT_EVALUATED").when(F.col(f"x{i}") == 0, "PASS").otherwise("REVIEW").alias("status"))
        for i, (a, v, b) in enumerate(rules)
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def fuse(modules: dict[str, DataFrame], key: str, common: list[str] | None = None) -> DataFrame:
    """Modules side by side on a row key that all of them have; common columns come once, others get the module's name."""
    names = list(modules)
    shared = common if common is not None else [c for c in modules[names[0]].columns if c != key and all(c in m.columns for m in modules.values())]
    parts = []
    for i, name in enumerate(names):
        df = modules[name]
        own = [F.col(c).alias(f"{name}__{c}") for c in df.columns if c != key and c not in shared]
        parts.append(df.select(key, *(shared if i == 0 else []), *own))
    return reduce(lambda a, b: a.join(b, key), parts)


def inspect(modules: dict[str, DataFrame], key: str) -> DataFrame:
    """(module, rows, columns, common, missing_keys, aligned): whether each module has the first one's keys, each once, with the same values in the common columns."""
    names = list(modules)
    if not names:
        raise ValueError("no modules")
    shared = [c for c in modules[names[0]].columns if c != key and all(c in m.columns for m in modules.values())]
    first = modules[names[0]].select(key, *(F.col(c).alias(f"_f_{c}") for c in shared)).withColumn("_in_first", F.lit(True))
    rows = []
    for name in names:
        df = modules[name]
        both = df.select(key, *shared).withColumn("_in", F.lit(True)).join(first, key, "full_outer")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in shared), F.lit(True))
        found = both.agg(F.count_if(F.col("_in").isNull()).alias("missing_keys"), F.count_if(F.col("_in").isNull() | F.col("_in_first").isNull() | ~same).alias("odd"), F.count_if("_in").alias("pairs"))
        size = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
        one = size.join(found, how="cross")  # one row each
        rows.append(one.select(F.lit(name).alias("module"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(shared)).alias("common"), "missing_keys", ((F.col("odd") == 0) & (F.col("rows") == F.col("keys")) & (F.col("pairs") == F.col("rows"))).alias("aligned")))
    return reduce(DataFrame.unionByName, rows)


def split(fused: DataFrame, modules: list[str], key: str) -> dict[str, DataFrame]:
    """The modules of a fused table, each with the common columns."""
    common = [c for c in fused.columns if c != key and "__" not in c]
    return {m: fused.select(key, *common, *(F.col(c).alias(c.split("__", 1)[1]) for c in fused.columns if c.startswith(f"{m}__"))) for m in modules}


def group_frequencies(original: DataFrame, derived: DataFrame, quasi: list[str]) -> DataFrame:
    """(quasi-identifiers, original_count, derived_count, difference): groups of both tables, 0 where one lacks them."""
    a = original.select(*(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias(c) for c in quasi)).groupBy(*quasi).agg(F.count("*").alias("original_count"))
    b = derived.select(*(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias(c) for c in quasi)).groupBy(*quasi).agg(F.count("*").alias("derived_count"))
    return a.join(b, quasi, "full_outer").fillna(0, ["original_count", "derived_count"]).withColumn("difference", F.col("derived_count") - F.col("original_count"))
