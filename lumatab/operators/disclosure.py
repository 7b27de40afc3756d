"""Disclosure risk: small groups, uniform groups, copied rows, close rows and inferable attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatab.functions.coerce import number
from lumatab.operators.quantiles import quantiles
from lumatab.operators.sampling import smallest


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias(c) for c in columns))


def not_evaluated(df: DataFrame, reason: str) -> DataFrame:
    """What takes the place of a verdict that could not be reached: never a pass."""
    return df.sparkSession.createDataFrame([("NOT_EVALUATED", reason)], "status string, reason string")


def klt(df: DataFrame, quasi: list[str], sensitive: list[str], k: int = 5, l: int = 2, t: float = 0.2) -> DataFrame:  # noqa: E741
    """One row: k, l, t, group_count, unique_group_rate, status. Null is a value of its own.

    Groups and their sensitive values are counted once; l and t come from those counts. A category that a
    group lacks is as far as its global share, so a group's distance needs only the ones it has.
    """
    quasi, sensitive = [c for c in quasi if c in df.columns], [c for c in sensitive if c in df.columns]
    if not quasi:
        return not_evaluated(df, "no quasi-identifier")
    rows = _texts(df, [*quasi, *sensitive])
    sizes = rows.groupBy(*quasi).agg(F.count("*").alias("n"))
    base = sizes.agg(F.coalesce(F.min("n"), F.lit(0)).alias("k"), F.count("*").alias("group_count"), F.coalesce(F.round(F.avg((F.col("n") == 1).cast("double")), 6), F.lit(0.0)).alias("unique_group_rate"))
    parts = []
    for c in sensitive:
        cells = rows.groupBy(*quasi, c).agg(F.count("*").alias("m"))
        overall = cells.groupBy(c).agg(F.sum("m").alias("g"))
        shares = overall.select(c, (F.col("g") / F.sum("g").over(_all())).alias("share"))
        joined = cells.join(sizes, _same(cells, sizes, quasi)).drop(*(sizes[q] for q in quasi)).join(shares, c)
        local = F.col("m") / F.col("n")
        by = joined.groupBy(*quasi).agg(F.count("*").alias("l"), ((F.sum(F.abs(local - F.col("share")) - F.col("share")) + 1) / 2).alias("t"))
        parts.append(by.agg(F.min("l").alias("l"), F.round(F.max("t"), 6).alias("t")))
    verdict = base
    if parts:
        verdict = base.join(reduce(DataFrame.unionByName, parts).agg(F.min("l").alias("l"), F.max("t").alias("t")), how="cross")  # one row each
        passed = (F.col("k") >= k) & (F.col("l") >= l) & (F.col("t") <= t)
    else:
        verdict = base.withColumns({"l": F.lit(None).cast("bigint"), "t": F.lit(None).cast("double")})
        passed = F.col("k") >= k
    return verdict.select("k", "l", "t", "group_count", "unique_group_rate", F.when(passed, "PASS").otherwise("REVIEW").alias("status"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def rare_groups(df: DataFrame, quasi: list[str], below: int = 5) -> DataFrame:
    """One row: groups, rare_groups, rare_group_ratio, rows_in_rare_groups."""
    sizes = df.groupBy(*quasi).agg(F.count("*").alias("n"))
    rare = F.count_if(F.col("n") < below)
    return sizes.agg(F.count("*").alias("groups"), rare.alias("rare_groups"), (rare / F.greatest(F.count("*"), F.lit(1))).alias("rare_group_ratio"), F.coalesce(F.sum(F.when(F.col("n") < below, F.col("n"))), F.lit(0)).alias("rows_in_rare_groups"))


def group_rare_labels(df: DataFrame, columns: list[str], share: float = 0.01, label: str = "OTHER") -> DataFrame:
    """df with values held by less than a share of the rows replaced by one label; null stays."""
    out = df
    for c in columns:
        counts = df.groupBy(c).agg(F.count("*").alias("_n"))
        common = counts.withColumn("_all", F.sum("_n").over(_all())).where(F.col("_n") >= share * F.col("_all")).select(F.col(c).alias("_common"))
        common = F.broadcast(common)  # at most 1 / share values
        out = out.join(common, out[c] == F.col("_common"), "left").withColumn(c, F.when(F.col(c).isNull() | F.col("_common").isNotNull(), F.col(c).cast("string")).otherwise(F.lit(label))).drop("_common")
    return out.select(*df.columns)


def matched_rows(original: DataFrame, derived: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """derived with `_copies`: how often a row's values (null equals null) occur in the original, 0 for never."""
    columns = columns or [c for c in original.columns if c in derived.columns]
    counts = original.groupBy(*columns).agg(F.count("*").alias("_copies"))
    right = counts.select(*(F.col(c).alias(f"_o_{c}") for c in columns), "_copies")
    same = reduce(lambda x, y: x & y, (derived[c].eqNullSafe(right[f"_o_{c}"]) for c in columns))
    return derived.join(right, same, "left").select(*derived.columns, F.coalesce("_copies", F.lit(0)).alias("_copies"))


def without_copies(original: DataFrame, derived: DataFrame, columns: list[str] | None = None, unique_only: bool = False) -> DataFrame:
    """derived without rows that the original has, or has exactly once."""
    return matched_rows(original, derived, columns).where("_copies <> 1" if unique_only else "_copies = 0").drop("_copies")


def duplicate_report(original: DataFrame, derived: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: copies and copies of unique rows, their rates, status."""
    rows = matched_rows(original, derived, columns)
    found = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("_copies") > 0).alias("exact_duplicates"), F.count_if(F.col("_copies") == 1).alias("unique_duplicates"))
    rate = F.col("exact_duplicates") / F.greatest("rows", F.lit(1))
    status = F.when(F.col("rows") == 0, "NOT_EVALUATED").when(F.col("unique_duplicates") > 0, "FAIL").when(rate <= 0.01, "PASS").when(rate <= 0.05, "REVIEW").otherwise("FAIL")
    return found.select("rows", "exact_duplicates", F.round(rate, 4).alias("exact_duplicate_rate"), "unique_duplicates", F.round(F.col("unique_duplicates") / F.greatest("rows", F.lit(1)), 4).alias("unique_duplicate_rate"), status.alias("status"))


def bin_edges(reference: DataFrame, numerical: list[str], bins: int = 10) -> dict[str, list[float] | None]:
    """The quantiles that cut each number of the reference into bins."""
    return quantiles(reference, {c: number(F.col(c), reference.schema[c].dataType) for c in numerical}, [i / bins for i in range(bins + 1)]) if numerical else {}


def binned_keys(df: DataFrame, edges: dict[str, list[float] | None], categorical: list[str], numerical: list[str]) -> DataFrame:
    """df with `_key`: categories and bins between the edges, joined by two bars; missing values are __NA__."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("__NA__")) for c in categorical]
    for c in numerical:  # `bins` + 1 numbers a column
        cuts = sorted(set(edges[c] or []))
        v = number(F.col(c), df.schema[c].dataType)
        if len(cuts) < 3:
            bin_of = F.bround(v, 0).cast("bigint")
        else:
            bin_of = reduce(lambda a, b: a + b, ((v > e).cast("int") for e in cuts[1:-1]))
        parts.append(F.coalesce(bin_of.cast("string"), F.lit("__NA__")))
    return df.withColumn("_key", F.concat_ws("||", *parts))


def singling_out(original: DataFrame, derived: DataFrame, categorical: list[str], numerical: list[str], bins: int = 10) -> DataFrame:
    """One row: rows, matched_rows, singleout_rate: derived rows whose binned key the original has."""
    edges = bin_edges(original, numerical, bins)
    left = binned_keys(derived, edges, categorical, numerical)
    right = binned_keys(original, edges, categorical, numerical).select("_key").distinct().withColumn("_hit", F.lit(1))
    counted = left.groupBy("_key").agg(F.count("*").alias("_n")).join(right, "_key", "left")  # a row a key, however many rows have it
    found = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("matched_rows"))
    return found.select("rows", "matched_rows", (F.col("matched_rows") / F.greatest("rows", F.lit(1))).alias("singleout_rate"))


def attribute_inference(original: DataFrame, derived: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """One row: cap, baseline_cap, inference_advantage, matches_found_rate, status.

    The guess for an original row is the most frequent sensitive value (smallest on ties) among derived rows
    with its quasi-identifiers, or the original's most frequent one where none has them.
    """
    used = [*quasi, sensitive]
    rows = original.select(*used).dropna()
    most = F.min(F.struct((-F.col("_n")).alias("n"), F.col(sensitive).alias("v")))["v"]  # over counted values: no task holds a group's rows
    guesses = derived.select(*used).dropna().groupBy(*used).agg(F.count("*").alias("_n")).groupBy(*quasi).agg(most.alias("_guess"))
    common = original.where(F.col(sensitive).isNotNull()).groupBy(sensitive).agg(F.count("*").alias("_n")).agg(most.alias("m")).first()["m"]
    kind = original.schema[sensitive].dataType
    usual = F.lit(common).cast(kind)
    guess = F.coalesce("_guess", usual)
    found = rows.join(guesses, quasi, "left").agg(
        F.count("*").alias("rows"), F.avg((guess == F.col(sensitive)).cast("double")).alias("cap"), F.avg((F.col(sensitive) == usual).cast("double")).alias("baseline_cap"), F.avg(F.col("_guess").isNotNull().cast("double")).alias("matches_found_rate")
    )
    gain = F.col("cap") - F.col("baseline_cap")
    status = F.when(F.col("rows") == 0, "NOT_EVALUATED").when(gain > 0.15, "FAIL").when(gain > 0.05, "REVIEW").otherwise("PASS")
    return found.select(F.round("cap", 4).alias("cap"), F.round("baseline_cap", 4).alias("baseline_cap"), F.round(gain, 4).alias("inference_advantage"), F.round("matches_found_rate", 4).alias("matches_found_rate"), status.alias("status"))


def _sample(df: DataFrame, key: str, columns: list[str], numeric: list[str], size: int) -> DataFrame:
    """A bounded sample that does not depend on order or partitions: the rows with the smallest md5 of their key."""
    read = [number(F.col(c), df.schema[c].dataType).alias(c) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit("__NA__")).alias(c) for c in columns]
    return smallest(df.select(F.col(key).cast("string").alias("_id"), *read), F.md5("_id"), ["_id"], size)


def _one_array(sample: DataFrame, columns: list[str]) -> DataFrame:
    """The sample, bounded by its size, as one row with one array."""
    return sample.agg(F.sort_array(F.collect_list(F.struct("_id", *columns))).alias("_all"))


def closest_records(original: DataFrame, derived: DataFrame, columns: list[str], key: str, derived_key: str, sample: int = 500) -> DataFrame:
    """(side, id, d1, d2): distances of sampled derived rows (side 1) and sampled original rows (side 0, without themselves) to the two closest sampled original rows.

    Numbers are scaled to the original sample's range; rows with a missing number are left out. `sample` is
    the operator's bound on both samples, whatever the tables' size.
    """
    full = lambda df: df.dropna(subset=columns)
    numeric = lambda df: df.withColumns({c: number(F.col(c), df.schema[c].dataType) for c in columns})
    a, b = _sample(full(numeric(original)), key, columns, columns, sample), _sample(full(numeric(derived)), derived_key, columns, columns, sample)
    limits = a.agg(*(F.min(c).alias(f"_l_{c}") for c in columns), *(F.max(c).alias(f"_h_{c}") for c in columns))
    every = _one_array(a, columns).join(limits, how="cross")  # one row each
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).join(F.broadcast(every), how="cross")  # at most 2 * sample rows against one

    def apart(other: Column) -> Column:
        gaps = []
        for c in columns:
            width = F.col(f"_h_{c}") - F.col(f"_l_{c}")
            width = F.when(width == 0, F.lit(1.0)).otherwise(width)
            gap = (F.col(c) - other[c]) / width
            gaps.append(gap * gap)
        return F.sqrt(reduce(lambda x, y: x + y, gaps))

    others = F.filter("_all", lambda o: (F.col("side") == 1) | (o["_id"] != F.col("_id")))
    near = F.slice(F.array_sort(F.transform(others, apart)), 1, 2)
    return rows.select("side", F.col("_id").alias("id"), near.alias("d")).select("side", "id", F.get("d", F.lit(0)).alias("d1"), F.get("d", F.lit(1)).alias("d2"))


def distance_report(near: DataFrame) -> DataFrame:
    """One row of closest_records: medians, fifth percentiles, shares at risk and the verdict."""
    syn, raw = F.when(F.col("side") == 1, F.col("d1")), F.when(F.col("side") == 0, F.col("d1"))
    ratio = F.when(F.col("side") == 1, F.coalesce(F.col("d1") / (F.col("d2") + 1e-9), F.lit(1.0)))
    base = near.agg(F.median(syn).alias("median_dcr"), F.min(syn).alias("min_dcr"), F.percentile(syn, 0.05).alias("dcr_5th"), F.median(raw).alias("raw_median"), F.percentile(raw, 0.05).alias("raw_5th"), F.median(ratio).alias("nndr_median"), F.avg((ratio < 0.2).cast("double")).alias("nndr_risk"), F.avg((syn < 0.05).cast("double")).alias("near_rate"))
    relative = near.join(F.broadcast(base.select("raw_5th")), how="cross").agg(F.avg(F.when(F.col("side") == 1, (F.col("d1") < F.col("raw_5th") / 2).cast("double"))).alias("relative"))  # against one row
    both = base.join(F.broadcast(relative), how="cross")  # one row each
    rel = F.when(F.col("raw_5th") > 0, F.col("relative")).otherwise(F.col("near_rate"))
    risk = F.greatest("near_rate", rel)
    status = F.when(F.col("median_dcr").isNull(), "NOT_EVALUATED").when((F.col("min_dcr") < 1e-4) | (risk > 0.15) | (F.col("nndr_risk") > 0.15), "FAIL").when((risk <= 0.05) & (F.col("nndr_risk") <= 0.05), "PASS").otherwise("REVIEW")
    r = lambda c: F.round(c, 4)
    return both.select(r("median_dcr").alias("median_dcr"), r("min_dcr").alias("min_dcr"), r("dcr_5th").alias("dcr_5th_percentile"), r("raw_median").alias("raw_internal_dcr_median"), r("raw_5th").alias("raw_internal_dcr_5th_percentile"), r("nndr_median").alias("nndr_median"), r("nndr_risk").alias("nndr_risk_rate"), r(risk).alias("memorization_risk_rate"), status.alias("status"))


def subspace_distance(original: DataFrame, derived: DataFrame, numerical: list[str], categorical: list[str], key: str, derived_key: str, sample: int = 500, holdout: DataFrame | None = None) -> DataFrame:
    """One row: distances in the space of quasi-identifiers of mixed kind.

    Numbers are scaled robustly by the original sample, missing ones stand at its median; categories are 0
    or 1 apart; a distance is the root of the mean square over columns. With holdout rows (of the original's columns), which
    took no part in making the derived ones, a derived table less than half as far from the original as they are is REVIEW at best.
    """
    columns = [*numerical, *categorical]
    a, b = _sample(original, key, columns, numerical, sample), _sample(derived, derived_key, columns, numerical, sample)
    if numerical:
        mid = a.agg(*(x for c in numerical for x in (F.coalesce(F.median(c), F.lit(0.0)).alias(f"_m_{c}"), F.coalesce(F.percentile(c, 0.75) - F.percentile(c, 0.25), F.lit(0.0)).alias(f"_q_{c}"))))
        mads = a.join(F.broadcast(mid), how="cross").agg(*(F.coalesce(F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))), F.lit(0.0)).alias(f"_d_{c}") for c in numerical))  # against one row
        scale = mid.join(F.broadcast(mads), how="cross").select(*(F.col(f"_m_{c}") for c in numerical), *(F.greatest(F.col(f"_q_{c}") / 1.349, 1.4826 * F.col(f"_d_{c}"), F.lit(1e-9)).alias(f"_s_{c}") for c in numerical))
        every = _one_array(a, columns).join(F.broadcast(scale), how="cross")
    else:
        every = _one_array(a, columns)
    b = b.withColumn("_made", F.lit(True))
    if holdout is not None:
        b = b.unionByName(_sample(holdout, key, columns, numerical, sample).withColumn("_made", F.lit(False)))
    rows = b.join(F.broadcast(every), how="cross")  # at most 2 * `sample` rows against one

    def apart(o: Column) -> Column:
        gaps = []
        for c in numerical:
            gap = (F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.coalesce(o[c], F.col(f"_m_{c}"))) / F.col(f"_s_{c}")
            gaps.append(gap * gap)
        gaps += [(F.col(c) != o[c]).cast("double") for c in categorical]
        return F.sqrt(reduce(lambda x, y: x + y, gaps) / len(columns))

    near = F.slice(F.array_sort(F.transform("_all", apart)), 1, 2)
    d1, d2 = F.get("d", F.lit(0)), F.coalesce(F.get("d", F.lit(1)), F.lit(1.0))
    made = lambda c: F.when(F.col("_made"), c)
    kept = F.when(~F.col("_made"), F.col("d1"))
    rows = rows.select("_made", near.alias("d")).select("_made", d1.alias("d1"), (d1 / F.greatest(d2, F.lit(1e-12))).alias("ratio"))
    found = rows.agg(
        F.percentile(made(F.col("d1")), 0.05).alias("dcr_p05"), F.median(made(F.col("d1"))).alias("dcr_median"), F.percentile(made(F.col("ratio")), 0.05).alias("nndr_p05"), F.median(made(F.col("ratio"))).alias("nndr_median"),
        F.avg(made((F.col("ratio") < 0.2).cast("double"))).alias("nndr_low_ratio"), F.avg(made((F.col("d1") <= 1e-12).cast("double"))).alias("exact_qi_match_rate"),
        *([F.median(kept).alias("holdout_dcr_median"), F.percentile(kept, 0.05).alias("holdout_dcr_p05")] if holdout is not None else []),
    )
    close = F.lit(False)
    if holdout is not None:
        risk = F.col("dcr_median") / F.greatest(F.col("holdout_dcr_median"), F.lit(1e-12))
        found = found.withColumn("relative_privacy_risk", F.when(F.col("holdout_dcr_median").isNotNull(), risk))
        close = F.coalesce(F.col("relative_privacy_risk") < 0.5, F.lit(False))
    status = F.when(F.col("dcr_median").isNull(), "NOT_EVALUATED").when((F.col("exact_qi_match_rate") > 0) | (F.col("dcr_p05") <= 1e-12) | (F.col("nndr_low_ratio") > 0.15), "FAIL").when(close | (F.col("nndr_low_ratio") > 0.05), "REVIEW").otherwise("PASS")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns), status.alias("status"))


def escape_copies(original: DataFrame, derived: DataFrame, key: str, columns: list[str], quasi: list[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None, seed: int = 42, attempts: int = 8, small: int = 32 << 20) -> DataFrame:
    """derived without copies of original rows: numbers outside the quasi-identifiers are moved a little, until the row is no copy.

    Then rows whose quasi-identifiers occur once in the original get them generalised, numbers moved and text
    replaced by a label. A row for which no attempt helps is left out. Attempts are looked up one after the other, the row as it is
    first: while the original's distinct values take at most `small` bytes, in a broadcast table, without moving rows between
    tasks; beyond, by joins of the rows still open.
    """
    from pyspark.sql import types as T

    from lumatab.operators.generate import normal

    quasi, bounds = quasi or [], bounds or {}
    is_number = lambda c: isinstance(derived.schema[c].dataType, T.NumericType)
    numeric = [c for c in columns if is_number(c)]
    both = original.select(*(number(F.col(c), original.schema[c].dataType).alias(c) for c in numeric)).unionByName(derived.select(*(number(F.col(c), derived.schema[c].dataType).alias(c) for c in numeric)))
    mid = quantiles(both, {c: F.col(c) for c in numeric}, [0.25, 0.5, 0.75]) if numeric else {}
    mad = quantiles(both, {c: F.abs(F.col(c) - (mid[c][1] if mid[c] else 0.0)) for c in numeric}, [0.5]) if numeric else {}
    scale = {c: max((mid[c][2] - mid[c][0]) / 1.349, 1.4826 * mad[c][0], abs(mid[c][1]) * 0.01, 1e-6) if mid[c] else 1.0 for c in numeric}

    whole = lambda c: isinstance(derived.schema[c].dataType, T.IntegralType)
    width = lambda c, attempt, start: scale[c] * (start + 0.05 * attempt)

    def put(c: str, value: Column) -> Column:
        if c in bounds:
            value = F.greatest(F.lit(float(bounds[c][0])), F.least(F.lit(float(bounds[c][1])), value))
        return value.cast(derived.schema[c].dataType)

    def moved(c: str, attempt: int, start: float) -> Column:
        w = width(c, attempt, start)
        z = normal(F.col(key), seed, f"{c}:{attempt}")
        step = F.signum(z) * max(1, round(w)) if whole(c) else z * w
        return put(c, F.col(c).cast("double") + F.when(step == 0, F.lit(w)).otherwise(step))

    def ends(c: str, start: float) -> list[Column]:
        """All values that attempts can give a whole number, where they are few: a draw is never 0, so they are a step up and down."""
        steps = {max(1, round(width(c, a, start))) for a in range(attempts)} if whole(c) else set()
        return [put(c, F.col(c).cast("double") + x * d) for d in sorted(steps) for x in (1, -1)] if 2 * len(steps) < attempts else []

    def fits(on: list[str]) -> bool:
        """Whether the original's distinct values of some columns, at 64 bytes a row besides their texts, are few enough for a broadcast."""
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in on if isinstance(original.schema[c].dataType, (T.StringType, T.BinaryType))]
        found = original.agg(F.approx_count_distinct(F.xxhash64(*on)).alias("n"), F.max(reduce(lambda x, y: x + y, texts, F.lit(64))).alias("width")).first()
        return found["n"] * (found["width"] or 64) <= small

    def hashed(at: dict[str, Column], on: list[str]) -> Column:
        """A hash that is the same for values that are equal; columns of unlike kinds take no part, numbers do as doubles."""
        numbers = lambda c: all(isinstance(x.schema[c].dataType, T.NumericType) for x in (original, derived))
        return F.xxhash64(F.lit(0), *(at[c].cast("double") if numbers(c) else at[c] for c in on if numbers(c) or original.schema[c].dataType == derived.schema[c].dataType))

    def first_free(rows: DataFrame, options: list[tuple[str, Column]], taken: DataFrame, on: list[str], start: float) -> DataFrame:
        """Each row as it is, or else with the first option, a value for a column, that is not among the taken ones."""
        names, hits = rows.columns, taken.select(*(F.col(c).alias(f"_t_{c}") for c in on), F.lit(True).alias("_taken"))
        ways = [(on[0], F.col(on[0])), *options]
        if fits(on):
            coded = F.broadcast(hits.withColumn("_code", hashed({c: F.col(f"_t_{c}") for c in on}, on)))

            def looked_up(rows: DataFrame, c: str, v: Column, live: Column) -> DataFrame:
                """rows with `_taken`, true where the row is live and taken with this value; the value is only worked out where it is live. One long is the key, the values decide."""
                at = {x: F.col(x) for x in on} | {c: F.col("_v")}
                rows = rows.withColumn("_v", F.when(live, v)).withColumn("_key", F.when(live, hashed(at, on)))
                equal = reduce(lambda x, y: x + y, (at[x].eqNullSafe(F.col(f"_t_{x}")).cast("int") for x in on))
                return rows.join(coded, (F.col("_key") == F.col("_code")) & (equal == len(on)), "left")

            rows, free, shut = rows.withColumns({"_open": F.lit(True), "_shut": F.lit(False)}), F.col("_open"), F.col("_shut")
            for i, (c, v) in enumerate(ways):
                if i == 1 or i > 1 and c != ways[i - 1][0]:  # a column whose every value is taken needs no draws
                    few = ends(c, start) if c in numeric else []
                    rows = rows.withColumn("_shut", F.lit(bool(few)))
                    for e in few:
                        rows = looked_up(rows, c, e, free & shut).select(*names, "_open", (shut & F.col("_taken").isNotNull()).alias("_shut"))
                live = free & ~shut
                found = live & F.col("_taken").isNull()
                row = [F.when(found, F.col("_v")).otherwise(F.col(x)).alias(x) if x == c and i else F.col(x) for x in names]
                rows = looked_up(rows, c, v, live).select(*row, (free & ~found).alias("_open"), "_shut")
            return rows.where(~free).select(*names)
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in on))
        cut = (lambda df: df.checkpoint()) if rows.sparkSession.sparkContext.getCheckpointDir() else (lambda df: df.localCheckpoint())
        rounds = [ways[:1]]  # then a column's first attempt, and its others together
        for c in dict.fromkeys(x for x, _ in options):
            mine = [w for w in options if w[0] == c]
            rounds += [mine[:1], mine[1:]] if len(mine) > 1 else [mine]
        done, left = [], cut(rows.withColumn("_id", F.monotonically_increasing_id()))
        for several in rounds:
            c = several[0][0]
            tries = left.select("*", F.posexplode(F.array_distinct(F.array(*(v for _, v in several)))).alias("_try", "_v"))
            tries = tries.select("_id", "_try", *(F.col("_v" if x == c else x).alias(x) for x in names))
            best = cut(tries.join(hits, same, "left_anti").groupBy("_id").agg(F.min_by(F.struct(*names), "_try").alias("r")))
            done.append(best.select("r.*"))
            left = cut(left.join(best.select("_id"), "_id", "left_anti"))
            if left.isEmpty():
                break
        return reduce(DataFrame.unionByName, done)

    kept = lambda c, v: F.when(F.col(c).isNotNull(), v)
    options = [(c, kept(c, moved(c, a, 0.05))) for c in numeric if c not in quasi for a in range(attempts)]
    out = first_free(derived, options, original.select(*columns).distinct(), columns, 0.05)
    if not quasi:
        return out
    once = original.groupBy(*quasi).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    ways = [(c, moved(c, a, 0.1)) for c in quasi if is_number(c) for a in range(attempts)] + [(c, F.lit("GENERALIZED")) for c in quasi if not is_number(c)]
    return first_free(out, ways, once, quasi, 0.1)
