"""Verdicts over metrics. What was not measured has a null value and never counts as passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatab.operators import association, disclosure, divergence
from lumatab.plans.model import ColumnPlan


def status(value: Column, passes: float, reviews: float, lower_is_better: bool = True) -> Column:
    """PASS, REVIEW or FAIL by two limits; a missing or non-finite value is REVIEW."""
    good, fair = (value <= passes, value <= reviews) if lower_is_better else (value >= passes, value >= reviews)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "REVIEW").when(good, "PASS").when(fair, "REVIEW").otherwise("FAIL")


def distribution_metrics(original: DataFrame, derived: DataFrame, plan: ColumnPlan, bins: int = 20) -> DataFrame:
    """(column_name, metric, value): jsd and tvd of categories; jsd, wasserstein and its similarity of numbers."""
    parts = []
    tall = lambda df, names: df.select("column_name", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select("column_name", "m.*")
    if plan.categorical:
        parts.append(tall(divergence.categorical_divergence(original, derived, list(plan.categorical)), ["jsd", "tvd"]))
    if plan.numerical:
        parts.append(tall(divergence.numerical_jsd(original, derived, list(plan.numerical), bins), ["jsd"]))
        parts.append(tall(divergence.distribution_distance(original, derived, list(plan.numerical)), ["wasserstein", "similarity"]))
    return reduce(DataFrame.unionByName, parts)


def metric_means(metrics: DataFrame) -> DataFrame:
    """(metric, value): means over columns, missing ones left out."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


def composite(jsd: Column, similarity: Column, correlation: Column) -> Column:
    """0.4 (1 - JSD) + 0.3 Wasserstein similarity + 0.3 correlation score, weights shared among those measured."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = [(0.4, 1 - jsd), (0.3, similarity), (0.3, correlation)]
    known = [(F.when(c.isNotNull() & ~F.isnan(c), F.lit(w)).otherwise(0.0), F.when(c.isNotNull() & ~F.isnan(c), unit(c)).otherwise(0.0)) for w, c in parts]
    weight = reduce(lambda a, b: a + b, (w for w, _ in known))
    return F.when(weight > 0, reduce(lambda a, b: a + b, (w * v for w, v in known)) / weight)


def correlation_overall(original: DataFrame, derived: DataFrame, plan: ColumnPlan) -> DataFrame:
    """(score, status): mean of the numerical and the categorical preservation score; 1 where there is no pair."""
    parts = []
    if len(plan.numerical) > 1:
        parts.append(association.correlation_score(association.correlation_preservation(original, derived, list(plan.numerical))).select("score"))
    if len(plan.categorical) > 1:
        parts.append(association.association_score(association.association_preservation(original, derived, list(plan.categorical))).select("score"))
    if not parts:
        return original.sparkSession.createDataFrame([(1.0, "PASS")], "score double, status string")
    score = F.avg("score")
    return reduce(DataFrame.unionByName, parts).agg(score.alias("score")).withColumn("status", status(F.col("score"), 0.8, 0.65, lower_is_better=False))


def quality(original: DataFrame, derived: DataFrame, plan: ColumnPlan) -> DataFrame:
    """One row: jsd, similarity, correlation, composite, status by 0.8 and 0.6."""
    means = metric_means(distribution_metrics(original, derived, plan)).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("jsd", "similarity")))
    both = means.join(correlation_overall(original, derived, plan).select(F.col("score").alias("correlation")), how="cross")  # one row each
    both = both.withColumn("composite", composite(F.col("jsd"), F.col("similarity"), F.col("correlation")))
    return both.withColumn("status", status(F.col("composite"), 0.8, 0.6, lower_is_better=False))


def statistical_fidelity(original: DataFrame, derived: DataFrame, plan: ColumnPlan) -> DataFrame:
    """One row: univariate (100 (1 - KS) and 100 (1 - TVD)), correlation (Frobenius) and overall score at 60 : 40, verdict by 85 and 70."""
    parts = []
    if plan.numerical:
        parts.append(divergence.distribution_distance(original, derived, list(plan.numerical)).select((100 * (1 - F.col("ks"))).alias("s")))
    if plan.categorical:
        seen = lambda df: df.dropna(subset=list(plan.categorical))
        parts.append(divergence.goodness_of_fit(seen(original), seen(derived), list(plan.categorical)).select((100 * F.col("tvd_fidelity")).alias("s")))
    uni = reduce(DataFrame.unionByName, parts).agg(F.avg(F.greatest(F.lit(0.0), "s")).alias("univariate"))
    corr = association.frobenius_fidelity(original, derived, list(plan.numerical)).select((100 * F.col("fidelity")).alias("correlation")) if len(plan.numerical) > 1 else original.sparkSession.createDataFrame([(100.0,)], "correlation double")
    both = uni.join(corr, how="cross").withColumn("overall", 0.6 * F.col("univariate") + 0.4 * F.col("correlation"))  # one row each
    return both.withColumn("verdict", F.when(F.col("overall") >= 85, "EXCELLENT").when(F.col("overall") >= 70, "GOOD").otherwise("FAIR"))


def evaluate(original: DataFrame, derived: DataFrame, plan: ColumnPlan, quasi: list[str], sensitive: str | None, key: str, derived_key: str) -> DataFrame:
    """(metric, value, status) of utility and disclosure together, and a last row `overall`.

    overall is PASS only if everything passed; attack simulations that need an outside library are reported as
    not evaluated, so without them it is REVIEW at best.
    """
    q = quality(original, derived, plan)
    rows = [q.select(F.lit("composite").alias("metric"), F.col("composite").alias("value"), "status"), q.select(F.lit("correlation").alias("metric"), F.col("correlation").alias("value"), status(F.col("correlation"), 0.7, 0.5, False).alias("status"))]
    columns = [*plan.categorical, *plan.numerical]
    d = disclosure.duplicate_report(original, derived, columns)
    rows.append(d.select(F.lit("exact_duplicate_rate").alias("metric"), F.col("exact_duplicate_rate").alias("value"), "status"))
    s = disclosure.singling_out(original, derived, list(plan.categorical), list(plan.numerical))
    rows.append(s.select(F.lit("singleout_rate").alias("metric"), F.col("singleout_rate").alias("value"), status(F.col("singleout_rate"), 0.05, 0.2).alias("status")))
    if plan.numerical:
        n = disclosure.distance_report(disclosure.closest_records(original, derived, list(plan.numerical), key, derived_key))
        rows.append(n.select(F.lit("memorization_risk_rate").alias("metric"), F.col("memorization_risk_rate").alias("value"), "status"))
    if quasi and sensitive:
        c = disclosure.attribute_inference(original, derived, quasi, sensitive)
        rows.append(c.select(F.lit("inference_advantage").alias("metric"), F.col("inference_advantage").alias("value"), "status"))
    rows.append(original.sparkSession.createDataFrame([("attack_simulation", None, "NOT_EVALUATED")], "metric string, value double, status string"))
    tall = reduce(DataFrame.unionByName, rows)
    overall = tall.agg(F.count_if(F.col("status") == "FAIL").alias("f"), F.count_if(F.col("status") != "PASS").alias("n"))
    last = overall.select(F.lit("overall").alias("metric"), F.lit(None).cast("double").alias("value"), F.when(F.col("f") > 0, "FAIL").when(F.col("n") > 0, "REVIEW").otherwise("PASS").alias("status"))
    return tall.unionByName(last)


#: Metric, area, whether lower is better, limit, penalty beyond it, penalty where it was not measured, and when it
#: must be measured ("always", "asked": where a row for it is there, "free").
CHECKS = (
    ("singling_out_risk", "privacy", True, 0.05, 15, 0, "always"),
    ("linkability_risk", "privacy", True, 0.05, 15, 0, "always"),
    ("inference_risk", "privacy", True, 0.05, 15, 0, "always"),
    ("memorization_risk_rate", "privacy", True, 0.05, 10, 0, "always"),
    ("inference_advantage", "privacy", True, 0.05, 10, 0, "asked"),
    ("subspace_pass", "privacy", False, 1.0, 10, 10, "asked"),
    ("composite", "quality", False, 0.8, 15, 15, "always"),
    ("correlation", "quality", False, 0.7, 10, 0, "free"),
    ("pmse_ratio", "quality", True, 3.0, 10, 0, "free"),
    ("spearman_score", "quality", False, 0.8, 10, 0, "free"),
    ("significant_preservation_rate", "quality", False, 0.8, 10, 0, "free"),
)
ATTACKS = ("singling_out_risk", "linkability_risk", "inference_risk")


def assessment_checks(found: DataFrame, numerical: bool = True, quality_limit: float = 0.8) -> DataFrame:
    """(metric, area, value, threshold, state, penalty), a row a check, from (metric, value).

    state is ok, issue or unmeasured; a check that need not be measured and was not is ok. Of several rows of one metric the largest value
    counts; without numbers in the plan (`numerical`) distances need not be measured.
    """
    checks = [(m, a, low, quality_limit if m == "composite" else limit, p, q, "free" if m == "memorization_risk_rate" and not numerical else need) for m, a, low, limit, p, q, need in CHECKS]
    table = found.sparkSession.createDataFrame(checks, "metric string, area string, low boolean, threshold double, beyond int, blank int, need string")
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    given = found.groupBy("metric").agg(F.max(finite).alias("value"), F.lit(True).alias("asked"))
    both = table.join(given, "metric", "left")  # a row a check
    bad = F.when(F.col("low"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    wanted = (F.col("need") == "always") | ((F.col("need") == "asked") & F.coalesce("asked", F.lit(False)))
    state = F.when(F.col("value").isNull(), F.when(wanted, "unmeasured").otherwise("ok")).when(bad, "issue").otherwise("ok")
    penalty = F.when(state == "issue", F.col("beyond")).when(state == "unmeasured", F.col("blank")).otherwise(0)
    return both.select("metric", "area", "value", "threshold", state.alias("state"), penalty.alias("penalty"))


def assessment(checks: DataFrame) -> DataFrame:
    """One row over assessment_checks: score, privacy_ok, quality_ok, issues (their names), status.

    The score is 100 less all penalties, and null unless the attacks and, where needed, the distances were measured. PASS needs every check
    to be ok; FAIL needs measured attacks and a score below 60; anything else is REVIEW.
    """
    measured = F.bool_and(F.when(F.col("metric").isin(*ATTACKS), F.col("value").isNotNull()))
    distances = F.bool_and(F.when(F.col("metric") == "memorization_risk_rate", F.col("state") != "unmeasured"))
    fine = lambda area: F.bool_and(F.when(F.col("area") == area, F.col("state") == "ok"))
    one = checks.agg(
        F.greatest(F.lit(0), 100 - F.sum("penalty")).alias("points"), measured.alias("measured"), distances.alias("distances"), fine("privacy").alias("privacy_ok"), fine("quality").alias("quality_ok"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") != "ok", F.col("metric")))), ",").alias("issues"),
    )
    verdict = F.when(F.col("privacy_ok") & F.col("quality_ok"), "PASS").when(F.col("measured") & (F.col("points") < 60), "FAIL").otherwise("REVIEW")
    return one.select(F.when(F.col("measured") & F.col("distances"), F.col("points")).alias("score"), "privacy_ok", "quality_ok", "issues", verdict.alias("status"))


def leaderboard(original: DataFrame, candidates: dict[str, DataFrame | None], plan: ColumnPlan) -> DataFrame:
    """(place, candidate, distribution, correlation, score, status) by 0.6 (1 - JSD) + 0.4 correlation; failed candidates (None) last."""
    from pyspark.sql import Window

    rows = []
    for name, df in candidates.items():
        if df is None:
            rows.append(original.sparkSession.createDataFrame([(name, None, None, None, "failed")], "candidate string, distribution double, correlation double, score double, status string"))
            continue
        q = quality(original, df, plan)
        rows.append(q.select(F.lit(name).alias("candidate"), (1 - F.col("jsd")).alias("distribution"), "correlation", (0.6 * (1 - F.col("jsd")) + 0.4 * F.col("correlation")).alias("score"), F.lit("completed").alias("status")))
    out = reduce(DataFrame.unionByName, rows)
    return out.select(F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "candidate")).alias("place"), "*")  # a row a candidate


def attention(path_statistics: DataFrame) -> DataFrame:
    """(path, note, share) of JSON paths a person should look at: missing values, names of derived fields, names of quality flags. Nothing is corrected or invented."""
    gone = F.col("nulls") + F.col("empties") + F.coalesce("missing", F.lit(0))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    notes = F.array_compact(
        F.array(
            F.when(gone > 0, F.struct(F.lit("missing").alias("note"), F.round(gone / (F.col("occurrences") + F.coalesce("missing", F.lit(0))), 6).alias("share"))),
            F.when(name.rlike("avg|mean|sum|total|ratio|rate|평균|합계|비율|율$") & (F.col("scalars") > 0), F.struct(F.lit("may_be_derived").alias("note"), F.lit(None).cast("double").alias("share"))),
            F.when(name.rlike("flag|status|quality|valid|qc|상태|품질|여부") & (F.col("scalars") > 0), F.struct(F.lit("may_be_flag").alias("note"), F.lit(None).cast("double").alias("share"))),
        )
    )
    return path_statistics.select("path", F.explode(notes).alias("n")).select("path", "n.note", "n.share")


def metric_delta(before: DataFrame, after: DataFrame, targets: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(metric, before, after, delta, met) of two (metric, value) tables; a target is ("at_least" | "at_most" | "reduction", number)."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    met = F.lit(None).cast("boolean")
    for name, (kind, limit) in (targets or {}).items():
        got = {"at_least": F.col("after") >= limit, "at_most": F.col("after") <= limit, "reduction": (F.col("before") - F.col("after")) / F.nullif("before", F.lit(0.0)) >= limit}[kind]
        met = F.when(F.col("metric") == name, got).otherwise(met)
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("met", met)
