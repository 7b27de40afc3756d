"""Declarative rules on rows: found in a table, applied as column expressions, audited in one aggregation."""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.functions.coerce import clipped, elapsed_months, half_even, lag_days, like_original, number, shifted_years, timestamp
from lumatab.operators.quantiles import quantiles
from lumatab.plans.model import Rule, RuleKind


def num(df: DataFrame, column: str) -> Column:
    return number(F.col(column), df.schema[column].dataType)


def moment(df: DataFrame, column: str) -> Column:
    return timestamp(F.col(column), df.schema[column].dataType)


def predicate(df: DataFrame, column: str, condition: str = "equals", value: Any = None, numeric: bool = False) -> Column:
    """A condition that is always true or false: missing values fail comparisons, and pass not_zero and not_in."""
    c = F.col(column)
    sure = lambda x: F.coalesce(x, F.lit(False))
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    n = num(df, column)
    if condition == "is_null":
        return c.isNull()
    if condition == "not_null":
        return c.isNotNull()
    if condition == "is_zero":
        return sure(n == 0)
    if condition == "not_zero":
        return ~sure(n == 0)
    if condition == "in":
        return sure(c.isin(values))
    if condition == "not_in":
        return ~sure(c.isin(values))
    if condition in ("gt", "gte", "lt", "lte"):
        right = F.lit(float(value)) if value is not None else F.lit(None).cast("double")
        return sure({"gt": n > right, "gte": n >= right, "lt": n < right, "lte": n <= right}[condition])
    if condition == "equals":
        return sure(n == float(value)) if numeric else sure(F.trim(c.cast("string")) == str(value).strip())
    raise ValueError(f"unknown condition {condition}")


def expression(df: DataFrame, tree: Any) -> Column:
    """Arithmetic from nested {"op": ..., "args": [...]}, {"column": ...} and {"literal": ...}; division by 0 gives null."""
    if isinstance(tree, str):
        return num(df, tree)
    if not isinstance(tree, dict):
        return F.lit(tree)
    if "column" in tree:
        return num(df, tree["column"]) if tree["column"] in df.columns else F.lit(None).cast("double")
    if "literal" in tree:
        return F.lit(tree["literal"])
    args = [expression(df, a) for a in tree.get("args", [])]
    op = tree["op"]
    if op in ("add", "sum", "multiply"):
        out = args[0] if args else F.lit(1.0 if op == "multiply" else 0.0)
        for a in args[1:]:
            out = out * a if op == "multiply" else out + a
        return out
    if op == "subtract":
        return args[0] - args[1]
    if op == "divide":
        return args[0] / F.nullif(args[1], F.lit(0))
    if op == "clip":
        return clipped(args[0], tree.get("min"), tree.get("max"))
    if op == "round":
        return half_even(args[0], tree.get("digits", 0))
    raise ValueError(f"unknown operation {op}")


def row_sum(df: DataFrame, columns: list[str]) -> Column:
    """Sum of what is there; null only if all are missing."""
    total = sum((F.coalesce(num(df, c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(F.coalesce(*(num(df, c) for c in columns)).isNotNull(), total)


def calculated(df: DataFrame, rule: Rule) -> Column:
    """The value that a calculated column should have."""
    p, sources = rule.params, list(rule.columns[1:])
    if "expression" in p:
        value = expression(df, p["expression"])
    else:
        how = p["calculation"]
        if how == "sum":
            value = row_sum(df, sources)
        elif how == "product":
            value = expression(df, {"op": "multiply", "args": sources})
        elif how == "difference":
            value = num(df, sources[0]) - num(df, sources[1])
        elif how == "elapsed_months":
            value = elapsed_months(moment(df, sources[0]), F.lit(p["as_of"]).cast("timestamp")).cast("double")
        elif how == "work_hours":
            value = clipped(F.lit(float(p["base_hours"])) - num(df, sources[0]), p.get("min_hours"), p.get("max_hours"))
        else:
            raise ValueError(f"unknown calculation {how}")
    return half_even(value, p["round_digits"]) if p.get("round_digits") is not None else value


def _next_float(x: Column, up: bool) -> Column:
    """The neighbouring double: a step of half a unit in the last place, rounded away, found by arithmetic alone."""
    eps = 1.1102230246251568e-16  # just above 2^-53
    step = F.greatest(F.abs(x) * eps, F.lit(5e-324))
    return x + step if up else x - step


def uniform(key: Column, seed: int, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of an md5 of a row's key: the same whatever the partitions, and whatever engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(salt))), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def apply_rule(df: DataFrame, rule: Rule, reference: DataFrame | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """df with the rule's repair. Rules that draw numbers need `key`, a column that tells rows apart."""
    p, cols, kind = rule.params, list(rule.columns), rule.kind
    if any(c not in df.columns for c in cols):
        return df
    like = lambda c, value: value.cast(df.schema[c].dataType)
    if kind in (RuleKind.LESS_EQUAL, RuleKind.LESS, RuleKind.GREATER_EQUAL, RuleKind.GREATER):
        a, b = num(df, cols[0]), num(df, cols[1])
        bad = {RuleKind.LESS_EQUAL: a > b, RuleKind.LESS: a >= b, RuleKind.GREATER_EQUAL: a < b, RuleKind.GREATER: a <= b}[kind]
        put = {RuleKind.LESS: _next_float(b, False), RuleKind.GREATER: _next_float(b, True)}.get(kind, b)
        whole = isinstance(df.schema[cols[0]].dataType, T.IntegralType)
        if whole and kind in (RuleKind.LESS, RuleKind.GREATER):
            put = F.ceil(b) - 1 if kind == RuleKind.LESS else F.floor(b) + 1
        return df.withColumn(cols[0], F.when(bad, like(cols[0], put)).otherwise(F.col(cols[0])))
    if kind == RuleKind.EQUALITY:
        return df.withColumns({c: F.col(cols[0]) for c in cols[1:]})
    if kind == RuleKind.MIN_MAX:
        c = cols[0]
        v = num(df, c)
        if p.get("repair") == "smooth" and p.get("max") is not None:
            low, high = p.get("smoothing_width", (0.01, 0.5))
            drawn = F.lit(float(p["max"])) - (low + (high - low) * uniform(F.col(key), seed, rule.name))
            return df.withColumn(c, F.when(v > p["max"], drawn).otherwise(v))
        return df.withColumn(c, clipped(v, p.get("min"), p.get("max")))
    if kind == RuleKind.CALCULATED:
        value = calculated(df, rule)
        return df.withColumn(cols[0], F.when(value.isNotNull(), like(cols[0], value)).otherwise(F.col(cols[0])))
    if kind in (RuleKind.CUSTOM, RuleKind.NULLABLE_IF, RuleKind.REQUIRED_IF):
        cond = predicate(df, cols[0], p.get("condition", "equals"), p.get("value"), p.get("numeric", isinstance(df.schema[cols[0]].dataType, T.NumericType)))
        targets = p.get("targets") or cols[1:]
        values = p.get("values", {c: None if kind == RuleKind.NULLABLE_IF else p.get("target_value") for c in targets})
        put = {}
        for c in targets:
            hit = cond & F.col(c).isNull() if kind == RuleKind.REQUIRED_IF else cond
            put[c] = F.when(hit, F.lit(values.get(c)).cast(df.schema[c].dataType)).otherwise(F.col(c))
        return df.withColumns(put)
    if kind == RuleKind.RARE_CATEGORY:
        size = float(p["bin_size"])
        v = num(df, cols[0])
        return df.withColumn(cols[0], F.when(v.isNotNull(), F.floor(v / size) * size).otherwise(F.col(cols[0]).cast("double")))
    if kind == RuleKind.EXTREME_VALUE:
        if p.get("spike_value") is not None:
            out = df
            for c in cols:
                v = num(df, c)
                often = df.agg(F.avg((F.coalesce(v, F.lit(float("nan"))) == p["spike_value"]).cast("double")).alias("s")).first()["s"] or 0
                if often > p.get("spike_threshold", 0.3):
                    drawn = F.round(-F.ln(uniform(F.col(key), seed, rule.name + c)) * p.get("scale", 500.0) + p.get("offset", 10.0), p.get("round_digits", -1))
                    out = out.withColumn(c, F.when(v == p["spike_value"], drawn).otherwise(v))
            return out
        source = reference if reference is not None else df
        upper = quantiles(source, {c: num(source, c) for c in cols}, [float(p["quantile"])])
        return df.withColumns({c: clipped(num(df, c), None, upper[c][0]) for c in cols if upper[c] is not None})
    if kind == RuleKind.DATE_ORDER:
        a, b = moment(df, cols[0]), moment(df, cols[1])
        lag = sampled_lag(df, reference if reference is not None else df, cols[0], cols[1], key or cols[0], seed, p.get("min_days", 1), p.get("max_days"))
        fixed = a + F.make_dt_interval(F.greatest(F.lit(1), F.bround(lag, 0)).cast("int"))
        put = like_original(fixed, F.col(cols[1])) if isinstance(df.schema[cols[1]].dataType, T.StringType) else fixed.cast(df.schema[cols[1]].dataType)
        return df.withColumn(cols[1], F.when(b < a, put).otherwise(F.col(cols[1])))
    return df  # audited only


def lag_model(reference: DataFrame, start: str, end: str, steps: int = 200) -> tuple[str, list[float]]:
    """(strategy, numbers): quantiles of positive lags in days if there are 30, else median and spread of their logarithms, else nothing."""
    lag = lag_days(moment(reference, start), moment(reference, end))
    lags = reference.select(lag.alias("d")).where("d > 0")
    if len(lags.limit(30).collect()) >= 30:
        *grid, top = quantiles(lags, {"d": F.col("d")}, [*(i / steps for i in range(steps + 1)), 0.995])["d"]
        return "empirical", [min(q, top) for q in grid]
    few = lags.agg(F.count("*").alias("n"), F.median(F.ln("d")).alias("m"), F.percentile(F.ln("d"), [0.25, 0.75]).alias("q")).first()  # under 30 rows
    if few["n"]:
        sigma = 1.4826 * lags.agg(F.median(F.abs(F.ln("d") - few["m"]))).first()[0]
        if sigma <= 1e-8:
            sigma = max((few["q"][1] - few["q"][0]) / 1.349, 0.05)
        return "lognormal", [few["m"], sigma]
    return "uniform", []


def sampled_lag(df: DataFrame, reference: DataFrame, start: str, end: str, key: str, seed: int = 42, min_days: float = 1, max_days: float | None = None) -> Column:
    """A lag in days for each row, drawn from the reference's lags: no fixed value that would show repaired rows."""
    strategy, numbers = lag_model(reference, start, end)
    u = uniform(F.col(key), seed, f"lag:{start}:{end}")
    if strategy == "empirical":
        at = u * (len(numbers) - 1)
        low = F.floor(at).cast("int")
        grid = F.array(*(F.lit(x) for x in numbers))
        lag = grid[low] + (at - low) * (grid[F.least(low + 1, F.lit(len(numbers) - 1))] - grid[low])
    elif strategy == "lognormal":
        normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * uniform(F.col(key), seed, f"lag2:{start}:{end}"))
        lag = F.exp(F.lit(numbers[0]) + F.lit(numbers[1]) * normal)
    else:
        low, high = max(float(min_days), 1.0), 60.0
        lag = low + (high - low) * u
    return F.round(clipped(lag, float(min_days), float(max_days) if max_days is not None else None), 3)


def violation(df: DataFrame, rule: Rule) -> Column:
    """Whether a row breaks the rule."""
    p, cols, kind = rule.params, list(rule.columns), rule.kind
    sure = lambda x: F.coalesce(x, F.lit(False))
    if kind in (RuleKind.LESS_EQUAL, RuleKind.LESS, RuleKind.GREATER_EQUAL, RuleKind.GREATER):
        a, b = num(df, cols[0]), num(df, cols[1])
        return sure({RuleKind.LESS_EQUAL: a > b, RuleKind.LESS: a >= b, RuleKind.GREATER_EQUAL: a < b, RuleKind.GREATER: a <= b}[kind])
    if kind == RuleKind.DATE_ORDER:
        return sure(moment(df, cols[1]) < moment(df, cols[0]))
    if kind == RuleKind.MIN_MAX:
        v, out = num(df, cols[0]), F.lit(False)
        if p.get("min") is not None:
            out = out | (v < p["min"])
        if p.get("max") is not None:
            out = out | (v > p["max"])
        return sure(out)
    if kind == RuleKind.CALCULATED:
        want, have = calculated(df, rule), num(df, cols[0])
        return want.isNotNull() & ~sure(F.abs(have - want) <= 1e-8 + 1e-5 * F.abs(want))
    if kind == RuleKind.EQUALITY:
        out = F.lit(False)
        for c in cols[1:]:
            out = out | ~F.col(c).eqNullSafe(F.col(cols[0]))
        return out
    if kind in (RuleKind.CUSTOM, RuleKind.NULLABLE_IF, RuleKind.REQUIRED_IF):
        cond = predicate(df, cols[0], p.get("condition", "equals"), p.get("value"), p.get("numeric", isinstance(df.schema[cols[0]].dataType, T.NumericType)))
        targets = p.get("targets") or cols[1:]
        values = p.get("values", {c: p.get("target_value") for c in targets})
        out = F.lit(False)
        for c in targets:
            if kind == RuleKind.REQUIRED_IF:
                out = out | F.col(c).isNull()
            elif kind == RuleKind.NULLABLE_IF or values.get(c) is None:
                out = out | F.col(c).isNotNull()
            else:
                out = out | ~F.col(c).eqNullSafe(F.lit(values[c]).cast(df.schema[c].dataType))
        return cond & out
    if kind == RuleKind.REQUIRED:
        return F.col(cols[0]).isNull()
    if kind == RuleKind.ALLOWED_VALUES:
        return F.col(cols[0]).isNotNull() & ~sure(F.col(cols[0]).isin(list(p["values"])))
    if kind == RuleKind.DATE_RANGE:
        v, out = moment(df, cols[0]), F.lit(False)
        if p.get("min"):
            out = out | (v < F.lit(p["min"]).cast("timestamp"))
        if p.get("max"):
            out = out | (v > F.lit(p["max"]).cast("timestamp"))
        return sure(out)
    if kind == RuleKind.RARE_CATEGORY:
        v = num(df, cols[0])
        return sure(v != F.floor(v / float(p["bin_size"])) * float(p["bin_size"]))
    return F.lit(False)


def audit(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, kind, rows, violations, rate, status) of all rules in one aggregation; without rows or columns a rule is not evaluated, never passed."""
    known = [all(c in df.columns for c in r.columns) for r in rules]
    one = df.agg(F.count("*").alias("n"), *(F.count_if(violation(df, r) if ok else F.lit(False)).alias(f"v{i}") for i, (r, ok) in enumerate(zip(rules, known, strict=True))))
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind.value).alias("kind"), F.col("n").alias("rows"), F.when(F.lit(ok), F.col(f"v{i}")).alias("violations"), F.when(F.lit(ok) & (F.col("n") > 0), F.round(F.col(f"v{i}") / F.col("n"), 6)).alias("rate"),
                 F.when(F.lit(not ok) | (F.col("n") == 0), "NOT_EVALUATED").when(F.col(f"v{i}") == 0, "PASS").otherwise("REVIEW").alias("status"))
        for i, (r, ok) in enumerate(zip(rules, known, strict=True))
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def settle(df: DataFrame, rules: list[Rule], reference: DataFrame | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """df with all rules applied until none is broken, at most one pass more than there are rules. Rules in the order of rule_graph.resolve settle in one pass."""
    out = df
    for _ in range(len(rules) + 1):
        for r in rules:
            out = apply_rule(out, r, reference, key, seed)
        if not audit(out, rules).where("violations > 0").take(1):
            break
    return out


# --- finding rules --------------------------------------------------------------------------------------------


def _chunks(items: list, n: int = 60) -> list[list]:
    """Many pairs make long expressions; so many go into one aggregation."""
    return [items[i : i + n] for i in range(0, len(items), n)]


def _ratios(df: DataFrame, pairs: list[tuple[str, str]], compare) -> DataFrame:
    """(first, second, valid, rows, forward, backward, equal) of column pairs."""
    parts = []
    for chunk in _chunks(pairs):
        aggs = [F.count("*").alias("n")]
        for i, (a, b) in enumerate(chunk):
            x, y = compare(a), compare(b)
            aggs += [F.count_if(x.isNotNull() & y.isNotNull()).alias(f"v{i}"), F.count_if(x <= y).alias(f"f{i}"), F.count_if(y <= x).alias(f"b{i}"), F.count_if(x == y).alias(f"e{i}")]
        cells = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col("n").alias("rows"), F.col(f"v{i}").alias("valid"), F.col(f"f{i}").alias("forward"), F.col(f"b{i}").alias("backward"), F.col(f"e{i}").alias("equal")) for i, (a, b) in enumerate(chunk)]
        parts.append(df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discover_orders(df: DataFrame, columns: list[str], dates: bool = False, at_least: float = 0.995) -> DataFrame:
    """(lower, higher, confidence, support): pairs where one column is at most the other in nearly all rows that have both, not equal in all."""
    pairs = list(combinations(columns, 2))
    found = _ratios(df, pairs, (lambda c: moment(df, c)) if dates else (lambda c: num(df, c)))
    f, b = F.col("forward") / F.col("valid"), F.col("backward") / F.col("valid")
    keep = (F.col("valid") > 0) if dates else (F.col("valid") > 0) & (F.col("equal") < F.col("valid"))
    forward = f >= at_least
    return found.where(keep & (forward | (b >= at_least))).select(
        F.when(forward, F.col("first")).otherwise(F.col("second")).alias("lower"), F.when(forward, F.col("second")).otherwise(F.col("first")).alias("higher"),
        F.round(F.when(forward, f).otherwise(b), 6).alias("confidence"), F.round(F.col("valid") / F.col("rows"), 6).alias("support"),
    )


def discover_conditional_nulls(df: DataFrame, conditions: list[str], targets: list[str], at_least: float = 0.995) -> DataFrame:
    """(condition_column, condition_value, target_column, confidence, support): values (null as a condition, too) at which another column is nearly always missing.

    Only targets with a missing value count. A condition value costs one group, so conditions are columns of few values.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.trim(F.col(c).cast("string")).alias("v")) for c in conditions)))
    tall = df.select(cells.alias("p"), *(F.col(t).isNull().alias(f"m{i}") for i, t in enumerate(targets))).select("p.*", *(f"m{i}" for i in range(len(targets))))
    counts = tall.groupBy("c", "v").agg(F.count("*").alias("n"), *(F.count_if(f"m{i}").alias(f"k{i}") for i in range(len(targets))))
    total = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(t).isNull()).alias(f"a{i}") for i, t in enumerate(targets)))
    wide = counts.join(F.broadcast(total), how="cross")  # against one row
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("target_column"), F.col(f"k{i}").alias("k"), F.col(f"a{i}").alias("a")) for i, t in enumerate(targets))))
    out = wide.select("c", "v", "n", "rows", rows.alias("t")).select("*", "t.*").where((F.col("c") != F.col("target_column")) & (F.col("a") > 0) & (F.col("k") / F.col("n") >= at_least))
    return out.select(F.col("c").alias("condition_column"), F.col("v").alias("condition_value"), "target_column", F.round(F.col("k") / F.col("n"), 6).alias("confidence"), F.round(F.col("n") / F.col("rows"), 6).alias("support"))


# What stands for "no" in text.
NEGATIVES = ("N", "n", "0", "무", "없음", "비해당", "미해당")


def discover_zero_implications(df: DataFrame, numeric: list[str], text: list[str], at_least: float = 0.99) -> DataFrame:
    """(condition_column, target_column, target_value, confidence, support): what is nearly always zero, or one word for no, where a column is zero."""
    parts = []
    pairs = [(a, b) for a in numeric for b in numeric if a != b]
    for chunk in _chunks(pairs):
        aggs = [F.count("*").alias("n"), *(F.count_if(num(df, a) == 0).alias(f"z_{a}") for a in dict.fromkeys(a for a, _ in chunk)), *(F.count_if((num(df, a) == 0) & (num(df, b) == 0)).alias(f"b{i}") for i, (a, b) in enumerate(chunk))]
        cells = [F.struct(F.lit(a).alias("condition_column"), F.lit(b).alias("target_column"), F.lit("0").alias("target_value"), (F.col(f"b{i}") / F.nullif(F.col(f"z_{a}"), F.lit(0))).alias("confidence"), (F.col(f"z_{a}") / F.col("n")).alias("support")) for i, (a, b) in enumerate(chunk)]
        parts.append(df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    if numeric and text:
        cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"), F.col(c).cast("string").alias("v"), (num(df, a) == 0).alias("z")) for a in numeric for c in text)))
        counts = df.select(cells.alias("p")).select("p.*").where("z").groupBy("a", "c", "v").agg(F.count("*").alias("n"))
        per = counts.groupBy("a", "c").agg(F.max_by(F.struct("v", "n"), F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("m"), F.sum("n").alias("zeros"))
        total = df.agg(F.count("*").alias("rows"))
        both = per.join(F.broadcast(total), how="cross").where(F.col("top.v").isin(list(NEGATIVES)))  # against one row
        parts.append(both.select(F.col("a").alias("condition_column"), F.col("c").alias("target_column"), F.col("top.v").alias("target_value"), (F.col("top.n") / F.col("m")).alias("confidence"), (F.col("zeros") / F.col("rows")).alias("support")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("confidence") >= at_least).withColumns({c: F.round(c, 6) for c in ("confidence", "support")})


# --- constraints on generated tables --------------------------------------------------------------------------


def ordered_pair(df: DataFrame, low: str, high: str) -> DataFrame:
    """df with the two columns swapped where they stand the wrong way round."""
    bad = F.coalesce(num(df, high) < num(df, low), F.lit(False))
    return df.withColumns({low: F.when(bad, F.col(high)).otherwise(F.col(low)), high: F.when(bad, F.col(low)).otherwise(F.col(high))})


def aged(df: DataFrame, birth: str, at: str, min_years: int = 0, max_years: int | None = None, drop: bool = False) -> DataFrame:
    """df with births moved, in their own format, so that the age at a date lies within limits; with drop such rows go."""
    b, r = moment(df, birth), moment(df, at)
    latest = shifted_years(r, -min_years).cast("timestamp")
    young = F.coalesce(b > latest, F.lit(False))
    earliest = shifted_years(r, -max_years).cast("timestamp") if max_years is not None else None
    old = F.coalesce(b < earliest, F.lit(False)) if earliest is not None else F.lit(False)
    if drop:
        return df.where(~young & ~old)
    text = isinstance(df.schema[birth].dataType, T.StringType)
    put = lambda m: like_original(m, F.col(birth)) if text else m.cast(df.schema[birth].dataType)
    out = F.when(young, put(latest))
    if earliest is not None:
        out = out.when(old, put(earliest))
    return df.withColumn(birth, out.otherwise(F.col(birth)))


def in_date_range(df: DataFrame, column: str, low: str | None = None, high: str | None = None, drop: bool = False) -> DataFrame:
    v = moment(df, column)
    below = F.coalesce(v < F.lit(low).cast("timestamp"), F.lit(False)) if low else F.lit(False)
    above = F.coalesce(v > F.lit(high).cast("timestamp"), F.lit(False)) if high else F.lit(False)
    if drop:
        return df.where(~below & ~above)
    text = isinstance(df.schema[column].dataType, T.StringType)
    put = lambda m: like_original(F.lit(m).cast("timestamp"), F.col(column)) if text else F.lit(m).cast(df.schema[column].dataType)
    out = F.col(column)
    if high:
        out = F.when(above, put(high)).otherwise(out)
    if low:
        out = F.when(below, put(low)).otherwise(out)
    return df.withColumn(column, out)


def implied(df: DataFrame, if_column: str, if_value: Any, then_column: str, then_value: Any) -> DataFrame:
    return df.withColumn(then_column, F.when(predicate(df, if_column, "equals", if_value), F.lit(then_value).cast(df.schema[then_column].dataType)).otherwise(F.col(then_column)))


def null_indicator(df: DataFrame, column: str, name: str, missing: str = "ABSENT", present: str = "PRESENT") -> DataFrame:
    """df with a column that says whether another one is missing, so that a generator can learn it."""
    return df.withColumn(name, F.when(F.col(column).isNull(), missing).otherwise(present))


def enforce_null_indicator(df: DataFrame, column: str, name: str, missing: str = "ABSENT", present: str = "PRESENT") -> DataFrame:
    """Generated rows made to agree with the indicator; rows that cannot are left out."""
    out = df.withColumn(column, F.when(F.col(name) == missing, F.lit(None)).otherwise(F.col(column)))
    return out.where(F.col(name).isin(missing, present) & ~((F.col(name) == present) & F.col(column).isNull()))


def median_filled(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """df with missing numbers at the reference's median, 0 if it has none."""
    source = reference if reference is not None else df
    middle = quantiles(source, {c: num(source, c) for c in columns}, [0.5])
    return df.withColumns({c: F.coalesce(num(df, c), F.lit(middle[c][0] if middle[c] else 0.0)) for c in columns})


def projected(df: DataFrame, specs: dict[str, dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(df on its declared domains, report). specs: column to min, max, integer, non_negative, allowed_values; no limit is ever taken from data.

    report: (column_name, violations_before, violations_after, status).
    """
    out, before, after = {}, [], []
    for c, s in specs.items():
        if c not in df.columns:
            continue
        allowed = s.get("allowed_values")
        if isinstance(df.schema[c].dataType, T.StringType) and not any(k in s for k in ("min", "max", "integer", "non_negative")):
            bad = F.col(c).isNotNull() & ~F.col(c).isin(list(allowed or []))
            out[c] = F.when(bad, F.lit(allowed[0])).otherwise(F.col(c)) if allowed else F.col(c)
            before.append((c, F.count_if(bad) if allowed else F.lit(0)))
            continue
        low, high = s.get("min", 0 if s.get("non_negative") else None), s.get("max")
        v = num(df, c)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (v < low)
        if high is not None:
            bad = bad | (v > high)
        new = half_even(v) if s.get("integer") else v
        new = clipped(new, float(low) if low is not None else None, float(high) if high is not None else None)
        if allowed:
            near = F.array_min(F.transform(F.array(*(F.lit(float(a)) for a in allowed)), lambda a: F.struct(F.abs(a - new), a.alias("a"))))
            new = F.when(new.isNotNull(), near["a"])
        out[c] = new.cast("bigint") if s.get("integer") else new
        before.append((c, F.count_if(F.coalesce(bad, F.lit(False)))))
    done = df.withColumns(out)
    for c, _ in before:
        s = specs[c]
        if isinstance(df.schema[c].dataType, T.StringType) and s.get("allowed_values") and "min" not in s:
            after.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(s["allowed_values"]))))
        else:
            low, high = s.get("min", 0 if s.get("non_negative") else None), s.get("max")
            broken = (F.col(c) < low if low is not None else F.lit(False)) | (F.col(c) > high if high is not None else F.lit(False))
            after.append(F.count_if(F.coalesce(broken, F.lit(False))))
    one = df.agg(*(x.alias(f"b{i}") if not isinstance(x, int) else F.lit(x) for i, (_, x) in enumerate(before))).join(done.agg(*(x.alias(f"a{i}") for i, x in enumerate(after))), how="cross")  # one row each
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").cast("bigint").alias("violations_before"), F.col(f"a{i}").cast("bigint").alias("violations_after"), F.when(F.col(f"a{i}") > 0, "FAIL_SAFE").otherwise("PASS").alias("status")) for i, (c, _) in enumerate(before)]
    return done, one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
