"""Made-up rows. Every draw is a hash of a row's number and the seed, so results do not depend on partitions."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.operators.quantiles import quantiles
from lumatab.operators.rules import num, uniform
from lumatab.plans.model import ColumnPlan, Relationship


def normal(key: Column, seed: int, salt: str) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(key, seed, salt + ":r"))) * F.cos(2 * math.pi * uniform(key, seed, salt + ":a"))


def laplace(key: Column, seed: int, salt: str, scale: Column | float) -> Column:
    u = uniform(key, seed, salt) - 0.5
    return -F.lit(scale) * F.signum(u) * F.ln(1 - 2 * F.abs(u)) if not isinstance(scale, Column) else -scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def between(grid: list[float] | None, share: Column) -> Column:
    """The value at a share of an even grid of quantiles, by linear interpolation."""
    if grid is None:
        return F.lit(None).cast("double")
    steps, values = len(grid) - 1, F.array(*map(F.lit, grid))
    low = F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int")
    return values[low] + (share * steps - low) * (values[low + 1] - values[low])


def rule_column(spec: dict[str, Any], seed: int, salt: str) -> Column:
    """A column over `row_id` (from 0): choice, sequence, number_range, date_between, pattern or constant."""
    row, u = F.col("row_id"), uniform(F.col("row_id"), seed, salt)
    kind = spec["type"]
    if kind == "choice":
        values = list(spec["values"])
        weights = spec.get("weights") or [1] * len(values)
        if len(weights) != len(values) or not values:
            raise ValueError("choice needs values, and as many weights")
        out, upto, total = None, 0.0, float(sum(weights))
        for v, w in zip(values[:-1], weights[:-1], strict=True):
            upto += w
            out = F.when(u <= upto / total, F.lit(v)) if out is None else out.when(u <= upto / total, F.lit(v))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
    if kind == "sequence":
        return F.concat(F.lit(str(spec.get("prefix", ""))), (int(spec.get("start", 1)) + row * int(spec.get("step", 1))).cast("string"))
    if kind == "number_range":
        low, high = float(spec.get("min", 0)), float(spec.get("max", 1))
        if not (math.isfinite(low) and math.isfinite(high)) or low > high:
            raise ValueError("number_range needs finite limits in order")
        if spec.get("integer"):
            a, b = math.ceil(low), math.floor(high)
            if a > b:
                raise ValueError(f"no integer in [{low}, {high}]")
            return (F.lit(a) + F.floor(u * (b - a + 1))).cast("bigint")
        return F.lit(low) + F.lit(high - low) * u
    if kind == "date_between":
        days = F.greatest(F.datediff(F.lit(spec["end"]).cast("date"), F.lit(spec["start"]).cast("date")), F.lit(0))
        return F.date_add(F.lit(spec["start"]).cast("date"), F.floor(u * (days + 1)).cast("int")).cast("string")
    if kind == "pattern":
        parts = []
        for i, ch in enumerate(spec.get("format", "########")):
            v = uniform(row, seed, f"{salt}:{i}")
            parts.append(F.floor(v * 10).cast("string") if ch == "#" else F.char(65 + F.floor(v * 26)) if ch == "?" else F.lit(ch))
        return F.concat(*parts)
    if kind == "constant":
        return F.lit(spec.get("value"))
    raise ValueError(f"unknown rule {kind}")


def unique_values(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """df with -2, -3 ... after the second and later occurrences of a value."""
    turn = F.row_number().over(Window.partitionBy(F.col(column).cast("string")).orderBy(order))
    return df.withColumn(column, F.when((turn == 1) | F.col(column).isNull(), F.col(column).cast("string")).otherwise(F.concat(F.col(column).cast("string"), F.lit("-"), turn.cast("string"))))


def dummy_table(spark: SparkSession, rows: int, columns: dict[str, dict[str, Any]], seed: int = 42, scenario: str = "normal") -> DataFrame:
    """A table from rules; `unique` or `primary_key` in a rule makes values distinct.

    Scenarios: boundary puts limits and blanks in the first rows, invalid breaks all rows, mixed does both with 5 % broken.
    """
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    df = df.withColumns({c: rule_column(s, seed, c) for c, s in columns.items()})
    for c, s in columns.items():
        if s.get("unique") or s.get("primary_key"):
            df = unique_values(df, c) if s["type"] != "sequence" else df
    if scenario in ("boundary", "mixed"):
        edges = {}
        for c, s in columns.items():
            if s["type"] == "number_range":
                edges[c] = F.when(F.col("row_id") == 0, F.lit(s.get("min", 0))).when(F.col("row_id") == 1, F.lit(s.get("max", 1))).otherwise(F.col(c))
            elif s["type"] in ("choice", "pattern"):
                edges[c] = F.when(F.col("row_id") == 0, F.lit("")).otherwise(F.col(c).cast("string"))
        df = df.withColumns(edges)
    if scenario in ("invalid", "mixed"):
        broken = F.col("row_id") < max(1, min(rows, round(rows * (1.0 if scenario == "invalid" else 0.05))))
        bad = {}
        for c, s in columns.items():
            top = float(s.get("max", 1))
            bad[c] = F.when(broken, F.lit(top + max(abs(top), 1) + 1) if s["type"] == "number_range" else F.lit(None)).otherwise(F.col(c))
        df = df.withColumns(bad)
    return df


def bootstrap(df: DataFrame, rows: int, order: list[str], seed: int = 42, salt: str = "boot") -> DataFrame:
    """`rows` rows of df drawn with replacement, with `row_id`.

    Rows are numbered by a hash in ranges whose sizes are known, so that numbering is no single sorted window. A row that is drawn often makes no
    task large: the numbers are joined on.
    """
    numbered, n = _numbered(df, order, seed)
    draws = df.sparkSession.range(rows).withColumnRenamed("id", "row_id").withColumn("_pick", F.floor(uniform(F.col("row_id"), seed, salt) * n).cast("bigint"))
    return draws.join(numbered, draws["_pick"] == numbered["_n"]).select("row_id", *df.columns)


def _numbered(df: DataFrame, order: list[str], seed: int) -> tuple[DataFrame, int]:
    """df with `_n` from 0 in the order of an md5 of `order`, and its number of rows. A range of digests is about the square root of the rows, so no task sorts many."""
    n = df.count()
    digits = max(1, min(6, math.ceil(math.log(max(n, 2), 16) / 2)))
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in order), F.lit(str(seed))))).withColumn("_part", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *order))
    out = hashed.withColumn("_place", place).join(before, "_part").withColumn("_n", F.col("_before") + F.col("_place") - 1)
    return out.drop("_h", "_part", "_place", "_before"), n


def marginal_sample(df: DataFrame, rows: int, categorical: list[str], numerical: list[str], conditions: dict[str, Any] | None = None, seed: int = 42, steps: int = 200) -> DataFrame:
    """Columns drawn one by one from their own distributions among rows that meet the conditions.

    Categories are drawn by cumulated shares through a range join on a table of values; numbers by linear
    interpolation in `steps` quantiles.
    """
    source = df
    for c, v in (conditions or {}).items():
        source = source.where(F.col(c).cast("string") == str(v))
    out = df.sparkSession.range(rows).withColumnRenamed("id", "row_id")
    for c in categorical:
        counts = source.groupBy(c).agg(F.count("*").alias("n")).withColumn("_h", F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        size = counts.agg(F.count("*").alias("values"), F.sum("n").alias("rows")).first()
        # running counts by ranges of digests: no task orders all values
        part = F.substring("_h", 1, max(1, min(6, math.ceil(math.log(max(size["values"], 2), 16) / 2))))
        sums = counts.groupBy(part.alias("_part")).agg(F.sum("n").alias("_s"))
        before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
        inner = Window.partitionBy("_part").orderBy("_h", F.asc_nulls_first(c)).rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("_part", part).withColumn("_w", F.sum("n").over(inner)).join(before, "_part").withColumn("_upto", F.col("_before") + F.col("_w"))
        total = float(size["rows"] or 1)
        shares = upto.select(F.col(c), (F.col("_upto") / total).alias("_to"), ((F.col("_upto") - F.col("n")) / total).alias("_from"))
        drawn = out.select("row_id", uniform(F.col("row_id"), seed, c).alias("_u"))
        # equal slots of the unit interval, as many as there are values, make the range join an equi-join
        slots = max(1024, size["values"])
        spread = shares.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_from") * slots), F.least(F.floor(F.col("_to") * slots), F.lit(slots - 1).cast("bigint")))))
        drawn = drawn.withColumn("_slot", F.floor(F.col("_u") * slots)).join(spread, "_slot").where((F.col("_u") > F.col("_from")) & (F.col("_u") <= F.col("_to"))).select("row_id", c)
        out = out.join(drawn, "row_id", "left")
    if numerical:
        grid = quantiles(source, {c: num(source, c) for c in numerical}, [i / steps for i in range(steps + 1)])
        out = out.withColumns({c: between(grid[c], uniform(F.col("row_id"), seed, c)) for c in numerical})
    return out.withColumns({c: F.lit(v) for c, v in (conditions or {}).items()}) if conditions else out


def copula_sample(df: DataFrame, rows: int, numerical: list[str], seed: int = 42, steps: int = 200) -> DataFrame:
    """Numbers drawn together by a Gaussian copula: rank correlations from the table, margins from its quantiles."""
    from lumatab.operators.association import pearson, ranks

    r = {tuple(row["pair"].split(" x ")): row["r"] for row in pearson(ranks(df, numerical), numerical).collect()}  # a number a pair
    k = len(numerical)
    m = [[1.0 if i == j else 2 * math.sin(math.pi / 6 * r.get((numerical[min(i, j)], numerical[max(i, j)]), 0.0)) for j in range(k)] for i in range(k)]
    low = [[0.0] * k for _ in range(k)]
    for i in range(k):
        for j in range(i + 1):
            s = m[i][j] - sum(low[i][q] * low[j][q] for q in range(j))
            low[i][j] = math.sqrt(max(s, 1e-9)) if i == j else s / low[j][j]
    out = df.sparkSession.range(rows).withColumnRenamed("id", "row_id").withColumns({f"_z{i}": normal(F.col("row_id"), seed, f"copula{i}") for i in range(k)})
    grid = quantiles(df, {c: num(df, c) for c in numerical}, [i / steps for i in range(steps + 1)])
    for i, c in enumerate(numerical):
        z = reduce(lambda a, b: a + b, (low[i][j] * F.col(f"_z{j}") for j in range(i + 1)))
        # the normal distribution function by its logistic form, right to 2e-4
        out = out.withColumn(c, between(grid[c], 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))))
    return out.select("row_id", *numerical)


def relational_sample(tables: dict[str, DataFrame], links: list[Relationship], keys: dict[str, str], scale: float = 1.0, noise: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Each table drawn with replacement, parents first: fresh keys 1..n, children pointing at keys that exist, noise on numbers of many values."""
    children = {r.child_table for r in links}
    out: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    for name in [*(t for t in tables if t not in children), *(t for t in tables if t in children)]:
        df = tables[name]
        total = df.count()
        rows = sizes[name] = max(1, int(total * scale))
        mine = [r for r in links if r.child_table == name]
        fixed = {keys.get(name), *(r.child_key for r in mine)}
        drawn = bootstrap(df, rows, [keys[name]] if keys.get(name) else df.columns, seed, f"rel:{name}")
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in fixed]
        if numeric:
            stats = df.agg(*(x for c in numeric for x in (F.stddev(c).alias(f"s_{c}"), F.approx_count_distinct(c).alias(f"d_{c}")))).first()  # two numbers a column
            put = {c: F.round(F.col(c) + normal(F.col("row_id"), seed, f"{name}.{c}") * noise * stats[f"s_{c}"], 2) for c in numeric if stats[f"d_{c}"] > 20 and stats[f"s_{c}"]}
            drawn = drawn.withColumns(put) if put else drawn
        if keys.get(name):
            kind = df.schema[keys[name]].dataType
            fresh = F.col("row_id") + 1
            drawn = drawn.withColumn(keys[name], fresh.cast(kind) if isinstance(kind, T.NumericType) else F.concat(F.lit("ID_"), F.lpad(fresh.cast("string"), 5, "0")))
        for r in mine:
            pick = F.floor(uniform(F.col("row_id"), seed, f"{name}.{r.child_key}") * sizes[r.parent_table]) + 1
            kind = tables[r.parent_table].schema[r.parent_key].dataType
            drawn = drawn.withColumn(r.child_key, pick.cast(kind) if isinstance(kind, T.NumericType) else F.concat(F.lit("ID_"), F.lpad(pick.cast("string"), 5, "0")))
        out[name] = drawn.select(*df.columns)
    return out


def panel_sample(df: DataFrame, entity: str, time: str, entities: int | None = None, seed: int = 42, noise: float = 0.03) -> DataFrame:
    """Whole histories of entities drawn with replacement, each shifted by up to a year and with noise on its numbers."""
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    who = rows.select(F.col(entity).alias("_old")).distinct()
    count = entities or who.count()
    drawn = bootstrap(who, count, ["_old"], seed, "panel").withColumn("_shift", (F.floor(uniform(F.col("row_id"), seed, "shift") * 731) - 365).cast("int"))
    out = drawn.join(rows, F.col("_old") == F.col(entity))
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != entity]
    stats = df.agg(*(F.stddev(c).alias(c) for c in numeric)).first() if numeric else {}  # one number a column
    key = F.concat_ws(":", "row_id", F.unix_micros(F.col(time).cast("timestamp")))
    put = {c: F.col(c) + normal(key, seed, c) * (noise * stats[c]) for c in numeric if stats[c]}
    put[time] = F.col(time).cast("timestamp") + F.make_dt_interval(F.col("_shift"))
    put[entity] = F.concat(F.lit("SYN-"), F.lpad((F.col("row_id") + 1).cast("string"), 6, "0"))
    return out.withColumns(put).select(*df.columns)


def laplace_noise(df: DataFrame, columns: list[str], key: str, epsilon: float = 1.0, bounds: dict[str, tuple[float, float]] | None = None, seed: int = 42) -> DataFrame:
    """df with Laplace noise of scale range / sqrt(rows) / epsilon; the range is a public one or the distance between quartiles. Noise, no privacy guarantee."""
    if epsilon <= 0:
        return df
    bounds = bounds or {}
    one = df.agg(F.count("*").alias("n"), *(F.max(num(df, c) % 1 != 0).alias(f"f_{c}") for c in columns)).first()  # a flag a column
    middle = quantiles(df, {c: num(df, c) for c in columns}, [0.25, 0.75])
    out = {}
    for c in columns:
        if middle[c] is None:
            continue
        width = bounds[c][1] - bounds[c][0] if c in bounds else middle[c][1] - middle[c][0]
        scale = max((width if width > 0 else 1.0) / math.sqrt(max(one["n"], 1)) / max(epsilon, 0.01), 1e-6)
        noisy = num(df, c) + laplace(F.col(key), seed, c, scale)
        out[c] = F.bround(noisy, 0).cast(df.schema[c].dataType) if not one[f"f_{c}"] else noisy
    return df.withColumns(out)


def accepted_sample(original: DataFrame, draw, rows: int, columns: list[str], accept: Column | None = None, policy: str = "balanced", max_attempts: int = 20) -> DataFrame:
    """`rows` rows from draw(rows, attempt) that pass `accept` and the policy on copies of original rows.

    strict blocks every original row, balanced those that occur less than five times, off none. After
    max_attempts without enough rows it fails: a short table is never returned silently.
    """
    blocked = None
    if policy != "off":
        counts = original.groupBy(*columns).agg(F.count("*").alias("_n"))
        blocked = (counts if policy == "strict" else counts.where("_n < 5")).select(*(F.col(c).alias(f"_b_{c}") for c in columns))
    got, have = None, 0
    for attempt in range(max_attempts):
        batch = draw(2 * (rows - have) + 16, attempt)
        if accept is not None:
            batch = batch.where(accept)
        if blocked is not None:
            batch = batch.join(blocked, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in columns)), "left_anti")
        got = batch if got is None else got.unionByName(batch)
        have += batch.count()
        if have >= rows:
            return got.limit(rows)
    raise RuntimeError(f"{have} of {rows} rows after {max_attempts} attempts: the rules or the policy on copies leave too few")


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, at_least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(fit, control): a share of the rows, rounded down, in the order of a hash, is set aside before anything is fitted, if there are enough rows."""
    numbered, n = _numbered(df, [key], seed)
    if n < at_least:
        return df, df.limit(0)
    return numbered.where(F.col("_n") >= int(share * n)).drop("_n"), numbered.where(F.col("_n") < int(share * n)).drop("_n")


# Area codes by the beginning of a region's name.
AREA_CODES = {
    "서울": "02", "경기": "031", "인천": "032", "강원": "033", "충남": "041", "충청남": "041", "대전": "042", "충북": "043", "충청북": "043", "세종": "044", "부산": "051", "울산": "052", "대구": "053", "경북": "054", "경상북": "054",
    "경남": "055", "경상남": "055", "전남": "061", "전라남": "061", "광주": "062", "전북": "063", "전라북": "063", "제주": "064",
}
GIVEN_NAMES = {"female": (["서", "지", "하", "예"], ["연", "은", "아", "윤"]), "male": (["민", "도", "준", "시"], ["준", "우", "호", "현"])}


def fake_people(df: DataFrame, columns: dict[str, str], key: str, as_of: str, age: str | None = None, gender: str | None = None, region: str | None = None, seed: int = 42) -> DataFrame:
    """df with made-up values that agree with each row: columns maps a column to ssn, phone, name, or any other kind of fake_values.

    An ssn's birth year is the row's age before the date `as_of`, its seventh digit goes by century and gender; a landline's area code goes by
    region (mobile where it is unknown); a given name by gender. Without a context value the draw is free.
    """
    u = lambda c, salt: uniform(F.col(key), seed, f"{c}:{salt}")
    digits = lambda n, c, salt: F.lpad(F.floor(u(c, salt) * 10**n).cast("string"), n, "0")
    pick = lambda words, c, salt: F.element_at(F.array(*map(F.lit, words)), (F.floor(u(c, salt) * len(words)) + 1).cast("int"))
    said = F.lower(F.trim(F.col(gender).cast("string"))) if gender else F.lit(None).cast("string")
    female, male = said.isin("f", "female", "여", "여성", "여자"), said.isin("m", "male", "남", "남성", "남자")
    for c, kind in columns.items():
        woman = F.when(female, True).when(male, False).otherwise(u(c, "g") < 0.5)
        if kind == "ssn":
            years = F.col(age).try_cast("int") if age else F.lit(None).cast("int")
            years = F.when((years >= 0) & (years <= 120), years).otherwise(F.floor(u(c, "y") * 60).cast("int") + 18)
            # a birthday in the year before the date, so that the age is reached and the next one is not
            day = F.date_add(F.add_months(F.lit(as_of).cast("date"), -12 * years), -F.floor(u(c, "d") * 365).cast("int"))
            mark = F.when(F.year(day) < 2000, F.when(woman, "2").otherwise("1")).otherwise(F.when(woman, "4").otherwise("3"))
            df = df.withColumn(c, F.concat(F.date_format(day, "yyMMdd"), F.lit("-"), mark, digits(6, c, "n")))
        elif kind == "phone":
            place = F.trim(F.col(region).cast("string")) if region else F.lit(None).cast("string")
            code = F.lit("010")
            for start, area in AREA_CODES.items():
                code = F.when(place.startswith(start), area).otherwise(code)
            df = df.withColumn(c, F.concat(code, F.lit("-"), F.when(code == "010", digits(4, c, "a")).otherwise(F.concat((F.floor(u(c, "a") * 8) + 2).cast("string"), digits(2, c, "b"))), F.lit("-"), digits(4, c, "e")))
        elif kind == "name":
            given = {k: F.concat(pick(a, c, "a"), pick(b, c, "b")) for k, (a, b) in GIVEN_NAMES.items()}
            df = df.withColumn(c, F.concat(pick(["김", "이", "박", "최", "정", "강", "조", "윤"], c, "s"), F.when(woman, given["female"]).otherwise(given["male"])))
        else:
            df = fake_values(df.drop(c), kind, c, key, seed)
    return df


def fake_values(df: DataFrame, kind: str, column: str, key: str, seed: int = 42) -> DataFrame:
    """df with a column of made-up values of a kind: name, phone, email, ssn, account, credit_card, business_number, ip_address, car_plate, address."""
    digits = lambda n, salt: F.lpad(F.floor(uniform(F.col(key), seed, f"{column}:{salt}") * 10**n).cast("string"), n, "0")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.floor(uniform(F.col(key), seed, f"{column}:{salt}") * len(words)) + 1).cast("int"))
    made = {
        "name": lambda: F.concat(pick(["김", "이", "박", "최", "정", "강", "조", "윤"], "s"), pick(["민", "서", "지", "하", "도", "예"], "a"), pick(["준", "연", "우", "은", "호", "아"], "b")),
        "phone": lambda: F.concat(F.lit("010-"), digits(4, "a"), F.lit("-"), digits(4, "b")),
        "email": lambda: F.concat(F.lit("user"), digits(6, "a"), F.lit("@example."), pick(["com", "net", "org"], "d")),
        "ssn": lambda: F.concat(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.floor(uniform(F.col(key), seed, "d") * 18250).cast("int")), "yyMMdd"), F.lit("-"), pick(["1", "2"], "g"), digits(6, "a")),
        "account": lambda: F.concat(digits(3, "a"), F.lit("-"), digits(4, "b"), F.lit("-"), digits(6, "c")),
        "credit_card": lambda: F.concat_ws("-", *(digits(4, s) for s in "abcd")),
        "business_number": lambda: F.concat(digits(3, "a"), F.lit("-"), digits(2, "b"), F.lit("-"), digits(5, "c")),
        "ip_address": lambda: F.concat_ws(".", F.lit("192.0.2"), F.floor(uniform(F.col(key), seed, "ip") * 256).cast("string")),
        "car_plate": lambda: F.concat(digits(2, "a"), pick(["가", "나", "다", "라", "마"], "h"), F.lit(" "), digits(4, "b")),
        "address": lambda: F.concat(pick(["서울특별시 중구", "부산광역시 남구", "대전광역시 서구"], "c"), F.lit(" "), pick(["중앙로", "시청로", "공원로"], "r"), F.lit(" "), digits(2, "n")),
    }
    return df.withColumn(column, F.when(F.col(column).isNotNull(), made[kind]()) if column in df.columns else made[kind]())


def dummy_tables(spark: SparkSession, tables: dict[str, tuple[int, dict[str, dict[str, Any]]]], links: list[Relationship], seed: int = 42) -> dict[str, DataFrame]:
    """Several tables from rules, children pointing at parent rows that exist: a child draws a parent's row number, and the key follows from the parent's rule by a join."""
    made = {n: dummy_table(spark, rows, columns, seed) for n, (rows, columns) in tables.items()}
    for r in links:
        parent = made[r.parent_table].select(F.col("row_id").alias("_p"), F.col(r.parent_key).alias("_key"))
        pick = F.floor(uniform(F.col("row_id"), seed, f"{r.child_table}.{r.child_key}") * tables[r.parent_table][0]).cast("bigint")
        child = made[r.child_table]
        joined = child.drop(r.child_key).withColumn("_pick", pick).join(parent, F.col("_pick") == F.col("_p"))
        columns = [c for c in child.columns if c != r.child_key]
        made[r.child_table] = joined.select(*columns, F.col("_key").alias(r.child_key))
    return made


def repeated_output(made: DataFrame, source: DataFrame, columns: list[str], made_key: str, source_order: list[str], seed: int = 42) -> DataFrame:
    """made with columns of the source taken in turn: row n gets the source's row n modulo its size. made_key numbers rows from 0."""
    numbered, n = _numbered(source.select(*dict.fromkeys([*columns, *source_order])), source_order, seed)
    right = numbered.select(F.col("_n"), *(F.col(c).alias(f"_s_{c}") for c in columns))
    joined = made.drop(*columns).withColumn("_at", F.col(made_key) % max(n, 1)).join(right, F.col("_at") == F.col("_n"), "left")
    return joined.select(*(c for c in made.columns if c not in columns), *(F.col(f"_s_{c}").alias(c) for c in columns))


#: Generators by name: (table, rows, plan, seed) -> DataFrame. `register` adds others.
GENERATORS: dict[str, Any] = {}


def register(name: str):
    def add(f):
        if name in GENERATORS:
            raise ValueError(f"{name} is taken")
        GENERATORS[name] = f
        return f

    return add


@register("statistical")
def _statistical(df: DataFrame, rows: int, plan: ColumnPlan, seed: int = 42) -> DataFrame:
    return marginal_sample(df, rows, list(plan.categorical), list(plan.numerical), seed=seed)


@register("gaussian_copula")
def _gaussian_copula(df: DataFrame, rows: int, plan: ColumnPlan, seed: int = 42) -> DataFrame:
    """Numbers together by the copula, categories by their own shares."""
    made = copula_sample(df, rows, list(plan.numerical), seed)
    return made.join(marginal_sample(df, rows, list(plan.categorical), [], seed=seed), "row_id") if plan.categorical else made


@register("bootstrap")
def _bootstrap(df: DataFrame, rows: int, plan: ColumnPlan, seed: int = 42) -> DataFrame:
    return bootstrap(df, rows, [*plan.categorical, *plan.numerical], seed).select("row_id", *plan.categorical, *plan.numerical)


def generate(name: str, df: DataFrame, rows: int, plan: ColumnPlan, seed: int = 42) -> DataFrame:
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](df, rows, plan, seed)
