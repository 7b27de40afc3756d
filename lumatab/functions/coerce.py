"""The one place where values are read as numbers or dates. Missing means null: NaN becomes null on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(col: Column, kind: T.DataType) -> Column:
    """As double; null for text that is no plain number (a cast alone would take '1d') and for NaN."""
    if isinstance(kind, T.BooleanType):
        return col.cast("double")
    if isinstance(kind, T.NumericType):
        wide = col.cast("double")
        return F.when(~F.isnan(wide), wide) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else wide
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns read as numbers."""
    return df.withColumns({c: number(F.col(c), df.schema[c].dataType) for c in columns})


def no_nan(df: DataFrame) -> DataFrame:
    """df with null for NaN in its floating columns."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floating}) if floating else df


def clipped(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within limits; null stays null (least and greatest alone would skip it)."""
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def date_text(col: Column) -> Column:
    """Dates as text with dashes: Korean year, month and day signs, slashes and dots are separators; brackets go."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"\([^)]*\)", "")
    text = F.regexp_replace(text, r"\s*[년월]\s*", "-")
    text = F.regexp_replace(text, r"\s*일", "")
    return F.trim(F.regexp_replace(text, r"(?<=\d)\s*[./]\s*(?=\d)", "-"))


def timestamp(col: Column, kind: T.DataType) -> Column:
    """As timestamp from dates, ISO text, yyyyMMdd and the forms of date_text; null otherwise."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    text = date_text(col)
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    short = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("y-M-d")))
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("y-M")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text.try_cast("timestamp"))
    return F.coalesce(compact, short, month, iso)


def like_original(moment: Column, original: Column) -> Column:
    """A timestamp written the way the original text is."""
    text = F.trim(original.cast("string"))
    return (
        F.when(text.rlike(r"^\d{8}$"), F.date_format(moment, "yyyyMMdd"))
        .when(text.rlike(r"^\d{4}/"), F.date_format(moment, "yyyy/MM/dd"))
        .when(text.rlike(r"^\d{4}\."), F.date_format(moment, "yyyy.MM.dd"))
        .when(text.rlike(r"년"), F.date_format(moment, "yyyy년 MM월 dd일"))
        .when(text.rlike(r"[T ]\d{2}:"), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def lag_days(before: Column, after: Column) -> Column:
    return (F.unix_micros(after.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(86_400_000_000.0)


def elapsed_months(moment: Column, as_of: Column) -> Column:
    """Year and month difference; the day plays no part."""
    return (F.year(as_of) - F.year(moment)) * 12 + (F.month(as_of) - F.month(moment))


def shifted_years(moment: Column, years: int) -> Column:
    """The same day so many years on; 29 February falls to the 28th."""
    return F.add_months(moment, 12 * years)
