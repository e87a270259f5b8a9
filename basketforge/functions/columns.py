"""Small column helpers shared by the retail operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r(value: Column | str, digits: int = 6) -> Column:
    """A double rounded to ``digits``; just under a half goes up too, so that the last bit of a sum decides nothing."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.floor(value * 10**digits + 0.5001) / float(10**digits)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long, and doubles rounded, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(r(f.name, digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)


def entropy(probabilities: Column) -> Column:
    """Shannon entropy (natural log) of an array of probabilities; zeros are dropped."""
    return F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log(p))


def fix_width(values: Column, width: int) -> Column:
    """An array of doubles cut or padded with zeros to ``width``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), width)), 1, width)


def category_path(*levels: str) -> Column:
    return F.concat_ws("/", *levels)


def spelled(values: Column | str, digits: int = 6) -> Column:
    """All numbers of a vector as text: whole multiples of 10^-digits, rounded as ``r`` does, with commas between."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(values, lambda x: F.floor(x * 10**digits + 0.5001).cast("long").cast("string")), ",")


def safe_name(text: str) -> str:
    """A column name made of a category label."""
    return text.replace(" ", "_").lower() if text else "unknown"
