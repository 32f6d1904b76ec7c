"""Group labels of any kind as dense or given whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType

from rillmark.operators.batch import ROW, number_rows
from rillmark.sources.staging import joined_by_count, staged

CLOSE = 1e-6


def _numbers(df: DataFrame, label: str) -> tuple[Column, Column]:
    """The whole number that a label is, and whether it is one."""
    kind, c = df.schema[label].dataType, F.col(label)
    if isinstance(kind, (IntegralType, BooleanType)):
        return c.cast("long"), F.lit(True)
    if isinstance(kind, (FloatType, DoubleType)):
        x = c.cast("double")
        fine = F.abs(x - F.rint(x)) <= CLOSE
        return F.when(fine & (F.abs(x) < 9e18), F.rint(x)).cast("long"), F.coalesce(fine, F.lit(False)) & (F.abs(x) < 9e18)
    text = F.trim(c.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("long")
    return whole, whole.isNotNull()


def group_codes(rows: DataFrame, label: str, out: str = "group_id") -> DataFrame:
    """``rows`` with a whole number for every label, the same for equal ones.

    If every label of the table is a whole number (or within 1e-6 of one, or such a number as text),
    those numbers are the codes; if any is not, labels stay as they are ("0042" and "42" differ) and
    their codes are their ranks, from 0.  Null labels are one group: null where codes are
    numbers, the last rank otherwise.  Numbers rank as numbers.  Ranks come from range partitions of the distinct labels, and
    go back by a join that broadcasts the few heavy labels only.
    """
    number, is_number = _numbers(rows, label)
    if rows.where(F.col(label).isNotNull() & ~is_number).isEmpty():
        return rows.withColumn(out, number)
    text = F.col(label).cast("string")
    keyed = rows.withColumn("__label", F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("l"), text)))
    counts = staged(keyed.groupBy("__label").agg(F.min(label).alias("__label_value"), F.count("*").alias("__count")))
    total = counts.agg(F.sum("__count")).first()[0]
    ranks = staged(number_rows(counts, F.col("__label_value").isNull(), "__label_value").withColumnRenamed(ROW, "__rank"))
    joined = joined_by_count(keyed, ranks, "__label", "__count", total, "__rank")
    return joined.select(*rows.columns, F.col("__rank").alias(out))
