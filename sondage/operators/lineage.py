"""What was done to each row: ordered steps that operators append to, JSON both ways, corrections refused the second time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<step:string,parameters:map<string,string>>>"
#: Column of the steps.
LINEAGE = "lineage"


def steps(rows: DataFrame) -> Column:
    """The steps of each row; none where the column isn't there or null."""
    return F.coalesce(F.col(LINEAGE), F.array().cast(KIND)) if LINEAGE in rows.columns else F.array().cast(KIND)


def with_step(rows: DataFrame, step: str, **parameters) -> DataFrame:
    """``rows`` with one more step at the end; parameters are kept as text, columns by the row's value."""
    said = {k: v.cast("string") if isinstance(v, Column) else F.lit(None if v is None else str(v)) for k, v in parameters.items()}
    given = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]) if said else F.create_map()
    one = F.struct(F.lit(step).alias("step"), given.cast("map<string,string>").alias("parameters"))
    return rows.withColumn(LINEAGE, F.concat(steps(rows), F.array(one)))


def has_step(rows: DataFrame, *names: str) -> Column:
    """Whether a row has had one of the steps."""
    return F.exists(steps(rows), lambda s: s["step"].isin(*names))


def once(rows: DataFrame, step: str, *others: str, **parameters) -> DataFrame:
    """As ``with_step``; the job fails at a row that has had the step, or one of ``others`` that it repeats, already."""
    before = F.concat_ws(", ", F.transform(F.filter(steps(rows), lambda s: s["step"].isin(step, *others)), lambda s: s["step"]))
    refused = F.raise_error(F.concat(F.lit(f"{step} refused, the row has had: "), before)).cast(KIND)
    checked = F.when(has_step(rows, step, *others), refused).otherwise(steps(rows))
    return with_step(rows.withColumn(LINEAGE, checked), step, **parameters)


def to_json(rows: DataFrame) -> DataFrame:
    """The steps as JSON text, for formats without nested columns; no steps are an empty list."""
    return rows.withColumn(LINEAGE, F.to_json(steps(rows)))


def from_json(rows: DataFrame) -> DataFrame:
    """Steps of JSON text; null gives none, text that isn't a list of steps fails the job."""
    read = F.from_json(LINEAGE, KIND)
    bad = F.raise_error(F.concat(F.lit("not a lineage: "), F.col(LINEAGE))).cast(KIND)
    return rows.withColumn(LINEAGE, F.when(F.col(LINEAGE).isNull(), F.array().cast(KIND)).when(read.isNull(), bad).otherwise(read))


def described(rows: DataFrame) -> DataFrame:
    """(lineage, n): the distinct lineages of a table, for a report."""
    return to_json(rows).groupBy(LINEAGE).agg(F.count(F.lit(1)).alias("n"))
