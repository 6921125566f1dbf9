"""Data quality: the registry compiled to one wide aggregate, reported as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry

MAX_NULLS, MIN_DISTINCT, ROW_TOLERANCE = 0.15, 0.99, 0.05
_FAMILIES = {"float": ("double", "float"), "int": ("int", "bigint", "smallint", "tinyint"), "string": ("string",)}


def validate_schema(df: DataFrame, registry: Registry, expected_rows: int | None = None) -> DataFrame:
    """expectation, column_name, success and observed of every expectation, from one pass over df."""
    types = dict(df.dtypes)
    checks: list[tuple[str, str, Column, Column]] = []

    def add(expectation: str, column: str, success: Column, observed: Column) -> None:
        checks.append((expectation, column, success, observed.cast("double")))

    n = F.count("*")
    for f in registry.features:
        add("exists", f.name, F.lit(f.name in types), F.lit(float(f.name in types)))
        if f.name not in types:
            continue
        c = F.col(f.name)
        family = next((v for k, v in _FAMILIES.items() if f.type.startswith(k)), None)
        if family:
            add("type", f.name, F.lit(types[f.name] in family), F.lit(float(types[f.name] in family)))
        numeric = types[f.name] in _FAMILIES["float"] + _FAMILIES["int"]
        if numeric and (f.low is not None or f.high is not None):
            out = F.count_if((c < F.lit(f.low) if f.low is not None else F.lit(False)) | (c > F.lit(f.high) if f.high is not None else F.lit(False)))
            add("range", f.name, out == 0, out)
        if f.allowed:
            out = F.count_if(~c.isin(*f.allowed))
            add("allowed", f.name, out == 0, out)
        nulls = F.count_if(c.isNull())
        if f.nullable:
            add("mostly_present", f.name, (nulls <= MAX_NULLS * n) | (n == 0), nulls)
        else:
            add("not_null", f.name, nulls == 0, nulls)
    if "grid_id" in types:
        distinct, known = F.count_distinct("grid_id"), F.count("grid_id")
        add("unique", "grid_id", (known == 0) | (distinct >= MIN_DISTINCT * known), distinct)
    if expected_rows is not None:
        add("row_count", "", F.abs(n - expected_rows) <= ROW_TOLERANCE * expected_rows, n)
    wide = df.agg(F.array(*[F.struct(F.lit(e).alias("expectation"), F.lit(c).alias("column_name"), s.alias("success"), o.alias("observed")) for e, c, s, o in checks]).alias("rows"))
    return wide.select(F.explode("rows").alias("x")).select("x.*")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature and null_rate, six decimals."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias("null_rate")) for c in columns])
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("x")).select("x.*")
