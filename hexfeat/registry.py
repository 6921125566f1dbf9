"""The feature registry: names, types, ranges and fills of the fused table. Its order is the column order of that table."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    type: str
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None
    fill: object = None
    lag: int = 0
    enabled: bool = True


SPARK_TYPES = {"string": T.StringType(), "float64": T.DoubleType(), "float32": T.FloatType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "datetime": T.TimestampNTZType()}

# Fixed values of the data model, in its order.
FEATURES = (
    Feature("grid_id", "identifiers", "string", nullable=False),
    Feature("region", "identifiers", "string", nullable=False),
    Feature("latitude", "identifiers", "float64", nullable=False, low=25, high=43),
    Feature("longitude", "identifiers", "float64", nullable=False, low=-125, high=-93),
    Feature("timestamp", "identifiers", "datetime", nullable=False),
    Feature("resolution_km", "identifiers", "int32", nullable=False, allowed=(1, 10, 22, 64)),
    Feature("temperature_2m", "weather", "float32", low=-50, high=65, fill="forward_fill"),
    Feature("relative_humidity_2m", "weather", "float32", low=0, high=100, fill="forward_fill"),
    Feature("wind_speed_10m", "weather", "float32", low=0, high=250, fill="forward_fill"),
    Feature("wind_direction_10m", "weather", "float32", low=0, high=360, fill="forward_fill"),
    Feature("precipitation", "weather", "float32", low=0, high=500, fill="zero"),
    Feature("soil_moisture_0_to_7cm", "weather", "float32", low=0, high=1, fill="forward_fill"),
    Feature("vpd", "weather", "float32", low=0, high=15, fill="forward_fill"),
    Feature("fire_weather_index", "weather", "float32", low=0, high=150, fill="forward_fill"),
    Feature("fuel_model_fbfm40", "vegetation", "int16", low=91, high=204),
    Feature("canopy_cover_pct", "vegetation", "float32", low=0, high=100),
    Feature("vegetation_type", "vegetation", "int16"),
    Feature("ndvi", "vegetation", "float32", low=-1, high=1, fill="forward_fill"),
    Feature("elevation_m", "topography", "float32", low=-100, high=4500),
    Feature("slope_degrees", "topography", "float32", low=0, high=90),
    Feature("aspect_degrees", "topography", "float32", low=0, high=360),
    Feature("active_fire_count", "fire_context", "int32", nullable=False, low=0, fill=0, lag=1),
    Feature("mean_frp", "fire_context", "float32", low=0, high=5000, fill=0.0, lag=1),
    Feature("median_frp", "fire_context", "float32", low=0, high=5000, fill=0.0, lag=1),
    Feature("max_confidence", "fire_context", "int8", low=0, high=100, fill=0, lag=1),
    Feature("nearest_fire_distance_km", "fire_context", "float32", low=-1, fill=-1.0, lag=1),
    Feature("fire_detected_binary", "fire_context", "int8", nullable=False, allowed=(0, 1), fill=0),
    Feature("days_since_last_precipitation", "derived", "int16", low=0, high=365),
    Feature("cumulative_wind_run_24h", "derived", "float32", low=0),
    Feature("drought_index_proxy", "derived", "float32", low=0, high=1),
    Feature("data_quality_flag", "metadata", "int8", nullable=False, fill=0),
    Feature("dominant_fuel_fraction", "metadata", "float32", low=0, high=1),
)


class Registry:
    def __init__(self, features: tuple[Feature, ...] = FEATURES):
        self.features = tuple(f for f in features if f.enabled)

    @classmethod
    def load(cls, path: str | Path) -> Registry:
        """From YAML: groups of feature entries in column order. A missing file raises FileNotFoundError."""
        import yaml

        groups = yaml.safe_load(Path(path).read_text())["features"]
        found = []
        for group, entries in groups.items():
            for e in entries:
                rule = e.get("validation") or {}
                allowed = rule.get("allowed_values")
                found.append(Feature(e["name"], group, e["type"].replace("datetime64[ns]", "datetime"), e.get("nullable", True), rule.get("min"), rule.get("max"), tuple(allowed) if allowed else None, e.get("fill_strategy", e.get("default_value")), int(e.get("temporal_lag") or 0), e.get("enabled", True)))
        return cls(tuple(found))

    def names(self, group: str | None = None, nullable: bool | None = None) -> list[str]:
        return [f.name for f in self.features if (group is None or f.group == group) and (nullable is None or f.nullable == nullable)]

    def lagged(self) -> list[str]:
        return [f.name for f in self.features if f.lag]

    def get(self, name: str) -> Feature | None:
        return next((f for f in self.features if f.name == name), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type], f.nullable) for f in self.features])

    def arranged(self, df: DataFrame, cast: bool = False) -> DataFrame:
        """All enabled features in order, absent ones as null, then the other columns of df."""
        have = set(df.columns)
        picked: list[Column] = [(F.col(f.name) if f.name in have and not cast else (F.col(f.name) if f.name in have else F.lit(None)).cast(SPARK_TYPES[f.type])).alias(f.name) for f in self.features]
        return df.select(*picked, *[c for c in df.columns if c not in set(self.names())])

    def filled(self, df: DataFrame) -> DataFrame:
        """Nulls of present columns by the feature's fill: `zero` and constants; forward fills need an order and are skipped here."""
        have = set(df.columns)
        fills = {f.name: 0 if f.fill == "zero" else f.fill for f in self.features if f.name in have and f.fill is not None and f.fill != "forward_fill"}
        return df.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in fills.items()})

    def empty(self, spark) -> DataFrame:
        return spark.createDataFrame([], self.schema())
