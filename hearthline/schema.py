"""Canonical record types and their completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


LISTING = (
    "id bigint, source_platform string, source_id string, source_url string, title string, description string, city string,"
    " neighborhood string, address string, latitude double, longitude double, price_mad double, price_per_m2 double,"
    " surface_m2 double, rooms int, bedrooms int, bathrooms int, property_type string, amenities array<string>,"
    " features array<string>, image_urls array<string>, main_image_url string, images_downloaded boolean, agent_name string,"
    " agent_phone string, is_active boolean, scraped_at timestamp, updated_at timestamp, has_geolocation boolean,"
    " has_images boolean, data_quality_score double"
)
ENRICHMENT = (
    "listing_id bigint, distance_to_city_center double, distance_to_nearest_school double, distance_to_nearest_hospital double,"
    " distance_to_nearest_metro double, distance_to_beach double, distance_to_airport double, walkability_score double,"
    " schools_count_1km int, restaurants_count_1km int, shops_count_1km int, parks_count_1km int,"
    " neighborhood_income_level string, osm_data map<string,double>, data_sources array<string>, enriched_at timestamp"
)
IMAGE = (
    "listing_id bigint, original_url string, storage_path string, local_path string, width int, height int, file_size_bytes int,"
    " format string, room_type string, is_exterior boolean, quality_score double, download_error string, downloaded_at timestamp"
)
INGEST_LOG = (
    "session_id string, platform string, city string, listings_found int, listings_new int, listings_updated int, errors_count int,"
    " at timestamp, status string, error_message string"
)


def conform(df: DataFrame, schema: str = LISTING, keep_extra: bool = True, defaults: dict | None = None) -> DataFrame:
    """Cast the columns of ``schema`` that are present, add the others (NULL, or their default), and turn NaN into NULL."""
    fields = _struct(schema) if isinstance(schema, str) else schema
    if not isinstance(fields, T.StructType):
        raise TypeError("schema must be a struct")
    out = []
    for f in fields.fields:
        if f.name not in df.columns:
            out.append(F.lit(None if defaults is None else defaults.get(f.name)).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast(f.dataType).alias(f.name))
    named = {f.name for f in fields.fields}
    return df.select(*out, *([f"`{c}`" for c in df.columns if c not in named] if keep_extra else []))


def create_tables(spark, database: str = "default") -> None:
    """The storage tables, if they are not there yet."""
    for name, schema in (("listings", LISTING), ("listing_enrichments", ENRICHMENT), ("listing_images", IMAGE), ("ingest_log", INGEST_LOG)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def to_json_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Arrays, maps and structs (or the given columns) as JSON text, as a database keeps them; NULL stays NULL."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))] if columns is None else columns
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})


def from_json_columns(df: DataFrame, schema: str = LISTING) -> DataFrame:
    """The nested columns of ``schema`` out of JSON text; text that doesn't parse becomes NULL."""
    nested = {f.name: f.dataType for f in _struct(schema).fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name in df.columns}
    return df.withColumns({c: F.from_json(F.col(f"`{c}`"), t) for c, t in nested.items() if isinstance(df.schema[c].dataType, T.StringType)})
