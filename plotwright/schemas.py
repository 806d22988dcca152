"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw headers in file order, and the cleaned names in the same order.
RAW_COLUMNS = "UniqueID ParcelID LandUse PropertyAddress SaleDate SalePrice LegalReference SoldAsVacant OwnerName OwnerAddress Acreage TaxDistrict LandValue BuildingValue TotalValue YearBuilt Bedrooms FullBath HalfBath".split()
CLEAN_COLUMNS = "unique_id parcel_id land_use property_address sale_date sale_price legal_reference sold_as_vacant owner_name owner_address acreage tax_district land_value building_value total_value year_built bedrooms full_bath half_bath".split()
NUMERIC_COLUMNS = "acreage land_value building_value total_value year_built bedrooms full_bath half_bath".split()
# The business key of a sale.
SALE_KEY = ["parcel_id", "property_address", "sale_price", "sale_date", "legal_reference"]


KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "point": T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])}


def fields(spec: str) -> T.StructType:
    """A schema from pairs of name and kind; needs no session."""
    return T.StructType([T.StructField(*(lambda n, k: (n, KINDS[k]))(*x.split())) for x in spec.split(", ")])


RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
SNAPSHOT = T.StructType([T.StructField(c, T.LongType() if c == "unique_id" else T.StringType()) for c in CLEAN_COLUMNS])
ADDRESSES = fields(
    "address_id long, address string, city string, state_validated boolean, validation_notes string, latitude double, longitude double, corrected_address string, geocode_confidence double, geocode_source string, geocode_status string, geocoded_at timestamp_ntz, last_updated timestamp_ntz, address_hash string, geom point, address_standardized string"
)
MAPPINGS = fields("mapping_id long, housing_id long, address_id long, address_type string")
CORRECTION_LOG = fields("id long, address_id long, original_value string, new_value string, field_changed string, changed_by string, changed_at timestamp_ntz, reason string")
USAGE = fields("id long, api_name string, request_date date, request_count long, last_updated timestamp_ntz, window_started_at timestamp_ntz")
ISSUES = fields("unique_id long, address1 string, address2 string, issue_type string")
GEOCODE_RESULT = fields("success boolean, latitude double, longitude double, corrected_address string, confidence double, source string, status string, message string, raw_response string")
EXPORT_COLUMNS = [*CLEAN_COLUMNS, "currency_code", "property_address_imputed", "owner_address_imputed"]
POINT_COLUMNS = ["latitude", "longitude", "geocode_source", "geocode_confidence"]
OWNER_COLUMNS = [f"owner_{c}" for c in POINT_COLUMNS]
EXPORTED = [*EXPORT_COLUMNS, *[f"property_{c}" for c in POINT_COLUMNS], *OWNER_COLUMNS]
STATUSES = ["GEOCODED", "FAILED", "MANUALLY_CORRECTED"]
SOURCES = ["OSM", "HERE"]
