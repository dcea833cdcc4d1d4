"""Fixed names and shapes of the entry model."""

from pyspark.sql import types as T

# The entry categories, in their order.
CATEGORIES = ["person", "event", "place", "artifact", "pol_mil_organization",
              "business", "historical_period", "concepts", "other"]

# The columns of an entry text file, in file order.
ENTRY_COLUMNS = ["id", "title", "locations", "start_year", "start_month", "start_day",
                 "end_year", "end_month", "end_day", "start_expr", "end_expr", "calendar",
                 "uncertainty_years", "category", "infobox_type", "description", "tags"]

# Location kinds.
KINDS = ["point", "polygon", "multipolygon", "path", "circle"]

DEFAULT_LIMIT = 100

LNG_LAT = T.ArrayType(T.DoubleType())
RINGS = T.ArrayType(T.ArrayType(LNG_LAT))
WAYPOINT = T.StructType([
    T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
    T.StructField("t", T.DoubleType()), T.StructField("label", T.StringType())])

# One element of an entry's locations list, as it is written in JSON.
LOCATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
    T.StructField("centerLat", T.DoubleType()), T.StructField("centerLng", T.DoubleType()),
    T.StructField("radiusKm", T.DoubleType()),
    T.StructField("rings", RINGS), T.StructField("polygons", T.ArrayType(RINGS)),
    T.StructField("waypoints", T.ArrayType(WAYPOINT)),
    T.StructField("uncertain", T.BooleanType()), T.StructField("label", T.StringType())])
LOCATIONS = T.ArrayType(LOCATION)
