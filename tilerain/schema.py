"""Explicit table schemas, sentinels and class dimensions."""

from pyspark.sql import types as T

# ---- fixed values: sentinels and processing constants of the data products ----
SAR_NODATA = -9999.0
INDEX_NODATA = -999999.0
PRECIP_NODATA = -9999.0
NLCD_NODATA = 250
BASELINE_DATE = "2022-01-25"
BASELINE_OFFSET = -1000.0
CUBE_START = "2016-08-01"
CLOUD_CLASSES = [8, 9]

# ---- fixed values: land-cover codes and their evaluation groups ----
NLCD_CLASSES = [11, 12, 21, 22, 23, 24, 31, 41, 42, 43, 51, 52, 71, 72, 73, 74, 81, 82, 90, 95]
NLCD_GROUPS = {
    "water": [11],
    "urban": [21, 22, 23, 24],
    "forest": [41, 42, 43],
    "cultivated": [81, 82],
    "shrubland": [51, 52],
    "wetlands": [90, 95],
    "barren": [31],
    "herbaceous": [71, 72, 73, 74],
    "ice/snow": [12],
}

# ---- fixed values: scene-classification codes and their evaluation groups ----
SCL_CLASSES = list(range(12))
SCL_GROUPS = {
    "topographic shadow": [2],
    "cloud shadow": [3],
    "vegetation": [4],
    "not vegetated": [5],
    "water": [6],
    "cloud": [8, 9],
    "cirrus": [10],
}

# ---- fixed values: display colors by class code ----
NLCD_COLORS = {
    11: "#486da2", 12: "#e7effc", 21: "#e1cdce", 22: "#dc9881", 23: "#f10100", 24: "#ab0101",
    31: "#b3afa4", 41: "#6ca966", 42: "#1d6533", 43: "#bdcc93", 51: "#b19943", 52: "#d1bb82",
    71: "#edeccd", 72: "#d0d181", 73: "#a4cc51", 74: "#82ba9d", 81: "#ddd83d", 82: "#ae7229",
    90: "#bbd7ed", 95: "#71a4c1", 250: "#000000",
}
SCL_COLORS = {
    0: "#000000", 1: "#ff0000", 2: "#2f2f2f", 3: "#643200", 4: "#00a000", 5: "#ffe65a",
    6: "#0000ff", 7: "#808080", 8: "#c0c0c0", 9: "#ffffff", 10: "#64c8ff", 11: "#ff96ff",
}

# ---- fixed values: hydrography feature codes kept for flowlines / dropped for waterbodies ----
FLOWLINE_FCODES = [46000, 46003, 46006, 46007, 55800, 33600, 33601, 33603, 33400, 42801, 42802, 42805, 42806, 42809]

# ---- fixed values: channel order of the two model inputs ----
S2_CHANNELS = ["red", "green", "blue", "nir", "swir1", "swir2", "ndwi", "mndwi", "awei_sh", "awei_nsh",
               "dem", "slope_y", "slope_x", "waterbody", "roads", "flowlines"]
SAR_CHANNELS = ["vv", "vh", "dem", "slope_y", "slope_x", "waterbody", "roads", "flowlines"]

CLASS_SYSTEMS = {
    "nlcd": (NLCD_CLASSES, NLCD_GROUPS, NLCD_COLORS),
    "scl": (SCL_CLASSES, SCL_GROUPS, SCL_COLORS),
}

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy")])

CELL_DAY = T.StructType([
    T.StructField("t", T.IntegerType()), T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()), T.StructField("precip", T.DoubleType()),
])

SCENE = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("sensor", T.StringType()),
    T.StructField("dt", T.TimestampNTZType()), T.StructField("crs", T.StringType()),
    T.StructField("bbox", BBOX), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("assets", T.MapType(T.StringType(), T.StringType())), T.StructField("ord", T.LongType()),
])

TILE = T.StructType([
    T.StructField("tile_id", T.LongType()), T.StructField("channel", T.StringType()),
    T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.FloatType())),
])

PATCH = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("tile_id", T.LongType()),
    T.StructField("x0", T.IntegerType()), T.StructField("y0", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("channels", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
])

SPLIT = T.StructType([
    T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("split", T.StringType()),
])

HOMOGENEOUS_PATCH = T.StructType([T.StructField(n, T.IntegerType()) for n in ("y", "x", "i", "j")])

CONTROL_POINT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mapX", "mapY", "sourceX", "sourceY")])

EVENT_METADATA_FIELDS = T.StructType([
    T.StructField("Sample ID", T.StringType()), T.StructField("Precipitation Event Date", T.StringType()),
    T.StructField("CRS", T.StringType()), T.StructField("State", T.StringType()),
    T.StructField("Bounding Box", BBOX),
])
EVENT_METADATA = T.StructType(
    EVENT_METADATA_FIELDS.fields + [T.StructField("metadata", EVENT_METADATA_FIELDS)])


def class_group(system: str) -> dict[int, str]:
    groups = CLASS_SYSTEMS[system][1]
    return {code: name for name, codes in groups.items() for code in codes}


def class_rgb(system: str) -> dict[int, tuple[int, int, int]]:
    """Channels scale hex to the unit interval and truncate back to 0..255."""
    def scaled(hexa: str) -> tuple[int, int, int]:
        return tuple(int(255 * (int(hexa[i:i + 2], 16) / 255)) for i in (1, 3, 5))
    return {code: scaled(hexa) for code, hexa in CLASS_SYSTEMS[system][2].items()}
