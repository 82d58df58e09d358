"""Band math on pixel columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilerain.schema import BASELINE_DATE, BASELINE_OFFSET, INDEX_NODATA, SAR_NODATA


def d(value) -> Column:
    return F.lit(float(value))


def db_scale(x: Column, nodata: float = SAR_NODATA) -> Column:
    """Power to dB; zero, negative and missing input becomes nodata."""
    return F.when(x > 0, d(10) * F.log10(x)).otherwise(d(nodata))


def db_to_power(x: Column, nodata: float = SAR_NODATA) -> Column:
    return F.when(x != d(nodata), F.pow(d(10), x / d(10))).otherwise(d(0))


def db_to_amplitude(x: Column) -> Column:
    return F.sqrt(F.pow(d(10), x / d(10)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, d(low)), d(high))


def reflectance(dn: Column, image_date: Column) -> Column:
    """Surface reflectance in [0, 1]; captures on or after the baseline date carry an additive offset."""
    offset = F.when(image_date >= F.lit(BASELINE_DATE).cast("date"), d(BASELINE_OFFSET)).otherwise(d(0))
    return clip((dn + offset) / d(10000))


def normalized_difference(a: Column, b: Column, nodata: float = INDEX_NODATA) -> Column:
    return F.when((a + b) != 0, (a - b) / (a + b)).otherwise(d(nodata))


def ndwi(green: Column, nir: Column, nodata: float = INDEX_NODATA) -> Column:
    return normalized_difference(green, nir, nodata)


def mndwi(green: Column, swir1: Column, nodata: float = INDEX_NODATA) -> Column:
    return normalized_difference(green, swir1, nodata)


def awei_sh(blue: Column, green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    return blue + d(2.5) * green - d(1.5) * (nir + swir1) - d(0.25) * swir2


def awei_nsh(green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    return d(4) * (green - swir1) - (d(0.25) * nir + d(2.75) * swir2)


def download_ndwi(green_dn: Column, nir_dn: Column, image_date: Column) -> Column:
    """Index from raw numbers: offset and clip only from the baseline on, missing where either band is 0."""
    later = image_date >= F.lit(BASELINE_DATE).cast("date")
    scaled = ndwi(reflectance(green_dn, image_date), reflectance(nir_dn, image_date))
    raw = ndwi(green_dn.cast("double"), nir_dn.cast("double"))
    return F.when((green_dn == 0) | (nir_dn == 0), d(INDEX_NODATA)).when(later, scaled).otherwise(raw)


def optical_missing(red_dn: Column, *indices: Column) -> Column:
    """Missing where the red number is 0 or any index is undefined."""
    missing = red_dn == 0
    for index in indices:
        missing = missing | (index == d(INDEX_NODATA))
    return missing


def blanked(index: Column, red_dn: Column) -> Column:
    """The index as it is exported: its missing value where the red number is 0."""
    return F.when(red_dn == 0, d(INDEX_NODATA)).otherwise(index)


# ---- fixed values: bands that each water index is computed from ----
INDEX_INPUTS = {"ndwi": ["green", "nir"], "mndwi": ["green", "swir1"], "awei_sh": ["blue", "green", "nir", "swir1", "swir2"],
                "awei_nsh": ["green", "nir", "swir1", "swir2"]}


def radar_missing(vv: Column, vh: Column, red_dn: Column) -> Column:
    return (vv == d(SAR_NODATA)) | (vh == d(SAR_NODATA)) | (red_dn == 0)


def selected_missing(selected: list[str], bands: dict[str, tuple[Column, Column]]) -> Column:
    """Union over the selected channels only; `bands` maps a channel to (its raw number or None, its index or None).

    An index is also missing where the raw number of any band that it is computed from is 0, so those must be in `bands`.
    """
    missing = F.lit(False)
    for name in selected:
        if name not in bands:
            continue
        dn, index = bands[name]
        if dn is not None:
            missing = missing | (dn == 0)
        if index is not None:
            missing = missing | (index == d(INDEX_NODATA))
        for band in INDEX_INPUTS.get(name, []):
            if band not in bands:
                raise ValueError(f"index {name!r} needs the raw numbers of {band!r}")
            missing = missing | (bands[band][0] == 0)
    return missing


def binarize(band: Column) -> Column:
    return F.when(band != 0, 1).otherwise(0)


def unit_byte(value: Column) -> Column:
    return value / d(255)


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def denormalize(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def clip_normalize(x: Column, low: float, high: float) -> Column:
    return clip((x - d(low)) / d(high - low))


def quantize(x: Column, low: Column, high: Column, levels: int = 64) -> Column:
    """Gray level 0..levels-1 with half-even rounding; a constant image is 0."""
    unit = clip((x - low) / (high - low))
    return F.when(low == high, F.lit(0)).otherwise(F.rint(unit * d(levels - 1)).cast("int"))


def sigmoid(x: Column) -> Column:
    return d(1) / (d(1) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable for large magnitudes of either sign."""
    return F.least(x, d(0)) - F.log1p(F.exp(-F.abs(x)))


def predicted(prob: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """Strict above the threshold for evaluation, inclusive for map production."""
    hit = prob >= d(threshold) if inclusive else prob > d(threshold)
    return F.when(hit, 1).otherwise(0)


def masked_prediction(pred: Column, missing: Column) -> Column:
    return F.when(missing, 0).otherwise(pred)


def export_bands(pred: Column) -> list[Column]:
    return [(pred * 255).cast("short").alias(f"band{i}") for i in (1, 2, 3)]


def error_maps(target: Column, pred: Column) -> list[Column]:
    return [((target == 0) & (pred == 1)).alias("false_positive"), ((target == 1) & (pred == 0)).alias("false_negative")]


def pair_shift(mapped: Column, source: Column, pixel: float = 10.0) -> Column:
    return (mapped - source) / d(pixel)
