"""One-expression operators on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a pixel for each band, the reference grid, the scale of stored reflectance.
BAND_METRES = {
    "B02": 10, "B03": 10, "B04": 10, "B08": 10,
    "B05": 20, "B06": 20, "B07": 20, "B8A": 20, "B11": 20, "B12": 20,
    "B01": 60, "B09": 60, "B10": 60,
}
GRID_METRES, REFLECTANCE_SCALE, IGNORED = 10, 10_000, 0


def band_ratio(band: str) -> int:
    """Pixels of the reference grid along one side of a band's pixel; 1 for names that are no known band."""
    return BAND_METRES.get(band, GRID_METRES) // GRID_METRES


def patch_name(path: Column) -> Column:
    """``year, tile, patch_x, patch_y`` of a path ending in ``<year>_<tile>_patch_<x>_<y>.<suffix>``; null where it has another form."""
    stem = r"([^/_]+)_([^/_]+)_patch_([^/_]+)_([^/_.]+)(?:\.[^/]*)?$"
    part = lambda i: F.regexp_extract(path, stem, i)
    number = lambda i: part(i).try_cast("int")
    named = F.struct(number(1).alias("year"), part(2).alias("tile"), number(3).alias("patch_x"), number(4).alias("patch_y"))
    return F.when(path.rlike(stem), named)


def normalise(value: Column) -> Column:
    """Stored reflectance as a fraction."""
    return value / F.lit(float(REFLECTANCE_SCALE))


def map_label(raw: Column, classes: dict[int, int]) -> Column:
    """The class of a raw label; labels that aren't listed are class 0."""
    if not classes:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw.cast("int")), F.lit(0))


def argmax_class(logp: Column) -> Column:
    """Index of the largest entry, the first of equal ones; null for a null or empty array."""
    return F.when(F.size(logp) > 0, F.array_position(logp, F.array_max(logp)).cast("int") - 1)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0).cast("double"), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))
    return F.transform(logits, lambda x: x.cast("double") - top.cast("double") - F.log(total))


def error_code(label: Column, predicted: Column, parcel: bool = True) -> Column:
    """0 right, 1 wrong; with ``parcel``, 255 where the label is the ignored class."""
    wrong = (label != predicted).cast("int")
    return F.when(label == IGNORED, 255).otherwise(wrong) if parcel else wrong


def preview_byte(value: Column, top: Column) -> Column:
    """A band value as a byte of a picture whose largest value is ``top``; null where that is 0."""
    byte = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.try_divide(value, top) * 256))).cast("int")
    return F.when(value.isNotNull() & (top != 0), byte)


def class_weight(frequency: Column, classes: Column | int) -> Column:
    """Inverse to the class's frequency; classes that don't occur have none."""
    return F.when(frequency > 0, 1 / (classes * frequency)).otherwise(F.lit(0.0))


def blend_weight(weight: Column, alpha: float | None) -> Column:
    """Between no weighting (alpha 0) and full weighting (1); null alpha gives no weights."""
    return F.lit(None).cast("double") if alpha is None else weight * alpha + (1 - alpha)


def prior_logit(frequency: Column, floor: Column) -> Column:
    """The logit of a class's prior; frequencies below ``floor`` count as that."""
    f = F.greatest(frequency, floor)
    return -F.log((1 - f) / f)


def composite_name(freq: str, bands: Column | list[str], height: Column | int, width: Column | int) -> Column | str:
    """``<freq>_<bands>_<h>x<w>``; a text if all parts are plain values."""
    if isinstance(bands, list):
        return f"{freq}_{''.join(bands)}_{height}x{width}"
    number = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("string")
    return F.concat(F.lit(f"{freq}_"), F.array_join(bands, ""), F.lit("_"), number(height), F.lit("x"), number(width))


def interior(y: Column, x: Column, height: int, width: int, border: int = 5) -> Column:
    """True away from the border of a tile."""
    return (y >= border) & (y < height - border) & (x >= border) & (x < width - border)


def boxes_meet(x0: Column, x1: Column, y0: Column, y1: Column, west: float, east: float, south: float, north: float) -> Column:
    """Whether closed boxes share a point."""
    return (x0 <= east) & (x1 >= west) & (y0 <= north) & (y1 >= south)


def batches_expected(patches: Column, tiles_per_patch: Column, block: int, drop_last: bool = False) -> Column:
    whole = patches * tiles_per_patch / F.lit(block)
    return (F.floor(whole) if drop_last else F.ceil(whole)).cast("long")
