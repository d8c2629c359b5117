"""Band algebra on pixel tables: reflectance, masks, spectral indices, circular variables, grey levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bands of a composite, the scale of their numbers, the scene classes that count as clear.
BANDS = ("b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12")
SCALE = 10_000
CLEAR = (4, 5, 6)
INDEX_NAMES = ("ndvi", "ndwi_mcf", "ndwi_gao", "mndwi", "bsi", "evi2", "ndre", "ndbi", "nbr2", "gvmi", "gli")


def clear(value: Column, scene_class: Column) -> Column:
    """The value where the scene class is clear; null under clouds, shadows, snow and without a class."""
    return F.when(scene_class.isin(*CLEAR), value)


def reflectance(df: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Digital numbers to reflectance, in place."""
    return df.withColumns({b: F.col(b) / SCALE for b in bands})


def normalised(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is zero."""
    return F.try_divide(a - b, a + b)


def spectral_indices(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    """The eleven indices over band columns named ``prefix`` + band + ``suffix``.

    A zero denominator gives null, as no comparison or average should meet an infinity.
    """
    b02, b03, b04, b05, _, _, b08, b8a, b11, b12 = (F.col(f"{prefix}{b}{suffix}") for b in BANDS)
    soil, green = b11 + b04, b08 + b02
    nir, red, swir = b08 / SCALE, b04 / SCALE, b12 / SCALE
    found = (
        normalised(b08, b04),
        normalised(b03, b08),
        normalised(b08, b11),
        normalised(b03, b11),
        normalised(soil, green),
        F.try_divide(2.5 * (nir - red), nir + 2.4 * red + 1),
        normalised(b8a, b05),
        normalised(b11, b08),
        normalised(b11, b12),
        normalised(nir + 0.1, swir + 0.02),
        normalised(2 * b03, b04 + b02),
    )
    return {f"{name}{suffix}": c for name, c in zip(INDEX_NAMES, found, strict=True)}


def circular(degrees: Column, name: str = "aspect") -> dict[str, Column]:
    """Sine and cosine of an angle in degrees, so that 359 and 1 are neighbours."""
    return {f"{name}_sin": F.sin(F.radians(degrees)), f"{name}_cos": F.cos(F.radians(degrees))}


def physical(blue: Sequence[Column], most: float = 0.40) -> Column:
    """Blue reflectance of at most ``most`` in every season; a null season fails."""
    return F.coalesce(reduce(and_, [c <= most for c in blue]), F.lit(False))


def complete(columns: Sequence[str]) -> Column:
    """No null among the columns."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns], F.lit(True))


def cloud_null(value: Column, blue: Column, most: float = 4000) -> Column:
    """Null where the blue number exceeds ``most``; a null blue keeps the value (P10)."""
    return F.when(blue > most, None).otherwise(value)


def grey_levels(value: Column, top: float = SCALE, levels: int = 32) -> Column:
    """0 .. levels - 1, rounded half to even and clamped."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.rint(value / top * (levels - 1)), F.lit(0.0)), F.lit(levels - 1.0))).cast("int")
