"""Column expressions on gray values and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col


def gray(r, g, b) -> Column:
    return F.bround(col(r) * 0.299 + col(g) * 0.587 + col(b) * 0.114).cast("int")


def inverted(v) -> Column:
    return 255 - col(v)


def white_above(v, threshold) -> Column:
    return F.when(col(v) > col(threshold), 255).otherwise(0)


def darkened(v, on, share) -> Column:
    """A value that loses ``share`` (cut to 0 to 1) where ``on`` holds."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(share).cast("double")))
    return F.when(col(on), (col(v) * (1 - s)).cast("int")).otherwise(col(v))


def padding(width, height, tile: int) -> tuple[Column, Column]:
    """What a cut-out lacks on the right and at the bottom."""
    return F.greatest(F.lit(0), F.lit(tile) - col(width)), F.greatest(F.lit(0), F.lit(tile) - col(height))


def heat(similarity, contrast: float = 0.2) -> Column:
    """Similarities stretched so that 1 - contrast is cold and 1 hot."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(similarity) - (1 - contrast)) / contrast))
