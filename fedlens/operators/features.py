"""Feature transforms on square pictures stored as flat arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fedlens.functions.hashing import uniform

# Mean and deviation used to standardise pixels, the same for both datasets.
PIXEL_MEAN = 0.1307
PIXEL_STD = 0.3081


def normalize(features: Column, mean: float = PIXEL_MEAN, std: float = PIXEL_STD) -> Column:
    return F.transform(features, lambda x: (x - F.lit(mean)) / F.lit(std))


def crop_offsets(seed: int, padding: int, id_col: str = "sample_id") -> tuple[Column, Column]:
    """Row and column offset of a random crop out of the padded picture."""
    pick = lambda tag: F.floor(uniform(seed, tag, id_col) * F.lit(2 * padding + 1)).cast("int")
    return pick("crop-row"), pick("crop-col")


def flip_drawn(seed: int, id_col: str = "sample_id") -> Column:
    return uniform(seed, "hflip", id_col) < F.lit(0.5)


def crop_and_flip(features: Column, side: int, padding: int, dy: Column, dx: Column, flip: Column) -> Column:
    """Random crop of the zero-padded picture, then an optional horizontal flip.

    Whole picture rows are moved: a shifted row is its kept slice between two runs of zeros.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    shift = dx - F.lit(padding)
    skipped, blank = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))

    def picture_row(row: Column) -> Column:
        source = row + dy - F.lit(padding)
        kept = F.slice(features, (source * side + skipped + 1).cast("int"), (F.lit(side) - F.abs(shift)).cast("int"))
        moved = F.concat(zeros(blank), kept, zeros(skipped))
        inside = source.between(0, side - 1) & (F.abs(shift) < side)
        return F.when(inside, F.when(flip, F.reverse(moved)).otherwise(moved)).otherwise(zeros(F.lit(side)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), picture_row))
