"""Boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box of 0..1000 in pixels: corners ordered, rounded half to even."""
    x = [box[i] * ((width if i % 2 == 0 else height) / 1000.0) for i in range(4)]
    return F.array(*[F.rint(e).cast("int") for e in (F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))])


def parse_box(text: Column) -> Column:
    """Four numbers, apart by blanks or commas, cut to whole ones; null for anything else."""
    parts = F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double").cast("int"))
    return F.when((F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def clamp_page(index: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, pages - 1))


def scale(page: Column, image: Column) -> Column:
    """Page points per image pixel; 1 where the image has no extent."""
    return F.when(image == 0, F.lit(1.0)).otherwise(page / image)


def to_points(box: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A box in image pixels in points of its page: scaled, not flipped, corners ordered."""
    sx, sy = scale(page_width, width), scale(page_height, height)
    x, y = [box[i] * sx for i in (0, 2)], [box[i] * sy for i in (1, 3)]
    return F.array(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))
