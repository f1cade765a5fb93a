"""Font size, wrapping and baselines of a text in its box, with the width of 0.55 em a character that needs no font file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.geometry import scale
from leafwork.functions.text import font_of, split_lines, strip

EM = 0.55
FILL = 1.01
# Ink height, line height and rise of ink above the baseline, per em (fixed values).
METRICS = {"helv": (0.90, 1.374, 0.72), "china-s": (0.90, 1.309, 0.80), "japan": (0.90, 1.309, 0.80), "korea": (0.90, 1.309, 0.80)}
# The same for a font without a row (fixed values).
DEFAULT = (0.90, 1.30, 0.75)
MARGIN, STEPS = 2, 12


def _metric(font: Column, i: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in METRICS.items() for x in (k, v[i])]), font), F.lit(DEFAULT[i]))


def width(chars: Column, size: Column) -> Column:
    return chars * size * EM


def font_size(lines: Column, w: Column, h: Column, ink: Column, leading: Column) -> Column:
    """The size at which a text fills its box: by height, by width for a single squeezed line, else where the wrapped lines fill it."""
    chars = F.transform(lines, lambda x: F.length(x).cast("double"))
    widest, n = F.array_max(chars), F.size(lines)
    fixed = h / (n * leading)
    many = F.greatest(F.lit(0.5), F.when(width(widest, fixed) > w, fixed * w / width(widest, fixed)).otherwise(fixed))
    one, by_height = chars[0], h / ink
    squeezed = F.greatest(F.lit(0.5), by_height * w / width(one, by_height))
    state = F.struct(F.sqrt(w * h / (one * EM * leading)).alias("size"), F.lit(False).alias("end"), F.lit(False).alias("single"))

    def step(s, _):
        k = F.greatest(F.lit(1.0), F.ceil(width(one, s["size"]) / w - 1e-9).cast("double"))
        new = h / (k * leading)
        single = k == 1
        return F.when(s["end"], s).otherwise(F.struct(F.when(single, s["size"]).otherwise(new).alias("size"), (single | (F.abs(new - s["size"]) < 0.2)).alias("end"), single.alias("single")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step, lambda s: F.when(s["single"], squeezed).otherwise(F.greatest(s["size"], F.lit(0.5))))
    single = F.when(one == 0, F.greatest(by_height, F.lit(1.0))).when(width(one, by_height) <= w * FILL, F.greatest(by_height, F.lit(1.0))).otherwise(done)
    return F.when(h <= 0, F.lit(8.0)).when(w <= 0, F.greatest(by_height, F.lit(1.0))).when(n > 1, many).otherwise(single)


def wrap(lines: Column, w: Column, size: Column) -> Column:
    """Lines broken after as many characters as fit; an empty line stays, and one character always goes on a line."""
    k = F.greatest(F.lit(1), F.floor(w * FILL / (size * EM) + 1e-9).cast("int"))

    def cut(x):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x)), k)
        return F.when((F.length(x) == 0) | (w <= 0), F.array(x)).otherwise(F.transform(starts, lambda s: F.substring(x, s, k)))

    return F.flatten(F.transform(lines, cut))


def layout(blocks: DataFrame, *keep: str) -> DataFrame:
    """``font``, ``derived``, ``size``, ``lines`` (``text``, ``x``, ``baseline``) of blocks with ``text``, ``font_scale``, corners ``x1`` to ``y2`` in image pixels, the image's ``width``
    and ``height`` and the page's ``page_width`` and ``page_height`` in points. A box is scaled, not flipped, its corners ordered and its right edge held
    ``MARGIN`` off the page's; a box without width takes all that is left. Blank text has no lines and size 0."""
    b = blocks.withColumn("font", font_of(F.coalesce("text", F.lit("")))).withColumn("raw", split_lines(F.coalesce(F.substring("text", 1, 2000), F.lit(""))))
    sx, sy = scale(F.col("page_width"), F.col("width")), scale(F.col("page_height"), F.col("height"))
    b = b.withColumns({"left": F.least("x1", "x2") * sx, "right": F.greatest("x1", "x2") * sx, "top": F.least("y1", "y2") * sy, "h": (F.greatest("y1", "y2") - F.least("y1", "y2")) * sy})
    room = F.col("page_width") - F.col("left") - MARGIN
    wide = F.col("right") - F.col("left")
    b = b.withColumns({"w": F.when(wide > 0, F.least(wide, room)).otherwise(room), "ink": _metric(F.col("font"), 0), "leading": _metric(F.col("font"), 1), "up": _metric(F.col("font"), 2)})
    b = b.withColumn("blank", strip(F.coalesce(F.substring("text", 1, 2000), F.lit(""))) == "")
    b = b.withColumn("derived", font_size(F.col("raw"), F.col("w"), F.col("h"), F.col("ink"), F.col("leading")))
    gain = F.when(F.col("font_scale") > 0, F.col("font_scale")).otherwise(F.lit(1.0))
    b = b.withColumn("gain", gain).withColumn("size", F.greatest(F.col("derived") * F.col("gain"), F.lit(0.5)))
    b = b.withColumn("wrapped", wrap(F.col("raw"), F.col("w"), F.col("size")))
    total = F.size("wrapped") * F.col("size") * F.col("leading")
    over = (F.col("gain") == 1) & (F.size("wrapped") > 1) & (F.col("h") > 0) & (total > F.col("h") * 1.1)
    b = b.withColumn("size", F.when(over, F.greatest(F.col("size") * F.col("h") / total, F.lit(0.5))).otherwise(F.col("size")))
    b = b.withColumn("wrapped", wrap(F.col("raw"), F.col("w"), F.col("size")))
    n, step = F.size("wrapped"), F.col("size") * F.col("leading")
    ink = F.when(n > 1, (n - 1) * step).otherwise(0.0) + F.col("ink") * F.col("size")
    b = b.withColumn("y0", F.col("top") + (F.col("h") - ink) / 2 + F.col("up") * F.col("size")).withColumn("step", step)
    lines = F.transform("wrapped", lambda x, i: F.struct(x.alias("text"), F.col("left").alias("x"), (F.col("y0") + i * F.col("step")).alias("baseline")))
    return b.select(*keep, "font", *[F.when(F.col("blank"), 0.0).otherwise(F.col(c)).alias(c) for c in ("derived", "size")], F.when(F.col("blank"), F.slice(lines, 1, 0)).otherwise(lines).alias("lines"))
