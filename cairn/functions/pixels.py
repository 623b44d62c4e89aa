"""Pixel operations on images as bytes and as tables with a row for each pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import can_shrink
from cairn.operators.facts import format_bytes, max_mip_levels


def shrink(pixels: DataFrame, image: Sequence[str], colours: Sequence[str], alpha: str, direction: str = "both", alpha_test: int | None = None) -> DataFrame:
    """Images of half the width, height or both: colours are means weighted by alpha, or plain means where all is clear; integers throughout.

    An image with an odd side above 1 that would be halved, and one whose such sides are all 1, can't be and stays as it is.
    A side of 1 stays beside one that is halved. alpha_test: where both sides are halved, alpha is weighted by itself, so that
    the share of pixels over that threshold holds about.
    """
    sides = pixels.groupBy(*image).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    sides = sides.withColumn("_ok", can_shrink(F.col("_w"), F.col("_h"), direction) == "Ok")
    each = pixels.join(sides, list(image))
    halved = {"x": direction != "vertical", "y": direction != "horizontal"}
    place = [F.when(F.col("_ok") & F.lit(halved[c]), F.expr(f"{c} div 2")).otherwise(F.col(c)).cast(pixels.schema[c].dataType).alias(c) for c in "xy"]
    a, inverse = F.col(alpha), None if alpha_test is None else (255 - alpha_test) ** 2
    sums = [F.sum(F.col(c) * a).alias(f"_w_{c}") for c in colours] + [F.sum(c).alias(f"_s_{c}") for c in colours]
    if alpha_test is not None:
        sums.append(F.sum(a * (a * alpha_test + inverse)).alias("_kept"))
    four = each.groupBy(*image, *place).agg(F.sum(alpha).alias("_a"), F.count("*").alias("_n"), *sums)
    mixed = [F.expr(f"CASE WHEN _a = 0 THEN _s_{c} div _n ELSE _w_{c} div _a END").alias(c) for c in colours]
    mean = "_a div _n" if alpha_test is None else f"CASE WHEN _n = 4 THEN _kept div greatest(_a * {alpha_test} + {inverse} * 4, 1) ELSE _a div _n END"
    return four.select(*image, "x", "y", *mixed, F.expr(mean).alias(alpha))


def with_smaller_mips(pixels: DataFrame, image: Sequence[str], colours: Sequence[str], alpha: str, levels: int, alpha_test: int | None = None) -> DataFrame:
    """Images with `level` 0 and as many smaller levels, each shrunk from the one before, as they can have; levels at most."""
    out = now = pixels.withColumn("level", F.lit(0))
    for n in range(1, levels + 1):
        able = now.groupBy(*image).agg((can_shrink(F.max("x") + 1, F.max("y") + 1) == "Ok").alias("_ok")).where("_ok").select(*image)
        now = shrink(now.join(able, list(image), "left_semi"), image, colours, alpha, "both", alpha_test).withColumn("level", F.lit(n))
        out = out.unionByName(now)
    return out


def shrunk_chain(mips: DataFrame, image: Sequence[str], colours: Sequence[str], alpha: str, direction: str = "both", alpha_test: int | None = None) -> DataFrame:
    """All levels (image, level, x, y, ...) of images at half the size; level 0 is the largest. The smallest level goes where there are more than the new size can have."""
    kept = shrink(mips, [*image, "level"], colours, alpha, direction, alpha_test)
    sizes = kept.groupBy(*image).agg(F.max(F.when(F.col("level") == 0, F.col("x") + 1)).alias("_w"), F.max(F.when(F.col("level") == 0, F.col("y") + 1)).alias("_h"), F.max("level").alias("_last"))
    sizes = sizes.select(*image, "_last", max_mip_levels(F.col("_w"), F.col("_h")).alias("_most"))
    return kept.join(sizes, list(image)).where("level < _last or _last < _most").drop("_last", "_most")


def any_external(mips: Column) -> Column:
    """Whether a level of a chain lies in another file."""
    return F.exists(mips, lambda m: m["external"].isNotNull())


def converted(images: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    """images (format, width, height, data) in another plain format; those that can't be decoded stay as they are."""
    size = pixel_bytes(F.col("format"))
    able = size.isNotNull() & fits(F.col("data"), F.col("format"), F.col("width"), F.col("height")) & (F.col("width") * F.col("height") > 0)
    new = imploded(exploded(images, keep), keep, name).withColumnRenamed("data", "_new")
    both = images.join(new, list(keep), "left")
    made = F.coalesce(able, F.lit(False)) & F.col("_new").isNotNull()
    return both.withColumns({"format": F.when(made, name).otherwise(F.col("format")), "data": F.when(made, F.col("_new")).otherwise(F.col("data"))}).drop("_new")


def replaced(textures: DataFrame, images: DataFrame, by: Sequence[str], name: str | None = None) -> DataFrame:
    """textures (format, width, height, mips by texture) with a new image (data, width, height): one texture is left, of one level, in the format given or its own."""
    new = images.select(*by, F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("data").alias("_d"))
    both = textures.join(new, list(by), "left")
    there = F.col("_d").isNotNull()
    kind = F.col("format") if name is None else F.when(there, name).otherwise(F.col("format"))
    one = F.when(there, F.array(F.array("_d"))).otherwise(F.col("mips"))
    return both.withColumns({"mips": one, "format": kind, "width": F.coalesce("_w", "width"), "height": F.coalesce("_h", "height")}).drop("_w", "_h", "_d")


#: Bytes of a pixel in each plain format, and where its channels stand; blocks aren't decoded.
CHANNELS = {
    "RawARGB32": {"b": 0, "g": 1, "r": 2, "a": 3},
    "AltARGB32": {"b": 0, "g": 1, "r": 2, "a": 3},
    "RawRGB24": {"b": 0, "g": 1, "r": 2},
    "AltRGB24": {"b": 0, "g": 1, "r": 2},
    "Grayscale": {"r": 0, "g": 0, "b": 0},
    "Alpha": {"a": 0},
}


def pixel_bytes(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in CHANNELS.items():
        out = F.when(name == k, 1 + max(v.values())).otherwise(out)
    return out


def fits(data: Column, name: Column, width: Column, height: Column) -> Column:
    """Whether an image has as many bytes as its format takes."""
    return F.length(data) == format_bytes(name, width, height)


def exploded(images: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, x, y, r, g, b, a for every pixel of images (format, width, height, data) in a plain format whose size fits.

    Colours without alpha are opaque, alpha without colour is black.
    """
    size = pixel_bytes(F.col("format"))
    good = images.where(size.isNotNull() & fits(F.col("data"), F.col("format"), F.col("width"), F.col("height")) & (F.col("width") * F.col("height") > 0))
    each = good.select(*keep, "format", "width", "data", size.alias("_size"), F.explode(F.sequence(F.lit(0), (F.col("width") * F.col("height") - 1).cast("int"))).alias("_i"))

    def channel(c: str, default: int):
        out = F.lit(default)
        for k, v in CHANNELS.items():
            if c in v:
                byte = F.conv(F.hex(F.substring("data", F.col("_i") * F.col("_size") + v[c] + 1, F.lit(1))), 16, 10).cast("int")
                out = F.when(F.col("format") == k, byte).otherwise(out)
        return out.alias(c)

    at = [F.expr("_i % width").cast("int").alias("x"), F.expr("_i div width").cast("int").alias("y")]
    return each.select(*keep, *at, channel("r", 0), channel("g", 0), channel("b", 0), channel("a", 255))


def imploded(pixels: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """by and `data`: pixels put together in a plain format, row by row; gray is the colours' mean, cut off."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    if name == "Grayscale":
        text = byte(F.expr("(r + g + b) div 3"))
    else:
        order = sorted(CHANNELS[name], key=CHANNELS[name].get)
        text = F.concat(*(byte(F.col(c)) for c in order))
    rows = pixels.withColumn("_p", F.struct("y", "x", text.alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["t"]), "")
    return rows.groupBy(*by).agg(F.unhex(joined).alias("data"))


def without_mips(mips: Column, largest: int = 0, smallest: int = 0) -> Column:
    """A mip chain, the smallest first, without so many of its largest and smallest levels."""
    return F.slice(mips, smallest + 1, F.greatest(F.size(mips) - largest - smallest, F.lit(0)))
