"""Image quality: metadata, corruption, blur, exposure and perceptual hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Quality limits, and file signatures with their format.
BLUR_BELOW = 100.0
OVEREXPOSED_ABOVE = 240.0
UNDEREXPOSED_BELOW = 15.0
SIGNATURES = (
    ("89504E47", "PNG"),
    ("FFD8FF", "JPEG"),
    ("47494638", "GIF"),
    ("424D", "BMP"),
)

_METRICS = "path string, width int, height int, channels int, blur_score double, exposure_mean double, exposure_std double, phash string"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from plumbob.functions.pixels import gray, perceptual_hash, sharpness

    for batch in batches:
        out = []
        for path, height, width, channels, data in batch.itertuples(index=False, name=None):
            if height <= 0 or width <= 0:
                out.append((path, 0, 0, 0, 0.0, 0.0, 0.0, ""))
                continue
            image = gray(data, height, width, channels)
            out.append(
                (path, width, height, channels, sharpness(image), float(image.mean()), float(image.std()), perceptual_hash(image))
            )
        yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "blur_score", "exposure_mean", "exposure_std", "phash"])


def measure_images(images: DataFrame) -> DataFrame:
    """Pixel metrics per decoded image, without a shuffle.

    ``images`` has the columns of Spark's image schema: ``origin, height, width,
    nChannels, data``. Undecodable images have a width of -1.
    """
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(_measure, _METRICS)


def image_profile(metrics: DataFrame) -> DataFrame:
    """Flags and derived metadata from measured metrics.

    ``format``, ``file_size_bytes`` and the colour ``mode`` are taken from the
    input when present; a mode follows from the decoded channels otherwise.
    """
    corrupt = F.col("width") <= 0
    decoded = F.when(F.col("channels") == 1, "L").when(F.col("channels") == 3, "RGB").otherwise("RGBA")
    mode = F.coalesce("mode", decoded) if "mode" in metrics.columns else decoded
    bands, depth = (F.create_map(*(F.lit(x) for e in table.items() for x in e)) for table in (BANDS, DEPTHS))
    unless = lambda c: F.when(corrupt, False).otherwise(c)
    has = lambda name, default: F.col(name) if name in metrics.columns else default
    return metrics.select(
        "path",
        F.when(corrupt, "unknown").otherwise(has("format", F.lit("unknown"))).alias("format"),
        "width",
        "height",
        F.when(corrupt, F.col("channels")).otherwise(F.coalesce(bands[mode], F.col("channels"))).alias("channels"),
        has("file_size_bytes", F.lit(None).cast("bigint")).alias("file_size_bytes"),
        F.round(F.col("width").cast("double") * F.col("height") / 1_000_000, 2).alias("megapixels"),
        corrupt.alias("is_corrupt"),
        F.round("blur_score", 2).alias("blur_score"),
        unless(F.col("blur_score") < BLUR_BELOW).alias("is_blurry"),
        F.round("exposure_mean", 2).alias("exposure_mean"),
        F.round("exposure_std", 2).alias("exposure_std"),
        unless(F.col("exposure_mean") > OVEREXPOSED_ABOVE).alias("is_overexposed"),
        unless(F.col("exposure_mean") < UNDEREXPOSED_BELOW).alias("is_underexposed"),
        "phash",
        F.when(corrupt, "").otherwise(mode).alias("color_mode"),
        F.when(corrupt, 0.0).otherwise(F.round(F.col("width") / F.nullif("height", F.lit(0)), 4)).alias("aspect_ratio"),
        F.when(~corrupt, depth[mode]).alias("bit_depth"),
    )


def _format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    name = F.lit("unknown")
    for signature, label in SIGNATURES:
        name = F.when(head.startswith(signature), label).otherwise(name)
    return name


# Bits and bands by colour mode; other modes have no depth of their own.
DEPTHS = {"1": 1, "L": 8, "P": 8, "RGB": 8, "RGBA": 8, "I": 32, "F": 32}
BANDS = {"1": 1, "L": 1, "P": 1, "I": 1, "F": 1, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4}
#: Partitions of files that are read by one task, where there are more than enough.
FILES_TOGETHER = 16
#: Segments of a JPEG file that may come before its frame header.
MOST_SEGMENTS = 400


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes from byte ``at``, counted from 1; null where the content ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    places = [at + i for i in range(size)]
    digits = F.concat(*(F.hex(content.substr(p, F.lit(1))) for p in (reversed(places) if little else places)))
    return F.when((at > 0) & (F.octet_length(content) >= at + size - 1), F.conv(digits, 16, 10).cast("bigint"))


def _by_value(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def _jpeg_frame(content: Column) -> Column:
    """Where the frame header of a JPEG file begins; 0 if there is none. Segments are passed over by their lengths."""
    start = F.struct(F.lit(3).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("frame"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        marker = _number(content, at + 1, 1)
        is_frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        there = (at > 0) & (_number(content, at, 1) == 0xFF)
        after = F.when(marker == 0xFF, at + 1).otherwise(at + 2 + _number(content, at + 2, 2))
        found = F.struct(F.lit(0).cast("bigint").alias("at"), F.when(there & is_frame, at).otherwise(F.lit(0)).cast("bigint").alias("frame"))
        further = F.struct(after.alias("at"), F.lit(0).cast("bigint").alias("frame"))
        return F.when(state["frame"] > 0, state).when(F.coalesce(there & ~is_frame, F.lit(False)), further).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), start, step, lambda s: s["frame"])


def image_header(content: Column) -> Column:
    """``struct(format, width, height, mode)`` from the first bytes of a PNG, JPEG, GIF or BMP file; nulls for others."""
    png_depth, png_type = _number(content, 25, 1), _number(content, 26, 1)
    png = F.when(png_type == 0, F.when(png_depth == 1, "1").when(png_depth == 16, "I;16").otherwise("L")).otherwise(
        _by_value(png_type, {2: "RGB", 3: "P", 4: "LA", 6: "RGBA"})
    )
    frame = F.nullif(_jpeg_frame(content), F.lit(0))
    bits = _number(content, 29, 2, True)
    bmp = F.when(bits == 1, "1").when(bits.isin(4, 8), "P").when(bits.isin(16, 24, 32), "RGB")
    # The height of a BMP file is negative where its rows go down.
    high = _number(content, 23, 4, True)
    name = _format(content)

    def fields(width: Column, height: Column, mode: Column) -> Column:
        return F.struct(name.alias("format"), width.cast("int").alias("width"), height.cast("int").alias("height"), mode.alias("mode"))

    none = F.lit(None)
    return (
        F.when(name == "PNG", fields(_number(content, 17, 4), _number(content, 21, 4), png))
        .when(
            name == "JPEG",
            fields(_number(content, frame + 7, 2), _number(content, frame + 5, 2), _by_value(_number(content, frame + 9, 1), {1: "L", 3: "RGB", 4: "CMYK"})),
        )
        .when(name == "GIF", fields(_number(content, 7, 2, True), _number(content, 9, 2, True), F.lit("P")))
        .when(name == "BMP", fields(_number(content, 19, 4, True), F.least(high, F.lit(1 << 32) - high), bmp))
        .otherwise(fields(none, none, none.cast("string")))
    )


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "file:/")


def profile_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Profile every file below ``path``; undecodable ones are kept as corrupt.

    Pixels are measured where they are decoded; only the metrics are joined
    with the size and what the file's header says of format and colours.
    """
    decoded = _read_files(spark, "image", path).select("image.*")
    files = (
        _read_files(spark, "binaryFile", path)
        # As a generator, so that the header is parsed once for all its fields.
        .select("path", "length", F.inline(F.array(image_header(F.col("content")))))
        .select(_plain(F.col("path")).alias("path"), F.col("length").alias("file_size_bytes"), "format", "mode")
    )
    metrics = measure_images(decoded).withColumn("path", _plain(F.col("path")))
    return image_profile(metrics.join(files.hint("merge"), "path", "left"))


def _read_files(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Every file below ``path``. Spark counts a small file as 4 MB, so its tasks have a few dozen; here many of these are one task."""
    files = spark.read.format(kind).option("recursiveFileLookup", "true").load(path)
    tasks = files.rdd.getNumPartitions()
    return files.coalesce(max(3 * spark.sparkContext.defaultParallelism, -(-tasks // FILES_TOGETHER)))


def hash_bits(phash: Column) -> Column:
    """The hexadecimal hash as a signed 64-bit number, for near-duplicate search."""
    high = F.conv(F.substring(phash, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(phash, 9, 8), 16, 10).cast("bigint")
    return F.when(F.length(phash) == 16, F.shiftleft(high, 32).bitwiseOR(low))
