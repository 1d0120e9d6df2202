"""Text and image sources, and sinks. All readers are Spark sources; paths may be folders or globs in any store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import BATCH_BYTES


def read_image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, b, g, r) of image files; a gray image has b = g = r. Each image is unpacked by itself."""
    images = spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def unpack(batches):
        for pdf in batches:
            for origin, width, height, n, data in pdf.itertuples(index=False):
                flat = np.frombuffer(data, "uint8").reshape(height, width, n)
                rows = max(1, 1_000_000 // max(1, width))
                for y0 in range(0, height, rows):
                    part = flat[y0 : y0 + rows]
                    y, x = np.indices(part.shape[:2])
                    plane = dict(zip("bgr", (part[:, :, c].ravel().astype("int32") for c in ((0, 1, 2) if n >= 3 else (0, 0, 0)))))
                    yield pd.DataFrame({"path": origin, "y": (y + y0).ravel().astype("int32"), "x": x.ravel().astype("int32"), **plane})

    spark.conf.set(BATCH_BYTES, str(512 << 10))  # a row holds a whole file
    return images.mapInPandas(unpack, "path string, y int, x int, b int, g int, r int")


def pixels_to_tiles(p: DataFrame, size: int) -> DataFrame:
    """(raster_id, ty, tx, cells): pixels packed by square tiles, sorted by y and x; a tile's size bounds its row."""
    t = lambda c: F.floor(F.col(c) / size).cast("int")
    return p.groupBy("raster_id", t("y").alias("ty"), t("x").alias("tx")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    return tiles.select("raster_id", F.explode("cells").alias("c")).select("raster_id", "c.y", "c.x", "c.v")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(x1, y1, x2, y2) from lines of four numbers."""
    return spark.read.csv(path, sep=" ", schema="x1 double, y1 double, x2 double, y2 double")


#: The keywords of a manifest.
MANIFEST_KEYWORDS = ["patchSize", "mosaic", "important", "unimportant"]


def read_manifest(spark: SparkSession, path: str, keywords: list[str] = MANIFEST_KEYWORDS) -> DataFrame:
    """(keyword, args) of a parameter file: a keyword and its arguments on a line. Comments and blank
    lines are left out, and an unknown keyword is an error. layers_of() reads a mosaic's arguments."""
    return parse_manifest(spark.read.text(path).withColumnRenamed("value", "line"), keywords)


def parse_manifest(lines: DataFrame, keywords: list[str] = MANIFEST_KEYWORDS) -> DataFrame:
    text = lines.select(F.btrim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = text.select(F.split("line", r"\s+", 2).alias("p"))
    known = F.col("p")[0].isin(keywords)
    keyword = F.when(known, F.col("p")[0]).otherwise(F.raise_error(F.concat(F.lit("unknown keyword: "), F.col("p")[0])).cast("string"))
    return parts.select(keyword.alias("keyword"), F.filter(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+"), lambda a: a != "").alias("args"))


def layers_of(manifest: DataFrame) -> DataFrame:
    """(folder, image, tops, layers, output) of each mosaic: three names, the number of layers, a class and a file name for each, and the output folder."""
    m = manifest.where("keyword = 'mosaic'").withColumn("n", F.get("args", F.lit(3)).try_cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("args", i * 2 + 4).alias("cls"), F.get("args", i * 2 + 5).alias("file")))
    name = lambda i: F.get("args", F.lit(i))
    return m.select(name(0).alias("folder"), name(1).alias("image"), name(2).alias("tops"), F.when(F.col("n") > 0, pairs).alias("layers"), F.get("args", F.col("n") * 2 + 4).alias("output"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 within a file. A file is one row before it is split, so use it for logs and tables, not for corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("lines"))
    last = F.size("lines")
    whole = whole.withColumn("lines", F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.greatest(last - 1, F.lit(0)))).otherwise(F.col("lines")))
    return whole.select("path", F.posexplode("lines").alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def metric_matrix(lines: DataFrame, offset: int = 6) -> DataFrame:
    """(path, config_ord, mosaic, value): cells of a matrix with a header line and `offset` tokens before the values; what isn't a number is left out."""
    rows = lines.where("line_no > 1").select("path", (F.col("line_no") - 1).alias("config_ord"), F.slice(F.split("line", " "), F.lit(offset + 1), F.size(F.split("line", " "))).alias("cells"))
    cells = rows.select("path", "config_ord", F.posexplode("cells").alias("i", "cell"))
    return cells.select("path", "config_ord", (F.col("i") + 1).alias("mosaic"), F.col("cell").try_cast("double").alias("value")).where("value IS NOT NULL")


def read_metric_matrix(spark: SparkSession, path: str, offset: int = 6) -> DataFrame:
    return metric_matrix(read_lines(spark, path), offset)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, labels) of a CSV file with a header and labels separated by blanks."""
    rows = spark.read.csv(path, header=True, schema="image string, label_text string")
    return rows.select("image", F.filter(F.split(F.coalesce("label_text", F.lit("")), " "), lambda x: x != "").alias("labels"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(x, name, value) of a wide CSV file: the first column is x, the others are series."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    x, *names = wide.columns
    return wide.select(x, *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot([x], names, "name", "value").withColumnRenamed(x, "x")


#: Fixed value: how the file name of a patch tells its class.
PATCH_NAME = r"/SP([^/]+)PATCH\S*\d+.jpg$"


def list_patches(spark: SparkSession, path: str) -> DataFrame:
    """(path, cls) of patch files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return patch_class(files).where("cls != ''")


def patch_class(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("path", PATCH_NAME, 1).alias("cls"))


def write_points(points: DataFrame, pixels: DataFrame, path: str) -> None:
    """x, y, height as CSV; a point off the raster's pixels has height 0."""
    point_heights(points, pixels).select("x", "y", "height").write.mode("errorifexists").csv(path, header=True)


def point_heights(points: DataFrame, pixels: DataFrame) -> DataFrame:
    return points.join(pixels, ["raster_id", "y", "x"], "left").withColumn("height", F.coalesce("v", F.lit(0.0)))


def write_mask(mask: DataFrame, path: str) -> None:
    mask.write.mode("errorifexists").partitionBy("raster_id").parquet(path)


def write_patches(patches: DataFrame, path: str) -> None:
    """Patch pixels in one folder per site and class."""
    patches.write.mode("errorifexists").partitionBy("site", "cls").parquet(path)


def write_metrics(metrics: DataFrame, names: list[str], mosaics: list[int], path: str) -> None:
    """One folder per metric; a row per configuration, a column per mosaic."""
    metric_rows(metrics, names, mosaics).write.mode("errorifexists").partitionBy("metric").csv(path, header=True, sep=" ")


def metric_rows(metrics: DataFrame, names: list[str], mosaics: list[int]) -> DataFrame:
    long = metrics.unpivot(["exp", "config", "mosaic"], names, "metric", "value")
    wide = long.groupBy("metric", "exp", "config").pivot("mosaic", mosaics).agg(F.max("value"))
    return wide.select("metric", "exp", "config", *[F.col(str(m)).alias(f"m{m}") for m in mosaics])
