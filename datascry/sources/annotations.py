"""Image folders and box annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.operators.encode import label_codes
from datascry.operators.merge import file_stem, label_lookup

# File endings and folder names that tell the layouts apart.
IMAGE_ENDINGS = r"(?i)\.(jpg|jpeg|png|bmp|gif|tif|tiff|webp)$"
IMAGE_FOLDERS = ["images", "image", "img"]
LABEL_FOLDERS = ["labels"]
MASK_FOLDERS = ["masks", "mask"]
SKIPPED_FOLDERS = ["__pycache__", "temp", "cache"]


def relative_path(path, root: str) -> Column:
    """Path below the dataset root, without the scheme."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    return F.substring(bare, F.lit(len(base) + 1), F.length(bare))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Relative path of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.url_decode(F.replace(relative_path(F.col("path"), root), F.lit("+"), F.lit("%2B"))).alias("path"), "length")


def detect_layout(spark: SparkSession, root: str, image_endings: str = IMAGE_ENDINGS) -> str:
    """yolo, segmentation, class_hierarchy, flat or unknown, from one pass over the file listing."""
    files = list_files(spark, root)
    parts = F.split("path", "/")
    top = F.when(F.size(parts) > 1, F.lower(parts[0]))
    image = F.col("path").rlike(image_endings)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    other = top.isNotNull() & ~top.isin(IMAGE_FOLDERS + LABEL_FOLDERS + MASK_FOLDERS + SKIPPED_FOLDERS) & ~top.startswith(".")
    seen = files.agg(
        some(top.isNull() & F.lower("path").rlike(r"\.ya?ml$")).alias("yaml"),
        some(top.isin(IMAGE_FOLDERS)).alias("images"),
        some(top.isin(LABEL_FOLDERS) & F.lower("path").endswith(".txt")).alias("label_texts"),
        some(top.isin(MASK_FOLDERS)).alias("masks"),
        some(top.isin(MASK_FOLDERS) & image).alias("mask_images"),
        some(top.isin(LABEL_FOLDERS) & image).alias("label_images"),
        some(other & image).alias("class_images"),
        some(top.isNull() & image).alias("flat"),
    ).first()
    if seen["yaml"]:
        keys = spark.read.text(root, pathGlobFilter="*.y*ml").filter(F.col("value").rlike(r"^\s*(names|nc|train)\s*:"))
        if not keys.isEmpty():
            return "yolo"
    if seen["images"] and seen["label_texts"]:
        return "yolo"
    if seen["images"] and (seen["mask_images"] if seen["masks"] else seen["label_images"]):
        return "segmentation"
    if seen["class_images"]:
        return "class_hierarchy"
    return "flat" if seen["flat"] else "unknown"


def read_images(spark: SparkSession, root: str, labels: DataFrame | None = None) -> DataFrame:
    """Decoded images with labels: (path, label, height, width, nChannels, mode, data)."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    rows = raw.select(relative_path(F.col("image.origin"), root).alias("path"), "image.height", "image.width",
                      "image.nChannels", "image.mode", "image.data")
    if labels is None:
        labels = spark.createDataFrame([], "name string, label string")
    named = label_lookup(rows, labels)
    return named.select("path", "label", "height", "width", "nChannels", "mode", "data")


def read_yolo(spark: SparkSession, root: str) -> DataFrame:
    """Label lines 'class cx cy w h': (image_stem, split, class_id, cx, cy, w, h); other lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), fields.alias("f")).filter(F.size("f") >= 5)
    values = [F.col("f")[i].try_cast("double") for i in range(1, 5)]
    boxes = rows.select(
        file_stem(F.col("path")).alias("image_stem"), F.element_at(F.split("path", "/"), -2).alias("split"),
        F.col("f")[0].try_cast("int").alias("class_id"),
        *[v.alias(n) for v, n in zip(values, ("cx", "cy", "w", "h"))])
    return boxes.na.drop()


VOC_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("size", T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])),
    T.StructField("object", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("bndbox", T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])),
    ]))),
])


def read_voc(spark: SparkSession, root: str, class_names: list[str] | None = None, pattern: str = "*.xml") -> DataFrame:
    """VOC XML annotations as normalised boxes: (image_stem, class_name, class_id, cx, cy, w, h).

    Class ids follow `class_names`; names not listed come after them in text order, numbered through ranges, however many there are.
    A name listed twice counts at its first place. Images without a size are skipped.
    """
    raw = (spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", True)
           .option("pathGlobFilter", pattern).schema(VOC_SCHEMA).load(root))
    rows = raw.filter("size.width > 0 and size.height > 0").select(
        file_stem(F.col("_metadata.file_path")).alias("image_stem"), "size.width", "size.height", F.explode("object").alias("o"))
    b = F.col("o.bndbox")
    width, height = F.col("width"), F.col("height")
    boxes = rows.select(
        "image_stem", F.trim("o.name").alias("class_name"),
        ((b.xmin + b.xmax) / 2 / width).alias("cx"), ((b.ymin + b.ymax) / 2 / height).alias("cy"),
        ((b.xmax - b.xmin) / width).alias("w"), ((b.ymax - b.ymin) / height).alias("h")).na.drop()
    given = list(class_names or [])
    listed = spark.createDataFrame([(n, given.index(n)) for n in dict.fromkeys(given)], "class_name string, class_id int")
    fresh = label_codes(boxes.join(listed, "class_name", "left_anti"), "class_name")
    ids = listed.unionByName(fresh.select(F.col("label").alias("class_name"), (F.col("code") + len(given)).cast("int").alias("class_id")))
    return boxes.join(ids, "class_name").select("image_stem", "class_name", "class_id", "cx", "cy", "w", "h")
