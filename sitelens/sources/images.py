"""Image scans: listings without content, and pixels by Spark's own decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.constants import ANNOTATED_EXTENSIONS, IMAGE_EXTENSIONS
from sitelens.functions import names
from sitelens.schemas import INDEX


def list_images(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = True, either_case: bool = True) -> DataFrame:
    """``path`` of each image file. ``either_case``: extensions wholly lower or upper case, else any case.

    Only names are read: the content column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path")
    return files.where(names.is_image(F.col("path"), extensions or IMAGE_EXTENSIONS, either_case)).distinct()


def list_annotated(spark: SparkSession, folder: str) -> DataFrame:
    """The four annotated extensions in one folder, in any case."""
    return list_images(spark, folder, ANNOTATED_EXTENSIONS, recursive=False, either_case=False)


def list_by_glob(spark: SparkSession, folder: str, glob: str = "*.{jpg,png}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")


def first_images(listing: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` by path; all without an ``n``."""
    return listing if n is None else listing.orderBy("path").limit(n)


def described(listing: DataFrame) -> DataFrame:
    """Listing with file name, stem, extension, camera setup and capture time."""
    p, name = F.col("path"), names.file_name(F.col("path"))
    return listing.withColumns({"file_name": name, "stem": names.stem(p), "ext": names.extension(p), "setup": names.setup_of(name), "captured_at": names.captured_at(name)})


def read_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path``, ``height``, ``width``, ``n_channels``, ``data`` (BGR bytes); unreadable files have nulls."""
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(folder)
    good = F.col("image.height") > 0
    keep = lambda c: F.when(good, F.col(f"image.{c}"))
    return image.select(F.col("image.origin").alias("path"), keep("height").alias("height"), keep("width").alias("width"), keep("nChannels").alias("n_channels"), keep("data").alias("data"))


def image_dimensions(images: DataFrame) -> DataFrame:
    return images.select("path", "width", "height")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Paths of an accepted-images index: its first column, blank rows left out. Other columns aren't parsed."""
    return spark.read.csv(path, header=True, schema=INDEX).select("path").where("trim(path) <> ''")
