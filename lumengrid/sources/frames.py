"""Frames from and to files, and to user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Before a frame's rows in a file of many frames, on a line of its own with the frame's name.
HEADER = "# "


def read_matrix_text(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """One frame per text file of numbers separated by white space: image_id (by path), path, height, width, values.

    Blank lines are skipped. A file whose lines differ in length, or with a word that isn't a number, has NULL values.

    With `many` a file holds any number of frames, one below the other, each behind a line `# name` and ending at a
    blank line, as `write_matrix_text` leaves them. Files are read in Spark's splits, so that neither the number of
    files nor the size of a task grows with the number of frames. There is a column `name`, and image_id is by path
    and name; a frame without such a line has a NULL name, one with several, or with nothing else, has NULL values.
    """
    texts = (spark.read.option("lineSep", "\n\n").text(path) if many else spark.read.text(path, wholetext=True)).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    texts = texts.withColumn("__lines", lines)
    own, single = ["path"], F.lit(True)
    if many:
        mark = HEADER.strip()
        texts = texts.where(F.size("__lines") > 0).withColumn("name", F.when(F.get("__lines", F.lit(0)).startswith(mark), F.trim(F.substr(F.get("__lines", F.lit(0)), F.lit(len(mark) + 1)))))
        texts = texts.withColumn("__lines", F.when(F.col("name").isNull(), F.col("__lines")).otherwise(F.slice("__lines", F.lit(2), F.size("__lines"))))
        own, single = ["path", "name"], (F.size("__lines") > 0) & ~F.exists("__lines", lambda x: x.startswith(mark))
    texts = texts.withColumn("rows", F.transform("__lines", lambda x: F.split(x, r"\s+")))
    width = F.size(F.get("rows", F.lit(0)))
    cells = F.transform(F.flatten("rows"), lambda x: x.try_cast("double"))
    fine = F.forall("rows", lambda r: F.size(r) == width) & F.forall(cells, lambda x: x.isNotNull()) & single
    return texts.select(F.xxhash64(*own).alias("image_id"), *own, F.size("rows").alias("height"), width.alias("width"), F.when(fine, cells).alias("values"))


def write_matrix_text(frames: DataFrame, path: str) -> None:
    """Store frames as text: a line `# image_id`, a line for each row of numbers, and a blank line; a file for each partition.

    A frame with a missing cell has the word `null` there, a NULL frame only its first line: both are read as NULL.
    """
    row = lambda y: F.array_join(F.slice("values", y * F.col("width") + 1, F.col("width")).cast("array<string>"), " ", "null")
    rows = F.when(F.col("height") > 0, F.transform(F.sequence(F.lit(0), F.col("height") - 1), row))
    block = F.concat_ws("\n", F.concat(F.lit(HEADER), F.col("image_id").cast("string")), rows)
    frames.select(block.alias("value")).write.option("lineSep", "\n\n").text(path)


def read_matrix_text_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Text files of numbers as tiles of one row each, for files larger than a task: image_id, path, and as in `tiles`.

    Files are read in Spark's splits. A line's number in its split is counted as the split streams by; what the splits
    before it hold is added, from a table with a row for each split. Blank lines are skipped. A file whose lines differ
    in length, or with a word that isn't a number, has NULL values.
    """
    own = ["path", "start"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.trim(F.regexp_replace("value", r"[\s]+", " ")).alias("line")).where("line <> ''")
    names = [*own, "line", "inside"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            inside = []
            for this in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = n + 1 if this == last else 0
                last = this
                inside.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=names)

    words = F.split("line", " ")
    parsed = lines.mapInArrow(count, "path string, start long, line string, inside long").select(*own, "inside", F.transform(words, lambda x: x.try_cast("double")).alias("cells"))
    whole = F.forall("cells", lambda x: x.isNotNull())
    splits = parsed.groupBy(*own).agg(F.count("*").alias("n"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most"), F.bool_and(whole).alias("fine"))
    of_file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = (F.min("least").over(of_file) == F.max("most").over(of_file)) & F.min("fine").over(of_file)
    first = F.first("most").over(of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    splits = splits.select(*own, before.alias("before"), F.sum("n").over(of_file).cast("int").alias("height"), first.alias("width"), fine.alias("fine"))
    return parsed.join(splits, own).select(
        F.xxhash64("path").alias("image_id"), "height", "width", F.lit(1).alias("gh"), F.col("width").alias("gw"), (F.col("before") + F.col("inside")).cast("int").alias("y0"), F.lit(0).alias("x0"), "path", F.when(F.col("fine"), F.col("cells")).alias("values")
    )


def read_gray_images(spark: SparkSession, path: str) -> DataFrame:
    """One frame per 8-bit image: the red channel over 255. Raises if a PNG has another bit depth.

    The headers are read when this is called. Spark's image source stores rows of blue, green, red; gray images
    have one channel. A file that can't be decoded has NULL height, width and values.
    """
    depth = F.conv(F.hex(F.substring("content", 25, 1)), 16, 10).cast("int")
    files = spark.read.format("binaryFile").load(path).select("path", F.hex(F.substring("content", 1, 4)).alias("magic"), depth.alias("depth"))
    odd = files.where((F.col("magic") == "89504E47") & (F.col("depth") != 8)).select("path").first()
    if odd:
        raise ValueError(f"only 8-bit images can be read, not {odd[0]}")
    at = spark.read.format("image").load(path).select("image.*")
    at = at.withColumns({n: F.when(F.col(n) > 0, F.col(n)) for n in ("height", "width", "nChannels")})
    channels = F.col("nChannels")
    red = F.when(channels == 1, F.lit(0)).otherwise(F.lit(2))
    byte = lambda p: F.conv(F.hex(F.substring(F.col("data"), p * channels + red + 1, F.lit(1))), 16, 10).cast("double") / 255
    values = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), byte)
    return at.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", values.alias("values"))


def write_frames(frames: DataFrame, path: str, by: str | None = None) -> None:
    """Store frames as Parquet, in one folder for each value of `by` if given."""
    writer = frames.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_discard(df: DataFrame) -> None:
    """Compute everything and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def sink_callback(frames: DataFrame, fn: Callable) -> None:
    """Call fn(row) for every frame, in the tasks that hold them; a retried task calls again."""

    def deliver(rows) -> None:
        for row in rows:
            fn(row)

    frames.foreachPartition(deliver)
