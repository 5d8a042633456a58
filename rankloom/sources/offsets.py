"""An index of byte offsets over JSON-lines files, and random access to records by it.

The scan is Spark's own, splittable one: a task knows the file and the split of each line and the bytes of each, so the offset of a line is the sum of the bytes before
it, carried from split to split of a file. The index is a table; records are read back by seek, the records of one file after each other in one task.

A line is what stands between two line feeds, a carriage return being part of it; the last one need not end. Blank lines have no entry; a torn line, or one without the key, has
an entry with a null key, and a null record if it isn't JSON. Files must not be compressed, as there is no seeking in those.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..shipping import ship
from .scratch import cut


def build(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, offset, length, key as a string) of every line that isn't blank; key is the name of a field."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    size = F.octet_length("value").cast("long")
    slim = lines.select("file", "block", F.monotonically_increasing_id().alias("nth"), size.alias("length"), (size + 1).alias("step"), F.get_json_object("value", f"$['{key}']").alias("key"))
    # the ids are those of this one read
    placed = ordered.running(cut(slim, "lines"), ["file"], ["block", "nth"], {"offset": "step"})
    return cut(placed.where("length > 0").select("file", "offset", "length", "key"), "offsets")


def _open(path: str) -> pa.NativeFile:
    if "://" in path or path.startswith("file:"):
        path = unquote(path)
        store, at = (fs.LocalFileSystem(), path[5:].replace("///", "/", 1)) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        return store.open_input_file(at)
    return fs.LocalFileSystem().open_input_file(path)


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, opened = None, None
    for b in batches:
        found = []
        for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if file != name:
                if opened is not None:
                    opened.close()
                name, opened = file, _open(file)
            opened.seek(offset)
            found.append(opened.read(length).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "line"])
    if opened is not None:
        opened.close()


def fetch(entries: DataFrame, schema: str) -> DataFrame:
    """The entries of an index, each with its line and the record in it; each file is opened by the tasks that have entries of it, in the order of offsets."""
    ship(entries.sparkSession)
    rows = entries.select("file", "offset", "length", "key").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    lines = rows.mapInArrow(_seek, "file string, offset long, length long, key string, line string")
    return lines.withColumn("record", F.from_json("line", schema, {"mode": "PERMISSIVE"}))


def sample(index: DataFrame, n: int, seed: int) -> DataFrame:
    """n entries in the order of md5(seed:key); null keys last, equal keys by place."""
    order = F.when(F.col("key").isNotNull(), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key"))))
    return index.orderBy(F.asc_nulls_last(order), "key", "file", "offset").limit(n)
