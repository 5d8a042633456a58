"""Resumable appends: rows whose key is already stored are not computed or written again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stored(df: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """The keys at a path; None if nothing is there yet."""
    try:
        return df.sparkSession.read.parquet(path).select(*keys)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_rows(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    have = stored(df, path, keys)
    rows = df.dropDuplicates(keys)
    return rows if have is None else rows.join(have, keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    new_rows(df, path, keys).write.mode("append").parquet(path)


def append_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, batch by batch, with the same rule; a batch that is repeated adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
