"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scratch import delete, folder, new_path

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows does not depend on executors that may be lost; options are the writer's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"{folder(df.sparkSession).rpartition('/')[2]}/" in path:
            delete(df.sparkSession, path)


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spare_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have, however its own are spelled."""
    taken = {c.lower() for c in df.columns}
    found = (f"_x{k}" for k in range(n + len(taken)))
    return [c for c in found if c not in taken][:n]
