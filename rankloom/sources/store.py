"""Readers and writers: JSON lines, CSV, partitioned result trees, direction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "question string, factual_context string, factual_answer array<string>, non_factual_evidence string, non_factual_answer array<string>, ground_truth array<string>, original_dataset_id string"
RECORD = "sample_idx int, question string, alpha double, k int, gold_in_topk boolean, nonfactual_in_topk boolean, gold_rank int, nonfactual_rank int, topk_indices array<int>"
CONVERSATION = "conversation array<struct<role:string,content:string>>, verified_entities array<struct<text:string,label:string>>"
#: The path columns of a result tree, outermost first, and a pattern that reads them from a file's path.
TREE = ("model", "eval", "direction", "normalize", "seed", "procedure", "layer", "position")
TREE_PATTERN = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/seed_(\d+)/([^/]+)/layer_(\d+)/([^/]+)/[^/]+$"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; fields may be long, quoted and hold line ends."""
    return spark.read.schema(schema).options(header="true", multiLine="true", quote='"', escape='"', maxCharsPerColumn="-1", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header="true", quote='"', escape='"', nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_table_csv(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """CSV with fixed decimals; null becomes an empty field."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals[c]}f", F.round(c, decimals[c]))).alias(c) if c in decimals else F.col(c) for c in df.columns]
    df.select(shown).write.mode("overwrite").options(header="true", nullValue="", emptyValue="").csv(path)


def write_tree(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Partition directories for the keys; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def path_columns(path: Column) -> list[Column]:
    """The columns of a result tree from the path of a file."""
    part = lambda k: F.regexp_extract(path, TREE_PATTERN, k + 1)
    return [(part(k).cast("int") if n in ("seed", "layer") else part(k)).alias(n) for k, n in enumerate(TREE)]


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every record of a tree whose directories carry values without names, with the path's columns."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.select("*", *path_columns(F.col("_metadata.file_path")))


def partitions(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("int").alias(key)).distinct().orderBy(key)


def in_every(df: DataFrame, key: str, *others: str) -> DataFrame:
    """The values of key that occur with every combination of the other columns."""
    have = df.select(key, *others).distinct()
    n = have.select(*others).distinct().agg(F.count("*").alias("n"))
    return have.groupBy(key).agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select(key)  # one row


def copy_partitions(df: DataFrame, wanted: DataFrame, keys: list[str], path: str) -> None:
    """Write the partitions of df that are wanted to a tree of their own."""
    write_tree(df.join(wanted, keys, "left_semi"), path, keys)


def save_directions(df: DataFrame, path: str) -> None:
    """Direction rows: dataset, seed, layer, position, direction array<float>, meta map; one file layout for all."""
    write_tree(df, path, ["dataset", "seed", "layer"])


def load_directions(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Stored directions; with a width every direction of another length is an error."""
    rows = spark.read.parquet(path)
    if width is None:
        return rows
    return rows.where(F.when(F.size("direction") == width, True).otherwise(F.raise_error(F.concat(F.lit("direction of length "), F.size("direction").cast("string"))).cast("boolean")))


def import_coefficients(files: DataFrame) -> DataFrame:
    """Directions from (name, coef): names like <dataset>_seed<N>_layer<L>_<position>; other names are left out."""
    pattern = r"^(.+)_seed(\d+)_layer(\d+)_(last_pos|entity_pos)$"
    part = lambda k: F.regexp_extract("name", pattern, k)
    return files.where(F.col("name").rlike(pattern)).select(part(1).alias("dataset"), part(2).cast("int").alias("seed"), part(3).cast("int").alias("layer"), part(4).alias("position"), F.col("coef").cast("array<float>").alias("direction"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): a digest of the rows of a table that does not depend on their order."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.md5(F.concat_ws(":", F.sum(h).cast("string"), F.count("*").cast("string"))).alias("digest"))


def sample_rows(df: DataFrame, ids: str, seed: int, n: int) -> DataFrame:
    """A fixed sample of records by id, in place of an index of file offsets."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ids).cast("string"))), ids).limit(n)
