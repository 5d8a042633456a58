"""Approximate nearest neighbours along shifted Hilbert curves.

Distinct vectors are projected by several random rotations onto a few dimensions, moved by a random shift, put on a grid and numbered along
the Hilbert curve of that grid. Each ordering is range-partitioned and numbered in Spark. A query looks at the vectors whose place on a curve
is within a window of its own; of each block it keeps the SHORT nearest. The findings of all curves are merged, the SHORT nearest of a query
are ranked by the exact cosine of the original vectors.

What goes along the curves is slim: points are numbers, and their vectors unit vectors in 24-bit fixed point, which tells vectors apart down to
angles of about a millionth, as their products are taken in double precision; the original vectors are read once more for the shortlists alone.

How wide the window must be depends on the data, not on its size alone: it is measured, at every size alike. A bounded number of probe
vectors is compared with all vectors, and the window is taken in which TARGET of their true neighbours come within reach on some curve. Data
without any structure need windows that grow with the number of vectors; they stay whole, in blocks of bounded size that grow with the window.

Equal vectors are one point of the index, which carries the few smallest ids of the group; so a group of copies costs one row, and ties go to the
smaller id exactly.

Defined results: vectors that are null or zero, or hold null or non-finite components, take no part, nor do vectors of another length than
most have (the longer, if two lengths are as frequent); a null id is never a query and never found; rows that repeat an id with the same vector count once;
fewer candidates than asked for are all returned; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

CURVES, DIMS, BITS = 3, 8, 7
NEIGHBOURS = 5
EVERY = 50
#: Nearest by the codes that are kept for the exact ranking.
SHORT = 24
#: Vectors that tell the spread of the projections, and probes that tell the window.
SAMPLE, PROBES, TARGET = 4096, 256, 0.97
#: Places on a curve that are compared in one block: as many as the window, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 2048, 65536
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points on a grid of 2^bits cells a side; by Skilling's transform."""
    x = cells.astype(np.uint64).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for k in range(dims):
            high = (x[:, k] >> np.uint64(b)) & np.uint64(1) == 1
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, k] ^= swap
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> np.uint64(b)) & np.uint64(1) == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << np.uint64(1)) | ((x[:, k] >> np.uint64(b)) & np.uint64(1))
    return key


class Curves:
    """The orderings: rotations, centre, scale and shifts."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED):
        width, rng = sample.shape[1], np.random.default_rng(seed)
        self.dims, self.bits = min(dims, width), bits
        self.rotations = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims] for _ in range(curves)]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = [(unit @ r).mean(axis=0) for r in self.rotations]
        self.scales = [np.maximum((unit @ r).std(axis=0), 1e-12) for r in self.rotations]
        self.shifts = [rng.uniform(-0.5, 0.5, self.dims) for _ in range(curves)]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        at = (unit @ self.rotations[curve] - self.centres[curve]) / self.scales[curve] + self.shifts[curve]
        cells = np.clip((at + 4) / 8 * (1 << self.bits), 0, (1 << self.bits) - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)


#: The largest number of a code.
FULL = (1 << 23) - 1


def _codes(unit: np.ndarray) -> list[bytes]:
    """Rows of unit vectors in 24-bit fixed point."""
    wide = np.rint(unit * FULL).astype("<i4")
    return [row.tobytes() for row in wide.view(np.uint8).reshape(*wide.shape, 4)[:, :, :3]]


def _vectors(codes: pa.Array) -> np.ndarray:
    """Rows of codes as vectors in double precision."""
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1, 3)
    wide = np.zeros((*raw.shape[:2], 4), np.uint8)
    wide[:, :, 1:] = raw  # the sign is in the last byte
    return (wide.view("<i4")[:, :, 0] >> 8) / FULL


def _coder(with_vec: bool):
    """Usable vectors: (id, size, digest of the vector, and the coded unit vector, or the vector itself if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0
            start = np.cumsum(size) - size
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                m = flat[start[at][:, None] + np.arange(n)]
                good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                at, m = at[good], m[good]
                digests = [hashlib.blake2b(row, digest_size=16).digest() for row in m]
                columns = [ids.take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(digests, pa.binary())]
                columns.append(pa.array(m.tolist(), pa.list_(pa.float64())) if with_vec else pa.array(_codes(_unit(m / np.abs(m).max(axis=1, keepdims=True))), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "digest", "vec" if with_vec else "codes"])

    return run


def coded(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", with_vec: bool = False) -> DataFrame:
    """(id, size, digest, codes) of every usable vector with an id; with_vec: the vector in place of the codes."""
    ship(table.sparkSession)
    kind = table.schema[vec_col].dataType.simpleString()
    vec = table[vec_col] if kind in ("array<float>", "array<double>") else table[vec_col].cast("array<double>")
    rows = table.select(table[id_col].cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
    return rows.mapInArrow(_coder(with_vec), f"id long, size int, digest binary, {'vec array<double>' if with_vec else 'codes binary'}")


def points(rows: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(point, digest, codes, ids): a number for every distinct vector of coded rows, and its neighbours + 1 smallest ids in order; a written table."""
    few = rows.select("digest", "id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("k") <= neighbours + 1)
    groups = few.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.select("digest", F.col("id").alias("first"), "codes").dropDuplicates(["digest", "first"])
    joined = groups.withColumn("first", F.element_at("ids", 1)).join(one, ["digest", "first"])
    return common.cut(joined.select(F.monotonically_increasing_id().alias("point"), "digest", "codes", "ids"), "points")


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = shared.value
        for b in batches:
            if b.num_rows:
                m = _vectors(b.column(1))
                for c in range(len(curves.rotations)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(curves.keys(m, c).astype(np.int64)), b.column(0)], ["curve", "key", "point"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        curve = b.column(0).to_numpy()
        place = np.zeros(len(curve), np.int64)
        for c in np.unique(curve).tolist():
            mine = curve == c
            place[mine] = seen.get(c, 0) + np.arange(mine.sum())
            seen[c] = seen.get(c, 0) + int(mine.sum())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(curve), part, np.int32)), pa.array(place)], ["curve", "point", "part", "place"])


def order(pts: DataFrame, curves: Curves) -> DataFrame:
    """(curve, point, rank): the place of every point on every curve, from 0."""
    keyed = pts.select("point", "codes").mapInArrow(_keyed(pts.sparkSession.sparkContext.broadcast(curves)), "curve int, key long, point long")
    ranged = keyed.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    counted = common.cut(ranged.mapInArrow(_counted, "curve int, point long, part int, place long"), "curve-places")
    sizes = counted.groupBy("curve", "part").agg(F.count("*").alias("n"))  # a row for each partition and curve
    before = sizes.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    return counted.join(before, ["curve", "part"]).select("curve", "point", (F.col("before") + F.col("place")).alias("rank"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _moderate(a: list[float]) -> list[float]:
    """The vector, moved by a power of two if its squares would leave the range of doubles."""
    most = max(map(abs, a))
    if 1e-140 < most < 1e140:
        return a
    return [math.ldexp(x, -math.frexp(most)[1]) for x in a]


def cosine(a: list[float], b: list[float]) -> float:
    a, b = _moderate(a), _moderate(b)
    return math.sumprod(a, b) / (math.sqrt(math.sumprod(a, a)) * math.sqrt(math.sumprod(b, b)))


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, those of -inf left out."""
    k = min(k, scores.shape[1])
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    row, col = np.repeat(np.arange(len(scores)), k), top.ravel()
    real = scores[row, col] > -np.inf
    return row[real], col[real]


def _probed(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        probes = _unit(vectors)
        for b in batches:
            if b.num_rows:
                point = b.column(0).to_numpy()
                s = probes @ _unit(_vectors(b.column(1))).T
                s[ids[:, None] == point[None, :]] = -np.inf
                row, col = _best(s, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(point[col]), pa.array(s[row, col].astype(float))], ["query", "found", "score"])

    return run


def _some(pts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, vectors) of the n points with the least digests, at most."""
    rows = pts.orderBy("digest").limit(n).select("point", "codes").collect()
    return np.array([r["point"] for r in rows], np.int64), _vectors(pa.array([bytes(r["codes"]) for r in rows], pa.binary())) if rows else np.zeros((0, 0))


def window_for(pts: DataFrame, ranks: DataFrame, k: int, probes: int = PROBES, target: float = TARGET) -> int:
    """The least window with which so many of the probes' true neighbours are in reach on some curve."""
    spark = pts.sparkSession
    ids, vectors = _some(pts, probes)
    if not len(ids):
        return 1
    near = pts.select("point", "codes").mapInArrow(_probed(spark.sparkContext.broadcast((ids, vectors)), k), "query long, found long, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))).where(F.col("r") <= k).select("query", "found").collect()  # probes * k rows
    wanted = spark.createDataFrame([(int(x),) for x in {*ids.tolist(), *(r["found"] for r in near)}], "point long")
    place = {(r["curve"], r["point"]): r["rank"] for r in ranks.join(F.broadcast(wanted), "point").collect()}  # at most probes * (k + 1) points
    curves = sorted({c for c, _ in place})
    gaps = sorted(min(abs(place[c, r["query"]] - place[c, r["found"]]) for c in curves) for r in near)
    return max(1, gaps[min(len(gaps) - 1, math.ceil(target * len(gaps)))]) if gaps else 1


def _searched(window: int, short: int):
    """The `short` nearest in each block of each query; rows come sorted by (curve, block, points before queries)."""
    names = ["query", "found", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            curve, number, asks, rank, point = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            m = _vectors(b.column(5))
            cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (number[1:] != number[:-1])) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(curve)]))):
                here = (int(curve[lo]), int(number[lo]))
                if here != block:
                    block, held = here, []
                q = lo + int(np.searchsorted(asks[lo:hi], True))
                if q > lo:
                    held.append((rank[lo:q], point[lo:q], m[lo:q]))
                if q == hi or not held:
                    continue
                if len(held) > 1:
                    held = [tuple(map(np.concatenate, zip(*held)))]
                r, p, v = held[0]
                unit = _unit(v)
                for at in range(q, hi, 512):
                    upto = min(hi, at + 512)
                    s = _unit(m[at:upto]) @ unit.T
                    s[(np.abs(rank[at:upto, None] - r[None, :]) > window) | (point[at:upto, None] == p[None, :])] = -np.inf
                    row, col = _best(s, short)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(point[at + row]), pa.array(p[col]), pa.array(s[row, col])], names)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of (query, found, vec of the one, vec of the other)."""
    for b in batches:
        score = [cosine(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["point", "found", "score"])


def search(table: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, window: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", short: int = SHORT, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by `every` its k nearest found."""
    spark = table.sparkSession
    rows = common.cut(coded(table, id_col, vec_col), "vectors")
    size = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.col("size") == size["size"])
    pts = points(rows, k)
    ranks = common.cut(order(pts, Curves(_some(pts, SAMPLE)[1], **how)), "curve-ranks")
    window = window or window_for(pts, ranks, k)
    block = min(MOST_BLOCK, max(LEAST_BLOCK, window))

    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "digest").distinct()
    asked = common.cut(asked.join(pts.select("digest", "point"), "digest").select("query_id", "point"), "queries")
    asking = asked.select("point").distinct()

    full = ranks.join(pts.select("point", "codes"), "point")
    shape = lambda df, number, asks: df.select("curve", number.cast("int").alias("block"), F.lit(asks).alias("asks"), "rank", "point", "codes")
    there = shape(full, F.floor(F.col("rank") / block), False)
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block))
    queries = full.join(asking, "point", "left_semi").withColumn("b", F.explode(reach))
    both = there.union(shape(queries, F.col("b"), True)).repartition("curve", "block").sortWithinPartitions("curve", "block", "asks", "rank")
    found = both.mapInArrow(_searched(window, short), "query long, found long, score double").groupBy("query", "found").agg(F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))).where(F.col("r") <= short).select("query", "found")
    best = common.cut(best, "shortlist")

    # the original vectors of the points that are in a shortlist or ask; then exact cosines
    wanted = pts.select("point", "digest").join(best.select(F.col("found").alias("point")).union(asking).distinct(), "point")
    vectors = coded(table, id_col, vec_col, True).select("digest", "vec").join(wanted, "digest").dropDuplicates(["point"]).select("point", "vec")
    vectors = common.cut(vectors, "shortlist-vectors")
    ones, others = (vectors.select(F.col("point").alias(p), F.col("vec").alias(v)) for p, v in (("query", "one"), ("found", "other")))
    pairs = best.join(ones, "query").join(others, "found").select("query", "found", "one", "other")
    exact = pairs.mapInArrow(_exact, "point long, found long, score double")

    # a point stands for the ids of its group, and a query's own group counts as well
    nearest = exact.join(pts.select(F.col("point").alias("found"), "ids"), "found").select("point", "score", "ids")
    most = F.aggregate("vec", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    moderate = F.when((most > 1e-140) & (most < 1e140), F.col("vec")).otherwise(F.transform("vec", lambda x: x / most))
    square = F.aggregate(moderate, F.lit(0.0), lambda s, x: s + x * x)
    same = pts.select("point", "ids").join(asking, "point", "left_semi").join(vectors, "point").select("point", (square / (F.sqrt(square) * F.sqrt(square))).alias("score"), "ids")
    listed = asked.join(nearest.union(same), "point").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
