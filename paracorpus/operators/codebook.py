"""Learn a codebook of centroids and map dense frames to units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paracorpus.session import pin

# A codebook is a model with a chosen number of entries (500 is usual). Tasks receive it in
# pieces of at most this many centroids; a larger codebook takes several passes over the frames.
PIECE = 8192
ROWS_AT_ONCE = 2048
# Bytes of centroids that may leave the cluster, as tasks hold all of them. A larger codebook stays
# there, in cells around some of its own centroids.
MOST_BYTES = 512 * 1024 * 1024
MOST_CELLS = 1024
# Frames that meet one part of a cell in one task.
FRAMES_AT_ONCE = 50_000


def fit_codebook(frames: DataFrame, k: int = 500, seed: int = 42, vec: str = "vec") -> DataFrame:
    """Columns (unit, vec): k-means centroids, numbered from 0."""
    spark = frames.sparkSession
    points = frames.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(points)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(centres, "unit int, vec array<double>")


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The valid vectors as rows; an error if one has another length."""
    lengths = np.asarray(vectors.value_lengths().fill_null(width))
    if (lengths != width).any():
        odd = int(np.flatnonzero(lengths != width)[0])
        raise ValueError(f"a vector has {lengths[odd]} numbers where the codebook has {width}: {vectors[odd]}")
    return np.asarray(vectors.drop_null().flatten(), dtype=np.float64).reshape(-1, width)


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rounded to nine digits so that all plans compare alike."""
    score = (points**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * (points @ centroids.T)
    return np.round(np.maximum(score, 0), 9)


def _best_of(points: np.ndarray, units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, unit, distance) of each point: of equal rounded distances the smallest unit, as `units` ascend."""
    best, near = np.empty(len(points), dtype=np.int64), np.empty(len(points))
    for lo in range(0, len(points), ROWS_AT_ONCE):
        score = _distances(points[lo : lo + ROWS_AT_ONCE], centroids)
        best[lo : lo + ROWS_AT_ONCE] = at = score.argmin(1)
        near[lo : lo + ROWS_AT_ONCE] = score[np.arange(len(at)), at]
    return near, units[best], ((points - centroids[best]) ** 2).sum(1)


def _nearest(units: np.ndarray, centroids: np.ndarray):
    """The nearest of these centroids; a null vector has none."""

    @F.arrow_udf("struct<near:double,unit:int,distance:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        known = np.asarray(vectors.is_valid())
        near, unit, distance = _best_of(_matrix(vectors, centroids.shape[1]), units, centroids)
        place = pa.array(np.where(known, np.cumsum(known) - 1, 0), pa.int64(), mask=~known)
        columns = [pa.array(near), pa.array(unit, pa.int32()), pa.array(distance)]
        return pa.StructArray.from_arrays(
            [c.take(place) for c in columns], ["near", "unit", "distance"], mask=pa.array(~known)
        )

    return nearest


def _near_cells(units: np.ndarray, pivots: np.ndarray, radii: np.ndarray):
    """The cells, but the given one, that may hold a centroid as near as `near`: by the triangle inequality
    none of a cell is nearer than the distance to its pivot less its radius."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array, near: pa.Array, home: pa.Array) -> pa.Array:
        points, bound, own = _matrix(vectors, pivots.shape[1]), np.sqrt(np.asarray(near)), np.asarray(home)
        found = []
        for lo in range(0, len(points), ROWS_AT_ONCE):
            part = slice(lo, lo + ROWS_AT_ONCE)
            # Rounding must not lose a cell.
            open_to = np.sqrt(_distances(points[part], pivots)) - radii <= bound[part, None] + 1e-4
            found += [units[o & (units != h)] for o, h in zip(open_to, own[part])]
        return pa.array(found, pa.list_(pa.int32()))

    return cells


def _assign_by_cells(frames: DataFrame, codebook: DataFrame, vec: str, numbers: int, size: int) -> DataFrame:
    """`assign_units` for a codebook that stays in the cluster.

    Some centroids, chosen by hash, are pivots; every centroid belongs to the cell of its nearest pivot. A frame is
    compared with the cell it falls into first, and then only with cells that may hold a nearer
    centroid. Large cells are cut into parts and the frames that meet a part into groups of bounded size; the best of
    all comparisons is a narrow aggregate by row.
    """
    pivots = codebook.orderBy(F.xxhash64("unit"), "unit").limit(int(max(1, min(MOST_CELLS, size, MOST_BYTES * size // (8 * numbers)))))
    pivots = pin(pivots, "pivots")
    members = assign_units(codebook, pivots.select("unit", "vec").withColumnRenamed("unit", "_pivot"), unit="_pivot", out=("cell", "apart"))
    members = pin(members, "cells")
    cells = members.groupBy("cell").agg(F.max("apart").alias("apart"), F.ceil(F.count("*") / PIECE).alias("parts"))
    cells = pin(cells, "cell-sizes")
    table = pivots.join(cells, F.col("unit") == F.col("cell")).orderBy("unit").select("unit", "vec", "apart").toArrow()
    units, centres = np.asarray(table["unit"]), _matrix(table["vec"].combine_chunks(), numbers // size)
    radii = np.sqrt(np.asarray(table["apart"]))

    rows = pin(frames.withColumn("_row", F.monotonically_increasing_id()), "frames")
    points = rows.where(F.col(vec).isNotNull()).select("_row", F.col(vec).cast("array<double>").alias("vec"))
    home = points.withColumn("cell", _nearest(units, centres)("vec")["unit"])

    def compare(visits: DataFrame) -> DataFrame:
        """_row, near, unit, distance: the best centroid of each visited cell's parts."""
        parts = visits.join(cells.select("cell", "parts"), "cell")
        parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        crowds = parts.groupBy("cell").agg(F.ceil(F.count("*") / FRAMES_AT_ONCE).alias("groups"))
        crowds = pin(crowds.join(cells, "cell").select("cell", "parts", "groups"), "crowds")
        group = F.pmod(F.xxhash64("_row"), F.col("groups")).alias("group")
        left = parts.join(crowds.select("cell", "groups"), "cell").select("cell", "part", group, "_row", "vec")
        held = members.join(crowds, "cell").withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")))
        right = held.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "unit", "vec")

        def best(frames: pa.Table, centroids: pa.Table) -> pa.Table:
            empty = not frames.num_rows or not centroids.num_rows
            if empty:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int32(), pa.float64())], names=columns)
            centroids = centroids.sort_by("unit")
            of, to = (_matrix(t["vec"].combine_chunks(), numbers // size) for t in (frames, centroids))
            near, unit, distance = _best_of(of, np.asarray(centroids["unit"]), to)
            return pa.table([frames["_row"], pa.array(near), pa.array(unit, pa.int32()), pa.array(distance)], names=columns)

        columns = ["_row", "near", "unit", "distance"]
        keys = ["cell", "part", "group"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "_row long, near double, unit int, distance double")
        return found.groupBy("_row").agg(F.min(F.struct("near", "unit", "distance")).alias("best"))

    first = pin(compare(home), "home-best")
    asked = home.join(first, "_row").withColumn("cells", _near_cells(units, centres, radii)("vec", F.col("best.near"), "cell"))
    others = compare(asked.select("_row", "vec", F.explode("cells").alias("cell")))
    best = first.unionByName(others).groupBy("_row").agg(F.min("best").alias("_best"))
    return rows.join(best, "_row", "left").drop("_row")


def assign_units(frames: DataFrame, codebook: DataFrame, vec: str = "vec", unit: str = "unit", out: tuple[str, str] = ("unit", "distance")) -> DataFrame:
    """Add `unit`, the nearest centroid of `codebook` (unit, vec), and the squared `distance`.

    Up to `MOST_BYTES` there is no shuffle: matrix products over Arrow batches against a piece of the
    codebook at a time. A larger codebook is compared cell by cell (`_assign_by_cells`). All plans compare and break ties
    alike: squared distances rounded to nine digits, of equal ones the smallest unit. A null vector gets nulls; a vector of another length than
    the codebook's is an error. `unit` names the codebook's column, `out` the new ones.
    """
    codebook = codebook.select(F.col(unit).cast("int").alias("unit"), F.col("vec").cast("array<double>").alias("vec"))
    size, numbers = codebook.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    if not size:
        raise ValueError("the codebook is empty")
    if numbers * 8 > MOST_BYTES and size > 1:
        found = _assign_by_cells(frames, codebook, vec, numbers, size)
    else:
        table = codebook.orderBy("unit").toArrow()
        units, centroids = np.asarray(table["unit"]), _matrix(table["vec"].combine_chunks(), numbers // size)
        vector = F.col(vec).cast("array<double>")
        pieces = [
            _nearest(units[lo : lo + PIECE], centroids[lo : lo + PIECE])(vector) for lo in range(0, size, PIECE)
        ]
        found = frames.withColumn("_best", pieces[0] if len(pieces) == 1 else F.array_min(F.array(*pieces)))
    return found.withColumns({out[0]: F.col("_best.unit"), out[1]: F.col("_best.distance")}).drop("_best")
