"""Exact nearest neighbours without a pass over all vectors.

Vectors are stored in cells, each with a centre, the distance of its farthest vector
from it, and the range of its paths. By the triangle inequality a vector of a cell is
no nearer to a query than the centre's distance less that radius, so a search reads the
cells that are nearest by this bound until it has enough hits, and then those whose
bound doesn't exceed the last hit's distance; the others cannot hold a nearer one.
Centres are fitted on a bounded sample, which decides how much is read, never what is
found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rank

#: Numbers in the sample that the centres are fitted on, rounds of the fit, and cells at most.
SAMPLE_VALUES, ROUNDS, MAX_CELLS = 4_000_000, 12, 1024
#: Vectors of a cell that are written by one task.
CELL_ROWS = 200_000
#: Vectors that cannot be searched (none, or of another length) are kept here.
NOWHERE = -1

Stats = "cell int, centre array<double>, radius double, rows bigint, least_path string, last_path string"


def fit(vectors: DataFrame, dimension: int, cells: int | None = None, column: str = "embedding", seed: int = 0) -> np.ndarray:
    """Centres by k-means on a sample of at most about SAMPLE_VALUES / dimension vectors; as many as the root of their number."""
    known = vectors.filter(F.size(column) == dimension).select(column)
    n, most = known.count(), max(1, SAMPLE_VALUES // max(dimension, 1))
    rows = known.sample(min(1.0, most / n), seed).limit(2 * most).toArrow() if n else None
    if rows is None or not rows.num_rows:
        return np.zeros((0, dimension))
    points = rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
    points = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    k = min(len(points), MAX_CELLS, cells or max(1, int(np.sqrt(n))))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_centre(points, centres)
        held = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        own[at : at + 4096] = ((centres**2).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1)
    return own


def assign(vectors: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """``vectors`` with their ``cell`` and the ``distance`` from its centre."""
    width = centres.shape[1]

    @F.arrow_udf("struct<cell:int,distance:double>")
    def placed(values: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
        cell, distance = np.full(len(values), NOWHERE, np.int32), np.full(len(values), np.nan)
        fits = np.flatnonzero(lengths == width)
        if len(fits) and len(centres):
            points = values.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            real = np.isfinite(points).all(axis=1)
            fits, points = fits[real], points[real]
            cell[fits] = nearest_centre(points, centres)
            distance[fits] = np.sqrt(((points - centres[cell[fits]]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(distance, mask=np.isnan(distance))], ["cell", "distance"])

    return vectors.withColumn("_placed", placed(F.col(column))).select("*", "_placed.cell", "_placed.distance").drop("_placed")


def write(vectors: DataFrame, path: str, dimension: int, cells: int | None = None) -> None:
    """Write vectors to ``path/rows`` by cell, and what is known of the cells to ``path/cells``.

    A cell's rows are spread over tasks by CELL_ROWS, so one that holds most of the
    vectors doesn't end in one task.
    """
    spark, centres = vectors.sparkSession, fit(vectors, dimension, cells)
    placed = assign(vectors, centres)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS at most
    parts = F.create_map(*[F.lit(x) for cell, n in sizes.items() for x in (cell, -(-n // CELL_ROWS))]) if sizes else None
    salt = F.pmod(F.xxhash64("doc_id", "line_start"), parts[F.col("cell")]) if sizes else F.lit(0)
    placed.repartition(F.col("cell"), salt).write.partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    found = rows.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"), F.min("doc_path").alias("least_path"), F.max("doc_path").alias("last_path"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    found.filter(F.col("cell") != NOWHERE).join(known, "cell").select(*[c.split()[0] for c in Stats.split(", ")]).coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class Read:
    """What a search has read."""

    cells: int = 0
    of: int = 0
    rows: int = 0
    all_rows: int = 0


class Cells:
    """Vectors that :func:`write` has written. ``more`` and ``living`` let a store add and hide rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.rows = spark.read.schema(f"{schema}, distance double, cell int").parquet(f"{path}/rows")
        self.known = spark.read.schema(Stats).parquet(f"{path}/cells").collect()  # MAX_CELLS at most
        self.read = Read()

    def _bounds(self, query: Sequence[float], prefix: str | None) -> list[tuple[float, int, int]]:
        """(least possible distance, cell, rows), nearest first; cells without such a path are left out."""
        q = np.asarray([float(np.float32(x)) for x in query])
        out = []
        for r in self.known:
            if len(r["centre"]) != len(q) or prefix and not (r["last_path"] >= prefix and (r["least_path"] < prefix or r["least_path"].startswith(prefix))):
                continue
            far = float(np.sqrt(((np.asarray(r["centre"]) - q) ** 2).sum()))
            out.append((max(0.0, far - r["radius"] - 1e-9 * (far + r["radius"] + 1)), r["cell"], r["rows"]))  # less what rounding may add
        return sorted(out)

    def _in(self, cells: Iterator[int] | list[int]) -> DataFrame:
        return self.rows.filter(F.col("cell").isin(list(cells)))

    def nearest(self, query: Sequence[float], k: int, path_prefix: str | None = None, living=lambda df: df, more: DataFrame | None = None) -> DataFrame:
        """The same as ``rank.nearest_chunks`` over all rows (those that ``living`` leaves, and ``more``)."""
        bounds, first, rows = self._bounds(query, path_prefix), [], 0
        for bound in bounds:
            if rows >= k and bound[0] > 0:
                break
            first.append(bound)
            rows += bound[2]
        start = living(self._in([c for _, c, _ in first])) if first else living(self.rows.limit(0))
        names = [c for c in start.columns if c not in ("cell", "distance")]
        start = start.select(*names) if more is None else start.select(*names).unionByName(more.select(*names))
        found = rank.nearest_chunks(start, query, k, path_prefix)
        scores = [r["score"] for r in found.select("score").collect()]  # k at most
        last = max(scores) if len(scores) == k else float("inf")
        rest = [b for b in bounds[len(first) :] if b[0] <= last]
        self.read = Read(len(first) + len(rest), len(self.known), rows + sum(b[2] for b in rest), sum(r["rows"] for r in self.known))
        if not rest:
            return found
        return rank.nearest_chunks(living(self._in([c for _, c, _ in rest])).select(*names).unionByName(start), query, k, path_prefix)
