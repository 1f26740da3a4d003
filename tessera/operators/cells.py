"""Exact vector search over cells (B-02 to B-04, K-01): vectors stored by version and nearest centroid.

``add`` writes vectors below ``root``:

* ``centroids``: unit vectors fitted to a bounded sample when the index is begun.  Any centroids give right results.
* ``vectors/snapshot_id=S``: a version's rows, sorted by cell within files of small row groups.
* ``cells/snapshot_id=S``: for each cell of the version its rows and its radius, the widest angle to the centroid.

Angles obey the triangle inequality: a row of a cell is no nearer to the query than the centroid's angle less the
radius, so cosines of a cell are bounded.  A search reads the nearest cells that hold k rows for a threshold, then
the cells whose bound reaches it.  Versions are partitions and pruned when the latest ones are known (dynamic partition pruning);
cells are sorted runs and pruned by the statistics of row groups.

Rows whose vector is null, zero, not finite or of another width than the centroids have no angle; they are cell -1,
which every search reads, so that queries of another width find theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators.search import limit_or, top

#: Vectors that centroids are fitted to, cells at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 10_000, 1_024, 8
#: What rounding may take from an angle, and from a score of six digits.
SLACK = 2e-6
NO_CELL = -1
ROW_GROUP_BYTES = 1 << 20
#: An index of so few rows is read as a whole: two more jobs would take longer than it saves.
DIRECT_ROWS = 20_000


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of length one; those without a direction, or of another width, become NaN."""
    out = np.full((len(column), width), np.nan)
    lists = column.cast(pa.list_(pa.float64()))
    own = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == width)
    if width and len(own):
        out[own] = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), width)
        with np.errstate(invalid="ignore", divide="ignore"):
            out /= np.sqrt((out * out).sum(1))[:, None]
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def fitted(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of the ``sample`` rows whose ids have the least hashes: spherical k-means from evenly chosen rows."""
    some = vectors.filter("size(vector) > 0").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    widths = np.asarray(some.value_lengths())
    if not len(some):
        return np.zeros((0, 0))
    rows = unit_rows(some, int(np.bincount(widths).argmax()))
    rows = rows[np.isfinite(rows).all(1)]
    n = min(len(rows), cells or min(MOST_CELLS, math.isqrt(max(vectors.count(), 1)) or 1))
    if not n:
        return np.zeros((0, rows.shape[1]))
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.sqrt((sums * sums).sum(1))[:, None]
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def add(vectors: DataFrame, root: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write the versions of ``vectors`` (snapshot_id, chunk_id, vector and columns to be carried along); ones that are there are replaced."""
    spark = vectors.sparkSession
    if not _there(spark, f"{root}/centroids"):
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(fitted(vectors, cells, sample))]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{root}/centroids")
    found = spark.read.parquet(f"{root}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    centres = np.array([r["centroid"] for r in found]) if found else np.zeros((0, 0))
    kept = [c for c in vectors.columns if c not in ("snapshot_id", "vector")]
    plain = vectors.select("snapshot_id", *kept, "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2_048):
                part = batch.slice(low, 2_048)
                cell, angle = np.full(part.num_rows, NO_CELL, np.int32), np.full(part.num_rows, np.nan)
                if len(centres):
                    cosines = unit_rows(part.column(part.num_columns - 1), centres.shape[1]) @ centres.T
                    own = np.flatnonzero(np.isfinite(cosines).all(1))
                    cell[own] = cosines[own].argmax(1)
                    angle[own] = np.arccos(np.clip(cosines[own].max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(angle)], names=[*part.schema.names, "cell", "angle"])

    dealt = plain.mapInArrow(run, _ddl(plain) + ", cell int, angle double")
    # By ranges: a version of any size is dealt to as many tasks as it needs, and small ones share a task.
    dealt = dealt.repartitionByRange("snapshot_id", "cell").sortWithinPartitions("snapshot_id", "cell", "chunk_id")
    versions = {"partitionOverwriteMode": "dynamic"}
    dealt.write.mode("overwrite").options(**versions, **{"parquet.block.size": ROW_GROUP_BYTES}).partitionBy("snapshot_id").parquet(f"{root}/vectors")
    written = spark.read.parquet(f"{root}/vectors").join(vectors.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    sizes = written.groupBy("snapshot_id", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes.repartitionByRange("snapshot_id").write.mode("overwrite").options(**versions).partitionBy("snapshot_id").parquet(f"{root}/cells")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


@dataclass(frozen=True)
class Pruned:
    """A search's hits, and how much of the chosen versions it reads: rows and cells, of all."""

    hits: DataFrame
    rows_read: int
    rows: int
    cells_read: int
    cells: int

    @property
    def fraction(self) -> float:
        return self.rows_read / self.rows if self.rows else 0.0


class CellIndex:
    """An opened index: files are listed and centroids read once."""

    def __init__(self, spark: SparkSession, root: str):
        self.vectors = spark.read.parquet(f"{root}/vectors")
        self.cells = spark.read.schema("cell int, n bigint, radius double, snapshot_id string").parquet(f"{root}/cells")
        found = spark.read.schema("cell int, centroid array<double>").parquet(f"{root}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centroids = np.array([r["centroid"] for r in found]) if found else np.zeros((0, 0))
        self.n = self.cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def top(self, query: Sequence[float], k: int | None = None, versions: DataFrame | Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
        """The hits of ``search``, without its report."""
        if self.n > DIRECT_ROWS:
            return self.search(query, k, versions, where).hits
        rows = self._of(self.vectors, versions)
        return self._best(rows if where is None else rows.filter(where), query, limit_or(k), None)

    def _known(self, query: Sequence[float], versions: DataFrame | Sequence[str] | None) -> list[tuple[float, float, int, int]]:
        """(angle to the query, bound of the cosine, cell, rows) of the versions' cells; without an angle - the query's width is another, or the rows' - there is no bound."""
        of = self._of(self.cells, versions).groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # MOST_CELLS + 1 rows at most
        q = np.array(query, float)
        length = math.sqrt(float(q @ q))
        fits = len(self.centroids) and len(q) == self.centroids.shape[1] and 0 < length < math.inf
        angles = np.arccos(np.clip(self.centroids @ q / length, -1, 1)).tolist() if fits else []
        out = []
        for cell, n, radius in of:
            if not angles or cell == NO_CELL:
                out.append((math.inf, math.inf, cell, n))
            else:
                out.append((angles[cell], math.cos(max(0.0, angles[cell] - radius - SLACK)) + SLACK, cell, n))
        return sorted(out)

    def search(self, query: Sequence[float], k: int | None = None, versions: DataFrame | Sequence[str] | None = None, where: Column | None = None) -> Pruned:
        """The ``k`` best rows by cosine, ties by chunk_id, of some versions: names, or a table (snapshot_id) of a side that may be broadcast.

        ``where`` is a condition on the carried columns.
        """
        k, known, rows = limit_or(k), self._known(query, versions), self._of(self.vectors, versions)
        rows = rows if where is None else rows.filter(where)
        seeds, held = [], 0
        for _, _, cell, n in known:
            if held >= k:
                break
            seeds.append(cell)
            held += n
        least = -math.inf
        if len(seeds) < len(known):
            first = self._best(rows, query, k, seeds).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            least = first["least"] if first["n"] == k else least
        keep = [(cell, n) for _, bound, cell, n in known if bound >= least]
        hits = self._best(rows, query, k, [cell for cell, _ in keep] if len(keep) < len(known) else None)
        return Pruned(hits, sum(n for _, n in keep), sum(n for *_, n in known), len(keep), len(known))

    @staticmethod
    def _of(table: DataFrame, versions: DataFrame | Sequence[str] | None) -> DataFrame:
        if versions is None:
            return table
        if isinstance(versions, DataFrame):
            return table.join(versions, "snapshot_id")
        return table.filter(F.col("snapshot_id").isin(list(versions)))

    @staticmethod
    def _best(rows: DataFrame, query: Sequence[float], k: int, cells: list[int] | None) -> DataFrame:
        """Conditions on cells reach the row groups' statistics."""
        rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
        score = vector.score(F.col("vector"), vector.literal(query))
        return top(rows.withColumn("score", F.nanvl(score, F.lit(None))), "chunk_id", k)
