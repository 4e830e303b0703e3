"""Exact k-nearest-neighbours regression without comparing all pairs of rows.

Train rows are cut into cells by median splits (found on a bounded sample; the sample
shapes the cells, not the result). A query first searches its own cell; the distance of
its k-th neighbour there then rules out every cell whose bounding box is further away.
Equal queries are searched once, and the answer is joined back by their features.

Train rows whose size was found to fit ``broadcast_bytes`` are sent to the queries, which then
move nowhere, however many cells they have to visit. Larger ones stay where they are: queries and
train rows meet by cell, and a cell that many queries visit is salted into many small tasks.

With many features a query's ball touches many boxes. So a cell is divided again, into blocks around a pivot each, in which
points lie in the order of their distance to it. By the triangle inequality a point that is much nearer to the pivot, or much
farther from it, than the query is no neighbour: whole blocks and the ends of others are passed over. A query begins with the
block of its nearest pivot. There are as many blocks as the rows ask for, smaller ones where few rows make few cells, and none of them
is on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import materialize

SAMPLE_PER_CELL = 16
MAX_CELLS = 16_384
CELL_ROWS = 512
BLOCK_ROWS = 2048
# A block around a pivot has about this part of all train rows at most, but so many rows are never divided.
BALL_SHARE, BALL_ROWS = 32, 32
# Packs of queries that visit a cell in one task, and queries that one task searches at once.
PACKS_PER_SALT, TILE_QUERIES = 8, 4096
# Train rows up to this size are sent to the queries.
BROADCAST_BYTES = 64 << 20
# Numbers a NumPy task works on at once, small enough for a processor cache.
TILE = 250_000

# Exponents of the named distances.
POWERS = {"euclidean": 2.0, "manhattan": 1.0, "minkowski": None}


@dataclass(frozen=True)
class Cells:
    """Median splits as a binary tree; ``left``/``right`` hold node numbers, leaves hold their cell."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @property
    def count(self) -> int:
        return int(self.leaf.max()) + 1

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            at, who = node[inner], rows[inner]
            node[who] = np.where(x[who, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])


def split_cells(sample: np.ndarray, wanted: int) -> Cells:
    """Split the fullest cell at the median of its widest column until there are ``wanted`` cells."""
    dim, cut, left, right, leaf = [0], [0.0], [0], [0], [-1]
    open_cells, done = [(0, sample)], []
    while open_cells and len(open_cells) + len(done) < wanted:
        open_cells.sort(key=lambda c: len(c[1]))
        node, points = open_cells.pop()
        placed = None
        if len(points) > 1:
            for d in np.argsort(-(points.max(axis=0) - points.min(axis=0))):
                low = points[:, d] <= np.median(points[:, d])
                if low.all():
                    low = points[:, d] < points[:, d].max()
                if low.any() and not low.all():
                    placed = (int(d), float(points[low, d].max()), low)
                    break
        if placed is None:
            done.append((node, points))
            continue
        dim[node], cut[node], low = placed
        for part, children in ((points[low], left), (points[~low], right)):
            children[node] = len(dim)
            open_cells.append((len(dim), part))
            for column, blank in ((dim, 0), (cut, 0.0), (left, 0), (right, 0), (leaf, -1)):
                column.append(blank)
    for number, (node, _) in enumerate(open_cells + done):
        leaf[node] = number
    return Cells(*[np.array(c) for c in (dim, cut, left, right, leaf)])


def _powered(diff: np.ndarray, p: float) -> np.ndarray:
    return diff * diff if p == 2 else np.abs(diff) if p == 1 else np.abs(diff) ** p


def _rooted(powered: np.ndarray, p: float) -> np.ndarray:
    """Distances that obey the triangle inequality, from sums of powers; for exponents below one the sums do."""
    return np.sqrt(powered) if p == 2 else powered if p <= 1 else powered ** (1 / p)


def _distances(x: np.ndarray, points: np.ndarray, p: float) -> np.ndarray:
    out = np.zeros((len(x), len(points)))
    for d in range(x.shape[1]):
        out += _powered(x[:, d, None] - points[None, :, d], p)
    return out


def _nearest(x: np.ndarray, points: np.ndarray, ids: np.ndarray, kept: int, p: float):
    """(query, point, distance) of the nearest points of each query; of equally near ones the smallest ids."""
    dist = _distances(x, points, p)
    limit = np.partition(dist, kept - 1, axis=1)[:, kept - 1]
    q, c = np.nonzero(dist <= limit[:, None])
    order = np.lexsort((ids[c], dist[q, c], q))
    q, c = q[order], c[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < kept
    return q[first], c[first], dist[q[first], c[first]]


class _Nearest:
    """The nearest points of a tile of queries so far: distances, ids and labels, nearest first, ties by id."""

    def __init__(self, n: int, k: int):
        self.d = np.full((n, k), np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.y = np.zeros((n, k))

    def meet(self, rows: np.ndarray, x: np.ndarray, points: np.ndarray, ids: np.ndarray, ys: np.ndarray, p: float) -> None:
        """Take the points of a cell into account for some of the queries."""
        k = self.d.shape[1]
        kept, size = min(k, len(ids)), max(1, TILE // len(ids))
        for at in range(0, len(rows), size):
            own = rows[at:at + size]
            q, c, dist = _nearest(x[own], points, ids, kept, p)
            place = k + np.arange(len(q)) - np.searchsorted(q, q)
            d = np.hstack([self.d[own], np.full((len(own), kept), np.inf)])
            i = np.hstack([self.id[own], np.full((len(own), kept), np.iinfo(np.int64).max)])
            y = np.hstack([self.y[own], np.zeros((len(own), kept))])
            d[q, place], i[q, place], y[q, place] = dist, ids[c], ys[c]
            order = np.lexsort((i, d), axis=1)[:, :k]
            self.d[own], self.id[own], self.y[own] = (np.take_along_axis(v, order, 1) for v in (d, i, y))


    def table(self, asked: np.ndarray, compared: np.ndarray) -> pa.Table:
        """One row per query: its number, the points found and the count of those it was compared with."""
        known = np.isfinite(self.d)
        points = pa.StructArray.from_arrays([pa.array(v[known]) for v in (self.d, self.id, self.y)], ["d", "id", "y"])
        edges = np.concatenate([[0], known.sum(1).cumsum()]).astype(np.int32)
        return pa.Table.from_arrays([pa.array(asked, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), points), pa.array(compared, pa.int64())],
                                    schema=_FOUND)


_FOUND = pa.schema([("row_id", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("y", pa.float64())]))),
                    ("compared", pa.int64())])


class _Ball:
    """A block of points in the order of their distance ``far`` to a pivot."""

    def __init__(self, ids, xs, ys, pivot, far):
        self.ids, self.points, self.ys, self.pivot, self.far = ids, xs.reshape(len(ids), -1), ys, pivot, far


#: Queries that are compared with one stretch of a block, and how far rounding may put a distance off, as a part of it.
STRETCH_QUERIES, SLACK = 32, 1e-9


def _searched(x: np.ndarray, reach: np.ndarray, balls: list[_Ball], k: int, p: float) -> tuple[_Nearest, np.ndarray]:
    """The best k of all balls for each query, none farther than ``reach`` (as a sum of powers), and the points compared."""
    best, compared = _Nearest(len(x), k), np.zeros(len(x), np.int64)
    away = _rooted(_distances(x, np.stack([b.pivot for b in balls]), p), p)
    inner = np.array([b.far[-1] for b in balls])
    # A block's first k points are no farther than its pivot and the k-th of them together.
    bound = np.minimum(_rooted(reach, p), (away + np.array([b.far[k - 1] if len(b.far) >= k else np.inf for b in balls])).min(axis=1))
    home, near = away.argmin(axis=1), np.argsort((away - inner).min(axis=0), kind="stable")
    for place, at_home in [*((b, True) for b in np.unique(home)), *((b, False) for b in near)]:
        ball, own = balls[place], away[:, place]
        limit = np.minimum(_rooted(best.d[:, -1], p), bound) * (1 + SLACK) + SLACK * (own + inner[place])
        rows = np.flatnonzero((own - inner[place] <= limit) & ((home == place) == at_home))
        rows = rows[np.argsort(own[rows], kind="stable")]
        for at in range(0, len(rows), STRETCH_QUERIES):
            some = rows[at:at + STRETCH_QUERIES]
            # Meanwhile others of these rows have found nothing new, so the limit still holds.
            low = np.searchsorted(ball.far, (own[some] - limit[some]).min(), "left")
            high = np.searchsorted(ball.far, (own[some] + limit[some]).max(), "right")
            if low < high:
                best.meet(some, x, ball.points[low:high], ball.ids[low:high], ball.ys[low:high], p)
                compared[some] += high - low
    return best, compared


def _box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray, p: float) -> np.ndarray:
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        gap = np.maximum(low[:, d] - x[:, d, None], x[:, d, None] - high[:, d])
        out += _powered(np.maximum(gap, 0), p)
    return out


@dataclass(frozen=True)
class KnnRegressor:
    """Parameters; ``fit`` wants the columns row_id (unique), features and label."""

    n_neighbors: int = 5
    weights: str = "uniform"
    metric: str = "minkowski"
    p: float = 2.0
    cell_rows: int = CELL_ROWS
    broadcast_bytes: int = BROADCAST_BYTES

    def __post_init__(self):
        if self.n_neighbors < 1 or self.weights not in ("uniform", "distance") or self.metric not in POWERS:
            raise ValueError(f"bad parameters: {self}")

    @property
    def power(self) -> float:
        return POWERS[self.metric] or self.p

    def fit(self, train: DataFrame) -> KnnModel:
        k = self.n_neighbors
        rows = train.select("row_id", vector_to_array("features").alias("x"), F.col("label").alias("y"))
        # Of equal points only the k with the smallest ids can ever be chosen; the limit
        # is applied before the shuffle, so a third of all rows being copies does no harm.
        rank = F.row_number().over(Window.partitionBy("x").orderBy("row_id"))
        rows = materialize(rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "knn-train")
        total = rows.count()
        if total < 1:
            raise ValueError("no train rows")
        wanted = int(np.clip(np.ceil(total / self.cell_rows), 1, MAX_CELLS))
        size = max(20_000, SAMPLE_PER_CELL * wanted)
        share = 1.5 * size / total
        sampled = rows.select("x").sample(share, 42) if share < 1 else rows.select("x")
        sample = np.vstack(sampled.toPandas()["x"])
        cells = split_cells(sample, wanted)
        width = sample.shape[1]
        placed = materialize(_with_cell(rows, cells), "knn-placed")
        bounds = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(width)],
            *[F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(width)]).toPandas()
        low = bounds[[f"lo{i}" for i in range(width)]].to_numpy()
        high = bounds[[f"hi{i}" for i in range(width)]].to_numpy()
        most = int(np.clip(total // BALL_SHARE, BALL_ROWS, BLOCK_ROWS))
        return KnnModel(self, cells, bounds["cell"].to_numpy(), low, high, materialize(_in_balls(placed, self.power, most), "knn-blocks"), total)


@dataclass(frozen=True)
class KnnModel:
    params: KnnRegressor
    cells: Cells
    cell_ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: DataFrame
    rows: int

    def neighbors(self, queries: DataFrame) -> DataFrame:
        """``x`` and ``near`` for the distinct features of ``queries``: the k nearest as (d, id, y), ties by id."""
        asked = queries.select(vector_to_array("features").alias("x")).distinct()
        if self.rows * (self.low.shape[1] + 2) * 8 <= self.params.broadcast_bytes:
            return self._search_all(asked)
        return self._search_cells(asked).select("x", "near")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the mean of the neighbours, plain or weighted by 1 / distance."""
        near = self.neighbors(df)
        if self.params.weights == "uniform":
            value = F.aggregate("near", F.lit(0.0), lambda a, e: a + e["y"]) / F.size("near")
        else:
            exact = F.exists("near", lambda e: e["d"] == 0)
            weight = lambda e: F.when(exact, (e["d"] == 0).cast("double")).otherwise(
                1 / F.when(e["d"] == 0, F.lit(None)).otherwise(F.pow(e["d"], F.lit(1 / self.params.power))))
            value = F.aggregate("near", F.lit(0.0), lambda a, e: a + weight(e) * e["y"]) \
                / F.aggregate("near", F.lit(0.0), lambda a, e: a + weight(e))
        # Written, so that both sides of the join are plain and a point asked by very many rows can be split.
        found = materialize(near.select(F.col("x").alias("_x"), value.alias("prediction")), "knn-answers")
        columns = [c for c in df.columns if c != "prediction"]
        return df.select(*columns, vector_to_array("features").alias("_own")) \
            .join(found, F.col("_own") == F.col("_x")).select(*columns, "prediction")

    def _search_all(self, asked: DataFrame) -> DataFrame:
        """Search with all train rows at hand; their size was checked."""
        parts: dict[int, list] = {}
        for row in self.blocks.collect():
            parts.setdefault(row["cell"], []).append((np.array(row["ids"]), np.array(row["xs"]), np.array(row["ys"])))
        held = {cell: tuple(np.concatenate(p) for p in zip(*blocks)) for cell, blocks in parts.items()}
        sent = asked.sparkSession.sparkContext.broadcast(held)
        cells, ids, low, high = self.cells, self.cell_ids, self.low, self.high
        k, p, width = self.params.n_neighbors, self.params.power, self.low.shape[1]

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            train = {c: (xs.reshape(-1, width), own, ys) for c, (own, xs, ys) in sent.value.items()}
            size = max(1, min(TILE_QUERIES, 16 * TILE // len(ids)))
            for batch in batches:
                for at in range(0, len(batch), size):
                    x = np.vstack(batch["x"].iloc[at:at + size])
                    best, home = _Nearest(len(x), k), cells.locate(x)
                    for cell in np.unique(home):
                        best.meet(np.flatnonzero(home == cell), x, *train[cell], p)
                    far = _box_distances(x, low, high, p)
                    for place in np.argsort(far.min(axis=0)):
                        # The slack covers the rounding of sums taken in another order.
                        open_ = (far[:, place] <= best.d[:, -1] * (1 + 1e-12)) & (home != ids[place])
                        if open_.any():
                            best.meet(np.flatnonzero(open_), x, *train[ids[place]], p)
                    known = np.isfinite(best.d)
                    near = [[{"d": d, "id": i, "y": y} for d, i, y in zip(best.d[r][known[r]], best.id[r][known[r]], best.y[r][known[r]])]
                            for r in range(len(x))]
                    yield pd.DataFrame({"x": pd.Series(list(x), dtype=object), "near": pd.Series(near, dtype=object)})

        return asked.mapInPandas(search, "x array<double>, near array<struct<d:double,id:long,y:double>>")

    def _search_cells(self, asked: DataFrame) -> DataFrame:
        """Search by joins of packed queries and train blocks."""
        k = self.params.n_neighbors
        # The numbers are written with the rows, so every later step sees the same ones.
        numbered = asked.withColumn("row_id", F.monotonically_increasing_id()).withColumn("reach", F.lit(None).cast("double"))
        home = materialize(_with_cell(numbered, self.cells), "knn-queries")
        first = materialize(self._visit(home).join(home.drop("reach"), "row_id", "right"), "knn-home")
        reach = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["d"])
        others = first.select("row_id", "x", "cell", reach.alias("reach")).mapInPandas(
            self._other_cells(), "row_id long, x array<double>, cell long, reach double")
        more = self._visit(materialize(others, "knn-visits"))
        both = first.select("row_id", "near", "compared").unionAll(more)
        # At most k entries per visited cell, so this list stays short.
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        return both.groupBy("row_id").agg(best.alias("near"), F.sum("compared").alias("compared")) \
            .join(home.select("row_id", "x"), "row_id").select("x", "near", "compared")

    def _other_cells(self):
        """Cells besides the own one that can hold a nearer (or equally near) point."""
        ids, low, high, p = self.cell_ids, self.low, self.high, self.params.power

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), max(1, TILE // len(ids))):
                    rows = batch.iloc[at:at + max(1, TILE // len(ids))]
                    x = np.vstack(rows["x"])
                    reach = rows["reach"].astype(float).fillna(np.inf).to_numpy()
                    open_ = _box_distances(x, low, high, p) <= reach[:, None] * (1 + 1e-12)
                    open_ &= ids[None, :] != rows["cell"].to_numpy()[:, None]
                    q, c = np.nonzero(open_)
                    yield pd.DataFrame({"row_id": rows["row_id"].to_numpy()[q], "x": pd.Series(list(x[q]), dtype=object),
                                        "cell": ids[c], "reach": reach[q]})
        return choose

    def _visit(self, queries: DataFrame) -> DataFrame:
        """(``row_id``, ``near``, ``compared``): the best k of the given cell for each (row_id, x, cell), no farther than ``reach``
        if that is known, and with how many points the query was compared."""
        k, p, width = self.params.n_neighbors, self.params.power, self.low.shape[1]

        def search(packs: pa.Table, blocks: pa.Table) -> pa.Table:
            balls = [_Ball(*(blocks.column(c)[i].values.to_numpy() for c in ("ids", "xs", "ys", "pivot", "far"))) for i in range(blocks.num_rows)]
            out = []
            for i in range(packs.num_rows if balls else 0):
                asked, qs, reach = (packs.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("asked", "qs", "reaches"))
                reach = np.where(np.isnan(reach), np.inf, reach)
                best, compared = _searched(qs.reshape(-1, width), reach, balls, k, p)
                out.append(best.table(asked, compared))
            return pa.concat_tables(out) if out else _FOUND.empty_table()

        salt = F.expr(f"_block div {PACKS_PER_SALT}")
        packs = materialize(_pack(queries.select("row_id", "x", "cell", "reach"), ["row_id", "x", "reach"]).select(
            "cell", salt.alias("salt"), F.col("m.row_id").alias("asked"), F.flatten("m.x").alias("qs"), F.col("m.reach").alias("reaches")), "knn-packs")
        # One row per visited cell; a block is repeated for every salt of its cell.
        salts = packs.groupBy("cell").agg(F.max("salt").alias("last"))
        blocks = self.blocks.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        # Packs are few bytes but much work, so they are dealt by number rather than by size.
        tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), packs.count() // PACKS_PER_SALT)
        return packs.repartition(tasks, "cell", "salt").groupBy("cell", "salt").cogroup(
            blocks.repartition(tasks, "cell", "salt").groupBy("cell", "salt")).applyInArrow(
            lambda packs, blocks: search(packs, blocks), "row_id long, near array<struct<d:double,id:long,y:double>>, compared long")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        c = self.cells
        nodes = zip(*(v.tolist() for v in (c.dim, c.cut, c.left, c.right, c.leaf)))
        spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], "node long, dim long, cut double, left long, right long, leaf long") \
            .write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(int(i), lo.tolist(), hi.tolist()) for i, lo, hi in zip(self.cell_ids, self.low, self.high)],
                              "cell long, low array<double>, high array<double>").write.mode("overwrite").parquet(f"{path}/boxes")
        spark.createDataFrame([(json.dumps(asdict(self.params)), self.rows)], "params string, rows long") \
            .write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(path: str) -> KnnModel:
        spark = SparkSession.active()
        nodes = spark.read.parquet(f"{path}/cells").orderBy("node").toPandas()
        boxes = spark.read.parquet(f"{path}/boxes").orderBy("cell").collect()
        kept = spark.read.parquet(f"{path}/params").first()
        return KnnModel(KnnRegressor(**json.loads(kept["params"])), Cells(*[nodes[c].to_numpy() for c in ("dim", "cut", "left", "right", "leaf")]),
                        np.array([b["cell"] for b in boxes]), np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes]),
                        spark.read.parquet(f"{path}/blocks"), kept["rows"])


def _with_cell(df: DataFrame, cells: Cells) -> DataFrame:
    @F.pandas_udf("long")
    def locate(x: pd.Series) -> pd.Series:
        return pd.Series(cells.locate(np.vstack(x)) if len(x) else [], dtype="int64")

    return df.withColumn("cell", locate("x"))


def _in_balls(placed: DataFrame, p: float, most: int = BLOCK_ROWS) -> DataFrame:
    """The rows of each cell in blocks of at most about ``most`` points around a pivot, nearest to it first.

    Cells hold a share of 1 / MAX_CELLS of all rows, or about ``cell_rows`` where that is more.
    """
    def divided(table: pa.Table) -> pa.Table:
        n = table.num_rows
        table = table.combine_chunks()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(n, -1)
        ids, ys = table.column("row_id").to_numpy(), table.column("y").to_numpy()
        parts = split_cells(x, -(-n // most)).locate(x)
        out = []
        for part in np.unique(parts):
            own = np.flatnonzero(parts == part)
            pivot = x[own].mean(axis=0)
            far = _rooted(_distances(x[own], pivot[None], p)[:, 0], p)
            order = np.lexsort((ids[own], far))
            own, far = own[order], far[order]
            out.append((table.column("cell")[0].as_py(), ids[own], x[own].ravel(), ys[own], pivot, far))
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 4]
        return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["cell", "ids", "xs", "ys", "pivot", "far"])

    return placed.select("cell", "row_id", "x", "y").groupBy("cell").applyInArrow(
        lambda t: divided(t), "cell long, ids array<long>, xs array<double>, ys array<double>, pivot array<double>, far array<double>")


def _pack(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each cell packed into blocks of about BLOCK_ROWS rows, as arrays of structs.

    The counts hold one row per cell, and there are at most MAX_CELLS cells.
    """
    sizes = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("_blocks"))
    block = F.pmod(F.xxhash64("row_id"), F.col("_blocks"))
    return df.join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("_block")).agg(
        F.collect_list(F.struct(*columns)).alias("m"))
