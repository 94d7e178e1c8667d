"""Spatial joins as equi-joins on grid cells.

For radius r the grid has cells of edge 2r. The indexed side is copied to each cell its box [c - r, c + r] meets: two per
axis, 8 in all for most points. A query point lies in one cell only, so its partners
meet it there, each exactly once, and what follows the join can be grouped by (cell, query) without another shuffle.
Spark's size estimates count neither these copies nor structs' fields, so an index of many times the broadcast limit would go
through the driver: ``met`` always deals both sides out by cell.

Where a kernel looks partners up, points are dealt by tiles instead: cubes of many cells, whose border alone is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from scanloom.functions import geometry as g
from scanloom.functions.kernels import CellIndex, k_nearest
from scanloom.storage import cut

CELL = ("__cx", "__cy", "__cz")
TILE = ("__tx", "__ty", "__tz")
_SLACK = 1.0 + 1e-6
#: Points of a tile at most, while tiles stay above four reaches and below TILES in number.
TILE_POINTS = 100_000
TILES = 65_536
#: Points a kernel index holds at most: about 100 MB with normals.
KERNEL_POINTS = 2_000_000


def _edge(radius: float) -> float:
    return 2.0 * radius * _SLACK


def first_at_place(df: DataFrame, payload: Sequence[str] = (), keys: Sequence[str] = (), point: Sequence[str] = ("x", "y", "z"), idx: str = "idx") -> DataFrame:
    """Of the points at one place the one of least index: all that a nearest join can find. Combined before its shuffle."""
    own = F.min_by(F.struct(idx, *point, *payload), F.col(idx)).alias("__own")
    return df.groupBy(*keys, *(F.col(c).alias(f"__at_{i}") for i, c in enumerate(point))).agg(own).select(*keys, "__own.*")


def indexed(df: DataFrame, radius: float, payload: Sequence[str] = (), keys: Sequence[str] = (), point: Sequence[str] = ("x", "y", "z"), idx: str = "idx", copies: bool = True) -> DataFrame:
    """The indexed side: one row for each cell that a point's box meets. Worth caching when it serves many queries.

    Without ``copies`` only one point of each place is kept, as nearest and semi joins need no more.
    """
    df = df if copies else first_at_place(df, payload, keys, point, idx)
    size, reach = _edge(radius), radius * _SLACK
    out = df.select(*keys, F.col(idx).alias("r_idx"), *(F.col(c).alias(f"r_{a}") for c, a in zip(point, "xyz")), *(F.col(c).alias(f"r_{c}") for c in payload))
    for name, a in zip(CELL, "xyz"):
        c = F.col(f"r_{a}").cast("double")
        cells = F.sequence(F.floor((c - reach) / size).cast("long"), F.floor((c + reach) / size).cast("long"))
        out = out.withColumn(name, F.explode(cells))
    return out


def placed(df: DataFrame, radius: float, point: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The query side: each point with its one cell."""
    return df.withColumns({name: g.cell(F.col(c), _edge(radius)) for name, c in zip(CELL, point)})


def within(radius: float, kind: str, point: Sequence[str]) -> tuple[Column, Column]:
    """Squared distance of a joined pair, and whether it is within the radius."""
    d2 = g.squared_distance(tuple(F.col(c) for c in point), tuple(F.col(f"r_{a}") for a in "xyz"), kind)  # type: ignore[arg-type]
    limit = F.lit(radius).cast(kind)
    return d2, d2 <= limit * limit


def met(queries: DataFrame, index: DataFrame, condition: Column, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Query rows (alias q) joined with the indexed rows (alias i) of their cell and keys; never by a broadcast of either side."""
    for c in (*keys, *CELL):
        condition = condition & (F.col(f"q.{c}") == F.col(f"i.{c}"))
    return queries.alias("q").join(index.alias("i").hint("merge"), condition, how)


def nearest_join(queries: DataFrame, index: DataFrame, radius: float, payload: Sequence[str] = (), keys: Sequence[str] = (), kind: str = "float", point: Sequence[str] = ("x", "y", "z"), idx: str = "idx") -> DataFrame:
    """Left join: every query row with its nearest indexed row within ``radius`` (inclusive), least index on ties.

    Adds r_idx, r_distance and r_<payload>, null where there is none. ``index`` is ``indexed(..., radius, payload, keys)``.
    ``kind`` is the arithmetic of distances and bound: "float" as in comparisons, "double" as in registration.
    """
    d2, near = within(radius, kind, point)
    pairs = met(placed(queries, radius, point), index, near, keys, "left")
    best = F.struct(d2.alias("d2"), F.col("r_idx"), *(F.col(f"r_{c}") for c in ("x", "y", "z", *payload)))
    columns = [c for c in queries.columns]
    grouped = pairs.groupBy(*(F.col(f"q.{c}").alias(c) for c in (*keys, *CELL, idx)))
    rest = [c for c in columns if c not in (*keys, idx)]
    # the other query columns are equal in each group
    found = grouped.agg(F.min(F.when(F.col("r_idx").isNotNull(), best)).alias("__best"), F.first(F.struct(*(F.col(f"q.{c}").alias(c) for c in rest))).alias("__own"))
    own = {c: F.col(f"__own.{c}") for c in rest}
    return found.select(
        *(own.get(c, F.col(c)).alias(c) for c in columns),
        F.col("__best.r_idx").alias("r_idx"), F.sqrt(F.col("__best.d2")).cast(kind).cast("double").alias("r_distance"),
        *(F.col(f"__best.r_{c}").alias(f"r_{c}") for c in ("x", "y", "z", *payload)),
    )


def tile_edge(points: DataFrame, reach: float) -> tuple[float, int]:
    """The longest edge, from four reaches up by doubling, whose tiles hold at most TILE_POINTS points; longer if they were more than TILES.

    With it the points of its fullest tile.
    """
    low = 4.0 * reach * _SLACK
    cells = points.groupBy(*(g.cell(F.col(c), low).alias(t) for c, t in zip("xyz", TILE))).agg(F.count("*").alias("n"))
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(30))))
    up = [F.expr(f"shiftright({t}, level)").alias(t) for t in TILE]
    tiles = levels.groupBy("level", *up).agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("most"), F.count("*").alias("tiles"))
    found = sorted((r["level"], r["most"], r["tiles"]) for r in tiles.collect())
    best, most = found[0][0], found[0][1]
    for (level, n, _), (_, _, finer) in zip(found[1:], found):
        if n <= TILE_POINTS or finer > TILES:
            best, most = level, n
    return low * 2.0**best, most


def tiled(points: DataFrame, edge: float, reach: float) -> DataFrame:
    """One row for each tile that a point's box meets."""
    for name, c in zip(TILE, "xyz"):
        at = F.col(c).cast("double")
        points = points.withColumn(name, F.explode(F.sequence(F.floor((at - reach * _SLACK) / edge).cast("long"), F.floor((at + reach * _SLACK) / edge).cast("long"))))
    return points


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch, bool]]:
    """Runs of one tile in rows that are sorted by tile: the tile, its rows as far as the batch goes, and whether they begin it."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(batch.schema.get_field_index(t)).to_numpy() for t in TILE])
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for first, last in zip([0, *ends], ends):
            tile = tuple(keys[first].tolist())
            yield tile, batch.slice(first, last - first), tile != before
            before = tile


def knn_in_tiles(points: DataFrame, k: int, radius: float, edge: float, finish: Callable[[np.ndarray], np.ndarray], names: Sequence[str], asked: DataFrame | None = None) -> DataFrame:
    """``points``, or those of them ``asked`` for, with what ``finish`` makes of the k nearest points of each, itself included, by (d2, index).

    ``finish`` takes places (n, k, 3) in index order and gives a column for each name. Rows of points with fewer than k within
    ``radius`` have nulls. A worker holds a tile's points and all their columns.
    """
    kept = [c for c in points.columns if c != "idx"]
    at = {t: g.cell(F.col(c), edge) for t, c in zip(TILE, "xyz")}
    rows = tiled(points.select("idx", *kept), edge, radius)
    if asked is None:
        rows = rows.withColumn("__ask", (F.col(TILE[0]) == at[TILE[0]]) & (F.col(TILE[1]) == at[TILE[1]]) & (F.col(TILE[2]) == at[TILE[2]]))
    else:
        asked = asked.select("idx", *kept).withColumns(at)
        rows = rows.join(asked.select(*TILE).distinct(), list(TILE), "left_semi").withColumn("__ask", F.lit(False)).unionByName(asked.withColumn("__ask", F.lit(True)))
    dealt, apart = rows.repartition(*TILE).sortWithinPartitions(*TILE, "idx"), asked is not None
    schema = StructType([*(f for f in points.select("idx", *kept).schema), *(StructField(c, DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(pieces).combine_chunks()
            ask = table["__ask"].to_numpy()
            if not ask.any():
                return
            table = table.select(["idx", *kept])
            if apart:  # a row asks for the point of its index in another row
                ids, table = table["idx"].to_numpy()[ask], table.filter(pa.array(~ask)).combine_chunks()
                wanted = np.searchsorted(table["idx"].to_numpy(), ids)
            else:
                wanted = np.flatnonzero(ask)
            p = np.column_stack([table[c].to_numpy() for c in "xyz"]).astype(float)
            for some, near in k_nearest(p, wanted, k, radius):
                whole = near[:, 0] >= 0
                values = np.full((len(some), len(names)), np.nan)
                if whole.any():
                    values[whole] = finish(p[near[whole]])
                own = table.take(pa.array(some)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(v, mask=~whole) for v in values.T)], names=schema.names)

        pieces: list[pa.RecordBatch] = []
        for _, rows, begins in tiles_of(batches):
            if begins and pieces:
                yield from solved(pieces)
                pieces = []
            pieces.append(rows)
        if pieces:
            yield from solved(pieces)

    return dealt.mapInArrow(run, schema)


class KernelIndex:
    """A cloud of bounded size held by every worker: nearest neighbours without a shuffle."""

    def __init__(self, points: DataFrame, radius: float, payload: Sequence[str], kind: str, point: Sequence[str] = ("x", "y", "z"), idx: str = "idx") -> None:
        chosen = points.select(F.col(idx).alias("r_idx"), *(F.col(c).alias(f"r_{a}") for c, a in zip(point, "xyz")), *(F.col(c).alias(f"r_{c}") for c in payload))
        self.schema, self.radius, self.kind = chosen.schema, radius, kind
        table = chosen.toArrow().sort_by("r_idx").combine_chunks()
        places = np.column_stack([table[f"r_{a}"].to_numpy() for a in "xyz"]).astype(np.float32 if kind == "float" else float).reshape(-1, 3)
        self.sent = points.sparkSession.sparkContext.broadcast((CellIndex(places, radius) if len(places) else None, table))

    def close(self) -> None:
        self.sent.destroy()


def index_for(points: DataFrame, radius: float, payload: Sequence[str] = (), keys: Sequence[str] = (), kind: str = "float", limit: int = KERNEL_POINTS) -> KernelIndex | DataFrame:
    """A kernel index while there are at most ``limit`` points and no keys; the cell-keyed table beyond."""
    if not keys and points.limit(limit + 1).count() <= limit:
        return KernelIndex(points, radius, payload, kind)
    return indexed(points, radius, payload, keys, copies=False)


def nearest(queries: DataFrame, index: KernelIndex | DataFrame, radius: float, payload: Sequence[str] = (), keys: Sequence[str] = (), kind: str = "float") -> DataFrame:
    """``nearest_join`` by either kind of index; the results are the same."""
    if not isinstance(index, KernelIndex):
        return nearest_join(queries, index, radius, payload, keys, kind)
    assert (index.radius, index.kind) == (radius, kind)
    sent, at = index.sent, [queries.columns.index(c) for c in "xyz"]
    added = [f for f in index.schema if f.name != "r_idx"]
    schema = StructType([*queries.schema, StructField("r_idx", LongType()), StructField("r_distance", DoubleType()), *(StructField(f.name, f.dataType) for f in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, table = sent.value
        names = [f.name for f in schema]
        for batch in batches:
            if not batch.num_rows:
                continue
            if cells is None:
                place, d2 = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            else:
                q = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at]).astype(cells.points.dtype)
                place, d2 = cells.search(q)
            take = pa.array(place, mask=place < 0)
            distance = np.sqrt(np.where(place < 0, 0, d2).astype(float)).astype(np.float32 if kind == "float" else float).astype(float)
            found = [pa.array(distance, mask=place < 0), *(table[f.name].combine_chunks().take(take) for f in added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, table["r_idx"].combine_chunks().take(take), *found], names=names)

    return queries.mapInArrow(run, schema)


def radius_join(queries: DataFrame, index: DataFrame, radius: float, keys: Sequence[str] = (), kind: str = "double", point: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Inner join: every (query row, indexed row) within ``radius``, inclusive, with d2. Rows stay dealt by (keys, cell)."""
    d2, near = within(radius, kind, point)
    kept = [F.col(f"q.{c}").alias(c) for c in (*queries.columns, *CELL)]
    more = [F.col(f"i.{c}").alias(c) for c in index.columns if c not in (*keys, *CELL)]
    return met(placed(queries, radius, point), index, near, keys).select(*kept, *more, d2.alias("d2"))


def knn_join(points: DataFrame, k: int, radius: float, idx: str = "idx", max_rounds: int = 40, queries: DataFrame | None = None) -> DataFrame:
    """(idx, r_idx, rank, d2, r_x, r_y, r_z): the k nearest points of each point, itself included, by (d2, index).

    Starts at ``radius``; points with fewer than k partners are looked up again at twice the radius. Those with k are
    complete, as everything within the radius has been seen. Points with fewer than k others keep them all.
    Of the points at one place only the k of least index are looked up: others rank behind them. ``queries``: those of the points to look up.
    """
    total = points.count()
    k = min(k, total)
    out, left = None, points if queries is None else queries
    place = Window.partitionBy("x", "y", "z").orderBy(idx)
    near = cut(points.select(idx, "x", "y", "z", F.row_number().over(place).alias("__copy")).where(F.col("__copy") <= k).drop("__copy"))
    for _ in range(max_rounds):
        pairs = radius_join(left.select(idx, "x", "y", "z"), indexed(near, radius, idx=idx), radius)
        window = Window.partitionBy(*CELL, idx)
        ranked = pairs.withColumns({"rank": F.row_number().over(window.orderBy("d2", "r_idx")), "__n": F.count("*").over(window)})
        done = ranked.where((F.col("__n") >= k) & (F.col("rank") <= k)).select(idx, "r_idx", "rank", "d2", "r_x", "r_y", "r_z")
        out = done if out is None else out.unionByName(done)
        left = left.join(done.select(F.col(idx).alias("__done")).distinct(), F.col(idx) == F.col("__done"), "left_anti")
        left = cut(left)
        if not left.limit(1).count():
            return out
        radius *= 2.0
    raise RuntimeError(f"k nearest points not found after {max_rounds} radii")


def exhaustive_nearest(queries: DataFrame, points: DataFrame, radius: float, idx: str = "idx") -> DataFrame:
    """Every pair compared: an oracle for tests on small tables, not part of any plan."""
    q = queries.select(F.col(idx).alias("q_idx"), *(F.col(c).alias(f"q_{c}") for c in "xyz"))
    p = points.select(F.col(idx).alias("p_idx"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    d2 = g.squared_distance(g.vector("q_"), g.vector("p_"))
    return q.crossJoin(p).where(d2 <= radius * radius).groupBy("q_idx").agg(F.min(F.struct(d2.alias("d2"), "p_idx")).alias("best")).select(F.col("q_idx").alias(idx), "best.p_idx", "best.d2")
