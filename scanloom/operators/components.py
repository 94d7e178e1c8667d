"""Connected components of a link table by hooking and pointer jumping, all as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.storage import cut

MAX_ROUNDS = 200
#: Up to so many links (16 bytes each) are solved by one task; more by rounds of joins.
SMALL = 1_000_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked node with the smallest id it reaches. ``links`` has two columns of longs.

    Every round takes the least label of each node's neighbours, passes it to the node its old label names and then
    jumps to the label's own label, so paths shrink by a constant factor a round. No node's neighbours
    are ever gathered: each step is a min() that is combined before its shuffle. Labels are checkpointed
    in the shared folder each round. No links give an empty table; loops and repeated links change nothing.
    """
    edges = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y").unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")).where("x != y")).distinct())
    labels = cut(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.min("x")).alias("component")))
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels, edges.y == labels.id).groupBy("x").agg(F.min("component").alias("low"))
        moved = labels.join(near, labels.id == near.x).select("id", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        hooks = moved.groupBy(F.col("old").alias("root")).agg(F.min("new").alias("hook"))
        hooked = moved.join(hooks, F.col("id") == F.col("root"), "left").select("id", "old", F.least("new", "hook").alias("new"))
        target = hooked.select(F.col("id").alias("at"), F.col("new").alias("jump"))
        jumped = cut(hooked.join(target, F.col("new") == F.col("at")).select("id", "old", F.col("jump").alias("component")))
        changed = jumped.where("component != old").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    table = pa.Table.from_batches(kept)
    ids, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    x, y = at[: table.num_rows], at[table.num_rows :]
    label = np.arange(len(ids))
    while True:  # least label over each link, then jumps; ids are sorted, so places order as ids do
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def sized_components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """``components`` of a link table (a, b); a table of at most ``small`` links is solved in one task of bounded size."""
    links = cut(links.select("a", "b"))
    if links.limit(small + 1).count() > small:
        return components(links)
    return links.repartition(1).mapInArrow(_union, "id long, component long")
