"""Work on the pairs inside buckets of any size, in tasks of bounded size.

A bucket is cut in chunks of about `tile` rows by a hash of the node; every pair of chunks is a
tile of its own. All pairs of a bucket meet in some tile, a task holds one tile at a time, and
what it gives back are a few rows for each node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import stored

TILE_ROWS = 512
#: Bytes of the texts of a chunk, where rows carry texts.
TILE_BYTES = 1 << 22


def in_tiles(
    rows: DataFrame,
    key: Sequence[str],
    node: str,
    work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: str,
    tile: int | None = None,
    weight: str | None = None,
    tile_weight: int = TILE_BYTES,
) -> DataFrame:
    """`work(rows, starts)` over whole tiles; `starts` are the first rows of each, the end is the last.

    With a column `weight`, a chunk also holds about `tile_weight` of its sum at most.

    `rows` is read twice and should be a stored table. Buckets of one row are left out. In a tile of
    two chunks the column `half` is 0 for one chunk and 1 for the other, so that `work` can skip the
    pairs inside a chunk, which the tile of that chunk alone holds.
    """
    tile = tile or TILE_ROWS
    chunks = F.ceil(F.col("rows_") / tile)
    if weight:
        chunks = F.least(F.greatest(chunks, F.ceil(F.col("weight_") / tile_weight)), F.col("rows_"))
    sizes = stored(
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.col(weight) if weight else F.lit(0)).alias("weight_"))
        .where("rows_ > 1")
        .select(*key, chunks.cast("int").alias("chunks")),
        "bucket-sizes",
    )
    chunk = F.pmod(F.xxhash64(F.lit(17), F.col(node)), F.col("chunks")).cast("int")
    placed = (
        rows.join(sizes, list(key))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("tile_low", F.least("chunk", "other"))
        .withColumn("tile_high", F.greatest("chunk", "other"))
        .withColumn("half", (F.col("chunk") != F.col("tile_low")).cast("int"))
        .drop("chunks", "chunk", "other")
    )
    group = [*key, "tile_low", "tile_high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, group):
            yield work(frame, starts)

    return placed.repartition(*group).sortWithinPartitions(*group, node).mapInPandas(run, schema)


def whole_groups(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From sorted batches: frames that end with a group, and where their groups start."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        starts = _starts(batch, group)
        last = starts[-1]
        if last:
            yield batch.iloc[:last], starts[:-1]
        rest = batch.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, _starts(rest, group)


def _starts(frame: pd.DataFrame, group: Sequence[str]) -> np.ndarray:
    changed = np.zeros(len(frame), dtype=bool)
    changed[0] = True
    for name in group:
        values = frame[name].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first row that each row reaches."""
    root = np.full(len(linked), -1)
    for at in range(len(linked)):
        if root[at] >= 0:
            continue
        root[at] = at
        front = np.array([at])
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = at
    return root
