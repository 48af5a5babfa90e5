"""Shards of near-equal bytes by a k-d tree over metadata, in column functions alone."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiremill.llm.common import stored, unit_hash

SHARDS = 16
#: Parts a range is cut in at each step of the search for a median.
PARTS = 1024
#: The search ends when the part that holds the median has at most this share of a leaf's bytes.
PRECISION = 0.002
#: Groups of equal texts above this share of a leaf are placed one by one, so they are at most
#: SHARDS / HEAVY_SHARE and their list is bounded.
HEAVY_SHARE = 0.02


@dataclass
class Node:
    """A node of the tree: the shards below it, the bytes it has room for, and where it was split."""

    first: int
    shards: int
    dimension: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def text_size(text: Column) -> Column:
    """Bytes of the text plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that equal texts share: bytes, bytes beyond one per character, and spaces."""
    text = F.coalesce(text, F.lit(""))
    return {
        "dim_bytes": F.octet_length(text),
        "dim_wide": F.octet_length(text) - F.length(text),
        "dim_spaces": F.length(text) - F.length(F.translate(text, " ", "")),
    }


def shard(
    docs: DataFrame, text: str = "text", dimensions: dict[str, Column] | None = None, shards: int = SHARDS,
    keep: Sequence[str] = (), carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: the columns of `keep` and `carry`, size, text_crc32, shard, slot.

    Nodes split until each is one shard. A node splits along the dimension with the widest range of
    its rows, as a share of the range of all rows, at the weighted median of (value, hash of the text):
    the bytes on either side are in proportion to the shards there. Medians come from sums over parts
    of the range, cut finer at each step; what reaches the driver are sums of PARTS parts per node.
    Equal texts stay together: groups large enough to disturb a shard are placed first, each where most
    room is left, and the tree divides the rest by the room that remains. The rows of a group larger than
    any room are numbered and dealt out in exact counts. Rows are written once, a file for each shard a task
    meets, and numbered by their place in the files, so no row moves. `carry` are wide columns: `docs` is read
    again for them. `dimensions` are non-negative integer columns below 2^31 that equal texts share.
    """
    every = docs.select(
        *[F.col(c) for c in (*keep, *carry)], text_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash_"),
        *[column.cast("long").alias(f"{name}_") for name, column in (dimensions or text_dimensions(F.col(text))).items()],
    )
    base = stored(every.drop(*carry), "shard-rows")
    names = [f"{name}_" for name in (dimensions or text_dimensions(F.col(text)))]
    facts = base.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"),
        *[F.max(n).alias(f"max_{n}") for n in names], *[F.min(n).alias(f"min_{n}") for n in names],
    ).first()
    leaf = max(facts["bytes"] / shards, 1)
    spans = {n: max((facts[f"max_{n}"] or 0) - (facts[f"min_{n}"] or 0), 1) for n in names}
    room = [float(leaf)] * shards
    heavy = (
        base.groupBy("text_hash_").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("bytes") > HEAVY_SHARE * leaf).orderBy(F.desc("bytes"), "text_hash_").collect()
    )
    placed = _place(heavy, room)
    beyond = [key for key, own in placed.items() if len(own) > 1]
    table = _small_table(
        docs.sparkSession,
        [{"heavy_hash_": key, "heavy_home_": -1 - beyond.index(key) if key in beyond else own[0][1]} for key, own in placed.items()],
        "heavy_hash_: bigint, heavy_home_: int",
    )
    own_key = F.col("text_hash_") == F.col("heavy_hash_")
    rest = base.join(F.broadcast(table), own_key, "left_anti")
    root = Node(0, shards)
    level = [root]
    while any(node.shards > 1 for node in level):
        _split(rest, root, [n for n in level if n.shards > 1], names, spans, room, leaf)
        level = [child for n in level for child in ((n.left, n.right) if n.left else (n,))]
    marked = (every if carry else base).join(F.broadcast(table), own_key, "left")
    home = F.coalesce("heavy_home_", _shard_of(root)).alias("home_")
    columns = [*keep, *carry, "size", "text_crc32"]
    homes = stored(marked.select(*columns, home), "shard-homes", by=["home_"])
    return _numbered(homes, {-1 - i: placed[key] for i, key in enumerate(beyond)}, columns)


def _small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows, made of a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _place(heavy: Sequence, room: list[float]) -> dict[int, list[tuple[int, int]]]:
    """For each large group, by its text hash, from which of its rows on it goes to which shard.

    `room` loses the bytes placed. Largest first, each to the shard with most room. A group that fits nowhere
    fills shards with as many whole rows as each has room for, most room first; what is left then goes one
    row at a time to where most room is, so no shard is over by more than a row.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    for row in heavy:
        size, left = row["bytes"] / row["rows"], row["rows"]
        order = sorted(range(len(room)), key=lambda i: (-room[i], i))
        if row["bytes"] <= room[order[0]]:
            counts = {order[0]: left}
        else:
            counts = {i: max(0, math.floor(room[i] / size + 1e-9)) for i in order}
            for i in order:
                counts[i] = min(counts[i], left)
                left -= counts[i]
            most = sorted(range(len(room)), key=lambda i: (counts[i] * size - room[i], i))
            for place, i in enumerate(most):
                counts[i] += left // len(room) + (place < left % len(room))
        own, low = [], 0
        for i, n in counts.items():
            if n:
                own.append((low, i))
                low += n
                room[i] -= n * size
        out[row["text_hash_"]] = own
    return out


def _key(dimension: str) -> Column:
    """Value of the dimension, then 32 bits of the text's hash: one order without ties between texts."""
    return F.shiftleft(F.col(dimension), 32) + F.shiftrightunsigned(F.col("text_hash_"), 32)


def _node_of(root: Node) -> Column:
    """The first shard of the leaf of the tree so far that holds a row."""
    if root.left is None:
        return F.lit(root.first)
    return F.when(_key(root.dimension) < F.lit(root.cut), _node_of(root.left)).otherwise(_node_of(root.right))


_shard_of = _node_of


def _split(
    rest: DataFrame, root: Node, nodes: Sequence[Node], names: Sequence[str], spans: dict[str, int],
    room: Sequence[float], leaf: float,
) -> None:
    """Split every given leaf of the tree; all of them share each pass over the rows."""
    rows = rest.withColumn("node", _node_of(root))
    ranges = {
        r["node"]: r
        for r in rows.groupBy("node")
        .agg(F.sum("size").alias("bytes"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)])
        .collect()
    }
    search: dict[int, list] = {}
    for node in nodes:
        seen = ranges.get(node.first)
        width = {n: (seen[f"max_{n}"] - seen[f"min_{n}"]) / spans[n] if seen else 0.0 for n in names}
        node.dimension = max(names, key=lambda n: (width[n], -names.index(n)))
        half = node.shards // 2
        left_room = max(sum(room[node.first : node.first + half]), 0.0)
        all_room = max(sum(room[node.first : node.first + node.shards]), 1e-9)
        wanted = (seen["bytes"] if seen else 0) * left_room / all_room
        low = seen[f"min_{node.dimension}"] << 32 if seen else 0
        high = (seen[f"max_{node.dimension}"] + 1) << 32 if seen else 0
        node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
        node.cut = high
        if seen:
            search[node.first] = [node, low, high, wanted, 0.0]
    while search:
        which, step, low_of = F.lit(None), F.lit(None), F.lit(None)
        key = F.lit(None)
        for first, (node, low, high, _, _) in search.items():
            own = F.col("node") == first
            key = F.when(own, _key(node.dimension)).otherwise(key)
            low_of = F.when(own, F.lit(low)).otherwise(low_of)
            which = F.when(own, F.lit(high)).otherwise(which)
            step = F.when(own, F.lit(max(1, -(-(high - low) // PARTS)))).otherwise(step)
        cut = (
            rows.withColumn("key", key).withColumn("low", low_of).withColumn("high", which).withColumn("step", step)
            .where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")))
            .withColumn("part", F.floor((F.col("key") - F.col("low")) / F.col("step")))
        )
        parts: dict[int, dict[int, int]] = {}
        for r in cut.groupBy("node", "part").agg(F.sum("size").alias("bytes")).collect():
            parts.setdefault(r["node"], {})[int(r["part"])] = r["bytes"]
        for first in list(search):
            node, low, high, wanted, before = search[first]
            width = max(1, -(-(high - low) // PARTS))
            sums = before
            for number, own in sorted(parts.get(first, {}).items()):
                if sums + own >= wanted:
                    start, stop = low + number * width, min(high, low + (number + 1) * width)
                    if own <= PRECISION * leaf or width == 1:
                        node.cut = start if wanted - sums < own / 2 else stop
                        del search[first]
                    else:
                        search[first] = [node, start, stop, wanted, sums]
                    break
                sums += own
            else:
                node.cut = high
                del search[first]


def _numbered(homes: DataFrame, split: dict[int, list[tuple[int, int]]], columns: Sequence[str]) -> DataFrame:
    """The stored rows with shard and slot: from 0 without gaps in each shard, by file and place in the file.

    `home_` is a shard or, below 0, a group of `split`, whose rows go to shards in ranges of their places.
    """
    rows = homes.withColumns({"file_": F.col("_metadata.file_path"), "index_": F.col("_metadata.row_index")})
    before = Window.partitionBy("home_").orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("home_", "file_").agg(F.count(F.lit(1)).alias("n_")).withColumn(
        "before_", F.coalesce(F.sum("n_").over(before), F.lit(0))
    )
    files = stored(files, "shard-files")
    held = {r["home_"]: r["n"] for r in files.groupBy("home_").agg(F.sum("n_").alias("n")).collect()}
    ranges = {home: [{"low": 0, "shard": home, "slot": 0}] for home in held if home >= 0}
    taken = {home: n for home, n in held.items() if home >= 0}
    for home, own in split.items():
        ends = [*[low for low, _ in own[1:]], held[home]]
        ranges[home] = [{"low": low, "shard": number, "slot": taken.get(number, 0)} for low, number in own]
        # a group meets a shard at most once
        for (low, number), end in zip(own, ends, strict=True):
            taken[number] = taken.get(number, 0) + end - low
    table = _small_table(
        homes.sparkSession, [{"home_": home, "ranges_": own} for home, own in ranges.items()],
        "home_: int, ranges_: array<struct<low: bigint, shard: int, slot: bigint>>",
    )
    starts = files.join(F.broadcast(table), "home_").select("home_", "file_", "before_", "ranges_")
    place = F.col("before_") + F.col("index_")
    own = F.element_at(F.filter("ranges_", lambda x: x["low"] <= place), -1)
    return rows.join(F.broadcast(starts), ["home_", "file_"]).select(
        *columns, own["shard"].alias("shard"), (own["slot"] + place - own["low"]).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`. Defined cases: a null text counts as an empty one; a null id stays null;
    repeated rows are documents of their own; fewer texts than shards leave shards empty; an empty
    table gives an empty result; other columns are ignored.
    """
    return shard(docs, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents, all columns, with shard and slot; columns of these names are replaced."""
    packed = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("row_"))
    found = shard(packed, shards=shards, carry=["row_"])
    own = [F.col("row_")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return found.select(*own, F.col("shard").cast("int").alias("shard"), "slot")
