"""SimHash near-duplicates: fingerprints of word shingles, linked through shared blocks of bits."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.llm.buckets import in_tiles, roots
from hiremill.llm.common import sifted, stored
from hiremill.llm.components import components

BITS = 64
SEED = 42
#: Shingles counted at a time, so that a very long text needs bounded memory.
COUNT_ROWS = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 without words.

    ASCII capitals are lowered, words end at ASCII spaces, a shingle is `width` words with one
    space between them; a shorter text is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - width + 1
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, COUNT_ROWS):
        spans = zip(first[at : at + COUNT_ROWS], last[at : at + COUNT_ROWS], strict=True)
        hashes = np.fromiter(
            (digest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=min(COUNT_ROWS, n - at)
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((counts * 2 > n) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, width) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return compute(text)


def block_masks(distance: int, rows: int, bits: int = BITS) -> list[int]:
    """Masks such that any two fingerprints at most `distance` bits apart agree under one of them.

    With b blocks, two such fingerprints agree in at least b - distance of them, so each choice of
    that many blocks is a key. b is the smallest with a key of at least log2(rows) bits: random
    fingerprints then rarely share a bucket. The links found are the same for every b.
    """
    wanted = math.log2(max(rows, 2))
    blocks = distance + 1
    while bits * (blocks - distance) / blocks < wanted and blocks < distance + 6:
        blocks += 1
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(parts[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - distance)]


def fingerprint_links(fingerprints: DataFrame, distance: int = 4) -> DataFrame:
    """(left, right): links that join all fingerprints at most `distance` bits apart, directly or in steps.

    `fingerprints` is a stored table with distinct longs in the column fp.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance, fingerprints.count())]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    rows = fingerprints.select("fp", F.explode(keys).alias("key")).select("key.mask", "key.part", "fp")

    def link(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64)
        stops = np.append(starts[1:], len(fp))
        twos = starts[stops - starts == 2]
        close = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= distance]
        left, right = [fp[close]], [fp[close + 1]]
        for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            if stop - start > 2:
                own = fp[start:stop]
                linked_rows = [np.bitwise_count(own[i : i + 64, None] ^ own[None, :]) <= distance for i in range(0, len(own), 64)]
                root = roots(np.concatenate(linked_rows))
                linked = np.flatnonzero(root != np.arange(len(own)))
                left.append(own[root[linked]])
                right.append(own[linked])
        return pd.DataFrame({"left": np.concatenate(left).view(np.int64), "right": np.concatenate(right).view(np.int64)})

    return in_tiles(rows, ["mask", "part"], "fp", link, "left long, right long")


def fingerprint_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Per document: `doc_id`, the columns of `keep`, fp, component (a fingerprint, never null), component_id."""
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), width).alias("fp"),
            *[F.col(c) for c in keep],
        ),
        "fingerprints",
    )
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(fingerprint_links(nodes.select("fp"), distance))
    member = stored(
        nodes.join(found, nodes["fp"] == found["node"], "left").select(
            "fp", "low", F.coalesce("component", "fp").alias("component")
        ),
        "members",
    )
    least = stored(member.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = stored(member.join(least, "component").select("fp", "component", "component_id"), "named")
    return rows.join(named, "fp")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest document id that links of at most `distance` differing bits reach,
    the document's own included. Equal fingerprints are one node, so copies cost one row however
    many there are. Defined cases: a null or empty text has fingerprint zero and is linked like any
    other; a null id is never the smallest (null only where the whole group has none); repeated rows
    stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    return fingerprint_groups(docs, text, doc_id, width, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the one of the smallest id.

    Rows with a null id come last; among rows of one id a checksum of the row decides. Of rows that
    are equal in every column one stays. Columns of map type do not take part in the checksum.
    """
    return first_of_groups(
        docs, doc_id, lambda marked: fingerprint_groups(marked, text, doc_id, width, distance, ["row_check_"])
    )


def first_of_groups(docs: DataFrame, doc_id: str, groups_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents that come first in their group; `groups_of` gives doc_id, row_check_ and component of each row."""
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    marked = docs.withColumn("row_check_", F.xxhash64(*plain)).withColumn("row_id_", F.col(doc_id))
    members = stored(groups_of(marked).select("doc_id", "row_check_", "component"), "group-members")
    first = members.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_check_")).alias("row")
    )
    chosen = stored(first.select(F.col("row.doc_id").alias("chosen_id_"), F.col("row.row_check_").alias("chosen_check_")), "chosen")

    def match(rows: DataFrame, name: str) -> Column:
        return rows["row_check_"].eqNullSafe(chosen["chosen_check_"]) & rows[name].eqNullSafe(chosen["chosen_id_"])

    # rows that are chosen and not repeated stay where they are; the others meet the chosen ones
    left_out = members.join(chosen, match(members, "doc_id"), "left_anti").select("row_check_")
    repeated = members.groupBy("row_check_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_check_")
    doubtful, sure = sifted(marked, left_out.unionByName(repeated), "row_check_")
    settled = doubtful.join(chosen, match(doubtful, "row_id_"), "left_semi").dropDuplicates(["row_id_", "row_check_"])
    return sure.unionByName(settled).select(docs.columns)
