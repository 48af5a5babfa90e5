"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints a few bits apart are candidates, and MinHash bands find those that differ in more bits;
every link is verified with the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.llm.buckets import TILE_BYTES, TILE_ROWS, in_tiles
from hiremill.llm.common import discard, sifted, stored, text_slices
from hiremill.llm.components import components
from hiremill.llm.simhash import fingerprint, fingerprint_links, first_of_groups

WIDTH = 5
SIMILARITY = 0.8
#: A pair at similarity s shares a band with probability 1 - (1 - s**BAND_ROWS)**BANDS: 0.9993 at 0.8.
BANDS = 24
BAND_ROWS = 6
SEED = 23
#: Bits in which fingerprints of candidates may differ, as in `simhash`.
DISTANCE = 4
#: Buckets of at most so many texts are compared pair by pair, each pair once whatever number of buckets holds it.
PAIR_ROWS = 6
#: Shingles after which a run of texts is hashed together.
HASH_ROWS = 1 << 14


def _multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed]).integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(text: str | None) -> int:
    """The same number for texts of the same words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED)).view(np.int64))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles as sorted hashes; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    codes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for number, factor in enumerate(_multipliers(width, 1)):
        out = (out ^ (out >> np.uint64(29))) * factor + codes[number : number + n]
    return np.unique(out ^ (out >> np.uint64(32)))


def band_keys(sets: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each set one key for each band of minima; none for an empty set."""
    out = [np.empty(0, dtype=np.int64)] * len(sets)
    own: list[int] = []
    size = 0
    for number, one in enumerate(sets):
        if len(one):
            own.append(number)
            size += len(one)
        if own and (size >= HASH_ROWS or number + 1 == len(sets)):
            for i, keys in zip(own, _band_keys([sets[i] for i in own]), strict=True):
                out[i] = keys
            own, size = [], 0
    return out


def _band_keys(sets: Sequence[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    factors, turns = _multipliers(BANDS * BAND_ROWS, 2), _multipliers(BANDS * BAND_ROWS, 3)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
    for i, (factor, turn) in enumerate(zip(factors, turns, strict=True)):
        least = np.minimum.reduceat((flat ^ turn) * factor, starts)
        key = (keys[:, i // BAND_ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, i // BAND_ROWS] = key ^ (key >> np.uint64(29))
    return keys.view(np.int64)


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Similarity of two sets of shingles; an empty set is like nothing."""
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared / max(1, len(one) + len(other) - shared)


def near_edges(sets: list[np.ndarray], groups: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of at least this similarity that join sets of different groups, as many as show what is reached.

    Sets of one group count as linked. From a set all that is not reached yet is compared with it at once.
    """
    sizes = np.array([len(s) for s in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(names, np.cumsum(sizes)[:-1])
    held = np.zeros(len(names), dtype=bool)
    members = {group: np.flatnonzero(groups == group) for group in np.unique(groups)}
    reached = np.zeros(len(sets), dtype=bool)
    left, flat = np.arange(len(sets)), names
    starts = np.cumsum(sizes) - sizes
    edges = []
    for at in range(len(sets)):
        if reached[at]:
            continue
        front = members[groups[at]].tolist()
        reached[front] = True
        while front:
            one = front.pop()
            open_ = ~reached[left]
            if not open_.any():
                break
            if open_.sum() < len(left) / 2:
                left = left[open_]
                flat = np.concatenate([own[i] for i in left])
                starts = np.cumsum(sizes[left]) - sizes[left]
                open_ = np.ones(len(left), dtype=bool)
            held[own[one]] = True
            shared = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[own[one]] = False
            near = left[open_ & (shared >= similarity * (sizes[one] + sizes[left] - shared) - 1e-9)]
            for other in near.tolist():
                if not reached[other]:
                    edges.append((one, other))
                    joined = members[groups[other]]
                    reached[joined] = True
                    front += joined.tolist()
    return edges


def bucket_entries(nodes: DataFrame) -> DataFrame:
    """(band, key, node, leader) of the nodes that share a band with others; the leader is the smallest of them.

    Stored; `nodes` is a stored table of node and bands.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = rows.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(rows.join(stored(leaders.drop("n"), "leaders"), ["band", "key"]), "entries")


def fingerprint_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, leader): nodes whose SimHash fingerprints are linked; `nodes` is a stored table of node and fp."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    equal = nodes.join(heads, "fp").where("node <> head").select("node", F.col("head").alias("leader"))
    links = stored(fingerprint_links(heads.select("fp"), distance).distinct(), "fingerprint-links")
    one, other = heads.select(F.col("fp").alias("left"), F.col("head").alias("leader")), heads.withColumnRenamed("fp", "right")
    near = links.join(one, "left").join(other, "right").select(F.col("head").alias("node"), "leader")
    return equal.unionByName(near)


def star_links(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(left, right): the pairs of node and leader that are similar; `pairs` is stored.

    A leader's nodes are cut in chunks by rows and bytes, with the leader's text beside each.
    """
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int")
    sizes = stored(pairs.join(texts.select("node", "bytes"), "node").groupBy("leader").agg(chunks.alias("chunks")), "star-sizes")
    spread = pairs.join(sizes, "leader").join(texts, "node").select(
        "leader", F.pmod(F.xxhash64(F.lit(29), "node"), F.col("chunks")).cast("int").alias("chunk"), "node", "text",
        F.lit(1).alias("place"),
    )
    heads = sizes.join(texts, sizes["leader"] == texts["node"]).select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "text", F.lit(0).alias("place")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for leader, node, text, place in zip(batch["leader"], batch["node"], batch["text"], batch["place"], strict=True):
                if not place:
                    head, own = leader, shingles(text, width)
                elif head == leader and jaccard(own, shingles(text, width)) >= similarity - 1e-9:
                    out.append((leader, node))
            yield pd.DataFrame(out, columns=["left", "right"], dtype="int64")

    return (
        heads.unionByName(spread).repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "place", "node")
        .mapInPandas(run, "left long, right long")
    )


def similar_links(
    entries: DataFrame, texts: DataFrame, width: int, similarity: float, candidates: DataFrame | None = None
) -> DataFrame:
    """(left, right): stored links that join all texts that share a band and are similar, directly or in steps.

    First each text is compared with one leader, and the pairs of `candidates` (node, leader) are. What buckets
    then still hold texts of several groups are compared whole, group against group: small ones by their pairs,
    without those compared before, others in tiles. No pair of a bucket is left out.
    """
    pairs = entries.where("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
    if candidates is not None:
        pairs = pairs.unionByName(candidates.select("node", "leader")).select(
            F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")
        ).distinct()
    pairs = stored(pairs, "stars")
    first = stored(star_links(pairs, texts, width, similarity), "star-links")
    groups = stored(components(first), "star-groups")
    named = stored(
        entries.drop("leader").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"),
        "named-entries",
    )
    several = stored(
        named.groupBy("band", "key")
        .agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count(F.lit(1)).alias("n"))
        .where("least <> most").select("band", "key", "n"),
        "open-buckets",
    )
    few = stored(named.join(several.where(F.col("n") <= PAIR_ROWS).drop("n"), ["band", "key"]), "small-buckets")
    other = few.select("band", "key", F.col("node").alias("leader"), F.col("group").alias("of"))
    across = few.join(other, ["band", "key"]).where((F.col("leader") < F.col("node")) & (F.col("of") != F.col("group")))
    left_out = stored(across.select("node", "leader").distinct().join(pairs, ["node", "leader"], "left_anti"), "pairs")
    second = stored(star_links(left_out, texts, width, similarity), "pair-links")
    open_ = named.join(several.where(F.col("n") > PAIR_ROWS).drop("n"), ["band", "key"])
    # a node's text travels once for each of its large open buckets
    rows = stored(open_.join(texts, "node").select("band", "key", "node", "group", "text", "bytes"), "open-texts")

    def link(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        nodes, group, text = frame["node"].to_numpy(), frame["group"].to_numpy(), frame["text"].tolist()
        left, right = [], []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            if stop - start > 1 and (group[start:stop] != group[start]).any():
                sets = [shingles(t, width) for t in text[start:stop]]
                for one, other in near_edges(sets, group[start:stop], similarity):
                    left.append(nodes[start + one])
                    right.append(nodes[start + other])
        return pd.DataFrame({"left": left, "right": right}, dtype="int64")

    third = stored(
        in_tiles(rows, ["band", "key"], "node", link, "left long, right long", weight="bytes"), "tile-links"
    )
    discard(rows)
    return first.unionByName(second).unionByName(third)


def _prints_column(text: Column, width: int) -> Column:
    """Of each text: node (its key), bands and fp, the fingerprint."""

    @F.arrow_udf("node long, bands array<long>, fp long")
    def compute(texts: pa.Array) -> pa.Array:
        nodes, bands, prints = [], [], []
        for own in text_slices(texts):
            nodes += [text_key(t) for t in own]
            bands += band_keys([shingles(t, width) for t in own])
            prints += [fingerprint(t, width) for t in own]
        ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
        flat = np.concatenate([np.empty(0, dtype=np.int64), *bands])
        codes = np.array(prints, dtype=np.uint64).view(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array(codes)], ["node", "bands", "fp"]
        )

    return compute(text)


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, similarity: float = SIMILARITY
) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the one of the smallest id.

    Texts are linked if the Jaccard similarity of their word shingles is at least `similarity`; groups
    are what links reach. Texts of the same words are one node. Defined cases: null and empty texts
    are copies of each other and of nothing else; null ids and repeated rows as in `simhash.keep_one`;
    an empty table gives an empty result.
    """

    text_name = text

    def groups(marked: DataFrame) -> DataFrame:
        rows = stored(
            marked.select(
                F.col(doc_id).alias("doc_id"), "row_check_", _prints_column(F.col(text_name), width).alias("own_")
            ).select("doc_id", "row_check_", "own_.*"),
            "copy-rows",
        )
        nodes = stored(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp")), "copy-nodes")
        entries = bucket_entries(nodes)
        # texts without words are one node and like nothing else
        candidates = stored(fingerprint_pairs(stored(nodes.where(F.size("bands") > 0).select("node", "fp"), "prints")), "candidates")
        own = [entries.select("node"), candidates.select("node"), candidates.select(F.col("leader").alias("node"))]
        wanted = own[0].unionByName(own[1]).unionByName(own[2]).distinct()
        # one row stands for a node; only rows whose checksum may be among those of the wanted nodes move
        heads = stored(
            rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row_check_")).alias("row"))
            .select("node", F.col("row.doc_id").alias("head_id_"), F.col("row.row_check_").alias("head_check_")),
            "text-rows",
        )
        plain = marked.select("row_id_", "row_check_", F.col(text_name).alias("text"))
        near, _ = sifted(plain, heads.select(F.col("head_check_").alias("row_check_")), "row_check_")
        whole = F.first("text")
        texts = stored(
            near.join(heads, (near["row_check_"] == heads["head_check_"]) & near["row_id_"].eqNullSafe(heads["head_id_"]))
            .groupBy("node").agg(whole.alias("text"), F.octet_length(whole).cast("long").alias("bytes")),
            "candidate-texts",
        )
        found = stored(components(similar_links(entries, texts, width, similarity, candidates)), "copy-groups")
        discard(texts, entries, nodes)
        return rows.join(found, "node", "left").select("doc_id", "row_check_", F.coalesce("component", "node").alias("component"))

    return first_of_groups(docs, doc_id, groups)
