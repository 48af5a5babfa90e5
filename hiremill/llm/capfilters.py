"""Near-duplicate embeddings through spherical-cap filters of structured random product codes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.buckets import in_tiles, roots
from hiremill.llm.common import once, stored
from hiremill.llm.components import components

BLOCKS = 2
CODES = 16
#: A cap starts this many standard deviations of a random inner product from the centre ...
DEVIATIONS = 3.0
#: ... and at this cosine at the most, for vectors of few dimensions.
MOST_COSINE = 0.6
#: Filters a vector is expected to pass in each code.
LIST_SIZE = 1.5


def usable(vector: np.ndarray | None) -> np.ndarray | None:
    """The vector in double precision, or None if null, empty, zero or with a null or non-finite component."""
    if vector is None or not len(vector):
        return None
    values = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(values).all():
        return None
    most = np.abs(values).max()
    return values / most if most and (most > 1e100 or most < 1e-100) else values if most else None


def packed(values: np.ndarray) -> bytes:
    """Single precision where that holds the values exactly, double precision otherwise."""
    short = values.astype("<f4")
    return (short if (short == values).all() else values.astype("<f8")).tobytes()


def unpacked(vectors: np.ndarray, dims: int) -> np.ndarray:
    out = np.empty((len(vectors), dims))
    for at, raw in enumerate(vectors):
        out[at] = np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dims else "<f8")
    return out


def vector_key(values: np.ndarray) -> str:
    return hashlib.blake2b((values + 0.0).tobytes(), digest_size=16).hexdigest()


def product_code(dims: int, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """A rotation, the code words of each block and the least sum of block products of a passed filter.

    A filter is one code word from each block; its direction is their concatenation. The number of
    words per block follows from the share of the sphere a cap covers, so that a vector passes
    `LIST_SIZE` filters on average whatever the dimension.
    """
    return once(("product-code", dims, number, BLOCKS, DEVIATIONS, LIST_SIZE), lambda: _product_code(dims, number))


def _product_code(dims: int, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    rng = np.random.default_rng([29, dims, number])
    blocks = min(BLOCKS, dims)
    cosine = min(DEVIATIONS / np.sqrt(dims), MOST_COSINE)
    probe = np.random.default_rng([31, dims]).standard_normal((20_000, dims))
    share = max((probe[:, 0] / np.linalg.norm(probe, axis=1) >= cosine).mean(), 1 / 20_000)
    words = int(np.clip(np.ceil((LIST_SIZE / share) ** (1 / blocks)), 4, 64))
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    parts = []
    for part in np.array_split(np.arange(dims), blocks):
        directions = rng.standard_normal((words, len(part)))
        parts.append(directions / np.linalg.norm(directions, axis=1, keepdims=True))
    return turn, parts, float(cosine * np.sqrt(blocks))


def passed_filters(unit: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that a row of unit vectors exceeds, by list decoding.

    Blocks are added one at a time; a partial sum goes on only if the best words of the remaining
    blocks could still lift it over the cap.
    """
    dims = unit.shape[1]
    turn, parts, least = product_code(dims, number)
    turned = unit @ turn
    edges = np.cumsum([0, *[p.shape[1] for p in parts]])
    scores = [turned[:, edges[i] : edges[i + 1]] @ p.T for i, p in enumerate(parts)]
    hope = np.zeros(len(unit))
    hopes = [hope]
    for block in reversed(scores[1:]):
        hope = hope + block.max(axis=1)
        hopes.append(hope)
    hopes.reverse()
    row = np.arange(len(unit))
    name = np.zeros(len(unit), dtype=np.int64)
    total = np.zeros(len(unit))
    for block, rest in zip(scores, hopes, strict=True):
        sums = total[:, None] + block[row]
        at, word = np.nonzero(sums + rest[row][:, None] >= least)
        row, name, total = row[at], name[at] * block.shape[1] + word, sums[at, word]
    return row, name


def filter_rows(reps: DataFrame) -> DataFrame:
    """(dims, cap, node, copies, vector, caps): a row for each filter each representative passes."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [usable(v) for v in batch["embedding"]]
            sizes = np.array([len(v) for v in vectors])
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                for some in np.array_split(own, max(1, len(own) // 1024)):
                    values = np.stack([vectors[i] for i in some])
                    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                    row, cap = [], []
                    for number in range(CODES):
                        r, c = passed_filters(unit, number)
                        row.append(r)
                        cap.append(c * CODES + number)
                    row, cap = np.concatenate(row), np.concatenate(cap)
                    order = np.lexsort((cap, row))
                    row, cap = row[order], cap[order]
                    bounds = np.searchsorted(row, np.arange(len(some) + 1))
                    caps = [cap[bounds[i] : bounds[i + 1]].astype("<i4").tobytes() for i in range(len(some))]
                    raw = [packed(v) for v in values]
                    yield pd.DataFrame(
                        {
                            "dims": dims,
                            "cap": cap,
                            "node": batch["node"].to_numpy()[some][row],
                            "copies": batch["copies"].to_numpy()[some][row],
                            "vector": [raw[i] for i in row],
                            "caps": [caps[i] for i in row],
                        }
                    )

    return reps.mapInPandas(decode, "dims int, cap long, node string, copies long, vector binary, caps binary")


def _seen_before(left: np.ndarray, right: np.ndarray, cap: int) -> np.ndarray:
    """Whether two padded lists of filters share one below `cap`, which both hold."""
    found = np.zeros(len(left), dtype=bool)
    for column in range(left.shape[1]):
        own = left[:, column]
        found |= ((own < cap) & (own >= 0)) & (right == own[:, None]).any(axis=1)
    return found


def cap_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, other, links) from every tile: a step towards the node's component, and the vectors it links to.

    A pair that shares several filters counts in the smallest of them only.
    """

    def link(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        nodes, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        vectors, lists = frame["vector"].to_numpy(), frame["caps"].to_numpy()
        caps, halves, dims = (frame[c].to_numpy() for c in ("cap", "half", "dims"))
        two = (frame["tile_low"] != frame["tile_high"]).to_numpy()
        stops = np.append(starts[1:], len(frame))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            if stop - start < 2:
                continue
            own = unpacked(vectors[start:stop], int(dims[start]))
            norms = np.linalg.norm(own, axis=1)
            linked = (own @ own.T) / np.outer(norms, norms) >= cosine
            np.fill_diagonal(linked, False)
            if two[start]:
                linked &= halves[start:stop][:, None] != halves[start:stop][None, :]
            if not linked.any():
                continue
            a, b = np.nonzero(np.triu(linked))
            held = [np.frombuffer(x, dtype="<i4") for x in lists[start:stop]]
            padded = np.full((len(held), max(map(len, held))), -1, dtype=np.int64)
            for i, x in enumerate(held):
                padded[i, : len(x)] = x
            links = np.zeros(len(own), dtype=np.int64)
            number = copies[start:stop]
            for at in range(0, len(a), 100_000):
                p, q = a[at : at + 100_000], b[at : at + 100_000]
                new = ~_seen_before(padded[p], padded[q], caps[start])
                np.add.at(links, p[new], number[q[new]])
                np.add.at(links, q[new], number[p[new]])
            root = roots(linked)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(own))))
            names = nodes[start:stop]
            out.append((names[some], names[root[some]], links[some]))
        if not out:
            return pd.DataFrame({"node": [], "other": [], "links": []}).astype({"node": object, "other": object, "links": "int64"})
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("node", "other", "links"))})

    return in_tiles(rows, ["dims", "cap"], "node", link, "node string, other string, links long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least `cosine` that share a filter are linked; cosines are computed
    in double precision, so no link lies below the threshold, and the codes are large enough that
    few above it are missed (the tests hold recall against brute force). Equal vectors are one node
    with a number of copies. Defined cases: a null, empty or zero vector, or one with a null, NaN or
    infinite component, links with nothing; vectors of different lengths never link; a null id is
    never the smallest, and its row is kept only if no row of its component has an id; repeated rows
    count as vectors of their own; an empty table gives an empty result; other columns are ignored.
    """

    @F.pandas_udf("string")
    def key(column: pd.Series) -> pd.Series:
        values = (usable(v) for v in column)
        return pd.Series([None if v is None else vector_key(v) for v in values], dtype=object)

    as_double = F.col(embedding).cast("array<double>")
    rows = stored(
        vectors.select(F.col(vec_id).alias("vec_id"), as_double.alias("embedding"), key(as_double).alias("node")), "vectors"
    )
    reps = stored(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")),
        "representatives",
    )
    found = stored(cap_links(stored(filter_rows(reps), "filters"), cosine), "cap-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "other")
    member = stored(
        reps.select("node", "low", "copies")
        .join(linked, "node", "left")
        .join(groups, "node", "left")
        .select(
            "node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "members",
    )
    # as a table of its own, so that both sides of the join are plain shuffles and a large component is split
    least = stored(member.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = stored(member.join(least, "component").select("node", "n_links", "component_id"), "named")
    return rows.join(named, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
