"""The near-copy stage of the pipeline against brute force on pairs planted at similarities of 0.8 to 0.95."""

from __future__ import annotations

import itertools
import random

import numpy as np

import corpus_pipeline
from hiremill.llm import buckets, common, nearcopies, simhash
from tests.llm.data import SCHEMA
from tests.llm.test_brute import reachable


def plain_shingles(text: str | None) -> set[tuple]:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def test_stage_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TILE_ROWS", 8)
    rng = random.Random(12)
    rows = []
    for pair in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append((2 * pair, " ".join(words)))
        least = rng.choice((0.6, 0.75, 0.8, 0.82, 0.85, 0.9, 0.95))
        own = list(words)
        while True:
            trial = list(own)
            trial[rng.randrange(len(trial))] = f"x{rng.randrange(10**6)}"
            if similarity(plain_shingles(" ".join(trial)), plain_shingles(" ".join(words))) < least:
                break
            own = trial
        rows.append((2 * pair + 1, " ".join(own)))
    base = rows[0][1].split()
    rows += [(200 + i, " ".join([*base, f"t{i}"])) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two  WORDS"), (305, "two others")]
    own = [plain_shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    links = [
        (ids[i], ids[j]) for i, j in itertools.combinations(range(len(rows)), 2) if similarity(own[i], own[j]) >= 0.8
    ]
    # pairs of the lower similarities must be among those linked
    assert sum(0.8 <= similarity(own[i], own[i + 1]) < 0.87 for i in range(0, 120, 2)) >= 10
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == set(reachable(ids, links))


def test_shares_of_candidates():
    """Candidates hold 0.99 of the pairs at just 0.8."""
    rng = random.Random(13)
    found = 0
    for _ in range(400):
        both, a, b = (nearcopies.shingles(" ".join(f"w{rng.random()}" for _ in range(n + 4))) for n in (80, 10, 10))
        left, right = nearcopies.band_keys([np.concatenate([both, x]) for x in (a, b)])
        found += bool((left == right).any())
    assert found >= 396


def test_edges_join_what_is_similar():
    rng = random.Random(17)
    for _ in range(30):
        texts = []
        while len(texts) < 25:
            words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(6, 30))]
            for _ in range(rng.randint(1, 4)):
                texts.append(" ".join(words))
                words = list(words)
                words[rng.randrange(len(words))] = "other"
        sets = [nearcopies.shingles(t) for t in texts]
        groups = np.array([rng.choice((i, i, i - i % 4)) for i in range(len(texts))])
        given = [(int(g), i) for i, g in enumerate(groups)]
        edges = nearcopies.near_edges(sets, groups)
        every = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if nearcopies.jaccard(sets[i], sets[j]) >= 0.8]
        ids = list(range(len(sets)))
        assert reachable(ids, given + edges) == reachable(ids, given + every)
        assert all(nearcopies.jaccard(sets[i], sets[j]) >= 0.8 for i, j in edges)


def test_fingerprints_give_candidates(spark):
    """Texts whose fingerprints differ in four bits or fewer are linked without a band, if they are similar."""
    rng = random.Random(19)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts += [" ".join(words), " ".join([*words[:-1], "last"]), " ".join(words[:60])]
    prints = [simhash.fingerprint(t, nearcopies.WIDTH) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(near) >= 20
    rows = [(i, t, len(t), int(np.uint64(p).view(np.int64))) for i, (t, p) in enumerate(zip(texts, prints, strict=True))]
    table = common.stored(spark.createDataFrame(rows, "node long, text string, bytes long, fp long"), "test-nodes")
    found = common.stored(nearcopies.fingerprint_pairs(table.select("node", "fp")), "test-candidates")
    ids = list(range(len(texts)))
    assert reachable(ids, [(r["leader"], r["node"]) for r in found.collect()]) == reachable(ids, near)
    nothing = spark.createDataFrame([], "band int, key long, node long, leader long")
    links = nearcopies.similar_links(nothing, table.drop("fp"), nearcopies.WIDTH, nearcopies.SIMILARITY, found)
    sets = [plain_shingles(t) for t in texts]
    similar = [(a, b) for a, b in near if similarity(sets[a], sets[b]) >= 0.8]
    assert reachable(ids, [(r["left"], r["right"]) for r in links.collect()]) == reachable(ids, similar)


def test_small_buckets_travel_as_pairs(spark, monkeypatch):
    """A text that shares several small buckets with a text unlike it travels for none of them: the pair has been compared."""
    sizes = {}
    kept = common.stored

    def stored(df, label):
        out = kept(df, label)
        sizes[label] = sizes.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(nearcopies, "stored", stored)
    rng = random.Random(20)
    rows = []
    for pair in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        own = list(words)
        for at in rng.sample(range(100), 4):
            own[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(own))]
    sets = [plain_shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(80), 2) if similarity(sets[a], sets[b]) >= 0.8]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept_rows = {r["doc_id"] for r in nearcopies.keep_one(docs).collect()}
    assert kept_rows == set(reachable(list(range(80)), links))
    assert sizes["stars"] >= 20 and sizes["open-texts"] == 0
