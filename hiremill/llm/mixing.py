"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.common import WORD, discard, stored, unit_hash

#: Weights of the sources in order, repeating; words of the mix over all words; copies of a source at most.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = 9
#: Parts an order is cut in at each step of the search for its cutoff.
PARTS = 4096
#: The parts of the order by odds, and of the order of rows whose odds lie in one of its smallest parts.
STEPS = ("part_1", "part_2")
TIE_STEPS = ("part_3", "part_4")


def word_count(text: Column) -> Column:
    """Words between the six ASCII spaces; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the total by weight, capped, the excess reshared.

    Sources take the weights in code point order, null last. Resharing until none is above its cap fills
    all of them up to one level: the sources in order of cap over weight are capped as long as the level
    of what is left lies above their own. The windows below hold one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1)
    )
    weighed = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(total_share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / weight_left).withColumn("own", F.col("cap") / F.col("weight"))
    # the first source at or above the level, in the order of filling, sets it for all that follow
    first = F.struct("own", F.col("source").isNull().alias("none"), "source", "level")
    settled = F.min(F.when(F.col("own") >= F.col("level"), first)).over(everything)
    here = F.struct(F.col("own"), F.col("source").isNull(), F.col("source"))
    full = settled.isNull() | (here < F.struct(settled["own"], settled["none"], settled["source"]))
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * settled["level"])
    return levels.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def pareto_rank(uniform: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, mapped to [0, 1) with their order kept."""
    odds = (uniform / (1 - uniform)) * ((1 - inclusion) / inclusion)
    return F.when(inclusion <= 0, F.lit(1.0 - 2.0**-53)).otherwise(odds / (1 + odds))


def allocate(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_COPIES,
    appeal: Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, and the columns of `keep`.

    A source with target t and size s takes each document floor(t / s) times for certain. What is left
    of the target is drawn without replacement: documents are ranked by random odds over inclusion odds
    and taken in that order up to the word where the target is met, the document across it if half of
    it fits, so a source misses its target by half a document at most. The inclusion probability is the
    fraction t / s - floor(t / s), and follows `appeal`, a positive column, where one is given: a
    document twice as appealing has twice the odds. The cutoff of an order is found from sums over
    parts of it, cut finer at each step, so no task holds a source whole. Rows in the smallest part, where
    the target is met, are stored and ranked by a hash of their place; what the others give follows from the row
    alone, so with columns in `keep`, which may be wide, `docs` is read again and only those few rows are stored.
    """
    every = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        unit_hash(F.col(doc_id), F.coalesce(F.col(text), F.lit("")), seed=SEED).alias("uniform"),
        (F.lit(1.0) if appeal is None else appeal).alias("appeal_"), *[F.col(c) for c in keep],
    )
    rows = stored(every.drop(*keep), "mix-rows")
    targets = stored(source_targets(rows, weights, total_share, most), "mix-targets").select(
        F.col("source").alias("to"), "source_size", "target"
    )
    # the search reads narrow columns many times
    narrow = stored(_ranked(rows, targets).where("wanted > 0").select("source", "size", "wanted", *STEPS), "mix-ranks")
    cuts = [f"cut_{name}" for name in STEPS]
    parts = _reached(narrow.withColumn("before", F.lit(0.0)), STEPS)
    cells = stored(parts.select(F.col("source").alias("cut_source"), *cuts, "before").distinct(), "mix-cells")
    discard(narrow)
    ranked = _ranked(every if keep else rows, targets)
    marked = ranked.join(cells, ranked["source"].eqNullSafe(cells["cut_source"]), "left")
    inside, same = _up_to(STEPS)
    same = F.coalesce(same, F.lit(False))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    plain = marked.where(~same).select(*columns, _copies(inside), *keep)
    tied = _tied(stored(
        marked.where(same).select(*columns, "sure", "wanted", "before", "order_1", F.monotonically_increasing_id().alias("row_id"), *keep),
        "mix-ties",
    ))
    last = _last_taken(tied)
    tied = tied.join(last, tied["source"].eqNullSafe(last["cut_source"]), "left")
    inside, same = _up_to(TIE_STEPS)
    inside = inside | (same & (F.struct("order_1", "order_2", "row_id") <= F.col("last")))
    return plain.unionByName(tied.select(*columns, _copies(inside), *keep))


def _copies(inside: Column) -> Column:
    return (F.col("sure") + F.coalesce(inside, F.lit(False)).cast("long")).alias("copies")


def _up_to(steps: Sequence[str]) -> tuple[Column, Column]:
    """Whether a row comes before the part where its source meets its target, and whether it lies in it."""
    inside, same = F.lit(False), F.lit(True)
    for name in steps:
        inside = inside | (same & (F.col(name) < F.col(f"cut_{name}")))
        same = same & (F.col(name) == F.col(f"cut_{name}"))
    return inside, same


def _parted(rows: DataFrame, order: str, steps: Sequence[str]) -> DataFrame:
    """The rows with the parts of `order`, a number in [0, 1), each step's inside the one before."""
    for number, name in enumerate(steps):
        part = F.pmod(F.floor(F.col(order) * F.lit(float(PARTS ** (number + 1)))), F.lit(PARTS))
        rows = rows.withColumn(name, part.cast("int"))
    return rows


def _ranked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with their certain copies, the words still wanted of their source, and their place in its order."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(ratio + F.lit(1e-12)).cast("long")
    inclusion = F.greatest(ratio - sure, F.lit(0.0))
    odds = F.col("appeal_") * inclusion / (1 - inclusion)
    ranked = (
        rows.join(targets, rows["source"].eqNullSafe(targets["to"]))
        .withColumn("sure", sure)
        .withColumn("wanted", F.col("target") - F.col("sure") * F.col("source_size"))
        .withColumn("order_1", pareto_rank(F.col("uniform"), odds / (1 + odds)))
        .drop("uniform", "appeal_", "to")
    )
    return _parted(ranked, "order_1", STEPS)


def _tied(rows: DataFrame) -> DataFrame:
    """The rows with their place in an order of their own, by a hash of their number."""
    return _parted(rows.withColumn("order_2", unit_hash(F.col("row_id"), seed=SEED + 1)), "order_2", TIE_STEPS)


def _reached(rows: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The rows in the parts where the order of their source reaches the wanted words.

    `before` are the words of the source before the part of the row.
    """
    cuts: list[str] = []
    for name in steps:
        sums = rows.groupBy("source", "wanted", "before", *cuts, name).agg(F.sum("size").alias("own"))
        order = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.col("before") + F.sum("own").over(order))
        # the part in which the order meets the wanted words; at most PARTS rows of a source stand here
        crossing = upto.where(F.col("upto") > F.col("wanted")).groupBy("source").agg(
            F.min(F.struct(name, (F.col("upto") - F.col("own")).alias("before"))).alias("cut")
        )
        found = stored(
            crossing.select(F.col("source").alias("cut_source"), F.col(f"cut.{name}").alias(f"cut_{name}"), F.col("cut.before").alias("next")),
            "mix-cut",
        )
        rows = (
            rows.join(found, rows["source"].eqNullSafe(found["cut_source"]) & (rows[name] == found[f"cut_{name}"]))
            .withColumn("before", F.col("next"))
            .drop("cut_source", "next", name)
        )
        cuts.append(f"cut_{name}")
    return rows


def _last_taken(tied: DataFrame) -> DataFrame:
    """Per source the parts where its order reaches the wanted words, and the last row taken there."""
    rows = _reached(tied.select("source", "size", "wanted", "before", *TIE_STEPS, "order_1", "order_2", "row_id"), TIE_STEPS)
    order = Window.partitionBy("source").orderBy("order_1", "order_2", "row_id")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.when(F.col("upto") - F.col("size") / 2 <= F.col("wanted"), F.struct("order_1", "order_2", "row_id"))
    return stored(
        rows.withColumn("upto", upto)
        .groupBy(F.col("source").alias("cut_source"), *[f"cut_{name}" for name in TIE_STEPS])
        .agg(F.max(last).alias("last")),
        "mix-cutoffs",
    )


def mix_sizes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    taken is the size times the copies the mix holds, none, one or two. Defined cases: a null text has
    size 0; documents of size 0 and of sources without words take nothing; a null source is one source,
    the last; a null id stays null; repeated rows are documents of their own, ranked by a hash of their
    place among themselves; an empty table gives an empty result; other columns are ignored.
    """
    return allocate(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns, each as often as the mix holds it."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("row_"))
    found = allocate(packed, keep=["row_"])
    repeats = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return found.where("copies > 0").select("row_", repeats.alias("copy_")).select("row_.*")
