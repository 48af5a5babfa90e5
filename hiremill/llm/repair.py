"""Conversation structure repair by lightest derivations.

An item is a number of rows read and a state of the grammar; an edit of the next row, or an inserted row,
derives another item. Weights are pairs of cost and audit (the initials of the edits), and items are popped
from an agenda in the order of their weights until the goal is final. A long conversation is cut into chunks
of bounded size; the lightest derivations from each state to each state of a chunk compose, so no task
holds a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.common import stored

#: The grammar of role initials, (s?(ua)+)?: from each state, the state after an initial.
START, OPENED, ASKED, ANSWERED = range(4)
MOVES = {
    START: {"s": OPENED, "u": ASKED},
    OPENED: {"u": ASKED},
    ASKED: {"a": ANSWERED},
    ANSWERED: {"u": ASKED},
}
GOALS = (START, ANSWERED)
#: Roles that a row can be given and that an inserted row can have.
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a row; the first two must be deleted.
BLANK, DUPLICATE, CUT, SOUND = "bdt-"
#: Rows of a chunk at most.
CHUNK = 512
#: Fixed patterns: six ASCII spaces, and marks that end a sentence.
SEEN = r"[^\x20\x09-\x0D]"
UNENDED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$"
LEGAL = ("su", "ua", "au")


# ---------------------------------------------------------------- derivations
def lightest(rows: Sequence[str], start: int, goals: Sequence[int]) -> dict[int, tuple[int, str]]:
    """For each goal state the least (cost, audit) that leads there from `start` over all rows.

    A row is its role's initial and its fault. An item (rows read, state) is final when popped: edits
    add to (cost, rows read, audit), and two audits of one item and cost are never one the beginning of
    the other, so what follows them does not change their order.
    """
    final: set[tuple[int, int]] = set()
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", start)]
    found: dict[int, tuple[int, str]] = {}
    wanted = set(goals)
    while agenda and wanted - found.keys():
        cost, read, audit, state = heapq.heappop(agenda)
        if (read, state) in final:
            continue
        final.add((read, state))
        if read == len(rows) and state in wanted:
            found[state] = (cost, audit)
        for more, edit, step, to in deductions(rows[read] if read < len(rows) else None, state):
            if (read + step, to) not in final:
                heapq.heappush(agenda, (cost + more, read + step, audit + edit, to))
    return found


@lru_cache(maxsize=4096)
def deductions(row: str | None, state: int) -> tuple[tuple[int, str, int, int], ...]:
    """(cost, edit, rows read, state after) of every edit in a state; `row` is None after the last one."""
    out = [(INSERT, "I", 0, MOVES[state][r]) for r in ROLES if r in MOVES[state]]
    if row is not None:
        fault = row[-1]
        out.append((DELETE, "D", 1, state))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if row[:-1] in MOVES[state]:
                out.append((KEEP + more, "K", 1, MOVES[state][row[:-1]]))
            out += [(REROLE + more, "R", 1, MOVES[state][r]) for r in ROLES if r in MOVES[state]]
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def chunk_weights(rows: tuple[str, ...], first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of a chunk; a first one starts at START, a last one ends in GOALS."""
    states = tuple(MOVES)
    return tuple(
        (start, goal, *weight)
        for start in ((START,) if first else states)
        for goal, weight in sorted(lightest(rows, start, GOALS if last else states).items())
    )


def followed(sofar: dict[int, tuple[int, str]], weights: Sequence[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """The least weights after one more chunk."""
    out: dict[int, tuple[int, str]] = {}
    for start, goal, cost, audit in weights:
        if start in sofar:
            weight = (sofar[start][0] + cost, sofar[start][1] + audit)
            out[goal] = min(out.get(goal, weight), weight)
    return out


class Writer:
    """Gives rows the roles and the places that an audit says, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        """Roles of the rows to insert here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield ROLES[self._advance()]

    def next_row(self, role: str) -> tuple[str, str | None]:
        """The edit of the next row and its role, None if it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return edit, None
        if edit == "K":
            self.state = MOVES[self.state][role[:1]]
            return edit, role
        return edit, ROLES[self._advance()]

    def _advance(self) -> str:
        """The one initial of ROLES that the state lets follow."""
        initial = next(r for r in ROLES if r in MOVES[self.state])
        self.state = MOVES[self.state][initial]
        return initial


# ---------------------------------------------------------------- tables
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped`, with the damage that a checksum of conv_id:turn deals to each row.

    Null roles and texts, and null ids in the checksum, are one space. Of 20 remainders, 0 drops the row (it
    stays, marked), 1 empties the text, 2 removes its full stops and marks, 3 repeats it, 4 makes it the user's.
    """
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), damaged.alias("text"),
        (F.col("kind") == 0).alias("dropped"), copies.alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """A stored table of all rows without their texts, `at` numbering them in the order of conversation and turn.

    Rows are dealt out by ranges of the whole order and a hash of their place, so neither a long conversation nor
    many equal rows land in one task.
    """
    text = F.coalesce("text", F.lit(" "))
    dealt = rows.select("conv_id", "turn", "role", "text", "dropped").withColumn(
        "tie", F.xxhash64(F.monotonically_increasing_id())
    )
    order = ["conv_id", "turn", "role", "text", "tie"]
    return stored(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", "turn", "dropped", F.left("role", F.lit(1)).alias("initial"),
            F.sha2(F.concat_ws("\x00", F.hex(F.encode("role", "UTF-8")), text), 256).alias("content"),
            (~F.col("text").rlike(SEEN)).alias("blank"), F.col("text").rlike(UNENDED).alias("cut"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "repair-rows",
    )


def _faults(rows: DataFrame) -> DataFrame:
    """The rows that are not dropped with their fault: blank, duplicate of an earlier one, or truncated."""
    kept = rows.where("not dropped")
    firsts = kept.groupBy(F.col("conv_id").alias("own"), F.col("content").alias("same")).agg(F.min("at").alias("first"))
    joined = kept.join(firsts, kept["conv_id"].eqNullSafe(firsts["own"]) & (kept["content"] == firsts["same"]))
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("at") != F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    )
    return joined.select("conv_id", "at", "initial", fault.alias("fault"))


def _facts(rows: DataFrame) -> DataFrame:
    """conv_id and gaps of every conversation."""
    turn = F.when(~F.col("dropped"), F.col("turn"))
    per_turn = rows.groupBy("conv_id", turn.alias("turn")).agg(F.lit(1).alias("one"))
    spread = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return per_turn.groupBy("conv_id").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"))


def _chunks(faults: DataFrame) -> DataFrame:
    """One row per conversation and chunk: rows (initial and fault, in order), counts, first and last place."""
    count = [F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    return faults.groupBy("conv_id", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", F.concat("initial", "fault").alias("row")))), lambda x: x["row"]
        ).alias("rows"),
        *count,
    )


def _composed(chunks: DataFrame) -> DataFrame:
    """Per conversation: conv_id, blank, duplicate, truncated, illegal, cost, audit.

    Chunks are numbered in each conversation to know its first and last; their derivations are found in all
    tasks and folded in order, a batch at a time, with one weight for each state.
    """
    own = Window.partitionBy("conv_id")
    numbered = chunks.withColumn("first", F.row_number().over(own.orderBy("chunk")) == 1).withColumn(
        "last", F.row_number().over(own.orderBy(F.desc("chunk"))) == 1
    )

    @F.pandas_udf("array<struct<start: int, goal: int, cost: long, audit: string>>")
    def weigh(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        names = ("start", "goal", "cost", "audit")
        return pd.Series(
            [
                [dict(zip(names, w, strict=True)) for w in chunk_weights(tuple(r), bool(f), bool(z))]
                for r, f, z in zip(rows, first, last, strict=True)
            ],
            dtype=object,
        )

    initials = F.transform("rows", lambda r: F.left(r, F.length(r) - 1))
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials) - 1), lambda a, b: F.concat(a, b))
    weighed = numbered.select(
        "conv_id", "chunk", "first", "last", "blank", "duplicate", "truncated", F.get(initials, F.lit(0)).alias("head"),
        F.element_at(initials, -1).alias("tail"),
        F.when(F.size("rows") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(F.lit(0)).alias("illegal"),
        weigh("rows", "first", "last").alias("weights"),
    )
    counts = ["blank", "duplicate", "truncated", "illegal"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.first:
                    state = {"sofar": {START: (0, "")}, "tail": None, **dict.fromkeys(counts, 0)}
                for name in counts:
                    state[name] += getattr(row, name)
                if state["tail"] is not None:
                    state["illegal"] += state["tail"] + row.head not in LEGAL
                state["tail"] = row.tail
                state["sofar"] = followed(
                    state["sofar"], [(w["start"], w["goal"], w["cost"], w["audit"]) for w in row.weights]
                )
                if row.last:
                    cost, audit = min(state["sofar"].values())
                    out.append((row.conv_id, *[state[name] for name in counts], cost, audit))
            frame = pd.DataFrame(out, columns=["conv_id", *counts, "cost", "audit"])
            yield frame.astype({"conv_id": "Int64"})

    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return weighed.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInPandas(fold, schema)


def _repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of every conversation, and the cheapest repair of those with rows."""
    ordered = _ordered(rows)
    return _facts(ordered), stored(_composed(_chunks(_faults(ordered))), "repairs")


def _in_order(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The audit of each conversation, then its rows in order, conversation by conversation in every partition."""
    marks = repairs.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit"
    )
    own = rows.where("not dropped").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "text", F.lit(None).cast("string").alias("audit")
    )
    return marks.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text")


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Per batch (conversation, edit, role, text) of rows kept, deleted (role None) and inserted, and an end mark.

    The end mark (edit None) comes after the last row of a conversation.
    """
    writer, conversation, open_ = Writer(""), None, False
    for batch in batches:
        out: list[tuple] = []
        for conv_id, audit, role, text in zip(batch["conv_id"], batch["audit"], batch["role"], batch["text"], strict=True):
            if audit is not None and not pd.isna(audit):
                if open_:
                    out += [(conversation, "I", r, "") for r in writer.inserted()]
                    out.append((conversation, None, None, None))
                writer, conversation, open_ = Writer(audit), None if pd.isna(conv_id) else int(conv_id), True
                continue
            out += [(conversation, "I", r, "") for r in writer.inserted()]
            out.append((conversation, *writer.next_row(role), text))
        yield out
    if open_:
        yield [*[(conversation, "I", r, "") for r in writer.inserted()], (conversation, None, None, None)]


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, role, text, edit (keep, rerole or insert), one row per kept row.

    `rows` has conv_id, turn, role, text; nulls in the last two are one space. Rows of one turn are ordered by role
    and text; a null id is one conversation. No rows, no result; other columns are ignored.
    """
    names = {"K": "keep", "R": "rerole", "I": "insert"}
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = 0
        for rows_out in _edited(batches):
            out = []
            for conversation, edit, role, text in rows_out:
                if edit is None:
                    place = 0
                elif role is not None:
                    out.append((conversation, place, role, text, names[edit]))
                    place += 1
            frame = pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit"])
            yield frame.astype({"conv_id": "Int64"})

    _, repairs = _repairs(plain)
    return _in_order(plain, repairs).mapInPandas(run, "conv_id long, place long, role string, text string, edit string")


def _digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id and the digest of each repaired conversation, its texts streamed through the hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, empty = hashlib.sha256(), True
        for rows_out in _edited(batches):
            out = []
            for conversation, edit, role, text in rows_out:
                if edit is None:
                    out.append((conversation, digest.hexdigest()))
                    digest, empty = hashlib.sha256(), True
                elif role is not None:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})

    return _in_order(rows, repairs).mapInPandas(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn, role, text and dropped; conversations of dropped rows alone have zeros, an empty audit
    and the digest of the empty string. Rows of one turn are ordered by role and text; null turns come first; a null
    id is one conversation; a role without characters has no initial and cannot be kept. An empty table gives an empty
    result.
    """
    facts, repairs = _repairs(rows)
    digests = _digests(rows, repairs).withColumnRenamed("conv_id", "digest_of")
    found = repairs.withColumnRenamed("conv_id", "own")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    return (
        facts.join(found, facts["conv_id"].eqNullSafe(found["own"]), "left")
        .join(digests, facts["conv_id"].eqNullSafe(digests["digest_of"]), "left")
        .select(
            "conv_id", "gaps", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The report on the conversations after the damage of `damage`. Other columns are ignored."""
    own: list[Column] = [
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text")
    ]
    return repair_report(damage(conversations.select(*own)))
