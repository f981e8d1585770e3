"""Repair of conversations: the cheapest edits that make roles alternate, by shortest paths over small integer costs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.llm.common import same_keys, settle

#: Costs of edits; a row that is cut short and not deleted costs as much as an insertion more.
RENAME, DELETE, INSERT, SHORT = 3, 4, 3, 3

#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3

#: States of the roles so far, s?(ua)+ or nothing: empty, after s, after u, after a; what a role's initial makes of each; states that may end.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
INTO = tuple(tuple((s, initial) for s in range(4) for initial, t in STEP[s].items() if t == state) for state in range(4))
ROLES = {"u": "user", "a": "assistant"}


def distances(initials: str, faults: bytes) -> list[int | None]:
    """Least cost from each node (rows done, state), as 4 * rows + state, to the end; None for nodes dearer than the start.

    Dial's queue: costs are at most RENAME + SHORT, so one bucket more than that, used in turn, holds all open nodes in order of cost.
    """
    n, buckets = len(faults), RENAME + SHORT + 1
    cost: list[int | None] = [None] * (4 * n + 4)
    best: list[int] = [1 << 60] * (4 * n + 4)
    queue: list[list[int]] = [[] for _ in range(buckets)]
    for s in ENDS:
        best[4 * n + s] = 0
        queue[0].append(4 * n + s)
    now, left = 0, len(ENDS)

    def reach(node: int, price: int) -> int:
        if price < best[node]:
            best[node] = price
            queue[price % buckets].append(node)
            return 1
        return 0

    while left and (cost[0] is None or now == cost[0]):  # a kept row costs nothing, so nodes as dear as the start count
        bucket = queue[now % buckets]
        if not bucket:
            now += 1
            continue
        node = bucket.pop()
        left -= 1
        if cost[node] is not None or best[node] != now:
            continue
        cost[node] = now
        done, state = divmod(node, 4)
        for s, initial in INTO[state]:
            if initial in ROLES:
                left += reach(4 * done + s, now + INSERT)
        if done:
            before, fault = 4 * done - 4, faults[done - 1]
            left += reach(before + state, now + DELETE)
            if fault not in (BLANK, DUPLICATE):
                more = SHORT if fault == TRUNCATED else 0
                for s, initial in INTO[state]:
                    if initial == initials[done - 1]:
                        left += reach(before + s, now + more)
                    if initial in ROLES:
                        left += reach(before + s, now + RENAME + more)
    return cost


def repairs(initials: str, faults: bytes) -> list[str]:
    """Edits before and at each row, and after the last: of the cheapest repairs the one whose letters come first in ASCII.

    D deletes, K keeps, Iu and Ia insert a user's or an assistant's turn, Ru and Ra rename to one.  Arcs are tight if they lead nearer to the
    end by their cost.  A state takes one of u and a only, so the letters say where a walk is.
    """
    cost = distances(initials, faults)
    n, at, state = len(faults), 0, 0
    out, here = [], ""
    while at < n or state not in ENDS or cost[4 * at + state]:
        rest = cost[4 * at + state]
        given = next((x for x in STEP[state] if x in ROLES), "")
        fault = faults[at] if at < n else BLANK
        more = SHORT if fault == TRUNCATED else 0
        kept = STEP[state].get(initials[at]) if at < n and fault not in (BLANK, DUPLICATE) else None
        if at < n and cost[4 * at + 4 + state] == rest - DELETE:
            out.append(here + "D")
            at, here = at + 1, ""
        elif cost[4 * at + STEP[state][given]] == rest - INSERT:
            here += f"I{given}"
            state = STEP[state][given]
        elif kept is not None and cost[4 * at + 4 + kept] == rest - more:
            out.append(here + "K")
            at, state, here = at + 1, kept, ""
        else:
            out.append(f"{here}R{given}")
            at, state, here = at + 1, STEP[state][given], ""
    return out + [here]


PLANNED = "seq long, fault int, edits string"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each row of conversations that come one after another in order; of a conversation two bytes a row are held."""
    open_, known, initials, faults = None, False, [], bytearray()

    def flush() -> pa.RecordBatch:
        edits = repairs("".join(initials), bytes(faults))
        n = len(edits)
        return pa.RecordBatch.from_arrays([pa.array([open_] * n, kind), pa.array(range(1, n + 1), pa.int64()), pa.array([*faults, SOUND], pa.int32()), pa.array(edits, pa.string())], names=["k", "seq", "fault", "edits"])

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        kind = batch.schema.field("k").type
        for k, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("k", "initial", "fault")), strict=True):
            if known and k != open_:
                ready.append(flush())
                initials, faults = [], bytearray()
                if len(ready) >= 500:
                    yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                    ready = []
            open_, known = k, True
            initials.append(initial or " ")
            faults.append(fault)
    if known:
        ready.append(flush())
    yield from ready


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """k, turn, role and text of rows after damage by the crc32 of ``conv:turn`` modulo 20; nulls are written as one blank.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user; others stay.
    """
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")) % 20
    rows = turns.select(F.col(f"`{conv}`").alias("k"), F.col(f"`{turn}`").alias("turn"), told(role).alias("role"), told(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(times)).select("k", "turn", "role", "text")


def repair_steps(rows: DataFrame) -> DataFrame:
    """The edits that repair the conversations of ``rows`` (k, turn, role, text), a row each: k, seq, step, edit, fault, turn, old_role, role, text.

    Rows of a conversation are in order of turn (nulls first), role and text; ``seq`` is that place from 1, and ``step`` orders insertions before it.  Edits are K, R, D
    and I; ``role`` and ``text`` are what a kept, renamed or inserted turn has, null for a deleted one; ``turn`` and ``old_role`` are null for an inserted
    one.  A null k is a conversation like others.  Equal rows are duplicates but for the first.  Texts may be of any length; no rows give none.

    Rows are numbered and written once.  Only their initials and faults reach the search, two bytes a row; texts come back by a join on k and seq, which spreads
    the rows of a long conversation over all tasks.
    """
    spaces = r"[^\x20\x09-\x0D]"
    order = W.Window.partitionBy("k").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = settle(rows.withColumn("seq", F.row_number().over(order).cast("long")), "turns")
    said = numbered.select("k", "seq", "role", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("said"), F.rlike("text", F.lit(spaces)).alias("some"), F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")).alias("whole"))
    firsts = said.groupBy("k", "said").agg(F.min("seq").alias("seq")).select("k", "seq", F.lit(True).alias("first"))
    fault = F.when(~F.col("some"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(SOUND)
    coded = said.alias("a").join(firsts.alias("b"), same_keys("a", "b", ["k", "seq"]), "left").select("a.k", "a.seq", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    kind = rows.schema["k"].dataType.simpleString()
    planned = coded.repartition("k").sortWithinPartitions("k", "seq").mapInArrow(_planned, f"k {kind}, {PLANNED}")
    steps = planned.select("k", "seq", "fault", F.posexplode(F.regexp_extract_all("edits", F.lit("[A-Z][ua]?"), F.lit(0))).alias("step", "edit"))
    new = F.when(F.substring("edit", 2, 1) == "u", "user").otherwise("assistant")
    letter = F.substring("edit", 1, 1)
    own = letter != "I"
    t = steps.alias("a").join(numbered.alias("b"), same_keys("a", "b", ["k", "seq"]), "left")
    return t.select(
        "a.k", "a.seq", "step", letter.alias("edit"), F.when(own, F.col("fault")).alias("fault"), F.when(own, F.col("turn")).alias("turn"), F.when(own, F.col("role")).alias("old_role"),
        F.when(letter == "K", F.col("role")).when(letter != "D", new).alias("role"), F.when(letter.isin("K", "R"), F.col("text")).when(letter == "I", "").alias("text"),
    )


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class _Tally:
    """What is told of one conversation, step by step."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.turns = [0, 0, 0, 0], 0, 0, 0
        self.low = self.high = self.turn = self.initial = None
        self.letters, self.sha, self.any = bytearray(), hashlib.sha256(), False

    def add(self, edit: str, fault: int | None, turn: int | None, old: str | None, role: str | None, text: str | None) -> None:
        self.letters += edit.encode()
        self.cost += {"I": INSERT, "D": DELETE, "R": RENAME, "K": 0}[edit]
        if edit != "I":
            self.faults[fault] += 1
            self.cost += SHORT if fault == TRUNCATED and edit != "D" else 0
            if self.initial is not None and self.initial + old[:1] not in LEGAL:
                self.illegal += 1
            self.initial = old[:1]
            if turn is not None and turn != self.turn:
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
                self.turns += 1
        if edit != "D":
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, self.letters.decode(), self.sha.hexdigest()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, whose steps come one after another in order; texts pass by."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        fields = [("k", kind), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=["k", *names])

    open_, tally = None, None
    for batch in batches:
        kind, rows = batch.schema.field("k").type, []
        for k, *step in zip(*(batch.column(c).to_pylist() for c in ("k", "edit", "fault", "turn", "old_role", "role", "text")), strict=True):
            if tally is None or k != open_:
                if tally is not None:
                    rows.append((open_, *tally.row()))
                open_, tally = k, _Tally()
            tally.add(*step)
        if rows:
            yield told(rows)
    if tally is not None:
        yield told([(open_, *tally.row())])


def repair_summary(steps: DataFrame) -> DataFrame:
    """Of each conversation that has steps: gaps among its turns, rows by first fault, illegal neighbours, cost, audit and the sha256 of the repaired ``role:text`` lines.

    A conversation's steps pass through one task in order, as a sha256 can't be split; texts are not held.
    """
    kind = steps.schema["k"].dataType.simpleString()
    return steps.repartition("k").sortWithinPartitions("k", "seq", "step").mapInArrow(_summed, f"k {kind}, {SUMMARY}")


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired_conversations(turns)


def repaired_conversations(turns: DataFrame, conv: str = "conv_id", **names: str) -> DataFrame:
    """Damage ``turns``, repair them, and tell of every conversation that there was before; one without rows after damage has zeros, no audit and the sha256 of nothing.

    Null conversation ids are one conversation, null turns come first and count in no gap.  Other columns are not looked at.
    """
    every = turns.select(F.col(f"`{conv}`").alias("k")).distinct()
    told = repair_summary(repair_steps(damaged(turns, conv, **names)))
    none = {n: F.lit("") if n == "audit" else F.sha2(F.lit(""), 256) if n == "repaired_sha256" else F.lit(0).cast("long") for n in (f.split()[0] for f in SUMMARY.split(", "))}
    t = every.alias("a").join(told.alias("b"), same_keys("a", "b", ["k"]), "left")
    return t.select(F.col("a.k").alias(conv), *[F.coalesce(F.col(f"b.{n}"), v).alias(n) for n, v in none.items()])
