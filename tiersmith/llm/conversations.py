"""Repair of the turn structure of conversations by Four-Russians block tables.

The turns of a conversation, in order, become symbols: the role's initial
(system, user, assistant or another) and the turn's first fault. The cheapest
edits that give a legal sequence of roles, ``(s?(ua)+)?``, follow from the cost
of the rest of the conversation for each of four states: nothing yet, after
system, after user, after assistant. Such a vector of costs minus its least is
one of a few dozen, so the step over every block of ``BLOCK`` symbols is worked
out once for every vector, and blocks are processed by look-up, from the end to
the start. The trace runs against that direction: each block is expanded into
the vectors between its symbols, and at every place the first edit in ASCII
order among the cheapest is taken, which gives the least string of edits.

Edits: Keep costs 0, Rerole to the user or assistant that must come next 3,
Delete 4 (the only edit for blank and repeated turns), Insert an empty user or
assistant turn anywhere 3; a truncated turn that isn't deleted costs 3 more.

Faults, the first that applies: *blank*, no character but blanks; *duplicate*,
role and text stand in an earlier turn; *truncated*, the last character that is
no blank is not one of ``.!?``.

**Order.** By turn, nulls first, then role and text; rows alike in all of these
are interchangeable. **Nulls.** A null role or text is one space; a null
conversation id is a conversation like others. A conversation without rows can
only come from ``ids`` and has zeros and no edits. Other columns are not looked at.

**Long conversations.** Rows are sorted by range over (conversation, turn, role,
start of the text), so one with a third of all rows spans many tasks. Its rows
form segments of at most ``SEGMENT`` turns; a segment is passed for every vector,
which gives its own step; steps are joined per conversation (one short row for
each segment), and all segments are traced side by side. First occurrences are
aggregated before they are joined. Only two things hold a conversation together:
its string of edits, a byte for each turn, which Spark bounds at 2 GB, and the
stream of its repaired turns, of which a task holds a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

BLANK = r"[\x20\x09-\x0D]"
BLOCK = 4
SEGMENT_BITS = 14
SEGMENT = 1 << SEGMENT_BITS
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Costs of edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, STAYS_CUT = 3, 4, 3, 3
NO_FAULT, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
#: A symbol is 4 * (0 other, 1 system, 2 user, 3 assistant) + fault; PAD fills the last block and changes nothing.
PAD, SYMBOLS = 16, 17
#: Where a turn of the kind s, u, a leads from each state, or -1.
_NEXT = {1: (AFTER_S, -1, -1, -1), 2: (AFTER_U, AFTER_U, -1, AFTER_U), 3: (-1, -1, AFTER_A, -1)}
#: Where an inserted or changed turn leads: the user or assistant that must come next.
_FORCED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = ("user", "assistant")


def _inserted(cost: list[int]) -> list[int]:
    """Costs from each state if turns may be inserted first."""
    out = list(cost)
    for _ in range(4):
        out = [min(c, INSERT + out[_FORCED[s]]) for s, c in enumerate(out)]
    return out


def _options(symbol: int, after: list[int]) -> list[list[tuple[int, str, int]]]:
    """For each state the edits of a turn as (cost of it and the rest, initial, next state)."""
    kind, fault = divmod(symbol, 4)
    out = []
    for s in range(4):
        edits = [(DELETE + after[s], "D", s)]
        if fault in (NO_FAULT, IS_TRUNCATED):
            more = STAYS_CUT if fault == IS_TRUNCATED else 0
            if kind and _NEXT[kind][s] >= 0:
                edits.append((more + after[_NEXT[kind][s]], "K", _NEXT[kind][s]))
            edits.append((REROLE + more + after[_FORCED[s]], "R", _FORCED[s]))
        out.append(edits)
    return out


@dataclass
class Tables:
    """Everything that depends on the rules only."""
    vectors: np.ndarray      # costs by state, the least 0; row 0 is the end of a conversation
    step: np.ndarray         # (vector after, symbol) -> vector before
    gain: np.ndarray         # and what the least rose by
    block_step: np.ndarray   # (vector after, code of BLOCK symbols) -> vector before
    block_gain: np.ndarray
    edits: list[str]         # strings of initials: insertions, then the edit of a turn
    trace: np.ndarray        # (vector after, symbol, state) -> number of the string
    state: np.ndarray        # and the state after the turn
    ending: list[str]        # by state, the insertions behind the last turn


@cache
def tables() -> Tables:
    end = _inserted([0, 1 << 20, 1 << 20, 0])
    known, queue, step, gain, trace, state, edits = {tuple(end): 0}, [tuple(end)], [], [], [], [], {"": 0}
    while len(step) < len(queue):  # every vector that can come before a known one
        after = list(queue[len(step)])
        rows: list[list] = [[], [], [], []]
        for symbol in range(PAD):
            options = _options(symbol, after)
            before = _inserted([min(o)[0] for o in options])
            least = min(before)
            shifted = tuple(c - least for c in before)
            if shifted not in known:
                known[shifted] = len(queue)
                queue.append(shifted)
            names, ends = [], []
            for s in range(4):
                text, at = "", s
                while True:  # the first in ASCII order among the cheapest, insertions included
                    best = [(e, to) for c, e, to in options[at] if c == before[at]]
                    if INSERT + before[_FORCED[at]] == before[at]:
                        best.append(("I", _FORCED[at]))
                    edit, at = min(best)
                    text += edit
                    if edit != "I":
                        break
                names.append(edits.setdefault(text, len(edits)))
                ends.append(at)
            for row, value in zip(rows, (known[shifted], least, names, ends)):
                row.append(value)
        for row, value in zip(rows, (len(step), 0, [0] * 4, list(range(4)))):  # PAD
            row.append(value)
        for all_rows, row in zip((step, gain, trace, state), rows):
            all_rows.append(row)
    one, rise = np.array(step, np.int16), np.array(gain, np.int32)
    many, sums = one, rise
    for _ in range(BLOCK - 1):  # put one more symbol before the block
        first = one[many.ravel()].reshape(*many.shape, SYMBOLS)
        more = rise[many.ravel()].reshape(*many.shape, SYMBOLS) + sums[..., None]
        many = first.swapaxes(1, 2).reshape(len(queue), -1)
        sums = more.swapaxes(1, 2).reshape(len(queue), -1)
    ending = ["", "II", "I", ""]
    return Tables(np.array(queue, np.int32), one, rise, many, sums, list(edits), np.array(trace, np.int16), np.array(state, np.int8), ending)


class Segments:
    """Symbols of many segments, processed together."""

    def __init__(self, symbols: list[bytes]):
        self.t = tables()
        self.sizes = np.array([len(s) for s in symbols], np.int64)
        self.blocks = -(-self.sizes // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.symbols = np.frombuffer(b"".join(s.ljust(b * BLOCK, bytes([PAD])) for s, b in zip(symbols, self.blocks.tolist())), np.uint8).reshape(-1, BLOCK)
        self.codes = self.symbols.astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
        self.order = np.argsort(-self.blocks, kind="stable")  # those with more blocks first

    def back(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment the vector before it and what it adds, given the vector behind it; and the vector behind every block."""
        now, added = vector[self.order].astype(np.int64), np.zeros(len(vector), np.int64)
        behind = np.zeros(len(self.codes), np.int16)
        rank, longest = -self.blocks[self.order], int(self.blocks.max(initial=0))
        for k in range(longest):  # block k from the end of each segment that has one
            n = int(np.searchsorted(rank, -k, "left"))
            own = self.order[:n]
            at = self.first[own] + self.blocks[own] - 1 - k
            behind[at] = now[:n]
            added[:n] += self.t.block_gain[now[:n], self.codes[at]]
            now[:n] = self.t.block_step[now[:n], self.codes[at]]
        out, total = np.empty_like(now), np.empty_like(added)
        out[self.order], total[self.order] = now, added
        return out, total, behind

    def trace(self, behind: np.ndarray, state: int | np.ndarray) -> tuple[list[str], np.ndarray]:
        """The string of edits of each segment and the state behind it, given the state before it."""
        between = np.empty((len(self.codes), BLOCK), np.int16)  # each block expanded backwards
        now = behind
        for j in range(BLOCK - 1, -1, -1):
            between[:, j] = now
            now = self.t.step[now, self.symbols[:, j]]
        at = np.zeros(len(self.sizes), np.int64) + state
        at = at[self.order]
        chosen = np.zeros(self.symbols.shape, np.int16)
        rank, longest = -self.blocks[self.order], int(self.blocks.max(initial=0))
        for k in range(longest):
            n = int(np.searchsorted(rank, -k, "left"))
            rows = self.first[self.order[:n]] + k
            for j in range(BLOCK):
                v, x = between[rows, j], self.symbols[rows, j]
                chosen[rows, j] = self.t.trace[v, x, at[:n]]
                at[:n] = self.t.state[v, x, at[:n]]
        ends = np.empty_like(at)
        ends[self.order] = at
        names = self.t.edits
        flat = chosen.ravel().tolist()
        text = ["".join([names[c] for c in flat[f * BLOCK:f * BLOCK + n]]) for f, n in zip(self.first.tolist(), self.sizes.tolist())]
        return text, ends


def _segment_facts(segments: DataFrame) -> DataFrame:
    """Of each segment (c, seg): illegal neighbours in it, its first and last kind, and its step: for every vector behind it the one before and what it adds.

    ``alone`` segments are a whole conversation; they are passed for the end only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        legal = np.zeros((4, 4), bool)
        legal[1, 2] = legal[2, 3] = legal[3, 2] = True
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            s = Segments(symbols)
            illegal = []
            for x in symbols:
                kind = np.frombuffer(x, np.uint8) >> 2
                illegal.append(int((~legal[kind[:-1], kind[1:]]).sum()))
            alone = np.asarray(batch.column("alone").to_numpy(zero_copy_only=False), bool)
            steps: list[list[int]] = [[] for _ in symbols]
            gains: list[list[int]] = [[] for _ in symbols]
            for v in range(len(t.vectors) if not alone.all() else 1):
                rows = np.arange(len(symbols)) if v == 0 else np.flatnonzero(~alone)
                part = s if v == 0 else (wide if v > 1 else Segments([symbols[i] for i in rows.tolist()]))
                wide = part
                before, added, _ = part.back(np.full(len(rows), v))
                for i, b, a in zip(rows.tolist(), before.tolist(), added.tolist()):
                    steps[i].append(b)
                    gains[i].append(a)
            yield pa.record_batch([
                batch.column("c"), batch.column("seg"), pa.array(illegal, pa.int64()), pa.array([x[0] >> 2 for x in symbols], pa.int32()),
                pa.array([x[-1] >> 2 for x in symbols], pa.int32()), pa.array(steps, pa.list_(pa.int32())), pa.array(gains, pa.list_(pa.int64()))],
                names=["c", "seg", "illegal", "head", "tail", "step", "gain"])

    return segments.select("c", "seg", "symbols", "alone").mapInArrow(
        run, "c string, seg long, illegal long, head int, tail int, step array<int>, gain array<long>")


def _joined(facts: DataFrame) -> DataFrame:
    """Of each conversation (c): cost, illegal, and for each of several segments the vector behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            cost, illegal, behind = [], [], []
            for parts in batch.column("parts").to_pylist():
                v, total, bad, places, right = 0, 0, 0, [], None
                for p in reversed(parts):
                    if len(parts) > 1:
                        places.append({"seg": p["seg"], "behind": v})
                    total += p["gain"][v]
                    v = p["step"][v]
                    bad += p["illegal"] + (right is not None and (p["tail"], right) not in ((1, 2), (2, 3), (3, 2)))
                    right = p["head"]
                cost.append(total + int(t.vectors[v][START]))
                illegal.append(bad)
                behind.append(places)
            yield pa.record_batch([batch.column("c"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(
                behind, pa.list_(pa.struct([("seg", pa.int64()), ("behind", pa.int32())])))], names=["c", "cost", "illegal", "behind"])

    gathered = facts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seg", "illegal", "head", "tail", "step", "gain"))).alias("parts"))
    return gathered.mapInArrow(run, "c string, cost long, illegal long, behind array<struct<seg:long,behind:int>>")


def _traced(segments: DataFrame) -> DataFrame:
    """(c, seg, edits, ends): by state before the segment, its string of edits and the state behind it; one state if it is alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            alone = np.asarray(batch.column("alone").to_numpy(zero_copy_only=False), bool)
            behind = np.asarray(batch.column("behind"), np.int64)
            edits: list[list[str]] = [[] for _ in symbols]
            ends: list[list[int]] = [[] for _ in symbols]
            for rows, states in ((np.flatnonzero(alone), 1), (np.flatnonzero(~alone), 4)):
                if not len(rows):
                    continue
                s = Segments([symbols[i] for i in rows.tolist()])
                blocks = s.back(behind[rows])[2]
                for state in range(states):
                    for i, text, end in zip(rows.tolist(), *(list(x) for x in s.trace(blocks, state))):
                        edits[i].append(text)
                        ends[i].append(int(end))
            yield pa.record_batch([batch.column("c"), batch.column("seg"), pa.array(edits, pa.list_(pa.string())),
                                   pa.array(ends, pa.list_(pa.int32()))], names=["c", "seg", "edits", "ends"])

    return segments.select("c", "seg", "symbols", "alone", "behind").mapInArrow(
        run, "c string, seg long, edits array<string>, ends array<int>")


def _entered(ends: DataFrame) -> DataFrame:
    """(c, seg, state, last): the state before each segment, and that behind the last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for c, parts in zip(batch.column("c").to_pylist(), batch.column("parts").to_pylist()):
                state = START
                for k, p in enumerate(parts):
                    before, state = state, p["ends"][state]
                    for column, value in zip(out, (c, p["seg"], before, state if k + 1 == len(parts) else None)):
                        column.append(value)
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                                  names=["c", "seg", "state", "last"])

    gathered = ends.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seg", "ends"))).alias("parts"))
    return gathered.mapInArrow(run, "c string, seg long, state int, last int")


@dataclass
class Repaired:
    summary: DataFrame  #: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation
    turns: DataFrame    #: (conv, edit, role, text) of the turns that stay or are new; those of a conversation lie in one partition, in order


def name_of(conv: Column) -> Column:
    """A conversation id as text that is never null."""
    return F.concat(F.when(conv.isNull(), "").otherwise("="), F.coalesce(conv.cast("string"), F.lit("")))


def placed_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, at, turn, role, text, kind, fault, print): all rows in order; ``at`` rises within a conversation."""
    full = F.regexp_replace("text", BLANK + r"+\z", "")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 1, "u", 2, "a", 3)]), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(full == "", IS_BLANK).when(~F.substring(full, -1, 1).isin(".", "!", "?"), IS_TRUNCATED).otherwise(NO_FAULT)
    taken = rows.select(name_of(F.col(f"`{conv}`")).alias("c"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    # Only the start of a text goes through the sampling of ranges; the sort has the whole.
    dealt = taken.repartitionByRange("c", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32)) \
                 .sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text")
    return written(dealt.select(
        "c", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", kind.cast("int").alias("kind"), fault.alias("fault"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("print")), "turns")


def repair(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repaired:
    """Faults, cheapest edits and repaired turns of every conversation of ``rows``, and of ``ids`` that have no rows."""
    placed = placed_turns(rows, conv, turn, role, text)
    # Texts are compared by 128 bits of their hash and their role's length.
    again = written(placed.groupBy("c", "print").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    seen = placed.select("c", "at", "turn", "kind", "fault", "print").join(again, ["c", "print"], "left")
    fault = F.when((F.col("fault") != IS_BLANK) & (F.col("at") > F.col("first")), IS_DUPLICATE).otherwise(F.col("fault"))
    marked = written(seen.select("c", "at", "turn", "kind", fault.alias("fault")), "marked")
    counts = marked.groupBy("c").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in ((IS_BLANK, "blank"), (IS_DUPLICATE, "duplicate"), (IS_TRUNCATED, "truncated"))],
        F.max("turn").alias("high"), F.min("turn").alias("low"))
    turns = marked.where("turn is not null").select("c", "turn").distinct().groupBy("c").agg(F.count("*").alias("different"))

    symbol = F.substring(F.hex(4 * F.col("kind") + F.col("fault")), -1, 1)
    packed = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", symbol.alias("s")))), lambda x: F.concat(F.lit("0"), x["s"])), ""))
    segments = marked.groupBy("c", F.shiftright("at", SEGMENT_BITS).alias("seg")).agg(packed.alias("symbols"))
    several = segments.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c", F.lit(False).alias("alone"))
    segments = written(segments.join(several, "c", "left").withColumn("alone", F.coalesce("alone", F.lit(True))), "segments")
    joined = written(_joined(_segment_facts(segments)), "joined")
    behind = joined.select("c", F.explode("behind").alias("b")).select("c", "b.seg", "b.behind")
    traced = written(_traced(segments.join(behind, ["c", "seg"], "left").withColumn("behind", F.coalesce("behind", F.lit(0)))), "traced")
    entered = _entered(traced.select("c", "seg", "ends"))
    ending = F.element_at(F.array(*[F.lit(x) for x in tables().ending]), F.col("last") + 1)
    edits = written(traced.join(entered, ["c", "seg"]).select(
        "c", "seg", F.concat(F.get("edits", F.col("state")), F.coalesce(ending, F.lit(""))).alias("edits"), "state"), "edits")

    audit = edits.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    listed = (rows if ids is None else ids).select(F.col(f"`{conv}`").alias("id")).distinct().withColumn("c", name_of(F.col("id")))
    zero = F.lit(0).cast("long")
    summary = listed.join(counts, "c", "left").join(turns, "c", "left").join(joined.drop("behind"), "c", "left").join(audit, "c", "left").select(
        F.col("id").alias(conv), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("different"), zero).cast("long").alias("gaps"),
        *[F.coalesce(n, zero).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))
    return Repaired(summary, _repaired_turns(placed, edits, listed.withColumnRenamed("id", conv), conv))


def _repaired_turns(placed: DataFrame, edits: DataFrame, listed: DataFrame, conv: str) -> DataFrame:
    """The turns after the edits: each segment's edits come before its turns and are used up by them, streaming."""
    none = F.lit(None).cast("string")
    script = edits.select("c", F.shiftleft("seg", SEGMENT_BITS).alias("at"), F.lit(0).alias("what"), none.alias("role"), F.col("edits").alias("text"), "state")
    given = placed.select("c", "at", F.lit(1).alias("what"), "role", "text", F.lit(0).alias("state"))
    stream = script.unionByName(given).repartition("c").sortWithinPartitions("c", "at", "what")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, place, state = "", 0, START
        for batch in batches:
            out: list[list] = [[], [], [], []]

            def put(c: str, edit: str, role: str, text: str) -> None:
                for column, value in zip(out, (c, edit, role, text)):
                    column.append(value)

            def insertions(c: str) -> None:
                nonlocal place, state
                while place < len(script) and script[place] == "I":
                    put(c, "I", ROLES[state == AFTER_U], "")
                    place, state = place + 1, _FORCED[state]

            for c, what, role, text, entry in zip(*(batch.column(x).to_pylist() for x in ("c", "what", "role", "text", "state"))):
                if what == 0:
                    script, place, state = text, 0, entry
                    insertions(c)  # those before its first turn
                    continue
                edit = script[place]
                place += 1
                if edit == "K":
                    put(c, "K", role, text)
                    state = _NEXT[" sua".index(role[0])][state]
                elif edit == "R":
                    put(c, "R", ROLES[state == AFTER_U], text)
                    state = _FORCED[state]
                insertions(c)  # those before the next turn
            yield pa.record_batch([pa.array(x, pa.string()) for x in out], names=["c", "edit", "role", "text"])

    done = stream.mapInArrow(run, "c string, edit string, role string, text string")
    kind = listed.schema[conv].dataType
    return done.select(F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).cast(kind).alias(conv), "edit", "role", "text")
