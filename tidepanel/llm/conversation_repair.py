"""Cheapest repair of the turn structure of conversations.

A conversation shall read ``(s?(ua)+)?`` by the initials of its roles. Its rows,
ordered by turn, are kept, given another role or deleted, and empty turns are
inserted, at least cost; of equally cheap edits the ASCII-least string of their
initials is taken. The state after some edits is one of four (start, after s, u,
a), and in every state only one role can be inserted or given, so an audit string
names one repair. Blank and duplicate rows must go; they leave the states alone.

Conversations become tensors that are time-major: sequences are bucketed by
length, all conversations of a bucket take one turn at a time, backwards for the
costs to go of all states (stored), then forwards for the edits; both are numpy
operations over whole buckets, and so is the assembly of the results.

Rows are sorted by ranges of (conversation, turn, role, digest of the text), not
grouped, so a conversation of any length is dealt to several tasks, its segments.
A segment's costs are linear in the (min, +) sense: a 4 x 4 matrix from its first
to its last state. Only the at most one conversation that crosses a border of two
ranges needs them; from these matrices come the costs to go at the borders, and
from one trace for each entry state the states in which segments are entered.
That is some numbers for each range, whatever the table holds. Equal rows are
counted before they are shuffled.

Defined cases: nulls in role or text are one space; null turns come first and
stay out of the gaps; rows of one turn are ordered by role, then by the SHA-256
of the text; an initial other than s, u, a (an empty role has none) cannot be
kept; rows with a null conv_id are one conversation; an empty table gives no
rows; other columns are not read. Texts may be long: they move in two shuffles and
are not looked at in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import modest_batches, stored

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the only role that may be inserted or given in a state.
SPOKEN = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: By kind of a row (s, u, a, other) and state: the state after keeping it; 4 is a dead end.
KEEP = np.array([[AFTER_S, 4, 4, 4], [AFTER_U, AFTER_U, 4, AFTER_U], [4, 4, AFTER_A, 4], [4, 4, 4, 4]])
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
FAR = 1 << 40
BROADCAST_ROWS = 500_000
#: Rows and bytes that a task works on at a time; a longer segment is one piece of work.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 50_000, 32_000_000


# -- rows ------------------------------------------------------------------


def damage(convs: DataFrame) -> DataFrame:
    """Known faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    rows = rows.filter("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _place() -> Column:
    """The turn, with null turns before all others."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))


def ordered_rows(convs: DataFrame) -> DataFrame:
    """Distinct rows in order, stored: conv_id, turn, role, text, n (copies), fault,
    kind, and ``ord``, whose high bits are the range (``seg``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256)), "conversation-rows")
    # Few texts come again in another turn of their conversation.
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.min(_place()).alias("first"), F.count("*").alias("c")).filter("c > 1")
    seen = stored(seen.select(F.col("conv_id").alias("c_id"), F.col("role").alias("c_role"), F.col("digest").alias("c_digest"), "first"), "conversation-repeats")
    other = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    rows = rows.join(other, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("role") == F.col("c_role")) & (F.col("digest") == F.col("c_digest")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.coalesce(_place() > F.col("first"), F.lit(False))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(cut, CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "n", fault.alias("fault"), kind.alias("kind"), "digest")
    keys = ["conv_id", "turn", "role", "digest"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("ord", F.monotonically_increasing_id())
    return stored(rows.drop("digest").withColumn("seg", F.shiftright("ord", 33).cast("int")), "conversation-order")


# -- tensors ---------------------------------------------------------------


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs to go when turns may be inserted first; the last axis is the state."""
    out = cost.copy()
    u, a = cost[..., AFTER_U], cost[..., AFTER_A]
    out[..., AFTER_U] = np.minimum(u, INSERT + a)
    out[..., AFTER_A] = np.minimum(a, INSERT + u)
    for state in (START, AFTER_S):
        out[..., state] = np.minimum(cost[..., state], INSERT + out[..., AFTER_U])
    return out


#: Costs to go after the last row: start and a are ends.
DONE = with_inserts(np.array([0, FAR, FAR, 0]))


def costs_to_go(kind: np.ndarray, late: np.ndarray, live: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, sequences, ends, states). ``kind``, ``late`` (cost of leaving a
    truncated row in) and ``live`` (not padding) are (turns, sequences); ``end`` is
    (sequences, ends, states)."""
    steps = len(kind)
    cost = np.empty((steps + 1, *end.shape), np.int64)
    cost[steps] = end
    for t in range(steps - 1, -1, -1):
        ahead = cost[t + 1]
        wide = np.concatenate([ahead, np.full((*ahead.shape[:-1], 1), FAR)], axis=-1)
        stay = late[t][:, None, None]
        keep = stay + np.take_along_axis(wide, np.broadcast_to(KEEP[kind[t]][:, None, :], ahead.shape), axis=-1)
        best = np.minimum(np.minimum(keep, DELETE + ahead), REROLE + stay + ahead[..., SPOKEN])
        cost[t] = np.where(live[t][:, None, None], with_inserts(np.minimum(best, FAR)), ahead)
    return cost


@dataclass
class Trace:
    """``inserts`` and the state before them (``state``), (turns + 1, sequences);
    ``edit``: the letter of each turn's edit, ``said``: the state after it."""

    inserts: np.ndarray
    state: np.ndarray
    edit: np.ndarray
    said: np.ndarray
    exit: np.ndarray


def trace(kind: np.ndarray, late: np.ndarray, live: np.ndarray, cost: np.ndarray, entry: np.ndarray, last: np.ndarray) -> Trace:
    """Follow the costs to go (one end) from the entry states, least letter first:
    D, I, K, R. ``last``: sequences that end here rather than go on elsewhere."""
    steps, count = kind.shape
    every = np.arange(count)
    q = entry.copy()
    out = Trace(np.zeros((steps + 1, count), np.int64), np.zeros((steps + 1, count), np.int64), np.zeros((steps, count), np.uint8), np.zeros((steps, count), np.int64), q)
    for t in range(steps + 1):
        here = cost[t][:, 0]
        out.state[t] = q
        ahead = cost[t + 1][:, 0] if t < steps else None
        while True:
            now = here[every, q]
            if ahead is not None:
                goes = live[t] & (DELETE + ahead[every, q] != now)
            else:
                goes = last & (now > 0)
            inserted = goes & (INSERT + here[every, SPOKEN[q]] == now)
            if not inserted.any():
                break
            out.inserts[t] += inserted
            q = np.where(inserted, SPOKEN[q], q)
        if ahead is None:
            break
        wide = np.concatenate([ahead, np.full((count, 1), FAR)], axis=1)
        kept = KEEP[kind[t], q]
        deleted = DELETE + ahead[every, q] == now
        keeps = ~deleted & (late[t] + wide[every, kept] == now)
        edit = np.where(deleted, ord("D"), np.where(keeps, ord("K"), ord("R")))
        after = np.where(deleted, q, np.where(keeps, kept, SPOKEN[q]))
        out.edit[t] = np.where(live[t], edit, 0)
        q = np.where(live[t], after, q)
        out.said[t] = q
    out.exit = q
    return out


@dataclass
class Buckets:
    """Sequences of rows that are not blank and not repeated, bucketed by length:
    each bucket is (sequences, row of every turn or -1), turns first."""

    parts: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(open_rows: np.ndarray, sequence: np.ndarray, count: int) -> "Buckets":
        """``open_rows``: places of those rows, ascending; ``sequence``: of each."""
        length = np.bincount(sequence, minlength=count)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        size = np.zeros(count, np.int64)
        some = length > 0
        size[some] = 1 << np.ceil(np.log2(length[some])).astype(np.int64)
        parts = []
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            place = begin[own][None, :] + np.arange(s)[:, None]
            inside = np.arange(s)[:, None] < length[own][None, :]
            rows = np.where(inside, open_rows[np.where(inside, place, 0)] if len(open_rows) else -1, -1)
            parts.append((own, rows))
        return Buckets(parts)


# -- segments --------------------------------------------------------------


@dataclass(frozen=True)
class Border:
    """What a segment must know of its neighbours: the state it is entered in, the
    costs to go at its end, if it is the last, and the row before it."""

    entry: int = START
    end: tuple[int, ...] = tuple(int(x) for x in DONE)
    last: bool = True
    before_kind: int | None = None
    before_turn: int | None = None


WHOLE = Border()


def _key(conv_id: object) -> str:
    return "n" if conv_id is None else f"s{conv_id}"


class Segments:
    """The segments of some rows, in order, as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        column = lambda c: self.table.column(c).combine_chunks()
        get = lambda c: column(c).to_numpy(zero_copy_only=False)
        ids = column("conv_id").dictionary_encode()
        code = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.seg, self.n, self.fault, self.kind = get("seg"), get("n"), get("fault"), get("kind")
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (self.seg[1:] != self.seg[:-1])
        self.begin = np.flatnonzero(new)
        self.stop = np.append(self.begin[1:], len(code))
        self.of = np.cumsum(new) - 1
        self.ids = column("conv_id").take(pa.array(self.begin))
        self.turn_known = column("turn").is_valid().to_numpy(zero_copy_only=False)
        self.turn = column("turn").fill_null(0).to_numpy(zero_copy_only=False)
        self.late = np.where(self.fault == CUT, TRUNCATED, 0)
        self.open = np.flatnonzero((self.fault != BLANK) & (self.fault != DUPLICATE))

    def __len__(self) -> int:
        return len(self.begin)

    def borders(self, known: dict[tuple[int, str], Border]) -> list[Border]:
        if not known:
            return [WHOLE] * len(self)
        return [known.get((int(s), _key(c)), WHOLE) for s, c in zip(self.seg[self.begin], self.ids.to_pylist())]

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(segments, rows, kind, late, live) of each bucket."""
        for own, rows in Buckets.of(self.open, self.of[self.open], len(self)).parts:
            at = np.maximum(rows, 0)
            yield own, rows, self.kind[at], self.late[at], rows >= 0

    def deletions(self) -> np.ndarray:
        """Rows of each segment that must go: blank and repeated ones, further copies."""
        must = self.n.copy()
        must[self.open] -= 1
        return np.add.reduceat(must, self.begin)


def matrices(segments: Segments) -> Iterator[dict]:
    """Per segment the (min, +) matrix from the first to the last state, and its
    last row."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    out = np.empty((len(segments), 4, 4), np.int64)
    for own, _, kind, late, live in segments.buckets():
        cost = costs_to_go(kind, late, live, np.broadcast_to(unit, (len(own), 4, 4)))
        out[own] = cost[0].transpose(0, 2, 1)
    final = segments.stop - 1
    for i, conv in enumerate(segments.ids.to_pylist()):
        turn = int(segments.turn[final[i]]) if segments.turn_known[final[i]] else None
        yield {"seg": int(segments.seg[final[i]]), "key": _key(conv), "numbers": [int(x) for x in out[i].ravel()], "last_kind": int(segments.kind[final[i]]), "last_turn": turn}


def exits(segments: Segments, known: dict[tuple[int, str], Border]) -> Iterator[dict]:
    """Per segment the state it is left in, for every entry state."""
    borders = segments.borders(known)
    end = np.array([b.end for b in borders], np.int64)
    last = np.array([b.last for b in borders])
    out = np.empty((len(segments), 4), np.int64)
    for own, _, kind, late, live in segments.buckets():
        cost = costs_to_go(kind, late, live, end[own][:, None, :])
        for q in range(4):
            out[own, q] = trace(kind, late, live, cost, np.full(len(own), q), last[own]).exit
    for i, conv in enumerate(segments.ids.to_pylist()):
        yield {"seg": int(segments.seg[segments.begin[i]]), "key": _key(conv), "numbers": [int(x) for x in out[i]], "last_kind": None, "last_turn": None}


def repaired(segments: Segments, known: dict[tuple[int, str], Border]) -> pa.RecordBatch:
    """The rows of ``PARTS``, one for each segment."""
    borders = segments.borders(known)
    count, rows = len(segments), len(segments.of)
    entry = np.array([b.entry for b in borders])
    end = np.array([b.end for b in borders], np.int64)
    last = np.array([b.last for b in borders])
    total, final_inserts, final_state = np.zeros(count, np.int64), np.zeros(count, np.int64), entry.copy()
    inserts, state = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    edit, said = np.full(rows, ord("D"), np.uint8), np.zeros(rows, np.int64)
    for own, at, kind, late, live in segments.buckets():
        cost = costs_to_go(kind, late, live, end[own][:, None, :])
        got = trace(kind, late, live, cost, entry[own], last[own])
        # The part's own cost: what is to go at its entry less what is to go at its end.
        total[own] = cost[0][np.arange(len(own)), 0, entry[own]] - np.where(last[own], 0, end[own, got.exit])
        final_inserts[own], final_state[own] = got.inserts[-1], got.state[-1]
        inserts[at[live]], state[at[live]] = got.inserts[:-1][live], got.state[:-1][live]
        edit[at[live]], said[at[live]] = got.edit[live], got.said[live]
    total += DELETE * segments.deletions()

    # Letters: inserts before a row, its edit, its further copies; at the end, inserts.
    letters = np.empty((rows, 3), np.uint8)
    letters[:] = ord("I"), 0, ord("D")
    letters[:, 1] = edit
    times = np.stack([inserts, np.ones(rows, np.int64), segments.n - 1], axis=1)
    stops = np.cumsum(np.add.reduceat(times.sum(1), segments.begin) + final_inserts)
    ends = 3 * segments.stop
    text = np.repeat(np.insert(letters.ravel(), ends, ord("I")), np.insert(times.ravel(), ends, final_inserts))
    audit = pa.LargeStringArray.from_buffers(count, pa.py_buffer(np.append(0, stops).astype(np.int64)), pa.py_buffer(text.astype(np.uint8)))

    # Turns: up to two inserts before a row and the row itself; at the end up to two.
    user, assistant = rows, rows + 1
    speaker = np.array([0, 0, user, assistant])
    first, second = SPOKEN[state], SPOKEN[SPOKEN[state]]
    role = np.stack([speaker[first], speaker[second], np.where(edit == ord("K"), np.arange(rows), speaker[said])], axis=1)
    there = np.stack([inserts > 0, inserts > 1, edit != ord("D")], axis=1)
    words = np.broadcast_to(np.array([rows, rows, 0]), (rows, 3)).copy()
    words[:, 2] = np.arange(rows)
    tail_role = np.stack([speaker[SPOKEN[final_state]], speaker[SPOKEN[SPOKEN[final_state]]]], axis=1)
    tail_there = np.stack([final_inserts > 0, final_inserts > 1], axis=1)
    spots = np.repeat(ends, 2)
    role, there_all = np.insert(role.ravel(), spots, tail_role.ravel()), np.insert(there.ravel(), spots, tail_there.ravel())
    words = np.insert(words.ravel(), spots, rows)
    turns = np.cumsum(np.add.reduceat(there.sum(1), segments.begin) + final_inserts)
    column = lambda c: segments.table.column(c).cast(pa.large_string()).combine_chunks()
    roles = pa.concat_arrays([column("role"), pa.array(["user", "assistant"], pa.large_string())]).take(pa.array(role[there_all]))
    texts = pa.concat_arrays([column("text"), pa.array([""], pa.large_string())]).take(pa.array(words[there_all]))
    spoken = pa.StructArray.from_arrays([roles.cast(pa.string()), texts.cast(pa.string())], names=["role", "text"])
    spoken = pa.ListArray.from_arrays(pa.array(np.append(0, turns).astype(np.int32)), spoken)

    def per_segment(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, segments.begin)

    # Faults: of a blank row all copies are blank; further copies of any other are duplicates.
    n, fault = segments.n, segments.fault
    blank = per_segment(np.where(fault == BLANK, n, 0))
    duplicate = per_segment(np.where(fault == BLANK, 0, n - (fault != DUPLICATE)))
    truncated = per_segment((fault == CUT).astype(np.int64))
    legal = np.zeros((5, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    before = np.append(-1, segments.kind[:-1])
    known_turn, turn = segments.turn_known, segments.turn
    new_turn = known_turn & np.append(True, (turn[1:] != turn[:-1]) | ~known_turn[:-1])
    first_row = np.zeros(rows, bool)
    first_row[segments.begin] = True
    new_turn |= first_row & known_turn
    for i, b in enumerate(borders):
        at = segments.begin[i]
        before[at] = -1 if b.before_kind is None else b.before_kind
        if b.before_turn is not None and known_turn[at] and turn[at] == b.before_turn:
            new_turn[at] = False
    wrong = np.where(before < 0, 0, ~legal[before, segments.kind]) + (n - 1)
    lowest = np.minimum.reduceat(np.where(known_turn, turn, np.iinfo(np.int64).max), segments.begin)
    highest = np.maximum.reduceat(np.where(known_turn, turn, np.iinfo(np.int64).min), segments.begin)
    none = per_segment(known_turn.astype(np.int64)) == 0
    spans = np.array([b is not WHOLE for b in borders])
    return pa.record_batch(
        {
            "conv_id": segments.ids, "seg": pa.array(segments.seg[segments.begin], pa.int32()), "spans": pa.array(spans),
            "low": pa.array(lowest, mask=none), "high": pa.array(highest, mask=none), "turns": pa.array(per_segment(new_turn.astype(np.int64))),
            "blank": pa.array(blank), "duplicate": pa.array(duplicate), "truncated": pa.array(truncated), "illegal": pa.array(per_segment(wrong.astype(np.int64))),
            "cost": pa.array(total), "audit": audit.cast(pa.string()), "repaired": spoken,
        }
    )


PARTS = "seg int, spans boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[Segments]:
    """Whole segments, some rows at a time."""
    waiting: list[pa.RecordBatch] = []
    rows, size, most_rows, most_bytes = 0, 0, ROWS_AT_A_TIME, BYTES_AT_A_TIME
    for batch in batches:
        batch = batch.select(columns)
        waiting.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= most_rows or size >= most_bytes:
            table = pa.Table.from_batches(waiting)
            cut = int(Segments(table).begin[-1])
            if cut:
                yield Segments(table.slice(0, cut))
            waiting = table.slice(cut).combine_chunks().to_batches()
            rows, size = table.num_rows - cut, sum(b.nbytes for b in waiting)
            # A segment that goes on is looked at again when it has doubled.
            most_rows, most_bytes = max(ROWS_AT_A_TIME, 2 * rows), max(BYTES_AT_A_TIME, 2 * size)
    if rows:
        yield Segments(pa.Table.from_batches(waiting))


_NUMBERS = "seg int, key string, numbers array<long>, last_kind int, last_turn long"
_COLUMNS = ["conv_id", "turn", "role", "text", "n", "fault", "kind", "seg"]


def _numbers(rows: DataFrame, find: Callable[[Segments], Iterator[dict]]) -> dict[tuple[int, str], dict]:
    """Some numbers for each segment of conversations that cross borders: at most
    two segments for each range, so they may come to the driver."""
    columns = [c for c in _COLUMNS if c not in ("role", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("seg", pa.int32()), ("key", pa.string()), ("numbers", pa.list_(pa.int64())), ("last_kind", pa.int32()), ("last_turn", pa.int64())])
        for segments in _pieces(batches, columns):
            yield pa.RecordBatch.from_pylist(list(find(segments)), kind)

    dealt = _by_segment(rows.select(*columns, "ord"))
    return {(r["seg"], r["key"]): r.asDict() for r in dealt.mapInArrow(run, _NUMBERS).collect()}


def _by_segment(rows: DataFrame) -> DataFrame:
    """Every range is a task's, in order; the number of ranges is that of ``ordered_rows``."""
    ranges = (rows.agg(F.max("seg")).first()[0] or 0) + 1
    return rows.repartitionById(ranges, F.col("seg")).sortWithinPartitions("ord")


def _borders(rows: DataFrame) -> dict[tuple[int, str], Border]:
    across = rows.groupBy("conv_id").agg(F.min("seg").alias("low"), F.max("seg").alias("high")).filter("low < high")
    # At most one for each range but the last.
    across = across.select(F.col("conv_id").alias("across_id"))
    if across.isEmpty():
        return {}
    inside = rows.join(F.broadcast(across), F.col("conv_id").eqNullSafe(F.col("across_id")), "left_semi")
    inside = stored(inside, "conversation-borders")
    found = _numbers(inside, matrices)
    chains: dict[str, list[int]] = {}
    for seg, key in sorted(found):
        chains.setdefault(key, []).append(seg)
    known: dict[tuple[int, str], Border] = {}
    for key, segs in chains.items():
        end = DONE
        for place in range(len(segs) - 1, -1, -1):
            before = found[segs[place - 1], key] if place else {"last_kind": None, "last_turn": None}
            known[segs[place], key] = Border(START, tuple(int(x) for x in end), place == len(segs) - 1, before["last_kind"], before["last_turn"])
            matrix = np.array(found[segs[place], key]["numbers"]).reshape(4, 4)
            end = np.minimum((matrix + end[None, :]).min(1), FAR)
    left = _numbers(inside, lambda s: exits(s, known))
    for key, segs in chains.items():
        state = START
        for seg in segs:
            b = known[seg, key]
            known[seg, key] = Border(state, b.end, b.last, b.before_kind, b.before_turn)
            state = left[seg, key]["numbers"][state]
    return known


# -- results ---------------------------------------------------------------


def repair_conversations(convs: DataFrame) -> DataFrame:
    """Per conversation (and range, where it crosses a border: then ``spans``), stored:
    its faults, cost, audit string and the ``repaired`` turns in order."""
    modest_batches(convs.sparkSession)
    rows = ordered_rows(convs)
    known = _borders(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments in _pieces(batches, _COLUMNS):
            yield repaired(segments, known)

    kind = convs.schema["conv_id"].dataType.simpleString()
    return stored(_by_segment(rows).mapInArrow(run, f"conv_id {kind}, {PARTS}"), "conversation-parts")


def repaired_rows(parts: DataFrame) -> DataFrame:
    """The repaired turns as rows: conv_id, seg, place (both in order), role, text."""
    return parts.select("conv_id", "seg", F.posexplode("repaired").alias("place", "turn")).select("conv_id", "seg", "place", "turn.role", "turn.text")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, whose parts come in order."""
    have, now, some = None, hashlib.sha256(), False
    for batch in batches:
        for key, lines in zip(batch.column("key").to_pylist(), batch.column("lines")):
            if have is not None and key != have:
                yield pa.record_batch({"key": pa.array([have]), "hash": pa.array([now.hexdigest()])})
                now, some = hashlib.sha256(), False
            have = key
            for line in lines.values if lines.is_valid else []:
                now.update(b"\n" if some else b"")
                now.update(line.as_py().encode())
                some = True
    if have is not None:
        yield pa.record_batch({"key": pa.array([have]), "hash": pa.array([now.hexdigest()])})


def conversation_report(parts: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for every conv_id of ``convs``: gaps, blank, duplicate, truncated,
    illegal, cost, audit and the SHA-256 of the repaired ``role:text`` lines. The
    lines of a conversation that crosses ranges are hashed as a stream."""
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    alone = parts.filter("not spans").select("conv_id", gaps.alias("gaps"), *sums, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n"))
    split = parts.filter("spans").withColumn("key", key)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    whole = split.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *[F.sum(c).alias(c) for c in sums], joined.alias("audit"))
    hashed = split.select("key", "seg", lines.alias("lines")).repartition("key").sortWithinPartitions("key", "seg").select("key", "lines").mapInArrow(_hashes, "key string, hash string")
    whole = whole.join(hashed, "key").select("conv_id", gaps.alias("gaps"), *sums, "audit", F.col("hash").alias("repaired_sha256"))
    found = alone.unionByName(whole).withColumnRenamed("conv_id", "found_id")
    every = convs.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *sums)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
