"""Reversible line deduplication: cuckoo filters in front of exact counts.

A line's key is the line without white space at both ends and with A-Z in lower
case, held as a 128-bit hash. ``LineIndex`` keeps, in tables of the shared
folder, the exact number of documents of every key (``refs``) and, for each shard
of the key space, a cuckoo filter over the keys that stand in at least
``min_docs`` documents, with those keys in sorted order. Inserting or deleting
documents adds to the counts and moves only the keys that cross the threshold
into or out of their shard's filter; deleting what was inserted restores the
former state. A lookup asks the filters first and confirms by the exact keys.

Counts are pre-aggregated in each task, so a line that a third of all documents
hold is a few rows in the shuffle. There is a shard for each 250,000 frequent keys
(64 at least). Dropping lines needs no shuffle while the frequent keys are few
enough to send to every task (``broadcast_keys``, 16 bytes each); beyond that the
filters alone are sent (``filter_keys``, some 2 bytes each) and the lines that
pass them are joined with the exact counts; beyond that all line keys are.

Defined cases: null and empty texts are one empty line; an empty key is never
dropped; a line that a document repeats counts once for it; every row is a
document, whether its id is null or repeated or not; an empty table gives an
empty index. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.shared import BLANKS, byte_table, mix64, rounds_of, stored

SLOTS = 4
#: Frequent keys for each shard, beyond 64 shards.
SHARD_KEYS = 250_000
_LOWER = byte_table(b"")
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports insertion and deletion."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, -(-keys * 5 // (SLOTS * 4)))
        return cls(1 << (need - 1).bit_length())

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = h & np.uint64(self.buckets - 1)
        return mark, one.astype(np.int64), (one ^ (mix64(mark) & np.uint64(self.buckets - 1))).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def _fill(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which ones found one."""
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        free = np.cumsum(self.table[own] == 0, axis=1)
        fits = free[:, -1] > rank
        slot = (free == rank[:, None] + 1).argmax(axis=1)
        self.table[own[fits], slot[fits]] = mark[order[fits]]
        placed = np.zeros(len(at), bool)
        placed[order[fits]] = True
        return placed

    def insert(self, h: np.ndarray) -> bool:
        """False if a place could not be found (the filter must then grow)."""
        rng = np.random.default_rng(len(h))
        mark, one, two = self.places(h)
        for second in (False, True):
            if len(mark):
                rest = ~self._fill(two if second else one, mark)
                mark, one, two = mark[rest], one[rest], two[rest]
        # The others push marks out of full buckets into their second ones.
        for out, at in zip(mark, two.tolist()):
            for _ in range(500):
                slot = rng.integers(SLOTS)
                out, self.table[at, slot] = self.table[at, slot], out
                at = int(np.uint64(at) ^ (mix64(np.array([out]))[0] & np.uint64(self.buckets - 1)))
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = out
                    break
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        for mark, one, two in zip(*self.places(h)):
            for at in (one, two):
                slot = np.flatnonzero(self.table[at] == mark)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break


def line_keys(texts: pa.Array) -> Iterator[tuple[list[bytes], list[bytes | None]]]:
    """For each text its lines and their keys (None for an empty key)."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = memoryview(texts.buffers()[2])[low:high].tobytes() if high > low else b""
    lower = raw.translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    edge = offsets - low
    newline = np.flatnonzero(data == 10)
    solid = np.flatnonzero(~_BLANK[data])
    digest = xxhash.xxh3_128_digest
    which = np.searchsorted(newline, edge)
    for i in range(len(texts)):
        own = newline[which[i] : which[i + 1]]
        begin = np.concatenate([edge[i : i + 1], own + 1])
        end = np.concatenate([own, edge[i + 1 : i + 2]])
        first, last = np.searchsorted(solid, begin), np.searchsorted(solid, end) - 1
        lines, keys = [], []
        for b, e, f, t in zip(begin.tolist(), end.tolist(), first.tolist(), last.tolist()):
            lines.append(raw[b:e])
            keys.append(digest(lower[solid[f] : solid[t] + 1]) if t >= f else None)
        yield lines, keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in rounds_of(batch, "text"):
            keys = [k for _, keys in line_keys(texts) for k in set(keys) if k is not None]
            yield pa.record_batch([pa.array(x) for x in _halves(keys)], names=["k1", "k2"])


_FILTER_DDL = "shard int, buckets long, marks binary, k1 binary, k2 binary"


def _filter_row(shard: int, k1: np.ndarray, k2: np.ndarray, old: CuckooFilter | None = None) -> pd.DataFrame:
    order = np.lexsort((k2, k1))
    k1, k2 = k1[order], k2[order]
    made = old
    while made is None or made.buckets * SLOTS * 95 < len(k1) * 100:
        made = CuckooFilter.sized(len(k1) if made is None else made.buckets * SLOTS)
        while not made.insert(k1.view(np.uint64)):
            made = CuckooFilter(made.buckets * 2)
    return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "marks": [made.table.tobytes()], "k1": [k1.tobytes()], "k2": [k2.tobytes()]})


def _build_filter(group: pd.DataFrame) -> pd.DataFrame:
    return _filter_row(int(group["shard"].iloc[0]), group["k1"].to_numpy(), group["k2"].to_numpy())


def _change_filter(filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """Put the keys that reached the threshold in and take the others out."""
    if not len(moves):
        return filters
    enter, leave = moves[moves["enter"]], moves[~moves["enter"]]
    if len(filters):
        row = filters.iloc[0]
        k1, k2 = np.frombuffer(row["k1"], np.int64), np.frombuffer(row["k2"], np.int64)
        made = CuckooFilter(int(row["buckets"]), np.frombuffer(row["marks"], np.uint16).reshape(-1, SLOTS).copy())
    else:
        k1 = k2 = np.zeros(0, np.int64)
        made = CuckooFilter(1)
    made.delete(leave["k1"].to_numpy().view(np.uint64))
    gone = pd.MultiIndex.from_frame(leave[["k1", "k2"]])
    stay = ~pd.MultiIndex.from_arrays([k1, k2]).isin(gone) if len(gone) else np.ones(len(k1), bool)
    k1 = np.concatenate([k1[stay], enter["k1"].to_numpy()])
    k2 = np.concatenate([k2[stay], enter["k2"].to_numpy()])
    if made.buckets * SLOTS * 95 < len(k1) * 100 or not made.insert(enter["k1"].to_numpy().view(np.uint64)):
        made = None
    return _filter_row(int(moves["shard"].iloc[0]), k1, k2, made)


class _Lookup:
    """All shards' filters side by side in one task, with the exact keys unless
    only (shard, buckets, marks) are given."""

    def __init__(self, rows: list[tuple], shards: int):
        self.offset, self.mask = np.zeros(shards, np.int64), np.zeros(shards, np.uint64)
        tables, at = [np.zeros((1, SLOTS), np.uint16)], 1
        for shard, buckets, marks, *_ in rows:
            self.offset[shard], self.mask[shard] = at, buckets - 1
            tables.append(np.frombuffer(marks, np.uint16).reshape(-1, SLOTS))
            at += buckets
        self.table = np.concatenate(tables)
        self.shards = shards
        k1 = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r[3], np.int64) for r in rows if len(r) > 3])
        k2 = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r[4], np.int64) for r in rows if len(r) > 3])
        order = np.lexsort((k2, k1))
        self.k1, self.k2 = k1[order], k2[order]
        self.most = int(np.unique(self.k1, return_counts=True)[1].max()) if len(k1) else 0

    def maybe(self, k1: np.ndarray) -> np.ndarray:
        """What the filters say: all frequent keys, and a few others."""
        h = k1.view(np.uint64)
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        mask = self.mask[shard]
        one = h & mask
        two = one ^ (mix64(mark) & mask)
        base = self.offset[shard]
        return ((self.table[base + one.astype(np.int64)] == mark[:, None]) | (self.table[base + two.astype(np.int64)] == mark[:, None])).any(axis=1)

    def frequent(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        if not self.most:
            return np.zeros(len(k1), bool)
        maybe = np.flatnonzero(self.maybe(k1))
        place = np.searchsorted(self.k1, k1[maybe])
        sure = np.zeros(len(maybe), bool)
        for j in range(self.most):
            at = np.minimum(place + j, len(self.k1) - 1)
            sure |= (self.k1[at] == k1[maybe]) & (self.k2[at] == k2[maybe])
        out = np.zeros(len(k1), bool)
        out[maybe[sure]] = True
        return out


_KEPT_DDL = "doc_id long, text string, n_lines long, n_dropped long"


def _dropper(sent, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(sent.value, shards)
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                docs = list(line_keys(texts))
                keys = [k for _, ks in docs for k in ks if k is not None]
                drop = iter(look.frequent(*(x.copy() for x in _halves(keys))).tolist()) if keys else iter(())
                out, counts, dropped = [], [], []
                for lines, ks in docs:
                    kept = [line for line, k in zip(lines, ks) if k is None or not next(drop)]
                    out.append(b"\n".join(kept))
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                text = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column(0), text, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return run


def _lines_of(sent, shards: int):
    """The lines that the filters let pass (all of them without filters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(sent.value, shards) if sent is not None else None
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                rows = part.column(part.schema.get_field_index("row")).to_pylist()
                at, number, keys = [], [], []
                for row, (_, ks) in zip(rows, line_keys(texts)):
                    for i, k in enumerate(ks):
                        if k is not None:
                            at.append(row)
                            number.append(i)
                            keys.append(k)
                k1, k2 = (x.copy() for x in _halves(keys))
                passed = look.maybe(k1) if look is not None and len(k1) else np.ones(len(k1), bool)
                columns = [np.array(at, np.int64), np.array(number, np.int32), k1, k2]
                yield pa.record_batch([pa.array(c[passed]) for c in columns], names=["row", "line", "k1", "k2"])

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, gone = (batch.column(i).to_pylist() for i in range(3))
        out, counts, dropped = [], [], []
        for text, numbers in zip(texts, gone):
            lines, cut = (text or "").split("\n"), set(numbers or ())
            out.append("\n".join(x for i, x in enumerate(lines) if i not in cut))
            counts.append(len(lines))
            dropped.append(len(cut))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


@dataclass
class LineIndex:
    """A state of the index: two tables in the shared folder. ``insert`` and
    ``delete`` return the next state and leave this one as it is."""

    spark: SparkSession
    refs: DataFrame
    filters: DataFrame
    min_docs: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, shards: int | None = None) -> LineIndex:
        refs = stored(cls._counted(docs), "line-refs")
        frequent = refs.filter(F.col("docs") >= min_docs)
        shards = shards or max(64, 1 << (frequent.count() // SHARD_KEYS).bit_length())
        filters = frequent.withColumn("shard", cls._shard(shards)).groupBy("shard").applyInPandas(_build_filter, _FILTER_DDL)
        return cls(docs.sparkSession, refs, stored(filters, "line-filters"), min_docs, shards)

    @staticmethod
    def _shard(shards: int):
        """The unsigned remainder of k1, as the filters compute it."""
        return F.pmod(F.pmod(F.shiftrightunsigned("k1", 1), F.lit(shards)) * 2 + F.col("k1").bitwiseAND(1), F.lit(shards)).cast("int")

    @staticmethod
    def _counted(docs: DataFrame) -> DataFrame:
        keys = docs.select("text").mapInArrow(_keys_of, "k1 long, k2 long")
        return keys.groupBy("k1", "k2").agg(F.count("*").alias("docs"))

    def _moved(self, docs: DataFrame, sign: int) -> LineIndex:
        change = self._counted(docs).select("k1", "k2", (F.col("docs") * sign).alias("change"))
        both = self.refs.select("k1", "k2", "docs", F.lit(0).cast("long").alias("change")).unionByName(change.withColumn("docs", F.lit(0).cast("long")))
        both = both.groupBy("k1", "k2").agg(F.sum("docs").alias("old"), F.sum("change").alias("change"))
        both = stored(both.withColumn("docs", F.col("old") + F.col("change")), "line-change")
        moves = both.filter((F.col("old") >= self.min_docs) != (F.col("docs") >= self.min_docs))
        moves = moves.select(self._shard(self.shards).alias("shard"), "k1", "k2", (F.col("docs") >= self.min_docs).alias("enter"))
        filters = self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(_change_filter, _FILTER_DDL)
        # Counts below 0 stay: documents deleted before they came are owed to the index.
        refs = both.filter("docs <> 0").select("k1", "k2", "docs")
        return LineIndex(self.spark, refs, stored(filters, "line-filters"), self.min_docs, self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._moved(docs, -1)

    def drop_lines(self, docs: DataFrame, broadcast_keys: int = 2_000_000, filter_keys: int = 30_000_000) -> DataFrame:
        """doc_id, the text without its frequent lines, n_lines and n_dropped."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        keys = self.filters.agg(F.coalesce(F.sum(F.length("k1") / 8), F.lit(0))).first()[0]
        context = self.spark.sparkContext
        if keys <= broadcast_keys:
            sent = context.broadcast([tuple(r) for r in self.filters.collect()])
            return docs.mapInArrow(_dropper(sent, self.shards), _KEPT_DDL)
        sent = context.broadcast([tuple(r) for r in self.filters.select("shard", "buckets", "marks").collect()]) if keys <= filter_keys else None
        # Rows are numbered once: both sides below read the same table.
        docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "line-docs")
        lines = docs.mapInArrow(_lines_of(sent, self.shards), "row long, line int, k1 long, k2 long")
        hot = self.refs.filter(F.col("docs") >= self.min_docs).select("k1", "k2")
        gone = lines.join(hot, ["k1", "k2"]).groupBy("row").agg(F.collect_list("line").alias("gone"))
        return docs.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_cutter, _KEPT_DDL)
