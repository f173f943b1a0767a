"""Exact Jaccard self-join of documents on word shingles, as T-occurrence search.

Two sets of sizes a and b reach the similarity t when they share at least
T = t / (1 + t) * (a + b) shingles, so at most D = (1 - t) / (1 + t) * (a + b)
shingles lie in one of them only. The join has three steps.

1. Blocks. The range of shingle hashes is cut into m > D segments. By the
   pigeonhole principle a linked pair has an identical segment, so every segment
   of every document gives one 64-bit signature, and documents that share a
   signature are put into one block. m depends on a class of set sizes; a
   document also takes part in the next class when a partner may be there.
   Shingles that are frequent in a hash sample of documents are left out of the
   signatures, so a passage that many documents share does not put them into one
   block; that takes no difference between two sets that was not there, so the
   principle holds for any choice of them. A document that has too many empty
   segments then gives the signatures of its whole set as well, which meet those
   of other such documents. Signatures travel packed, and each task passes on one
   document for each signature it has seen, together with the signature before it
   in that document's list. Documents that share a signature and the one before it
   met at that one, so of each group one document for each distinct predecessor is
   linked; copies give one edge and not one for each signature or task.
2. Search. Within a block every shingle has an inverted list. A query sorts its
   lists by length, heap-merges the short ones and probes the T - 1 long ones by
   binary search for each candidate (DivideSkip); candidates that reach the
   overlap are linked. Documents that are in one component already are not
   compared again, so a group of near copies costs few queries, not all pairs.
   Before, the sets of blocks too large for one task are told apart by sketches, one
   bit for the parity of the number of shingles in each bin of hashes: sets differ in as
   many shingles as parities at least, so no linked pair is parted, and chains of unlinked
   documents break up without their texts; what stays large is cut into chunks. More than
   ``sketch_docs`` of them are first put into blocks again, with the shingles frequent
   among them left out.
3. Equal sets were collapsed to their smallest id before; they get its component.

No pair is lost: the blocks contain all linked pairs whatever the data, and the
search in a block is exact. A block with more than ``block_docs`` sets, or more
than ``block_shingles`` in them, is cut into chunks. Each chunk is searched together with the block's hubs, a hash sample
of an eighth of a chunk, so the parts of one group of near copies come together
through them; pairs inside the block's largest component then need no look, and
only the sets outside it are searched against all others, chunk by chunk.

Defined cases: fewer words than the shingle length give the whole sequence as
the only shingle; null, empty and blank texts have the empty set, which links
with nothing; rows that repeat an id are one document, linked by any of their
texts, each row with the size of its own set (one without words keeps its id as
component); a null id is returned with a null component. Only ``doc_id`` and ``text`` are read.
Shingles are compared by a 64-bit hash, equal sets by 128 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import BLANK_TABLE, Words, components, contract_edges, forget, mix64, modest_batches, release, rounds_of, scratch_scope, stored

_ROLL = np.uint64(0xD6E8FEB86659FD93)
_U64 = 1 << 64
#: Buckets that signatures are dealt into: at least, and documents for each beyond that.
LEAST_BUCKETS, BUCKET_DOCS = 1024, 50_000
#: Signatures that a task holds before it passes them on.
FLUSH = 500_000


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, of = words.hashes(), words.of
    rolled = np.zeros(0, np.uint64)
    if len(h) >= k:
        rolled = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * _ROLL + h[j : len(h) - k + 1 + j]
        rolled = mix64(rolled)
    for i in range(len(of) - 1):
        lo, hi = int(of[i]), int(of[i + 1])
        if hi - lo >= k:
            s = np.sort(rolled[lo : hi - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif hi > lo:
            one = hi - lo
            for x in h[lo:hi].tolist():
                one = (one * int(_ROLL) + x) % _U64
            yield mix64(np.array([one], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Segments:
    """The size classes of a threshold of ``percent`` and their segment counts."""

    def __init__(self, percent: int):
        self.percent = percent
        ratio = min(2.0, (100 / percent) ** 2)
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] * ratio))))
        self.low_array = np.array(self.low)
        self.count: list[int] = []
        for top in (x - 1 for x in self.low[1:]):
            base = self.most_apart(top, top) + 1
            empty = base * float(np.exp(-top / base)) if base > 1 else 0.0
            m = base + int(np.ceil(empty + 3 * np.sqrt(empty)))
            self.count.append(m)

    def most_apart(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def least_shared(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def smallest_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, segments, most apart there) for a set of n shingles."""
        own = int(np.searchsorted(self.low_array, n, "right")) - 1
        found = []
        for c in (own, own + 1):
            if c > own and self.largest_partner(n) < self.low[c]:
                break
            top = self.low[c + 1] - 1
            apart = self.most_apart(n, min(self.largest_partner(n), top))
            if apart:
                found.append((c, self.count[c], apart))
        return found


@lru_cache(maxsize=8)
def segments_of(percent: int) -> Segments:
    return Segments(percent)


@lru_cache(maxsize=128)
def _bounds(m: int) -> np.ndarray:
    return np.array([-(-j * _U64 // m) for j in range(1, m)], dtype=np.uint64)


@lru_cache(maxsize=128)
def _salts(c: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments without frequent shingles, of whole sets, and of empty ones."""
    base = np.arange(m, dtype=np.uint64) + np.uint64((c * 2 + 1) << 40)
    return mix64(base), mix64(base ^ np.uint64(1 << 62)), mix64(base ^ np.uint64(1 << 63))


def signatures(s: np.ndarray, seg: Segments, frequent: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one sorted set, over its size classes. ``frequent``:
    sorted shingles that are left out where enough others are there."""
    classes = seg.classes(len(s))
    if not classes:
        return np.zeros(0, np.uint64)
    rare = s
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = s[frequent[at] != s]
    out = []

    def give(part: np.ndarray, c: int, m: int, kind: int) -> np.ndarray:
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix64(part), out=total[1:])
        cut = np.empty(m + 1, np.int64)
        cut[0], cut[m] = 0, len(part)
        cut[1:m] = np.searchsorted(part, _bounds(m))
        filled = cut[1:] > cut[:-1]
        salt = _salts(c, m)[kind]
        out.append(mix64((total[cut[1:]] - total[cut[:-1]] + salt)[filled]))
        return filled

    for c, m, apart in classes:
        filled = give(rare, c, m, 0)
        # Where so many segments are empty that the agreeing one may be one of them,
        # the whole set speaks too; what is empty even then has a signature of its own.
        if m - int(filled.sum()) > m - 1 - apart:
            filled = give(s, c, m, 1)
            if m - int(filled.sum()) > m - 1 - apart:
                out.append(_salts(c, m)[2][~filled])
    return np.concatenate(out)


def _in_sample(k: int):
    """Every shingle of the sampled documents with its count in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in rounds_of(batch, "text"):
                found = list(shingle_sets(Words(texts, BLANK_TABLE), k))
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def frequent_shingles(docs: DataFrame, k: int, n_docs: int, sample_docs: int = 20_000, least: int = 4, most: int = 500_000) -> np.ndarray:
    """Shingles in ``least`` or more documents of a hash sample of about
    ``sample_docs``, at most ``most`` of them. They only make blocks smaller: any
    choice gives the same links."""
    keep = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(n_docs, 1)))
    counts = docs.filter(keep).select("text").mapInArrow(_in_sample(k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    return np.sort(rows["h"].to_numpy().view(np.uint64)) if len(rows) else np.zeros(0, np.uint64)


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("x", pa.large_binary()), ("y", pa.large_binary())])
_PACKED_DDL = "bucket int, kind int, x binary, y binary"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in columns that are sorted together."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _pack(sig: np.ndarray, before: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; equal signatures leave one id and local edges.
    ``before``: the signature before each one in its document's list, 0 if none."""
    order = np.lexsort((ids, sig))
    sig, before, ids = sig[order], before[order], ids[order]
    first = _runs(sig)
    run = np.cumsum(first) - 1
    heads = ids[first]
    other = ids != heads[run]
    a, b = contract_edges(ids[other], heads[run][other])
    rows = [(int(mix64(a[:1].astype(np.uint64))[0] >> np.uint64(64 - bits)), 2, a.tobytes(), b.tobytes())] if len(a) else []
    sig, before, ids = sig[first], before[first], heads
    bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([np.flatnonzero(_runs(bucket)), [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        rows.append((int(bucket[lo]), 1, sig[lo:hi].tobytes(), np.concatenate([ids[lo:hi].view(np.uint64), before[lo:hi]]).tobytes()))
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        yield pa.record_batch([pa.array([r[i] for r in part], _PACKED.field(i).type) for i in range(4)], schema=_PACKED)


def _describe(k: int, percent: int, bits: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segments_of(percent)
        sigs, befores, owners, waiting = [], [], [], 0
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                docs = []
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(Words(texts, BLANK_TABLE), k)):
                    both = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                    docs.append((doc is None, doc or 0, len(s), both & (_U64 - 1), both >> 64))
                    if doc is not None and len(s):
                        got = signatures(s, seg, sent.value)
                        if len(got):
                            sigs.append(got)
                            befores.append(np.concatenate([np.zeros(1, np.uint64), got[:-1]]))
                            owners.append(np.full(len(got), doc, np.int64))
                            waiting += len(got)
                table = np.array([(d, n) for _, d, n, _, _ in docs], np.int64).reshape(-1, 2)
                hashes = np.array([(x, y) for *_, x, y in docs], np.uint64).reshape(-1, 2)
                none = np.array([d[0] for d in docs], np.int64).reshape(-1, 1)
                blob = np.concatenate([table, hashes.view(np.int64), none], axis=1)
                where = int(xxhash.xxh64_intdigest(blob.tobytes()) >> (64 - bits))
                yield pa.record_batch([pa.array([where], pa.int32()), pa.array([0], pa.int32()), pa.array([blob.tobytes()], pa.large_binary()), pa.array([b""], pa.large_binary())], schema=_PACKED)
                if waiting >= FLUSH:
                    yield from _pack(np.concatenate(sigs), np.concatenate(befores), np.concatenate(owners), bits)
                    sigs, befores, owners, waiting = [], [], [], 0
        if waiting:
            yield from _pack(np.concatenate(sigs), np.concatenate(befores), np.concatenate(owners), bits)

    return run


_FOUND_DDL = "kind int, a long, b long, c long, d long"
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    nothing = pa.nulls(len(a), pa.int64())
    return pa.record_batch([pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(b), nothing, nothing], schema=_FOUND)


def meeting_edges(sig: np.ndarray, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that share a signature and have not met at the one before:
    in every group, one id for each distinct predecessor (all ids without one)
    with the group's first id."""
    order = np.lexsort((ids, before, sig))
    sig, before, ids = sig[order], before[order], ids[order]
    group, speaks = _runs(sig), _runs(sig, before) | (before == 0)
    heads = ids[group][np.cumsum(group) - 1]
    speaks &= ids != heads
    return ids[speaks], heads[speaks]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their buckets: documents are unpacked, and ids with the
    same signature become edges."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    now, sigs, befores, owners, waiting = -1, [], [], [], 0
    for batch in batches:
        for bucket, kind, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            if sigs and bucket != now:
                edges.append(meeting_edges(np.concatenate(sigs), np.concatenate(befores), np.concatenate(owners)))
                waiting += len(edges[-1][0])
                sigs, befores, owners = [], [], []
            now = bucket
            if kind == 0:
                t = np.frombuffer(x, np.int64).reshape(-1, 5)
                yield pa.record_batch([pa.array(np.zeros(len(t), np.int32)), pa.array(t[:, 0], mask=t[:, 4] == 1), *(pa.array(t[:, i]) for i in (1, 2, 3))], schema=_FOUND)
            elif kind == 1:
                sigs.append(np.frombuffer(x, np.uint64))
                owner, before = np.split(np.frombuffer(y, np.uint64), 2)
                owners.append(owner.view(np.int64))
                befores.append(before)
            else:
                edges.append((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)))
                waiting += len(edges[-1][0])
            if waiting > 400_000:
                edges = [contract_edges(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))]
                waiting = 0
                if len(edges[0][0]) > 200_000:
                    yield _edge_batch(*edges.pop())
    if sigs:
        edges.append(meeting_edges(np.concatenate(sigs), np.concatenate(befores), np.concatenate(owners)))
    if edges:
        a, b = contract_edges(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        if len(a):
            yield _edge_batch(a, b)


class Block:
    """Inverted lists over the sets of one block, and the search in them."""

    def __init__(self, sets: list[np.ndarray], seg: Segments):
        self.seg, self.n = seg, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(self.n), self.sizes)
        values, rank = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(rank, kind="stable")
        self.postings = owner[order]
        self.keys = rank[order].astype(np.int64) * self.n + self.postings
        self.length = np.bincount(rank, minlength=len(values))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.ranks = np.split(rank, np.cumsum(self.sizes)[:-1])
        self.parent = list(range(self.n))
        self.members = [1] * self.n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            i, j = min(i, j), max(i, j)
            self.parent[j] = i
            self.members[i] += self.members[j]

    def search(self, q: int) -> None:
        """Link q with every set of the block that reaches the overlap."""
        size, own = int(self.sizes[q]), self.find(q)
        smallest, largest = self.seg.smallest_partner(size), self.seg.largest_partner(size)
        need = int(self.seg.least_shared(size, smallest))
        lists = self.ranks[q][np.argsort(self.length[self.ranks[q]], kind="stable")]
        n_long = min(need - 1, len(lists))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        short = short[self.length[short] > 1]
        if not len(short):
            return
        # Heap merge: the least head of all short lists comes first.
        posts = [self.postings[self.start[r] : self.start[r + 1]].tolist() for r in short]
        found: dict[int, int] = {}
        if len(posts) == 1:
            found = {d: 1 for d in posts[0]}
        else:
            heap = [(p[0], i, 0) for i, p in enumerate(posts)]
            heapq.heapify(heap)
            while heap:
                d, i, at = heap[0]
                found[d] = found.get(d, 0) + 1
                at += 1
                if at < len(posts[i]):
                    heapq.heapreplace(heap, (posts[i][at], i, at))
                else:
                    heapq.heappop(heap)
        cand = np.array([d for d in found if smallest <= self.sizes[d] <= largest and d != q and self.find(d) != own], np.int64)
        if not len(cand):
            return
        shared = np.array([found[int(d)] for d in cand])
        step = max(1, 2_000_000 // max(1, len(long)))
        for at in range(0, len(cand), step):
            probe = (long[:, None].astype(np.int64) * self.n + cand[at : at + step]).ravel()
            place = np.searchsorted(self.keys, probe)
            hit = np.zeros(len(probe), bool)
            inside = place < len(self.keys)
            hit[inside] = self.keys[place[inside]] == probe[inside]
            shared[at : at + step] += hit.reshape(len(long), -1).sum(axis=0)
        for d in cand[shared * (100 + self.seg.percent) >= self.seg.percent * (size + self.sizes[cand])]:
            self.link(q, int(d))

    def solve(self) -> np.ndarray:
        """The component of each set, as the smallest place in it. Searches until
        all sets that have not been queries are in one component."""
        waiting, aside, large = list(range(self.n)), [], None
        for q in waiting:  # grows when another component becomes the large one
            if large is not None and self.find(q) == self.find(large):
                aside.append(q)
                continue
            self.search(q)
            if self.members[self.find(q)] >= 2 * (self.members[self.find(large)] if large is not None else 1):
                waiting.extend(aside)
                aside, large = [], q
        return np.array([self.find(i) for i in range(self.n)])


def _search_blocks(k: int, percent: int):
    """Rows come in order of (task); each task's rows are searched together."""
    out = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def solve(ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids ascend; sets of one id are one node from the start."""
        own = np.array(ids, np.int64)
        block = Block(sets, segments_of(percent))
        for i in np.flatnonzero(own[1:] == own[:-1]).tolist():
            block.link(i, i + 1)
        root = block.solve()
        other = np.flatnonzero(own[root] != own)
        node, first = np.unique(own[other], return_index=True)
        return node, own[root[other[first]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, known = None, [], [], set()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                task = part.column(part.schema.get_field_index("task")).to_pylist()
                doc = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                for t, d, s in zip(task, doc, shingle_sets(Words(texts, BLANK_TABLE), k)):
                    if t != now:
                        if len(ids) > 1:
                            done.append(solve(ids, sets))
                        now, ids, sets = t, [], []
                    if not ids or ids[-1] != d:
                        known = set()
                    name = s.tobytes()
                    if len(s) and name not in known:  # not the same text again
                        known.add(name)
                        ids.append(d)
                        sets.append(s)
            if sum(len(a) for a, _ in done) > 50_000:
                yield pa.record_batch([pa.array(np.concatenate([x[i] for x in done])) for i in (0, 1)], schema=out)
                done = []
        if len(ids) > 1:
            done.append(solve(ids, sets))
        if done:
            yield pa.record_batch([pa.array(np.concatenate([x[i] for x in done])) for i in (0, 1)], schema=out)

    return run


def _searched(docs: DataFrame, places: DataFrame, k: int, percent: int, parts: int, broadcast_rows: int, round_shingles: int) -> DataFrame:
    """The links found in each task; ``places``: class_id, shingles, task. A text is
    sent to each of its tasks; tasks with more than ``round_shingles`` in all are searched
    in rounds, each of which lets go of the texts of the one before."""
    rounds = max(1, -(-(places.agg(F.sum("shingles")).first()[0] or 0) // round_shingles))
    every = places.select("class_id", "task")
    links = []
    for r in range(rounds):
        places = every.filter(F.pmod(F.xxhash64(F.lit(4), "task"), F.lit(rounds)) == r) if rounds > 1 else every
        ids = places.select("class_id").distinct()
        some = docs
        if places.count() > broadcast_rows >= ids.count():  # then only their texts are shuffled
            some = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("class_id"), "left_semi")
        texts = some.join(_sent(places, broadcast_rows), F.col("doc_id") == F.col("class_id")).select("task", "doc_id", "text")
        links.append(stored(texts.repartition(parts, "task").sortWithinPartitions("task", "doc_id").mapInArrow(_search_blocks(k, percent), "node long, root long"), "jaccard-links"))
        del texts
        release(docs.sparkSession)
    return reduce(DataFrame.unionByName, links)


def _sent(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _piece(salt: int, count: str):
    return F.pmod(F.xxhash64(F.lit(salt), "class_id"), F.col(count)).cast("int")


def _chunks(sets, shingles, block_docs: int, block_shingles: int):
    return F.greatest(F.ceil(sets / block_docs), F.ceil(shingles / block_shingles), F.lit(1)).cast("long")


def _outside_largest(placed: DataFrame, links: DataFrame, block_docs: int, block_shingles: int, broadcast_rows: int) -> DataFrame | None:
    """Tasks that hold every set outside the largest component of its block with
    every other set of the block; None if there is no such set. ``placed``:
    class_id, shingles and block of the blocks that were cut."""
    whole = placed.join(links, F.col("class_id") == F.col("node"), "left").select("class_id", "shingles", "block", F.coalesce("root", "class_id").alias("comp"))
    whole = stored(whole, "jaccard-cut")
    most = whole.groupBy("block", "comp").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    most = most.groupBy("block").agg(F.max_by(F.struct("comp", "n", "s"), F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > top.n")
    half = max(1, block_docs // 2), max(1, block_shingles // 2)
    outer = _chunks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"), *half)
    most = stored(most.select("block", F.col("top.comp").alias("largest"), outer.alias("outer"), _chunks(F.col("top.n"), F.col("top.s"), *half).alias("inner")), "jaccard-largest")
    if most.isEmpty():
        return None
    rows = whole.join(_sent(most, broadcast_rows), "block")
    out = rows.filter("comp <> largest").withColumn("i", _piece(1, "outer"))
    met = out.select("class_id", "shingles", "block", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("inner") - 1)).alias("j"), F.lit(0).alias("side"))
    own = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda j: F.struct(F.least(F.col("i").cast("long"), j).alias("i"), F.greatest(F.col("i").cast("long"), j).alias("j")))).alias("p")
    among = out.select("class_id", "shingles", "block", own).select("class_id", "shingles", "block", "p.i", "p.j", F.lit(1).alias("side"))
    rest = rows.filter("comp = largest").withColumn("j", _piece(2, "inner").cast("long"))
    rest = rest.select("class_id", "shingles", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("i"), "j", F.lit(0).alias("side"))
    tasks = met.withColumn("i", F.col("i").cast("long")).unionByName(among).unionByName(rest)
    return stored(tasks.select("class_id", "shingles", F.xxhash64("block", "side", "i", "j").alias("task")), "jaccard-tasks")


def _described(docs: DataFrame, k: int, percent: int, parts: int, bits: int, frequent: np.ndarray) -> DataFrame:
    """Kind 0: doc_id, set size and hash; kind 1: ids that share a signature."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    packed = docs.mapInArrow(_describe(k, percent, bits, sent), _PACKED_DDL)
    found = stored(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _FOUND_DDL), "jaccard-sets")
    del packed
    release(docs.sparkSession)
    return found


def _with_chunks(whole: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """``whole``: class_id, shingles, block. Sets that are alone in their block go."""
    sizes = whole.groupBy("block").agg(F.count("*").alias("sets"), F.sum("shingles").alias("all_shingles")).filter("sets > 1")
    return whole.join(sizes.select("block", _chunks(F.col("sets"), F.col("all_shingles"), block_docs, block_shingles).alias("chunks")), "block")


def _finer(docs: DataFrame, whole: DataFrame, k: int, percent: int, parts: int, bits: int, block_docs: int, block_shingles: int, broadcast_rows: int, enough: int = 0, most_rounds: int = 4) -> DataFrame:
    """``whole`` with large blocks split, until at most ``enough`` documents are in
    such. In a large corpus a shingle of few documents
    is not in the sample of all, and such shingles chain documents that have no
    link. So documents of blocks that would be cut are put into blocks again, with
    shingles that are frequent among them alone left out; linked pairs share a
    block for either choice."""
    before = None
    for _ in range(most_rounds):
        sized = _with_chunks(whole, block_docs, block_shingles)
        large = stored(sized.filter("chunks > 1").select("class_id", "shingles", "block"), "jaccard-large")
        n, shingles = large.agg(F.count("*"), F.sum("shingles")).first()
        if n <= enough or (before and 4 * n > 3 * before):
            break
        before = n
        texts = docs.join(_sent(large.select("class_id"), broadcast_rows), F.col("doc_id") == F.col("class_id"), "left_semi")
        frequent = frequent_shingles(texts, k, n, int(min(20_000, n, max(1, n * 10_000_000 // shingles))))
        found = _described(texts, k, percent, parts, bits, frequent)
        blocks = components(found.filter("kind = 1").select("a", "b"), "jaccard-blocks")
        blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct())
        split = large.join(blocks, F.col("class_id") == F.col("node")).select("class_id", "shingles", F.xxhash64("block", "root").alias("block"))
        whole = stored(sized.filter("chunks = 1").select("class_id", "shingles", "block").unionByName(split), "jaccard-placed")
    return whole


#: Sketches that a task compares with others, at the most, and their bytes.
SKETCHES, SKETCH_BYTES = 8192, 16_000_000


def sketch(s: np.ndarray, size: int) -> np.ndarray:
    """The parity of the number of shingles in each of ``size`` bins, a power of two."""
    odd = (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _size_of(seg: Segments, c: int) -> int:
    """Bins for the sets of a size class: as many as shingles, or up to twice that."""
    return max(64, 1 << (int(seg.low[c + 1]) - 1).bit_length())


def _sketches(k: int, percent: int):
    """class_id, block, size class, set size and sketch of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segments_of(percent)
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                rows = []
                for i, s in enumerate(shingle_sets(Words(texts, BLANK_TABLE), k)):
                    if len(s):
                        c = int(np.searchsorted(seg.low_array, len(s), "right")) - 1
                        rows.append((i, c, len(s), sketch(s, _size_of(seg, c)).tobytes()))
                at = pa.array([r[0] for r in rows], pa.int64())
                names = ["class_id", "block", "c", "n", "bits"]
                yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=names)

    return run


def near_sketches(ids: np.ndarray, n: np.ndarray, bits: np.ndarray, upper: np.ndarray, cross: bool, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all ids whose sketches differ in no more places than linked sets
    of their sizes do. ``cross``: only those with ``upper`` against the others. Ids that are
    joined already are not compared again."""
    order = np.argsort(n, kind="stable")
    ids, n, bits, upper = ids[order], n[order], bits[order], upper[order]
    # Equal ids are one node from the start.
    label = np.unique(ids, return_inverse=True)[1]
    a, b = [], []
    asks = np.flatnonzero(~upper) if cross else np.arange(len(ids))
    stop = np.searchsorted(n, [seg.largest_partner(int(x)) for x in n[asks]], "right")
    step = max(1, 32_768 // bits.shape[1])
    for q, end in zip(asks.tolist(), stop.tolist()):
        own = label[q]
        other = label[q + 1 : end] != own
        if cross:
            other &= upper[q + 1 : end]
        cand = q + 1 + np.flatnonzero(other)
        for at in range(0, len(cand), step):
            some = cand[at : at + step]
            apart = np.bitwise_count(bits[some] ^ bits[q]).sum(axis=1, dtype=np.int64)
            near = some[apart <= seg.most_apart(int(n[q]), n[some])]
            if len(near):
                a.append(np.full(len(near), ids[q]))
                b.append(ids[near])
                joined = np.zeros(len(ids), bool)
                joined[label[near]] = True
                label[joined[label]] = own
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return contract_edges(np.concatenate(a), np.concatenate(b))


def _near(percent: int):
    """Rows come in order of (task); edges between near sketches of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segments_of(percent)

        def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            c, cross = t["c"].to_numpy(), t["cross"][0].as_py()
            width = _size_of(seg, int(c.min())) // 64
            bits = np.zeros((len(t), width), np.uint64)
            for i, raw in enumerate(t["bits"].to_pylist()):  # wider ones are folded
                bits[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width), axis=0)
            a, b = near_sketches(t["class_id"].to_numpy(), t["n"].to_numpy(), bits, c > c.min(), cross, seg)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            task = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and hi > lo and task[lo] != now:
                    yield from solve(held)
                    held = []
                if hi > lo:
                    now = task[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(held)

    return run


def _told_apart(docs: DataFrame, whole: DataFrame, k: int, percent: int, parts: int, block_docs: int, block_shingles: int, broadcast_rows: int) -> DataFrame:
    """``whole`` with the blocks that would be cut split by the sketches of their sets.
    Sets of one size class, and those of neighbouring ones, meet in pieces."""
    sized = _with_chunks(whole, block_docs, block_shingles)
    large = stored(sized.filter("chunks > 1").select("class_id", "shingles", "block"), "jaccard-large")
    if large.isEmpty():
        return whole
    texts = docs.join(_sent(large.select("class_id", "block"), broadcast_rows), F.col("doc_id") == F.col("class_id")).select("class_id", "block", "text")
    made = stored(texts.repartition(parts).mapInArrow(_sketches(k, percent), "class_id long, block long, c int, n long, bits binary"), "jaccard-sketches")
    per = made.groupBy("block", "c").agg(F.greatest(F.ceil(F.count("*") / SKETCHES), F.ceil(F.sum(F.length("bits")) / SKETCH_BYTES)).cast("int").alias("pieces"))
    per = stored(per, "jaccard-pieces")
    to = lambda by, name: per.select("block", (F.col("c") + by).alias("c"), F.col("pieces").alias(name))
    rows = made.join(_sent(to(0, "pieces"), broadcast_rows), ["block", "c"]).join(_sent(to(-1, "above"), broadcast_rows), ["block", "c"], "left").join(_sent(to(1, "below"), broadcast_rows), ["block", "c"], "left")
    rows = rows.withColumn("piece", _piece(6, "pieces"))
    upto = lambda name: F.when(F.col(name).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(name) - 1))
    task = lambda c, i, j, cross: F.struct(F.xxhash64("block", c, i, j, F.lit(cross)).alias("task"), F.lit(cross).alias("cross"))
    own = F.transform(upto("pieces"), lambda j: task(F.col("c"), F.least("piece", j), F.greatest("piece", j), False))
    up = F.transform(upto("above"), lambda j: task(F.col("c"), F.col("piece"), j, True))
    down = F.transform(upto("below"), lambda j: task(F.col("c") - 1, j, F.col("piece"), True))
    rows = rows.withColumn("at", F.explode(F.concat(own, up, down))).select("at.task", "at.cross", "class_id", "c", "n", "bits")
    edges = rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_near(percent), "a long, b long")
    blocks = components(edges, "jaccard-blocks")
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct())
    split = large.join(blocks, F.col("class_id") == F.col("node")).select("class_id", "shingles", F.xxhash64("block", "root").alias("block"))
    return stored(sized.filter("chunks = 1").select("class_id", "shingles", "block").unionByName(split), "jaccard-placed")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, block_docs: int = 4096, block_shingles: int = 500_000, broadcast_rows: int = 1_000_000, round_shingles: int = 20_000_000, sketch_docs: int = 250_000) -> DataFrame:
    """Per document row: doc_id, n_shingles, class_id (the smallest id with the
    same set) and component_id (the smallest id that links lead to). A round of the
    search sends texts of ``round_shingles``, or of half the distinct sets if they are more."""
    spark = docs.sparkSession
    modest_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = docs.count()
    bits = max(LEAST_BUCKETS, n_docs // BUCKET_DOCS).bit_length() - 1
    found = _described(docs, k, percent, parts, bits, frequent_shingles(docs, k, n_docs))
    rows = found.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    key = ["n_shingles", "h1", "h2"]
    same = stored(rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("class_id")), "jaccard-classes")
    blocks = components(found.filter("kind = 1").select("a", "b"), "jaccard-blocks")
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct())
    round_shingles = max(round_shingles, (same.agg(F.sum("n_shingles")).first()[0] or 0) // 2)
    placed = same.groupBy("class_id").agg(F.sum("n_shingles").alias("shingles")).join(blocks, F.col("class_id") == F.col("node"))
    whole = stored(placed.select("class_id", "shingles", F.col("root").alias("block")), "jaccard-placed")
    whole = _finer(docs, whole, k, percent, parts, bits, block_docs, block_shingles, broadcast_rows, sketch_docs)
    whole = _told_apart(docs, whole, k, percent, parts, block_docs, block_shingles, broadcast_rows)
    placed = _with_chunks(whole, block_docs, block_shingles)
    # A hub goes to all chunks of its block, so hubs are an eighth of the rows more.
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "class_id"), 8 * F.col("chunks")) == 0)
    chunk = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(_piece(0, "chunks").cast("long")))
    placed = placed.select("class_id", "shingles", "block", "chunks", F.explode(chunk).alias("chunk"))
    placed = stored(placed.select("class_id", "shingles", "block", F.xxhash64("block", "chunk").alias("task"), "chunks"), "jaccard-tasks")
    links = _searched(docs, placed, k, percent, parts, broadcast_rows, round_shingles)
    cut = placed.filter("chunks > 1").select("class_id", "shingles", "block").distinct()
    # Rows that share an id are one document, whatever their sets.
    twice = rows.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
    twice = stored(twice.filter("lo <> hi").select("doc_id"), "jaccard-twice")
    more = []
    if not cut.isEmpty():
        links = components(links, "jaccard-links")
        tasks = _outside_largest(cut, links, block_docs, block_shingles, broadcast_rows)
        more = [_searched(docs, tasks, k, percent, parts, broadcast_rows, round_shingles)] if tasks is not None else []
    if not twice.isEmpty():
        more.append(rows.join(twice, "doc_id").join(same, key).select(F.col("doc_id").alias("node"), F.col("class_id").alias("root")))
    for table in more:
        links = links.unionByName(table)
    if more:
        links = components(links, "jaccard-links")
    joined = same.join(links, F.col("class_id") == F.col("node"), "left")
    # A table of its own, so that the join can be split where many copies share a set.
    joined = stored(joined.select(*key, "class_id", F.coalesce("root", "class_id").alias("component_id")), "jaccard-joined")
    forget(whole, placed, twice)
    out = rows.join(joined, key, "left")
    named = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, k: int = 4, percent: int = 85, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents whose id is the smallest of their component, with the columns
    of ``docs``. Rows with a null id stay, as do rows that repeat a kept id."""
    kept: list[DataFrame] = []
    with scratch_scope(docs.sparkSession, kept):
        found = jaccard_components(docs, k, percent)
        gone = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
        kept.append(gone)
    return docs.join(_sent(gone, broadcast_rows), "doc_id", "left_anti").select(docs.columns)
