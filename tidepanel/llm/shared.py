"""Helpers that several text operators share: scratch tables, byte-level word
scanning in numpy, and connected components over an edge table."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Characters that separate words in the benchmark and licence scans.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that count as white space (tab, LF, VT, FF, CR and blank).
BLANKS = b" \t\n\x0b\x0c\r"


# -- scratch tables --------------------------------------------------------


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` when
    the cluster names one, else the session's checkpoint directory. With a local
    master (tests, one machine) a temporary folder becomes that directory; on a
    cluster a missing shared folder is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidepanel-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.add(path)
    return path


#: Paths made inside each open ``scratch_scope``.
_scopes: list[set[str]] = []
#: Where the tables that ``stored`` returned lie.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: later work
    starts from files that every executor can open, whoever is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        if path := _places.pop(table, None):
            remove_path(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs. Spark removes them when the driver
    collects garbage, which a driver with room to spare may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch_scope(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Remove the scratch tables made inside, but for those put into ``keep``. What
    is kept must be stored inside, as lazy results still read other tables."""
    made: set[str] = set()
    _scopes.append(made)
    try:
        yield
    finally:
        # By identity: scopes that made the same paths so far are equal as sets.
        del _scopes[next(i for i, scope in enumerate(_scopes) if scope is made)]
        for path in made - {_places.get(t) for t in keep}:
            remove_path(spark, path)


def modest_batches(spark: SparkSession) -> None:
    """Texts are long: where the session still has Spark's defaults, send Arrow
    batches of at most 8 MB and 2,000 rows to Python instead of 64 MB and 10,000."""
    for key, default, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame):
    """All columns in one struct, so that no name can clash with those of a plan."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def columns_of(row: str, names: list[str]) -> list:
    """The columns of ``whole_row`` again."""
    return [F.col(row).getField(c).alias(c) for c in names]


def ascii_lower(col):
    """Lower-case A-Z only (``lower`` would also change other alphabets)."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def fold_of(col, n: int):
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


# -- word scanning in numpy ------------------------------------------------


def byte_table(separators: bytes) -> bytes:
    """A translation table: A-Z to a-z, and every separator to a blank."""
    table = bytearray(range(256))
    for up, low in zip(ASCII_UPPER.encode(), ASCII_LOWER.encode()):
        table[up] = low
    for s in separators:
        table[s] = 0x20
    return bytes(table)


#: Words of letters, digits and everything beyond ASCII.
ALNUM_TABLE = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)))
#: Words between white space.
BLANK_TABLE = byte_table(BLANKS)

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (fixed values: the constants of
    the splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """All words of a batch of texts, as arrays over one translated buffer.

    ``data``: the bytes, ``begin``/``end``: each word's range, ``of``: the first
    word of each text (one entry more than texts), ``edge``: text offsets.
    """

    def __init__(self, texts: pa.Array, table: bytes):
        texts = texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        raw = memoryview(texts.buffers()[2])[low:high].tobytes() if high > low else b""
        self.data = np.frombuffer(raw.translate(table), dtype=np.uint8)
        self.edge = offsets - low if len(offsets) else np.zeros(1, np.int64)
        inside = self.data != 0x20
        n = len(inside)
        first = np.ones(n, dtype=bool)
        first[1:] = ~inside[:-1]
        starts = self.edge[:-1]
        first[starts[starts < n]] = True
        self.begin = np.flatnonzero(inside & first)
        last = np.ones(n, dtype=bool)
        last[:-1] = ~inside[1:]
        stops = self.edge[1:]
        last[stops[stops > 0] - 1] = True
        self.end = np.flatnonzero(inside & last) + 1
        self.of = np.searchsorted(self.begin, self.edge)

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word (polynomial over its bytes, then mixed)."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.data] * _power(_R, len(self.data)), out=total[1:])
        value = (total[self.end] - total[self.begin]) * _power(_R_INVERSE, len(self.data))[self.begin]
        return mix64(value + (self.end - self.begin).astype(np.uint64))


def hash_of_words(words: list[str]) -> np.ndarray:
    """The hashes that ``Words.hashes`` gives these words."""
    return Words(pa.array(words, pa.string()), ALNUM_TABLE).hashes() if words else np.zeros(0, np.uint64)


def text_slices(column: pa.Array, limit: int = 1_500_000) -> Iterator[tuple[int, pa.Array]]:
    """Cut a column into runs of some ``limit`` bytes, so that the arrays over
    single bytes stay small; a longer text is a run of its own."""
    column = column.cast(pa.large_string())
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, "right")))
        yield at, column.slice(at, stop - at)
        at = stop


def rounds_of(batch: pa.RecordBatch, name: str, limit: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """``text_slices`` together with the other columns of a batch. After a batch,
    memory that its arrays left free goes back to the system, as workers live on."""
    for at, texts in text_slices(batch.column(batch.schema.get_field_index(name)), limit):
        yield batch.slice(at, len(texts)), texts
    del batch
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# -- connected components --------------------------------------------------


def contract_edges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the edges by one star for each component, centred on its smallest
    node: (node, centre) without the centres themselves."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[: len(left)], where[len(left) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contract_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_a, kept_b, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        kept_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        kept_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        waiting += len(batch)
        if waiting >= 500_000:
            a, b = contract_edges(np.concatenate(kept_a), np.concatenate(kept_b))
            kept_a, kept_b, waiting = [a], [b], 0
    a, b = contract_edges(np.concatenate(kept_a), np.concatenate(kept_b))
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["node", "root"])


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of two long columns.

    Returns (node, root), root being the smallest node of the component, for
    every node that has an edge to another node. Alternates the large-star and
    small-star steps of Kiveris et al. (2014): each is one aggregation and one
    join, the number of rounds is logarithmic in practice, and no component is
    ever gathered in one place. Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root"))
    pairs = pairs.filter("node is not null and root is not null and node <> root")
    pairs = pairs.mapInArrow(_contract_partition, "node long, root long")

    def signature(df: DataFrame):
        got = df.agg(F.count("*"), F.sum(F.xxhash64("node", "root") % 1_000_003), F.sum(F.expr("cast(node as decimal(38,0))"))).first()
        return tuple(got)

    pairs = stored(pairs.distinct(), label)
    was = signature(pairs)
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).withColumn("low", F.least("low", "node"))
        # A table of its own, so that the join can be split where a node has many neighbours.
        least = stored(least, label)
        # Large star: every larger neighbour of a node moves to its smallest one.
        large = both.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.filter("node <> root").distinct()
        # Small star: smaller neighbours and the node itself do the same.
        down = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(down, "node")
        small = small.select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct(F.col("node"), F.col("low").alias("root")))).alias("e")).select("e.*")
        nxt = stored(small.filter("node <> root").distinct(), label)
        forget(least, pairs)
        now = signature(nxt)
        if now == was:
            return nxt
        pairs, was = nxt, now
    raise RuntimeError("components did not settle")
