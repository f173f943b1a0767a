"""Token ids in a content-addressed store.

A document's ids are cut into chunks where a rolling (gear) hash of the last ids
meets a mask, so equal passages give equal chunks wherever they stand. The store
is a folder in the shared file system:

- ``chunks/``: every distinct chunk once, under its address (the 128-bit hash of
  its ids as little-endian unsigned 32-bit integers); the ids are packed in 16 or
  32 bits (``width``);
- ``recipes/``: one row per document in ascending doc_id order, over parts that
  are ranges of doc_id: the addresses and sizes in order, the number of ids,
  those of the part before it, and the Merkle root over the addresses;
- ``manifest/``: for each part its documents, its ids, and the Merkle root over
  the roots of its documents; the store's root is that over the parts.

Reading verifies each chunk against its address and each recipe against its
root. ``document_checks`` reads the files back without moving ids: each chunk
file gives (address, ids, crc32), a recipe gives for each of its chunks how many
bytes come after it, and the crc32 of the document is the exclusive or of its
chunks' crc32, each carried over those bytes. ``read_documents`` returns the ids.

Documents are tokenized once. For a file whose normaliser and pre-tokenizer are
those of ``LOWER_WORDS``, words between white space are looked up in a bounded
memo of the worker; a new word goes through the tokenizer, and plain Latin words
straight to its model, with the same ids as the whole text gives. Any other file
encodes whole texts.

Defined cases: a null text is an empty one, which is one chunk with the end id; a
null doc_id comes first; repeated rows are documents of their own; an empty table
gives an empty store. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import byte_table, modest_batches, remove_path, rounds_of, scratch_path

END_ID = 2
MEMO_WORDS = 300_000
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
_WINDOW_DOUBLINGS = 4
_MASK = np.uint64(((1 << 8) - 1) << 15)
LEAST_IDS, MOST_IDS = 64, 2048


# -- tokenizing ------------------------------------------------------------

#: A normaliser and pre-tokenizer after which a word between white
#: space has the same ids wherever it stands (the pattern itself is the file's).
LOWER_WORDS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Words that go to the model as one text: its output objects cost more than words.
_TOGETHER = 500


def word_pattern(path: str) -> tuple[str, str] | None:
    """The pattern, and the mark of word ends, of a tokenizer file that cuts as
    ``LOWER_WORDS`` says; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    if norm.get("normalizers") != LOWER_WORDS["normalizer"] or len(steps) != 2 or spec["model"].get("type") != "BPE" or spec.get("post_processor"):
        return None
    mark = spec["model"].get("end_of_word_suffix")
    split, letters = steps
    fits = split.get("type") == "Split" and split.get("pattern") == {"Regex": LOWER_WORDS["split"]} and split.get("behavior") == "Removed" and split.get("invert")
    fits = fits and letters.get("type") == "ByteLevel" and not letters.get("add_prefix_space") and not letters.get("use_regex")
    special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return (split["pattern"]["Regex"], mark) if fits and special and mark else None


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 as itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 and the bytes of a column; nulls are empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    return offsets - low, memoryview(texts.buffers()[2])[low:high].tobytes() if high > low else b""


class TextEncoder:
    """The ids of whole texts, for any tokenizer file."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.whole, self.end_id = Tokenizer.from_file(path), end_id

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's first place (one more than
        texts); every text ends with the end id."""
        found = [e.ids for e in self.whole.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        first = np.concatenate([[0], np.cumsum([len(ids) + 1 for ids in found])]).astype(np.int64)
        return np.fromiter(chain.from_iterable([*ids, self.end_id] for ids in found), np.uint32, int(first[-1])), first


class WordEncoder:
    """The ids of words between white space, as the whole text would have them."""

    def __init__(self, path: str, end_id: int, pattern: str, mark: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.end_id = Tokenizer.from_file(path), end_id
        self.cut = regex.compile(pattern)
        self.model = Tokenizer(self.whole.model)
        # A word's last id, and no other, carries the mark of word ends.
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)
        self.closes[[i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token.endswith(mark)]] = True
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        #: What stands for each byte; blanks stay, as they part the words of a run.
        self.spelling = "".join(letters[b] if b != 0x20 else " " for b in range(256))
        self.clear()

    def clear(self) -> None:
        """Forget all words. A word's number leads to its ids in the pool."""
        self.words: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pool = array("I", [self.end_id])
        self.ends = array("q", [1])

    def keep(self, words: list[str]) -> None:
        """Forget all but these words."""
        known = [w for w in words if w in self.words]
        number = np.fromiter(map(self.words.__getitem__, known), np.int64, len(known))
        pool, stop = np.array(self.pool, np.uint32), np.array(self.ends, np.int64)
        count = np.diff(stop, prepend=0)[number]
        total = np.cumsum(count)
        ids = pool[np.repeat(stop[number] - total, count) + np.arange(count.sum())]
        self.clear()
        self._append(known, ids, count)

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space that are one piece each, in lower
        case, and how many each has."""
        runs = [" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        runs = [r if r.isascii() else charmap_decode(r.encode(), "strict", self.spelling)[0] for r in runs]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(runs, add_special_tokens=False))])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            raise ValueError("the model does not mark the ends of words")
        return ids, np.diff(ends, prepend=0)

    def _append(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.ends)
        self.ends.frombytes((len(self.pool) + np.cumsum(counts)).astype(np.int64).tobytes())
        self.pool.frombytes(ids.astype(np.uint32).tobytes())
        self.words.update(zip(words, range(at, at + len(words))))

    def learn(self, words: list[str]) -> None:
        """Put new words into the pool."""
        letters = [w for w in words if _LETTERS.fullmatch(w)]
        if letters:
            self._append(letters, *self._by_model([w.lower() for w in letters]))
        if len(letters) == len(words):
            return
        cut: dict[str, list[str]] = {}
        other: list[str] = []
        for w in words:
            if w in self.words:
                continue
            if _PLAIN.fullmatch(w) and "<|" not in w:
                cut[w] = self.cut.findall(w.lower())
            else:
                other.append(w)
        new = list({p for ps in cut.values() for p in ps if p not in self.pieces})
        if new:
            ids, counts = self._by_model(new)
            self.pieces.update(zip(new, map(np.ndarray.tolist, np.split(ids, np.cumsum(counts)[:-1]))))
        found = [[i for p in ps for i in self.pieces[p]] for ps in cut.values()]
        found += [e.ids for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
        self._append([*cut, *other], np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(ids) for ids in found], np.int64))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's first place (one more than
        texts); every text ends with the end id."""
        # A copy from its own first byte on: some kernels misread slices.
        offsets, raw = _text_buffers(texts)
        plain = b"<|" not in raw
        raw = raw.translate(byte_table(b"")) if plain else raw
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))
        if plain:
            # Fewer distinct words, with the same ids: capitals go anyway, and marks
            # at the end of a word are pieces of their own. (Not beside what may be
            # a special token, which is matched before letters are made small.)
            texts = pc.replace_substring_regex(texts, r"([a-z])([.,;:!?]+)([ \n])", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        if len(self.words) > MEMO_WORDS:
            self.keep(distinct)
        number = np.fromiter(map(self.words.get, distinct, repeat(0)), np.int64, len(distinct))
        new = np.flatnonzero(number == 0).tolist()
        if new:
            fresh = [distinct[i] for i in new]
            self.learn(fresh)
            number[new] = np.fromiter(map(self.words.__getitem__, fresh), np.int64, len(fresh))
        pool, stop = np.array(self.pool, np.uint32), np.array(self.ends, np.int64)
        start = np.concatenate([[0], stop[:-1]])
        n_words = np.diff(np.asarray(lists.offsets))
        # One more "word", the end id (number 0), after the words of each text.
        words = np.zeros(int(n_words.sum()) + len(texts), np.int64)
        ends = np.cumsum(n_words + 1) - 1
        rest = np.ones(len(words), bool)
        rest[ends] = False
        words[rest] = number[flat.indices.to_numpy(zero_copy_only=False)]
        length = (stop - start)[words]
        total = np.cumsum(length)
        at = np.repeat((start[words] - (total - length)).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[at]
        return ids, np.concatenate([[0], total[ends]]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int = END_ID) -> TextEncoder | WordEncoder:
    # Tasks share the cores; threads of the library would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    words = word_pattern(path)
    return TextEncoder(path, end_id) if words is None else WordEncoder(path, end_id, *words)


# -- chunks, addresses, crc32 ----------------------------------------------


def chunk_ends(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each document, places in ``ids``; ``first``: the
    first place of each document and the end of the last. A document's chunks
    depend on its own ids alone: no chunk ends before ``LEAST_IDS`` of them, and
    the rolling hash looks back over fewer."""
    h = _GEAR[ids & 0xFFFF]
    for step in range(_WINDOW_DOUBLINGS):
        d = 1 << step
        earlier = h[:-d] << np.uint64(d)
        h[d:] += earlier
    cuts = np.flatnonzero((h & _MASK) == 0) + 1
    bounds, cuts = np.searchsorted(cuts, first).tolist(), cuts.tolist()
    places, found = first.tolist(), []
    for at, n, lo, hi in zip(places, places[1:], bounds, bounds[1:]):
        ends = []
        for c in cuts[lo:hi] if n - at > LEAST_IDS else ():
            while c - at > MOST_IDS:
                at += MOST_IDS
                ends.append(at)
            if c - at >= LEAST_IDS:
                ends.append(c)
                at = c
        while n - at > MOST_IDS:
            at += MOST_IDS
            ends.append(at)
        found.append([*ends, n] if not ends or ends[-1] != n else ends)
    return found


def address(ids: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ids.astype("<u4").tobytes())


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs of hashes are hashed again until one is left; a lone one moves up."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32 (bits reflected)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=100_000)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes, modulo the polynomial."""
    out, base, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_times`` of two arrays of unsigned 32-bit values."""
    out = np.zeros(len(a), np.uint32)
    b = b.astype(np.uint32)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def combined_crc32(parts: list[tuple[int, int]]) -> int:
    """The crc32 of several pieces in a row from their (crc32, bytes)."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


# -- writing ---------------------------------------------------------------

_STAGED_DDL = "doc_id long, n_tokens long, root binary, addresses array<binary>, sizes array<int>, widths array<int>, packed array<binary>"
_STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("addresses", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())), ("packed", pa.list_(pa.binary()))])


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(path, end_id)
        sent: set[bytes] = set()
        for batch in batches:
            for part, texts in rounds_of(batch, "text", 3_000_000):
                ids, first = enc.encode_texts(texts)
                ends = chunk_ends(ids, first)
                stop = np.fromiter(chain.from_iterable(ends), np.int64)
                start = np.concatenate([[0], stop[:-1]])
                narrow = np.maximum.reduceat(ids, start) < 1 << 16
                wide, short = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype("<u2").tobytes())
                names, packed = [], []
                for a, b, slim in zip(start.tolist(), stop.tolist(), narrow.tolist()):
                    name = xxhash.xxh3_128_digest(wide[4 * a : 4 * b])
                    names.append(name)
                    # A chunk that this task has given already is not given again.
                    packed.append(None if name in sent else bytes(short[2 * a : 2 * b] if slim else wide[4 * a : 4 * b]))
                    if len(sent) < 200_000:
                        sent.add(name)
                counts = np.array([len(e) for e in ends])
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                roots = [merkle_root(names[a:b]) for a, b in zip(at, at[1:])]
                columns = [pa.array(np.diff(first)), pa.array(roots, pa.binary()), _lists(pa.array(names, pa.binary()), counts), _lists(pa.array((stop - start).astype(np.int32)), counts)]
                columns += [_lists(pa.array(np.where(narrow, 2, 4).astype(np.int32)), counts), _lists(pa.array(packed, pa.binary()), counts)]
                yield pa.record_batch([part.column(0), *columns], schema=_STAGED)

    return run


_RECIPE_DDL = "part int, doc_id long, n_tokens long, root binary, addresses array<binary>, sizes array<int>, before long, row long"


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``before`` and ``row`` of the recipes of one part, which come in order."""
    total = rows = 0
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False)
        upto = np.cumsum(n)
        before = total + upto - n
        yield pa.record_batch([*batch.columns, pa.array(before), pa.array(np.arange(rows, rows + len(n)))], names=[*batch.schema.names, "before", "row"])
        total, rows = total + (int(upto[-1]) if len(n) else 0), rows + len(n)


_PART_DDL = "part int, n_docs long, n_tokens long, root binary"


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, roots, total = None, [], 0
    for batch in batches:
        for part, n, root in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != now and now is not None:
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([total], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])
                roots, total = [], 0
            now = part
            roots.append(root)
            total += n
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([total], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Write a store and return its path. ``tokenizer``: a tokenizers file;
    ``end_id``: the id after the last one of every document."""
    spark = docs.sparkSession
    modest_batches(spark)
    path = path or scratch_path(spark, "token-store")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs.mapInArrow(_tokenize(tokenizer, end_id), _STAGED_DDL).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    given = staged.select(F.explode(F.arrays_zip("addresses", "sizes", "widths", "packed")).alias("c")).select("c.*").filter("packed is not null")
    # One sort after the shuffle serves the aggregation; tasks sent no chunk twice.
    given = given.toDF("address", "size", "width", "packed").repartition(parts, "address").sortWithinPartitions("address")
    given.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    # The ids that bound the parts come from the ids alone, so the ranges need no second look at the rest.
    ordered = staged.select("doc_id", "n_tokens", "root", "addresses", "sizes").repartitionByRange(parts, "doc_id")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "root", "addresses", "sizes").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(_number_rows, _RECIPE_DDL).write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "n_tokens", "root", "row")
    roots = recipes.repartition(parts, "part").sortWithinPartitions("part", "row").mapInArrow(_part_roots, _PART_DDL)
    roots.write.parquet(f"{path}/manifest")
    remove_path(spark, f"{path}/staged")
    return path


def store_root(spark: SparkSession, path: str) -> bytes:
    """The Merkle root of the whole store, over its parts (as many as files)."""
    rows = spark.read.parquet(f"{path}/manifest").select("part", "root").collect()
    return merkle_root([bytes(r.root) for r in sorted(rows)])


# -- reading ---------------------------------------------------------------


def _unpack(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if width == 2 else "<u4").astype("<u4")


def _chunk_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, widths, packed = (c.to_pylist() for c in batch.columns)
        crcs = []
        for name, size, width, data in zip(names, sizes, widths, packed):
            ids = _unpack(data, width)
            if len(ids) != size or address(ids) != name:
                raise ValueError(f"chunk {name.hex()} does not have the content of its address")
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["address", "size", "crc"])


_STEP_DDL = "part int, row long, doc_id long, start long, n_tokens long, shift long, address binary"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of each recipe, after the recipe was held against its
    root; ``shift`` carries a crc32 over the bytes that come after the chunk."""
    names = [f.split()[0] for f in _STEP_DDL.split(", ")]
    for batch in batches:
        n, roots, addresses, sizes = (batch.column(i) for i in (4, 5, 6, 7))
        flat, size = addresses.flatten(), sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(np.asarray(addresses.offsets))
        total, upto = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(counts)])
        leaves = flat.to_pylist()
        whole = total[upto[1:]] - total[upto[:-1]]
        if (whole != n.to_numpy(zero_copy_only=False)).any() or any(merkle_root(leaves[a:b]) != root for a, b, root in zip(upto.tolist(), upto[1:].tolist(), roots.to_pylist())):
            raise ValueError("a recipe does not have the root of its document")
        owner = np.repeat(np.arange(len(counts)), counts)
        after = total[upto[1:]][owner] - total[1:]
        distinct, where = np.unique(after, return_inverse=True)
        shift = np.array([_shift(4 * int(x)) for x in distinct], np.int64)[where]
        kept = [batch.column(i).take(pa.array(owner)) for i in range(5)]
        yield pa.record_batch([*kept, pa.array(shift), flat], names=names)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's crc32, carried over the bytes after it."""
    for batch in batches:
        if batch.column(6).null_count:
            raise ValueError("a chunk of a recipe is missing")
        shift, crc = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint32) for i in (5, 6))
        yield pa.record_batch([*batch.columns[:5], pa.array(_times_all(shift, crc).astype(np.int64)), batch.column(7)], names=["part", "row", "doc_id", "start", "n_tokens", "crc", "size"])


def recipes_with_start(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``, the ids of all documents before: those of the
    parts before (one row each) and of the own part."""
    sums = spark.read.parquet(f"{path}/manifest").select("part", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    recipes = spark.read.parquet(f"{path}/recipes").join(F.broadcast(sums), "part")
    return recipes.withColumn("start", F.coalesce("ahead", F.lit(0)) + F.col("before"))


def document_checks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    facts = spark.read.parquet(f"{path}/chunks").select("address", "size", "width", "packed").mapInArrow(_chunk_facts, "address binary, size int, crc long")
    steps = recipes_with_start(spark, path).select("part", "row", "doc_id", "start", "n_tokens", "root", "addresses", "sizes").mapInArrow(_steps, _STEP_DDL)
    # Both sides are plain shuffles, so a chunk that many documents hold can be split.
    both = steps.join(facts, "address", "left").select("part", "row", "doc_id", "start", "n_tokens", "shift", "crc", "size")
    both = both.mapInArrow(_carried, "part int, row long, doc_id long, start long, n_tokens long, crc long, size int")
    whole = both.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("found"))
    sound = F.assert_true(F.col("found") == F.col("n_tokens"), "a document does not have the ids of its recipe")
    return whole.select("doc_id", "start", "n_tokens", F.when(sound.isNull(), F.col("ids_crc32")).alias("ids_crc32"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for chunks in batch.column(1).to_pylist():
            chunks.sort(key=lambda c: c["i"])
            ids.append(np.concatenate([_unpack(c["packed"], c["width"]) for c in chunks]).astype(np.int64))
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the ids of every document."""
    steps = recipes_with_start(spark, path).select("part", "row", "doc_id", F.posexplode("addresses").alias("i", "address"))
    steps = steps.join(spark.read.parquet(f"{path}/chunks"), "address", "left")
    whole = steps.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("i", "width", "packed")).alias("chunks"))
    return whole.select("doc_id", "chunks").mapInArrow(_join_ids, "doc_id long, ids array<long>")
