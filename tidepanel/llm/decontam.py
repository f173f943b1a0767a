"""Benchmark decontamination with DataFrame functions only.

Every document becomes an array of normalised words; each run of ``n``
consecutive words is hashed to a long and looked up in the hashed windows of the
benchmark, which are broadcast after their number, and that of the items in them,
was checked. A lookup that
hits is verified word by word. One scan of the documents, no shuffle of texts:
only hits and one marker row per document reach the aggregation. With more
windows than may be broadcast, the words are stored once, hashes with their row
and place are joined by a shuffle, and the hits of a document meet its words again.

Defined cases: a null or empty text has no words and is never contaminated; a
null benchmark text has no windows; a null item_id is an item named ``null``; an item with fewer than ``n`` words, but not
none, is one window of all its words; repeated document rows are judged each on
its own text, also when they share an id or have none; with an empty benchmark nothing is hit. Further columns, whatever their
names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import WORD_GAP, ascii_lower, columns_of, scratch_scope, stored, whole_row

#: Windows of the benchmark that may be broadcast (some 200 bytes each).
BROADCAST_WINDOWS = 400_000
#: The same characters as WORD_GAP, for texts that still have capitals.
RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def word_array(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per distinct window: its hash, words, length and the items."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), word_array(F.col("text")).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = words.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    rows = at.select("item", "len", F.expr("slice(w, i, len)").alias("win_words"))
    rows = rows.groupBy("win_words", "len").agg(F.array_sort(F.collect_set("item")).alias("win_items"))
    return rows.select(F.xxhash64("win_words").alias("h"), F.col("len").alias("win_len"), "win_words", "win_items")


def _hashes(lengths: list[int]) -> list:
    """Per window length, the hashes of all windows of ``w``."""
    size = F.size("w")

    def own(k: int):
        inner = F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, k)))
        return F.when(size >= k, inner).otherwise(F.array().cast("array<bigint>"))

    return [own(k) for k in lengths]


def _hits_by_broadcast(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Per row of ``words``: doc_id, row, mark, n_words, spans, found."""
    size = F.size("w")
    # Position 0 is a marker that keeps documents without a hit.
    words = words.withColumn("all_h", F.concat(F.array(F.lit(0).cast("long")), *_hashes(lengths)))
    seen = words.select("doc_id", "row", "mark", "w", F.posexplode("all_h").alias("p", "dh"))
    start, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for k in lengths:
        own = F.greatest(size - k + 1, F.lit(0))
        inside = (F.col("p") > before) & (F.col("p") <= before + own)
        start, length = F.when(inside, F.col("p") - 1 - before).otherwise(start), F.when(inside, F.lit(k)).otherwise(length)
        before = before + own
    seen = seen.join(F.broadcast(windows), F.col("dh") == F.col("h"), "left")
    seen = seen.filter("p = 0 or h is not null")
    seen = seen.select("doc_id", "row", "mark", size.alias("n_words"), "p", start.alias("s"), length.alias("k"), "win_len", "win_words", "win_items", "w")
    hit = (F.col("p") > 0) & (F.col("k") == F.col("win_len")) & (F.expr("slice(w, s + 1, k)") == F.col("win_words"))
    seen = seen.select("doc_id", "row", "mark", "p", F.col("n_words").cast("long").alias("n_words"), F.when(hit, F.struct(F.col("s").alias("start"), F.col("k").alias("len"))).alias("span"), F.when(hit, F.col("win_items")).alias("found"))
    seen = seen.filter("p = 0 or span is not null")
    return seen.groupBy("doc_id", "row", "mark").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("found").alias("found"))


def _hits_by_shuffle(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for any number of windows. Only hashes with row and place are
    dealt by hash (two plain shuffles, so a frequent window can be split); words
    meet their hits once for each row."""
    words = stored(words, "document-words")

    def place(hashes, k: int):
        return F.transform(hashes, lambda x, i: F.struct(x.alias("dh"), i.alias("start"), F.lit(k).alias("len")))

    placed = [place(h, k) for k, h in zip(lengths, _hashes(lengths))]
    looks = words.select("row", F.explode(F.concat(*placed)).alias("at")).select("row", "at.dh", "at.start", "at.len")
    hits = looks.join(windows, (F.col("dh") == F.col("h")) & (F.col("len") == F.col("win_len")))
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("start", "len", "win_words", "win_items")).alias("hits"))
    both = words.join(hits, "row", "left")
    sure = F.filter(F.coalesce("hits", F.array()), lambda x: F.slice(F.col("w"), x["start"] + 1, x["len"]) == x["win_words"])
    both = both.select("doc_id", "row", "mark", F.size("w").cast("long").alias("n_words"), sure.alias("hits"))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))))
    return both.select("doc_id", "row", "mark", "n_words", spans.alias("spans"), F.transform("hits", lambda x: x["win_items"]).alias("found"))


def text_mark(text_col: str):
    """128 bits of hash that stand for a text; what is hit depends on it alone."""
    return F.struct(F.xxhash64(F.lit(0), F.col(text_col)).alias("a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("b"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document row: its id as ``doc_id``, the ``mark`` of its text, n_words, the
    hit ``spans`` as (start, len) in words, n_hit and the sorted ``items`` found in it."""
    windows = stored(benchmark_windows(benchmark, n), "windows")
    count, named, lengths = windows.agg(F.count("*"), F.sum(F.size("win_items")), F.collect_set("win_len")).first()
    lengths = sorted(lengths, reverse=True) or [n]
    words = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_mark(text_col).alias("mark"), word_array(F.col(text_col)).alias("w"))
    count = max(count, (named or 0) // 4)
    per = (_hits_by_broadcast if count <= broadcast_windows else _hits_by_shuffle)(words, windows, lengths)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("c")),
        lambda acc, s: F.struct(
            F.greatest(acc["e"], s["start"] + s["len"]).alias("e"),
            (acc["c"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["e"], s["start"]))).alias("c"),
        ),
        lambda acc: acc["c"],
    )
    return per.select("doc_id", "row", "mark", "n_words", "spans", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("found"))).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """The documents without contamination, with the columns of ``docs``.

    ``documents`` drops every document with a hit word; ``spans`` cuts the hit
    words (each with the separators after it) out of the texts. Rows are judged by
    their own texts, so equal texts are treated alike and an id says nothing.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    kept: list[DataFrame] = []
    with scratch_scope(docs.sparkSession, kept):
        hits = contamination(docs, benchmark, n).filter("n_hit > 0")
        hits = hits.select(F.col("mark.a").alias("hit_a"), F.col("mark.b").alias("hit_b"), *(["spans"] if mode == "spans" else []))
        # Rows of one mark have the same spans.
        hits = stored(hits.dropDuplicates(["hit_a", "hit_b"]), "hits")
        kept.append(hits)
    mark = text_mark("text")
    same = (mark["a"] == F.col("hit_a")) & (mark["b"] == F.col("hit_b"))
    held = docs.select(whole_row(docs).alias("doc"), "text")
    if mode == "documents":
        # Marks of 16 bytes may be broadcast by their number.
        other = F.broadcast(hits) if hits.count() <= 1_000_000 else hits
        return held.join(other, same, "left_anti").select(*columns_of("doc", docs.columns))
    pieces = F.regexp_extract_all("text", F.lit(f"[^{RAW_GAP}]+[{RAW_GAP}]*"), 0)
    lead = F.regexp_extract("text", f"^[{RAW_GAP}]*", 0)
    # Spans come in order, so the pieces between them are what stays: up to the next
    # span, from the end of all before it.
    ends = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,len:int>>").alias("parts"))

    def between(acc, span):
        part = F.struct((acc["end"] + 1).alias("at"), (span["start"] - acc["end"]).alias("len"))
        return F.struct(F.greatest(acc["end"], span["start"] + span["len"]).alias("end"), F.when(span["start"] > acc["end"], F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    gaps = F.aggregate("spans", ends, between, lambda acc: F.concat(acc["parts"], F.array(F.struct((acc["end"] + 1).alias("at"), F.greatest(F.size("pieces") - acc["end"], F.lit(0)).alias("len")))))
    held = held.join(hits, same, "left").withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    left = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice("pieces", g["at"], g["len"]))), "")
    held = held.withColumn("cut", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(lead, left)))
    return held.select(*[F.col("cut").alias("text") if c == "text" else own for c, own in zip(docs.columns, columns_of("doc", docs.columns))])
