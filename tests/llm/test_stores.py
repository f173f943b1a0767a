import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LOWER, SCHEMA, corpus, frame

BLANK = " \t\n\x0b\x0c\r"


def dropped(rows, least):
    keys = Counter()
    for r in rows:
        keys.update({x.strip(BLANK).translate(LOWER) for x in (r[1] or "").split("\n")} - {""})
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if keys[x.strip(BLANK).translate(LOWER)] < least]
        out[r[0]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("limits", [(2_000_000, 0), (0, 2_000_000), (0, 0)])
def test_lines_against_brute_force(spark, limits):
    from tidepanel.llm.line_dedup import LineIndex

    rows = corpus() + [(9000 + i, f" Common LINE\t\nown {i}\n\n\x0bcommon line", "en", "a", 1) for i in range(12)]
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in LineIndex.build(docs, min_docs=3).drop_lines(docs, *limits).collect()}
    assert got == dropped(rows, 3)


def test_rows_with_one_id_are_documents_each(spark):
    import duckdb

    from tidepanel.llm.line_dedup import LineIndex
    from tidepanel.llm.queries import ORACLES

    rows = [(1, "same line", "en", "a", 1)] * 12 + [(None, "same line\nown", "en", "a", 1), (2, "other\n\nSAME line ", "en", "a", 1)]
    docs = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("docs", F.lit(3))
    kept = LineIndex.build(docs).drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    got = sorted(map(str, (tuple(r) for r in kept.collect())))
    documents = docs.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(ORACLES["op2_line_dedup"]).fetchall()
    assert got == sorted(map(str, want)) and got.count(str((1, 1, 1, hashlib.sha256(b"").hexdigest()))) == 12


def test_line_index_is_reversible(spark):
    from tidepanel.llm.line_dedup import LineIndex

    rows = corpus()
    more = [(5000 + i, "\n".join(f"line {j}" for j in range(i % 7)) + "\nw1 w2", "en", "a", 1) for i in range(30)]
    docs, extra = frame(spark, rows), frame(spark, more)
    first = LineIndex.build(docs, min_docs=3, shards=4)
    both = first.insert(extra)
    assert {r.doc_id: r.text for r in both.drop_lines(docs.union(extra)).collect()} == {k: v[2] for k, v in dropped(rows + more, 3).items()}
    back = both.delete(extra)
    state = lambda x: sorted(tuple(r) for r in x.refs.collect())
    assert state(back) == state(first)
    assert {r.doc_id: r.text for r in back.drop_lines(docs).collect()} == {k: v[2] for k, v in dropped(rows, 3).items()}


def test_deletions_before_insertions_cancel(spark):
    """Documents that the index never held: counts below 0 wait for them, in any order."""
    from tidepanel.llm.line_dedup import LineIndex

    rows = corpus(groups=15)
    strange = [(7000 + i, "never seen\nw1 w2\nshared line", "en", "a", 1) for i in range(4)]
    more = [(8000 + i, "shared line\nw1 w2", "en", "a", 1) for i in range(3)]
    docs, b, c = frame(spark, rows), frame(spark, strange), frame(spark, more)
    first = LineIndex.build(docs, min_docs=3, shards=4)
    state = lambda x: sorted(tuple(r) for r in x.refs.collect())
    owed = first.delete(b)
    assert min(r[2] for r in state(owed)) == -4
    assert state(owed.insert(b)) == state(first) == state(first.insert(c).delete(b).delete(c).insert(b))
    # Filters follow: what is frequent only after the debt is paid is dropped then.
    paid = owed.insert(c).insert(b)
    want = {k: v[2] for k, v in dropped(rows + more, 3).items()}
    assert {r.doc_id: r.text for r in paid.drop_lines(docs.union(c)).collect()} == want
    assert {r.doc_id: r.text for r in paid.drop_lines(docs.union(c), 0, 0).collect()} == want


def test_cuckoo_filter():
    from tidepanel.llm.line_dedup import CuckooFilter

    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    f = CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01


def tokens_of(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {r[0]: [*e.ids, 2] for r, e in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}


ODD = [
    "it's DON'T 'tis ''s x'll'd 12 3a4 a%%%b ***", "ÀÉÎ ß ª º µ ÿ Ÿ İstanbul ﬁ Ǆ", "<|endoftext|> a<|startoftext|>b <|", "é ño   x y　z \x85q \x1cfoo", "日本語 한국어 русский עברית 😀👍🏽", "a‍b ﻿", "½ ² ٣ Ⅷ", "  lead\n\n\ttrail  ", "İ'S ſ's K",
]


def test_encoding_of_slices():
    import pyarrow as pa
    import public_tokenizers

    from tidepanel.llm.shared import text_slices
    from tidepanel.llm.token_store import encoder_of

    rows = corpus() + [(7000 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    want = tokens_of(rows)
    enc = encoder_of(public_tokenizers.path("word_bpe_49k.json"))
    for limit in (50, 3000, 10**9):
        for start, texts in text_slices(pa.array([r[1] for r in rows], pa.string()).slice(2), limit):
            ids, first = enc.encode_texts(texts)
            for r, a, b in zip(rows[2 + start :], first, first[1:]):
                assert ids[a:b].tolist() == want[r[0]]


def test_store_round_trip(spark):
    import public_tokenizers

    from tidepanel.llm.token_store import document_checks, read_documents, store_root, write_store

    rows = corpus() + [(7000 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    want = tokens_of(rows)
    docs = frame(spark, rows)
    path = write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in read_documents(spark, path).collect()} == want
    at = 0
    got = {r.doc_id: r for r in document_checks(spark, path).collect()}
    assert len(got) == len(rows)
    for doc in sorted(want):
        ids = np.array(want[doc], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    again = write_store(docs.repartition(5), public_tokenizers.path("word_bpe_49k.json"))
    assert store_root(spark, again) == store_root(spark, path)


def test_store_empty_and_repeated_rows(spark):
    import public_tokenizers

    from tidepanel.llm.token_store import document_checks, write_store

    path = public_tokenizers.path("word_bpe_49k.json")
    assert document_checks(spark, write_store(frame(spark, [], SCHEMA), path)).count() == 0
    twice = [(1, "a b", "en", "a", 3), (1, "a b", "en", "a", 3), (None, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.start, r.n_tokens) for r in document_checks(spark, write_store(frame(spark, twice), path)).collect())
    assert got == [(0, 0, 1), (1, 1, 3), (1, 4, 3)]


def test_crc_combination():
    from tidepanel.llm.token_store import combined_crc32

    data = bytes(range(256)) * 9
    cut = [0, 4, 400, 1000, 1000, len(data)]
    assert combined_crc32([(zlib.crc32(data[a:b]), b - a) for a, b in zip(cut, cut[1:])]) == zlib.crc32(data)


def test_sharding(spark):
    from tidepanel.llm.ring_shards import assign, sharded

    rows = corpus(groups=300) + [(9000 + i, "one large group of equal texts " * 3, "en", "a", 1) for i in range(400)]
    text = {r[0]: (r[1] or "").encode() for r in rows}
    got = sharded(frame(spark, rows), shards=6).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 6
    assert max(load.values()) <= 1.05 * mean
    small = defaultdict(set)
    for r in got:
        if r.doc_id < 9000:
            small[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in small.values())
    docs = frame(spark, rows)
    placed = {r.doc_id: r.shard for r in assign(docs, 6).collect()}
    assert placed == {r.doc_id: r.shard for r in got}
    assert sharded(frame(spark, [], SCHEMA)).count() == 0
    clash = assign(docs.withColumn("shard", F.lit("own")).withColumn("cell", F.lit(1)).withColumn("a.b", F.lit(1)), 6)
    assert clash.columns == [*docs.columns, "cell", "a.b", "shard"] and {r.doc_id: r.shard for r in clash.collect()} == placed


def test_scratch_tables_go(spark):
    from tidepanel.llm.decontam import remove_contaminated
    from tidepanel.llm.jaccard_join import keep_one_per_component
    from tidepanel.llm.shared import forget, scratch_root, scratch_scope, stored

    folder = scratch_root(spark).removeprefix("file:")
    docs = frame(spark, corpus(groups=8))
    before = set(os.listdir(folder))
    kept = keep_one_per_component(docs)
    assert kept.count() > 0 and {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"jaccard-dropped"}
    before = set(os.listdir(folder))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert remove_contaminated(docs, bench).count() > 0 and {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"hits"}
    before, keep = set(os.listdir(folder)), []
    with scratch_scope(spark, keep):
        stored(docs, "one")
        keep.append(stored(docs, "two"))
    assert keep[0].count() == docs.count() and len(set(os.listdir(folder)) - before) == 1
    forget(*keep)
    assert set(os.listdir(folder)) == before


def test_scopes_inside_scopes(spark):
    from tidepanel.llm.shared import _scopes, forget, scratch_root, scratch_scope, stored

    folder = scratch_root(spark).removeprefix("file:")
    docs, before = frame(spark, corpus(groups=2)), set(os.listdir(folder))
    outer, inner = [], []
    with scratch_scope(spark, outer):
        with scratch_scope(spark, inner):
            stored(docs, "lost")
            inner.append(stored(docs, "within"))
        outer.append(stored(inner[0], "without"))
    assert not _scopes and {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"without"}
    forget(*outer)
    assert set(os.listdir(folder)) == before


def test_ring_moves_little():
    from tidepanel.llm.ring_shards import place_cells

    rng = np.random.default_rng(4)
    loads = {int(c): int(x) for c, x in enumerate(rng.integers(50, 150, 1 << 16))}
    a, b = place_cells(loads, 24), place_cells(loads, 25)
    by = np.zeros(24)
    for c, s in a.items():
        by[s] += loads[c]
    assert by.max() / by.mean() < 1.003 and by.min() / by.mean() > 0.95
    moved = sum(loads[c] for c in loads if a[c] != b[c]) / sum(loads.values())
    assert moved < 0.35, moved


def fair_targets(sizes, weights, most):
    got = {s: 0.0 for s in sizes}
    live, left = set(sizes), float(sum(sizes.values()))
    while live:
        rate = left / sum(weights[s] for s in live)
        full = {s for s in live if rate * weights[s] > most * sizes[s]}
        if not full:
            got.update({s: rate * weights[s] for s in live})
            break
        for s in full:
            got[s] = most * sizes[s]
            left -= got[s]
        live -= full
    return got


def test_mixing(spark):
    from tidepanel.llm.mixing import mix, mix_report
    from tests.llm.common import blank_words

    rows = corpus(groups=250) + [(8000, "   ", "en", "empty source", 1)]
    size = {r[0]: len(blank_words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    want = fair_targets(total, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    docs = frame(spark, rows)
    got = mix_report(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r.taken
    for s in names:
        times = {r.doc_id: r.copies for r in got if r.size and source[r.doc_id] == s}
        left = [size[d] for d, n in times.items() if n < 3]
        assert abs(taken[s] - want[s]) <= max(min(left, default=0), 0.01 * want[s]), (s, taken[s], want[s])
    mixed = mix(docs, shards=4).collect()
    copies = Counter(r.doc_id for r in mixed)
    assert {r.doc_id: r.copies for r in got if r.copies} == dict(copies)
    assert {r.mix_shard for r in mixed} == {0, 1, 2, 3}
    again = mix(docs.repartition(7), shards=4).collect()
    assert sorted(tuple(map(str, r)) for r in again) == sorted(tuple(map(str, r)) for r in mixed)
    assert mix_report(frame(spark, [], SCHEMA)).count() == 0
    assert mix(frame(spark, [], SCHEMA)).count() == 0
    named = mix(docs.withColumn("mix_shard", F.lit("own")).withColumn("key", F.lit(1)), shards=4)
    assert named.columns == [*docs.columns, "key", "mix_shard", "mix_order"] and {r.mix_shard for r in named.collect()} == {0, 1, 2, 3}
    same = mix(docs.withColumn("mix_shard", F.lit("own")).withColumn("dealt.x", F.lit(1)), shards=4, keep_plan_columns=False)
    assert same.columns == [*docs.columns, "mix_shard", "dealt.x"] and same.count() == len(mixed)


def test_what_is_taken_comes_from_the_dealt_blocks(spark):
    from tidepanel.llm.mixing import mix_report, plan_mix, mix_rows

    docs = frame(spark, corpus(groups=60))
    plan = plan_mix(docs, shards=5)
    rows = {r.doc_id: r for r in mix_rows(docs).collect()}
    assert len({r.u for r in rows.values()}) == len(rows)
    dealt = defaultdict(list)
    for r in plan.deal.collect():
        dealt[r.key, r.block] += r.dealt
    want = {d: sum(r.u <= c.last_u or r.u in c.extra for c in dealt[r.key, r.u >> 53]) * r.size for d, r in rows.items()}
    assert {r.doc_id: r.taken for r in mix_report(docs, shards=5).collect()} == want
    # All shards hold the same number of blocks, but for rounding at the nodes.
    loads = Counter(c.mix_shard for copies in dealt.values() for c in copies)
    assert set(loads) == set(range(5)) and max(loads.values()) - min(loads.values()) <= 3
    text = mix_report(docs, shards=5)._jdf.queryExecution().toString()
    assert "mix-deal" in text


def test_hypergeometric_draws(spark):
    from fractions import Fraction
    from math import comb

    from tidepanel.llm.mixing import hypergeometric, tree_quotas

    rng = np.random.default_rng(6)
    rows = [(g := int(rng.integers(0, 40)), b := int(rng.integers(0, 40)), int(rng.integers(0, g + b + 1)), float(rng.random())) for _ in range(300)]
    rows += [(0, 5, 3, 0.5), (5, 0, 3, 0.5), (3, 3, 0, 0.9), (3, 3, 6, 0.0), (1500, 1500, 1500, 0.5), (3000, 10, 1000, 0.3)]
    got = spark.createDataFrame(rows, "good long, bad long, n long, u double").select("*", hypergeometric(*[F.col(c) for c in ("good", "bad", "n", "u")]).alias("x")).collect()
    for r in got:
        upto, whole = 0, comb(r.good + r.bad, r.n)
        for x in range(max(0, r.n - r.bad), min(r.n, r.good) + 1):
            upto += comb(r.good, x) * comb(r.bad, r.n - x)
            if Fraction(upto, whole) >= Fraction(r.u):
                break
        assert r.x == x, r
    quotas = {"a": 700, "b": 1, "c": 90, "d": 0, "e": 2048}
    table = spark.createDataFrame(list(quotas.items()), "key string, n long")
    shares = tree_quotas(table, 6, 3).collect()
    assert len(shares) == 30 and all(r.n >= 0 for r in shares)
    for k, n in quotas.items():
        assert sum(r.n for r in shares if r.key == k) == n
    loads = [sum(r.n for r in shares if r.mix_shard == s) for s in range(6)]
    assert max(loads) - min(loads) <= 3
    # The draws spread as drawing blocks without replacement does: the mean of many seeds.
    means = np.mean([[r.n for r in tree_quotas(table, 2, s).filter("key = 'a'").collect() if r.mix_shard == 0] for s in range(40)])
    assert abs(means - 350) < 6


def test_any_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidepanel.llm.token_store import document_checks, read_documents, word_pattern, write_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert word_pattern(path) is None and word_pattern(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Hello World, it's FINE", "en", "a", 1), (2, None, "en", "a", 1), *corpus(groups=6)[2:]]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    whole = Tokenizer.from_file(path)
    want = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 50256] for r in rows}
    store = write_store(frame(spark, rows), path, end_id=50256)
    assert want[0][:3] == [15496, 2159, 11]
    assert {r.doc_id: r.ids for r in read_documents(spark, store).collect()} == want
    assert {r.doc_id: r.ids_crc32 for r in document_checks(spark, store).collect()} == {d: zlib.crc32(np.array(x, "<u4").tobytes()) for d, x in want.items()}


def test_chunks_depend_on_their_document_alone():
    from tidepanel.llm.token_store import LEAST_IDS, MOST_IDS, chunk_ends

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (1, 64, 65, 3000, 5, 20_000)] + [np.zeros(9000, np.uint32)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = chunk_ends(np.concatenate(docs), first)
    for d, at, ends in zip(docs, first, got):
        assert [e - at for e in ends] == chunk_ends(d, np.array([0, len(d)]))[0]
        sizes = np.diff(ends, prepend=at)
        assert ends[-1] == at + len(d) and sizes.max() <= MOST_IDS and (len(sizes) == 1 or sizes[:-1].min() >= LEAST_IDS)
    assert len(got[5]) > 40 and len(got[6]) == 5


def test_a_spoiled_store_is_found(spark):
    import public_tokenizers
    from tidepanel.llm.token_store import document_checks, write_store

    store = write_store(frame(spark, corpus(groups=5)), public_tokenizers.path("word_bpe_49k.json"))
    chunks = spark.read.parquet(f"{store}/chunks")
    chunks.withColumn("packed", F.when(F.col("size") == 1, F.unhex(F.lit("0300"))).otherwise(F.col("packed"))).write.parquet(f"{store}/spoiled")
    from tidepanel.llm.shared import remove_path

    remove_path(spark, f"{store}/chunks")
    spark.read.parquet(f"{store}/spoiled").write.parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="does not have the content of its address"):
        document_checks(spark, store).collect()


def taken_by_hand(rows, target, passes):
    """Copies by u that one source gives of ``rows`` (size, u): whole passes, the
    prefix in the order of u that fits, the longest behind it that fit, the shortest
    if that is nearer; more than 1 % off, the longest that fit once more, and so on."""
    copies = Counter({u: passes for _, u in rows})
    missing = target - passes * sum(s for s, _ in rows)
    order = sorted(rows, key=lambda r: r[1])
    while order and order[0][0] <= missing:
        missing -= order[0][0]
        copies[order.pop(0)[1]] += 1

    def longest(behind, missing):
        left = []
        for s, u in sorted((r for r in behind if r[0]), key=lambda r: (-r[0], r[1])):
            if s <= missing:
                missing -= s
                copies[u] += 1
            else:
                left.append((s, u))
        return missing, left

    if missing <= 0 or not order:
        return copies
    missing, behind = longest(order, missing)
    rest = [behind]
    least = min((s for s, _ in behind), default=None)
    if min(missing, missing if least is None else least - missing) > 0.01 * target:
        for level in range(1, 3 - passes):
            missing, left = longest(rows, missing)
            rest.append(left)
    ends = [(s, level, u) for level, left in enumerate(rest) for s, u in left]
    if ends and min(ends)[0] - missing < missing:
        copies[min(ends)[2]] += 1
    return copies


@pytest.mark.parametrize("seed", [1])
def test_mix_of_skewed_sizes_against_brute_force(spark, seed):
    """A huge document, null ids and repeated ids: targets are met all the same."""
    import random

    from tidepanel.llm.mixing import mix, mix_report, mix_rows, plan_mix

    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 50, 400]), "en", s, None) for i, s in enumerate(rng.choices(["a", "b", "c", None], k=300))]
    rows += [(2000 + i, "w " * n, "en", "e", None) for i, n in enumerate([40_000, 30_000, 700, 900, 1000, 3, 1])]
    rows += [(1000, "w " * 9000, "en", "a", None), (1001, "w " * 5000, "en", "c", None)]
    rows += [(None, "same words in every row", "en", "b", None)] * 200 + [(7, "four words of seven", "en", "d", i) for i in range(150)] + [(None, f"own {i} x", "en", "d", i) for i in range(100)]
    docs = frame(spark, rows)
    found = mix_rows(docs).collect()
    assert len(found) == len(rows) and len({r.u for r in found}) == len(rows)
    plan = plan_mix(docs)
    goals = {r.key: r for r in plan.sources.collect()}
    dealt = defaultdict(list)
    for r in plan.deal.collect():
        dealt[r.key, r.block] += r.dealt
    for key, goal in goals.items():
        own = [(r.size, r.u) for r in found if r.key == key]
        passes = min(3, int(goal.target / goal.source_size + 1e-12))
        copies = taken_by_hand(own, goal.target, passes)
        want = {u: copies[u] for s, u in own if s}
        got = {u: sum(u <= c.last_u or u in c.extra for c in dealt[key, u >> 53]) for s, u in own if s}
        assert got == want, key
        words = sum(s * got.get(u, 0) for s, u in own)
        left = [s for s, u in own if s and got[u] < 3]
        assert abs(words - goal.target) <= max(min(left, default=0), 0.01 * goal.target) + 1e-6
    report = mix_report(docs).collect()
    assert len(report) == len(rows) and max(r.copies for r in report) <= 3
    mixed = mix(docs.withColumn("copy", F.lit("own")).withColumn("mark", F.lit(1)), keep_plan_columns=False)
    assert mixed.columns == [*docs.columns, "copy", "mark"]
    out = mixed.collect()
    assert len(out) == sum(r.copies for r in report)
    # Rows that differ in another column only are taken up to three times each.
    assert max(Counter(tuple(r) for r in out if r.source == "d").values()) <= 3
    again = mix(docs.repartition(5), keep_plan_columns=False).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in again) == Counter((r.doc_id, r.text, r.source) for r in out)
