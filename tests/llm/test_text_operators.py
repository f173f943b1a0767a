import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import SCHEMA, alnum_words, blank_words, corpus, frame


@pytest.mark.parametrize("limit", [400_000, 0])
def test_contamination_against_brute_force(spark, limit):
    from tidepanel.llm.decontam import contamination

    rows = corpus()
    items = [(1, " ".join(alnum_words(rows[5][1])[:40])), (2, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 P10"), (3, "w1 W2"), (4, None), (5, "!!"), (6, "w1, w2"), (None, "z z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in contamination(frame(spark, rows).withColumn("h", F.lit(1)).withColumn("p", F.lit(2)), bench, broadcast_windows=limit).collect()}
    want = {}
    for r in rows:
        w, hit, found = alnum_words(r[1]), set(), set()
        for item, text in items:
            b = alnum_words(text)
            k = min(10, len(b))
            windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add("null" if item is None else str(item))
        want[r[0]] = (len(w), len(hit), sorted(found))
    assert got == want
    assert any(v[1] for v in want.values())


def test_remove_contaminated(spark):
    from tidepanel.llm.decontam import remove_contaminated

    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"Keep this. {passage}! And this.", "en", "a", 1), (2, "clean text", "en", "a", 1), (3, None, "en", "a", 1), (None, passage, "en", "a", 1)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = frame(spark, rows)
    kept = remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    cut = {r.doc_id: r.text for r in remove_contaminated(docs, bench, mode="spans").collect()}
    assert cut == {1: "Keep this. And this.", 2: "clean text", 3: None, None: ""}
    assert remove_contaminated(frame(spark, [], SCHEMA), bench).count() == 0
    assert remove_contaminated(docs, bench.limit(0)).count() == 4


def test_shuffled_windows_leave_the_words_behind(spark):
    from tidepanel.llm.decontam import contamination

    bench = spark.createDataFrame([(1, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 P10")], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = contamination(frame(spark, corpus(groups=5)), bench, broadcast_windows=0)._jdf.queryExecution().executedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(plan) if "hashpartitioning(dh#" in line)
    sent = next(line for line in plan[at:] if "Project [" in line)
    assert "row#" in sent and " w#" not in sent and "[w#" not in sent


@pytest.mark.parametrize("limit", [400_000, 0])
def test_rows_are_judged_by_their_own_text(spark, limit, monkeypatch):
    """Rows that share an id, or have none, keep clean text; equal rows go alike."""
    from tidepanel.llm import decontam

    whole = decontam.contamination
    monkeypatch.setattr(decontam, "contamination", lambda d, b, n: whole(d, b, n, broadcast_windows=limit))
    bad = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, bad), (2, "Short item")], "item_id long, text string")
    clean = "clean words one two three four five six seven eight nine eleven twelve thirteen"
    rows = [
        (1, clean, "en", "a", 1),
        (1, f"before, {bad.upper()}! after; {bad}. short item end", "en", "a", 1),
        (None, clean, "en", "b", 2),
        (None, f"{bad} eleven", "en", "b", 2),
        (None, f"{bad} eleven", "fr", "b", 3),
        (None, None, "en", None, 4),
        (5, "", "en", "b", 5),
        (6, f"x {bad} one two", "en", "b", 5),
        (7, f"{bad} {bad}", "en", "b", 5),
        (8, ". short, item.", "en", "b", 5),
    ]
    docs = frame(spark, rows).withColumn("mark", F.lit("own")).withColumn("hit_a", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("spans", F.lit(3))
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text, r.mark, r.hit_a, r.doc, r.spans) for r in kept.collect()))) == sorted(str((*rows[i][:2], "own", 1, 2, 3)) for i in (0, 2, 5, 6))
    cut = decontam.remove_contaminated(docs, bench, mode="spans")
    assert cut.columns == docs.columns
    want = [clean, "before, after; end", clean, "eleven", "eleven", None, "", "x one two", "", ". "]
    assert sorted(map(str, ((r.doc_id, r.text) for r in cut.collect()))) == sorted(str((r[0], t)) for r, t in zip(rows, want))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 13])
def test_window_hashes_of_any_length(spark, n):
    """Each window length, items shorter than it, and repeated document rows."""
    from tidepanel.llm.decontam import contamination

    rng = random.Random(n)
    text = lambda k: " ".join(rng.choice("abcd") for _ in range(k))
    rows = [(i, text(rng.randrange(0, 40)), "en", "a", 1) for i in range(60)]
    rows += rows[:5]
    items = [(i, text(rng.randrange(0, 2 * n + 1))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in contamination(frame(spark, rows), bench, n).collect())

    def brute(words):
        hit, found = set(), set()
        for i, t in items:
            w = alnum_words(t)
            k = min(n, len(w))
            for at in range(len(w) - k + 1 if k else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[at : at + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        return len(hit), tuple(sorted(found))

    assert got == sorted((r[0], *brute(alnum_words(r[1]))) for r in rows)


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_removal_with_clashing_columns(spark, mode):
    from tidepanel.llm.decontam import remove_contaminated

    passage = " ".join(f"q{i}" for i in range(12))
    docs = frame(spark, [(1, f"Keep. {passage}! End.", "en", "a", 1), (2, "clean", "en", "a", 1)])
    for name in ("hit_id", "hit_words", "row", "w", "doc", "cut", "a.b"):
        docs = docs.withColumn(name, F.lit("own"))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = remove_contaminated(docs, bench, mode=mode)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(rows) == ({2} if mode == "documents" else {1, 2})
    assert all(r[c] == "own" for r in rows.values() for c in ("hit_id", "hit_words", "row", "a.b"))


def jaccard_brute(rows, k, percent):
    sets = {}
    for r in rows:
        w = blank_words(r[1])
        sets[r[0]] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                r, s = find(ids[x]), find(ids[y])
                parent[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent,block,shingles", [(4, 85, 4096, 10**6), (5, 80, 4096, 100), (4, 85, 3, 10**6)])
def test_jaccard_join_against_brute_force(spark, k, percent, block, shingles):
    from tidepanel.llm.jaccard_join import jaccard_components

    rows = corpus(seed=k + block, groups=50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), k, percent, block_docs=block, block_shingles=shingles).collect()}
    assert got == jaccard_brute(rows, k, percent)


def test_jaccard_texts_are_sent_in_rounds(spark, monkeypatch):
    """No round sends far more than half the corpus, and its shuffle files go."""
    from tidepanel.llm import jaccard_join

    rows, sizes, released = corpus(seed=9, groups=50), [], []
    docs = frame(spark, rows)
    search = jaccard_join._search_blocks

    def counted(df, label):
        out = stored(df, label)
        if label == "jaccard-tasks":
            sizes.append(out.agg(F.sum("shingles")).first()[0])
        return out

    stored = jaccard_join.stored
    searches = []
    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "_search_blocks", lambda *a: searches.append(a) or search(*a))
    monkeypatch.setattr(jaccard_join, "release", lambda s: released.append(s))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, 70, block_docs=4, round_shingles=1).collect()}
    brute = jaccard_brute(rows, 4, 70)
    assert got == brute
    half = sum(n for n, _ in brute.values()) // 2
    assert len(searches) >= sum(-(-n // half) for n in sizes) > len(sizes) and len(released) > len(searches)


def test_jaccard_join_odd_rows(spark):
    from tidepanel.llm.jaccard_join import jaccard_components, keep_one_per_component

    rows = [(1, "a b c d e", "en", "a", 1)] * 3 + [(2, "A B C D E", "en", "a", 1), (None, "a b c d e", None, None, None), (3, None, "en", "a", 1)]
    docs = frame(spark, rows).withColumn("task", F.lit(1)).withColumn("root", F.lit(2))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 1, 3]
    assert jaccard_components(frame(spark, [], SCHEMA)).count() == 0


@pytest.mark.parametrize("block,broadcast", [(4096, 1_000_000), (4, 0)])
def test_jaccard_join_of_repeated_ids(spark, block, broadcast):
    from tidepanel.llm.jaccard_join import jaccard_components

    text = lambda *words: " ".join(f"u{w}" for w in words)
    # Id 1 has two texts; the second is near that of id 2. Id 5 joins those of ids 3 and 4.
    rows = [(1, text(*range(50, 70)), "en", "a", 1), (1, text(*range(20)), "en", "a", 1), (2, text(*range(19), 99), "en", "a", 1)]
    rows += [(3, text(*range(100, 120)), "en", "a", 1), (4, text(*range(200, 220)), "en", "a", 1), (5, text(*range(100, 120)), "en", "a", 1), (5, text(*range(200, 220)), "en", "a", 1), (6, text(*range(300, 320)), "en", "a", 1)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(frame(spark, rows), 4, 70, block_docs=block, broadcast_rows=broadcast).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (5, 3), (6, 6)]


def test_meeting_edges_lose_no_link():
    from tidepanel.llm.jaccard_join import meeting_edges
    from tidepanel.llm.shared import contract_edges

    rng = np.random.default_rng(8)
    sig, before, ids, stars = [], [], [], []
    groups = {}
    for doc in range(400):
        last = 0
        for place in range(rng.integers(1, 12)):
            now = (place + 1) * 1000 + int(rng.integers(0, 3 if doc % 2 else 300))
            sig.append(now), before.append(last), ids.append(doc)
            groups.setdefault(now, []).append(doc)
            last = now
    stars = [(d, g[0]) for g in groups.values() for d in g[1:]]
    a, b = meeting_edges(np.array(sig, np.uint64), np.array(before, np.uint64), np.array(ids))
    assert len(a) < 0.7 * len(stars)
    whole = lambda x, y: sorted(zip(*(v.tolist() for v in contract_edges(x, y))))
    assert whole(a, b) == whole(*np.array(stars).T)
    # Copies: one edge each, however many signatures they have.
    a, _ = meeting_edges(np.tile(np.arange(1, 31), 50).astype(np.uint64), np.tile(np.arange(30), 50).astype(np.uint64), np.repeat(np.arange(50), 30))
    assert len(a) == 49


def test_jaccard_edges_do_not_follow_the_partitions(spark):
    from tidepanel.llm.jaccard_join import LEAST_BUCKETS, _FOUND_DDL, _PACKED_DDL, _describe, _meet

    rng = np.random.default_rng(9)
    base = [f"v{j}" for j in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 300, i % 3):
            words[at] = f"n{rng.integers(1000)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    packed = frame(spark, rows, parts=6).select("doc_id", "text").mapInArrow(_describe(5, 80, LEAST_BUCKETS.bit_length() - 1, spark.sparkContext.broadcast(None)), _PACKED_DDL)
    edges = [packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _FOUND_DDL).filter("kind = 1").count() for n in (4, 32)]
    assert edges[1] <= 1.6 * edges[0] and edges[1] <= 3 * len(rows), edges


def test_components(spark):
    from tidepanel.llm.shared import components

    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    for i in range(60):
        assert got.get(i, i) == i // 10 * 10
    for i in range(101, 160):
        assert got[i] == 100


def test_near_duplicate_vectors(spark):
    from tidepanel.llm.embed_dedup import near_duplicates

    rng = np.random.default_rng(0)
    rows, i = [], 0
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.06, 0.1])
            rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 2.0])], int(rng.choice([0, 0, 0, 1]))))
            i += 1
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [None] + [1.0] * 15, 0), (906, rows[0][1], None), (907, [1.0, 0.0], 0), (908, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    x = {r[0]: np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows + odd[-2:]}
    label = {r[0]: r[2] for r in rows + odd}
    links = {a: [b for b in x if b != a and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.98] for a in x}
    comp = {a: a for a in label}
    for _ in range(50):
        for a in links:
            comp[a] = min([comp[a], *[comp[b] for b in links[a]]])
    want = {a: (len(links.get(a, [])), comp[a], comp[a] == a) for a in label}
    for options in ({}, {"cell_rows": 10}, {"cell_rows": 10, "chunk_rows": 4}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()}
        assert got == want, options
    assert near_duplicates(df.limit(0)).count() == 0


WORDS = {"en": "the and of with this that house river stone", "fr": "le les des avec cette maison rivière être où", "de": "der die und mit diese haus fluss über schön"}


def talk(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split(), n))


def test_language_id(spark):
    from tidepanel.llm.langid import codewords, identify, learn

    rng = np.random.default_rng(1)
    rows = [(i, talk(rng, l := ["en", "fr", "de"][i % 3], int(rng.integers(3, 60))), l, "s", 1) for i in range(300)]
    rows += [(1000, None, "en", "s", 1), (1001, "123 !!", "en", "s", 1), (1002, "", None, None, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in identify(docs, learn(docs)).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [d for d in got if d < 1000 and got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(frame(spark, [], SCHEMA), learn(frame(spark, [], SCHEMA))).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    for k in (2, 5, 12):
        c = codewords(k)
        assert len({tuple(r) for r in c}) == k and not (np.abs(c.sum(0)) == k).any()


def test_long_texts_and_rare_languages_are_learned(spark):
    from tidepanel.llm.langid import identify, learn

    rng = np.random.default_rng(5)
    # French stands in long texts only, and German in two documents.
    rows = [(i, talk(rng, "fr" if i % 2 else "en", 5000 if i % 2 else 40), "fr" if i % 2 else "en", "s", 1) for i in range(80)]
    rows += [(200 + i, talk(rng, "de", 60), "de", "s", 1) for i in range(2)]
    assert min(len(r[1]) for r in rows if r[2] == "fr") > 20_000
    docs = frame(spark, rows).withColumn("label", F.lit("x")).withColumn("rate", F.lit(0))
    model = learn(docs, sample_docs=40)
    assert model.languages == ["de", "en", "fr"]
    tests = frame(spark, [(k, talk(rng, x, 30), x, "s", 1) for k, x in enumerate(["en", "fr", "de"] * 10)])
    assert all(r.lang_pred == ["en", "fr", "de"][r.doc_id % 3] for r in identify(tests, model).collect())


def test_language_codes_against_brute_force(spark):
    """Counts, classifiers, losses and decoding, computed one text and bit at a time."""
    import math

    import pyarrow as pa

    from tidepanel.llm.grams import LETTER_TABLE, Scan
    from tidepanel.llm.langid import BUCKETS, LanguageModel, codewords, gram_counts, learn

    rng = np.random.default_rng(7)
    rows = [(i, talk(rng, ["de", "en", "fr"][i % 3], 25), ["de", "en", "fr"][i % 3], "s", 1) for i in range(60)]
    model = learn(frame(spark, rows))
    buckets = lambda text: [int(b) for _, own in gram_counts(Scan(pa.array([text]), LETTER_TABLE)) for b in own]
    counts = [dict() for _ in range(3)]
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for b in buckets(text):
                own = counts[["de", "en", "fr"].index(lang)]
                own[b] = own.get(b, 0) + 1
    share = lambda k, b: (counts[k].get(b, 0) + 0.5) / (sum(counts[k].values()) + 0.5 * BUCKETS)

    def weight(b, bit):
        one = [k for k in range(3) if model.code[k, bit] > 0]
        zero = [k for k in range(3) if model.code[k, bit] < 0]
        return math.log(sum(share(k, b) for k in one) / len(one)) - math.log(sum(share(k, b) for k in zero) / len(zero))

    for text in (rows[0][1], rows[1][1], "the river der fluss", "xyz"):
        own = buckets(text)
        outputs = [sum(weight(b, j) for b in own) / max(len(own), 1) for j in range(model.code.shape[1])]
        loss = [sum(model.trust[j] * math.log1p(math.exp(-model.scale * model.code[k, j] * outputs[j])) for j in range(len(outputs))) for k in range(3)]
        soft = [math.exp(min(loss) - x) for x in loss]
        pred, score, lead = model.predict(pa.array([text]))
        assert pred[0] == loss.index(min(loss)) and score[0] == pytest.approx(max(soft) / sum(soft), rel=1e-4)
        assert lead[0] == pytest.approx((sorted(soft)[-1] - sorted(soft)[-2]) / sum(soft), abs=1e-4)
    # A single wrong bit does not change the decoded language where codewords are far apart.
    code = codewords(12)
    m = LanguageModel([str(k) for k in range(12)], code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]), 4.0)
    for k in range(12):
        flipped = np.where(np.arange(code.shape[1]) == k, -code[k], code[k])
        assert m.losses(flipped[None]).argmin() == k


def test_license_scan(spark):
    from tidepanel.llm.license_scan import PHRASES, TEMPLATES, Scanner, scan_licenses

    apache = TEMPLATES[0][1].title().replace(" ", ", ", 3)
    rows = [(1, "x MIT-License y mit license", "en", "a", 1), (2, f"intro {apache} end", "en", "a", 1), (3, None, "en", "a", 1), (4, "the license of the software", "en", "a", 1), (5, "CC\nBY cc by by cc", "en", "a", 1), (6, "gnu general public licence gnu general public license", "en", "a", 1)]
    rows += corpus(groups=10)[:-5]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    for r in rows:
        w, places, labels = alnum_words(r[1]), [], set()
        for p, label in PHRASES.items():
            p = p.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        g = got[r[0]]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1
    assert "apache" in got[1].labels and max(s.share for s in got[1].spans) > 0.9
    assert got[3].labels == ""
    # Matching statistics against brute force.
    rng = np.random.default_rng(0)
    s = Scanner(TEMPLATES, PHRASES)
    texts = [t.split() for _, t in TEMPLATES] + [p.split() for p in PHRASES]
    vocab = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(vocab)}
    text = [w for _ in range(60) for w in (texts[rng.integers(len(texts))][int(rng.integers(5)) :][: int(rng.integers(1, 9))])]
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for at, (_, size) in enumerate(s.automaton.stream([number[w] for w in text])):
        best = max((n for n in range(1, at + 2) if tuple(text[at + 1 - n : at + 1]) in inside), default=0)
        assert size == best


def test_license_scan_finds_every_notice(spark):
    from tidepanel.llm.license_scan import TEMPLATES, scan_licenses

    bsd, size = TEMPLATES[8][1], len(TEMPLATES[8][1].split())
    rows = [(1, f"{bsd} " * 1000, "en", "a", 1), (2, f"{bsd} {'other ' * 500}{bsd}", "en", "a", 1), (3, bsd, "en", "a", 1)]
    got = {r.doc_id: [(s.label, s.first, s.last, s.share) for s in r.spans] for r in scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == [("bsd", i * size, (i + 1) * size - 1, 1.0) for i in range(1000)]
    assert got[2] == [("bsd", 0, size - 1, 1.0), ("bsd", size + 500, 2 * size + 499, 1.0)] and got[3] == [("bsd", 0, size - 1, 1.0)]


def test_toxicity(spark):
    from tidepanel.llm.toxicity import fit_nnpu, keep_clean, learn, score

    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = talk(rng, ["en", "fr"][i % 2], int(rng.integers(20, 80))).split() + (["scumbag", "idiotic"] if toxic else [])
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1)]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels + [(5, 1, None), (77777, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = learn(docs, lab)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([got[i].predicted == int(i % 6 == 0) for i in range(600) if got[i].held_out]) > 0.97
    clean = keep_clean(docs.withColumn("score", F.lit(1)), model)
    assert clean.columns == [*docs.columns, "score"] and {r.doc_id for r in clean.collect()} == {d for d, r in got.items() if not r.predicted}
    nothing = learn(docs, lab.limit(0))
    assert {r.score for r in score(docs, nothing).collect()} == {0.0}
    assert score(frame(spark, [], SCHEMA), model).count() == 0
    # The risk never rewards calling everything negative below zero.
    w, b = fit_nnpu(np.ones((20, 1), np.float32), np.r_[np.ones((20, 1)), np.zeros((80, 1))].astype(np.float32), 0.2)
    assert w[0] + b > 0 > b


def test_risk_and_gradient_against_brute_force():
    """One step of the learner against the risk itself and finite differences."""
    from tidepanel.llm.toxicity import fit_nnpu

    rng = np.random.default_rng(3)
    xp, xu, prior = rng.integers(0, 2, (30, 4)).astype(float), rng.integers(0, 2, (90, 4)).astype(float), 0.3

    def parts(w):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        plus = prior * np.mean([np.log1p(np.exp(-z)) for z in zp])
        minus = np.mean([np.log1p(np.exp(z)) for z in zu]) - prior * np.mean([np.log1p(np.exp(z)) for z in zp])
        return plus, minus

    def gradient(f, w, h=1e-6):
        return np.array([(f(w + h * e) - f(w - h * e)) / (2 * h) for e in np.eye(len(w))])

    def brute(rounds, rate=0.05, l2=1e-4):
        w = np.append(np.zeros(4), -1.0)
        m, v = np.zeros(5), np.zeros(5)
        for t in range(1, rounds + 1):
            # The non-negative estimate: where the negative risk is below zero, step up it.
            g = gradient(lambda x: sum(parts(x)), w) if parts(w)[1] >= 0 else gradient(lambda x: -parts(x)[1], w)
            g = g + np.append(l2 * w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    for rounds in (1, 5, 60):
        w, b = fit_nnpu(xp, xu, prior, rounds=rounds)
        assert np.allclose([*w, b], brute(rounds), atol=2e-3), rounds
    # With a prior that is too high the unbiased risk has no lower bound; this one stays at zero or more.
    xp, xu, prior = np.eye(4)[:2].repeat(20, 0), np.eye(4).repeat(20, 0), 0.9
    w, b = fit_nnpu(xp, xu, prior, rounds=600)
    assert parts(np.append(w, b))[1] > -0.05


def test_toxicity_of_long_texts(spark):
    import pyarrow as pa

    from tidepanel.llm.grams import Scan, word_buckets
    from tidepanel.llm.toxicity import BITS, BUCKETS, ToxicModel, learn, score

    # Twenty weak features, one in each stretch of text: length alone adds up to nothing.
    weak = [f"chance{c}" for c in "abcdefghijklmnopqrst"]
    slot = np.full(BUCKETS, -1, np.int16)
    slot[word_buckets(Scan(pa.array([" ".join(weak)])).words, BITS)] = np.arange(20)
    model = ToxicModel(slot, np.full(20, 0.4), -2.0)
    dull = "calm words " * 300
    long, dense, short = " ".join(f"{dull} {w}" for w in weak * 5), f"{dull * 30} {' '.join(weak)} {dull}", " ".join(weak)
    got = model.scores(pa.array([long, dense, short, weak[0], None, dull]))
    assert got[0] < got[3] < 0.5 < got[1] < got[2] and got[4] == got[5] == pytest.approx(1 / (1 + np.exp(2)))
    # Long documents are sampled: all positives are over 50,000 characters here.
    rng, rows, labels = np.random.default_rng(4), [], []
    for i in range(240):
        toxic = i % 4 == 0
        words = talk(rng, "en", 12_000 if toxic or i % 20 == 1 else 60).split()
        words[30:30] = ["scumbag", "idiotic"] if toxic else []
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    assert min(len(r[1]) for r in rows[::4]) > 50_000
    docs = frame(spark, rows)
    got = {r.doc_id: r.predicted for r in score(docs, learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert np.mean([got[i] == int(i % 4 == 0) for i in got]) > 0.97


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(groups=120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] % 9 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"p{j}" for j in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept, had = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
        assert kept <= had
        if name == "ngram_jaccard_join":
            comp = jaccard_brute([tuple(r) for r in before.collect()], 5, 80)
            assert kept == {d for d, (_, c) in comp.items() if d == c}
        if name == "benchmark_decontamination":
            assert not any("p5 p6 p7 p8 p9 p10 p11 p12 p13 p14" in " ".join(alnum_words(r.text)) for r in docs.collect())
        if name == "sharding":
            assert docs.columns == [*columns, "shard"] and docs.count() == before.count()


def test_jaccard_chains_are_split(spark, monkeypatch):
    """Passages of few documents, which a sample of a large corpus misses, chain all
    documents; their number of comparisons does not grow with the square."""
    from tidepanel.llm import jaccard_join

    rng = random.Random(8)
    passages = [[f"p{i}_{j}" for j in range(25)] for i in range(60)]
    rows = []
    for i in range(500):
        own = [f"o{i}_{j}" for j in range(60)]
        words = sum(rng.sample(passages, 3), []) + own
        rows.append((len(rows), " ".join(words), "en", "a", 1))
        if i % 50 == 0:
            rows.append((len(rows), " ".join([*words[:-1], "changed"]), "en", "a", 1))
    frequent, store, dealt = jaccard_join.frequent_shingles, jaccard_join.stored, []

    def missed(docs, k, n_docs, *more):
        return frequent(docs, k, n_docs, *more) if more else np.zeros(0, np.uint64)

    def counted(df, label):
        out = store(df, label)
        dealt.extend([out.count()] if label == "jaccard-tasks" else [])
        return out

    monkeypatch.setattr(jaccard_join, "frequent_shingles", missed)
    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = jaccard_join.jaccard_components(frame(spark, rows), 4, 85, block_docs=40, block_shingles=100_000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == jaccard_brute(rows, 4, 85) and len({c for _, c in got.values()}) == 500
    assert sum(dealt) <= 2 * len(rows), dealt


def test_jaccard_sketches_part_chains_and_no_link(spark, monkeypatch):
    """Long documents that share stray shingles are told apart by their sketches, without
    describing their texts again and again, and no linked pair is parted."""
    from tidepanel.llm import jaccard_join
    from tidepanel.llm.jaccard_join import near_sketches, segments_of, sketch

    rng, np_rng = random.Random(4), np.random.default_rng(4)
    seg, sets = segments_of(80), []
    for i in range(60):
        base = np_rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        for cut in (0, 30, 60, 100):
            new = np_rng.integers(0, 1 << 63, int(np_rng.integers(0, 40)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[cut:], new])))
    n = np.array([len(s) for s in sets])
    bits = np.array([sketch(s, 512) for s in sets])
    a, b = near_sketches(np.arange(len(sets)), n, bits, np.zeros(len(sets), bool), False, seg)
    root = dict(zip(a.tolist(), b.tolist()))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert root.get(i, i) == root.get(j, j)
            elif not both:
                assert root.get(i, i) != root.get(j, j)
    # Each document shares some stray words' passages with a few others.
    passages = [[f"p{i}_{j}" for j in range(8)] for i in range(40)]
    rows = []
    for i in range(150):
        words = [f"o{i}_{j}" for j in range(120)]
        for p in rng.sample(passages, 4):
            at = rng.randrange(len(words))
            words[at:at] = p
        rows.append((len(rows), " ".join(words), "en", "a", 1))
        if i % 30 == 0:
            rows.append((len(rows), " ".join([*words[:-2], "changed"]), "en", "a", 1))
    described = jaccard_join._described
    calls, dealt, store = [], [], jaccard_join.stored

    def counted(df, label):
        out = store(df, label)
        dealt.extend([out.count()] if label == "jaccard-tasks" else [])
        return out

    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: np.zeros(0, np.uint64))
    monkeypatch.setattr(jaccard_join, "_described", lambda *a: calls.append(a) or described(*a))
    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = jaccard_join.jaccard_components(frame(spark, rows), 4, 85, block_docs=5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_brute(rows, 4, 85)
    assert len(calls) == 1 and sum(dealt) <= 30, (len(calls), dealt)


def test_pipeline_run(spark, tmp_path):
    """The query gives the rows of its stages, each written and read again."""
    import corpus_pipeline

    rows = corpus(groups=30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] % 9 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"p{j}" for j in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == docs.columns and got.count() > 0
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in docs.collect())


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts and clashing columns: every stage
    keeps what is clean, row by row."""
    import corpus_pipeline

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmno") + str(rng.randrange(30)) for _ in range(n))
    passage = " ".join(f"p{j}" for j in range(20))
    texts = [text(30) for _ in range(12)] + [text(4), text(400)]
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    rows += [(None, text(25), "en", None, 1), (None, text(25), "en", None, 2), (3, text(35), "en", "b", 3), (3, text(35), "fr", "b", 4)]
    clean = [r[1] for r in rows]
    rows += [(50, None, None, None, None), (51, "", "en", "a", 0), (None, None, None, None, None), (3, f"{text(9)} {passage}", "en", "b", 5), (None, f"{passage} end", "en", None, 6)]
    names = ["mark", "copy", "u", "key", "hit_a", "shard", "doc", "spans", "mix_shard"]
    docs = frame(spark, rows)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept = [r.text for r in now.collect()]
        if name in ("toxicity", "ngram_jaccard_join"):
            assert set(clean) <= set(kept) and sum(passage in (t or "") for t in kept) == 2
        if name == "benchmark_decontamination":
            assert set(clean) <= set(kept) and not any(passage in (t or "") for t in kept)
        if name != "sharding":
            assert now.columns == columns
    assert sorted(now.columns) == sorted(columns) and {r.shard for r in now.collect()} <= set(range(24)) and all(r.mark == 0 and r.copy == 1 for r in now.collect())
    # Each source's copies come near its target, so most of what is clean is there.
    assert len(set(clean) & set(kept)) > len(clean) / 2


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
