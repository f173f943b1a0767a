"""URL rules and aliases, the repair of turns, and the filter audit."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import permutations

import duckdb
import pandas as pd
import pytest

# -- urls ------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, verdict string"


def judged(spark, rows, **more):
    from tidepanel.llm.url_filters import judge

    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)
    return {r.page_id: r for r in judge(pages, **more).collect()}


URLS = [
    (1, "http://A.Example.com/en/1", "", "a.example.com", "/en/1", "example.com/en/", "block"),
    (2, "https://www.example.com/en/1?x#y", None, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (3, "https://b.www.example.com/en/", "", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (4, "http://notexample.com/en/1", "", "notexample.com", "/en/1", "com/", "allow"),
    (5, "http://x.net/es/1", "", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://net/fr/1", "", "net", "/fr/1", "net/fr/", "block"),
    (7, "http://x.net/en/1", "", "x.net", "/en/1", None, "allow"),
    (8, "http://x.com", "", "x.com", "", None, "allow"),
    (9, "http://x.com?/a", "", "x.com", "", None, "allow"),
    (10, "x.net/es/1", "", "", "", None, "allow"),
    (11, None, "<link rel=canonical href=http://x.net/es/1>", "", "", None, "allow"),
    (12, "http://x.net/es", "", "x.net", "/es", None, "block"),  # one resource with .../es/ below
    (13, "https://x.net:443/es/?utm_source=f#top", "", "x.net:443", "/es/", None, "block"),
    (14, "http://x.net/es/", "", "x.net", "/es/", "net/es/", "block"),
    (15, "a://b://c.net/es/", "", "b:", "//c.net/es/", None, "allow"),
    (16, "", "", "", "", None, "allow"),
]


def test_rules_hosts_and_paths(spark):
    got = judged(spark, [u[:3] for u in URLS] + [URLS[0][:3]])
    for page, url, _, host, path, rule, verdict in URLS:
        r = got[page]
        assert (r.url, r.host, r.path, r.rule, r.verdict) == (url, host, path, rule, verdict)
    assert got[12].alias and not got[13].rule and got[13].alias and not got[14].alias and len(got) == len(URLS)


LINKED = [
    # 1 names 2 by a canonical link, 2 refreshes to 3, 3 is blocked; 4 links from afar.
    (1, "http://one.org/a", "<html><LINK HREF='//two.org/b' REL='canonical'></html>"),
    (2, "https://two.org/b/?ref=1", '<meta http-equiv="Refresh" content="0; URL=\'http://three.net/es/9\'">'),
    (3, "http://three.net/es/9", ""),
    (4, "http://one.org/dir/x", '<link rel="canonical" href="../a"><link rel="canonical" href="sub">'),
    (5, "http://one.org/dir/sub", '<link rel=canonical href=/a>'),
    # An allow rule of its own is never overruled; it does not protect others either.
    (6, "http://six.com/", '<link rel="canonical" href="http://one.org/a">'),
    # Comments, scripts, other links and links that are no urls.
    (7, "http://seven.org/", "<!-- <link rel=canonical href=http://three.net/es/9> --><script>'<link rel=canonical href=http://three.net/es/9>'</script><a rel=canonical href=http://three.net/es/9>"),
    (8, "http://eight.org/", '<link rel="canonical" href="mailto:x@three.net"><link rel="stylesheet" href="http://three.net/es/9"><link rel="canonical" href="#top"><link rel="canonical" href="">'),
    # A blocked target that is no page of the table.
    (9, "http://nine.org/", '<link rel="canonical" href="http://gone.net/fr/1?a=1&amp;b=2">'),
    (10, "http://ten.org/q?b=2&a=1", ""),
    (11, "http://eleven.org/", '<link rel="canonical" href="http://ten.org/q?a=1&amp;b=2">'),
    (12, "http://twelve.org/", None),
]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_aliases_are_blocked(spark, most, monkeypatch):
    from tidepanel.llm import url_filters

    monkeypatch.setattr(url_filters, "BROADCAST_NODES", most)
    got = judged(spark, LINKED)
    assert {p for p, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 9}
    assert {p for p, r in got.items() if r.alias} == {1, 2, 4, 5, 9}
    known = spark.createDataFrame([("http://ten.org/q?a=1&b=2", "http://far.net/fr/"), ("http://twelve.org", None), (None, "http://x.net/es/"), ("x", "y")], "from_url string, to_url string")
    more = judged(spark, LINKED, redirects=known)
    assert {p for p, r in more.items() if r.alias} == {1, 2, 4, 5, 9, 10, 11}


def test_urls_against_sql(spark):
    from tidepanel.llm.queries import ORACLES

    rows = [u[:3] for u in URLS] + [(100 + p, u, h) for p, u, h in LINKED]
    got = judged(spark, rows)
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    want = duckdb.sql(ORACLES["op11_url_filters"]).fetchall()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.alias) for r in got.values()) == sorted(want) and len(want) == len(rows)


def test_long_chain_and_hot_target(spark):
    """A chain of 60 aliases, and 400 pages that name one blocked url."""
    rows = [(i, f"http://c{i}.org/", f"<link rel=canonical href=http://c{i + 1}.org/>") for i in range(60)]
    rows += [(60, "http://c60.org/", "<link rel=canonical href=http://bad.net/es/>")]
    rows += [(1000 + i, f"http://h{i}.org/", "<link rel=canonical href='http://hot.net/fr/'>") for i in range(400)]
    got = judged(spark, rows)
    assert all(r.verdict == "block" and r.alias for r in got.values()) and len(got) == 461


def test_odd_rules_and_empty_pages(spark):
    from tidepanel.llm.url_filters import judge

    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge(pages).count() == 0
    for rules in ([("deny", "a", "/")], [("allow", "", "/")], [("allow", "a", "/")] * 501):
        with pytest.raises(ValueError):
            judge(pages, rules)
    tie = judged(spark, [(1, "http://ab.c/x", "")], rules=[("allow", "ab.c", "/x"), ("block", "ab.c", "/x")])
    assert tie[1].verdict == "allow"


# -- conversations ---------------------------------------------------------

CONVS = "conv_id long, turn long, role string, text string, seg string, n int"
BLANKS = " \t\n\x0b\x0c\r"


def broken(rows):
    """The rows after the known damage, in order, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        out[conv] += {0: [], 1: [(turn, role, "")], 2: [(turn, role, re.sub("[.!?]", "", text))], 3: [(turn, role, text)] * 2, 4: [(turn, "user", text)]}.get(code, [(turn, role, text)])
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def cheapest(rows):
    """All edits by plain recursion over (row, what was said so far): least cost, then
    the least string. Conversations of this test are short."""
    seen, items = set(), []
    for _, role, text in rows:
        gone = not text.strip(BLANKS) or (role, text) in seen
        seen.add((role, text))
        items.append((role, text, gone, 0 if text.rstrip(BLANKS)[-1:] in {".", "!", "?"} else 3))
    fits = re.compile("(s?(ua)+)?").fullmatch
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, said):
        # ``said``: the last initial, all that the pattern looks at once it began.
        found = [(0, "", ())] if i == len(items) and said in ("", "a") else []
        for role in ("user", "assistant"):
            if role[0] in after[said] and left[i, said] < 3:
                left[i, role[0]] = left[i, said] + 1
                c, e, t = best(i, role[0])
                found.append((c + 3, "I" + e, ((role, ""), *t)))
        if i < len(items):
            role, text, gone, late = items[i]
            c, e, t = best(i + 1, said)
            found.append((c + 4, "D" + e, t))
            if not gone:
                for new, cost, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new[:1] and new[0] in after[said]:
                        c, e, t = best(i + 1, new[0])
                        found.append((c + cost + late, letter + e, ((new, text), *t)))
        return min(found) if found else (10**6, "", ())

    left = defaultdict(int)
    got = best(0, "")
    assert fits("".join(r[:1] for r, _ in got[2]))
    return got


def report_of(rows):
    """Brute force of the report, and the repaired turns."""
    out, turns = {}, {}
    by_conv = broken(rows)
    for conv in {r[0] for r in rows}:
        mine = by_conv.get(conv, [])
        known = [t for t, _, _ in mine if t is not None]
        blank = duplicate = cut = 0
        seen = set()
        for _, role, text in mine:
            first = "b" if not text.strip(BLANKS) else "d" if (role, text) in seen else "t" if text.rstrip(BLANKS)[-1:] not in {".", "!", "?"} else ""
            seen.add((role, text))
            blank, duplicate, cut = blank + (first == "b"), duplicate + (first == "d"), cut + (first == "t")
        wrong = sum(a[1][:1] + b[1][:1] not in {"su", "ua", "au"} for a, b in zip(mine, mine[1:]))
        cost, audit, said = cheapest(mine)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, cut, wrong, cost, audit, digest)
        turns[conv] = list(said)
    return out, turns


def conversations(seed, count=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9])
        for turn in range(n):
            if rng.random() < 0.1:
                continue
            role = "system" if turn == 0 and rng.random() < 0.4 else ("user", "assistant")[turn % 2] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hello.", "Why?", "Yes!", "no end", "", " \n", None, f"Word {rng.randrange(50)}.", "tail. \n", "tail.\x85"])
            rows.append((conv if conv else None, turn if rng.random() < 0.95 else rng.choice([None, 2]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_brute_force(spark, seed):
    from tidepanel.llm.conversation_repair import conversation_report, damage, repair_conversations, repaired_rows

    rows = conversations(seed)
    convs = spark.createDataFrame([(*r, "clash", 7) for r in rows], CONVS).repartition(3)
    parts = repair_conversations(damage(convs))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_report(parts, convs).collect()}
    want, turns = report_of(rows)
    assert got == want
    said = defaultdict(list)
    for r in sorted(repaired_rows(parts).collect(), key=lambda r: (r.seg, r.place)):
        said[r.conv_id].append((r.role, r.text))
    assert dict(said) == {c: t for c, t in turns.items() if t}


def test_one_long_conversation_over_many_ranges(spark, monkeypatch):
    """A third of all rows in one conversation: several segments, one result."""
    from tidepanel.llm import conversation_repair as module

    monkeypatch.setattr(module, "ROWS_AT_A_TIME", 7)
    rng = random.Random(3)
    hot = [(500, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "open", "", f"{t}?", f"{t}!"])) for t in range(0, 160, 1)]
    rows = hot + conversations(4, 70)
    convs = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVS).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        parts = module.repair_conversations(module.damage(convs))
        assert parts.filter("conv_id = 500").count() > 2 and parts.filter("spans").select("conv_id").distinct().count() > 2
        got = {r.conv_id: tuple(r)[1:] for r in module.conversation_report(parts, convs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == report_of(rows)[0]


def test_repair_against_sql_and_odd_tables(spark):
    from tidepanel.llm.conversation_repair import conversation_report, damage, repair_conversations
    from tidepanel.llm.queries import ORACLES

    rows = conversations(9, 30) + [(77, None, None, None)] * 3 + [(78, 5, "user", "a. " * 20_000)] * 40
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    got = conversation_report(repair_conversations(damage(convs)), convs)
    conversations_ = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    duckdb.register("conversations", conversations_)
    want = duckdb.sql(ORACLES["op12_conversation_repair"])
    pick = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in pick)) for r in want.fetchall())
    empty = convs.limit(0)
    assert conversation_report(repair_conversations(empty), empty).count() == 0


# -- filter audit ----------------------------------------------------------

DOCS = "doc_id long, text string, source string, mask string, n long"


def audit_of(docs, labels):
    """Every order by removing documents one filter after the other."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((source or "", i, {k for k, v in f.items() if v}))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [f for f in left if c in f[2]]
                left = [f for f in left if c not in f[2]]
                steps.append((order, k, len(left), len(gone), sum(c in f[2] for f in mine) - len(gone), sum(f[2] == {c} for f in mine), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone), c))
        total = defaultdict(int)
        for s in steps:
            total[s[8]] += s[3]
        out.update({(part, s[0], s[1]): (*s[2:8], total[s[8]]) for s in steps})
    return out


def audited_docs(seed):
    rng = random.Random(seed)
    texts = ["", None, "Short TEXT", " ".join(f"w{j}" for j in range(250)), "same " * 300, " ".join(f"W{j}" for j in range(250)), "# " + " ".join(f"x{j}" for j in range(199)), "long " * 30_000 + "*", "É " * 210, "one two\x0bthree"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", "", None, "hot", "hot", "hot"])) for _ in range(150)]
    docs += docs[:10] + [(200 + i, texts[3], "hot") for i in range(60)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_brute_force(spark, seed):
    from tidepanel.llm.filter_audit import filter_audit

    docs, labels = audited_docs(seed)
    table = spark.createDataFrame([(*d, "clash", 5) for d in docs], DOCS).repartition(3)
    marks = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality long, toxic long, n int")
    got = filter_audit(table, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == audit_of(docs, labels) and len(rows) == 600 * len({d[2] or "" for d in docs})


def test_audit_of_own_filters_and_empty_tables(spark):
    from pyspark.sql import functions as F

    from tidepanel.llm.filter_audit import audit_orders, filter_audit, mask_counts

    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, None, "s"), (4, "a b c", "t")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, kind int")
    counts = mask_counts(docs, labels, {"X": F.size("w") < 2, "Y": F.col("t").contains("b")}, copies=False, measures={"kind": "kind"})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.kind_lost, r.shapley) for r in audit_orders(counts, ["X", "Y"], ["kind"]).collect()}
    assert got["s", "XY", 1] == (1, 2, 0, 4) and got["s", "XY", 2] == (0, 1, 1, 2) and got["t", "YX", 1] == (0, 1, 0, 2) and len(got) == 8
    none = docs.limit(0)
    assert filter_audit(none, labels.select("doc_id", F.col("kind").alias("quality"), F.col("kind").alias("toxic"))).count() == 0
    for names in (["XX"], ["X", "X"], list("ABCDEFGHI")):
        with pytest.raises(ValueError):
            audit_orders(counts, names, [])
