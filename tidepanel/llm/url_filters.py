"""URL rules, and block decisions that follow redirects and canonical links.

Rules name a host and the beginning of a path; the longest rule that fits a url
decides. A url without a rule may still be another name of a blocked one: pages
say so by a canonical link or a refresh to another url, crawls by a table of
redirects, and urls that differ only in scheme, fragment, tracking parameters or
a closing slash are one resource. These edges are read from the pages by regular
expressions inside the JVM, their connected components are found by the shared
star contraction (no component is ever gathered), and one blocked member blocks
every member that has no rule of its own. An explicit rule, allow rules first of
all, is never overruled by an alias.

Html is read once. Components see edges between different resources only, as
pairs of 64-bit hashes; pages meet blocked resources by a join on that hash,
broadcast only after a count, salted otherwise, as one url may hold many rows.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule, and is nobody's alias, so it is allowed; null or empty html has no links; a
link that cannot be a url (``mailto:``, an empty or fragment-only reference) is
left out; ``..`` in relative links is kept as it is written; repeated rows are
judged alike, each on its own; an empty table gives no rows; columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import ascii_lower, components, stored

#: Fixed values: (verdict, host, path) of the registered query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules become one expression, so their number is bounded.
MOST_RULES = 500
BROADCAST_NODES = 1_000_000
SALTS = 16
#: Query parameters that only follow visitors.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Of two
    rules of one length an allow rule goes first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if any(v not in ("allow", "block") or not h for v, h, _ in rules):
        raise ValueError("a rule is (allow or block, host, beginning of the path)")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def resource_key(url: Column) -> Column:
    """One name for urls that a site answers alike; null without ``://``."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/(?:index\.html?)?$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    name = F.concat(host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise(F.lit("")))
    return F.when(url.contains("://"), name)


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"(?i)\b{name}{_VALUE}", 1)
    return F.replace(F.trim(F.regexp_replace(raw, r"^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def _resolved(link: Column, host: Column, path: Column) -> Column:
    """The link as a whole url, seen from the page; null if it is none."""
    base = F.concat(F.lit("http://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(link, r"^(?:\./)+", "")))
    )


def page_links(html: Column, host: Column, path: Column) -> Column:
    """Where a page's canonical link and refresh lead, as an array of urls.
    Comments and scripts are not part of the page."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = F.regexp_extract_all(html, F.lit(_TAG), 0)

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link\b") & tag.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b""")
        refresh = tag.rlike(r"(?i)^<meta\b") & tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b""")
        moved = F.regexp_extract(_attribute(tag, "content"), r"""(?i)\burl\s*=\s*["']?([^"'\s;]+)""", 1)
        return _resolved(F.when(canonical, _attribute(tag, "href")).when(refresh, moved).otherwise(F.lit("")), host, path)

    return F.filter(F.transform(tags, target), lambda x: x.isNotNull())


def aliases_of_blocked(blocked: DataFrame, edges: DataFrame) -> DataFrame:
    """All resources (``node``) in a component with a blocked one, and those
    blocked themselves. ``blocked``: node; ``edges``: a, b, hashes of resources."""
    if edges.isEmpty():
        return blocked.select("node")
    roots = components(edges, "url-components")
    hit = blocked.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    hit = hit.select("root").distinct()
    members = roots.join(hit, "root").select("node")
    return blocked.select("node").unionByName(hit.withColumnRenamed("root", "node")).unionByName(members).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page row: page_id, url, host, path, rule, verdict, and ``alias`` (the
    verdict came over an alias). ``redirects`` (from_url, to_url) adds edges known
    from elsewhere; the pages' own links are always read."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    seen = pages.select("page_id", "url", "html", host_of(url).alias("host"), path_of(url).alias("path"))
    # Most pages name no other url: those texts are not searched for tags.
    may_link = F.coalesce(F.col("html").rlike("(?i)canonical|refresh"), F.lit(False))
    links = F.when(may_link & url.contains("://"), page_links(F.col("html"), host, path))
    seen = seen.select("page_id", "url", "host", "path", rule_for(host, path, rules).alias("own"), F.xxhash64(resource_key(url)).alias("hash"), url.contains("://").alias("named"), links.alias("links"))
    seen = stored(seen.select("page_id", "url", "host", "path", "own", F.when(F.col("named"), F.col("hash")).alias("node"), "links"), "judged-urls")

    edges = seen.filter("size(links) > 0 and node is not null").select(F.col("node").alias("a"), F.lit(None).cast("string").alias("from_url"), F.explode("links").alias("to_url"))
    if redirects is not None:
        known = redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")).filter(F.col("from_url").contains("://") & F.col("to_url").contains("://"))
        edges = edges.unionByName(known.select(F.xxhash64(resource_key(F.col("from_url"))).alias("a"), "from_url", "to_url"))
    end_verdict = lambda c: rule_for(host_of(F.col(c)), path_of(F.col(c)), rules)["verdict"]
    edges = edges.select("a", F.xxhash64(resource_key(F.col("to_url"))).alias("b"), (end_verdict("from_url") == "block").alias("a_blocked"), (end_verdict("to_url") == "block").alias("b_blocked"))
    edges = stored(edges.groupBy("a", "b").agg(F.max("a_blocked").alias("a_blocked"), F.max("b_blocked").alias("b_blocked")), "url-edges")

    blocked = seen.filter("own.verdict = 'block' and node is not null").select("node")
    blocked = blocked.unionByName(edges.filter("a_blocked").select(F.col("a").alias("node"))).unionByName(edges.filter("b_blocked").select(F.col("b").alias("node")))
    spread = aliases_of_blocked(blocked.distinct(), edges.select("a", "b"))
    open_ = F.col("own").isNull() & F.col("node").isNotNull()
    wanted = seen.filter(open_).select("node").distinct()
    spread = stored(spread.join(wanted, "node", "left_semi").select(F.col("node").alias("hit")), "url-aliases")

    rest = seen.filter(open_).select("page_id", "url", "host", "path", "node", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    if spread.count() <= BROADCAST_NODES:
        rest = rest.join(F.broadcast(spread), F.col("node") == F.col("hit"), "left")
    else:
        salted = spread.withColumn("hit_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = rest.join(salted, (F.col("node") == F.col("hit")) & (F.col("salt") == F.col("hit_salt")), "left")
    found = F.col("hit").isNotNull()
    rest = rest.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(found, "block").otherwise("allow").alias("verdict"), found.alias("alias"))
    sure = seen.filter(~open_).select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(False).alias("alias"))
    return sure.unionByName(rest)
