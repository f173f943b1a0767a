"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.shared import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.decontam import contamination

    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.line_dedup import LineIndex

    docs = read_table(spark, sf_dir, "documents")
    kept = LineIndex.build(docs, min_docs=10).drop_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidepanel.llm.token_store import document_checks, write_store

    path = write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return document_checks(spark, path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.ring_shards import sharded

    rows = sharded(read_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.embed_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.mixing import mix_report

    return mix_report(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.langid import identify, learn

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.jaccard_join import jaccard_components

    found = jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "class_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.toxicity import learn, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, read_table(spark, sf_dir, "labels")))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.url_filters import judge

    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "alias")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.conversation_repair import conversation_report, damage, repair_conversations

    convs = read_table(spark, sf_dir, "conversations")
    return conversation_report(repair_conversations(damage(convs)), convs)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.filter_audit import filter_audit

    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_store": op3_token_store,
    "op4_sharding": op4_sharding,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_url_filters": op11_url_filters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM win),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, i, dw.k, item FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw) dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE hot.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY r, doc_id""",
    "op5_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op9_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
z1 AS (SELECT doc_id, list_sort(list(g)) AS l FROM s GROUP BY doc_id),
z2 AS (SELECT l, min(doc_id) AS class_id FROM z1 GROUP BY l)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN k ON k.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN z1 ON z1.doc_id = d.doc_id LEFT JOIN z2 ON z1.l = z2.l""",
    "op11_url_filters": r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT row_number() OVER () AS r, page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g') AS html,
  translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
tag AS (SELECT r, url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE url LIKE '%://%'),
att AS (SELECT *, replace(trim(regexp_replace(regexp_extract(tag, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&') AS href,
  replace(trim(regexp_replace(regexp_extract(tag, '(?i)\bcontent\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&') AS content FROM tag),
lnk AS (SELECT *, CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b') THEN href
  WHEN regexp_matches(tag, '(?i)^<meta\b') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(content, '(?i)\burl\s*=\s*["'']?([^"''\s;]+)', 1) ELSE '' END AS l FROM att),
e0 AS (SELECT url AS a, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN l = '' OR l LIKE '#%' OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN l LIKE '//%' THEN 'http:' || l WHEN l LIKE '/%' THEN 'http://' || host || l WHEN l LIKE '?%' THEN 'http://' || host || path || l
  ELSE 'http://' || host || CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || regexp_replace(l, '^(?:\./)+', '') END AS b FROM lnk),
u AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT b FROM e0) WHERE url LIKE '%://%'),
v AS (SELECT url, translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS q FROM u),
k AS (SELECT url, regexp_replace(host, ':(?:80|443)$', '') || regexp_replace(path, '/(?:index\.html?)?$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key,
  (SELECT arg_max(verdict, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS verdict FROM v),
e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM e0 JOIN k x ON x.url = e0.a JOIN k y ON y.url = e0.b),
bad(key) AS (SELECT DISTINCT key FROM k WHERE verdict = 'block' UNION SELECT CASE WHEN e.a = bad.key THEN e.b ELSE e.a END FROM bad JOIN e ON e.a = bad.key OR e.b = bad.key)
SELECT page_id, p.host, p.path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule,
  coalesce(k.verdict, CASE WHEN bad.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, k.verdict IS NULL AND bad.key IS NOT NULL AS alias
FROM p LEFT JOIN k ON k.url = p.url LEFT JOIN (SELECT DISTINCT key FROM bad) bad ON bad.key = k.key""",
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(substr(key, j, 1)) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code FROM c),
e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE code <> 0),
o AS (SELECT *, left(role, 1) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 3 ELSE 0 END AS fault,
  lag(k) OVER (PARTITION BY conv_id ORDER BY i) AS pk FROM o),
g AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late FROM f),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pk || k NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
b(conv_id, i, c) AS (SELECT conv_id, n + 1, [0, 6, 3, 0] FROM n UNION ALL
  SELECT conv_id, i, CASE WHEN fault IN (1, 2) THEN list_transform(c, lambda x: x + 4) ELSE [least(m[1], 3 + m[3], 6 + m[4]), least(m[2], 3 + m[3], 6 + m[4]), least(m[3], 3 + m[4]), least(m[4], 3 + m[3])] END
  FROM (SELECT g.conv_id, g.i, g.fault, b.c, [least(4 + c[1], 3 + late + c[3], CASE k WHEN 's' THEN late + c[2] WHEN 'u' THEN late + c[3] END), least(4 + c[2], 3 + late + c[3], CASE k WHEN 'u' THEN late + c[3] END),
    least(4 + c[3], 3 + late + c[4], CASE k WHEN 'a' THEN late + c[4] END), least(4 + c[4], 3 + late + c[3], CASE k WHEN 'u' THEN late + c[3] END)] AS m
    FROM b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i - 1)),
v AS (SELECT b.conv_id, b.i, b.c, w.c AS nx, g.k, g.late, g.role, g.text FROM b LEFT JOIN b w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1
  LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i),
t(conv_id, i, q, audit, lines) AS (SELECT conv_id, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM n UNION ALL
  SELECT conv_id, CASE WHEN ed = 'I' THEN i ELSE i + 1 END, CASE ed WHEN 'D' THEN q WHEN 'K' THEN kp ELSE sp END, audit || ed,
    CASE ed WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE sp WHEN 3 THEN 'user:' ELSE 'assistant:' END) WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE sp WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) END
  FROM (SELECT *, CASE WHEN c[q] = 4 + nx[q] THEN 'D' WHEN c[q] = 3 + c[sp] THEN 'I' WHEN c[q] = late + nx[kp] THEN 'K' ELSE 'R' END AS ed
    FROM (SELECT t.*, v.c, v.nx, v.late, v.role, v.text, CASE q WHEN 3 THEN 4 ELSE 3 END AS sp, CASE WHEN k = 's' AND q = 1 THEN 2 WHEN k = 'u' AND q <> 3 THEN 3 WHEN k = 'a' AND q = 3 THEN 4 END AS kp
      FROM t JOIN v ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.i = t.i WHERE NOT (v.nx IS NULL AND v.c[t.q] = 0)))),
z AS (SELECT t.conv_id, audit, lines, x.c[1] AS cost FROM t JOIN v ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.i = t.i AND v.nx IS NULL AND v.c[t.q] = 0 JOIN b x ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.i = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_filter_audit": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY part, fails),
o(o) AS (SELECT '' UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(c) WHERE NOT contains(o, c)),
s AS (SELECT o, unnest(range(1, 6)) AS k FROM o WHERE length(o) = 5),
b AS (SELECT o, k, substr(o, k, 1) AS c, substr(o, 1, k - 1) AS before FROM s),
c AS (SELECT part, o, k, c, n, g, x, fails, contains(fails, c) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM b, m),
a AS (SELECT part, o, k, c, sum(n) FILTER (WHERE NOT gone AND NOT hit) AS kept, sum(n) FILTER (WHERE NOT gone AND hit) AS removed, sum(n) FILTER (WHERE gone AND hit) AS redundant,
  sum(n) FILTER (WHERE fails = c) AS unique_fails, sum(g) FILTER (WHERE NOT gone AND hit) AS good_lost, sum(x) FILTER (WHERE NOT gone AND hit) AS toxic_lost FROM c GROUP BY part, o, k, c)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM a""",
}
