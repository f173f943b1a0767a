"""Mixing sources to target weights with DataFrame functions only.

Every source gets a target in words (``targets``): the sizes of all documents
are shared by weight, no source gets more than ``most`` times its own size, and
what is above is shared again. A target is met by whole passes over the source
and, for the rest, by a prefix of its documents in a permuted order (by the hash
of id, source, text and, for repeated rows, a number): the hash range is cut into
blocks, block sums locate the cut, those of finer blocks locate it again, and only
the finest block with the cut is looked at row by row. So a source with a third of
all rows costs some aggregations. What the prefix leaves, as its next document is
too long, is filled from the documents behind it, longest first, by counts for each
size; at the end less is missing than the shortest document left out has words, and
that one is taken if it brings the sum nearer to the target. Only a source whose
documents left out are all too long has some others taken once more.

A source's stock is its blocks, once for each pass that takes them; their number
is its quota. A splitting tree shares the quotas among output shards: every node
holds a quota of each source, its left child gets a fixed number of blocks, and
how many of each source is one multivariate hypergeometric draw, source after
source by inversion of the hypergeometric distribution at a hashed uniform
number. At the leaves each source's stock, in a permuted order, is dealt out by
these quotas, so the draws of the shards are disjoint and use the stock up.
Which copies of a document are taken is read from the dealt blocks (``deal``).
Rows of a shard are shuffled by a hash. Fixed seeds make reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 are taken as often as their neighbours and count 0
words; a source without words has the target 0; repeated rows (one id, source and
text, null ids too) are numbered and taken each on its own; an empty table gives no
rows. Other columns are passed through by ``mix``; a column with the name of a plan column is replaced by it where plan
columns are asked for. Sources are taken to be few beside documents: a node of the tree
holds one number for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import columns_of, forget, stored, whole_row

BLOCK_BITS = 10
FINE_BITS = 20
BROADCAST_ROWS = 500_000
LAST_U = (1 << 63) - 1


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key():
    """A non-null name of the source."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _order(seed: int):
    """The place of a document in its source's permuted order, 63 bits. Needs
    ``mark``, the hash of its text, and ``copy``, its number among equal rows."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "mark", "copy").bitwiseAND(F.lit((1 << 63) - 1))


def _block(bits: int = BLOCK_BITS):
    return F.shiftright("u", 63 - bits).cast("int")


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per source: key, source_size, target. ``rows``: key, source, size."""
    per = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    # Sources reach their limit in order of limit / weight; those before a row are full.
    by = Window.orderBy(F.col("full") / F.col("w"), "key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
    per = per.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("rate", F.col("left_size") / F.col("left_w")).withColumn("at", F.row_number().over(by))
    free = F.when(F.col("rate") * F.col("w") <= F.col("full"), F.struct("at", "rate"))
    per = per.withColumn("first_free", F.min(free).over(whole))
    rate = F.coalesce(F.col("first_free.rate"), F.lit(float("inf")))
    return per.select("key", "source_size", F.least("full", F.when(rate == float("inf"), F.col("full")).otherwise(rate * F.col("w"))).alias("target"))


# -- the splitting tree ----------------------------------------------------


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` blocks drawn without replacement are among the ``good``
    ones: the least x whose cumulative probability reaches ``u``. Weights follow
    from their ratios, in logarithms, and are summed up before the search."""
    low, high = F.greatest(F.lit(0).cast("long"), n - bad), F.least(n, good)
    range_ = F.sequence(low, high)

    def onward(weight: Column, x: Column) -> Column:
        ratio = (good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))
        return F.when(x < high, weight + F.log(ratio)).otherwise(weight)

    def add(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], acc["w"])
        return F.struct(onward(acc["w"], x).alias("w"), top.alias("top"), (acc["total"] * F.exp(acc["top"] - top) + F.exp(acc["w"] - top)).alias("total"))

    begin = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top"), F.lit(0.0).alias("total"))
    ready = lambda acc: F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("upto"), F.lit(None).cast("long").alias("x"), acc["top"].alias("top"), acc["total"].alias("total"))

    def seek(acc: Column, x: Column) -> Column:
        upto = acc["upto"] + F.exp(acc["w"] - acc["top"]) / acc["total"]
        return F.struct(onward(acc["w"], x).alias("w"), upto.alias("upto"), F.coalesce(acc["x"], F.when(upto >= u, x)).alias("x"), acc["top"].alias("top"), acc["total"].alias("total"))

    return F.aggregate(range_, F.aggregate(range_, begin, add, ready), seek, lambda acc: F.coalesce(acc["x"], high))


_QUOTA = "array<struct<key:string,left:bigint,right:bigint>>"


def _split_node(quotas: Column, n: Column, seed: Column) -> Column:
    """The quotas of both children; ``n`` blocks go to the left one."""
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    begin = F.struct(whole.alias("blocks"), n.alias("n"), F.array().cast(_QUOTA).alias("out"))

    def draw(acc: Column, s: Column) -> Column:
        uniform = F.pmod(F.xxhash64(seed, s["key"]), F.lit(1 << 52)) / float(1 << 52)
        x = hypergeometric(s["n"], acc["blocks"] - s["n"], acc["n"], uniform)
        return _let(x, lambda x: F.struct((acc["blocks"] - s["n"]).alias("blocks"), (acc["n"] - x).alias("n"), F.concat(acc["out"], F.array(F.struct(s["key"].alias("key"), x.alias("left"), (s["n"] - x).alias("right")))).alias("out")))

    return F.aggregate(quotas, begin, draw, lambda acc: acc["out"])


def tree_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """The blocks of every source for every shard. ``quotas``: key, n. Returns
    key, mix_shard, n, with the sums of ``quotas`` over the shards."""
    whole = F.array_sort(F.collect_list(F.struct("key", F.col("n").cast("long").alias("n"))))
    nodes = quotas.agg(whole.alias("quotas")).select("quotas", F.lit(0).alias("low"), F.lit(shards).alias("high"))
    size = shards
    while size > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        blocks = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, s: a + s["n"])
        n = F.round(blocks * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
        drawn = nodes.withColumn("drawn", _split_node(F.col("quotas"), n, F.xxhash64(F.lit(seed), "low", "high")))
        own = lambda side: F.transform("drawn", lambda s: F.struct(s["key"].alias("key"), s[side].alias("n")))
        children = F.array(F.struct(own("left").alias("quotas"), F.col("low"), middle.alias("high")), F.struct(own("right").alias("quotas"), middle.alias("low"), F.col("high")))
        leaf = F.array(F.struct("quotas", "low", "high"))
        nodes = drawn.select(F.explode(F.when(F.col("high") - F.col("low") < 2, leaf).otherwise(children)).alias("node")).select("node.*")
        size = -(-size // 2)
    return nodes.select(F.col("low").alias("mix_shard"), F.explode("quotas").alias("q")).select("q.key", "mix_shard", "q.n")


# -- the plan --------------------------------------------------------------


@dataclass
class MixPlan:
    """``sources``: key, source_size, target; ``deal``: for every block of a source
    its dealt copies, an array of (pass, mix_shard, last_u, extra): documents of the
    block up to this hash, and those with an extra hash, are taken in that pass."""

    sources: DataFrame
    deal: DataFrame
    shards: int
    seed: int

    def with_copies(self, rows: DataFrame) -> DataFrame:
        """Rows with key and u get ``dealt``: the (pass, mix_shard) that take them."""
        rows = rows.withColumn("block", _block()).join(_sent(self.deal), ["key", "block"], "left")
        taken = F.filter(F.coalesce("dealt", F.array().cast(_DEALT)), lambda c: (F.col("u") <= c["last_u"]) | F.array_contains(c["extra"], F.col("u")))
        return rows.withColumn("dealt", taken)


_DEALT = "array<struct<pass:int,mix_shard:int,last_u:bigint,extra:array<bigint>>>"


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _cut(sums: DataFrame, rest: DataFrame) -> DataFrame:
    """The place where each source's running sum passes ``rest``, and what is still
    missing before it. ``sums``: key, place, b; ``rest``: key, rest."""
    ahead = Window.partitionBy("key").orderBy("place")
    sums = sums.withColumn("upto", F.sum("b").over(ahead)).join(_sent(rest), "key")
    past = sums.filter((F.col("upto") > F.col("rest")) & (F.col("rest") > 0))
    return past.groupBy("key").agg(F.min("place").alias("cut"), F.min_by(F.col("rest") - F.col("upto") + F.col("b"), "place").alias("rest"))


_PICKS = "array<struct<size:bigint,c:bigint,level:int>>"


def _fitting(sizes: str | Column, missing: Column, level: int) -> Column:
    """Walk over (size, c) from the longest: as many of each as fit into what is
    missing. A struct of what is still missing, the shortest of which some are left,
    and the picks."""
    begin = F.struct(missing.cast("double").alias("missing"), F.lit(None).cast("bigint").alias("short"), F.array().cast(_PICKS).alias("picks"))

    def one(acc: Column, s: Column) -> Column:
        n = F.least(s["c"], F.floor(acc["missing"] / s["size"]))
        picks = F.when(n > 0, F.concat(acc["picks"], F.array(F.struct(s["size"].alias("size"), n.alias("c"), F.lit(level).alias("level"))))).otherwise(acc["picks"])
        return F.struct((acc["missing"] - n * s["size"]).alias("missing"), F.when(n < s["c"], s["size"]).otherwise(acc["short"]).alias("short"), picks.alias("picks"))

    return F.aggregate(sizes, begin, one)


def _fill(rows: DataFrame, sources: DataFrame, most: int, near: float) -> DataFrame:
    """Documents that fill what is ``missing`` of their source's target behind the
    prefix: key, block, level and the hashes of the documents (``extra``).

    Counts for each size are walked from the longest that fits, as many of a size as
    fit, so less is missing at the end than any document left out has words; the
    shortest of these closes the gap if that leaves less. Of one size the first in
    the permuted order are taken. They are few: their words sum up to less than one
    document. Where more than ``near`` of the target is missing even so, as all that
    is left out is too long, documents are taken once more (level 1 and up), as
    often as ``most`` allows."""
    held = sources.filter("missing > 0").select("key", "last_u", "missing", "passes", "target")
    open_ = rows.filter("size > 0").select("key", "size", "u", _block().alias("block")).join(_sent(held), "key")
    behind = F.col("u") > F.col("last_u")
    sizes = open_.groupBy("key", "missing", "passes", "target", "size").agg(F.count_if(behind).alias("c"), F.count("*").alias("every"))
    inside = F.col("size") <= F.col("missing")
    desc = lambda c: F.reverse(F.array_sort(F.collect_list(F.when(inside & (F.col(c) > 0), F.struct("size", F.col(c).alias("c"))))))
    per = sizes.groupBy("key", "missing", "passes", "target").agg(desc("c").alias("fits"), desc("every").alias("again"), F.min(F.when(~inside & (F.col("c") > 0), F.col("size"))).alias("longer"))
    per = per.withColumn("level0", _fitting("fits", F.col("missing"), 0))
    short = F.least("level0.short", "longer")
    off = F.least(F.col("level0.missing"), F.coalesce(short - F.col("level0.missing"), F.col("level0.missing")))
    per = per.withColumn("short0", short).withColumn("once", off <= near * F.col("target"))
    for level in range(1, most):
        allowed = ~F.col("once") & (F.col("passes") + level < most)
        sizes_again = F.when(allowed, F.col("again")).otherwise(F.array().cast("array<struct<size:bigint,c:bigint>>"))
        per = per.withColumn(f"level{level}", _fitting(sizes_again, F.col(f"level{level - 1}.missing"), level)).withColumn(f"short{level}", F.col(f"level{level}.short"))
    closing = F.array_min(F.filter(F.array(*[F.struct(F.col(f"short{k}").alias("size"), F.lit(1).cast("bigint").alias("c"), F.lit(k).alias("level")) for k in range(most)]), lambda x: x["size"].isNotNull()))
    gap = F.col(f"level{most - 1}.missing")
    closing = F.when(closing["size"] - gap < gap, F.array(closing)).otherwise(F.array()).cast(_PICKS)
    picks = per.select("key", F.explode(F.concat(*[f"level{k}.picks" for k in range(most)], closing)).alias("p"))
    picks = stored(picks.groupBy("key", "p.size", "p.level").agg(F.sum("p.c").alias("c")), "mix-picks")
    chosen = open_.join(_sent(picks), ["key", "size"]).filter(behind | (F.col("level") > 0))
    # The block in which the last one of a size lies, so that only its rows are put in order.
    ahead = Window.partitionBy("key", "size", "level").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = chosen.groupBy("key", "size", "level", "c", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    before = stored(before.filter("before < c").select("key", "size", "level", "block", (F.col("c") - F.col("before")).alias("left")), "mix-picks")
    chosen = chosen.join(_sent(before), ["key", "size", "level", "block"])
    place = F.row_number().over(Window.partitionBy("key", "size", "level", "block").orderBy("u"))
    chosen = chosen.withColumn("place", place).filter("place <= left")
    return chosen.groupBy("key", "block", "level").agg(F.array_sort(F.collect_list("u")).alias("extra"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 16, seed: int = 11, rows: DataFrame | None = None, near: float = 0.01) -> MixPlan:
    rows = rows if rows is not None else mix_rows(docs, seed)
    goal = targets(rows, weights, most)
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    goal = goal.withColumn("passes", F.coalesce(F.least(F.floor(ratio + 1e-12), F.lit(most)), F.lit(0)).cast("int"))
    goal = stored(goal.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    blocks = stored(rows.groupBy("key", _block().alias("place")).agg(F.sum("size").alias("b")), "mix-blocks")
    cut = stored(_cut(blocks, goal.select("key", "rest")), "mix-cuts")
    inside = rows.withColumn("place", _block(FINE_BITS)).join(_sent(cut), "key").filter(_block() == F.col("cut")).select("key", "place", "size")
    fine = stored(_cut(inside.groupBy("key", "place").agg(F.sum("size").alias("b")), cut.select("key", "rest")), "mix-cuts")
    # In the finest block with the cut: the documents that fit, in order.
    held = rows.withColumn("place", _block(FINE_BITS)).join(_sent(fine), "key").filter("place = cut")
    run = Window.partitionBy("key").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("size").over(run)).filter(F.col("upto") <= F.col("rest"))
    last = held.groupBy("key").agg(F.max("u").alias("inner_u"), F.max("upto").alias("inner_sum"))
    found = cut.select("key", F.col("cut").alias("block_cut")).join(fine.select("key", F.col("cut").alias("fine_cut"), F.col("rest").alias("fine_rest")), "key", "left").join(last, "key", "left")
    sources = goal.join(found, "key", "left")
    start = lambda place, bits: F.shiftleft(F.col(place).cast("long"), 63 - bits)
    inner = F.coalesce(F.greatest("inner_u", start("fine_cut", FINE_BITS) - 1), start("block_cut", BLOCK_BITS) - 1)
    last_u = F.when(F.col("rest") <= 0, F.lit(-1).cast("long")).when(F.col("block_cut").isNull(), F.lit(LAST_U)).otherwise(inner)
    missing = F.when(F.col("block_cut").isNotNull() & (F.col("rest") > 0), F.col("fine_rest") - F.coalesce("inner_sum", F.lit(0)))
    sources = stored(sources.select("key", "source_size", "target", "passes", last_u.alias("last_u"), missing.alias("missing")), "mix-sources")
    extra = _fill(rows, sources, most, near).groupBy("key", "block").agg(F.map_from_entries(F.collect_list(F.struct("level", "extra"))).alias("extras"), (F.max("level") + 1).alias("levels"))
    extra = stored(extra, "mix-fill")
    # The stock: one row per block and pass that takes it, the last pass up to the cut.
    stock = blocks.select("key", F.col("place").alias("block")).join(_sent(sources), "key").join(_sent(extra), ["key", "block"], "left")
    more = F.greatest((start("block", BLOCK_BITS) <= F.col("last_u")).cast("int"), F.coalesce("levels", F.lit(0)))
    stock = stock.withColumn("n", F.col("passes") + more).filter("n > 0").select("key", "block", "passes", "last_u", "extras", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass"))
    upto = F.when(F.col("pass") < F.col("passes"), F.lit(LAST_U)).when(F.col("pass") == F.col("passes"), F.col("last_u")).otherwise(F.lit(-1).cast("long"))
    own_extra = F.coalesce(F.element_at("extras", F.col("pass") - F.col("passes")), F.array().cast("array<bigint>"))
    drawn = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block", "pass"), "block", "pass")
    stock = stored(stock.select("key", "block", "pass", upto.alias("last_u"), own_extra.alias("extra"), (F.row_number().over(drawn) - 1).alias("place")), "mix-stock")
    quotas = tree_quotas(stock.groupBy("key").agg(F.count("*").alias("n")), shards, seed)
    ahead = Window.partitionBy("key").orderBy("mix_shard").rowsBetween(Window.unboundedPreceding, -1)
    quotas = stored(quotas.select("key", "mix_shard", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")), "mix-quotas")
    # One row per source with its shards in order: a block's shard is found by its place.
    leaves = quotas.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ahead", "n", "mix_shard"))).alias("leaves"))
    own = F.filter("leaves", lambda q: (q["ahead"] <= F.col("place")) & (F.col("place") < q["ahead"] + q["n"]))
    deal = stock.join(_sent(leaves), "key").select("key", "block", F.struct("pass", F.element_at(own, 1)["mix_shard"].alias("mix_shard"), "last_u", "extra").alias("copy"))
    deal = stored(deal.groupBy("key", "block").agg(F.array_sort(F.collect_list("copy")).cast(_DEALT).alias("dealt")), "mix-deal")
    forget(goal, blocks, cut, fine, extra, stock, quotas)
    return MixPlan(sources.select("key", "source_size", "target"), deal, shards, seed)


_SAME = ["doc_id", "source", "key", "mark"]


def mix_rows(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, key, mark, copy, size and u of every document, as a stored
    table. Equal rows are counted before they are shuffled and numbered after."""
    rows = docs.select("doc_id", "source", _key().alias("key"), F.xxhash64("text").alias("mark"), _size().alias("size"))
    rows = rows.groupBy(*_SAME, "size").agg(F.count("*").alias("n"))
    rows = rows.select(*_SAME, "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return stored(rows.withColumn("u", _order(seed)), "mix-rows")


def _numbered_copies(held: DataFrame, rows: DataFrame) -> DataFrame:
    """``held`` (doc and the columns of ``_SAME``) with ``copy``, the numbers of
    ``mix_rows``. Only rows that come more than once are looked up and moved, and a
    row that comes very often is numbered in each input partition by itself."""
    often = rows.filter("copy = 2").select(*[F.col(c).alias(f"r_{c}") for c in _SAME])
    if often.isEmpty():
        return held.withColumn("copy", F.lit(1).cast("long"))
    often = _sent(stored(often, "mix-repeats"))
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("key") == F.col("r_key")) & (F.col("mark") == F.col("r_mark"))
    alone = held.join(often, same, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    many = stored(held.join(often, same, "left_semi").withColumn("part", F.spark_partition_id()), "mix-repeated")
    own = Window.partitionBy(*_SAME, "part")
    many = many.withColumn("place", F.row_number().over(own.orderBy(F.xxhash64("doc"))))
    ahead = Window.partitionBy("key", "mark", "doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = many.groupBy("key", "mark", "doc_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sizes = sizes.select(F.col("key").alias("s_key"), F.col("mark").alias("s_mark"), F.col("doc_id").alias("s_id"), F.col("part").alias("s_part"), "before")
    there = (F.col("key") == F.col("s_key")) & (F.col("mark") == F.col("s_mark")) & F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("part") == F.col("s_part"))
    many = many.join(_sent(sizes), there).select("doc", *_SAME, (F.col("before") + F.col("place")).alias("copy"))
    return alone.unionByName(many)


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 16, seed: int = 11) -> DataFrame:
    """Per document: doc_id, size, source_size, target, the words taken, and how
    many copies the shards hold."""
    rows = mix_rows(docs, seed)
    plan = plan_mix(docs, weights, most, shards, seed, rows)
    out = plan.with_copies(rows).join(_sent(plan.sources), "key", "left")
    return out.select("doc_id", "size", "source_size", "target", (F.size("dealt") * F.col("size")).cast("long").alias("taken"), F.size("dealt").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 16, seed: int = 11, keep_plan_columns: bool = True) -> DataFrame:
    """Every copy that the mix takes: the columns of ``docs``, and ``mix_shard`` and
    ``mix_order``. Rows are dealt to tasks by shard and stretch of its order, and
    shuffled (sorted by ``mix_order``) there; a shard is never in one task."""
    rows = mix_rows(docs, seed)
    plan = plan_mix(docs, weights, most, shards, seed, rows)
    held = docs.select(whole_row(docs).alias("doc"), "doc_id", "source", _key().alias("key"), F.xxhash64("text").alias("mark"))
    held = _numbered_copies(held, rows).withColumn("u", _order(seed)).select("doc", "key", "u")
    forget(rows)
    held = plan.with_copies(held).select("doc", "u", F.explode("dealt").alias("copy"))
    held = held.select("doc", F.col("copy.mix_shard").alias("mix_shard"), F.xxhash64(F.lit(seed), "u", "copy.pass").alias("mix_order"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stretch = F.shiftright("mix_order", 44) * F.lit(max(1, -(-4 * parts // shards))) / F.lit(1 << 20)
    held = held.withColumn("stretch", F.floor(stretch)).repartition("mix_shard", "stretch").sortWithinPartitions("mix_shard", "mix_order")
    own = ["mix_shard", "mix_order"] if keep_plan_columns else []
    return held.select(*columns_of("doc", [c for c in docs.columns if c not in own]), *own)
