"""What every filter of a corpus removes, in every order of the filters.

A document fails some subset of the filters, its mask. All questions about
orders follow from how many documents of a part have each mask: a subset-zeta
transform turns these counts into survivors for every subset of filters (those
whose mask is disjoint from it), and a step of an order is the difference of two
subsets that differ by one filter. Labels are counted alike, so what a step
costs in good or toxic documents is the same difference. Shapley values are
differences weighed by the number of orders that hold them.

Texts are read once, for masks and a digest. Copies are found without a join:
rows of one text, part and label shrink to counts in the map tasks, with the
smallest id among them, so a group of copies with a third of all rows is a few
rows after its shuffle. Masks of a part are at most 2^filters rows.

Defined cases: a null text is empty; a null part is the empty string; repeated
rows (same id, same text) are each counted and are no copies of each other; a
row with a null id is no copy and no row is a copy of it, and it has no labels;
of several label rows of an id the largest label counts, null labels are 0; an
empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK_WORD_GAP = r"[\x20\x09-\x0D]+"
#: More filters would make 2^n masks a part and n! orders.
MOST_FILTERS = 8


def text_filters() -> dict[str, tuple]:
    """The filters that look at one text, by name: columns that are true where a
    document fails. They use ``t`` (the text) and ``w`` (its words)."""
    words, points = F.size("w"), F.length("t")
    capitals = points - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": words < 200,
        "B": 100 * F.size(F.array_distinct("w")) < 50 * words,
        "C": 100 * capitals.cast("long") > 2 * points,
        "D": F.col("t").rlike(r"[#$%&*|]"),
    }


def _mask(filters: dict[str, Column]) -> Column:
    """Bit i is set where the i-th filter fails the document (null counts as kept)."""
    return sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(filters.values())), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: bool = True, part_col: str = "source", measures: dict[str, str] | None = None) -> DataFrame:
    """Rows (part, mask, n, one count per measure). With ``copies`` the last bit
    is set for rows whose text some smaller id has. ``measures`` names label columns
    of ``labels`` that are counted where they are 1."""
    filters = text_filters() if filters is None else filters
    measures = {"good": "quality", "toxic": "toxic"} if measures is None else measures
    rows = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", _BLANK_WORD_GAP), ""))
    rows = rows.select("doc_id", "part", _mask(filters).alias("mask"), F.sha2("t", 256).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(m) for m, c in measures.items()])
    # Rows without an id meet no label; their digest spreads them over the tasks of the join.
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marks = marks.withColumn("label_spread", F.lit(0).cast("long"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left").drop("label_id", "label_spread", "spread")
    rows = rows.fillna(0, list(measures))
    if copies:
        # Here an id has one row for each text and part, so the least row holds the count at the least id.
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
        nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
        same = rows.groupBy("digest", "part", "mask", *measures).agg(F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless"))
        least = F.min("first.doc_id").over(Window.partitionBy("digest"))
        same = same.withColumn("kept", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
        both = F.array(F.struct("mask", F.col("kept").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
        rows = same.select("part", *measures, F.explode(both).alias("m")).select("part", *measures, "m.mask", "m.n")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(m)).alias(m) for m in measures])


def survivors(counts: DataFrame, n_filters: int, measures: list[str]) -> DataFrame:
    """Per part and measure (``n`` among them) an array over subsets of filters:
    at place S + 1 the documents whose mask is disjoint from S. ``{measure}_exact``
    holds the counts of the masks themselves."""
    if not 0 < n_filters <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters")
    full = (1 << n_filters) - 1
    places = F.sequence(F.lit(0), F.lit(full))

    def dense(measure: str) -> Column:
        found = F.map_from_entries(F.collect_list(F.struct("mask", F.col(measure).cast("long").alias("v"))))
        return F.transform(places, lambda s: F.coalesce(F.element_at(found, s), F.lit(0).cast("long")))

    exact = counts.groupBy("part").agg(*[dense(m).alias(f"{m}_exact") for m in measures])
    bits = F.array(*[F.lit(1 << i) for i in range(n_filters)])

    def zeta(measure: str) -> Column:
        # After all bits, place T holds the sum over the subsets of T.
        def one_bit(acc: Column, bit: Column) -> Column:
            return F.transform(acc, lambda v, s: v + F.when(s.bitwiseAND(bit) != 0, F.element_at(acc, s - bit + 1)).otherwise(F.lit(0).cast("long")))

        below = F.aggregate(bits, F.col(f"{measure}_exact"), one_bit)
        return F.reverse(below)  # survivors of S are the masks below its complement

    return exact.select("part", *[f"{m}_exact" for m in measures], *[zeta(m).alias(m) for m in measures])


def _shapley(bit: Column, n_filters: int) -> Column:
    """What the filter ``bit`` removes, summed over all orders: |S|! (n-1-|S|)!
    orders have exactly S before it."""
    weigh = F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)).cast("long") for k in range(n_filters)])
    subsets = F.filter(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)), lambda s: s.bitwiseAND(bit) == 0)
    gain = lambda s: F.element_at("n", s + 1) - F.element_at("n", s + bit + 1)
    return F.aggregate(subsets, F.lit(0).cast("long"), lambda acc, s: acc + F.element_at(weigh, F.bit_count(s) + 1) * gain(s))


def audit_orders(counts: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant (failing
    the filter but gone before), unique_fails (failing no other filter), what each
    measure loses here as ``{measure}_lost``, and the filter's shapley sum."""
    if any(len(x) != 1 for x in names) or len(set(names)) != len(names):
        raise ValueError("filters need different names of one letter")
    k = len(names)
    table = survivors(counts, k, ["n", *measures])
    alphabet = "".join(names)
    place = lambda letter: F.instr(F.lit(alphabet), letter)
    bit_at = lambda at: F.call_function("shiftleft", F.lit(1), at - 1)
    # Filters first: their own figures do not depend on the order.
    per = F.transform(F.array(*[F.lit(1 << i) for i in range(k)]), lambda b: F.struct(_shapley(b, k).alias("shapley"), F.element_at("n_exact", b + 1).alias("unique_fails"), (F.element_at("n", F.lit(1)) - F.element_at("n", b + 1)).alias("fails")))
    table = table.withColumn("per", per)
    orders = ",".join("".join(p) for p in permutations(names))
    table = table.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    table = table.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc + bit_at(place(x)))
    table = table.withColumn("before", before).withColumn("at", place(F.element_at(letters, F.col("step"))))
    after = F.col("before") + bit_at(F.col("at"))
    lost = lambda m: F.element_at(m, F.col("before") + 1) - F.element_at(m, after + 1)
    own = F.element_at("per", F.col("at"))
    return table.select(
        "part", "filter_order", "step",
        F.element_at("n", after + 1).alias("kept"), lost("n").alias("removed"), (own["fails"] - lost("n")).alias("redundant"),
        own["unique_fails"].alias("unique_fails"), *[lost(m).alias(f"{m}_lost") for m in measures], own["shapley"].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to D on texts and E, identical to the text of a
    smaller id, for every part, order and step."""
    names = [*text_filters(), "E"]
    return audit_orders(mask_counts(docs, labels), names, ["good", "toxic"])
