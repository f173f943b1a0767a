"""Near-duplicate embeddings: spherical k-means cells, cosine products in blocks.

Vectors with the same label and the same components are one class, found by a
hash aggregation; the rest works on one vector per class and its number of rows.
Centroids are fitted on a bounded sample (``sample_rows``); every class is
assigned. Two unit vectors with cosine >= t lie within sqrt(2 - 2t) of each
other, so if their nearest centroids differ, one of them is within half of that
of the plane between the two cells. Each vector therefore also visits the cells
whose plane is that near, and comparing the members of a cell with its members
and visitors finds every pair: nothing rests on how well the cells fit.

A cell is compared in blocks of a matrix product, in double precision. Pairs are
not written out: each block adds to the link counts and gives one star of edges.
Cells of more than ``chunk_rows`` are cut, and each pair of chunks is a task.

Defined cases: null labels, null or empty vectors, and vectors of zero length or
with null or non-finite components link with nothing and are kept; vectors of
different length are not compared; a null vec_id has a null component and is
kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import components, contract_edges, stored


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit vectors: centroids of unit length."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        filled = norm > 1e-12
        c[filled] = total[filled] / norm[filled, None]
    return c


def cells_of(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each unit vector, and which cells it visits."""
    sims = x @ c.T
    home = sims.argmax(axis=1)
    gap = sims[np.arange(len(x)), home][:, None] - sims
    apart = np.sqrt(np.maximum(((c * c).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * c @ c.T), 0))[home]
    visits = gap <= reach * apart + 1e-9
    visits[np.arange(len(x)), home] = False
    return home, visits


_CELL_DDL = "label long, dim int, cell int, rep long, weight long, home int, visits binary, v binary"


def _assign(sent, reach: float):
    names = [f.split()[0] for f in _CELL_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            label, dim, rep, weight, vectors = batch.columns
            dims = dim.to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = vectors.take(pa.array(at))
                x = own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                c = centroids.get(int(d), np.ones((1, int(d))))
                home, visits = cells_of(x, c, reach)
                rows = []
                for i, j in enumerate(at):
                    bits, v = np.packbits(visits[i]).tobytes(), x[i].tobytes()
                    for cell in (int(home[i]), *np.flatnonzero(visits[i]).tolist()):
                        rows.append((label[j].as_py(), int(d), cell, rep[j].as_py(), weight[j].as_py(), int(home[i]), bits, v))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                for lo in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array([r[i] for r in rows[lo : lo + 20_000]], t) for i, t in enumerate(types)], names=names)

    return run


_LINK_DDL = "kind int, a long, b long"


def _compare(threshold: float):
    def links(cell: int, chunk: np.ndarray, one: int, two: int, rep: np.ndarray, weight: np.ndarray, home: np.ndarray, visits: np.ndarray, x: np.ndarray):
        left = np.flatnonzero(chunk == one)
        right = np.flatnonzero(chunk == two)
        count = np.zeros(len(rep), np.int64)
        ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            p, q = np.nonzero(x[part] @ x[right].T >= threshold)
            p, q = part[p], right[q]
            keep = p < q if one == two else p != q
            hp, hq = home[p] == cell, home[q] == cell
            keep &= hp | hq
            p, q, hp, hq = p[keep], q[keep], hp[keep], hq[keep]
            # A member and a visitor may meet in the other cell too; the lower cell counts.
            member, visitor = np.where(hp, p, q), np.where(hp, q, p)
            other = home[visitor]
            once = (hp & hq) | ~visits[member, other] | (cell < other)
            p, q = p[once], q[once]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            a, b = contract_edges(np.concatenate([rep[p], ea[0]]), np.concatenate([rep[q], eb[0]]))
            ea, eb = [a], [b]
        some = np.flatnonzero(count)
        return rep[some], count[some], ea[0], eb[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve():
            cell, one, two = held[0][2:5]
            chunk = np.array([r[5] for r in held])
            rep, weight, home = (np.array([r[i] for r in held], np.int64) for i in (6, 7, 8))
            width = len(held[0][9]) * 8
            visits = np.unpackbits(np.frombuffer(b"".join(r[9] for r in held), np.uint8)).reshape(len(held), width).astype(bool)
            x = np.frombuffer(b"".join(r[10] for r in held), np.float64).reshape(len(held), -1)
            node, n, a, b = links(cell, chunk, one, two, rep, weight, home, visits, x)
            kind = np.concatenate([np.zeros(len(node), np.int32), np.ones(len(a), np.int32)])
            return pa.record_batch([pa.array(kind), pa.array(np.concatenate([node, a])), pa.array(np.concatenate([n, b]))], names=["kind", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[:5]
                if key != now:
                    if len(held) > 1:
                        yield solve()
                    now, held = key, []
                held.append(row)
        if len(held) > 1:
            yield solve()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 8192, cell_rows: int = 1024, most_cells: int = 256, chunk_rows: int = 4096) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept (one row per component)."""
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & nonzero, F.lit(False))
    rows = rows.withColumn("good", good).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    fine = rows.filter("good").withColumn("dim", F.size("embedding"))
    key = ["label", "dim", "h1", "h2"]
    classes = stored(fine.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("v")), "vector-classes")
    largest = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("dim", "v").toPandas() if largest else None
    centroids = {}
    for r in largest:
        own = sample[sample["dim"] == r.dim]
        k = min(most_cells, -(-r.n // cell_rows), len(own))
        if k > 1:
            x = np.stack(own["v"].to_numpy()).astype(np.float64)
            centroids[r.dim] = fit_centroids(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    reach = float(np.sqrt(2 - 2 * threshold)) / 2
    sent = spark.sparkContext.broadcast(centroids)
    cells = classes.select("label", "dim", "rep", "weight", "v").mapInArrow(_assign(sent, reach), _CELL_DDL)
    cells = stored(cells, "vector-cells")
    place = ["label", "dim", "cell"]
    sizes = cells.groupBy(*place).agg(F.greatest(F.ceil(F.count("*") / chunk_rows), F.lit(1)).cast("int").alias("chunks"))
    cells = cells.join(F.broadcast(sizes) if sizes.count() <= 500_000 else sizes, place)
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j")))
    cells = cells.withColumn("p", F.explode(pair)).select("label", "dim", "cell", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "chunk", "rep", "weight", "home", "visits", "v")
    task = ["label", "dim", "cell", "i", "j"]
    found = cells.repartition(parts, *task).sortWithinPartitions(*task, "rep").mapInArrow(_compare(threshold), _LINK_DDL)
    found = stored(found, "vector-links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.filter("kind = 1").select("a", "b"), "vector-components").toDF("rep", "root")
    known = classes.select(*key, "rep", "weight").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select(*key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("good"), F.col("label")).alias("label"), F.size("embedding").alias("dim"), "h1", "h2").join(known, key, "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
