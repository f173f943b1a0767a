"""Minimum-trace reconciliation without an inverse, a dense covariance or pairs.

With C the constraints of the hierarchy (an inner node less its children) and W the
covariance of the forecast errors, the reconciled forecasts are
``y - W C' (C W C')^-1 C y``. Conjugate gradients need products with W only, and W =
shrink * diag(E E') + (1 - shrink) * E E' is applied as products with the residuals E:
``E' u`` is one number for each residual time and forecast time, summed by Spark.
So an iteration is two joins along the edges of the hierarchy and two sums; vectors
are tables (node, forecast time, value) from checkpoints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.panel import ensure, settled

#: Part of the diagonal in the covariance, and what is added to it for solvability.
SHRINK, RIDGE = 0.5, 1e-8
_BROADCAST = 1_000_000


def _times(df: DataFrame, time_col: str, name: str) -> tuple[DataFrame, int]:
    """Distinct times with dense numbers, in order; a panel has few beside its rows."""
    found = sorted(r[0] for r in df.select(time_col).distinct().collect() if r[0] is not None)
    table = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(found)], df.select(F.col(time_col).alias(f"__{name}_at")).schema.add(name, "integer")) if found else None
    return table, len(found)


class Mint:
    """Reconciliation of one hierarchy (``parents``: child -> parents) by the
    residuals of its nodes, which lie as one array a node in ``e``."""

    def __init__(self, spark, parents: dict[str, list[str]], tolerance: float = 1e-13, most_rounds: int = 500):
        self.spark, self.tolerance, self.most_rounds = spark, tolerance, most_rounds
        inner = sorted({p for ps in parents.values() for p in ps})
        names = inner + sorted(set(parents) - set(inner))
        self.number = {n: k for k, n in enumerate(names)}
        self.inner = len(inner)
        self.nodes = spark.createDataFrame([(n, k) for n, k in self.number.items()], "__name string, i int")
        self.nodes = F.broadcast(self.nodes) if len(names) <= _BROADCAST else self.nodes
        edges = [(self.number[c], self.number[p]) for c, ps in parents.items() for p in ps]
        self.edges = spark.createDataFrame(edges, "child int, parent int")
        self.edges = F.broadcast(self.edges) if len(edges) <= _BROADCAST else self.edges

    # - residuals -

    def placed(self, df: DataFrame, id_col: str, time_col: str, col: str, name: str) -> tuple[DataFrame, DataFrame, int]:
        """(i, time number, value) of the nodes' rows; missing values are left out."""
        times, n = _times(df, time_col, name)
        ensure(n > 0, "no times")
        rows = df.join(self.nodes, F.col(id_col).cast("string") == F.col("__name")).join(F.broadcast(times), F.col(time_col) == F.col(f"__{name}_at"))
        rows = rows.groupBy("i", name).agg(F.sum(F.col(col).cast("double")).alias("x")).filter("x is not null")
        return rows, times, n

    def residuals(self, df: DataFrame, id_col: str, time_col: str, col: str, folds: int | None = None) -> "Mint":
        """Second moments of the column (missing rows count 0) or, with ``folds``, of
        its deviations from the mean of the other folds; folds are stretches of time
        and count alike."""
        rows, _, n = self.placed(df, id_col, time_col, col, "t")
        folds = min(folds, n) if folds is not None else None
        ensure(folds is None or folds > 1, "two folds and times are needed")
        fold = np.zeros(n, int) if folds is None else np.minimum(np.arange(n) // (n // folds), folds - 1)
        size = np.bincount(fold)
        held = rows.groupBy("i").agg(F.collect_list(F.struct("t", "x")).alias("r"))
        held = held.select("i", F.transform("r", lambda r: r["t"]).alias("t"), F.transform("r", lambda r: r["x"]).alias("x"))

        def dense(batches):
            for pdf in batches:
                out = []
                for t, x in zip(pdf["t"], pdf["x"]):
                    v = np.zeros(n)
                    v[np.asarray(t, int)] = x
                    if folds is not None:
                        part = np.bincount(fold, v, len(size))
                        v = v - ((part.sum() - part) / (n - size))[fold]
                    out.append(v / np.sqrt(size[fold] * len(size)))
                yield pd.DataFrame({"i": pdf["i"], "e": out})

        rows = held.mapInPandas(dense, "i int, e array<double>")
        square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
        self.e, self.span = settled(rows.withColumn("d", square)), n
        return self

    # - products -

    def down(self, p: DataFrame, col: str) -> DataFrame:
        """C' p: (i, k, u) of all nodes."""
        below = p.join(self.edges, F.col("i") == F.col("parent")).select(F.col("child").alias("i"), "k", (-F.col(col)).alias("u"))
        return p.select("i", "k", F.col(col).alias("u")).unionByName(below).groupBy("i", "k").agg(F.sum("u").alias("u"))

    def up(self, w: DataFrame, col: str) -> DataFrame:
        """C w: (i, k, c) of the inner nodes."""
        own = w.filter(F.col("i") < self.inner).select("i", "k", F.col(col).alias("c"))
        below = w.join(self.edges, F.col("i") == F.col("child")).select(F.col("parent").alias("i"), "k", (-F.col(col)).alias("c"))
        return own.unionByName(below).groupBy("i", "k").agg(F.sum("c").alias("c"))

    def spread(self, u: DataFrame, steps: int) -> DataFrame:
        """W u: (i, k, w). Nodes without residuals have the ridge only."""
        held, n = settled(u.join(self.e, "i", "left")), self.span

        def gram(batches):
            total = np.zeros((n, steps))
            for pdf in batches:
                pdf = pdf[pdf["e"].notna()]
                if len(pdf):
                    nodes, at = np.unique(pdf["i"].to_numpy(), return_inverse=True)
                    first = np.full(len(nodes), -1)
                    first[at[::-1]] = np.arange(len(pdf))[::-1]
                    wide = np.zeros((len(nodes), steps))
                    np.add.at(wide, (at, pdf["k"].to_numpy()), pdf["u"].to_numpy())
                    total += np.stack(pdf["e"].to_numpy()[first]).T @ wide
            t, k = np.nonzero(total)
            yield pd.DataFrame({"t": t.astype(np.int32), "k": k.astype(np.int32), "s": total[t, k]})

        sums = np.zeros((n, steps))
        for r in held.mapInPandas(gram, "t int, k int, s double").groupBy("t", "k").agg(F.sum("s").alias("s")).collect():
            sums[r["t"], r["k"]] = r["s"]

        def back(batches):
            for pdf in batches:
                u, k = pdf["u"].to_numpy(float), pdf["k"].to_numpy()
                w = RIDGE * u
                some = np.flatnonzero(pdf["e"].notna().to_numpy())
                if len(some):
                    e = np.stack(pdf["e"].to_numpy()[some])
                    w[some] += SHRINK * pdf["d"].to_numpy(float)[some] * u[some] + (1 - SHRINK) * (e * sums[:, k[some]].T).sum(1)
                yield pd.DataFrame({"i": pdf["i"], "k": pdf["k"], "w": w})

        return held.mapInPandas(back, "i int, k int, w double")

    def _scale(self) -> DataFrame:
        """The diagonal of C diag(W) C', which preconditions the solve."""
        d = self.nodes.select("i").join(self.e.select("i", "d"), "i", "left").select("i", (F.coalesce("d", F.lit(0.0)) + RIDGE).alias("d"))
        below = d.join(self.edges, F.col("i") == F.col("child")).select(F.col("parent").alias("i"), "d")
        return settled(d.filter(F.col("i") < self.inner).unionByName(below).groupBy("i").agg(F.sum("d").alias("m")))

    def reconcile(self, df: DataFrame, id_col: str, time_col: str, col: str) -> DataFrame:
        """(name, time, col) of all nodes at all forecast times."""
        y, times, steps = self.placed(df, id_col, time_col, col, "k")
        grid = self.nodes.select("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
        y = settled(grid.join(y, ["i", "k"], "left").select("i", "k", F.coalesce("x", F.lit(0.0)).alias("y")))
        state = self.up(y, "y").join(self._scale(), "i").select("i", "k", "m", F.lit(0.0).alias("z"), F.col("c").alias("r"), (F.col("c") / F.col("m")).alias("p"))
        state = settled(state)
        first = None
        for _ in range(self.most_rounds):
            ap = self.up(self.spread(self.down(state, "p"), steps), "w")
            state = settled(state.join(ap, ["i", "k"]))
            sums = state.groupBy("k").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("rz"), F.sum(F.col("p") * F.col("c")).alias("pap"), F.sum(F.col("r") * F.col("c") / F.col("m")).alias("rc"), F.sum(F.col("c") * F.col("c") / F.col("m")).alias("cc"))
            rz, pap, rc, cc = np.zeros((4, steps))
            for s in sums.collect():
                rz[s["k"]], pap[s["k"]], rc[s["k"]], cc[s["k"]] = s["rz"], s["pap"], s["rc"], s["cc"]
            first = rz.copy() if first is None else first
            going = (rz > self.tolerance**2 * first) & (pap > 0)
            if not going.any():
                break
            alpha = np.where(going, rz / np.where(going, pap, 1.0), 0.0)
            after = np.maximum(rz - 2 * alpha * rc + alpha * alpha * cc, 0.0)
            beta = np.where(going, after / np.where(going, rz, 1.0), 0.0)
            a, b = (F.element_at(F.lit([float(x) for x in v]), F.col("k") + 1) for v in (alpha, beta))
            r = F.col("r") - a * F.col("c")
            state = state.select("i", "k", "m", (F.col("z") + a * F.col("p")).alias("z"), r.alias("r"), (r / F.col("m") + b * F.col("p")).alias("p"))
        else:
            raise RuntimeError(f"the solve did not settle in {self.most_rounds} rounds")
        moved = self.spread(self.down(state, "z"), steps)
        out = y.join(moved, ["i", "k"], "left").join(self.nodes, "i").join(F.broadcast(times), "k")
        return out.select(F.col("__name").alias(id_col), F.col("__k_at").alias(time_col), (F.col("y") - F.coalesce("w", F.lit(0.0))).alias(col))
