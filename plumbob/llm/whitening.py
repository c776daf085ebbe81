"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred matrix X (a row for each distinct vector) is never multiplied by
itself. From a unit vector v, rows give u = Xv and then Xᵀu, by turns, and both
series are orthogonalised against all their earlier members, so that
X V = U B with an upper bidiagonal B. The singular values and right vectors of
the small B, turned back by V, are the standard deviations and components of X.

An u has an entry for each row and is never stored: it is a combination of
earlier products Xv, hence u = Xw with a short w, and a task computes the entries
of its rows when it needs them. A step is one pass over the rows that brings
back the products of the raw Xv with the earlier u, its length and its Xᵀ
product: sums of as many numbers as a vector has, added up within each task. A
second pass follows where orthogonalising takes away most of the length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, scratch

#: Rows of a block of vectors, as bytes of a block.
BLOCK_BYTES = 1 << 20
#: Entries are clipped here, far beyond any that a sum of squares can use.
LARGEST = 1 << 62
#: Lengths below this share of the greatest are zero.
ZERO = 1e-12
#: What is left of a length that is orthogonalised once only.
ONCE = 0.1

SCALE, SHIFT = 64, 1_000_000


def whole_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: entries c as floor(64 c) + 1,000,000.

    Rows whose vector is null or holds null or non-finite entries are left out;
    so are vectors of another length than most rows have (of equally frequent
    lengths the greater counts), and vectors without entries. Entries beyond
    2^62 in size are taken as that. Repeated rows and null ids stay.
    """
    entries = F.transform(ref(vector_column), lambda c: c.cast("double"))
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))

    def whole(c: Column) -> Column:
        scaled = c * float(SCALE)
        clipped = F.least(F.greatest(scaled, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
        return F.floor(clipped) + F.lit(SHIFT)

    rows = df.select(as_long(id_column).alias("vec_id"), entries.alias("entries")).where(
        F.col("entries").isNotNull() & ~F.coalesce(odd, F.lit(True)) & (F.size("entries") > 0)
    )
    sizes = rows.groupBy(F.size("entries").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1)
    width = sizes.collect()
    size = width[0]["size"] if width else 0
    return rows.where(F.size("entries") == size).select("vec_id", F.transform("entries", whole).alias("x"))


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of equal length as blocks of 4 or 8 bytes an entry, with sums of their entries in two parts."""
    import numpy as np

    for batch in batches:
        column = batch.column("x")
        width = len(column[0]) if batch.num_rows else 1
        rows = max(1, BLOCK_BYTES // (8 * width))
        for start in range(0, batch.num_rows, rows):
            x = np.asarray(column.slice(start, rows).flatten()).reshape(-1, width)
            high, low = x >> 31, x & ((1 << 31) - 1)
            small = "<i4" if abs(x).max() < 1 << 31 else "<i8"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(x)], pa.int64()),
                    pa.array([width], pa.int32()),
                    pa.array([small], pa.string()),
                    pa.array([x.astype(small).tobytes()], pa.binary()),
                    pa.array([high.sum(0).tolist()], pa.list_(pa.int64())),
                    pa.array([low.sum(0).tolist()], pa.list_(pa.int64())),
                ],
                ["rows", "width", "kind", "x", "high", "low"],
            )


BLOCKS = "rows bigint, width int, kind string, x binary, high array<bigint>, low array<bigint>"


def _unpack(batches: Iterable[pa.RecordBatch], n: int, sums: list[int]):
    """The centred rows x - S/n of each block, from whole numbers as long as they are exact."""
    import numpy as np

    total = np.array(sums, object)
    for batch in batches:
        for kind, width, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "width", "x"))):
            yield _centred(np.frombuffer(raw, kind).astype(np.int64).reshape(-1, width), n, total)


def _exact(x, n: int, total):
    """n x - S, whole; as Python's integers where 64 bits are too few."""
    import numpy as np

    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, total), default=0) < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def _centred(x, n: int, total):
    import numpy as np

    return (_exact(x, n, total) / n).astype(np.float64)


class FitList:
    """Each distinct vector once, in blocks on the shared folder, with their number and sums."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        path = scratch(spark, "vectors")
        vectors.select("x").distinct().mapInArrow(_pack, BLOCKS).write.parquet(path)
        self.blocks = spark.read.schema(BLOCKS).parquet(path)
        parts = self.blocks.select("rows", F.posexplode(F.arrays_zip("high", "low")).alias("place", "part"))
        # At most a row per dimension.
        found = (
            parts.groupBy("place")
            .agg(*(F.sum(F.col(f"part.{p}").cast("decimal(38,0)")).alias(p) for p in ("high", "low")), F.sum("rows").alias("n"))
            .orderBy("place")
            .collect()
        )
        self.n = found[0]["n"] if found else 0
        self.sums = [(int(r["high"]) << 31) + int(r["low"]) for r in found]
        self.width = len(self.sums)

    def totals(self, of_rows: Callable) -> "numpy.ndarray":  # noqa: F821
        """Sums over all blocks of what ``of_rows(centred rows)`` returns, a vector of set length."""
        n, sums = self.n, self.sums

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            total = 0.0
            for rows in _unpack(batches, n, sums):
                total = total + of_rows(rows)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

        import numpy as np

        parts = self.blocks.select("kind", "width", "x").mapInArrow(run, "place int, value double")
        found = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(found.num_rows)
        out[found.column("place").to_numpy()] = found.column("value").to_numpy()
        return out


def _step(v, w) -> Callable:
    """Of r = Xv: its products with the earlier u = Xw, its squared length and Xᵀr."""

    def run(rows):
        import numpy as np

        r = rows @ v
        return np.concatenate([(rows @ w).T @ r, [r @ r], rows.T @ r])

    return run


def bidiagonalise(fit: FitList, steps: int | None = None, seed: int = 1) -> tuple:
    """``(V, alphas, betas)`` with X V = U B, B upper bidiagonal of these.

    All directions are found, in as many steps as a vector has entries, also
    where singular values are equal: where a series ends, another starts at
    right angles to it. Fewer ``steps`` leave out what is not found by then.
    """
    import numpy as np

    d = fit.width
    rng = np.random.default_rng(seed)

    def fresh(basis):
        v = rng.standard_normal(d)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        return v / np.linalg.norm(v)

    basis, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w of u = Xw, Xᵀu
    alphas, betas, greatest = [], [], 0.0
    v = fresh(basis)
    for _ in range(min(d, steps or d)):
        basis = np.column_stack([basis, v])
        k = short.shape[1]
        w = v
        before = 0.0
        for again in range(3):
            found = fit.totals(_step(w, short))
            along, length, product = found[:k], found[k], found[k + 1 :]
            w = w - short @ along
            rest = math.sqrt(max(length - along @ along, 0.0))
            before = max(before, math.sqrt(length))
            greatest = max(greatest, before)
            if rest >= ONCE * math.sqrt(length) or rest <= ZERO * greatest:
                break
        product = product - back @ along
        if rest <= ZERO * greatest:  # nothing but what is known: u is zero
            alphas.append(0.0)
            short, back = np.column_stack([short, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
            product = np.zeros(d)
        else:
            alphas.append(rest)
            short = np.column_stack([short, w / rest])
            product = product / rest
            back = np.column_stack([back, product])
            product = product - rest * v
        if basis.shape[1] == d:
            break
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        beta = float(np.linalg.norm(product))
        if beta <= ZERO * greatest:
            betas.append(0.0)
            v = fresh(basis)
        else:
            betas.append(beta)
            v = product / beta
    return basis, alphas, betas


class Whitening:
    """Components by falling eigenvalue, and what a table needs of them."""

    def __init__(self, fit: FitList, components: int = 16, steps: int | None = None):
        import numpy as np

        self.n, self.sums = fit.n, fit.sums
        self.components, self.deviations = np.zeros((fit.width, 0)), np.zeros(0)
        self.explained, self.identity_error = np.zeros(0), 0.0
        if not fit.n:
            return
        basis, alphas, betas = bidiagonalise(fit, steps)
        bidiagonal = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
        _, sizes, turned = np.linalg.svd(bidiagonal)
        kept = min(components, int((sizes > 1e-10 * max(sizes[0], 1e-300)).sum()))
        self.components = basis @ turned[:kept].T
        self.deviations = sizes[:kept] / math.sqrt(fit.n)
        if not kept:
            return
        scaled = self.scaled()

        def squares(rows):
            y = rows @ scaled
            return np.concatenate([[(rows * rows).sum()], y.sum(0), (y.T @ y).ravel()])

        found = fit.totals(squares) / fit.n
        mean, product = found[1 : kept + 1], found[kept + 1 :].reshape(kept, kept)
        self.explained = self.deviations**2 / found[0]
        self.identity_error = float(np.abs(product - np.outer(mean, mean) - np.eye(kept)).max())

    def scaled(self):
        return self.components / self.deviations


def _whitened(n: int, sums: list[int], scaled) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.array(sums, object)
        width = len(sums)
        for batch in batches:
            step = max(1, BLOCK_BYTES // (8 * width))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.asarray(part.column("x").flatten()).reshape(-1, width)
                exact = _exact(x, n, total)
                apart = [sum(v * v for v in row) for row in exact.tolist()]
                y = (exact / n).astype(np.float64) @ scaled
                texts = pa.array([str(a) for a in apart], pa.string())
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), texts, values], ["vec_id", "deviation", "whitened"])

    return run


def whitened_vectors(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """``(vec_id, deviation decimal(38,0), whitened array<double>)`` of the rows of :func:`whole_vectors`.

    ``deviation`` is the sum over dimensions of (n x - S)^2, exact; null beyond 38 digits.
    """
    run = _whitened(fitted.n, fitted.sums, fitted.scaled())
    rows = vectors.mapInArrow(run, "vec_id bigint, deviation string, whitened array<double>")
    return rows.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whiten(df: DataFrame, components: int = 16, steps: int | None = None) -> DataFrame:
    """Per row of a table of vectors and component: its whitened coordinate and the fit's figures.

    See :func:`whole_vectors` for which rows take part. Components without any
    variance are left out, so a table of one distinct vector, or of none, gives
    no rows. ``deviation`` is null where a long is too small.
    """
    vectors = whole_vectors(df)
    fitted = Whitening(FitList(vectors), components, steps)
    names = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not len(fitted.explained):
        return df.sparkSession.createDataFrame([], names)
    shares = F.array(*(F.lit(float(e)) for e in fitted.explained))
    return whitened_vectors(vectors, fitted).select(
        "vec_id", F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )
