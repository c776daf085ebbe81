"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores, one per list: each list holds a part of the
vectors' components. Candidates lie in blocks; a block's lists are dealt to tasks
one by one, with the same part of the queries, and none knows another's scores.

1. Every list of a block names its best entries per query, and its least score.
   Put side by side they give lower bounds, with the least score where an entry
   is missing: the k-th best of all is a score that k candidates reach.
2. That bound, divided evenly among the lists, goes to all of them as the cutoff
   of a query. Each list gives the entries that reach it: a candidate that
   reaches it in no list cannot be among the best. Sums and the cutoff bound
   the rest from above, and candidates that cannot reach the k-th best go.
3. The missing partial scores of the others are resolved exactly.

(Cao and Wang, 2004; scores may be negative, since the cutoff bounds the sum by
itself.) A list is scored again in phase 2: keeping it sorted would write an entry
for every query and candidate. Equal vectors are candidates by their k + 1 smallest
ids only, so a vector that fills much of the table costs no more than another.

Vectors so long that a score might exceed 62 bits meet the others in a path of
their own, with whole numbers of any length; a score beyond 64 bits counts as the
largest or smallest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, stored

#: The sum of a vector's magnitudes from which its scores may not fit 62 bits.
LONGEST = float(1 << 31)
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
#: Entries that a block's list names per query in the first phase.
DEPTH = 128
#: Groups over which candidate blocks are dealt; query blocks go to each of them.
GROUPS = 32
NEVER = -(1 << 63)

Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """``(row, vec_id, v, w)`` with ``v = floor(scale * x)``, or the same as whole doubles in ``w`` where the vector is too long for 62 bits.

    Vectors that are null, empty or hold null or non-finite components are left out.
    """
    x = ref(vector_column)
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    # A product with a power of two keeps all digits, so the remainder cuts off just what lies beyond the point.
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(F.when(F.abs(c) < float(1 << 53), c)).cast("double")).otherwise(c))
    rows = df.where(finite & (F.size(x) > 0)).select(as_long(id_column).alias("vec_id"), whole.alias("w"))
    length = F.aggregate("w", F.lit(0.0), lambda s, c: s + F.abs(c))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        F.when(length < LONGEST, F.transform("w", lambda c: F.when(length < LONGEST, c).cast("int"))).alias("v"),
        F.when(length >= LONGEST, F.col("w")).alias("w"),
    )


def _blocks(name: str, size: int, lists: int, cutoffs: bool = False, kind: str = "int32") -> Batches:
    """Vectors of one dimension as matrices of up to ``size`` rows, a matrix per list; a block is named after its first row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            matrix = np.array([r[1] for r in rows], kind)
            edges = [dim * j // lists for j in range(lists + 1)]
            numbers = np.array([r[0] for r in rows], np.int64).tobytes()
            parts = [np.ascontiguousarray(matrix[:, a:b]).tobytes() for a, b in zip(edges, edges[1:])]
            columns = [[dim] * lists, list(range(lists)), [rows[0][0]] * lists, [numbers] * lists, parts]
            names = ["dim", "list", f"{name}_block", f"{name}_rows", f"{name}_matrix"]
            if cutoffs:
                columns.append([np.array([r[2] for r in rows], np.int64).tobytes()] * lists)
                names.append("cutoffs")
            types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            cuts = batch.column("cutoff").to_pylist() if cutoffs else [None] * batch.num_rows
            for row, v, cut in zip(batch.column("row").to_pylist(), batch.column("v").to_pylist(), cuts):
                own = held.setdefault(len(v), [])
                own.append((row, v, cut))
                if len(own) == size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def _candidate_blocks(rows: DataFrame, lists: int, kind: str = "int32") -> DataFrame:
    schema = "dim int, list int, c_block bigint, c_rows binary, c_matrix binary"
    blocks = rows.select("row", "v").mapInArrow(_blocks("c", CANDIDATES_PER_BLOCK, lists, kind=kind), schema)
    return blocks.withColumn("group", F.pmod(F.xxhash64("c_block"), F.lit(GROUPS)).cast("int"))


def _query_blocks(rows: DataFrame, lists: int, kind: str = "int32") -> DataFrame:
    with_cutoffs = "cutoff" in rows.columns
    schema = "dim int, list int, q_block bigint, q_rows binary, q_matrix binary" + (", cutoffs binary" if with_cutoffs else "")
    blocks = rows.mapInArrow(_blocks("q", QUERIES_PER_BLOCK, lists, with_cutoffs, kind), schema)
    return blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))


def _pairs(offered: DataFrame, asking: DataFrame) -> DataFrame:
    """Each list of each block of candidates beside the same list of the queries' blocks."""
    return offered.join(asking, ["group", "dim", "list"])


def _list_scores(batch: pa.RecordBatch, i: int):
    """Query rows, candidate rows and the scores (queries x candidates) that one list gives, exact."""
    import numpy as np

    q_rows, c_rows = (np.frombuffer(batch.column(n)[i].as_buffer(), np.int64) for n in ("q_rows", "c_rows"))
    q, c = (np.frombuffer(batch.column(f"{n}_matrix")[i].as_buffer(), np.int32).reshape(len(r), -1) for n, r in (("q", q_rows), ("c", c_rows)))
    small = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1] < 1 << 53  # then sums of doubles are exact
    kind = np.float64 if small else np.int64
    return q_rows, c_rows, (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


_NAMED = "q bigint, c_block bigint, ids binary, scores binary, least bigint"


def _first_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A list's best entries per query, and its least score."""
    import numpy as np

    for batch in batches:
        for i, block in enumerate(batch.column("c_block").to_pylist()):
            q_rows, c_rows, scores = _list_scores(batch, i)
            depth = min(DEPTH, len(c_rows))
            at = np.argpartition(-scores, depth - 1, axis=1)[:, :depth]
            best = np.take_along_axis(scores, at, 1)
            columns = [q_rows, [block] * len(q_rows), [c.tobytes() for c in c_rows[at]], [b.tobytes() for b in best], scores.min(axis=1)]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["q", "c_block", "ids", "scores", "least"])


def _lower_bounds(k: int) -> Batches:
    """The k largest lower bounds of a query in a block, from the entries that its lists named."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            qs, bounds = [], []
            for q, named in zip(batch.column("q").to_pylist(), batch.column("named").to_pylist()):
                ids, at = np.unique(np.concatenate([np.frombuffer(n["ids"], np.int64) for n in named]), return_inverse=True)
                above = np.concatenate([np.frombuffer(n["scores"], np.int64) - n["least"] for n in named])
                sums = np.full(len(ids), sum(n["least"] for n in named), np.int64)
                np.add.at(sums, at, above)
                best = np.sort(sums[ids != q])[::-1][:k].tolist()
                qs += [q] * len(best)
                bounds += best
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(bounds, pa.int64())], ["q", "bound"])

    return run


def _enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a list that reach the cutoff of their query."""
    import numpy as np

    for batch in batches:
        for i, number in enumerate(batch.column("list").to_pylist()):
            q_rows, c_rows, scores = _list_scores(batch, i)
            cutoffs = np.frombuffer(batch.column("cutoffs")[i].as_buffer(), np.int64)
            qs, cs = np.nonzero((scores >= cutoffs[:, None]) & (q_rows[:, None] != c_rows[None, :]))
            columns = [q_rows[qs], c_rows[cs], np.full(len(qs), number, np.int32), scores[qs, cs]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["q", "c", "list", "score"])


def _long_scores(k: int) -> Batches:
    """The best k scores of each query in a block and all that equal the last, in whole numbers of any length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def whole(batch: pa.RecordBatch, i: int, name: str, n: int):
            matrix = np.frombuffer(batch.column(f"{name}_matrix")[i].as_buffer(), np.float64).reshape(n, -1)
            return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(n, -1)

        for batch in batches:
            for i in range(batch.num_rows):
                q_rows, c_rows = (np.frombuffer(batch.column(n)[i].as_buffer(), np.int64) for n in ("q_rows", "c_rows"))
                c = whole(batch, i, "c", len(c_rows))
                for q, vector in zip(q_rows.tolist(), whole(batch, i, "q", len(q_rows))):
                    scores = np.array([min(max(x, NEVER), -NEVER - 1) for x in c @ vector], np.int64)[c_rows != q]
                    others = c_rows[c_rows != q]
                    if len(others):
                        kept = scores >= np.sort(scores)[-min(k, len(scores))]
                        columns = [np.full(kept.sum(), q, np.int64), others[kept], scores[kept]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["q", "c", "score"])

    return run


_ENTRY = "q bigint, c bigint, list int, score bigint"


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query; ranked before the shuffle too, so a query's rows need not meet."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _kth(rows: DataFrame, k: int, bound: str) -> DataFrame:
    """``(q, bound)``: the k-th largest bound of each query that has k."""
    best = _best(rows, k, F.col(bound).desc())
    return best.groupBy("q").agg(F.min(bound).alias(bound), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("q", bound)


def _with_long(candidates: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """``(q, c, score)``: the best of all pairs of which one vector, or both, is too long for the lists."""
    long, whole = F.col("w").isNotNull(), F.coalesce("w", F.col("v").cast("array<double>")).alias("v")

    def best(offered: DataFrame, asked: DataFrame) -> DataFrame:
        blocks = _pairs(_candidate_blocks(offered.select("row", whole), 1, "float64"), _query_blocks(asked.select("row", whole), 1, "float64"))
        return blocks.mapInArrow(_long_scores(k), "q bigint, c bigint, score bigint")

    return best(candidates.where(long), asking).union(best(candidates.where(~long), asking.where(long)))


def top_k(
    df: DataFrame, k: int = 5, queries: Column | None = None, id_column: str = "vec_id", vector_column: str = "embedding", lists: int = 2
) -> DataFrame:
    """Each query's k highest integer inner products: ``query_id, rank, vec_id, score``.

    ``queries`` selects the rows that ask (by ``vec_id`` and ``v``, the integer
    vector; all if not given). Every row but the query's own is a candidate, also
    one of the same id; ties go to the smaller id, null ids last. A query gets
    fewer rows if there are fewer candidates of its dimension, none if there is none.
    """
    everything = stored(integer_vectors(df, id_column, vector_column), "vectors")
    alike = Window.partitionBy("v", "w").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    candidates = stored(everything.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n"), "candidates")
    asking_all = everything if queries is None else everything.where(queries)
    vectors, asking = everything.where(F.col("v").isNotNull()), asking_all.where(F.col("v").isNotNull())
    offered = stored(_candidate_blocks(candidates.where(F.col("v").isNotNull()), lists), "vector-blocks")

    # 1: local lists, and a score that k candidates reach.
    first = _pairs(offered, _query_blocks(asking.select("row", "v"), lists)).mapInArrow(_first_lists, _NAMED)
    named = first.groupBy("q", "c_block").agg(F.collect_list(F.struct("ids", "scores", "least")).alias("named"))  # one for each list
    reached = stored(_kth(named.select("q", "named").mapInArrow(_lower_bounds(k), "q bigint, bound bigint"), k, "bound"), "first-lists")
    # 2: the cutoff goes to the blocks with the queries, and enough entries come back.
    cutoff = F.coalesce(F.ceil(F.col("bound") / lists), F.lit(NEVER))
    asking_on = asking.join(reached.withColumnRenamed("q", "row"), "row", "left")
    asking_on = stored(asking_on.select("row", "v", "vec_id", "bound", cutoff.alias("cutoff")), "cutoffs")
    pairs = _pairs(offered, _query_blocks(asking_on.select("row", "v", "cutoff"), lists))
    enough = pairs.mapInArrow(_enough, _ENTRY).groupBy("q", "c").agg(F.sum("score").alias("known"), F.count(F.lit(1)).alias("n"))
    enough = stored(enough, "enough-entries")
    better = _kth(enough.where(F.col("n") == lists).withColumnRenamed("known", "total"), k, "total")
    bounds = asking_on.select(F.col("row").alias("q"), "bound", "cutoff").join(better, "q", "left")
    bounds = bounds.withColumn("needed", F.coalesce(F.greatest("bound", "total"), F.lit(NEVER))).select("q", "cutoff", "needed")
    most = F.col("known") + (lists - F.col("n")) * (F.col("cutoff") - 1)
    left = enough.join(bounds, "q").where((F.col("n") == lists) & (F.col("known") >= F.col("needed")) | (F.col("n") < lists) & (most >= F.col("needed")))
    # 3: the missing scores of what is left.
    exact = left.where(F.col("n") == lists).select("q", "c", F.col("known").alias("score"))
    product = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a.cast("bigint") * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    rest = (
        left.where(F.col("n") < lists)
        .select("q", "c")
        .join(vectors.select(F.col("row").alias("c"), F.col("v").alias("cv")), "c")
        .join(asking.select(F.col("row").alias("q"), F.col("v").alias("qv")), "q")
        .select("q", "c", product.alias("score"))
    )
    found = exact.union(rest)
    if not candidates.where(F.col("w").isNotNull()).isEmpty():
        found = found.union(_with_long(candidates, asking_all, k))
    named = found.join(everything.select(F.col("row").alias("c"), "vec_id"), "c")
    ranked = _best(named, k, F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("c"))
    return ranked.join(asking_all.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id")), "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
