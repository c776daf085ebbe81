"""Near copies by the Jaccard similarity of their word shingles, joined over adaptive prefixes.

Two sets link when ``100 * intersection >= threshold * union``. Shingles have one
order for all documents, rare ones first. Sets that link share a shingle of their
prefixes, and if each prefix is longer by l - 1 shingles, they share l of them.
Each document chooses its l by an estimate of what its candidates would cost (Wang,
Li and Feng, 2012), and a pair is a candidate once it shares as many prefix shingles
as the smaller of the two l, and its sizes allow a link.

1. One scan hashes the sets, identifies equal ones, and counts shingles in a table
   of set size: the order, and the estimate. Only its buckets reach the driver.
2. A second scan gives each distinct set's prefix, by shingle. Shingles with many
   holders by the estimate are dealt out over salted tiles. Each posting carries
   a sketch of its whole set, which bounds from below in how many shingles two
   sets differ.
3. While shingles have many holders in different components, rounds that cost one
   pair per posting: in each tile every member is compared with one of them, first
   with that which has most of its prefix in common with others, as the original
   of altered copies has. Groups of near copies fall together into components
   here. Rounds end when one leaves most pairs as they were.
4. What shares a prefix shingle and is not yet in one component is compared in
   full. Links are lost nowhere: a pair is left out only if its ends are already
   in one component, or its sizes, its sketches or shared prefixes rule a link out.

Sets are identified, and shingles compared, by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, count_slices, count_table, releasing, stored, text_blocks
from plumbob.llm.graph import connected_components

SHINGLE = 5
THRESHOLD = 80
#: Buckets of the table of counts, as a power of two. The driver and each worker hold it once.
BUCKET_BITS = 22
#: Marks of the texts whose sets are hashed again, as a power of two.
MARK_BITS = 20
#: The most shared shingles that a prefix asks for.
MOST_SHARED = 16
#: Other holders of a shingle that the table of counts cannot show.
UNSEEN = 0.2
#: A comparison moves whole sets: its cost in postings, per shingle of the set.
VERIFY_COST = 0.25
#: Estimated holders of a shingle per tile.
TILE = 1000
#: Sets and texts a task remembers to have sent; only saves sending them again.
REMEMBERED = 100_000
#: Rounds of one pair per posting go on while there are so many pairs per posting, and while a round leaves less than a share of them.
CROWDED = 2
STAR_GAIN = 0.8
SALTS = 16
#: Near copies are looked up by broadcast up to this many, and by shuffle beyond.
BROADCAST_KEYS = 200_000


def _buckets(hashes, bits: int):
    import numpy as np

    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


#: Columns of a set's sketch, 64 bits each: for each value of the hashes' last bits, whether an odd number of shingles has it.
SKETCH = ("s0", "s1", "s2", "s3")


def _sketches(sets) -> list[pa.Array]:
    import numpy as np

    bits = 64 * len(SKETCH)
    marks = np.zeros((len(sets), bits), np.uint8)
    for row, own in zip(marks, sets):
        row[:] = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    words = np.packbits(marks, axis=1).view("<i8").reshape(len(sets), len(SKETCH))
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(SKETCH))]


def _identity(own) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _hash_sets(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from plumbob.llm.shingles import shingle_sets

        names = ["doc_id", "text_key", "cls", "n_shingles", *SKETCH, "slice", "counts"]
        counts, any_text = np.zeros(1 << bits, np.int32), False
        for batch, block in text_blocks(batches):
            sets = shingle_sets(block, SHINGLE)
            np.add.at(counts, _buckets(np.concatenate(sets), bits), 1)
            any_text = True
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([_identity(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *_sketches(sets),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        if any_text:
            part = count_slices(counts)
            empty = [pa.nulls(part.num_rows, pa.int64())] * (4 + len(SKETCH))
            yield pa.RecordBatch.from_arrays([*empty, part.column(0), part.column(1)], names)

    return run


def needed_overlap(n: int, threshold: int = THRESHOLD) -> int:
    """The least a set of n shares with any set it links with."""
    return -(-threshold * n // 100)


def choose_prefix(estimates, n: int, threshold: int) -> tuple[int, int]:
    """``(l, length)`` of least cost; ``estimates`` are the other holders of the first shingles, in order.

    A prefix costs its length, and the postings it meets; each candidate must be
    met l times, so about one l-th of the postings are left to compare.
    """
    import numpy as np

    need = needed_overlap(n, threshold)
    shared = np.arange(1, min(MOST_SHARED, need) + 1)
    length = n - need + shared
    postings = np.cumsum(estimates + UNSEEN)[length - 1]
    best = int(np.argmin(length + postings + VERIFY_COST * n * postings / shared))
    return int(shared[best]), int(length[best])


def _compact(counts) -> tuple[int, bytes]:
    """The usual count, and the counts in 32 bits, packed: a worker unpacks them without a second copy."""
    import numpy as np

    return int(np.median(counts)), zlib.compress(np.minimum(counts, (1 << 31) - 1).astype("<i4").tobytes(), 1)


def _prefixes(table, bits: int, threshold: int, tile: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from plumbob.llm.shingles import shingle_sets

        usual, packed = table.value
        counts = np.frombuffer(zlib.decompress(packed), "<i4")
        sent: set[int] = set()
        for _, block in text_blocks(batches):
            shingles, heads, lengths = [], [], []
            for own in shingle_sets(block, SHINGLE):
                if not len(own):
                    continue
                cls = _identity(own)
                if cls in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(cls)
                n = len(own)
                held = counts[_buckets(own, bits)]
                order = np.argsort(held, kind="stable")  # rare first, then by hash
                longest = n - needed_overlap(n, threshold) + MOST_SHARED
                first = order[:longest]
                estimates = np.maximum(held[first] - usual, 0)
                shared, length = choose_prefix(estimates, n, threshold)
                shingles.append(own[first[:length]])
                heads.append((cls, n, shared))
                lengths.append((length, 1 + estimates[:length] // tile))
            if not heads:
                continue
            repeat = [x for x, _ in lengths]
            columns = [np.concatenate(shingles).view(np.int64), np.concatenate([t for _, t in lengths]).astype(np.int32)]
            columns += [np.repeat(np.array(c, np.int64), repeat) for c in zip(*heads)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "tiles", "cls", "n", "l"])

    return run


def _postings(docs: DataFrame, table, bits: int, threshold: int, tile: int) -> DataFrame:
    """Prefix shingles that several distinct sets hold: ``shingle, tile, tiles, cls, n, l``.

    The holders of one shingle are in one tile, or spread over several by the
    estimate; a tile of several stays even if it has a single holder.
    """
    rows = docs.select("text").mapInArrow(releasing(_prefixes(table, bits, threshold, tile)), "shingle bigint, tiles int, cls bigint, n bigint, l bigint")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).repartition("shingle", "tile")
    once = rows.groupBy("shingle", "tile", "cls").agg(*(F.first(c).alias(c) for c in ("tiles", "n", "l")))
    # Counted with the rows of a tile together, where the exchange has put them.
    held = once.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("shingle", "tile")))
    return held.where("holders > 1 OR tiles > 1").drop("holders")


def _described(postings: DataFrame, hashed: DataFrame, threshold: int) -> DataFrame:
    """Postings with their set's sketch and ``share``, what of its prefix others hold too: more in an original than in its altered copies."""
    length = F.col("n") - F.ceil(F.col("n") * threshold / 100) + F.col("l")
    held = postings.groupBy("cls").agg(F.count(F.lit(1)).alias("held"))
    sketches = hashed.where("cls IS NOT NULL").groupBy("cls").agg(*(F.first(s).alias(s) for s in SKETCH))
    return postings.join(held.join(sketches, "cls"), "cls").withColumn("share", F.round(F.col("held") / length, 2)).drop("held")


def _near_enough(a: str, b: str, threshold: int):
    """Sizes and sketches that allow a link. Each shingle that one set has alone changes at most one bit of the difference."""
    n_a, n_b = (x.format("n") for x in (a, b))
    differ = sum(F.bit_count(F.col(a.format(s)).bitwiseXOR(F.col(b.format(s)))) for s in SKETCH)
    sizes = 100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)
    return sizes & ((100 + threshold) * differ <= (100 - threshold) * (F.col(n_a) + F.col(n_b)))


def _sets(wanted) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from plumbob.llm.shingles import shingle_sets

        marked = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        sent: set[int] = set()
        for batch in batches:
            keys = np.asarray(batch.column("text_key")).view(np.uint64)
            part = batch.filter(pa.array(marked[_buckets(keys, MARK_BITS)]))
            for _, block in text_blocks([part]):
                found = {}
                for own in shingle_sets(block, SHINGLE):
                    if len(own) and (cls := _identity(own)) not in sent:
                        found[cls] = own.tobytes()
                sent.update(found)
                if len(sent) >= REMEMBERED:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["cls", "elements"])

    return run


def _fetch_sets(docs: DataFrame, hashed: DataFrame, classes: DataFrame) -> tuple[DataFrame, object]:
    """``(cls, elements)`` of the given sets, hashed again from texts that a table of their keys lets through; and that broadcast table."""
    import numpy as np

    keys = hashed.join(classes, "cls").groupBy("cls").agg(F.min("text_key").alias("text_key"))
    buckets = keys.select(F.shiftrightunsigned("text_key", 64 - MARK_BITS).alias("bucket")).distinct()
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[np.asarray(buckets.toArrow().column("bucket"))] = True  # at most as many rows as buckets
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(marks).tobytes())
    found = docs.select("text_key", "text").mapInArrow(releasing(_sets(wanted)), "cls bigint, elements binary")
    return found.join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("elements").alias("elements")), wanted


def _compare(threshold: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _verified(docs: DataFrame, hashed: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """``(a, b)`` of the pairs whose whole sets link. Only their sets are hashed again and moved."""
    pairs = stored(pairs.select("a", "b"), "candidates")
    if pairs.isEmpty():
        return pairs
    classes = stored(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "candidate-sets")
    sets, wanted = _fetch_sets(docs, hashed, classes)
    rows = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a")
    rows = rows.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b")
    found = rows.select("a", "b", "x", "y").mapInArrow(releasing(_compare(threshold)), "a bigint, b bigint, linked boolean")
    links = stored(found.where("linked").drop("linked"), "links")
    wanted.unpersist()
    return links


def _enough_shared():
    """Candidates share as many prefix shingles as the smaller prefix asks for."""
    return F.col("shared") >= F.least("l_a", "l_b")


def _labelled(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    """Postings with the component of each set; sets without links are components by themselves."""
    if components is None:
        return postings.withColumn("label", F.col("cls"))
    return postings.join(components, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _pairs_apart(postings: DataFrame) -> float:
    """How many pairs share a prefix shingle and lie in different components, counted per shingle."""
    n = F.col("n").cast("double")
    sizes = postings.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.sum(n).alias("all"), F.sum(n * n).alias("same"))
    return sizes.agg(F.sum(F.col("all") * F.col("all") - F.col("same"))).first()[0] or 0.0


def _star_pairs(postings: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Candidates among pairs of a member and its tile's, or a tile's and its shingle's, first one."""
    parts = ("k", "cls", "n", "l", "label", *SKETCH)
    by_label = F.xxhash64("label", F.lit(turn)) if turn % 2 else F.lit(0).cast("bigint")
    rows = postings.withColumn("k", F.struct(by_label, -F.col("share"), F.xxhash64("cls", F.lit(turn))))

    def first(df: DataFrame, *by: str) -> DataFrame:
        found = df.groupBy(*by).agg(F.min(F.struct(*parts)).alias("top"), F.first("tiles").alias("tiles"))
        return found.select(*by, "tiles", F.inline(F.array("top"))).toDF(*by, "tiles", *(f"top_{c}" for c in parts))

    tops = first(rows, "shingle", "tile")
    spread = tops.where("tiles > 1").select("shingle", "tiles", *(F.col(f"top_{c}").alias(c) for c in parts))
    names = (*parts[1:], *(f"top_{c}" for c in parts))
    in_tiles = rows.join(tops.drop("tiles"), ["shingle", "tile"]).select(*names)
    over_tiles = spread.join(first(spread, "shingle").drop("tiles"), "shingle").select(*names)
    pairs = in_tiles.union(over_tiles).where("cls <> top_cls AND label <> top_label").where(_near_enough("{}", "top_{}", threshold))
    counted = pairs.groupBy(F.col("top_cls").alias("a"), F.col("cls").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"),
        *(F.first(c).alias(f"{c}_b") for c in ("n", "l")),
        *(F.first(f"top_{c}").alias(f"{c}_a") for c in ("n", "l")),
    )
    return counted.where(_enough_shared()).select("a", "b")


def _remaining_pairs(postings: DataFrame, threshold: int) -> DataFrame:
    """Candidates among all pairs that share a prefix shingle and lie in different components."""
    mixed = postings.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("tiles").alias("tiles"))
    mixed = mixed.where("low <> high").select("shingle")
    rows = postings.join(mixed, "shingle", "left_semi")
    parts = ("cls", "n", "l", "label", *SKETCH)
    left = rows.select("shingle", "tile", *(F.col(c).alias(f"{c}_a") for c in parts))
    # Each holder meets the tiles of its shingle one by one.
    right = rows.select(
        "shingle", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *(F.col(c).alias(f"{c}_b") for c in parts)
    )
    fits = (F.col("label_a") != F.col("label_b")) & (F.col("cls_a") < F.col("cls_b")) & _near_enough("{}_a", "{}_b", threshold)
    met = left.join(right, ["shingle", "tile"]).where(fits)
    counted = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), *(F.first(c).alias(c) for c in ("n_a", "l_a", "n_b", "l_b"))
    )
    return counted.where(_enough_shared()).select("a", "b")


def _linked(df: DataFrame, id_column: str, text_column: str, threshold: int, bits: int, tile: int) -> tuple[DataFrame, DataFrame | None]:
    """Documents as ``doc_id, text_key, cls, n_shingles``, and the components ``(cls, label)`` of linked sets, if any."""
    text = F.coalesce(ref(text_column).cast("string"), F.lit(""))
    docs = df.select(as_long(id_column).alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    spark = df.sparkSession

    sketch = ", ".join(f"{s} bigint" for s in SKETCH)
    schema = f"doc_id bigint, text_key bigint, cls bigint, n_shingles bigint, {sketch}, slice int, counts binary"
    rows = stored(docs.select("doc_id", "text_key", "text").mapInArrow(releasing(_hash_sets(bits)), schema), "shingles")
    hashed = rows.where("slice IS NULL").select("doc_id", "text_key", "cls", "n_shingles", *SKETCH)
    table = spark.sparkContext.broadcast(_compact(count_table(rows.where("slice IS NOT NULL"), 1 << bits)))

    postings = stored(_postings(docs, table, bits, threshold, tile), "all-postings")
    postings = stored(_described(postings, hashed, threshold), "postings")

    links = components = None
    labelled, size, turn, before = _labelled(postings, None), postings.count(), 0, float("inf")
    while True:
        apart = _pairs_apart(labelled)
        crowded = CROWDED * size < apart < STAR_GAIN * before
        pairs = _star_pairs(labelled, turn, threshold) if crowded else _remaining_pairs(labelled, threshold)
        found = _verified(docs, hashed, pairs, threshold)
        turn, before = turn + 1, apart
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            components = stored(connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("label")), "components")
            labelled = _labelled(postings, components)
        if not crowded:
            break
    table.unpersist()
    return hashed, components


def near_components(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, bucket_bits: int = BUCKET_BITS,
    tile: int = TILE,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, the smallest id reachable by links.

    A text of fewer than five words is one shingle; without words, or null, its
    set is empty and it is a component by itself. Rows are told apart by what
    they hold, not by their ids, so repeated rows and ids stay; a null id counts
    for no component's smallest. Other columns are ignored.
    """
    return _with_components(*_linked(df, id_column, text_column, threshold, bucket_bits, tile))


def one_per_group(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, bucket_bits: int = BUCKET_BITS,
    tile: int = TILE,
) -> DataFrame:
    """The rows of ``df`` less the near copies: of each component of linked documents one row stays, of the smallest id.

    Documents without words are linked with nothing and stay. All columns stay
    as they are. Rows are found again by id and a hash of the text.
    """
    hashed, components = _linked(df, id_column, text_column, threshold, bucket_bits, tile)
    rows = hashed.where("cls IS NOT NULL")
    classes = rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    label = F.col("cls")
    if components is not None:
        classes = classes.join(components, "cls", "left")
        label = F.coalesce("label", "cls")
    classes = classes.select("cls", label.alias("label"), "first", "n")
    groups = classes.groupBy("label").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    members = classes.join(groups.select("label", "kept"), "label").select("cls", F.inline(F.array("kept")))
    members = members.select("cls", F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    salted = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(salted, ["cls", "salt"])
    kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    keys = stored(grouped.groupBy("doc_id", "text_key").agg(F.max(kept).alias("kept"), F.count(F.lit(1)).alias("n")), "near-copies")
    keys = keys.where("NOT kept OR n > 1")  # all others stay as they are

    k, t, i = (_fresh(df, f"near_copy_{x}") for x in ("kept", "key", "id"))
    keys = keys.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), F.col("kept").alias(k))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    key = F.xxhash64(F.coalesce(ref(text_column).cast("string"), F.lit("")))
    same = as_long(id_column).eqNullSafe(keys[i]) & (key == keys[t])
    found = df.join(keys, same, "left")
    alone = found.where(F.col(k).isNull()).select(*map(ref, df.columns))
    again = keys.where(F.col(k))
    if again.isEmpty():
        return alone
    # A kept row that is there several times.
    return alone.union(found.where(F.col(k)).dropDuplicates([i, t]).select(*map(ref, df.columns)))


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _with_components(hashed: DataFrame, components: DataFrame | None) -> DataFrame:
    classes = hashed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if components is None:
        together = classes.where("n > 1").select("cls", F.col("least").alias("component_id"))
    else:
        own = classes.join(components, "cls", "left")
        least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"))
        linked = own.where("label IS NOT NULL").select("cls", "label").join(least, "label").select("cls", "component_id")
        alone = own.where("label IS NULL AND n > 1").select("cls", F.col("least").alias("component_id"))
        together = linked.union(alone)
    # Only sets of several documents are here; a set that much of the table has meets its rows in many tasks.
    salted = together.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, ["cls", "salt"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
