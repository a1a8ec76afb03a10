"""Near copies among embeddings by NN-descent.

Every vector holds a list of near neighbours. Lists start from blocks of vectors that lie side by side in the order of random
projections, and get better by joins: two neighbours of one vector are likely to be near each other. Lists whose last
entry still is above the threshold are saturated and grow. Joins go on until the lists no longer change. Pairs above the
threshold are the links; an audit against brute force on a sample tells whether another start is needed, and the job fails rather
than return links below the bound. Lists drop pairs, bridges do not: each block of vectors that is compared leaves a forest over all its
pairs above the threshold. Components with saturated lists are compared with each other where their centres are near, and
whole, in blocks.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.components import components
from tablegauge.session import drop_path, scratch_path

log = logging.getLogger(__name__)

#: Neighbours in a list, at first; a saturated list doubles in each round, up to the second figure.
NEIGHBOURS, MOST_NEIGHBOURS = 6, 48
#: Vectors of a block in a random order, and orders that are shuffled at a time.
BLOCK, ORDERS = 48, 8
#: The share of pairs at the threshold that may have another code in all orders of a start; the joins find most of them.
APART = 0.003
#: The lists have come to rest when at most this share of the entries is new.
MOVING = 0.001
#: The audit: a recall below the bound starts anew; after so many starts the job fails.
LEAST_RECALL, STARTS = 0.98, 8
#: Vectors of the sample besides the root of all; linked ones that the sample of all should hold, and how often it may be widened for them.
AUDITED, LINKED, WIDENED = 150, 50, 8
#: Vectors in a block of a group that is compared whole.
CHUNK = 256


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(rows, -1) if rows else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if rows else x


def _batch(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


#: A pair without a cosine is a bridge: both ends are in one component.
_PAIR = {"a": pa.int64(), "b": pa.int64(), "cosine": pa.float64()}
_PAIRS = "a long, b long, cosine double"
_EDGE = {"a": pa.int64(), "b": pa.int64()}
_EDGES = "a long, b long"
_COUNT = {"id": pa.int64(), "n": pa.int64()}
_COUNTS = "id long, n long"


def bits_of(rows: int) -> int:
    """Bits of an order's code in a label of so many vectors: half a block to a code. None where one block holds all."""
    return max(0, math.ceil(math.log2(rows / (BLOCK // 2)))) if rows > BLOCK else 0


def orders_of(rows: int, least: float) -> int:
    """Random orders of a label of so many vectors, so that a pair at the threshold has one code in at least one, but for ``APART``."""
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits_of(rows)
    return math.ceil(math.log(APART) / math.log1p(-same)) if same < 1 else 1


def _ordered(dimension: int, seed: int, first: int, least: float) -> Callable:
    """Each vector with its place in its label's random orders from ``first``: sign bits of projections, then one more projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        for batch in batches:
            x = _unit(batch.column("vec"))
            for n in set(batch.column("rows").to_pylist()) - known.keys():
                known[n] = bits_of(n), orders_of(n, least)
            bits, orders = np.array([known[n] for n in batch.column("rows").to_pylist()], np.int64).reshape(-1, 2).T
            for t in range(first, min(first + ORDERS, int(orders.max(initial=0)))):
                at = np.flatnonzero(orders > t)
                most = int(bits[at].max())
                planes = np.random.default_rng([seed, t]).normal(size=(64, dimension))[:most + 1]
                side = x[at] @ planes.T  # the first projection gives the place inside a code
                code = (((side[:, 1:] > 0) & (np.arange(most) < bits[at, None])).astype(np.int64) << np.arange(most)).sum(axis=1)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(np.full(len(at), t, np.int32)), pa.array(code), pa.array(side[:, 0]), part.column("id"), part.column("vec")],
                    names=["label", "t", "code", "place", "id", "vec"],
                )

    return run


def _forest(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` (groups, size) and who is near whom in a group: each id with the smallest of its component, but that one itself."""
    low = ids
    while True:
        least = np.minimum(low, np.where(near, low[:, None, :], np.iinfo(np.int64).max).min(axis=2))
        if (least == low).all():
            return ids[low != ids], low[low != ids]
        low = least


def _with_bridges(pairs: tuple[np.ndarray, ...], bridges: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b, cosine = pairs
    cosines = pa.array(np.concatenate([cosine, np.zeros(len(bridges[0]))]), mask=np.arange(len(a) + len(bridges[0])) >= len(a))
    return _batch(_PAIR, np.concatenate([a, bridges[0]]), np.concatenate([b, bridges[1]]), cosines)


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    np.fill_diagonal(sims, -2)
    k = min(most, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], sims[:0, 0]
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel()


def _in_blocks(most: int, least: float) -> Callable:
    """Rows in order: pairs of near vectors inside blocks of neighbours in that order, half of each block shared with the next."""

    def pairs(held: list[tuple]) -> pa.RecordBatch:
        ids = np.array([h[0] for h in held])
        x = np.stack([h[1] for h in held])
        sims = x @ x.T
        bridges = _forest(ids[None], (sims >= least)[None])
        return _with_bridges(_best(ids, sims, most), bridges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            x = _unit(batch.column("vec"))
            for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("t").to_pylist())):
                if key != current or len(held) == BLOCK:
                    if len(held) > 1:
                        yield pairs(held)
                    held = held[BLOCK // 2:] if key == current else []
                    current = key
                held.append((batch.column("id")[k].as_py(), x[k]))
        if len(held) > 1:
            yield pairs(held)

    return run


def _joined(least: float) -> Callable:
    """Rows in order of ``mid``: pairs of its neighbours that are better than the last entry of the first one's list, and bridges."""
    limit = 20_000

    def pairs(mid: np.ndarray, ids: np.ndarray, last: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[0], np.flatnonzero(np.diff(mid)) + 1, [len(mid)]])
        sizes = np.diff(first)
        left, right, cosines, bridges = [], [], [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            groups = first[:-1][sizes == size][:, None] + np.arange(size)
            for part in np.array_split(groups, max(1, groups.size * int(size) // 400_000)):
                sims = np.matmul(x[part], x[part].transpose(0, 2, 1))
                sims[:, np.arange(size), np.arange(size)] = -2
                near = sims >= least
                tied = near.any(axis=(1, 2))
                bridges.append(_forest(ids[part[tied]], near[tied]))
                g, i, j = np.nonzero(sims > last[part][:, :, None])
                left.append(ids[part[g, i]])
                right.append(ids[part[g, j]])
                cosines.append(sims[g, i, j])
        if not left:
            return _batch(_PAIR, [], [], [])
        found = np.stack([np.concatenate(left), np.concatenate(right)], axis=1)
        found, at = np.unique(found, axis=0, return_index=True)
        bridges = np.unique(np.concatenate([np.stack(f, axis=1) for f in bridges]), axis=0)
        return _with_bridges((found[:, 0], found[:, 1], np.concatenate(cosines)[at]), (bridges[:, 0], bridges[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            held.append((batch.column("mid").to_numpy(), batch.column("id").to_numpy(), batch.column("last").to_numpy(), _unit(batch.column("vec"))))
            count += len(held[-1][0])
            if count >= limit:
                mid, ids, last, x = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(mid == mid[-1], True)) if mid[0] != mid[-1] else 0
                if cut:  # the last group may go on in the next batch
                    yield pairs(mid[:cut], ids[:cut], last[:cut], x[:cut])
                held, count = [(mid[cut:], ids[cut:], last[cut:], x[cut:])], len(mid) - cut
        if count:
            yield pairs(*(np.concatenate(c) for c in zip(*held)))

    return run


def _lists(pairs: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """The best entries of each list and all bridges: (a, b, cosine, new, bridge, rank, size), of other bridges without cosine. ``sizes`` has (a, size) of the lists that are larger than usual."""
    unique = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min("new").alias("new"), F.max("bridge").alias("bridge"))
    if sizes is None:
        unique = unique.withColumn("size", F.lit(NEIGHBOURS))
    else:
        unique = unique.join(sizes, "a", "left").withColumn("size", F.coalesce("size", F.lit(NEIGHBOURS)))
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("cosine"), "b")))
    listed = F.col("cosine").isNotNull() & (F.col("rank") <= F.col("size"))
    return ranked.withColumn("cosine", F.when(listed, F.col("cosine"))).filter("cosine is not null or bridge").select("a", "b", "cosine", "new", "bridge", "rank", "size")


def _starts(vectors: DataFrame, dimension: int, seed: int, first: int, least: float) -> DataFrame:
    sized = vectors.join(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "label")
    placed = sized.mapInArrow(_ordered(dimension, seed, first, least), "label long, t int, code long, place double, id long, vec " + vectors.schema["vec"].dataType.simpleString())
    keys = ["label", "t", "code", "place", "id"]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_in_blocks(NEIGHBOURS, least), _PAIRS)


def _round(vectors: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Neighbours of neighbours: pairs of entries of one vector's list, and of vectors whose lists it is on.

    A vector among whose neighbours nobody is new has been through this with the same ones.
    """
    reverse = lists.select(F.col("b").alias("mid"), F.col("a").alias("id"), "cosine", "new", "size")
    # of those whose lists a vector is on, as many as its own list holds; dealt out first, so that a hub is cut down in many tasks
    slot = F.pmod(F.xxhash64("id"), F.lit(16))
    near = Window.partitionBy("mid", "slot").orderBy(F.desc("cosine"), "id")
    cut = reverse.withColumn("slot", slot).withColumn("rank", F.row_number().over(near)).filter("rank <= size")
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("mid").orderBy(F.desc("cosine"), "id"))).filter("rank <= size")
    members = lists.select(F.col("a").alias("mid"), F.col("b").alias("id"), "new").unionByName(cut.select("mid", "id", "new"))
    members = members.groupBy("mid").agg(F.collect_set("id").alias("ids"), F.max("new").alias("new")).filter("new")
    members = members.select("mid", F.explode(F.array_union("ids", F.array("mid"))).alias("id"))
    # a list that is short takes any pair
    last = lists.groupBy(F.col("a").alias("id")).agg(F.when(F.count(F.lit(1)) < NEIGHBOURS, -2.0).otherwise(F.min("cosine")).alias("last"))
    rows = members.join(vectors.select("id", "vec").join(last, "id"), "id").select("mid", "id", "last", "vec")
    return rows.repartition("mid").sortWithinPartitions("mid").mapInArrow(_joined(least), _PAIRS)


def _against(queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, label, weight = (batch.column(c).to_numpy() for c in ("id", "label", "weight"))
            near = (queries @ _unit(batch.column("vec")).T >= least) & (labels[:, None] == label) & (ids[:, None] != own)
            yield _batch(_COUNT, ids, near.astype(np.int64) @ weight)

    return run


def audited_recall(vectors: DataFrame, counts: DataFrame, least: float) -> float:
    """The share of sampled vectors with links whose links all are in ``counts`` (id, n); 1 without any.

    The lower share of two samples: of all vectors and of those linked in ``counts``. Each vector counts once, however many links
    it has. The samples grow with the root of the rows; where links are rare, that of all is widened so that it can hold some.
    """
    order = F.xxhash64("id", F.lit(7))
    linked = counts.filter("n > 0").select("id")
    rows, known = vectors.count(), linked.count()
    size = AUDITED + math.isqrt(rows)
    wide = min(size * WIDENED, max(size, math.ceil(LINKED * rows / max(known, 1))))
    picked = linked.orderBy(order).limit(size).withColumn("of_all", F.lit(False)).unionByName(vectors.select("id").orderBy(order).limit(wide).withColumn("of_all", F.lit(True)))
    picked = picked.groupBy("id").agg(F.max("of_all").alias("of_all"))
    sample = vectors.join(F.broadcast(picked), "id").select("id", "label", "vec").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1.0
    ids, labels = (sample.column(c).to_numpy() for c in ("id", "label"))
    true = vectors.mapInArrow(_against(_unit(sample.column("vec").combine_chunks()), ids, labels, least), _COUNTS).groupBy("id").agg(F.sum("n").alias("true"))
    judged = true.filter(F.col("true") > 0).join(counts, "id", "left").join(picked, "id").withColumn("whole", F.coalesce("n", F.lit(0)) >= F.col("true"))
    r = judged.agg(*(F.count_if(c).alias(n) for n, c in (
        ("all", F.col("of_all")), ("all_whole", F.col("of_all") & F.col("whole")), ("linked", F.col("n") > 0), ("linked_whole", (F.col("n") > 0) & F.col("whole")))
    )).first()
    log.info("audit: %d of %d linked vectors whole in a sample of %d of all, %d of %d among the linked", r["all_whole"], r["all"], wide, r["linked_whole"], r["linked"])
    return min(r[f"{k}_whole"] / r[k] if r[k] else 1.0 for k in ("all", "linked"))


def _whole(least: float) -> Callable:
    """Rows in order of (group, low, high, part): per vector the weight of those at least that near in the other part."""
    def counts(rows: list[tuple], low: int, high: int) -> pa.RecordBatch:
        ids, weights, parts = (np.array([r[k] for r in rows]) for k in range(3))
        x = np.stack([r[3] for r in rows])
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if low != high:
            near &= parts[:, None] != parts
        return _batch(_COUNT, ids, near.astype(np.int64) @ weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current = None
        for batch in batches:
            x = _unit(batch.column("vec"))
            columns = [batch.column(c).to_pylist() for c in ("component", "low", "high", "id", "weight", "part")]
            for k, (c, low, high, i, w, p) in enumerate(zip(*columns)):
                if (c, low, high) != current:
                    if rows:
                        yield counts(rows, *current[1:])
                    rows, current = [], (c, low, high)
                rows.append((i, w, p, x[k]))
        if rows:
            yield counts(rows, *current[1:])

    return run


def _finite(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, some component not zero (and its square neither)."""
    sound = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    length = F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.coalesce(sound & (length > 0) & (length < float("inf")), F.lit(False))


def embedding_classes(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, ``n_links``, ``component_id`` and ``kept`` (it is the smallest of its component).

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least ``least``. Null, empty
    and zero vectors, those with null or non-finite components, of a squared length beyond double precision, and rows with a
    null vec_id link with nothing; a null vec_id has a null class. Only vectors of one length are compared. One row per row;
    equal vectors of one label count as linked and are compared once. Extra columns are ignored; an empty table gives an
    empty one. Every returned link is at or above ``least``; links may be missed, see ``audited_recall``. A recall
    below ``LEAST_RECALL`` after ``STARTS`` starts raises.
    """
    spark = rows.sparkSession
    base = scratch_path(spark, "embeddings")
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))
    sound = F.coalesce(_finite(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    marked = plain.withColumn("sound", sound).withColumn("digest", F.xxhash64("vec"))
    marked.filter("sound").groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).write.parquet(f"{base}/vectors")
    vectors = spark.read.parquet(f"{base}/vectors")
    lengths = [r["d"] for r in vectors.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]

    for d in lengths or [1]:
        _links_of(vectors.filter(F.size("vec") == d), d, least, f"{base}/length-{d}")
    reached = spark.read.parquet(*(f"{base}/length-{d}/reached" for d in lengths or [1])).withColumnRenamed("component", "component_id")
    counted = spark.read.parquet(*(f"{base}/length-{d}/counts" for d in lengths or [1]))
    per_class = vectors.join(counted, "id", "left").join(reached, "id", "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    found = marked.filter("sound").join(per_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links_of(vectors: DataFrame, dimension: int, least: float, base: str) -> None:
    """Writes ``reached`` (id, component) and ``counts`` (id, n) of the linked vectors of one length."""
    spark = vectors.sparkSession
    pairs, sizes, kept, lists = None, None, None, None
    number = 0
    most = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    for start in range(STARTS):
        first, round_ = 0, 0
        while True:
            if first < orders_of(most, least):
                fresh = _starts(vectors, dimension, 100 + start, first, least)
                first += ORDERS
            else:
                fresh, round_ = _round(vectors, lists, least), round_ + 1
            fresh = fresh.withColumn("new", F.lit(True)).withColumn("bridge", F.col("cosine").isNull())
            if kept is not None:
                # entries of the start, from all its orders, are new to the first join
                joined = F.lit(False) if round_ else F.col("new")
                fresh = fresh.unionByName(kept.select("a", "b", "cosine", joined.alias("new"), "bridge"))
            path = f"{base}/{number}"
            _lists(fresh, sizes).write.parquet(path)
            if pairs:
                drop_path(spark, pairs)
            pairs, number = path, number + 1
            kept = spark.read.parquet(pairs)
            lists = kept.filter("cosine is not null")
            if first < orders_of(most, least):
                continue
            # a saturated list is not waited for: its component is compared whole
            full = lists.filter((F.col("cosine") >= least) & (F.col("rank") == F.col("size")))
            state = lists.join(full.select("a").distinct(), "a", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.count_if("new").alias("new")).first()
            log.info("start %d, join %d: %d entries, %d of them new", start, round_, state["n"], state["new"])
            if state["new"] <= MOVING * state["n"]:
                break
            grown = full.filter(F.col("size") < MOST_NEIGHBOURS).select("a", (2 * F.col("size")).alias("size")).distinct()
            sizes = _larger(sizes, grown, f"{base}/sizes-{number}")
        near = lists.filter(F.col("cosine") >= least)
        both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both.write.parquet(f"{base}/links-{start}")
        found = spark.read.parquet(f"{base}/links-{start}")
        saturated = near.filter(F.col("rank") >= NEIGHBOURS).select(F.col("a").alias("id")).distinct()
        edges = found.filter("a < b").unionByName(kept.filter("bridge").select("a", "b"))
        of = components(edges)
        across = _across(vectors, of, of.join(saturated, "id").select("component").distinct(), least, f"{base}/across-{start}")
        of = components(edges.unionByName(across)) if across.limit(1).count() else of
        _counts(vectors, found, of, saturated, least).write.parquet(f"{base}/counts-{start}")
        counts = spark.read.parquet(f"{base}/counts-{start}")
        recall = audited_recall(vectors, counts, least)
        log.info("start %d: recall %.4f", start, recall)
        if recall >= LEAST_RECALL:
            of.write.parquet(f"{base}/reached")
            counts.write.parquet(f"{base}/counts")
            drop_path(spark, pairs)
            return
    raise RuntimeError(f"{STARTS} starts found {recall:.4f} of the links of the sample, not {LEAST_RECALL}")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], vec: str, others: tuple[str, ...]) -> Iterator[tuple]:
    """Rows in order of ``keys``, group by group: the key, the vectors and the other columns as arrays."""
    held: list[tuple] = []
    current = None
    for batch in batches:
        x = _unit(batch.column(vec))
        rest = [batch.column(c).to_pylist() for c in others]
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
            if key != current:
                if held:
                    yield current, np.stack([h[0] for h in held]), [np.array(c) for c in zip(*(h[1:] for h in held))]
                held, current = [], key
            held.append((x[k], *(c[k] for c in rest)))
    if held:
        yield current, np.stack([h[0] for h in held]), [np.array(c) for c in zip(*(h[1:] for h in held))]


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cosine = (_unit(batch.column("vec")) * _unit(batch.column("centre"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["component", "angle"])


def _close(least: float) -> Callable:
    """Centres with radii, in order of (label, low, high): pairs of components whose members can be near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = math.acos(max(-1.0, min(1.0, least))) + 1e-6
        for _, x, (ids, radii) in _groups(batches, ("label", "low", "high"), "centre", ("component", "radius")):
            i, j = np.nonzero((np.arccos(np.clip(x @ x.T, -1, 1)) <= radii[:, None] + radii + reach) & (ids[:, None] < ids))
            yield _batch(_EDGE, ids[i], ids[j])

    return run


def _touch(least: float) -> Callable:
    """Members of two components, block by block: the pair of components where a pair of members is near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b, _, _), x, (sides,) in _groups(batches, ("a", "b", "p", "q"), "vec", ("component",)):
            if (x[sides == a] @ x[sides == b].T >= least).any():
                yield _batch(_EDGE, [a], [b])

    return run


def _across(vectors: DataFrame, of: DataFrame, full: DataFrame, least: float, base: str) -> DataFrame:
    """(a, b): pairs of the components ``full`` that hold a link, whatever the lists know of it.

    A component's centre is the member that names it, its radius the angle to the farthest one. Pairs that are too far apart
    for a link by these are left out; all others are compared member by member, in blocks.
    """
    spark = vectors.sparkSession
    inside = of.join(full, "component")
    parts = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = inside.join(parts, "component").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    dealt.join(vectors.select("id", "label", "vec"), "id").write.parquet(f"{base}/members")
    members = spark.read.parquet(f"{base}/members")
    centres = members.filter("id = component").select("component", "label", "parts", F.col("vec").alias("centre"))
    by_part = centres.select("component", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "centre")
    angles = members.join(by_part, ["component", "part"]).select("component", "vec", "centre").mapInArrow(_angles, "component long, angle double")
    radii = angles.groupBy("component").agg(F.max("angle").alias("radius"))
    blocks = centres.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks"))
    met = centres.join(radii, "component").join(blocks, "label").withColumn("block", F.expr("cast(pmod(xxhash64(component), blocks) as int)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "component", "radius", "centre"
    )
    keys = ["label", "low", "high"]
    met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_close(least), _EDGES).distinct().write.parquet(f"{base}/close")
    close = spark.read.parquet(f"{base}/close")
    if not close.limit(1).count():
        return close
    sized = close.join(parts.select(F.col("component").alias("a"), F.col("parts").alias("ps")), "a").join(parts.select(F.col("component").alias("b"), F.col("parts").alias("qs")), "b")
    tasks = sized.withColumn("p", F.explode(F.expr("sequence(0, ps - 1)"))).withColumn("q", F.explode(F.expr("sequence(0, qs - 1)"))).select("a", "b", "p", "q")
    held = members.select("component", "part", "vec")
    sides = tasks.withColumn("component", F.col("a")).withColumn("part", F.col("p")).unionByName(tasks.withColumn("component", F.col("b")).withColumn("part", F.col("q")))
    keys = ["a", "b", "p", "q"]
    sides.join(held, ["component", "part"]).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_touch(least), _EDGES).distinct().write.parquet(f"{base}/links")
    return spark.read.parquet(f"{base}/links")


def _counts(vectors: DataFrame, links: DataFrame, of: DataFrame, saturated: DataFrame, least: float) -> DataFrame:
    """(id, n): the weight of the vectors linked with each. Components that hold a saturated list are compared whole, in blocks
    of ``CHUNK`` vectors against each other, so that their figures do not depend on the length of any list."""
    weights = vectors.select("id", "weight")
    full = of.join(saturated, "id").select("component").distinct()
    inside = of.join(full, "component")
    parts = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = inside.join(parts, "component").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).join(vectors.select("id", "vec", "weight"), "id")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "id", "weight", "part", "vec"
    )
    keys = ["component", "low", "high"]
    whole = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_whole(least), _COUNTS)
    rest = links.join(inside.select(F.col("id").alias("a")), "a", "left_anti").join(weights.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("weight").alias("n"))
    return whole.unionByName(rest).groupBy("id").agg(F.sum("n").alias("n"))


def _larger(sizes: DataFrame | None, full: DataFrame, path: str) -> DataFrame:
    """Sizes of lists with the new ones of ``full``, written, so that a round reads them and not the rounds before."""
    (full if sizes is None else sizes.unionByName(full).groupBy("a").agg(F.max("size").alias("size"))).write.parquet(path)
    return full.sparkSession.read.parquet(path)


def oracle() -> str:
    """DuckDB SQL for the classes of ``embeddings``: all pairs within a label, and what their links reach."""
    return """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS (SELECT vec_id, label, e, len(e) AS d, list_sum(list_transform(e, lambda x: x * x)) AS q FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE a.q > 0 AND b.q > 0 AND list_dot_product(a.e, b.e) / (sqrt(a.q) * sqrt(b.q)) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, least(vec_id, coalesce(m.b, vec_id)) = vec_id AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN m ON m.a = vec_id"""
