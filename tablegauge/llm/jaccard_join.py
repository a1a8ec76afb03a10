"""Near copies by an exact Jaccard join on word shingles, as a grouped prefix join.

The rarest quarter of a document's shingles (its prefix) must share a shingle with the prefix of every document that is
similar enough, under any one order of the shingles. Documents with equal sets are one class, classes with the same prefix and
size one group; groups meet in the lists of their prefix shingles, and the members of groups that met are compared whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.components import components
from tablegauge.llm.memory import frugal
from tablegauge.llm.words import SMALL_BLOCK, blocks, hashes, mix, spans, windows
from tablegauge.session import drop_path, scratch_path

#: Shingles that may be known as frequent: twelve bytes each on every executor, whatever the size of the data.
MOST_FREQUENT = 1 << 20
#: Bits of the filter that tells which documents a second reading must look at: two megabytes, whatever the size of the data.
FILTER_BITS = 1 << 24
#: Shingles that a task holds at once.
HELD = 1 << 20
#: Words of 64 bits in a document's bitmap, which tells most unlike pairs apart before whole sets are fetched.
BITMAP = 16
#: Rounds in which a list that is still open is compared with one of its members, before its rest is compared pairwise.
PIVOTS = 3
#: One hot document is compared by so many tasks.
SALTS = 64

#: Bytes of a row group of the tables written between the steps: what a task's writer holds in memory.
ROW_GROUP = 16 << 20


def _put(df: DataFrame, path: str) -> None:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingles of each text: runs of ``width`` words, or all words as one run where there are fewer."""
    for _, data, offsets in blocks(texts, SMALL_BLOCK):
        starts, ends, rows = spans(data, offsets)
        words = hashes(data, starts, ends)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= width:
                yield np.unique(windows(words[a:b], width))
            else:
                yield windows(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _frequent_in(width: int) -> Callable:
    """Shingles that repeat among the documents of one task, with the number of documents."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["shingle", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for b in batches:
            for s in shingle_sets(b.column("text"), width):
                sets.append(s)
                held += len(s)
                if held > HELD:
                    yield counted(sets)
                    sets, held = [], 0
        if sets:
            yield counted(sets)

    return run


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``MOST_FREQUENT``, sorted, with their counts.

    They only order shingles: which ones are known changes the work, never the result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "frequent")
    local = docs.select("text").mapInArrow(frugal(_frequent_in(width)), "shingle long, docs long")
    _put(local.groupBy("shingle").agg(F.sum("docs").alias("docs")), path)
    counted = spark.read.parquet(path)
    # shingles by the power of a quarter of their documents: some hundred groups, whatever the counts
    level = F.floor(F.log2("docs") * 4).cast("int")
    sizes = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["level"]
    # where even the highest level has too many, none of it is known: never more than ``MOST_FREQUENT`` reach the driver
    found = counted.filter(level >= least if least is not None else F.lit(False)).toArrow()
    drop_path(spark, path)
    values = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], np.minimum(found.column("docs").to_numpy()[order], 1 << 30).astype(np.int32)


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    marks = np.zeros(64 * BITMAP, np.uint8)
    marks[shingles >> np.uint64(64 - (64 * BITMAP).bit_length() + 1)] = 1
    return np.packbits(marks, bitorder="little").view(np.int64)


def _prefixes(width: int, percent: int, frequent) -> Callable:
    """Per document: size and signature of its set, and its prefix, rarest shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            size, first, second, prefix, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n = len(s)
                size.append(n)
                bits.append(_bitmap(s))
                first.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                second.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF))).view(np.int64)) if n else 0)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                prefix.append(s[:n - -(-percent * n // 100) + 1].view(np.int64) if n else s.view(np.int64))
            lengths = np.cumsum([0, *map(len, prefix)])
            maps = np.concatenate(bits) if bits else np.zeros(0, np.int64)
            values = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * BITMAP, pa.int32()), pa.array(maps))],
                names=["doc_id", "n", "first", "second", "prefix", "bits"],
            )

    return run


def _local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of the groups of one task: per shingle one group (``other`` null), and every other one beside it."""
    parts, held = [], 0
    for b in batches:
        lists = b.column("prefix")
        count = np.diff(lists.offsets.to_numpy())
        start = np.repeat(np.cumsum(count) - count, count)
        group, size = (np.repeat(b.column(c).to_numpy(), count) for c in ("grp", "n"))
        parts.append((lists.flatten().to_numpy(), group, size, (np.arange(len(start)) - start).astype(np.int32)))
        held += len(start)
        if held > HELD:
            yield from _by_token(parts)
            parts, held = [], 0
    if held:
        yield from _by_token(parts)


def _by_token(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(x) for x in zip(*parts)]
    parts.clear()
    order = np.lexsort((columns[1], columns[0]))
    for k, column in enumerate(columns):  # one after the other: a task holds few copies
        columns[k] = column[order]
    del column, order
    token, group, size, place = columns
    head = np.ones(len(token), bool)
    head[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1 << 17
    for k in range(0, len(token), step):
        s = slice(k, k + step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token[s]), *(pa.array(x[at[s]]) for x in (group, size, place)), *(pa.array(x[s], mask=head[s]) for x in (group, size, place))],
            names=["token", "a", "a_n", "a_at", "b", "b_n", "b_at"],
        )


_LISTS = "token long, a long, a_n int, a_at int, b long, b_n int, b_at int"


def _may_link(percent: int):
    """Sizes and places in the order leave room for enough shared shingles (exact: no linked pair fails at its first one)."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return (100 * small.cast("long") >= percent * large.cast("long")) & ((100 + percent) * rest.cast("long") >= percent * (F.col("a_n") + F.col("b_n")).cast("long"))


def _roomy(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link: a mark that the other one lacks stands for a shingle that it lacks."""
    left = bitmaps.select(F.col("cls").alias("a"), F.col("n").cast("long").alias("a_n"), F.col("bits").alias("a_bits"))
    right = bitmaps.select(F.col("cls").alias("b"), F.col("n").cast("long").alias("b_n"), F.col("bits").alias("b_bits"))
    both = pairs.join(left, "a").join(right, "b")
    lacking = "aggregate(zip_with({0}_bits, {1}_bits, (x, y) -> bit_count(x & ~y)), 0, (s, v) -> s + v)"
    most = F.least(F.col("a_n") - F.expr(lacking.format("a", "b")), F.col("b_n") - F.expr(lacking.format("b", "a")))
    return both.filter((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def _sets_of(docs: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents ``ends`` and perhaps a few more, told apart by a filter of fixed size."""
    spark = docs.sparkSession
    words = ends.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")).groupBy(F.floor(F.col("slot") / 32).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(slot, 32) as int)))").alias("bits")
    ).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            place = batch.column("slot").to_numpy()
            wanted = np.flatnonzero(marks[place // 32] >> (place % 32) & 1)
            if len(wanted):
                part = batch.take(pa.array(wanted))
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["id", "shingles"])

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")).mapInArrow(frugal(run), "id long, shingles array<long>")


def _compare(percent: int) -> Callable:
    """Rows of (a, salt) in order, the set of ``a`` first (``b`` null): the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.zeros(0, np.int64)
        for batch in batches:
            left, right = [], []
            column = batch.column("shingles")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                shingles = values[offsets[k]:offsets[k + 1]]
                if b is None:
                    current, own = a, shingles.copy()
                elif a == current:
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(shingles) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. A document on many pairs is dealt over ``SALTS`` tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "shingles")
    heads = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    rows = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(frugal(_compare(percent)), "a long, b long")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id): near copies share the smallest doc_id that their links reach.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set has its distinct runs of ``width`` words,
    or all words as one run where there are fewer. Two documents link when ``100 * shared >= percent * union``. Null, empty
    and blank texts have an empty set and link with nothing. Equal sets are always linked. Rows with a null doc_id are in
    the result with a null class and take no part. A repeated doc_id must carry one text; each row comes out. Extra columns
    are ignored. An empty table gives an empty one. No pair, partner or list is capped.

    Copies of one set are compared once. In the list of a shingle every group meets one other, within a task and then across
    tasks; it is compared with the one that it meets most often. Lists whose groups still lie in different components are compared
    with one of their members, some times, and only what is apart after that pairwise. A pair that is left out lies in one
    component already, so the components are those of all links.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(_frequent(rows, width))
    _put(rows.mapInArrow(frugal(_prefixes(width, percent, frequent)), "doc_id long, n int, first long, second long, prefix array<long>, bits array<long>"), f"{base}/prefixes")
    prefixes = spark.read.parquet(f"{base}/prefixes")
    _put(prefixes.select("doc_id", "n", "first", "second"), f"{base}/own")
    own = spark.read.parquet(f"{base}/own")

    # equal sets are one class; equal prefixes and sizes one group, named by its smallest class
    key = prefixes.filter("n > 0 and doc_id is not null")
    classes = key.groupBy("n", "first", "second").agg(F.min("doc_id").alias("cls"), F.first(F.xxhash64("prefix")).alias("of_prefix"), F.first("bits").alias("bits"))
    _put(classes, f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    grouped = classes.groupBy("n", "of_prefix").agg(F.min("cls").alias("grp"))
    _put(classes.join(grouped, ["n", "of_prefix"]).select("grp", "cls"), f"{base}/members")
    members = spark.read.parquet(f"{base}/members")
    named = members.filter("grp = cls").select("grp")
    leaders = key.select(F.col("doc_id").alias("grp"), "n", "prefix").join(named, "grp").dropDuplicates(["grp"])

    # lists of prefix shingles: one group per task and shingle goes on, the others stay beside it
    local = leaders.mapInArrow(frugal(_local_lists), _LISTS)
    by_token = Window.partitionBy("token").orderBy("a")
    tops = [F.first(c).over(by_token).alias(f"top{c[1:]}") for c in ("a", "a_n", "a_at")]
    across = local.filter("b is null").select("token", "a", "a_n", "a_at").select("*", *tops).filter("a > top")
    across = across.select("token", F.col("top").alias("a"), F.col("top_n").alias("a_n"), F.col("top_at").alias("a_at"), F.col("a").alias("b"), F.col("a_n").alias("b_n"), F.col("a_at").alias("b_at"))
    _put(local.filter("b is not null").unionByName(across), f"{base}/met")
    met = spark.read.parquet(f"{base}/met")
    drop_path(spark, f"{base}/prefixes")

    def side(p: str) -> DataFrame:
        return met.select("token", F.col(p).alias("grp"), F.col(f"{p}_n").alias("n"), F.col(f"{p}_at").alias("at"))

    lists = side("a").unionByName(side("b")).distinct()
    shared = members.groupBy("grp").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first < last")
    wide = members.join(shared.select("grp", "first"), "grp")

    bitmaps = classes.select("cls", "n", "bits")
    waves: list[str] = []

    def done(kind: str) -> DataFrame | None:
        found = [f"{base}/{kind}-{w}" for w in waves]
        return spark.read.parquet(*found) if found else None

    def compare(pairs: DataFrame, name: str) -> bool:
        """Compares the whole sets of ``pairs`` that were not compared before and whose bitmaps leave room; tells if any was."""
        new = pairs if not waves else pairs.join(done("pairs"), ["a", "b"], "left_anti")
        _put(_roomy(new, bitmaps, percent), f"{base}/pairs-{name}")
        new = spark.read.parquet(f"{base}/pairs-{name}")
        if new.isEmpty():
            return False
        ends = new.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if waves:
            ends = ends.join(done("sets").select("id"), "id", "left_anti")
        _put(_sets_of(rows, ends, width), f"{base}/sets-{name}")
        waves.append(name)
        _put(_verified(new, done("sets"), percent), f"{base}/links-{name}")
        return True

    # first: every group against the one that most of its lists put beside it, every member against the first of its group
    beside = met.filter(_may_link(percent)).groupBy("a", "b").count()
    best = beside.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b")
    compare(best.unionByName(wide.filter("cls > first").select(F.col("first").alias("a"), F.col("cls").alias("b"))).distinct(), "first")

    def labelled() -> DataFrame:
        if not waves:
            return members.withColumn("component", F.col("cls"))
        known = components(done("links")).select(F.col("id").alias("cls"), "component")
        return members.join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def still_open(of_members: DataFrame, name: str) -> DataFrame:
        """The lists whose members lie in different components."""
        spread = of_members.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        of_lists = lists.join(spread, "grp")
        unlike = of_lists.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("token")
        _put(of_lists.join(unlike, "token"), f"{base}/open-{name}")
        return spark.read.parquet(f"{base}/open-{name}")

    def side_of(df: DataFrame, p: str) -> DataFrame:
        return df.select("token", *(F.col(c).alias(f"{p}_{c}" if c != "grp" else p) for c in ("grp", "n", "at", "low", "high")))

    apart = F.expr("a <> b and not (a_low = a_high and b_low = b_high and a_low = b_low)")

    def expanded(group_pairs: DataFrame, of_members: DataFrame) -> DataFrame:
        left = of_members.select(F.col("grp").alias("a"), F.col("cls").alias("x"), F.col("component").alias("x_in"))
        right = of_members.select(F.col("grp").alias("b"), F.col("cls").alias("y"), F.col("component").alias("y_in"))
        pairs = group_pairs.join(left, "a").join(right, "b").filter("x_in <> y_in and (a <> b or x < y)")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # then, some times: the members of an open list against one of them, the same one in lists of the same members
    for k in range(PIVOTS):
        of_members = labelled()
        lists_left = still_open(of_members, f"pivot{k}")
        order = F.struct(F.xxhash64("grp", F.lit(k)).alias("order"), "grp", "n", "at", "low", "high")
        pivot = lists_left.groupBy("token").agg(F.min(order).alias("p")).select("token", "p.grp", "p.n", "p.at", "p.low", "p.high")
        met_again = side_of(pivot, "a").join(side_of(lists_left, "b"), "token").filter(apart & _may_link(percent)).select("a", "b").distinct()
        if not compare(expanded(met_again, of_members), f"pivot{k}"):
            break
    # last: what a list or a group still holds in different components, pair by pair
    of_members = labelled()
    lists_left = still_open(of_members, "rest")
    group_pairs = side_of(lists_left, "a").join(side_of(lists_left, "b"), "token").filter(apart & F.expr("a < b") & _may_link(percent)).select("a", "b").distinct()
    unlike = of_members.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    inside = unlike.select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    compare(expanded(group_pairs.unionByName(inside), of_members), "rest")

    links = done("links") if waves else spark.createDataFrame([], "a long, b long")
    reached = components(links).select(F.col("id").alias("cls"), "component")
    of_class = classes.join(reached, "cls", "left").select("n", "first", "second", F.coalesce("component", "cls").alias("component_id"))
    linked = own.filter("n > 0 and doc_id is not null").join(of_class, ["n", "first", "second"]).select("doc_id", "n", "component_id")
    alone = own.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    for name in ("members", "met", *(f"{kind}-{w}" for kind in ("pairs", "sets", "links") for w in waves)):
        drop_path(spark, f"{base}/{name}")
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class of near copies; rows without a doc_id stay."""
    classes = jaccard_classes(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti")


def oracle() -> str:
    """DuckDB SQL for the classes of ``documents``: sets of shingles, all pairs that share one, and what their links reach."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"""
