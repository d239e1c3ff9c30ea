"""N-gram Jaccard join by grouped prefixes.

1. Every task counts shingles in a fixed table of ``BUCKETS`` counters (one count sketch of the whole
   corpus, 4 MB whatever its size); rarest bucket first is the global order of shingles.
2. Documents with the same shingle set become one class, whose smallest doc_id stands for it.
3. The prefix filter: two sets reach the similarity only if they share a shingle among the first
   n - ceil(t n) + 1 of either. A prefix shingle that no other class has in its prefix is dropped.
4. Classes with the same size and the same remaining prefix form a group. Group pairs come from
   shared prefix shingles and pass a size and a position filter.
5. Groups are expanded and members verified on whole shingle sets. Only connectivity is asked for, so a
   list of n groups first gives n - 1 pairs with its pivot; the pairs between members that are still in
   different components follow in a second pass. No link between components can be missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import WordHashes, bound_batches, connected_components, materialize, mix, shingle_sets, tidy

BUCKETS = 1 << 20
CHUNK = 1 << 12
FILTER_BITS = 1 << 24
#: Lists of at most so many groups are compared in whole at once; longer ones through a pivot first.
SHORT = 16


def text_sets(k: int) -> Callable:
    """Of a column of texts, their shingle sets; made anew in each task."""

    def make() -> Callable:
        cache = WordHashes()
        return lambda column: shingle_sets(column.to_pylist(), k, cache)

    return make


def stored_sets() -> Callable:
    """Of a column of sets, the sets."""
    return lambda column: [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def count_sketch(rows: DataFrame, make: Callable) -> np.ndarray:
    """How many (row, shingle) pairs fall into each bucket, over all ``rows(id, binary)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_sets, total = make(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((np.concatenate(to_sets(batch.column(0))) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        chunks = [(i, c) for i, c in enumerate(total.reshape(-1, CHUNK)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.int32()), pa.array([zlib.compress(c.astype("<i8").tobytes(), 1) for _, c in chunks], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select(rows.columns[1]).mapInArrow(tidy(count), "chunk int, counts binary")
    out = np.zeros((BUCKETS // CHUNK, CHUNK), dtype=np.int64)
    bound_batches(rows.sparkSession)
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():  # BUCKETS numbers at most
        out[row.chunk] = np.frombuffer(row.counts, "<i8")
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(rows: DataFrame, make: Callable, num: int, den: int) -> DataFrame:
    """Per row of ``rows(id, binary)``: size and key of its shingle set, prefix in the global order, and how common that prefix is."""
    sketch = rows.sparkSession.sparkContext.broadcast(count_sketch(rows, make))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_sets, counts = make(), sketch.value
        for batch in batches:
            sizes, high, low, first, common = [], [], [], [], []
            for s in to_sets(batch.column(1)):
                n = len(s)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                c = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                take = np.lexsort((s, c))[: n - -(-num * n // den) + 1] if n else np.zeros(0, dtype=np.int64)
                sizes.append(n)
                high.append((key >> 64) - (1 << 63))
                low.append((key & ((1 << 64) - 1)) - (1 << 63))
                first.append(s[take].view(np.int64))
                common.append(float(np.log2(c[take] + 1.0).mean()) if n else 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists, pa.array(common, pa.float64())], ["id", "n", "high", "low", "prefix", "common"])

    return rows.mapInArrow(tidy(prefix), "id long, n long, high long, low long, prefix array<long>, common double")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over ``ids(id)``, with two bits an id: as large for any input."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["k", "bits"])

    def either(table: pa.Table) -> pa.Table:
        all_bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for x in table.column("bits").to_pylist():
            all_bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"k": pa.array([0], pa.int32()), "bits": pa.array([all_bits.tobytes()], pa.binary())})

    found = ids.mapInArrow(tidy(mark), "k int, bits binary").groupBy("k").applyInArrow(either, "k int, bits binary").collect()
    return np.unpackbits(np.frombuffer(found[0].bits, np.uint8)).astype(bool) if found else np.zeros(FILTER_BITS, dtype=bool)


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) & (FILTER_BITS - 1)


def sets_by_id(texts: DataFrame, ids: DataFrame, parts: Callable) -> DataFrame:
    """``id, hashes`` of the parts whose id is in ``ids(id)``, in one scan of ``texts(id, _text)`` without a shuffle.

    ``parts(doc ids, texts, cache)`` yields (part ids, function from index to set). The filter lets a few other parts through."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(_id_filter(ids)))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = WordHashes(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found, hashes = [], []
            for part_ids, to_set in parts(batch.column(0), batch.column(1), cache):
                one, two = _bits(part_ids)
                for i in np.flatnonzero(bits[one] & bits[two]).tolist():
                    found.append(int(part_ids[i]))
                    hashes.append(to_set(i).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(hashes, pa.binary())], ["id", "hashes"])

    return texts.where("id is not null").select("id", "_text").mapInArrow(tidy(to_sets), "id long, hashes binary")


def _sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    def whole(docs: pa.Array, texts: pa.Array, cache: WordHashes) -> Iterator[tuple[np.ndarray, Callable]]:
        yield docs.to_numpy(zero_copy_only=False), lambda i: shingle_sets([texts[i].as_py()], k, cache)[0]

    return sets_by_id(texts, ids, whole)


def _histogram(values: np.ndarray) -> np.ndarray:
    return np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256)


def _passing(pairs: DataFrame, left: DataFrame, right: DataFrame, test: Callable) -> DataFrame:
    """The rows of ``pairs(a, b)`` for which ``test`` holds of a's and b's binary value in ``left(a, x)`` and ``right(b, y)``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long").distinct()


def _sides(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    return values.select(F.col("id").alias("a"), F.col("value").alias("x")), values.select(F.col("id").alias("b"), F.col("value").alias("y"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets have den * intersection >= num * union.

    First by the sets' histograms over 256 ranges of hashes, whose common part bounds the intersection from above: most pairs fall there,
    and only the sets of those left are moved."""

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_histogram(np.frombuffer(x, np.uint64)).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x, 1) for x in sizes], pa.binary())], ["id", "value"])

    def may(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64), np.frombuffer(zlib.decompress(y), "<u4").astype(np.int64)
        both = int(np.minimum(x, y).sum())
        return den * both >= num * (int(x.sum() + y.sum()) - both)

    def does(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(x) + len(y) - len(np.union1d(x, y))
        return den * both >= num * (len(x) + len(y) - both)

    left = materialize(_passing(pairs, *_sides(sets.mapInArrow(tidy(histograms), "id long, value binary")), may), "pairs-left")
    ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return _passing(left, *_sides(_let_through(sets, ids)), does)


def among(ids: DataFrame) -> Callable:
    """Made anew in each task: of an array of numbers, which are in ``ids(id)``; a few others pass too."""
    shared = ids.sparkSession.sparkContext.broadcast(np.packbits(_id_filter(ids)))

    def make() -> Callable:
        bits = np.unpackbits(shared.value).astype(bool)

        def test(numbers: np.ndarray) -> np.ndarray:
            one, two = _bits(numbers)
            return bits[one] & bits[two]

        return test

    return make


def maybe_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose long ``key`` is in ``ids(id)``, and a few others, without a shuffle: what a join with ``ids`` need not move."""
    make, at = among(ids), rows.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at).to_numpy(zero_copy_only=False)), pa.bool_()))

    return rows.mapInArrow(tidy(keep), rows.schema)


def _let_through(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, value`` of the sets whose id is in ``ids`` (and a few others), without a shuffle."""
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(_id_filter(ids)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            one, two = _bits(batch.column(0).to_numpy())
            kept = batch.filter(pa.array(bits[one] & bits[two], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["id", "value"])

    return sets.mapInArrow(tidy(keep), "id long, value binary")


def near(num: int, den: int, p: str = "p_", q: str = "") -> F.Column:
    """Size and position filter for two postings of one shingle; it never drops the first shingle that a linked pair shares."""
    n, m = F.col(f"{p}n"), F.col(f"{q}n")
    most = F.least(n - F.col(f"{p}pos"), m - F.col(f"{q}pos"))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (most * (num + den) >= num * (n + m))


def pairs_with_pivots(postings: DataFrame, num: int, den: int, pivots: int = 4) -> DataFrame:
    """For each shingle, its commonest postings (the pivots) with each other one: linear in the postings."""
    w = Window.partitionBy("shingle").orderBy(F.desc("common"), "id", "n")
    chosen = postings.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= pivots).select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "pos")])
    pivot = postings.join(chosen, "shingle")
    return pivot.where((F.col("id") != F.col("p_id")) & near(num, den)).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()


def linked_components(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, name: str, ties: DataFrame | None = None) -> DataFrame:
    """``id, component`` of the sets that have a link, directly or through ``ties(a, b)``.

    ``classes(id, n, prefix, common)`` are distinct sets, ``sets_of(ids)`` gives a table ``id, hashes`` of those asked for, or of more. Counts by shingle are
    aggregated where the postings are and joined to them, so a common shingle's postings need not meet in one task."""
    lists = classes.select("id", "n", "common", F.posexplode("prefix").alias("pos", "shingle"))
    shared = lists.groupBy("shingle").count().where("count > 1").select("shingle")
    postings = materialize(lists.join(shared, "shingle"), f"{name}-postings")

    own = postings.groupBy("id", "n").agg(  # the prefix of one set
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shingle"))), lambda x: x["shingle"].cast("string")), ","), 256).alias("prefix"), F.max("common").alias("common")
    )
    own = materialize(own, f"{name}-own")
    leaders = own.groupBy("n", "prefix").agg(F.min(F.struct((-F.col("common")).alias("c"), "id")).alias("first")).select("n", "prefix", F.col("first.id").alias("leader"))
    groups = materialize(own.join(leaders, ["n", "prefix"]).select("id", "n", "leader"), f"{name}-groups")
    leads = F.when(F.col("id") == F.col("leader"), 1)
    postings = postings.join(groups, ["id", "n"])
    counts = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.count(leads).alias("groups"))
    postings = materialize(postings.join(counts, "shingle"), f"{name}-grouped")
    of_groups = postings.groupBy("shingle", "n", F.col("leader").alias("id"), "groups").agg(F.min("pos").alias("pos"), F.max("common").alias("common"))
    short, long = of_groups.where(F.col("groups") <= SHORT), of_groups.where(F.col("groups") > SHORT)
    mate = short.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "pos")])
    within = short.join(mate, "shingle").where((F.col("p_id") < F.col("id")) & near(num, den)).select(F.col("p_id").alias("a"), F.col("id").alias("b"))
    of_pairs = materialize(within.unionAll(pairs_with_pivots(long, num, den)).distinct(), f"{name}-group-pairs")
    member, other = groups.select(F.col("leader").alias("b"), F.col("id").alias("m")), groups.select(F.col("leader").alias("a"), F.col("id").alias("m"))
    # a pair of groups is expanded to the leader of one with the members of the other: linear in the members
    expanded = of_pairs.join(member, "b").select(F.col("a").alias("u"), "m").unionAll(of_pairs.join(other, "a").select(F.col("b").alias("u"), "m")).unionAll(groups.select(F.col("leader").alias("u"), F.col("id").alias("m")))
    pairs = materialize(expanded.where("u <> m").select(F.least("u", "m").alias("a"), F.greatest("u", "m").alias("b")).distinct(), f"{name}-pairs")

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    sets = sets_of(ends(pairs))
    links = materialize(verified(pairs, sets, num, den), f"{name}-links")
    found = materialize(connected_components(links if ties is None else links.unionAll(ties), f"{name}-first"), f"{name}-found")

    # second pass: what pivots and leaders have left apart
    rest = postings.where((F.col("members") > F.col("groups")) | (F.col("groups") > SHORT)).join(found.withColumnRenamed("component", "c"), "id", "left")
    rest = rest.select("shingle", "id", "n", "pos", F.coalesce("c", "id").alias("c"))
    split = rest.groupBy("shingle").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("shingle")
    apart = materialize(rest.join(split, "shingle"), f"{name}-apart")
    if apart.isEmpty():
        return found
    mate = apart.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "pos", "c")])
    rest = apart.join(mate, "shingle").where((F.col("p_c") < F.col("c")) & near(num, den)).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), f"{name}-rest")
    if rest.isEmpty():
        return found
    unseen = ends(rest).join(sets.select("id"), "id", "left_anti")
    further = sets if unseen.isEmpty() else sets.unionAll(sets_of(materialize(unseen, f"{name}-unseen")))
    more = materialize(verified(rest, further, num, den), f"{name}-more")
    if more.isEmpty():
        return found
    # the components found are one edge each by now
    return connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more), f"{name}-second")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link rows whose sets of distinct k-word shingles have Jaccard similarity num/den or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links).
    Words are lower-cased (A-Z) and cut at the six ASCII white-space characters; shingles are compared by
    64-bit hashes. A text with fewer than k words has its whole sequence as its only shingle. Null, empty
    and blank texts have 0 shingles and are linked with nothing. Rows that repeat an id are one node, linked
    by any of their texts, and have one component_id. A row whose id is null is returned with its n_shingles and a null component_id.
    Other columns are ignored, whatever their names; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("_text"))
    rows = materialize(prefixes(texts, text_sets(k), num, den), "join-rows")
    full = rows.where("n > 0 and id is not null")
    classes = full.groupBy("high", "low").agg(F.min(F.struct("id", "n", "prefix", "common")).alias("first")).select("high", "low", "first.*")
    classes = materialize(classes, "join-classes")
    # an id on several rows is one node: tie it to the classes of all its texts
    twice = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    ties = full.join(twice, "id", "left_semi").join(classes.select("high", "low", F.col("id").alias("a")), ["high", "low"]).select("a", F.col("id").alias("b")).distinct()
    components = materialize(linked_components(classes.drop("high", "low"), lambda ids: materialize(_sets(texts, ids, k), "join-sets"), num, den, "join", ties), "join-components")

    named = classes.select("high", "low", F.col("id").alias("first")).join(components.withColumnRenamed("id", "first"), "first", "left").select("high", "low", F.coalesce("component", "first").alias("component_id"))
    with_text = full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "high", "low").join(named, ["high", "low"]).drop("high", "low")
    # the others go by their id alone: what has no words would else meet in one task
    empty = rows.where("n = 0 and id is not null").join(components, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    nameless = rows.where("id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return with_text.unionAll(empty).unionAll(nameless)
