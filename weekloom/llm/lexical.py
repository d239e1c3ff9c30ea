"""Ranked lexical search over dual-sorted wavelet trees.

Documents are cut into shards where they are read. A shard writes its postings as one sequence of document numbers, term after term and within a term
by falling impact, and builds a wavelet tree over it. The tree halves the range of documents at each level and keeps the order of what it
deals out, so in every node a term's postings are one interval, and its first entry has the term's greatest impact among the node's documents. The sum of
those over an item's terms bounds the score of every document below the node. Nodes are opened from the best bound down, for all items of a block at
once, until none can reach an item's kth score; leaves are single documents with exact scores.

No posting is shuffled. A task carries each item's best k from shard to shard, so later shards are cut off earlier, and sends k rows an item at its end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, materialize, tidy
from weekloom.llm.terms import TERMS_SQL, terms

#: A shard ends at so many documents or so many postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Items are searched in blocks of about so many terms; a block's terms are what is broadcast.
BLOCK_TERMS = 1 << 17
#: Nodes of an item that are opened at once.
OPENED = 64
#: Groups in which the tasks' results are first merged.
MERGES = 256
LONGEST = (1 << 63) - 1


class Tree:
    """A wavelet tree, level by level: at each, the zeros before every place, and the impacts in that level's order.

    A level's zeros stand before its ones, so a node's interval [a, b) goes on as the interval of its zeros and that of its ones."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, levels: int):
        n = len(docs)
        self.levels = levels
        self.zeros = np.zeros((levels, n + 1), dtype=np.int32)
        self.impacts = np.empty((levels + 1, n), dtype=np.int32)
        for level in range(levels):
            self.impacts[level] = impacts
            one = (docs >> (levels - 1 - level) & 1).astype(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            docs, impacts = docs[order], impacts[order]
        self.impacts[levels] = impacts

    def children(self, level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where places of the levels stand on the next one, if zeros and if ones."""
        zero = self.zeros[level, at].astype(np.int64)
        return zero, self.zeros[level, -1] + at - zero


class Shard:
    """The postings of some documents: a tree, the interval of each term, and the documents' ids in ascending order."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, docs: np.ndarray, term_of: np.ndarray, impacts: np.ndarray, n_terms: int):
        by_id = np.lexsort((ids, ~known))  # null ids last
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        self.ids, self.known = ids[by_id], known[by_id]
        order = np.lexsort((place[docs], -impacts, term_of))
        self.starts = np.searchsorted(term_of[order], np.arange(n_terms + 1))
        self.tree = Tree(place[docs][order], impacts[order], max(1, (len(ids) - 1).bit_length()))


class Queries:
    """Items as runs of term numbers with weights."""

    def __init__(self, firsts: np.ndarray, term_of: np.ndarray, weights: np.ndarray):
        self.firsts, self.term_of, self.weights = firsts, term_of, weights


def search(shard: Shard, q: Queries, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in the shard, score) of all documents that can be among an item's k best, where a score below its floor can not."""
    tree, items = shard.tree, len(q.firsts) - 1
    floors = np.maximum(floors, 1)
    item = np.repeat(np.arange(items), np.diff(q.firsts))
    a, b = shard.starts[q.term_of], shard.starts[q.term_of + 1]
    held = (b > a) & (q.weights > 0)
    # an open node: item, level, number of its first document over the size; its terms' intervals are runs of (a, b, weight)
    item, a, b, w = item[held], a[held], b[held], q.weights[held]
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    node = {"item": item[starts], "level": np.zeros(len(starts), np.int64), "docs": np.zeros(len(starts), np.int64), "size": np.diff(np.append(starts, len(item)))}
    node["bound"] = np.add.reduceat(w * tree.impacts[0, a], starts) if len(starts) else np.zeros(0, np.int64)
    found = [np.zeros((3, 0), dtype=np.int64)]
    while len(node["item"]):
        keep = node["bound"] >= floors[node["item"]]
        rank = np.lexsort((-node["bound"], node["item"]))
        rank = rank[keep[rank]]
        of = node["item"][rank]
        first = np.searchsorted(of, of)  # of is sorted: where each item's nodes begin
        opened = np.zeros(len(keep), dtype=bool)
        opened[rank[np.arange(len(rank)) - first < OPENED]] = True
        lasting = np.repeat(opened, node["size"])
        wait, held = keep & ~opened, np.repeat(keep & ~opened, node["size"])
        now = {n: x[opened] for n, x in node.items()}
        level = np.repeat(now["level"], now["size"])
        (az, ao), (bz, bo) = tree.children(level, a[lasting]), tree.children(level, b[lasting])
        parent = np.repeat(np.arange(len(now["item"])), now["size"])
        sides = []
        for bit, (c, d) in enumerate(((az, bz), (ao, bo))):
            full = d > c
            up, c, d, weight = parent[full], c[full], d[full], w[lasting][full]
            if not len(up):
                continue
            at = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            bound = np.add.reduceat(weight * tree.impacts[level[full] + 1, c], at)
            mine = up[at]
            child = {"item": now["item"][mine], "level": now["level"][mine] + 1, "docs": now["docs"][mine] * 2 + bit, "size": np.diff(np.append(at, len(up))), "bound": bound}
            leaf = child["level"] == tree.levels
            found.append(np.stack([child["item"][leaf], child["docs"][leaf], bound[leaf]]))
            inner = np.repeat(~leaf, child["size"])
            sides.append(({n: x[~leaf] for n, x in child.items()}, c[inner], d[inner], weight[inner]))
        parts = [({n: x[wait] for n, x in node.items()}, a[held], b[held], w[held]), *sides]
        node = {n: np.concatenate([p[0][n] for p in parts]) for n in node}
        a, b, w = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        if len(found) > 1:
            found = [best_of(np.concatenate(found, axis=1), k)]
            floors = np.maximum(floors, kth(found[0], items, k))
    return tuple(found[0] if len(found) == 1 else np.concatenate(found, axis=1))


def best_of(found: np.ndarray, k: int) -> np.ndarray:
    """Of the columns (item, place, score), each item's k best, ties to the smaller place."""
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    return found[:, np.arange(found.shape[1]) - np.searchsorted(found[0], found[0]) < k]


def kth(found: np.ndarray, items: int, k: int) -> np.ndarray:
    """Each item's kth score of ``best_of``; 0 if it has fewer."""
    out, ends = np.zeros(items, dtype=np.int64), np.searchsorted(found[0], np.arange(items), side="right")
    full = np.bincount(found[0], minlength=items) >= k
    out[full] = found[2][ends[full] - 1]
    return out


def impact(tf: int, n: int, docs: int, length: int) -> int:
    """What one term adds to the score of a document of n terms, over its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * n * docs // length))


def shards(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int], docs: int, length: int) -> Iterator[Shard]:
    """Shards of ``(doc_id, text)``; a document that holds no asked term has no part in them."""
    ids, known, held, term_of, impacts = [], [], [], [], []

    def shard() -> Shard:
        return Shard(np.array(ids, np.int64), np.array(known, bool), np.concatenate(held), np.concatenate(term_of), np.concatenate(impacts), len(numbers))

    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = terms(text.as_py())
            found = np.fromiter(map(numbers.get, words, [-1] * len(words)), np.int64, len(words))
            own, tf = np.unique(found[found >= 0], return_counts=True)
            if not len(own):
                continue
            each = {t: impact(t, len(words), docs, length) for t in set(tf.tolist())}
            held.append(np.full(len(own), len(ids)))
            ids.append(0 if key is None else key)
            known.append(key is not None)
            term_of.append(own)
            impacts.append(np.array([each[t] for t in tf.tolist()], np.int64))
            size += len(own)
            if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield shard()
                ids, known, held, term_of, impacts, size = [], [], [], [], [], 0
    if ids:
        yield shard()


def _statistics(texts: DataFrame, numbers: Broadcast) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms, documents that hold each of the asked terms) over all ``texts(doc_id, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers.value
        holding, docs, length = np.zeros(len(own), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1):
                words = terms(text.as_py())
                docs += bool(words)
                length += len(words)
                holding[[own[x] for x in own.keys() & set(words)]] += 1
        term_of = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([*term_of.tolist(), -1, -2], pa.int32()), pa.array([*holding[term_of].tolist(), docs, length], pa.int64())], ["term", "n"])

    totals = texts.mapInArrow(tidy(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of a block at most
    by = {r.term: r.n for r in totals}
    return by.get(-1, 0), by.get(-2, 0), np.array([by.get(i, 0) for i in range(len(numbers.value))], np.int64)


def _block(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The tasks' best k documents of each item of ``asked(item_id, term)``, which is small: ``item_id, part, doc_id, score``."""
    rows = asked.orderBy("item_id", "term").collect()
    context = texts.sparkSession.sparkContext
    numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    shared = context.broadcast(numbers)
    docs, length, holding = _statistics(texts, shared)
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in holding.tolist()]
    names, firsts = np.unique(np.array([r.item_id for r in rows], np.int64), return_index=True)
    term_of = np.array([numbers[bytes(r.term)] for r in rows], np.int64)
    plan = context.broadcast((names, Queries(np.append(firsts, len(rows)), term_of, np.array(weight, np.int64)[term_of])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = plan.value
        best, score_of = np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)  # (item, place, score) with places in ids
        floors = np.zeros(len(names), np.int64)
        for shard in shards(batches, shared.value, docs, length):
            item, place, score = search(shard, queries, k, floors)
            ids = np.concatenate([score_of, np.stack([shard.ids[place], shard.known[place].astype(np.int64)])], axis=1)
            order = np.lexsort((ids[0], 1 - ids[1]))  # places in the order of ids, nulls last
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            best = best_of(np.stack([np.append(best[0], item), rank, np.append(best[2], score)]), k)
            score_of, best[1] = ids[:, order][:, best[1]], np.arange(best.shape[1])
            floors = np.maximum(floors, kth(best, len(names), k))
        part = TaskContext.get().partitionId() % MERGES
        doc_ids = pa.array(score_of[0], pa.int64(), mask=score_of[1] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]], pa.int64()), pa.array(np.full(best.shape[1], part), pa.int32()), doc_ids, pa.array(best[2], pa.int64())], ["item_id", "part", "doc_id", "score"])

    return texts.mapInArrow(tidy(run), "item_id long, part int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its k documents of the highest score above 0, ties to the smaller doc_id.

    The score adds, once for each of an item's terms, its weight by rarity over all documents times an impact that rises with the term's occurrences and falls
    with the document's length; all of it whole numbers but the logarithm. Whole texts are read; null and empty ones hold no term and count nowhere. Rows
    that repeat a doc_id are documents of their own (one id may then be ranked more than once); null ids come last among ties. Rows that
    repeat an item_id are one item with the terms of all; items without an id or a term, or whose terms no document holds, have no result.
    Other columns are ignored; without documents or items the result is empty. A document may be of any length."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            ids = [i for i, x in zip(batch.column(0).to_pylist(), own, strict=True) for _ in x]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t for x in own for t in x], pa.binary())], ["item_id", "term"])

    bound_batches(docs.sparkSession)
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.encode(F.col(item_text_col).cast("string"), "UTF-8").alias("text"))
    asked = materialize(asked.mapInArrow(tidy(split), "item_id long, term binary").distinct(), "lexical-terms")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for i in range(blocks):
        own = _block(texts, asked.where(block == i), k)
        found = own if found is None else found.unionAll(own)

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    return best(best(found, "item_id", "part"), "item_id").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB; ``docs`` and ``items`` are the names of the tables.
LEXICAL_SQL = (
    r"""
with d as (
  select row_number() over () as rid, doc_id, """
    + TERMS_SQL.format("text")
    + r""" as w from {docs}
), s as (
  select count(*)::bigint as docs, sum(len(w))::bigint as length from d where len(w) > 0
), i as (
  select distinct item_id, term from (select item_id, unnest("""
    + TERMS_SQL.format("text")
    + r""") as term from {items} where item_id is not null)
), p as (
  select rid, doc_id, n, term, count(*)::bigint as tf from (select rid, doc_id, len(w)::bigint as n, unnest(w) as term from d)
  where term in (select term from i) group by all
), f as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from p, s group by term, docs
), r as (
  select item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::bigint as score
  from p join i using (term) join f using (term), s group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
from r where score > 0 qualify rank <= 50
"""
)
