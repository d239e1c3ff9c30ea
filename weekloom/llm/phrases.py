"""Benchmark decontamination by a positional inverted index.

The index is a table: documents are cut into segments where they are read, and each segment has one row for each term with the places of all its postings, and
one row with its documents. Terms that no item can ask for, by a filter of fixed size, are not stored.

A search groups the index by segment. A window of an item starts from the list of its rarest term in the segment, moved by the term's offset in the window, and is
intersected with the lists of the other terms, moved likewise, from rare to common. What is left are the exact occurrences. Proximity goes through the same lists, but
lets a term stand anywhere within a span of places and then looks for a span that holds all terms of the window."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, materialize, tidy
from weekloom.llm.terms import TERMS_SQL, terms

WINDOW = 10
#: A segment ends with the document that reaches so many words.
SEGMENT_WORDS = 1 << 20
#: Bits of the filter of terms that items hold.
FILTER_BITS = 1 << 20
#: Items are searched in blocks of about so many words; a block's windows are what is broadcast.
BLOCK_WORDS = 1 << 18

INDEX = "segment long, term binary, places binary, docs array<long>"
MATCH = "struct<item_id: long, start: int, end: int>"
FOUND = f"segment long, place int, doc_id long, n_words long, exact array<{MATCH}>, near array<{MATCH}>"


def _bucket(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (FILTER_BITS - 1)


class _Codes(dict):
    """A number for each term that may be asked for, -1 for the others."""

    def __init__(self, asked: np.ndarray):
        super().__init__()
        self.asked, self.names = asked, []

    def __missing__(self, term: bytes) -> int:
        code = -1
        if self.asked[_bucket(term)]:
            code = len(self.names)
            self.names.append(term)
        self[term] = code
        return code


def _asked_buckets(items: DataFrame) -> np.ndarray:
    """Which of the filter's bits the terms of ``items(item_id, words)`` set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {_bucket(w) for x in batch.column(1).to_pylist() for w in x}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.int32())], ["bucket"])

    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[[r.bucket for r in items.mapInArrow(tidy(mark), "bucket int").distinct().collect()]] = True  # FILTER_BITS rows at most
    return bits


def positional_index(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The index of ``texts(doc_id, text)``, for the terms of ``items(item_id, words)``: ``segment, term, places, docs``.

    Words of a segment are numbered on, with one number left out behind each document, so that no phrase leads from one to the next. Places are the
    gaps between a term's numbers, the first counted from 0, as 32-bit integers. The row of a segment's documents has no term; its docs are their ids
    and its places the words of each, in the same order."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(_asked_buckets(items)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(np.unpackbits(shared.value).astype(bool))
        number, ids, sizes, held = TaskContext.get().partitionId() << 32, [], [], []

        def segment() -> pa.RecordBatch:
            starts = np.cumsum([0, *[s + 1 for s in sizes[:-1]]])
            at = np.concatenate([np.flatnonzero(c >= 0) + s for c, s in zip(held, starts.tolist(), strict=True)])
            of = np.concatenate([c[c >= 0] for c in held])
            order = np.argsort(of, kind="stable")
            of, at = of[order], at[order]
            edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            gaps = np.diff(at, prepend=0)
            gaps[edges[:-1]] = at[edges[:-1]]
            gaps = gaps.astype("<u4")
            names = [codes.names[i] for i in of[edges[:-1]].tolist()]
            places = [gaps[a:b].tobytes() for a, b in pairwise(edges.tolist())]
            docs = pa.array([*[None] * len(names), ids], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(names) + 1, number)), pa.array([*names, None], pa.binary()), pa.array([*places, np.array(sizes, "<u4").tobytes()], pa.binary()), docs], ["segment", "term", "places", "docs"]
            )

        words = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms(text.as_py())
                ids.append(key)
                sizes.append(len(own))
                held.append(np.fromiter(map(codes.__getitem__, own), np.int32, len(own)))
                words += len(own) + 1
                if words >= SEGMENT_WORDS:
                    yield segment()
                    number, ids, sizes, held, words = number + 1, [], [], [], 0
                    if len(codes) > 300_000:
                        codes = _Codes(codes.asked)
        if ids:
            yield segment()

    return materialize(texts.mapInArrow(tidy(build), INDEX), "phrase-index")


class Windows:
    """The windows of some items: for each its item and, as rows of ``width`` places, its terms, -1 behind the end of a shorter one."""

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int):
        self.numbers: dict[bytes, int] = {}
        rows, of = {}, []
        for item, words in items:
            own = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            for s in range(max(1, len(own) - width + 1) if own else 0):
                part = own[s : s + width]
                rows.setdefault((item, *part, *[-1] * (width - len(part))), None)
        of = list(rows)
        self.items = np.array([r[0] for r in of], np.int64)
        self.terms = np.array([r[1:] for r in of], np.int64).reshape(len(of), width)
        self.sizes = (self.terms >= 0).sum(axis=1)


class Lists:
    """The postings of one segment as one ascending array of term * span + place."""

    def __init__(self, lists: dict[int, np.ndarray], n_terms: int, words: int):
        self.span = words + 1
        self.counts = np.zeros(n_terms + 1, np.int64)  # the last stands for -1
        for t, x in lists.items():
            self.counts[t] = len(x)
        self.first = np.concatenate([[0], np.cumsum(self.counts[:-1])])
        self.keys = np.concatenate([np.zeros(0, np.int64), *[x + t * self.span for t, x in sorted(lists.items())]])

    def begun(self, windows: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) for each posting of each window's rarest term."""
        sizes = self.counts[rarest]
        of = np.repeat(np.arange(len(windows)), sizes)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return windows[of], self.keys[self.first[rarest][of] + inside] - rarest[of] * self.span

    def between(self, term_of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a posting in [low, high]."""
        low, high = np.maximum(low, 0), np.minimum(high, self.span - 1)
        at = np.searchsorted(self.keys, term_of * self.span + low)
        return (high >= low) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= term_of * self.span + high)


def occurrences(lists: Lists, w: Windows, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of exact occurrences if slop is None; else (window, place of its rarest term) where all its terms stand near."""
    counts = np.where(w.terms >= 0, lists.counts[w.terms], np.iinfo(np.int64).max)
    windows = np.flatnonzero(counts.min(axis=1, initial=1) > 0)
    order = np.argsort(counts[windows], axis=1, kind="stable")  # offsets from the rarest term to the commonest
    window, place = lists.begun(windows, w.terms[windows, order[:, 0]]) if len(windows) else (windows, windows)
    row_of = np.searchsorted(windows, window)
    start = place - order[row_of, 0] if len(windows) else place
    for step in range(1, w.terms.shape[1]):
        if not len(window):
            break
        offset = order[row_of, step]
        term = w.terms[window, offset]
        at, reach = (start + offset, 0) if slop is None else (place, w.sizes[window] + slop - 1)
        keep = (term < 0) | lists.between(term, at - reach, at + reach)
        window, place, start, row_of = window[keep], place[keep], start[keep], row_of[keep]
    return window, start if slop is None else place


def tightest(lists: Lists, terms_of: np.ndarray, place: int, most: int, begin: int, stop: int) -> tuple[int, int] | None:
    """The earliest of the shortest spans [start, end) of at most ``most`` places inside [begin, stop), a document, that hold the place and all the terms."""
    near = []
    for t in set(terms_of.tolist()):
        low, high = (int(np.searchsorted(lists.keys, t * lists.span + x)) for x in (max(begin, place - most + 1), min(stop, place + most)))
        near += [(int(p) - t * lists.span, t) for p in lists.keys[low:high]]
    near.sort()
    count, missing, first, best = {}, len(set(terms_of.tolist())), 0, None
    for p, t in near:
        missing -= count.get(t, 0) == 0
        count[t] = count.get(t, 0) + 1
        while not missing:
            at, gone = near[first]
            if at <= place <= p and p + 1 - at <= most and (best is None or p - at < best[1] - 1 - best[0]):
                best = (at, p + 1)
            count[gone] -= 1
            missing += count[gone] == 0
            first += 1
    return best


def _runs(item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of one item that touch become one run."""
    order = np.lexsort((end, start, item))
    item, start, end = item[order], start[order], end[order]
    reach = np.maximum.accumulate(end + item_base(item)) - item_base(item) if len(item) else end
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return item[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


def item_base(item: np.ndarray) -> np.ndarray:
    """A number that rises from each item to the next by more than any place."""
    return np.cumsum(np.concatenate([[0], np.diff(item) != 0])).astype(np.int64) << 33


def _searcher(shared: Broadcast, slop: int | None) -> Callable[[pa.Table], pa.Table]:
    """Searches one segment for the windows of one block of items."""

    def search(table: pa.Table) -> pa.Table:
        w, lists, ids, words = shared.value, {}, [], np.zeros(0, np.int64)
        for term, places, docs in zip(table.column("term").to_pylist(), table.column("places").to_pylist(), table.column("docs").to_pylist(), strict=True):
            if term is None:
                ids, words = docs, np.frombuffer(places, "<u4").astype(np.int64)
            elif term in w.numbers:
                lists[w.numbers[term]] = np.cumsum(np.frombuffer(places, "<u4").astype(np.int64))
        first = np.cumsum(words + 1) - words - 1
        postings = Lists(lists, len(w.numbers), int((words + 1).sum()))
        exact = near = [np.zeros(0, np.int64)] * 3
        if len(w.items) and len(postings.keys):
            window, start = occurrences(postings, w, None)
            exact = _runs(w.items[window], start, start + w.sizes[window])
            if slop is not None:
                spans = set()
                for x, p in zip(*(y.tolist() for y in occurrences(postings, w, slop)), strict=True):
                    own, doc = w.terms[x, : w.sizes[x]], int(np.searchsorted(first, p, "right")) - 1
                    if span := tightest(postings, own, p, len(own) + slop, int(first[doc]), int(first[doc] + words[doc])):
                        spans.add((int(w.items[x]), *span))
                near = [np.array(x, np.int64) for x in zip(*sorted(spans), strict=True)] or near
        kind = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

        def listed(item: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
            doc = np.searchsorted(first, start, side="right") - 1
            order = np.lexsort((start, item, doc))
            values = pa.StructArray.from_arrays([pa.array(item[order]), pa.array((start - first[doc])[order], pa.int32()), pa.array((end - first[doc])[order], pa.int32())], fields=list(kind))
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(words) + 1)), pa.int32()), values)

        segment = table.column("segment")[0].as_py()
        return pa.table({"segment": pa.array(np.full(len(words), segment), pa.int64()), "place": pa.array(np.arange(len(words)), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "exact": listed(*exact), "near": listed(*near)})

    return search


def search_index(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``segment, place, doc_id, n_words, exact, near`` for every document of the index; segment and place name its row.

    exact are the runs of words (start, end exclusive) that windows of an item cover by exact occurrences; near, unless slop is None, the shortest spans of at most
    a window's words and ``slop`` more that hold all its terms in any order (those of exact occurrences among them)."""
    sizes = items.select(F.sum(F.size("words")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(sizes / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for i in range(blocks):
        rows = items.where(block == i).orderBy("item_id", "words").collect()
        shared = index.sparkSession.sparkContext.broadcast(Windows([(r.item_id, [bytes(w) for w in r.words]) for r in rows], width))

        own = index.groupBy("segment").applyInArrow(_searcher(shared, slop), FOUND)
        found = own if found is None else found.unionAll(own)
    if blocks == 1:
        return found
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("exact"), flat("near"))


def split_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words`` of the items that have an id and a word, written."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(terms, batch.column(1).to_pylist()), pa.list_(pa.binary()))], ["item_id", "words"])

    bound_batches(items.sparkSession)
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    return materialize(rows.mapInArrow(tidy(split), "item_id long, words array<binary>").where(F.size("words") > 0), "phrase-items")


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact phrase and, with ``slop``, proximity matches of ``items(item_id, text)`` in every document, as ``search_index`` gives them."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    asked = split_items(items)
    return search_index(positional_index(texts, asked), asked, width, slop)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word of a document is hit if it stands inside an occurrence of a window, ``width`` consecutive words of an item (all its words, if fewer). Whole
    texts are read; null and empty ones have no words, and nothing is hit. Rows that repeat a doc_id are documents of their own, null ids are kept. Rows that
    repeat an item_id are several texts of one item; items without an id or words take no part. Other columns are ignored;
    without items nothing is hit, and without documents the result is empty. A document may be of any length."""
    found = phrase_matches(docs, items, width, None, id_col, text_col)
    spans = F.array_sort(F.transform("exact", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    hit = F.aggregate(spans, zero, lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))
    own = F.array_sort(F.transform(F.array_distinct(F.transform("exact", lambda m: m["item_id"])), lambda x: x.cast("string")))
    out = found.select("doc_id", "n_words", hit["n"].alias("n_hit"), own.alias("own"))
    return out.select("doc_id", "n_words", "n_hit", F.size("own").cast("long").alias("n_items"), F.sha2(F.array_join("own", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB; ``docs`` and ``items`` are the names of the tables.
CONTAMINATION_SQL = (
    r"""
with d as (
  select row_number() over () as rid, doc_id, """
    + TERMS_SQL.format("text")
    + r""" as w from {docs}
), i as (
  select item_id, """
    + TERMS_SQL.format("text")
    + r""" as w from {items} where item_id is not null
), g as (
  select distinct item_id, k, gram from (
    select item_id, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) as gram from i where len(w) > 0)
), p as (
  select rid, k, x.s as s, x.gram as gram from (
    select rid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: {{'s': s, 'gram': array_to_string(w[s:s + k - 1], ' ')}})) as x from d join (select distinct k from g) on len(w) >= k)
), h as (
  select rid, item_id, s, k from p join g using (k, gram)
), n as (
  select rid, count(distinct spot)::bigint as n_hit from (select rid, unnest(range(s, s + k)) as spot from h) group by rid
), o as (
  select rid, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item_id::varchar as item from h) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (rid) left join o using (rid)
"""
)
