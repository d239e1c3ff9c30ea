"""Passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are the lines of a text of ``LEAST`` words or more, and runs of shorter lines up to a blank one. They are compared as sets of 5-word shingles: banded MinHash, exact
verification of colliding paragraphs, connected components of near copies. A passage may also stand inside different
paragraphs, so words are further cut where a hash of two neighbouring words is the least within ``REACH`` words; such pieces depend on nearby
words only, and equal pieces of different documents repeat. What touches is joined, and runs of ``LEAST`` words or more count.
In each component or piece the document with the smallest id keeps its copy; the copies of the others are to be removed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.jaccard_join import SHORT, among, linked_components, maybe_among, prefixes, sets_by_id, stored_sets, verified
from weekloom.llm.shared import WordHashes, connected_components, discard, materialize, mix, ngram_hashes, tidy

LEAST = 20
REACH = 4
SHINGLE = 5
NUM, DEN = 80, 100
RECALL = 0.999
#: A line of wrapped text has fewer words.
WRAP = 40
#: Places between two texts of a batch; more than content-defined cuts and shingles look ahead.
GAP = 8
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def tuned_bands(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): two rows a band, and the fewest bands that let a pair of that similarity collide with that probability."""
    rows = 2
    for bands in range(1, most + 1):
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no such bands")


BANDS, ROWS = tuned_bands(NUM / DEN, RECALL)
#: For each MinHash a mask and an odd factor.
SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _summed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-dependent hashes of the word runs [start, end), none of them empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    each = mix(values[place + np.repeat(starts, sizes)] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(each, at) + sizes.astype(np.uint64))


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end) of ``raw``, eight bytes of all words at a time."""
    sizes = ends - starts
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    out = sizes.astype(np.uint64)
    left = np.flatnonzero(sizes <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        if done:
            left = left[sizes[left] > done]
        unused = np.maximum(8 - (sizes[left] - done), 0).astype(np.uint64) * np.uint64(8)
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) + (eight[starts[left] + done] << unused))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


class Words:
    """The words of a batch of texts in one array, with ``GAP`` places between texts, so that nothing near one text's end depends on the next text.

    starts and ends are those of its lines; a blank line stands between texts."""

    def __init__(self, texts: list[bytes | None]):
        raw = b"\n\n".join([*(t or b"" for t in texts), b""]).lower()
        seen = np.frombuffer(raw, np.uint8)
        blank = (seen == 32) | (seen - np.uint8(9) < 5)
        edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
        at, to = edges[::2], edges[1::2]
        flat = word_hashes(raw, at, to)
        sizes = np.array([len(t or b"") + 2 for t in texts], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        before = np.searchsorted(at, begin)  # words before each text
        counts = np.diff(np.append(before, len(at)))
        self.first = np.cumsum(counts + GAP) - counts - GAP  # where each text begins
        self.last = self.first + counts
        self.values = np.zeros(int((counts + GAP).sum()), dtype=np.uint64)
        self.inside = np.zeros(len(self.values), dtype=bool)
        place = np.arange(len(flat)) + np.repeat(self.first - before, counts)
        self.values[place], self.inside[place] = flat, True
        feeds = seen == 10
        of = np.searchsorted(begin, np.flatnonzero(feeds), side="right") - 1  # the text of each line
        sizes = np.bincount(np.cumsum(feeds)[at], minlength=len(of))
        self.starts = np.cumsum(sizes) - sizes + (self.first - before)[of]
        self.ends = self.starts + sizes

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """Number of the text in which each place stands."""
        return np.searchsorted(self.first, places, side="right") - 1

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the long lines, and of the runs of shorter lines up to a blank one that are long together: wrapped text."""
        sizes = self.ends - self.starts
        long = sizes >= LEAST
        starts, ends = [self.starts[long]], [self.ends[long]]
        for most in (LEAST, WRAP):
            turns = np.flatnonzero(np.diff(np.concatenate([[0], (sizes > 0) & (sizes < most), [0]])))
            one, two = turns[::2], turns[1::2] - 1
            run = (two > one) & (self.ends[two] - self.starts[one] >= LEAST)
            starts.append(self.starts[one[run]])
            ends.append(self.ends[two[run]])
        total = len(self.values) + 1
        both = np.unique(np.concatenate(starts) * total + np.concatenate(ends))
        return both // total, both % total

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces: cut by content and at line edges; those that lines cut are there whole as well."""
        if not self.inside.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = mix(self.values[:-1] * np.uint64(3) + self.values[1:])
        pair[~(self.inside[:-1] & self.inside[1:])] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = self.inside[:-1] & self.inside[1:]
        for d in range(1, REACH + 1):
            least[d:] &= pair[d:] < pair[:-d]
            least[:-d] &= pair[:-d] <= pair[d:]
        full = self.last > self.first
        content = np.unique(np.concatenate([self.first[full], np.flatnonzero(least) + 1, self.last[full]]))
        kept = self.ends > self.starts
        cuts = np.unique(np.concatenate([content, self.starts[kept], self.ends[kept]]))
        small, whole = self.inside[cuts[:-1]], self.inside[content[:-1]] & (np.diff(np.searchsorted(cuts, content)) > 1)
        return np.concatenate([cuts[:-1][small], content[:-1][whole]]), np.concatenate([cuts[1:][small], content[1:][whole]])


def signatures(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band keys of the lines [start, end), one row a line."""
    if not len(starts):
        return np.zeros((0, BANDS), dtype=np.uint64)
    grams = ngram_hashes(words, SHINGLE)
    ranges = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
    padded = np.append(grams, np.uint64(0xFFFFFFFFFFFFFFFF))  # so that a last range may end at the end
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, dtype=np.uint64)
        for row in range(ROWS):
            h = (padded ^ SEEDS[2 * (band * ROWS + row)]) * SEEDS[2 * (band * ROWS + row) + 1]
            key = mix(key * np.uint64(31) + np.minimum.reduceat(h, ranges)[::2])
        out[:, band] = key
    return out


def packed(starts: np.ndarray, ends: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Runs of words in few bytes."""
    return squeeze.compress(np.concatenate([np.diff(starts, prepend=0), ends - starts]).astype("<i4").tobytes())


def unpacked(runs: bytes, widen: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what ``packed`` gave."""
    steps, sizes = np.frombuffer(widen.decompress(runs, max_output_size=1 << 31), "<i4").astype(np.int64).reshape(2, -1)
    starts = np.cumsum(steps)
    return starts, starts + sizes


def _units(texts: DataFrame) -> DataFrame:
    """``id, text`` (a hash of it) and either a paragraph (``hash, start, end`` and its bands, a column each) or all pieces of that text (``piece_hashes, piece_runs``)."""
    bands = [f"band{i}" for i in range(BANDS)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = batch.column(1).to_pylist()
            words = Words(found)
            ids, names = batch.column(0).to_numpy(zero_copy_only=False), np.array([xxhash.xxh3_64_intdigest(t or b"") for t in found], dtype=np.uint64).view(np.int64)
            ls, le = words.paragraphs()
            ps, pe = words.pieces()
            keys = signatures(words.values, ls, le).view(np.int64)
            of, of_piece = words.text_of(ls), words.text_of(ps)
            order = np.argsort(of_piece, kind="stable")
            ps, pe, of_piece = ps[order], pe[order], of_piece[order]
            piece_hashes = _summed(words.values, ps, pe).astype("<u8")
            full, bounds = np.unique(of_piece, return_index=True)
            spans = [(a, b, first) for (a, b), first in zip(pairwise([*bounds.tolist(), len(ps)]), words.first[full].tolist(), strict=True)]
            lines, texts = len(ls), len(full)
            longs = [_summed(words.values, ls, le).view(np.int64), *keys.T]
            columns = [pa.array(np.concatenate([x[of], x[full]]), pa.int64()) for x in (ids, names)]
            columns += [pa.concat_arrays([pa.array(np.ascontiguousarray(x), t), pa.nulls(texts, t)]) for x, t in [(longs[0], pa.int64()), *[(x - words.first[of], pa.int32()) for x in (ls, le)], *[(x, pa.int64()) for x in longs[1:]]]]
            columns += [pa.concat_arrays([pa.nulls(lines, pa.binary()), pa.array(x, pa.binary())]) for x in ([piece_hashes[a:b].tobytes() for a, b, _ in spans], [packed(ps[a:b] - first, pe[a:b] - first, squeeze) for a, b, first in spans])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", "hash", "start", "end", *bands, "piece_hashes", "piece_runs"])

    return texts.where("id is not null").mapInArrow(tidy(cut), f"id long, text long, hash long, start int, end int, {', '.join(f'{x} long' for x in bands)}, piece_hashes binary, piece_runs binary")


def _piece_hashes(texts: DataFrame) -> DataFrame:
    """``id, hash`` of each piece of ``texts(id, piece_hashes)``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(b"".join(found), "<i8"), pa.int64())], ["id", "hash"])

    return texts.select("id", "piece_hashes").mapInArrow(tidy(each), "id long, hash long")


def _pieces_among(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """``id, text, hash, start, end`` of the pieces of ``texts(id, text, piece_hashes, piece_runs)`` whose hash is in ``hashes(id)``, and of a few others."""
    shared = among(hashes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_among, widen = shared(), zstandard.ZstdDecompressor()
        for batch in batches:
            found, runs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            values = np.frombuffer(b"".join(found), "<i8")
            row = np.repeat(np.arange(len(found)), [len(x) // 8 for x in found])
            kept = np.flatnonzero(is_among(values))
            row, base = row[kept], np.cumsum([0, *[len(x) // 8 for x in found]])
            starts, ends = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
            some, bounds = np.unique(row, return_index=True)
            for i, (a, b) in zip(some.tolist(), pairwise([*bounds.tolist(), len(row)]), strict=True):
                one, two = unpacked(runs[i], widen)
                starts[a:b], ends[a:b] = one[kept[a:b] - base[i]], two[kept[a:b] - base[i]]
            columns = [pa.array(batch.column(i).to_numpy()[row], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values[kept], pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "text", "hash", "start", "end"])

    return texts.select("id", "text", "piece_hashes", "piece_runs").mapInArrow(tidy(keep), "id long, text long, hash long, start int, end int")


def _line_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, hashes``: the shingle sets of the paragraphs whose hash is asked for (and a few others)."""

    def lines(docs: pa.Array, texts: pa.Array, cache: WordHashes) -> Iterator[tuple[np.ndarray, Callable]]:
        words = Words(texts.to_pylist())
        starts, ends = words.paragraphs()
        grams = ngram_hashes(words.values, SHINGLE)

        def distinct(i: int) -> np.ndarray:
            own = np.sort(grams[starts[i] : ends[i] - SHINGLE + 1])
            return own[np.append(True, own[1:] != own[:-1])]

        yield _summed(words.values, starts, ends).view(np.int64), distinct

    return sets_by_id(texts, ids, lines)


def joined(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of ``LEAST`` words or more that what overlaps or touches makes together, for rows of lists of ``start << 32 | end``."""
    row = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    both = runs.flatten().to_numpy()
    if not len(both):
        return row, row, row
    a, b = (row << 32) + (both >> 32), (row << 32) + (both & 0xFFFFFFFF)
    order = np.argsort(a)
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
    starts, ends = a[first], top[np.append(first[1:], len(a)) - 1]
    kept = ends - starts >= LEAST
    return starts[kept] >> 32, starts[kept] & 0xFFFFFFFF, ends[kept] & 0xFFFFFFFF


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_repeats, repeated_words, removed_words, spans, removals, components``.

    n_repeats counts runs of words that also stand in another document; spans and removals list runs as start:end in words (end exclusive),
    removals those that are not the copy to keep; components are the ids of the line components that the document has part in, each named by a line hash.
    Words are lower-cased (A-Z) and cut at ASCII white space. A null, empty or short text has no repeats. Repeats within one document alone do not
    count; rows that repeat an id are one document: the numbers of its different texts add up, their lists are joined by a semicolon, and a text that the id has twice counts once. Rows with a null id are left out. Other columns are ignored; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("_text"))
    units = materialize(_units(texts), "repeat-units")
    lines, pieces = units.where("hash is not null"), units.where("hash is null")
    bands = [f"band{i}" for i in range(BANDS)]

    classes = materialize(lines.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), *[F.min(x).alias(x) for x in bands]), "repeat-classes")
    banded = classes.select(F.col("hash").alias("id"), F.explode(F.array(*bands)).alias("shingle"))
    shared = banded.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    collide = materialize(banded.join(shared, "shingle"), "repeat-bands")
    few, many = collide.where(F.col("m") <= SHORT), collide.where(F.col("m") > SHORT).select("id").distinct()
    mate = few.select("shingle", F.col("id").alias("p_id"))
    pairs = materialize(few.join(mate, "shingle").where("p_id < id").select(F.col("p_id").alias("a"), F.col("id").alias("b")).distinct(), "repeat-pairs")
    many = materialize(many, "repeat-many")
    discard(collide)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(many).distinct()
    sets = materialize(_line_sets(texts, asked).dropDuplicates(["id"]), "repeat-sets")
    links = materialize(verified(pairs, sets, NUM, DEN), "repeat-links")
    if many.isEmpty():
        found = connected_components(links, "repeat")
    else:  # a long band by an exact prefix join of its lines: comparing all its pairs would grow with its square
        # the pairs of short bands are linked already, so only the lines of long ones take part
        hot = prefixes(maybe_among(sets, "id", many), stored_sets, NUM, DEN).drop("high", "low")
        found = linked_components(materialize(hot, "repeat-hot"), lambda _: sets, NUM, DEN, "repeat-hot", links)
    found = materialize(found, "repeat-near")
    discard(pairs, sets)
    of_line = classes.drop(*bands).join(found.withColumnRenamed("id", "hash"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    groups = of_line.groupBy("component").agg(F.min("first").alias("keeper"), F.max("last").alias("last")).where("keeper < last")
    runs_of = ["id", "text", "start", "end", "component", "keeper"]
    repeated_lines = lines.select("hash", *runs_of[:4]).join(of_line.join(groups, "component").select("hash", "component", "keeper"), "hash").select(*runs_of)

    twice = _piece_hashes(pieces).groupBy("hash").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last").select("hash", "keeper")
    twice = materialize(twice, "repeat-twice")
    repeated_pieces = _pieces_among(pieces, twice.select("hash")).join(twice, "hash").withColumn("component", F.lit(None).cast("long")).select(*runs_of)

    run = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    runs = repeated_lines.unionAll(repeated_pieces).groupBy("id", "text").agg(  # of one text
        F.collect_set(run).alias("all"), F.collect_set(F.when(F.col("keeper") < F.col("id"), run)).alias("go"), F.array_sort(F.collect_set("component")).alias("components")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, said, words, counts = batch.num_rows, [], [], []
            for i in (2, 3):
                row, starts, ends = joined(batch.column(i))
                counts.append(np.bincount(row, minlength=n))
                words.append(np.bincount(row, weights=ends - starts, minlength=n).astype(np.int64))
                each, bounds = [f"{a}:{b}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.cumsum([0, *counts[-1]]).tolist()
                said.append([",".join(each[a:b]) for a, b in pairwise(bounds)])
            named = [c if k else [] for c, k in zip(batch.column(4).to_pylist(), counts[0].tolist(), strict=True)]
            columns = [*[pa.array(x, pa.int64()) for x in (counts[0], *words)], *[pa.array(x, pa.string()) for x in said], pa.array(named, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text", "n_repeats", "repeated_words", "removed_words", "spans", "removals", "components"])

    merged = runs.mapInArrow(tidy(merge), "id long, text long, n_repeats long, repeated_words long, removed_words long, spans string, removals string, components array<long>")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("text", c)))), lambda x: x[c]), ";").alias(c)
    merged = merged.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_repeats", "repeated_words", "removed_words")], listed("spans"), listed("removals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("components")))).alias("components"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = ids.join(merged, "id", "left")
    return out.select(
        F.col("id").alias("doc_id"), zero("n_repeats"), zero("repeated_words"), zero("removed_words"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("removals", F.lit("")).alias("removals"),
        F.coalesce("components", F.array().cast("array<long>")).alias("components"),
    )
