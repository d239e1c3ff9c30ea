"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

Each pre-token is a doubly linked list of byte runs. Every adjacent pair that is a token waits in the bucket of its
rank; a bitmap over ranks, with two coarser bitmaps above, gives the lowest non-empty bucket by find-first-set.
Entries whose list position has changed since are skipped. Work is linear in merges, whatever the pre-token's length."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, tidy

#: Pre-tokens remembered in each of two generations by a worker.
REMEMBERED = 40_000
#: Rows of an Arrow batch that are encoded together.
TOGETHER = 2500
#: Pre-tokens of more bytes go through a queue of their own.
LONG = 128
NONE = np.int32(2**31 - 1)


def rank_file(spark, path: str) -> bytes:
    """The rank file, a base64 token and its rank a line, as Spark reads it, so that it may be in any store."""
    if "://" not in path:
        path = f"file://{path}"
    return "\n".join(r.value for r in spark.read.text(path).collect() if r.value.strip()).encode()


def vocabulary_of(ranks: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())})


class Vocabulary:
    """Ranks, tokens, the empty rank queue, and what this process has encoded lately.

    The queue: ``buckets[rank]`` holds list positions, one for most ranks and a heap where there are several; ``low`` has a bit for
    each non-empty bucket, ``mid`` one for each non-zero word of ``low``, ``top`` one for each of ``mid``. It is empty between pre-tokens, so its arrays
    serve for all."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.buckets: list[list[int] | None] = [None] * (max(ranks.values(), default=0) + 1)
        self.low = [0] * ((len(self.buckets) >> 6) + 1)
        self.mid = [0] * ((len(self.low) >> 6) + 1)
        self.recent: dict = {}
        self.older: dict = {}
        self._pairs()

    def _pairs(self) -> None:
        """Sorted keys left * 2^32 + right of the pairs of tokens whose bytes together are a token, and its rank."""
        get, keys, made = self.ranks.get, [], []
        for t, rank in self.ranks.items():
            for cut in range(1, len(t)):
                left, right = get(t[:cut]), get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(made, dtype=np.int32)[order]
        self.byte_ids = np.array([get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; NONE where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE) if len(self.pair_keys) else np.full(len(keys), NONE, np.int32)

    def encode_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of many short pre-tokens, through one rank queue whose buckets hold positions of all of them.

        A visit to the lowest bucket merges, in every pre-token, the leftmost position that is not stale; others go back
        into the bucket, so each pre-token sees the order of merges that it would see alone."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        n, ends = len(data), np.cumsum(sizes)
        if not n:
            return [np.zeros(0, np.int64) for _ in pieces]
        tok = self.byte_ids[data]
        of = np.repeat(np.arange(len(pieces)), sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
        rank_at, alive = np.full(n, NONE, np.int32), np.ones(n, dtype=bool)
        starts = np.flatnonzero(nxt >= 0)
        rank_at[starts] = self.pair_rank(tok[starts], tok[starts + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        low, mid, top = [0] * len(self.low), [0] * len(self.mid), 0

        def push(ranks: np.ndarray, at: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, a, b in zip(ranks[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if r in buckets:
                    buckets[r].append(at[a:b])
                    continue
                buckets[r] = [at[a:b]]
                w = r >> 6
                low[w] |= 1 << (r & 63)
                mid[w >> 6] |= 1 << (w & 63)
                top |= 1 << (w >> 6)

        live = starts[rank_at[starts] != NONE]
        if len(live):
            push(rank_at[live], live)
        while top:
            g = (top & -top).bit_length() - 1
            w = (g << 6) + (mid[g] & -mid[g]).bit_length() - 1
            rank = (w << 6) + (low[w] & -low[w]).bit_length() - 1
            held = buckets.pop(rank)
            low[w] &= low[w] - 1
            if not low[w]:
                mid[g] &= mid[g] - 1
                if not mid[g]:
                    top &= top - 1
            at = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
            at = at[rank_at[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                whose = of[at]
                later = whose[1:] == whose[:-1]
                if later.any():
                    first = np.concatenate([[True], ~later])
                    rest, at = at[~first], at[first]
                    push(np.full(len(rest), rank), rest)
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = rank
            nxt[at] = after
            rank_at[gone] = NONE
            alive[gone] = False
            rank_at[at] = NONE
            has = after >= 0
            right, left = at[has], prv[at]
            prv[after[has]] = right
            back = left >= 0
            left = left[back]
            changed = np.concatenate([right, left])
            if len(changed):
                new = self.pair_rank(tok[changed], np.concatenate([tok[after[has]], tok[at[back]]]))
                rank_at[changed] = new
                can = new != NONE
                if can.any():
                    push(new[can], changed[can])
        ids = tok[alive]
        return np.split(ids, np.cumsum(np.bincount(of[alive], minlength=len(pieces)))[:-1])

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: always merge the pair of lowest rank, the leftmost first."""
        ranks, get = self.ranks, self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        buckets, low, mid, top = self.buckets, self.low, self.mid, 0
        n = len(piece)
        end = list(range(1, n + 2))  # end[i]: where the run that begins at i ends; 0 once it is merged away
        before = list(range(-1, n))
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                if buckets[r]:
                    buckets[r].append(i)  # positions come in order here, so the list is a heap
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        while top:
            g = (top & -top).bit_length() - 1
            m = mid[g]
            w = (g << 6) + (m & -m).bit_length() - 1
            m = low[w]
            rank = (w << 6) + (m & -m).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                buckets[rank] = None
                low[w] = m = m & (m - 1)
                if not m:
                    mid[g] = m = mid[g] & (mid[g] - 1)
                    if not m:
                        top &= top - 1
            j = end[i]
            if not j or j >= n:
                continue  # stale: merged away, or the last run by now
            k = end[j]
            if get(piece[i:k]) != rank:
                continue  # stale: a longer run by now
            end[i] = k
            end[j] = 0
            fresh = ()
            if k < n:
                before[k] = i
                r = get(piece[i : end[k]])
                if r is not None:
                    fresh = ((r, i),)
            if i:
                h = before[i]
                r = get(piece[h:k])
                if r is not None:
                    fresh += ((r, h),)
            for r, at in fresh:
                if buckets[r]:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, wanted: list[str]) -> list[tuple[int, str, bytes]]:
        """For each of the distinct pre-tokens: how many ids, the ids joined by commas, the bytes that they decode to. Short ones are remembered."""
        out = [self.recent.get(piece) or self.older.get(piece) for piece in wanted]
        new = [i for i, got in enumerate(out) if got is None]
        data = {i: wanted[i].encode("utf-8") for i in new}
        short = [i for i in new if len(data[i]) <= LONG and data[i] not in self.ranks]
        found = dict(zip(short, self.encode_many([data[i] for i in short]), strict=True)) if short else {}
        for i in new:
            ids = found[i].tolist() if i in found else self.encode_piece(data[i])
            out[i] = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        for piece, got in zip(wanted, out, strict=True):
            if len(piece) <= LONG and piece not in self.recent:
                if len(self.recent) >= REMEMBERED:
                    self.older, self.recent = self.recent, {}
                self.recent[piece] = got
        return out


class Numbers(dict):
    """Numbers keys in the order they are met."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def encode_text(text: str, pattern, vocabulary: Vocabulary) -> list[int]:
    return [t for piece in pattern.findall(text) for t in vocabulary.encode_piece(piece.encode("utf-8"))]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, ``with_ids``, the ``ids`` themselves.

    A null text counts as empty and has no tokens; both digests are then those of no bytes. Each match of the pattern is encoded
    separately (the public patterns match every character); no special tokens. Whole texts are encoded, of any length; a pre-token of many
    bytes costs no more a byte than a short one. Rows are handled alone: repeated rows give repeated results, null ids are kept, other
    columns ignored, and an empty table gives an empty result."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(rank_file(spark, ranks_path))  # its size does not depend on the data

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(shared.value)
        split = regex.compile(pattern)
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            counts, hashes, back, lists = [], [], [], []
            numbers = Numbers()
            of_texts = [np.fromiter(map(numbers.__getitem__, split.findall(t or "")), dtype=np.int32) for t in batch.column(1).to_pylist()]
            learned = known.learn(list(numbers))
            n, joined, data = np.array([x[0] for x in learned], dtype=np.int64), [x[1] for x in learned], [x[2] for x in learned]
            for pieces in of_texts:
                listed = pieces.tolist()
                ids = ",".join([joined[i] for i in listed])
                counts.append(int(n[pieces].sum()))
                hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([data[i] for i in listed])).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(ids, dtype=np.int32, sep=",") if ids else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(encode), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def bpe_decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``doc_id, bytes``, the bytes of the ids in order; null or empty lists give no bytes, an unknown id an error."""
    spark = rows.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(rank_file(spark, ranks_path))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(back), "doc_id long, bytes binary")
