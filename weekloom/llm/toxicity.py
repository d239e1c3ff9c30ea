"""Toxicity with subword-bag embeddings.

A word is the average of the vectors of its character n-grams, boundary marks included; a text the average of its words, every
occurrence counting, times ``SCALE``; a linear softmax over that gives the class. Vectors start from the log-odds of their n-grams; they and the softmax
are trained jointly, in numpy, by Adagrad on small batches, until the loss on a part of the sample set aside stops falling. A misspelt word shares most n-grams with the word
meant and so its vector. As everything after the n-grams is linear, a trained model folds into one number a slot, and a batch of texts is scored
with a few passes over the array of its characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, tidy

SLOTS, WIDTH = 1 << 19, 4
ORDERS = (3, 4, 5, 6)
#: At most so many texts with label 0 and with label 1 are learned from, those with the smallest hash of their id.
SAMPLE = (3000, 2000)
#: One in so many of them is set aside to tell when to stop.
ASIDE = 8
EPOCHS, PATIENCE, BATCH, STEP, DECAY = 6, 2, 4, 0.05, 1e-7
#: A few words decide about a text, so their share of the average is small; this lifts it to the size that softmax and step fit.
SCALE = 128.0
#: Standard errors by which a slot's log-odds must differ from 0 for its vector to start there.
SURE = 2.5
CUT = 0.7
#: Characters that are looked at together.
TOGETHER = 1 << 18


def _letters(text: str) -> np.ndarray:
    """Code points between two spaces; lower case, and a space for every other ASCII character."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((c >= 128) | (c >= 97) & (c <= 122), c, np.uint32(32)).astype(np.uint32)


def ngrams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, beginnings) of all n-grams in an array of letters and spaces: a space may be the first or last of an n-gram, which marks
    where a word begins or ends, but not inside. An n-gram of no letters is none."""
    space = c == 32
    slots, at = [], []
    h = c * np.uint32(0x9E3779B1)
    open_ = np.ones(len(c), dtype=bool)  # no space inside the n-gram that begins here, its first character aside
    for n in range(2, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        if n > 2:
            open_ = open_[:m] & ~space[n - 2 : n - 2 + m]
        h = (h[:m] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x85EBCA77))
        if n in ORDERS:
            found = np.flatnonzero(open_[:m])
            x = h[found]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39 + 2 * n)
            slots.append(((x ^ (x >> np.uint32(15))) & np.uint32(SLOTS - 1)).astype(np.int32))
            at.append(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(slots), np.concatenate(at)) if slots else (none.astype(np.int32), none)


def shares(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of each n-gram, n-grams of each word): a word's n-grams begin at the space before it or at a letter of it."""
    space = c == 32
    begins = space & ~np.append(space[1:], True)
    word = np.cumsum(begins)[at] - 1
    return word, np.bincount(word, minlength=int(begins.sum()))


def bag_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text, and what each weighs in its average."""
    c = _letters(text or "")
    slots, at = ngrams(c)
    word, sizes = shares(c, at)
    if not len(sizes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    own, place = np.unique(slots, return_inverse=True)
    return own.astype(np.int32), (np.bincount(place, weights=1 / sizes[word]) / len(sizes)).astype(np.float32)


class Bags:
    """The bags of texts, their slots numbered from 0 in ``used``; a text of no words has one slot of no weight."""

    def __init__(self, texts: list[str]):
        bags = [bag_of(t) for t in texts]
        bags = [b if len(b[0]) else (np.zeros(1, np.int32), np.zeros(1, np.float32)) for b in bags]
        seen = np.zeros(SLOTS, dtype=bool)
        for own, _ in bags:
            seen[own] = True
        self.used = np.flatnonzero(seen)
        number = (np.cumsum(seen) - 1).astype(np.int32)
        self.bags = [(number[own], weights * np.float32(SCALE)) for own, weights in bags]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slots, weights, sizes, starts) of some texts."""
        some = [self.bags[i] for i in rows]
        sizes = np.array([len(own) for own, _ in some])
        return np.concatenate([own for own, _ in some]), np.concatenate([w for _, w in some]), sizes, np.cumsum(sizes) - sizes


def log_odds(bags: Bags, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each slot, how much commoner it is in texts of label 1 than of label 0, as a log ratio; towards 0 where the counts are too small to tell."""
    counts = []
    for label in (0, 1):
        of = rows[y[rows] == label]
        n = np.zeros(len(bags.used))
        for i in of:
            n[bags.bags[i][0]] += 1
        counts.append((n + 1.0, len(of) + 2.0))
    (a, n), (b, m) = counts
    ratio = np.log(b / m) - np.log(a / n)
    sure = ratio / np.sqrt(1 / a + 1 / b)
    return (ratio * np.maximum(0.0, 1 - (SURE / np.maximum(np.abs(sure), 1e-9)) ** 2)).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the slots, softmax weights and bias."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((SLOTS, WIDTH), dtype=np.float32)
    weights, bias = rng.normal(0, 1, (WIDTH, 2)), np.zeros(2)
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return vectors, weights, np.zeros(2) if not len(y) else np.array([5.0, -5.0]) * (1 - 2 * y[0])
    bags = Bags(texts)
    own = rng.normal(0, 0.01, (len(bags.used), WIDTH)).astype(np.float32)  # n-grams that no training text has stay 0 and say nothing
    order = rng.permutation(len(y))
    own[:, 0] += log_odds(bags, y, order[len(y) // ASIDE :])
    weights[0] = -0.5, 0.5
    aside, learn = order[: len(y) // ASIDE], order[len(y) // ASIDE :]
    seen_v, seen_w, seen_b = np.full(own.shape, 1e-6, dtype=np.float32), np.full((WIDTH, 2), 1.0), np.full(2, 1.0)
    onehot = np.eye(2)[y]

    def forward(rows: np.ndarray) -> tuple:
        slots, share, sizes, starts = bags.of(rows)
        text = np.add.reduceat(own[slots] * share[:, None], starts, axis=0).astype(np.float64)
        logits = text @ weights + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return slots, share, sizes, text, p / p.sum(axis=1, keepdims=True)

    def loss() -> float:
        p = np.concatenate([forward(aside[i : i + 256])[-1] for i in range(0, len(aside), 256)])
        return float(-np.log(np.maximum((p * onehot[aside]).sum(axis=1), 1e-12)).mean())

    best, kept, worse = np.inf, (own.copy(), weights.copy(), bias.copy()), 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(learn)
        for i in range(0, len(mixed), BATCH):
            rows = mixed[i : i + BATCH]
            slots, share, sizes, text, p = forward(rows)
            g = p - onehot[rows]
            to_text = np.repeat((g @ weights.T).astype(np.float32), sizes, axis=0) * share[:, None]
            u, inverse = np.unique(slots, return_inverse=True)
            to_own = np.stack([np.bincount(inverse, weights=to_text[:, k]) for k in range(WIDTH)], axis=1).astype(np.float32) + np.float32(DECAY) * own[u]
            to_weights = text.T @ g
            seen_v[u] += to_own**2
            own[u] -= STEP * to_own / np.sqrt(seen_v[u])
            seen_w += to_weights**2
            weights -= STEP * to_weights / np.sqrt(seen_w)
            seen_b += g.sum(axis=0) ** 2
            bias -= STEP * g.sum(axis=0) / np.sqrt(seen_b)
        now = loss() if len(aside) else 0.0
        worse = 0 if now < best - 1e-4 else worse + 1
        if now < best:
            best, kept = now, (own.copy(), weights.copy(), bias.copy())
        if worse >= PATIENCE:
            break
    vectors[bags.used] = kept[0]
    return vectors, kept[1], kept[2]


def worth_of(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """What each slot adds to the logit of label 1, and what is there without any."""
    vectors, weights, bias = model
    return (vectors @ (weights[:, 1] - weights[:, 0]).astype(np.float32)) * np.float32(SCALE), float(bias[1] - bias[0])


def logits(texts: list[str | None], worth: np.ndarray, rest: float) -> np.ndarray:
    """The logit of label 1 for each text."""
    out = np.full(len(texts), rest)
    at, part, size = [], [], 0

    def add() -> None:
        c = np.concatenate(part)
        slots, begins = ngrams(c)
        word, sizes = shares(c, begins)
        if len(sizes):
            value = np.bincount(word, weights=worth[slots], minlength=len(sizes)) / np.maximum(sizes, 1)
            space = c == 32
            first = np.flatnonzero(space & ~np.append(space[1:], True))
            text = np.searchsorted(np.cumsum([len(x) for x in part]), first, side="right")
            words = np.bincount(text, minlength=len(part))
            out[at] += np.bincount(text, weights=value, minlength=len(part)) / np.maximum(words, 1)

    for i, text in enumerate(texts):
        at.append(i)
        part.append(_letters(text or ""))
        size += len(part[-1])
        if size >= TOGETHER or i + 1 == len(texts):
            add()
            at, part, size = [], [], 0
    return out


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60.0, 60.0)))


def held_out(identity: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of the labelled rows that are not held out. The driver gets at most one text for each of SAMPLE ids."""
    identity, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    marks = labels.select(identity.alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    picked = [marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most) for label, most in enumerate(SAMPLE)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # SAMPLE rows at most
    known = docs.select(identity.alias("id"), text.alias("text")).where("text is not null").join(chosen, "id")
    sample = sorted(known.groupBy("id", "label").agg(F.min("text").alias("text")).collect())
    return fit([r.text for r in sample], [r.label for r in sample])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``; score is the probability of label 1, predicted whether it is 0.7 or more.

    Learned from labelled rows whose crc32(id as text) mod 3 is not 1 (those are held out); labels other than 0 and 1, null labels, null ids and null
    texts are not learned from. Of labels that repeat an id the largest counts, of texts the least. A null or empty text scores like a text of no words. Without labels of both
    classes the score is the only class's near-certainty, 0.5 without any. Whole texts and words of any length are read. Repeated rows give repeated results; null ids are kept; other columns are
    ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    bound_batches(spark)
    identity, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    model = spark.sparkContext.broadcast(worth_of(learned(docs, labels, id_col, text_col, label_col)))  # SLOTS numbers, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = probability(logits(batch.column(2).to_pylist(), *model.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(identity.alias("doc_id"), held_out(identity).alias("held_out"), text.alias("text")).mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")
