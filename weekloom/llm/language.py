"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 4, hashed into ``DIM`` slots; the kernel of two texts is the size of the
intersection over the geometric mean of the sizes. Nyström features over ``LANDMARKS`` texts feed a one-versus-rest kernel ridge
regression. As the kernel is linear in the (normalised) presence vectors, landmarks and regression multiply out to one DIM x
languages matrix, and texts are scored by products of their presence matrix with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, tidy

DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
#: At most so many training texts of each language, those with the smallest hash of their id, and so many languages.
PER_LANGUAGE, LANGUAGES = 400, 200
#: Ids are picked in so many parts before they are picked in all.
PARTS = 64
LANDMARKS = 320
#: Texts whose presence vectors are multiplied together.
TOGETHER = 64
RIDGE = 1e-3
SHARPNESS = 6.0

#: Case-folds A-Z and turns every other ASCII character into a space, byte by byte.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))



def grams(text: str, scratch: np.ndarray) -> np.ndarray:
    """Sorted slots of the text's n-grams; empty if there is no letter. ``scratch`` is DIM False values and stays so."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    data = b" " + b" ".join(data.split()) + b" "
    if len(data) <= 2 or data.isascii() is False and not any(c.isalpha() for c in text):
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(len(b), dtype=np.uint32)
    for n in ORDERS:
        if n > len(b):
            break
        h = (h[: len(b) - n + 1] * np.uint32(0x01000193)) ^ b[n - 1 :] * np.uint32(0x9E3779B1) if n > 1 else b * np.uint32(0x9E3779B1)
        scratch[(h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(17)] = True
    found = np.flatnonzero(scratch)
    scratch[found] = False
    return found


def fit(texts: list[str], langs: list[str], scratch: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The learned languages, and the matrix whose rows a normalised presence vector adds up to its scores."""
    sets = [grams(t, scratch) for t in texts]
    kept = [i for i, s in enumerate(sets) if len(s)]
    names = sorted({langs[i] for i in kept})
    if not names:
        return [], np.zeros((DIM, 0), dtype=np.float32)

    def presence(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), DIM), dtype=np.float32)
        for r, i in enumerate(rows):
            out[r, sets[i]] = 1 / np.sqrt(len(sets[i]))
        return out

    order: list[int] = []  # landmarks: languages take turns
    turns = {name: [i for i in kept if langs[i] == name] for name in names}
    for at in range(max(map(len, turns.values()))):
        order += [of[at] for of in turns.values() if at < len(of)]
    marks = presence(order[:LANDMARKS])
    kernel = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([presence(kept[i : i + 256]) @ marks.T for i in range(0, len(kept), 256)]).astype(np.float64) @ half
    wanted = np.array([[float(langs[i] == name) for name in names] for i in kept])
    size = 1 / np.maximum(wanted.sum(axis=0), 1)
    share = (wanted @ size)[:, None]  # each language weighs the same
    weights = np.linalg.solve(features.T @ (features * share) + RIDGE * np.eye(features.shape[1]), features.T @ (wanted * share))
    return names, (marks.T.astype(np.float64) @ (half @ weights)).astype(np.float32)


def _held_out(identity: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """The model of the labelled rows of ``docs`` that are not held out: languages and matrix."""
    identity = F.col(id_col).cast("long")
    known = docs.select(identity.alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), _held_out(identity).alias("held"))
    known = known.where("id is not null and text is not null and lang is not null and not held")
    # ids are picked first, so that no text is sorted or shuffled for the sample; in parts first, so that no task sees all rows of a language
    order = (F.xxhash64("id"), "id")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS))
    some = known.select("lang", "id").withColumn("at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("at") <= PER_LANGUAGE)
    picked = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= PER_LANGUAGE)
    picked = picked.orderBy("at", "lang", "id").limit(PER_LANGUAGE * LANGUAGES).select("lang", "id").distinct()
    sample = known.join(F.broadcast(picked), ["lang", "id"]).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()  # PER_LANGUAGE * LANGUAGES rows at most
    sample = sorted((r.id, r.lang, r.text) for r in sample)
    return fit([t for _, _, t in sample], [x for _, x, _ in sample], np.zeros(DIM, dtype=bool))


def predicted(texts: list[str | None], names: list[str], matrix: np.ndarray) -> list[tuple[str, float]]:
    """The language of each text and its score; ``und`` and 0 if it has no letter or nothing is learned. TOGETHER presence vectors make a matrix product."""
    scratch, presence = np.zeros(DIM, dtype=bool), np.zeros((TOGETHER, DIM), dtype=np.float32)
    out: list[tuple[str, float]] = []
    for at in range(0, len(texts), TOGETHER):
        sets = [grams(t, scratch) if t and names else grams("", scratch) for t in texts[at : at + TOGETHER]]
        for row, own in zip(presence, sets, strict=False):
            row[own] = 1
        values = presence[: len(sets)].astype(np.float32, copy=False) @ matrix
        for row, own, value in zip(presence, sets, values.astype(np.float64), strict=False):
            row[own] = 0
            if not len(own):
                out.append(("und", 0.0))
                continue
            value = value / np.sqrt(len(own))
            e = np.exp(SHARPNESS * (value - value.max()))
            out.append((names[int(value.argmax())], float(e.max() / e.sum())))
    return out


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``.

    Rows whose crc32(id as text) mod 3 is 1 are held out; the others with a non-null language (and text) are what the model learns from.
    lang_pred is a learned language, ``und`` with score 0 for a null text, a text without a letter, or when nothing could be learned. The score is the
    softmax of the regression's values. Null ids are not held out and not learned from. Repeated rows
    give repeated results, and of texts that repeat an id and a language one is learned from; whole texts are read; other columns are ignored; an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, id_col, text_col, lang_col))  # DIM x languages, whatever the data

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predicted(batch.column(2).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    identity = F.col(id_col).cast("long")
    rows = docs.select(identity.alias("doc_id"), _held_out(identity).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not ``und`` and has a score of ``least`` or more.

    A null text and a text without a letter have no language and go. Repeated rows stay as often as they are; an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, id_col, text_col, lang_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predicted(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), *shared.value)
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
