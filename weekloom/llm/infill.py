"""Fill-in-the-middle: documents are cut in three at unit boundaries and rearranged, so that a left-to-right model learns to fill gaps.

A text becomes an array of code points (UTF-32). Each code point has a class, a unit ends where neighbouring classes say so, and
``flatnonzero`` gives all boundaries of a text at once; two ranks picked by a hash of the document's id choose the cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")
#: White space as ``shared.WORD`` has it.
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of a text end, as counts of code points: 0, then the end of each unit, the last at the end of the text.

    Lines end behind each line feed. Words and stretches of white space alternate as units. Characters are units of one code point."""
    n = len(points)
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    if unit == "char":
        return np.arange(n + 1)
    if unit == "line":
        ends = points[:-1] == 10
    else:
        kind = np.isin(points, SPACES)
        ends = kind[1:] != kind[:-1]
    return np.concatenate([[0], np.flatnonzero(ends) + 1, [n]])


def cut(text: str, key: str, unit: str, seed: str, share: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; the first four 8-digit groups of a digest of seed and key decide."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = boundaries(points, unit)
    n = len(at) - 1
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or h3 % 100 >= share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    one, two = at[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    first, middle, last = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (points[:one], points[one:two], points[two:]))
    if h4 % 100 < spm:
        return n, "spm", one, two - one, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", one, two - one, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``cut`` was given."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    one, two = head.split(SUFFIX if form == "psm" else PREFIX)
    if form == "psm":
        return one.removeprefix(PREFIX) + middle + two
    return two + middle + one.removeprefix(SUFFIX)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: str = "7", share: int = 100, spm: int = 50, with_output: bool = True) -> DataFrame:
    """Per row: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, and ``output`` unless ``with_output`` is false.

    The whole text (null counts as empty) is cut into n units (lines with their line feeds, words, or characters). The hex SHA-256 of ``seed:doc_id``
    (nothing for a null id) gives four numbers: two choose how many units stand before the middle and before the suffix, the third lets ``share`` of a hundred texts be
    rearranged, the fourth gives ``spm`` of a hundred of those the suffix first. Empty texts, and texts that hold a mark, stay plain, with null
    lengths. ``restored_sha256`` is of the text rebuilt from output and form. Rows are handled alone: repeated rows give repeated results,
    null ids are kept, other columns ignored, an empty table gives an empty result, and a text may be of any length."""
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    keep = len(names) - (not with_output)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, form, before, inside, output = cut(text or "", "" if key is None else str(key), unit, seed, share, spm)
                rows.append((key, n, form, before, inside, sha(output), sha(restore(output, form)), output)[:keep])
            columns = list(zip(*rows, strict=True)) or [()] * keep
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[:keep])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return rows.mapInArrow(tidy(run), schema + (", output string" if with_output else ""))


#: The digests in DuckDB; ``docs`` is the name of the documents. The text is rebuilt from its three pieces.
INFILL_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from {docs}
), g as (
  select doc_id, t, u, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from g
), p as (
  select *, array_to_string(u[1:one], '') as a, array_to_string(u[one + 1:two], '') as m, array_to_string(u[two + 1:], '') as z from c
)
select doc_id, n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) as output_sha256,
  sha256(case when form = 'plain' then t else a || m || z end) as restored_sha256
from p
"""
