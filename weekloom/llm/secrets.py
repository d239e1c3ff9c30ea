"""Secret scans with a worklist of decoded layers.

The text is the first layer. Each layer is scanned, then searched for encoded stretches (URL escapes, Unicode and HTML character
escapes, base64, and compressed data inside base64); what they decode to are new layers, until none is left. A layer equal to one
it came from is not followed (cycles). Every character of a layer knows the stretch of the text that it stems from, so
finds in any layer are given as code points of the text."""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, tidy

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this keeps those of 24 and more
HINTS = ("passw", "secret", "token", "apikey", "api_key")

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A percent sign that was itself escaped again and again. Beyond NESTED times all its layers are unwrapped at once: they differ in the number of 25s only.
NESTED = 16
DEEP = re.compile(r"%(?:25){" + str(NESTED) + r",}")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: A maximal run, with the lines that go on with it; only those of SHORTEST characters and more are decoded.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++)={0,2}")
SEGMENT = re.compile(r"[A-Za-z0-9+/_-]+")
SHORTEST = 16
URLSAFE = str.maketrans("-_", "+/")
#: Where compressed data begin: gzip, zlib, bzip2, xz.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00", re.DOTALL)
#: Six ASCII characters in UTF-16, of either byte order.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){6}")
#: Unpacked data are read in blocks of about so many bytes, which overlap; a run of what encoded text is made of is never cut, however long.
BLOCK, OVERLAP = 1 << 22, 1 << 16
RUNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;{} \t\r\n"
#: Packed data inside packed data, so deep: some unpack to themselves.
DEEPEST = 100


def scan(text: str) -> list[tuple[int, int, str]]:
    """Base finds of one layer: (start, end, kind)."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _from_url(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(s: str) -> str | None:
    if s.startswith("\\u") and not s.startswith("\\u{"):
        return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")
    digits = s.strip("\\uUx&#X{};")
    point = int(digits, 10 if s.startswith("&#") and s[2] not in "xX" else 16)
    return chr(point) if point < 0xD800 or 0xDFFF < point < 0x110000 else None


def unpacked(source: Iterator[bytes]) -> Iterator[bytes]:
    """What the compressed data that begin ``source`` hold, member by member, in parts of at most BLOCK bytes; of broken data what stands before the break."""
    data, d = b"", None
    try:
        while True:
            if d is None:
                while len(data) < 6 and (more := next(source, b"")):
                    data += more
                if not (m := PACKED.match(data)):
                    return
                d = bz2.BZ2Decompressor() if m[0][:1] == b"B" else lzma.LZMADecompressor() if m[0][:1] == b"\xfd" else zlib.decompressobj(47)
            out = d.decompress(data, BLOCK)
            data = getattr(d, "unconsumed_tail", b"")
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, None
            elif not data and not out and getattr(d, "needs_input", True) and not (data := next(source, b"")):
                return
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return


def may_unpack(start: bytes) -> bool:
    """Whether these bytes, which look like the beginning of packed data, are one: those of bzip2 and xz by their marks, the others by what they give."""
    if start[:3] == b"BZh":
        return start[4:10] in (b"1AY&SY", b"\x17rE8P\x90")
    return start[:1] == b"\xfd" or bool(next(unpacked(iter([start])), b""))


def in_blocks(data: Iterator[bytes]) -> Iterator[bytes]:
    """The data in overlapping blocks; a block ends before a run that goes on in the next."""
    held, seen = b"", 0  # the first ``seen`` bytes of what is held were in a block before
    for part in data:
        held += part
        if len(held) - seen >= BLOCK:
            end = len(held.rstrip(RUNS))
            if end > seen:
                yield held[:end]
                at = max(0, end - OVERLAP)
                held, seen = held[at:], end - at
    if len(held) > seen or not seen:
        yield held


def layers_of(data: Iterator[bytes], depth: int = 0) -> Iterator[bytes]:
    """Blocks of unpacked data, and of those packed inside them, wherever they begin."""
    data, rest = itertools.tee(data)
    offset, tried, read = 0, -1, 0  # of the block, of the last beginning tried, of what the second reader has passed
    waiting = b""
    for block in in_blocks(data):
        yield block
        for m in PACKED.finditer(block) if depth < DEEPEST else ():
            at = offset + m.start()
            if at <= tried or not may_unpack(block[m.start() : m.start() + OVERLAP]):
                continue
            tried = at
            while read + len(waiting) <= at:  # go on to where the packed data begin
                read, waiting = read + len(waiting), next(rest)
            rest, twin = itertools.tee(rest)
            yield from layers_of(unpacked(itertools.chain([waiting[at - read :]], twin)), depth + 1)
        offset += max(0, len(block) - OVERLAP)
        while read + len(waiting) <= offset and (more := next(rest, b"")):  # what is behind needs no memory
            read, waiting = read + len(waiting), more


def texts_of(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, number of its first byte, bytes a character or 0 if UTF-8); a byte that can't be read becomes one character."""
    yield data.decode("utf-8", "surrogateescape"), 0, 0
    if WIDE.search(data):
        for odd in (0, 1):
            size = (len(data) - odd) // 2 * 2
            yield "".join(map(chr, memoryview(data[odd : odd + size]).cast("H"))), odd, 2


class Layer:
    """A decoded text; begin and end give, for each character, where it stems from, or one stretch for all."""

    def __init__(self, text: str, begin, end, above: frozenset):
        self.text, self.begin, self.end = text, begin, end
        self.own = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.above = above

    def stretch(self, start: int, end: int) -> tuple[int, int]:
        if self.begin is None:
            return start, end
        if isinstance(self.begin, int):
            return self.begin, self.end
        return self.begin[start], self.end[end - 1]

    def decoded_in_place(self, pattern: re.Pattern, decode) -> Layer | None:
        """The whole layer with every match replaced by what it decodes to."""
        parts, begin, end, at = [], [], [], 0
        flat = isinstance(self.begin, int)

        def keep(a: int, b: int) -> None:
            parts.append(self.text[a:b])
            if not flat:
                begin.extend(range(a, b) if self.begin is None else self.begin[a:b])
                end.extend(range(a + 1, b + 1) if self.begin is None else self.end[a:b])

        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None:
                continue
            keep(at, m.start())
            a, b = self.stretch(m.start(), m.end())
            parts.append(new)
            if not flat:
                begin.extend([a] * len(new))
                end.extend([b] * len(new))
            at = m.end()
        if not parts:
            return None
        keep(at, len(self.text))
        return Layer("".join(parts), self.begin if flat else begin, self.end if flat else end, self.above | {self.own})

    def from_base64(self, m: re.Match) -> Iterator[Layer]:
        """A run can begin anywhere in what matches, so all four alignments are decoded."""
        segments = [x.span() for x in SEGMENT.finditer(self.text, m.start(), m.end())]
        bare = "".join(self.text[a:b] for a, b in segments).translate(URLSAFE)
        if len(bare) < SHORTEST:
            return
        segments[-1] = (segments[-1][0], m.end())
        above = self.above | {self.own}
        for shift in range(4):
            part = bare[shift : len(bare) - ((len(bare) - shift) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            for text, first, width in texts_of(data):
                yield Decoded(text, self, segments, shift, first, width, above)
            whole = None
            for packed in PACKED.finditer(data):
                if not may_unpack(data[packed.start() : packed.start() + OVERLAP]):
                    continue
                whole = whole or Decoded(data.decode("latin-1"), self, segments, shift, 0, 1, above)
                for block in layers_of(unpacked(iter([data[packed.start() :]]))):
                    begin, end = whole.stretch(packed.start(), len(data))
                    for text, _, _ in texts_of(block):
                        yield Layer(text, begin, end, above)

    def inner(self) -> Iterator[Layer]:
        if "%" in self.text:
            if "25" * NESTED in self.text and (x := self.decoded_in_place(DEEP, lambda _: "%25")):
                yield x
            elif x := self.decoded_in_place(ESCAPES, _from_url):
                yield x
        if ("\\" in self.text or "&#" in self.text) and (x := self.decoded_in_place(UNICODE, _from_unicode)):
            yield x
        for m in BASE64.finditer(self.text):
            yield from self.from_base64(m)


class Decoded(Layer):
    """What base64 holds; a find stems from the characters that hold its bytes."""

    def __init__(self, text: str, parent: Layer, segments: list, shift: int, first: int, width: int, above: frozenset):
        super().__init__(text, *parent.stretch(segments[0][0], segments[-1][1]), above)
        self.parent, self.segments, self.shift, self.first, self.width = parent, segments, shift, first, width
        self.edges = list(itertools.accumulate((b - a for a, b in segments), initial=0))
        self.bytes_before = None

    def _byte(self, at: int) -> int:
        """The number of the byte with which a character begins."""
        if self.width or self.text.isascii():
            return self.first + at * (self.width or 1)
        if self.bytes_before is None:
            points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            sizes[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte that can't be read
            self.bytes_before = np.concatenate([[0], np.cumsum(sizes)])
        return self.first + int(self.bytes_before[at])

    def stretch(self, start: int, end: int) -> tuple[int, int]:
        one, two = self.shift + self._byte(start) * 4 // 3, self.shift - (-self._byte(end) * 4 // 3)
        i, j = bisect_right(self.edges, one) - 1, bisect_left(self.edges, two) - 1
        i, j = min(i, len(self.segments) - 1), min(j, len(self.segments) - 1)
        begin, stop = self.segments[i][0] + one - self.edges[i], self.segments[j][0] + two - self.edges[j]
        return self.parent.stretch(begin, min(stop, self.segments[j][1]))


def find_secrets(text: str) -> tuple[list, list]:
    """(base finds, all finds), each (start, end, kind) in the order of the contract."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(scan(text), key=order)
    found, done = set(base), set()
    work = [Layer(text, None, None, frozenset()).inner()]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        at = (layer.own, layer.begin if isinstance(layer.begin, int) else None, layer.end if isinstance(layer.end, int) else None)
        if layer.own in layer.above or at in done:
            continue
        done.add(at)
        found.update((*layer.stretch(a, b), kind) for a, b, kind in scan(layer.text))
        work.append(layer.inner())
    return base, sorted(found, key=order)


def _said(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` over the whole text (null counts as empty).

    Counts and digest are of the finds in the text itself, spans also those in decoded layers, each once, as kind:start:end in code points.
    A text without finds has counts 0, the digest of no bytes and empty spans. Rows are handled alone: repeated rows give repeated
    results, null ids are kept, other columns ignored, and an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = zip(*map(find_secrets, (t or "" for t in batch.column(1).to_pylist())), strict=True) if batch.num_rows else ((), ())
            counts = [pa.array([sum(x[2] == kind for x in b) for b in base], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_said(e) for e in every], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found stretch of the text replaced by ``mark``; stretches that overlap become one. Null texts stay null."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(hide), docs.schema)


def redacted(text: str, mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(find_secrets(text)[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
