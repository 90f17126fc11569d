"""Splitting oversized items at natural boundaries (problem 3).

Content-defined chunking: a rolling hash over the text gives each window a landmark (the position of the
smallest hash), the landmark snaps to the nearest natural boundary of the best kind in the window, and the cut
falls there. As hashes and boundaries depend on nearby text only, an edit moves the cuts of neighbouring pieces
and the later ones fall into step again.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.sentences import unit_ends

WINDOW = 24
_HEADING = regex.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", regex.M)
_FENCE = regex.compile(r"^[ \t]*(?:```|~~~)", regex.M)
_PARAGRAPH = regex.compile(r"\n[ \t\r]*\n+")
_BLANK = regex.compile(r"\s+")


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the WINDOW characters before each position 1..n, mixed so that the smallest is content-chosen."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total, power = np.zeros(len(codes), dtype=np.uint64), 1
    for k in range(min(WINDOW, len(codes))):
        total[k:] += mixed[: len(codes) - k] * np.uint64(power)
        power = power * 0xBF58476D1CE4E5B9 % (1 << 64)
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(32))


def headings(text: str) -> list[tuple[int, int, str]]:
    """(position, level, title) of the headings outside code fences."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    out = []
    for m in _HEADING.finditer(text):
        if m[2].strip() and not np.searchsorted(fences, m.start()) % 2:
            out.append((m.start(), len(m[1]), m[2].strip()))
    return out


def natural_boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may begin, and their kinds: 4 heading, 3 paragraph, 2 line, 1 sentence, 0 word."""
    kinds: dict[int, int] = {}
    for m in _BLANK.finditer(text):
        kinds[m.end()] = 2 if "\n" in m[0] else 0
    for e in unit_ends(text):
        m = _BLANK.match(text, e)
        at = m.end() if m else e
        kinds[at] = max(kinds.get(at, 0), 1)
    for m in _PARAGRAPH.finditer(text):
        at = _BLANK.match(text, m.start()).end()
        kinds[at] = 3
    for at, _, _ in headings(text):
        kinds[at] = 4
    kinds.pop(0, None)
    kinds.pop(len(text), None)
    at = np.array(sorted(kinds), dtype=np.int64)
    return at, np.array([kinds[i] for i in at.tolist()], dtype=np.int64)


def between_characters(text: str, i: int, lowest: int) -> int:
    """The last position at or before i that does not part a character from its marks and joiners."""
    j = i
    while j > lowest and j < len(text) and (unicodedata.combining(text[j]) or unicodedata.category(text[j]) in ("Mn", "Me") or ord(text[j]) in (0x200D, 0xFE0F) or ord(text[j - 1]) == 0x200D):
        j -= 1
    return j if j > lowest else i


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Positions between pieces: core pieces of at most limit - overlap characters, the first of at most limit."""
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    least = max(1, most // 4)
    marks, (at, kinds) = rolling_hash(text), natural_boundaries(text)
    out, begin, n = [], 0, len(text)
    while n - begin > (most if out else limit):
        lo, hi = begin + least, begin + most
        landmark = lo + int(np.argmin(marks[lo - 1 : hi]))
        a, b = np.searchsorted(at, [lo, hi + 1])
        if b > a:
            best = kinds[a:b].max()
            options = at[a:b][kinds[a:b] == best]
            cut = int(options[np.argmin(np.abs(options - landmark))])
        else:
            cut = between_characters(text, landmark, begin)
        out.append(cut)
        begin = cut
    return out


def path_at(base: list[str], heads: list[tuple[int, int, str]], at: int) -> list[str]:
    """The heading path in force at a position: each heading cuts the path to its level and adds itself."""
    path = list(base)
    for pos, level, title in heads:
        if pos > at:
            break
        path = path[: level - 1] + [title]
    return path


def pieces(text: str, limit: int, overlap: int, path: list[str] | None, byte_start: int | None) -> list[tuple]:
    """(text, heading path, byte_start, byte_end, char_start, char_end) of each piece; the overlap is exact."""
    overlap = max(0, min(overlap, limit - 1))
    borders = [0, *cuts(text, limit, overlap), len(text)]
    heads, out, size, done = headings(text), [], 0, 0
    for i, (a, b) in enumerate(zip(borders, borders[1:])):
        begin = max(0, a - overlap) if i else 0
        # bytes before `begin`, counted forward from the last piece's begin
        size += len(text[done:begin].encode("utf-8", "surrogatepass"))
        done = begin
        body = text[begin:b]
        start = None if byte_start is None else byte_start + size
        stop = None if start is None else start + len(body.encode("utf-8", "surrogatepass"))
        out.append((body, path_at(path or [], heads, a), start, stop, begin, b))
    return out


def split_oversized(items: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of the items whose text is longer than max_chars of their configuration, one row per piece.

    Defined cases: null and short texts and items without a configuration give no pieces; the stored byte_end
    is never used, so stale ones do no harm; a null byte_start gives null byte positions; a null heading_path is
    an empty one; an item delivered again counts once; a null or non-positive limit splits nothing; an overlap
    of the limit or more is cut to the limit less one; texts of any length are processed whole.
    """
    sizes = configs.select("chunking_config_hash", "max_chars", "overlap_chars").where("max_chars > 0").dropDuplicates(["chunking_config_hash"])
    big = (
        items.select("chunk_hash", "chunking_config_hash", "text", "heading_path", "byte_start")
        .where("text is not null")
        .join(sizes, "chunking_config_hash")
        .where(F.char_length("text") > F.col("max_chars"))
        .dropDuplicates(["chunk_hash"])
        .select("chunk_hash", "text", "heading_path", "byte_start", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    )
    names = ["chunk_hash", "piece_no", "text", "heading_path", "byte_start", "byte_end", "char_start", "char_end"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def split(batches):
        for batch in batches:
            rows = [(k, n, *p) for k, t, h, s, m, o in zip(*(c.to_pylist() for c in batch.columns)) for n, p in enumerate(pieces(t, m, o, h, s))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return big.mapInArrow(split, "chunk_hash string, piece_no int, text string, heading_path array<string>, byte_start bigint, byte_end bigint, char_start bigint, char_end bigint")
