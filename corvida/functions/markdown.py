"""Markdown of normalised units: splitting, search projection, normal form, tables. Line state needs a loop, so these
are Arrow UDFs over whole texts; what one expression can say stays a column expression."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvida.functions.text import RAW_HTML, nfc

_PUNCTUATION = r"""!-/:-@\[-`{-~"""
_INLINE = re.compile(rf"(`[^`\n]*(?:`|(?=\n|$)))|\\([{_PUNCTUATION}])|&(lt|gt|amp);")
_ENTITY = {"lt": "<", "gt": ">", "amp": "&"}
_HTML = re.compile(RAW_HTML)
SPANS = T.ArrayType(T.StructType([T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType())]))


def is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def split_spans(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Pieces of at most ``most`` characters of text[start:end]. A piece ends after the last blank line in reach, else
    at the limit; white space at the beginning of a further piece is passed over; blank pieces are dropped."""
    if most <= 0:
        raise ValueError("max_chars must be positive")
    out, at = [], start
    while at < end:
        stop = min(at + most, end)
        if stop < end:
            breaks = list(re.finditer(r"\n\s*\n", text[at:stop]))
            if breaks:
                stop = at + breaks[-1].end()
        out.append((at, stop))
        at = stop
        while at < end and text[at].isspace():
            at += 1
    return [(a, b) for a, b in out if text[a:b].strip()]


def chunk_spans(most: int):
    """A function of (text, byte_start, byte_end of a section) to its chunk spans, in characters and bytes of the text."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out, last, raw = [], None, b""
        for text, a, b in zip(texts, starts, ends):
            if text is None or a is None or b is None:
                out.append(None)
                continue
            if text is not last:
                last, raw = text, text.encode()
            begin, body = len(raw[: int(a)].decode()), raw[int(a) : int(b)].decode()
            rows, at, size = [], 0, int(a)
            for x, y in split_spans(body, 0, len(body), most):
                size += len(body[at:x].encode())
                stop = size + len(body[x:y].encode())
                rows.append({"char_start": begin + x, "char_end": begin + y, "byte_start": size, "byte_end": stop})
                at, size = y, stop
            out.append(rows)
        return pd.Series(out)

    return spans


def resolve_line(line: str) -> str:
    """A line without its escapes: backslash before ASCII punctuation, &lt; &gt; &amp;; code spans stay as they are."""
    return _INLINE.sub(lambda m: m[1] or m[2] or _ENTITY[m[3]], line)


def resolve_escapes(text: str) -> str:
    """Escapes of all lines outside code fences."""
    out, inside = [], False
    for line in text.split("\n"):
        fence = is_fence(line)
        inside ^= fence
        out.append(line if fence or inside else resolve_line(line))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def resolved(texts: pd.Series) -> pd.Series:
    return texts.map(resolve_escapes, na_action="ignore")


@F.pandas_udf(T.StringType())
def indexed_text(texts: pd.Series) -> pd.Series:
    """What the text index holds: no NUL, NFC, escapes resolved."""
    return texts.map(lambda t: resolve_escapes(unicodedata.normalize("NFC", t.replace("\0", ""))), na_action="ignore")


def underline_level(line: str) -> int:
    """1 for a line of '=', 2 for one of two or more '-', else 0."""
    body = line.lstrip(" ").rstrip(" \t")
    return 1 if body and not body.strip("=") else 2 if len(body) > 1 and not body.strip("-") else 0


def normal_form(text: str) -> str:
    """Markdown in its stored form: no byte order mark, LF, NFC, no blanks at line ends, one LF at the end, headings
    that are underlined made '#' headings outside fences."""
    rows = unicodedata.normalize("NFC", text.removeprefix(chr(0xFEFF)).replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    out, inside, i = [], False, 0
    while i < len(rows):
        fence = rows[i].lstrip(" ").startswith("```")
        inside ^= fence
        level = underline_level(rows[i + 1]) if not (fence or inside) and rows[i].strip() and i + 1 < len(rows) else 0
        out.append(f"{'#' * level} {rows[i].strip()}" if level else rows[i].rstrip(" \t"))
        i += 2 if level else 1
    return "\n".join(out).rstrip("\n") + "\n"


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form, na_action="ignore")


def form_error(text: str) -> str | None:
    """The first rule of the stored form that a text breaks, None where it breaks none."""
    if chr(0xFEFF) in text:
        return "byte_order_mark"
    if "\r" in text:
        return "carriage_return"
    if unicodedata.normalize("NFC", text) != text:
        return "not_nfc"
    if not text.endswith("\n") or text.endswith("\n\n"):
        return "final_newline"
    inside, before = False, ""
    for line in text[:-1].split("\n"):
        if line.endswith((" ", "\t")):
            return "trailing_blank"
        body = line.lstrip(" ")
        if body.startswith("```"):
            inside = not inside
        elif body.startswith("~~~"):
            return "tilde_fence"
        elif not inside:
            if before.strip() and underline_level(line):
                return "underlined_heading"
            if _HTML.search(line):
                return "raw_html"
        before = line
    return None


@F.pandas_udf(T.StringType())
def form_errors(texts: pd.Series) -> pd.Series:
    return texts.map(form_error, na_action="ignore")


def source_escape(text: Column) -> Column:
    """Text as literal Markdown: LF, NFC, controls dropped, entities for & < >, a backslash before other ASCII punctuation."""
    clean = F.regexp_replace(nfc(F.regexp_replace(text, "\r\n?", "\n")), r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}]", "")
    marked = F.regexp_replace(clean, r"""([!-%'-/:;=?@\[-`{-~])""", r"\\$1")
    return F.replace(F.replace(F.replace(marked, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def grid_to_markdown(grid: list[list[str]]) -> str:
    """Tables of a grid of cells. Blank rows part regions; rows before the first with two filled cells are prose; that
    row is the header; columns without a filled cell in the table are left out."""
    blocks, region = [], []
    for row in [*grid, []]:
        cells = [(c or "").strip() for c in row]
        if any(cells):
            region.append(cells)
            continue
        if region:
            head = next((i for i, r in enumerate(region) if sum(map(bool, r)) > 1), len(region))
            blocks += [" ".join(filter(None, r)) for r in region[:head]]
            table = region[head:]
            if table:
                width = max(map(len, table))
                full = [r + [""] * (width - len(r)) for r in table]
                keep = [c for c in range(width) if any(r[c] for r in full)]
                rows = ["|" + "".join(f" {r[c].replace('|', chr(92) + '|')} |" for c in keep) for r in full]
                blocks.append("\n".join([rows[0], "|" + " --- |" * len(keep), *rows[1:]]))
        region = []
    return "\n\n".join(blocks)


_TABLE = re.compile(r"<table(?=[\s>/])[^>]*>(.*?)</table>", re.I | re.S)
_ROW = re.compile(r"\s*<tr(?=[\s>/])[^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"\s*<td(?=[\s>/])[^>]*>(.*?)</td>", re.I | re.S)
_IMG = re.compile(r"<img(?=[\s/>])[^>]*?\ssrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>", re.I)
_DIV = re.compile(r"</?(?:div|center)(?=[\s>])[^>]*>\s*", re.I)
_UNKNOWN = re.compile(r"<th|<thead|<tbody|<tfoot|<caption|rowspan|colspan|<table", re.I)


def _elements(rx: re.Pattern, text: str) -> list[str] | None:
    """Contents of the elements that fill ``text``; None where anything but white space lies between or around."""
    out, at = [], 0
    while m := rx.match(text, at):
        out.append(m[1])
        at = m.end()
    return out if not text[at:].strip() else None


def html_table(inner: str) -> str | None:
    """A pipe table with an empty header of a plain HTML table's inside; None for any shape beyond rows of cells."""
    rows = None if _UNKNOWN.search(inner) else _elements(_ROW, inner)
    cells = [_elements(_CELL, r) for r in rows or []]
    if not cells or any(c is None for c in cells) or not cells[0] or len({len(c) for c in cells}) > 1:
        return None
    if any(re.search(r"[<>\n\r\\]", x) for c in cells for x in c):
        return None
    n = len(cells[0])
    return "\n".join(["|" + " |" * n, "|" + " --- |" * n, *("|" + "".join(f" {x.strip().replace('|', chr(92) + '|')} |" for x in c) for c in cells)])


def html_to_markdown(text: str) -> str:
    """OCR output without HTML where that loses nothing: images to Markdown, centring wrappers off, tables to pipes.
    A table must stand alone as a block; what is not understood stays as it is."""
    text = _IMG.sub(lambda m: m[0] if re.search(r"[()<>\s]", m[1] or m[2] or "") else f"![]({m[1] or m[2] or ''})", text)
    text = _DIV.sub("", text)

    def table(m: re.Match) -> str:
        alone = (m.start() == 0 or text[: m.start()].endswith("\n\n")) and (m.end() == len(text) or text[m.end()] == "\n")
        return (html_table(m[1]) if alone else None) or m[0]

    return _TABLE.sub(table, text)


@F.pandas_udf(T.StringType())
def without_html(texts: pd.Series) -> pd.Series:
    return texts.map(html_to_markdown, na_action="ignore")


@F.pandas_udf(T.StringType())
def grid_markdown(grids: pd.Series) -> pd.Series:
    """Markdown of an array of rows of cells."""
    return grids.map(lambda g: grid_to_markdown([list(r) if r is not None else [] for r in g]), na_action="ignore")


def assemble_view(units, key: str, order: str, unit: str, body: str):
    """One text per key from its units in order, and where each unit lies in it, in bytes: key, unit, byte_start, byte_end, view.

    Running sums of octet lengths give the offsets; units are joined by one empty line.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order, unit)
    start = F.coalesce(F.sum(F.octet_length(body) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.withColumn("byte_start", start).withColumn("byte_end", F.col("byte_start") + F.octet_length(body))
    views = units.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, unit, body))), lambda x: x[body]), "\n").alias("view"))
    return placed.select(key, unit, "byte_start", "byte_end").join(views, key)
