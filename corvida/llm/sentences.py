"""Sentence units across languages and scripts (problem 9).

The boundary rules are a finite transducer in two layers. The outer one reads line classes; its states are
OUT, PROSE, LIST and FENCE, and its table decides which lines are units of their own and which run together
into a block. The inner one reads the terminators of a block and decides from a bounded neighbourhood
(abbreviation before, matched quotation around, character after) whether a unit ends.

A blank line leaves the outer transducer in OUT or FENCE whatever came before, and no block reaches over it. Long
documents are therefore cut after blank lines only, however far apart they are, so a cut never changes a result. Each
piece is a row of its own and a function from {OUT, FENCE} to (state after it, ends in it); the functions of a document
are composed by a prefix scan over its pieces, and each piece then keeps the ends of the state it really starts in.

The language column is never read: the rules look at characters only.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import written

PIECE = 1 << 16
OUT, PROSE, LIST, FENCE = range(4)
BLANK, MARK, ALONE, ITEM, TEXT = range(5)
# next state and action for [state][line class]; actions: 0 none, 1 line is a unit, 2 open block, 3 extend block, 4 close block,
# 5 close block + line is a unit, 6 close block + open block, 7 close block (fence opens), 8 unit ends with this line (fence closes)
TABLE = [
    [(OUT, 0), (FENCE, 0), (OUT, 1), (LIST, 2), (PROSE, 2)],
    [(OUT, 4), (FENCE, 7), (OUT, 5), (PROSE, 3), (PROSE, 3)],
    [(OUT, 4), (FENCE, 7), (OUT, 5), (LIST, 6), (LIST, 3)],
    [(FENCE, 0), (OUT, 8), (FENCE, 0), (FENCE, 0), (FENCE, 0)],
]

# Abbreviations. TITLES never end a unit; NUMBERED never before a digit; LOOSE end one only before what can begin one.
TITLES = set("dr st mr mrs ms prof sr sra sres dra hr fr mme mlle gen col rev hon cf vs approx ca bzw gem e.g i.e z.b u.a d.h s.o p.ex p.ej π.χ κ.λπ डॉ श्री जी".split()) - {"जी"}
NUMBERED = set("no nr nos núm num pág pag pp fig figs abs art vol ver sec cap kap ch eq tab § bd ziff".split())
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember januari februari maj augusti ledna února".split())
LOOSE = set("etc usw ltd inc co corp aprox env p.m a.m u.s bros jr".split())

OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "‘": "’", "[": "]", "《": "》", "【": "】"}
CLOSERS = set("”“»」』)）’]》】\"'")
PARTICLES = set("とはをがのにでもへやって")

_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_ALONE = regex.compile(r"\s*(?:#{1,6}\s|\||!\[[^\]]*\]\([^)]*\)\s*$|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:From|To|Cc|Bcc|Subject|Date|Sent|Reply-To|Message-ID|Von|An|Betreff|Datum|De|À|Objet|Asunto|Fecha|Para|差出人|宛先|件名|日付|发件人|收件人|主题|日期):\s|[^\p{L}\p{N}]+$)")
_ITEM = regex.compile(r"\s*(?:[-*+•・]|\d{1,3}[.)])\s+\S")
_NUMBER = regex.compile(r"\s*\d{1,3}[.)]\s+")
_EXAMPLE = regex.compile(r"(?<!\p{L})p\.\s?e[jx]$", regex.I)
_FENCE = regex.compile(r"\s*(?:```|~~~)")
_QUOTE = regex.compile("[“”„«»「」『』()（）‘\\[\\]《》【】\"]")
_TERM = regex.compile(r"[.!?…。！？．।॥؟۔｡]+|(?<=[\p{Greek}\p{Nd}\p{Latin}][)»”]?);")
_THAI = regex.compile(r"(?<=\p{Thai})[  ]+(?=\p{Thai})")
_TOKEN = regex.compile(r"[\p{L}\p{M}](?:[\p{L}\p{M}]|\.(?=[\p{L}\p{M}]))*$")
_LATIN = regex.compile(r"[\p{Latin}\p{Greek}\p{M}](?:[\p{Latin}\p{Greek}\p{M}]|\.(?=[\p{Latin}\p{Greek}]))*$")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_GREEK = regex.compile(r"\p{Greek}")
_INVISIBLE = regex.compile(r"[\s\p{Cf}\p{Cc}]+$")
_ORDINAL = regex.compile(r"[^\p{N}]?\d{1,2}\.\s+(\p{L}+)")
_SPACE = regex.compile(r"[\s​]*")


def line_class(text: str, a: int, b: int) -> int:
    i = a
    while i < b and text[i] in " \t　\xa0":
        i += 1
    if i >= b or text[i] in "\r\n" or not text[i:b].strip():
        return BLANK
    ch = text[i]
    if ch in "`~" and _FENCE.match(text, a, b):
        return MARK
    if ch in "-*+•・" or ch.isdigit():
        if _ITEM.match(text, a, b):
            return ITEM
        return ALONE if _ALONE.match(text[a:b].rstrip("\r\n")) else TEXT
    if ch in "#|!" or not ch.isalnum() or ch in "FTCBSDRMVAOPÀ差宛件日发收主":
        return ALONE if _ALONE.match(text[a:b].rstrip("\r\n")) else TEXT
    return TEXT


def last_visible(text: str, a: int, b: int) -> int:
    """Position after the last visible character of text[a:b]; a where there is none."""
    while b > a:
        ch = text[b - 1]
        if not (ch.isspace() or unicodedata.category(ch) in ("Cf", "Cc")):
            return b
        b -= 1
    return a


def quotations(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a block, in order; what is never closed is plain text."""
    spans, stack = [], []
    for m in _QUOTE.finditer(text, a, b):
        ch, i = m[0], m.start()
        depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == ch), None)
        if depth is not None:
            start = stack[depth][1]
            del stack[depth:]
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, i))
        elif ch == '"':
            stack.append(('"', i))
        elif ch in OPENERS:
            stack.append((OPENERS[ch], i))
    return spans


def _follows(text: str, i: int, b: int) -> str:
    j = _SPACE.match(text, i, b).end()
    return text[j] if j < b else ""


def ends_here(text: str, a: int, i: int, j: int, b: int) -> bool:
    """Whether the terminators text[i:j], outside of any quotation of the block text[a:b], end a unit."""
    run, after = text[i:j], text[j] if j < b else ""
    if run == ";":
        return bool(_GREEK.search(text, max(a, i - 80), i)) and (not after or after.isspace())
    before = text[i - 1] if i > a else ""
    if any(ch in "。！？।॥؟۔｡" for ch in run):
        return True
    if "!" in run or "?" in run:
        return not after or after.isspace() or after in CLOSERS or after in OPENERS or after.isupper() or bool(_CJK.match(after)) or not after.isascii()
    if run == "．":
        return not (before.isdigit() and after.isdigit())
    if "…" in run or len(run) > 2:
        if before.isspace() or not before:
            nxt = _follows(text, j, b)
            return not nxt or not nxt.islower()
        return True
    if len(run) == 2:
        return True
    cjk = bool(_CJK.search(text, max(a, i - 12), i))
    if before.isdigit() and (after.isdigit() or cjk and after in "\r\n" and _follows(text, j, b).isdigit()):
        return False
    if before.isdigit() and after.isspace() and (m := _ORDINAL.match(text, max(a, i - 2), b)) and m[1].lower() in MONTHS:
        return False
    if after and not after.isspace() and after not in CLOSERS and after not in OPENERS:
        if not (after.isupper() or _CJK.match(after)) or not before.isalnum():
            return False
        if after.isupper() and j + 1 < b and not (text[j + 1].islower() or text[j + 1] in " '’"):
            return False
        m = _LATIN.search(text, max(a, i - 24), i)
        return before.isdigit() and after.isupper() or bool(m and len(m[0]) > 1 and before.islower() and "." not in m[0] and m[0].lower() not in TITLES | NUMBERED)
    m = (_LATIN if before.isascii() or _GREEK.match(before) or unicodedata.name(before, "").startswith("LATIN") else _TOKEN).search(text, max(a, i - 24), i)
    if m:
        word = m[0].lower()
        if word in TITLES or len(word) == 1 or word in ("ej", "ex") and _EXAMPLE.search(text, max(a, i - 6), i):
            return False
        if word in NUMBERED and _follows(text, j, b).isdigit():
            return False
        if word in LOOSE:
            nxt = _follows(text, j, b)
            if not nxt or nxt.isupper() or nxt in OPENERS or nxt in '"¿¡' or _CJK.match(nxt):
                return True
            k = text.find(nxt, j, b)
            return bool(regex.match(r"\p{Ll}\p{Lu}", text[k : k + 2]))
        if "." in word and all(len(p) == 1 for p in word.split(".")):
            return False
    return True


def block_ends(text: str, a: int, b: int, out: list[int]) -> None:
    """Append the unit ends of the prose block text[a:b]."""
    spans = quotations(text, a, b) if _QUOTE.search(text, a, b) else []
    begin, k = _SPACE.match(text, a, b).end(), 0
    number = _NUMBER.match(text, a, b)  # an item's number belongs to its first sentence
    least = number.end() if number else a
    marks = [(m.start(), m.end()) for m in _TERM.finditer(text, a, b)]
    if _THAI.search(text, a, b):
        marks = sorted(marks + [(m.start(), m.start()) for m in _THAI.finditer(text, a, b)])
    for i, j in marks:
        if i < begin or i < least:
            continue
        while k < len(spans) and spans[k][1] < i:
            k += 1
        if k < len(spans) and spans[k][0] < i:  # inside a quotation: only a whole quoted unit ends, with its closing sign
            open_, close = spans[k]
            if open_ != begin or _SPACE.match(text, j, b).end() != close:
                continue
            end = close + 1
            while end < b and text[end] in ".!?。！？":
                end += 1
            nxt = text[end] if end < b else ""
            if nxt in PARTICLES and text[close] in "」』”":
                continue
            if text[j - 1] in "!?" and _follows(text, end, b).islower():
                continue
        elif i == j:
            end = i
        elif ends_here(text, a, i, j, b):
            end = j
        else:
            continue
        while end < b and text[end] in CLOSERS and not (text[end] in '"“' and not any(s[1] == end for s in spans)) and not (text[end] == "'" and end + 1 < b and text[end + 1].isalpha()):
            end += 1
        if end > begin:
            out.append(end)
        begin = _SPACE.match(text, end, b).end()
    end = last_visible(text, a, b)
    if end > a and (not out or out[-1] < end):
        out.append(end)


def run(text: str, a: int, b: int, state: int, whole: bool = True) -> tuple[int, list[int]]:
    """The transducer over the lines of text[a:b] from ``state``: state after them and unit ends. ``whole`` says that
    nothing follows, so a fence that is still open ends there."""
    out: list[int] = []
    start, fence, opened = a, a, False
    for m in _LINE.finditer(text, a, b):
        i, j = m.span()
        if i == j:
            break
        state, action = TABLE[state][line_class(text, i, j)]
        if action == 2:
            start, opened = i, True
        elif action in (4, 5, 6, 7):
            block_ends(text, start, i, out)
            opened = action == 6
            start = i
        if action in (1, 5, 8):
            end = last_visible(text, i, j)
            if end > i:
                out.append(end)
        elif state == FENCE:
            fence = i
    if opened:
        block_ends(text, start, b, out)
    elif state == FENCE and whole:
        end = last_visible(text, fence, b)
        if end > a:
            out.append(end)
    return state, out


_GAP = regex.compile(r"\n[ \t\u3000\xa0]*\r?\n")


def borders(text: str, size: int = PIECE) -> list[int]:
    """Starts of the pieces of a text: at least ``size`` characters apart, each right after a blank line."""
    cuts, at = [0], 0
    while m := _GAP.search(text, at + size):
        at = m.end()
        if at >= len(text):
            break
        cuts.append(at)
    return cuts


def pieces(text: str, size: int = PIECE) -> list[str]:
    cuts = borders(text, size)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def compose(functions: np.ndarray) -> np.ndarray:
    """State before each piece, from state functions [pieces, 4], by a parallel (doubling) prefix scan from OUT."""
    f, step = functions.copy(), 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        step *= 2
    return np.concatenate([[OUT], f[:-1, OUT]])


def split_long(text: str, size: int = PIECE) -> list[int]:
    """Unit ends by way of pieces; the same as unit_ends, whatever the size of the pieces."""
    ps = pieces(text, size)
    results = [[run(p, 0, len(p), s, k == len(ps) - 1) for s in range(4)] for k, p in enumerate(ps)]
    states = compose(np.array([[r[0] for r in rs] for rs in results]))
    starts = np.cumsum([0] + [len(p) for p in ps[:-1]])
    return [int(a) + e for rs, s, a in zip(results, states, starts) for e in rs[s][1]]


def unit_ends(text: str | None) -> list[int]:
    """Ends of the sentence units, in code points from the start of the text; none for null, empty and blank text."""
    return run(text, 0, len(text), OUT)[1] if text else []


def _units(t: str, ends: list[int], key, shift: int, out: tuple[list, ...]) -> None:
    at = 0
    for e in ends:
        s = _SPACE.match(t, at, e).end()
        for column, value in zip(out, (key, shift + s, shift + e, t[s:e])):
            column.append(value)
        at = e


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, sent_no (from 0), sent_start, sent_end and sentence, one row per unit.

    Defined cases: null, empty and blank texts have no units; repeated rows come out repeated; a null key is
    kept; extra columns are ignored; texts of any length are processed whole.
    """
    plain = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = plain.schema["k"].dataType.simpleString()
    columns = f"{key} {kind}, sent_no int, sent_start bigint, sent_end bigint, sentence string"

    def units(batches):
        for batch in batches:
            out, nos = ([], [], [], []), []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = unit_ends(t)
                _units(t, ends, k, 0, out)
                nos.extend(range(len(ends)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=[key, "sent_no", "sent_start", "sent_end", "sentence"])

    long = F.char_length("t") > 2 * PIECE
    short = plain.where(F.coalesce(~long, F.lit(False))).mapInArrow(units, columns)
    return short.unionByName(_long_sentences(plain.where(long), key, columns))


def _long_sentences(plain: DataFrame, key: str, columns: str) -> DataFrame:
    """The same for long documents (k, t), a row a piece: equal rows are one and come out as often as they are there."""
    docs = plain.groupBy("k", "t").agg(F.count("*").alias("copies")).withColumn("doc", F.sha2("t", 256))
    kind = plain.schema["k"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for k, t, copies, doc in zip(*(c.to_pylist() for c in batch.columns)):
                ps = pieces(t)
                starts = np.cumsum([0] + [len(p) for p in ps[:-1]])
                n = len(ps)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, batch.schema.field(0).type), pa.array([doc] * n, pa.string()), pa.array([copies] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array([i == n - 1 for i in range(n)]), pa.array(ps, pa.string())], names=["k", "doc", "copies", "piece", "start", "last", "t"])

    rows = docs.select("k", "t", "copies", "doc").mapInArrow(cut, f"k {kind}, doc string, copies bigint, piece int, start bigint, last boolean, t string").repartition("doc", "piece")

    def work(batches):
        for batch in batches:
            names = ["k", "doc", "copies", "piece", "start", "t", "from_out", "from_fence", "ends_out", "ends_fence"]
            done = [tuple(run(t, 0, len(t), s, last) for s in (OUT, FENCE)) for last, t in zip(batch.column("last").to_pylist(), batch.column("t").to_pylist())]
            extra = [pa.array([d[s][part] for d in done], kind) for part, kind in ((0, pa.int32()), (1, pa.list_(pa.int64()))) for s in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), *extra], names=names)

    worked = written(rows.mapInArrow(work, f"k {kind}, doc string, copies bigint, piece int, start bigint, t string, from_out int, from_fence int, ends_out array<bigint>, ends_fence array<bigint>"), "p9")
    # prefix scan of the state functions of each document; only two numbers a piece are gathered
    f = worked.groupBy("k", "doc").agg(F.array_sort(F.collect_list(F.struct("piece", "from_out", "from_fence"))).alias("f"))
    empty = F.struct(F.lit(OUT).alias("state"), F.array().cast("array<int>").alias("before"))
    after = lambda acc, x: F.struct(F.when(acc["state"] == FENCE, x["from_fence"]).otherwise(x["from_out"]).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before"))
    states = f.select("k", "doc", F.posexplode(F.aggregate("f", empty, after, lambda acc: acc["before"])).alias("piece", "state"))
    ends = F.when(F.col("state") == FENCE, F.col("ends_fence")).otherwise(F.col("ends_out"))
    same = (F.col("w.doc") == F.col("s.doc")) & (F.col("w.piece") == F.col("s.piece")) & F.col("w.k").eqNullSafe(F.col("s.k"))
    each = worked.alias("w").join(states.alias("s"), same).select("w.k", "w.doc", "w.copies", "w.piece", "w.start", "w.t", ends.alias("ends"))
    before = F.coalesce(F.sum(F.size("ends")).over(Window.partitionBy("k", "doc").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")

    def spell(batches):
        for batch in batches:
            out, nos = ([], [], [], []), []
            for k, copies, start, t, es, first in zip(*(batch.column(c).to_pylist() for c in ("k", "copies", "start", "t", "ends", "first"))):
                for _ in range(copies):
                    _units(t, es, k, start, out)
                    nos.extend(range(first, first + len(es)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("k").type), pa.array(nos, pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=[key, "sent_no", "sent_start", "sent_end", "sentence"])

    return each.withColumn("first", before).mapInArrow(spell, columns)
