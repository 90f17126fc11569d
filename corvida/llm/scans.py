"""Noise in text from scanned pages (problem 5).

Everything is learned from the corpus itself, by contrast with texts that were never scanned ("clean"):

* Words. Tokens of pages that no clean text holds are questions, tokens of clean texts are answers. Candidates
  are retrieved by an inverted join on character q-grams (for scripts without blanks: on the characters around
  a position). Edits between question and answer are counted for page tokens and for rare clean tokens that are
  put the same question; gradient-boosted trees learn to tell the two apart and rank the candidates. What looks
  like a rare clean word is left alone.
* Lines. Lines at a page's edges are generalised into templates (digits masked, one word open) and counted at
  edges, inside pages and in titles. Three boosted classifiers look at pairs of lines: whether an edge line
  and its neighbour part at running header or page number, whether the hyphen between two lines goes, and whether
  the line break between two lines stays.

Words are matched on a folded shadow of the text, character for character as long as the text itself, and replaced
in the text by position, so what is no fault keeps its characters.

Bounded samples: each classifier is fitted on at most ``TRAIN`` rows, chosen by hash. Counts cover all texts. Edges
are the first and last ``EDGE`` printed lines of a page; a template must stand at two edges to be running.
"""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm import lookalike
from corvida.llm.boost import Boosted
from corvida.session import written

TRAIN, MOST_BROADCAST = 20000, 200_000
SURE_WORD, SURE_LINE = 0.8, 0.75
VARIANT = 20  # a look-alike form this much rarer than the common one is no word of its own
EDGE = 3
BREAKS = "-" + chr(0xAC) + chr(0x2010) + chr(0xAD)
_LOWER = "a-zß-öø-ÿĀ-ɏḀ-ỿͰ-Ͽἀ-῾"
_KANA = "ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ"
_EAST = _KANA + "々〆㐀-䶿一-鿿豈-龎"
# Further pairs of kana and ideographs or kana of two kinds that look alike.
ALIKE = {"ー": "一", "へ": "ヘ", "り": "リ", "ハ": "八", "ミ": "三", "チ": "千"}

_BROKEN = re.compile(rf"(?<![^\W\d_])([^\W\d_]++)([{BREAKS}])[ \t]*\r?\n[ \t]*((?=[^\W\d_])[{_LOWER}а-џ][^\W\d_]*)")
_BREAK = re.compile(rf"[{BREAKS}](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?=[{_LOWER}а-џ])")
_HYPHEN = re.compile(rf"[{BREAKS}][ \t]*\r?\n")
# These begin with the characters that can begin a match, which the search skips to; what must stand before follows.
_PART, _MARK = rf"[{_LOWER}\u0300-\u036f0-9†|$€§¢]", rf"(?<=[{_LOWER}])[.'`](?=[{_LOWER}]{{2}})"
_REST = rf"(?:{_MARK}{_PART}++)"
_WORD = re.compile(rf"[{_PART[1:-1]}.'`](?<!(?s:[\w\-].))(?:(?<={_PART})(?:{_PART}++{_REST}*+|{_REST}++)|(?<=[{_LOWER}][.'`])(?=[{_LOWER}]{{2}}){_PART}++{_REST}*+)(?!-?\d)(?![\u0400-\u04ff])")
_SPECK = re.compile(rf"[.'`,^_~*\"](?<=[{_EAST}].)(?=\n?[{_EAST}])")
_COMPOUND = re.compile(rf"(?<!\S)[{_LOWER}]++-[{_LOWER}]+")
_CJK = re.compile(rf"[{_EAST}]+")
_WINDOW = re.compile(rf"(?:\^|[{_EAST}])[{_EAST}](?:\$|[{_EAST}])")
_UNSEEN = re.compile(r"\u00ad(?![ \t]*\n)")
_DIGITS = re.compile("[0-9０-９]+")
_PRINTED = re.compile(r"[^ \t\n\x0b\f\r]")
_PARTS = re.compile(r"[a-zß-öø-ÿĀ-ɏḀ-ỿ]+|[ァ-ヺー-ヿ]+|[一-鿿々〆]+|[ぁ-ゟ]+|[^ \t\n\x0b\f\r]")


def _seen(ch: str) -> str:
    return "" if ch != chr(0xAD) and unicodedata.category(ch) == "Cf" else ch


def _shadow(ch: str) -> str:
    """What a character counts as: width, blanks and look-alikes folded, lower case; always one character."""
    one = lookalike.fold_char(ch)
    one = one if len(one) == 1 else ch
    one = lookalike.TO_LATIN.get(one, one)
    return one.lower() if len(one.lower()) == 1 else one


_SEEN, _SHADOW = lookalike._Table(_seen), lookalike._Table(_shadow)


_HIDDEN = re.compile(r"[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000110bd-\U000e007f]")
# characters that are their own shadow once in lower case; all others are looked up
_OTHER = re.compile(rf"[^\x00-\x7f{_LOWER.replace('Ͱ-Ͽἀ-῾', '')}\u0300-\u036f{_EAST}。、・「」『』…“”„‘’–—«»¿¡]")


def solid(text: str) -> str:
    """The text composed, with plain line ends and without characters that never show (soft hyphens stay at line ends)."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _UNSEEN.sub("", text.translate(_SEEN)) if _HIDDEN.search(text) else text


def shadow(text: str) -> str:
    """The text as tokens see it, character for character."""
    low = text.lower()
    if text.isascii():
        return low
    return _OTHER.sub(lambda m: _SHADOW[ord(text[m.start()])], low) if len(low) == len(text) else text.translate(_SHADOW)


def flat(text: str) -> str:
    return shadow(solid(text))


def _is_word(w: str) -> bool:
    return any(map(str.isalpha, w)) and (w.strip("|") == w or len(w) > 2)


def _words_in(text: str) -> list[str]:
    out = [w for w in _WORD.findall(text) if _is_word(w)]
    if "-" in text:
        out += [m[0] for w in text.split() if "-" in w and (m := _COMPOUND.match(w))]
    return out


class _Pieces(dict):
    """The words and compounds of pieces of folded texts between blanks, over which no token reaches."""

    def __missing__(self, piece: str) -> list[str]:
        out = _words_in(piece)
        if len(piece) <= 40:
            if len(self) > 200_000:
                self.clear()
            self[piece] = out
        return out


_PIECES = _Pieces()


def unbroken(text: str) -> str:
    return _BREAK.sub("", text)


def word_tokens(text: str) -> set[str]:
    """Words and compounds of a folded text."""
    if not text.isascii() and _CJK.search(text):  # few blanks, so few pieces come again
        return set(_words_in(text))
    return set().union(*map(_PIECES.__getitem__, set(text.split())))


def tokens(text: str) -> set[str]:
    """Words, compounds and three-character windows of a folded text, words broken at a line end joined.

    Windows show the text's own characters: a katakana misread as the ideograph it looks like is a fault of the scan.
    """
    text = unbroken(text)
    out = word_tokens(text)
    if not text.isascii() and _CJK.search(text):
        codes, specks = east_codes(text)
        out |= {*windows_of(distinct(codes)), *specks}
    return out


def east_codes(text: str) -> tuple[np.ndarray, set[str]]:
    """Three-character windows of a folded text as numbers, some more than once, and its specks."""
    specks = _SPECK.findall(text)
    runs = set(_CJK.findall((_SPECK.sub("", text) if specks else text).replace("\n", "")))
    return window_codes(f"^{'$^'.join(runs)}$"), {"~" + p for p in specks}


def window_codes(s: str) -> np.ndarray:
    """The windows of runs between ^ and $, 21 bits for each character."""
    a = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    middle = a[1:-1]
    return ((a[:-2] << 42) | (middle << 21) | a[2:])[(middle != ord("^")) & (middle != ord("$"))]


def distinct(codes: np.ndarray) -> np.ndarray:
    """The numbers in order, each once (for few of them np.unique takes ten times as long)."""
    codes = np.sort(codes)
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def windows_of(codes: np.ndarray) -> list[str]:
    s = np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    return [s[i : i + 3] for i in range(0, len(s), 3)]


def windows(run: str) -> list[str]:
    """One window for each character of a run, the character in its middle; ^ and $ stand for the run's borders."""
    s = f"^{run}$"
    return [s[i : i + 3] for i in range(len(run))]


def is_window(token: str) -> bool:
    return len(token) == 3 and bool(_WINDOW.fullmatch(token))


def lines_of(text: str) -> list[tuple[int, str]]:
    return [(i, s) for i, s in enumerate(text.replace("\r\n", "\n").split("\n")) if s.strip()]


# ---------------------------------------------------------------- counting


def count_tokens(pages: DataFrame, clean: DataFrame) -> DataFrame:
    """token, n_page, n_clean: in how many page and clean texts each token occurs."""

    kept = pa.schema([("token", pa.string()), ("n_page", pa.int64()), ("n_clean", pa.int64())])

    def count(batches):
        seen, east = (Counter(), Counter()), ([], [])

        def rows():
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"token": every, "n_page": [seen[0][t] for t in every], "n_clean": [seen[1][t] for t in every]}, schema=kept)
            for side in (0, 1):
                for codes, n in east[side]:
                    none = np.zeros(len(codes), np.int64)
                    yield pa.RecordBatch.from_pydict({"token": windows_of(codes), "n_page": none if side else n, "n_clean": n if side else none}, schema=kept)

        for batch in batches:
            found = ([], [])
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unbroken(flat(text))
                seen[not page].update(word_tokens(text))
                if not text.isascii() and _CJK.search(text):
                    codes, specks = east_codes(text)
                    found[not page].append(distinct(codes))
                    seen[not page].update(specks)
            for side in (0, 1):
                if found[side]:
                    codes, at = np.unique(np.concatenate([*found[side], *(c for c, _ in east[side])]), return_inverse=True)
                    once = [np.ones(sum(map(len, found[side])), np.int64), *(n for _, n in east[side])]
                    east[side][:] = [(codes, np.bincount(at, np.concatenate(once)).astype(np.int64))]
            if sum(map(len, seen)) + sum(len(c) for side in east for c, _ in side) > 200_000:  # bounds the memory of a task; what comes again is summed later
                yield from rows()
                seen, east = (Counter(), Counter()), ([], [])
        yield from rows()

    both = pages.select(F.lit(True).alias("page"), "text").unionByName(clean.select(F.lit(False).alias("page"), "text"))
    return both.mapInArrow(count, "token string, n_page bigint, n_clean bigint").groupBy("token").agg(F.sum("n_page").alias("n_page"), F.sum("n_clean").alias("n_clean"))


# ---------------------------------------------------------------- words


LONG = 40  # longer words are looked up by their thirds


def grams(token: str, asking: bool) -> list[str]:
    """Keys of the inverted join: for windows the characters around the middle; for words q-grams, of three
    characters for short words and four for long ones, with a class of the question's length, which splits frequent
    q-grams. A question near the border asks for both sizes; an answer stands in every class two edits can reach.

    Very long words have too many q-grams to list: of two edits one third of the answer at least is spared, so their
    keys are digests of thirds, the middle one at every shift that two edits can cause.
    """
    if is_window(token):
        return [f"{token[0]}_{token[2]}"]
    n = len(token)
    out = set()
    if n > LONG - 2 * asking:
        third = lambda name, size, part: f"{name}{size}{hashlib.blake2b(part.encode(), digest_size=8).hexdigest()}"
        for k in range(n - 2, n + 3) if asking else (n,):
            x, y = k // 3, 2 * k // 3
            out |= {third("a", k, token[:x]), third("c", k, token[n - (k - y) :])} | {third("b", k, token[x + d : y + d]) for d in (range(-2, 3) if asking else (0,))}
    if n > LONG + 2 * asking:
        return sorted(out)
    padded, q = f"^{token}$", set()
    if n <= (9 if asking else 6):
        q |= {"s" + padded[i : i + 3] for i in range(n)}
    if n >= (6 if asking else 7):
        q |= {"l" + padded[i : i + 4] for i in range(n - 1)}
    sizes = [n // 5] if asking else range(max(2, n - 2) // 5, (n + 2) // 5 + 1)
    return [*sorted(out), *(f"{k}{g}" for g in q for k in sizes)]


def _script(ch: str) -> str:
    return "k" if re.match(f"[{_KANA}]", ch) else "h" if _CJK.match(ch) else "l"


def plausible(ops: list[tuple[str, str]]) -> bool:
    """Whether edits can be faults of recognition: at most two, of at most two characters, between scripts only look-alikes."""
    if not 0 < len(ops) <= 2 or any(max(len(r), len(w)) > 2 for r, w in ops):
        return False
    looks = lookalike.KANA_HAN | ALIKE
    for r, w in ops:
        if len(r) == len(w) == 1 and {_script(r), _script(w)} == {"k", "h"} and looks.get(r) != w and looks.get(w) != r:
            return False
    return True


def edits(wrong: str, right: str) -> list[tuple[str, str]]:
    """(right part, wrong part) of the differences."""
    sm = difflib.SequenceMatcher(None, right, wrong, autojunk=False)
    return [(right[a:b], wrong[c:d]) for tag, a, b, c, d in sm.get_opcodes() if tag != "equal"]


def swapped(counts: DataFrame) -> DataFrame:
    """token, replacement: page windows whose middle is a look-alike of the one that clean texts have far more often.

    The ranking counts in how many windows an edit is seen; a look-alike may sit in a few words only, on many pages.
    """
    han, kana = "".join(lookalike.HAN_KANA), "".join(lookalike.HAN_KANA.values())
    alike = counts.where((F.char_length("token") == 3) & F.col("token").rlike(f"[{han}{kana}]")).withColumn("looks", F.translate("token", han, kana))
    top = alike.groupBy("looks").agg(F.max(F.struct("n_clean", F.col("token").alias("replacement"))).alias("top")).select("looks", "top.*").withColumnRenamed("n_clean", "most")
    far = F.col("most") >= VARIANT * F.greatest(F.col("n_clean"), F.lit(1))
    return alike.where("n_page > 0").join(top, "looks").where(far & (F.substring("token", 2, 1) != F.substring("replacement", 2, 1))).select("token", "replacement")


def candidates(counts: DataFrame) -> DataFrame:
    """asked (token), real (asked of a page token rather than of a rare clean one), answer, n_answer, ops, distance; written."""
    word = F.char_length("token") >= 3
    asked = counts.where(word & ~F.col("token").contains("-") & ~F.col("token").startswith("~") & (((F.col("n_clean") == 0) & (F.col("n_page") > 0)) | ((F.col("n_clean") == 1) & (F.col("n_page") == 0))))
    answers = counts.where(word & (F.col("n_clean") >= 3) & ~F.col("token").contains("-"))

    def spread(asking: bool):
        def run(batches):
            for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
                keys = [grams(t, asking) for t in batch.column(0).to_pylist()]
                i = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(i), batch.column(1).take(i), pa.array([g for k in keys for g in k], pa.string())], names=["token", "x", "gram"])

        return run

    q = asked.select("token", F.when(F.col("n_page") > 0, 1).otherwise(0).cast("bigint").alias("x")).mapInArrow(spread(True), "token string, x bigint, gram string").select(F.col("token").alias("asked"), F.col("x").alias("real"), "gram")
    a = answers.select("token", F.col("n_clean").alias("x")).mapInArrow(spread(False), "token string, x bigint, gram string").select(F.col("token").alias("answer"), F.col("x").alias("n_answer"), "gram")
    met = q.join(a, "gram").where("asked <> answer and abs(char_length(asked) - char_length(answer)) <= 2")
    most = F.when(F.char_length("answer") >= 9, 3).when(F.char_length("answer") >= 5, 2).otherwise(1)
    near = met.withColumn("far", F.levenshtein("asked", "answer", 3)).where(F.col("far").between(0, most)).groupBy("asked", "real", "answer", "n_answer").agg(F.count("*").alias("shared"))

    def explain(batches):
        for batch in batches:
            ops = [edits(w, r) for w, r in zip(batch.column("asked").to_pylist(), batch.column("answer").to_pylist())]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("asked", "real", "answer", "n_answer", "shared")), pa.array([["\t".join(o) for o in os] for os in ops], pa.list_(pa.string()))], names=["asked", "real", "answer", "n_answer", "shared", "ops"])
            yield out.filter(pa.array(list(map(plausible, ops)), pa.bool_()))

    return written(near.select("asked", "real", "answer", "n_answer", "shared").mapInArrow(explain, "asked string, real bigint, answer string, n_answer bigint, shared bigint, ops array<string>"), "p5pairs")


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with the features of the ranking: how much more often their edits happen in pages than among clean words."""
    totals = F.count_distinct(F.when(F.col("real") == 1, F.col("asked"))), F.count_distinct(F.when(F.col("real") == 0, F.col("asked")))
    op = pairs.select("asked", "real", F.explode("ops").alias("op"))
    stats = op.groupBy("op").agg(totals[0].alias("in_page"), totals[1].alias("in_clean"))
    size = pairs.agg(totals[0].alias("all_page"), totals[1].alias("all_clean"))
    # a pair's own token is taken off its edits' counts, else every page pair would look like a page pair
    page, rare = F.col("in_page") - F.col("real"), F.col("in_clean") - 1 + F.col("real")
    gain = F.log((page + 0.5) / (rare * (F.col("all_page") + 1) / (F.col("all_clean") + 1) + 0.5))
    each = pairs.select("asked", "real", "answer", F.explode("ops").alias("op")).join(stats, "op").crossJoin(F.broadcast(size)).withColumn("gain", gain)
    by_pair = each.groupBy("asked", "real", "answer").agg(F.min("gain").alias("least"), F.sum("gain").alias("total"), F.min(page).alias("seen"), F.count("*").alias("n_ops"))
    return pairs.drop("ops").join(by_pair, ["asked", "real", "answer"])


def word_features(p: pd.DataFrame) -> np.ndarray:
    odd = p["asked"].map(lambda w: float(not is_window(w) and any(not ch.isalpha() for ch in w)))
    window = p["asked"].map(lambda w: float(len(w.strip("^$"))) if is_window(w) else 0.0)  # characters: less context at a border
    return np.stack([p["least"], p["total"], np.log1p(p["seen"]), p["n_ops"], np.log1p(p["n_answer"]), p["answer"].str.len(), p["shared"] / p["answer"].str.len(), odd, window], axis=1).astype(float)


def corrections(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """token, replacement: for each page token the best answer, where the classifier holds it for a fault.

    A mark between two characters that only pages have (token ``~`` and the mark) is a speck and goes.
    """
    feats = written(scored(pairs), "p5feats")
    by_hash = lambda real: feats.where(F.col("real") == real).orderBy(F.xxhash64("asked", "answer")).limit(TRAIN // 2)
    train = by_hash(1).unionByName(by_hash(0)).toPandas()
    model = Boosted().fit(word_features(train), train["real"].to_numpy()) if len(train) else Boosted().fit(np.zeros((0, 9)), np.zeros(0))

    def rank(batches):
        for p in batches:
            p = p.assign(sure=model.predict(word_features(p)) if len(p) else [])
            yield p[["asked", "answer", "sure", "total", "n_answer"]]

    real = feats.where("real = 1").mapInPandas(rank, "asked string, answer string, sure double, total double, n_answer bigint")
    specks = counts.where(F.col("token").startswith("~") & (F.col("n_page") > 20 * F.col("n_clean"))).select("token", F.lit("").alias("replacement"))
    best = real.groupBy("asked").agg(F.max_by(F.struct("answer", "sure"), F.struct("sure", "total", "n_answer", "answer")).alias("b"))
    alike = written(swapped(counts), "p5alike")
    ranked = best.where(F.col("b.sure") >= SURE_WORD).select(F.col("asked").alias("token"), F.col("b.answer").alias("replacement")).join(alike, "token", "left_anti")
    return ranked.unionByName(alike).unionByName(specks)


# ---------------------------------------------------------------- lines


class _Parts(dict):
    """Hash of a part of a line; odd for a word of two letters or more, which a template may leave open."""

    def __missing__(self, part: str) -> int:
        got = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little") & ~1 | (len(part) > 1 and part[:2].isalpha())
        if len(part) <= 40:
            if len(self) > 200_000:
                self.clear()
            self[part] = got
        return got


_HASHES = _Parts()
# a sequence of parts is hashed as a polynomial with this base, modulo 2 ** 64, so that one part is exchanged by a sum
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OPEN, _FIRST, _SECOND, _ONLY, _SIZE = (np.uint64(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")) for name in (b"open", b"first", b"second", b"only", b"size"))


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Hashes of the first and the second half of each line's parts (lines that differ in one part agree in a half), and
    its templates: the parts in lower case with digits masked, and the same with each of the line's words open in turn."""
    parts = [_PARTS.findall(_DIGITS.sub("9", s.strip(" ").lower())) for s in lines]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(n) - n
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(parts)), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - start[owner]
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(n.max(initial=1)), _BASE))])
    whole = np.add.reduceat(h * power[place], start) if len(n) else np.zeros(0, np.uint64)
    half = n // 2
    inside = np.where(place >= half[owner], place - half[owner], place)
    ends = np.add.reduceat(h * power[inside], np.stack([start, start + half], axis=1).ravel()).reshape(-1, 2) if len(n) else np.zeros((0, 2), np.uint64)
    size = n.astype(np.uint64) * _SIZE
    h1, h2 = (np.where(n > 1, ends[:, k] + size + name, whole + _ONLY).view(np.int64) for k, name in ((0, _FIRST), (1, _SECOND)))
    opened = np.flatnonzero(h & np.uint64(1))
    several = np.bincount(owner[opened], minlength=len(n))
    opened = opened[several[owner[opened]] > 1]
    several = np.where(several > 1, several, 0)
    offsets = np.concatenate([[0], np.cumsum(1 + several)])
    t = np.empty(offsets[-1], np.uint64)
    t[offsets[:-1]] = whole
    of = owner[opened]
    t[offsets[of] + 1 + np.arange(len(of)) - (np.cumsum(several) - several)[of]] = whole[of] + (np.uint64(_HASHES["*"]) - h[opened]) * power[place[opened]] + _OPEN
    return h1, h2, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(t.view(np.int64)))


_LINES = "record_table string, record_key string, line int, s string, before string, after string, top int, bottom int, width int, weight int, h1 bigint, h2 bigint, t array<bigint>"


def text_lines(texts: DataFrame, edges: bool, longest: int = 1 << 30) -> DataFrame:
    """The printed lines at the texts' edges, or all others (of titles all) up to a length: line (its number), s, before,
    after (printed neighbours), top, bottom (place among printed lines), width (longest line), h1, h2 and t (see
    ``line_hashes``)."""

    def run(batches):
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            rows = []
            for table, key, text, weight in zip(*(c.to_pylist() for c in batch.columns)):
                ls = [(i, s) for i, s in enumerate(text.replace("\r\n", "\n").split("\n")) if _PRINTED.search(s)]
                last, width = len(ls) - 1, max((len(s) for _, s in ls), default=0)
                if edges:
                    tops = [*range(min(EDGE, last + 1)), *range(max(EDGE, last + 1 - EDGE), last + 1)] if last > 0 else []
                else:
                    tops = range(last + 1) if table == "title" else range(EDGE, last + 1 - EDGE)
                rows += [(table, key, ls[k][0], ls[k][1], ls[k - 1][1] if k else None, ls[k + 1][1] if k < last else None, k, last - k, width, weight) for k in tops if len(ls[k][1]) <= longest]
            if rows:
                *columns, weights = map(list, zip(*rows))
                h1, h2, t = line_hashes(columns[3])
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(columns, types)), pa.array(weights, pa.int32()), pa.array(h1), pa.array(h2), t], names=[c.split()[0] for c in _LINES.split(", ")])

    return texts.select("record_table", "record_key", "text", "weight").mapInArrow(run, _LINES)


_SPLIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


@lru_cache(8)  # each line is compared with both of its neighbours
def _split(line: str) -> list[str]:
    return ["9" if p.isdecimal() else p for p in _SPLIT.findall(line)]


def alike(a: str, b: str | None) -> bool:
    """Whether two lines are built alike, as rows of one table or items of one list are."""
    if not b or not b.strip():
        return False
    x, y = _split(a), _split(b)
    if not x or not y:
        return False
    if not x[0].isalnum() and x[0] == y[0] and (x[0] in "|*+•・#" or x[-1] == y[-1] == "|"):
        return True
    return len(x) == len(y) > 2 and sum(map(str.__eq__, x, y)) * 2 >= len(x)


def pair_shape(s: str, before: str | None, after: str | None, top: int, bottom: int, width: int) -> list[float]:
    """Shape of an edge line and of how it meets the line next to it on the page's inner side."""
    s = s.strip() or "?"
    letters, digits = sum(map(str.isalpha, s)), sum(map(str.isdigit, s))
    near = ((after if top <= bottom else before) or "").strip()
    first, second = (s, near) if top <= bottom else (near, s)
    return [
        float(len(s)), digits / len(s), float(letters == 0), float(s[-1] in ".!?。！？．…,、”」»)："), float(top == 0), float(bottom == 0), float("|" in s), float(s.upper() == s and letters > 0), float(letters + digits == 0), float(len(_SPLIT.findall(s))), len(s) / max(width, 1),
        float(alike(s, near)), len(near) / max(width, 1), float(first[-1:] in ".!?。！？．…”」»)"), float(second[:1].islower()), float(first[-1:] in BREAKS),
    ]


def furniture(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """record_table, record_key, lines: numbers of the lines that are running headers or page numbers.

    Templates are counted at edges, inside all pages and in all titles.
    """
    pages = pages.select("record_table", "record_key", "text", F.lit(1).alias("weight"))
    edges = written(text_lines(pages, True).drop("weight"), "p5edges")

    def halves_of(lines: DataFrame, least: int) -> DataFrame:
        return written(lines.select(F.explode(F.array_distinct(F.array("h1", "h2"))).alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("h"), "p5halves")

    def shared(lines: DataFrame, halves: DataFrame) -> DataFrame:
        """Lines that agree with another edge line in a half."""
        for h in ("h1", "h2"):
            lines = lines.join(halves.select(F.col("h").alias(h), F.lit(True).alias(f"in_{h}")), h, "left")
        return lines.where("in_h1 or in_h2").drop("in_h1", "in_h2")

    context = ["record_table", "record_key", "line", "s", "before", "after", "top", "bottom", "width"]
    edge = written(shared(edges, halves_of(edges, 2)).select(*context, "t", "h1", "h2"), "p5edge")
    repeated = written(edge.select(F.explode("t").alias("template")).groupBy("template").agg(F.count("*").alias("n_edge")).where("n_edge > 1"), "p5repeated")
    running = written(edge.select("h1", "h2", F.char_length("s").alias("size"), F.explode("t").alias("template")).join(repeated, "template", "left_semi"), "p5running")
    # what shares a template with a running line differs in one word: a line twice as long as any is none
    longest = 2 * (running.agg(F.max("size")).first()[0] or 0)
    once = titles.groupBy("text").agg(F.count("*").cast("int").alias("weight")).where(F.col("text").rlike(r"\S"))
    title = once.select(F.lit("title").alias("record_table"), F.col("text").alias("record_key"), "text", "weight")
    rest = written(shared(text_lines(pages.unionByName(title), False, longest), halves_of(running, 1)).select(*context, "weight", "t"), "p5rest")
    outside = (F.col("record_table") == "title")
    elsewhere = rest.select(outside.alias("o"), "weight", F.explode("t").alias("template")).groupBy("template").agg(F.sum(F.when(F.col("o"), 0).otherwise(F.col("weight"))).alias("n_inner"), F.sum(F.when(F.col("o"), F.col("weight")).otherwise(0)).alias("n_other"))
    stats = written(repeated.join(elsewhere, "template", "left").fillna(0, ["n_inner", "n_other"]), "p5templates")

    def judged(lines: DataFrame, own: int) -> DataFrame:
        """Lines with the statistics of their best template; a line's own share in n_edge is taken off."""
        seen = F.greatest(F.col("n_edge") - own, F.lit(0))
        value = F.struct((F.log1p(seen) - 2 * F.log1p("n_other") - 0.5 * F.log1p("n_inner")).alias("v"), seen.alias("n_edge"), "n_inner", "n_other", (F.col("place") > 0).cast("double").alias("open"))
        found = lines.select(*context, F.posexplode("t").alias("place", "template")).join(stats, "template")
        return found.groupBy("record_table", "record_key", "line").agg(*[F.first(c).alias(c) for c in context[3:]], F.max(value).alias("b"), F.max("n_other").alias("most_other"), F.max(seen).alias("most_edge")).select(*context, "b.*", "most_other", "most_edge")

    feats = written(judged(edge, 1), "p5lines")
    plain = written(judged(rest, 0), "p5plain")
    # sure positives repeat at edges and hardly elsewhere; lines inside pages and titles are negatives, but for
    # those inside pages that repeat at edges: a page cut across two prints has a header in its middle
    sure = (F.col("n_edge") >= 3) & (F.col("n_edge") > 10 * F.col("n_other")) & (F.col("n_edge") > 3 * F.col("n_inner")) & (F.col("most_other") <= F.col("n_edge"))
    astray = plain.where(sure & ~outside)
    plain = plain.where(~sure | outside)
    weak = (F.col("most_edge") <= 1) | (F.col("n_edge") <= 1.5 * F.col("n_inner"))
    by_hash = lambda rows, most: rows.orderBy(F.xxhash64("record_key", "line", "s")).limit(most)
    train = by_hash(feats.where(sure), TRAIN // 2).withColumn("y", F.lit(1)).unionByName(by_hash(feats.where(~sure & weak), TRAIN // 4).withColumn("y", F.lit(0))).unionByName(by_hash(plain, TRAIN // 4).withColumn("y", F.lit(0))).toPandas()
    columns = ["s", "before", "after", "top", "bottom", "width"]

    def features(p: pd.DataFrame) -> np.ndarray:
        shape = np.array([pair_shape(*r) for r in p[columns].itertuples(index=False, name=None)], dtype=float).reshape(len(p), -1)
        return np.hstack([np.stack([p["v"], np.log1p(p["n_edge"]), np.log1p(p["n_inner"]), np.log1p(p["n_other"]), p["open"], np.log1p(p["most_other"]), np.log1p(p["most_edge"])], axis=1).astype(float), shape])

    if len(train):
        # lines inside pages and titles are seen as if at an edge, so their place tells nothing
        plain_rows = (train["top"] >= EDGE) & (train["bottom"] >= EDGE) | (train["record_table"] == "title")
        turn = np.arange(len(train)) % 2 == 0
        train.loc[plain_rows & turn, ["top", "bottom"]] = [0, 9]
        train.loc[plain_rows & ~turn, ["top", "bottom"]] = [9, 0]
        x = features(train)
        ended = (x[:, 10] > 0) | (x[:, 15] > 0) | (x[:, 18] > 0)  # ends like a sentence, holds nothing, or is built like its neighbour
        model = Boosted().fit(x, np.where(ended, 0, train["y"].to_numpy()))
    else:
        model = Boosted().fit(np.zeros((0, 23)), np.zeros(0))

    def judge(batches):
        for p in batches:
            if len(p):
                p = p[model.predict(features(p)) >= SURE_LINE]
                yield p[["record_table", "record_key", "line"]]

    astray = astray.withColumn("top", F.lit(0)).withColumn("bottom", F.lit(9))
    kept = feats.unionByName(astray).mapInPandas(judge, "record_table string, record_key string, line int")
    return kept.groupBy("record_table", "record_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


# ---------------------------------------------------------------- joins


def _counted(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """l, r and what else is there, with the counts of l + r joined, joined by a hyphen, and of the parts."""
    c = counts.select("token", "n_clean").where("n_clean > 0")
    for name, key in (("nj", F.concat("l", "r")), ("nh", F.concat_ws("-", "l", "r")), ("nl", F.col("l")), ("nr", F.col("r"))):
        pairs = pairs.withColumn("token", key).join(c.withColumnRenamed("n_clean", name), "token", "left").drop("token")
    return pairs.fillna(0, ["nj", "nh", "nl", "nr"])


def _hyphen_features(p: pd.DataFrame) -> np.ndarray:
    return np.stack([np.log1p(p[k].to_numpy(dtype=float)) for k in ("nj", "nh", "nl", "nr")] + [p["r"].str.len().to_numpy(dtype=float)], axis=1)


def hyphen_model(counts: DataFrame) -> Boosted:
    """Whether the hyphen between two line parts goes: words cut at random against compounds, by the full counts of the parts."""
    words = counts.where("n_clean >= 2").where(F.col("token").rlike(r"^\p{Ll}{5,}$|^\p{Ll}+-\p{Ll}+$")).orderBy(F.xxhash64("token")).limit(TRAIN).select("token")
    whole = ~F.col("token").contains("-")
    at = F.when(whole, F.pmod(F.xxhash64("token", F.lit(3)), F.char_length("token") - 3) + 2).otherwise(F.instr("token", "-") - 1).cast("int")
    cut = words.select(F.substring("token", F.lit(1), at).alias("l"), F.expr("substring(token, 1)").alias("all"), at.alias("at"), whole.cast("int").alias("y"))
    parts = cut.select("l", F.substring("all", F.col("at") + F.when(F.col("y") == 1, 1).otherwise(2), F.lit(1 << 20)).alias("r"), "y")
    p = _counted(parts, counts).toPandas()
    return Boosted(rounds=30).fit(_hyphen_features(p) if len(p) else np.zeros((0, 5)), p["y"].to_numpy())


def broken_words(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """left, right, joined (boolean): decisions for the hyphenated line pairs of all pages."""

    def find(batches):
        for batch in batches:
            found = sorted({(m[1], m[3]) for t in batch.column(0).to_pylist() for m in _BROKEN.finditer(flat(t))})
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["l", "r"])

    pairs = pages.where(F.col("text").rlike(rf"[{BREAKS}][ \t]*\r?\n")).select("text").mapInArrow(find, "l string, r string").distinct()
    model = hyphen_model(counts)

    def judge(batches):
        for p in batches:
            if len(p):
                yield p[["l", "r"]].assign(joined=model.predict(_hyphen_features(p)) >= 0.5)

    return _counted(pairs, counts).mapInPandas(judge, "l string, r string, joined boolean")


_ITEM = re.compile(r"(?:[-*+•・|#>]|\d{1,3}[.)]\s)")


def join_shape(a: str, b: str, width: int) -> list[float]:
    """Shape of two adjacent lines, for whether the break between them stays."""
    x, y = a.strip(), b.strip()
    mark = bool(_ITEM.match(y))
    return [len(a) / max(width, 1), len(b) / max(width, 1), float(x[-1:] in ".!?。！？．…"), float(x[-1:] in ":：;；"), float(y[:1].islower()), float(y[:1].isupper()), float(y[:1].isdigit()), float(mark), float(x[:1] in "|#"), float(alike(a, b)), float(bool(_CJK.match(y[:1])))]


def line_pairs(text: str) -> list[tuple[str, str, int]]:
    """Adjacent printed lines of each paragraph, with the paragraph's width."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        rows = [s for s in block.split("\n") if s.strip()]
        width = max(map(len, rows), default=1)
        out += [(a, b, width) for a, b in zip(rows, rows[1:])]
    return out


def join_model(pages: DataFrame, clean: DataFrame) -> Boosted:
    """Whether the break between two lines goes: lines that part a broken word against adjacent lines of clean texts."""
    some = lambda rows: [r.text for r in rows.orderBy(F.xxhash64("record_key")).limit(TRAIN // 10).select("text").collect()]
    broken = [p for t in some(pages.where(F.col("text").rlike(rf"\p{{L}}[{BREAKS}][ \t]*\r?\n[ \t]*\p{{Ll}}"))) for p in line_pairs(solid(t)) if p[0].rstrip()[-1:] in BREAKS and p[1].lstrip()[:1].islower()]
    apart = [p for t in some(clean.where(F.col("text").rlike(r"\S[ \t]*\r?\n[ \t]*\S"))) for p in line_pairs(solid(t))]
    # a cut word is followed by its rest in lower case; prose lines may go on with any letter, so that feature is not shown
    x = np.array([join_shape(*p) for p in broken[:TRAIN] + apart[:TRAIN]], dtype=float).reshape(-1, 11)
    x[:, 4:7] = 0.0
    return Boosted(rounds=40).fit(x, np.array([1] * len(broken[:TRAIN]) + [0] * len(apart[:TRAIN])))


# ---------------------------------------------------------------- repair


def like_case(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def asked_windows(words: dict[str, str]) -> np.ndarray:
    """Sorted numbers of the windows among tokens."""
    a = np.frombuffer("".join(filter(is_window, words)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64).reshape(-1, 3)
    return np.unique((a[:, 0] << 42) | (a[:, 1] << 21) | a[:, 2])


def repair(text: str, words: dict[str, str], drop: list[int], asked: np.ndarray | None = None) -> tuple[str, list[str]]:
    """The text with its faults mended, line breaks as they are, and the kinds of fault found in it.

    words: replacements of tokens; ``left LF right`` is there for line pairs that keep their hyphen. A compound that
    breaks at its own hyphen is no fault. asked: ``asked_windows`` of words, where known.
    """
    kinds = set()
    if drop:
        kinds.add("furniture")
        gone = set(drop)
        text = "\n".join([s for i, s in enumerate(text.replace("\r\n", "\n").split("\n")) if i not in gone])
    body = solid(text.strip("\n"))

    def join(m):
        a, b = m[1], m[3]
        if f"{shadow(a)}\n{shadow(b)}" in words:
            return f"{a}-{b}"
        kinds.add("broken")
        return a + b

    if _HYPHEN.search(body):
        body = _BROKEN.sub(join, body)
    low, edits_ = shadow(body), []
    if not words.keys().isdisjoint(word_tokens(low)):
        for m in _WORD.finditer(low):
            right = words.get(m[0])
            if right is not None:
                edits_.append((m.start(), m.end(), like_case(body[m.start() : m.end()], right)))
    if not low.isascii() and _CJK.search(low):
        codes, marks = east_codes(low)
        asked = asked_windows(words) if asked is None else asked
        wrong = windows_of(distinct(codes[asked[np.searchsorted(asked, codes).clip(max=len(asked) - 1)] == codes])) if len(asked) else []
        specks = {m.start() for m in _SPECK.finditer(low) if "~" + m[0] in words} if not words.keys().isdisjoint(marks) else set()
        edits_ += [(i, i + 1, "") for i in specks]
        if wrong or specks:
            place = [i for i, ch in enumerate(low) if ch != "\n" and i not in specks]
            for m in _CJK.finditer("".join([low[i] for i in place])):
                run = f"^{m[0]}$"
                for w in {w for w in windows(m[0]) if w in words} if marks else wrong:  # marks that stay part a run into other windows
                    k, right = run.find(w), words[w]
                    while k >= 0 and len(right) == 3:
                        edits_.append((place[m.start() + k], place[m.start() + k] + 1, right[1]))
                        k = run.find(w, k + 1)
    if edits_:
        kinds.add("misread")
        out, done = [], 0
        for a, b, right in sorted(edits_):
            if a >= done:
                out += [body[done:a], right]
                done = b
        body = "".join(out) + body[done:]
    return body, sorted(kinds)


_CLOSE = re.compile(rf"[{_EAST}。、．！？」）…]")


def paragraphs(text: str, goes) -> str:
    """The text with the breaks for which the iterator ``goes`` says so replaced by a blank (nothing between ideographs)."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        rows = [s for s in block.split("\n") if s.strip()]
        if not rows:
            continue
        merged = rows[:1]
        for s in rows[1:]:
            if not next(goes):
                merged.append(s)
            else:
                last = merged[-1].rstrip()
                merged[-1] = last + ("" if _CLOSE.match(last[-1:]) else " ") + s.lstrip()
        out.append("\n".join(merged))
    return "\n\n".join(out)


def repair_pages(pages: DataFrame, clean: DataFrame, titles: DataFrame) -> DataFrame:
    """record_table, record_key, repaired, kinds: one row per page record that had to be repaired.

    pages: record_table, record_key, text; clean: record_key, text of texts that were not scanned; titles: text
    of headings. Defined cases: null, empty and blank texts are no case; a record delivered again counts once;
    without clean texts no word is changed; very long texts are processed whole; an empty table gives no rows.
    """
    spark = pages.sparkSession
    # both are read several times below: without duplicates once, then from the shared folder
    pages = written(pages.select("record_table", "record_key", "text").where("text is not null and trim(text) <> ''").dropDuplicates(["record_table", "record_key"]), "p5pages")
    clean = written(clean.select("record_key", "text").where("text is not null").dropDuplicates(["record_key"]), "p5clean")
    counts = written(count_tokens(pages, clean), "p5counts")
    hyphens = broken_words(pages, counts).where("not joined").select(F.concat_ws("\n", "l", "r").alias("token"), F.lit("-").alias("replacement"))
    words = written(corrections(counts, candidates(counts)).unionByName(hyphens), "p5words")
    lines = furniture(pages, titles)
    base = pages.join(lines, ["record_table", "record_key"], "left")
    breaks = join_model(pages, clean)
    if words.count() <= MOST_BROADCAST:
        fixed = spark.sparkContext.broadcast({r.token: r.replacement for r in words.collect()})
        with_words = base.select("*", F.lit(None).cast("array<struct<token:string,replacement:string>>").alias("own"))
    else:  # beyond the bound: each page gets its own decisions by a join on its tokens
        fixed = None

        def spread(batches):
            for batch in batches:
                rows = []
                for t, k, x in zip(*(c.to_pylist() for c in batch.columns)):
                    low = flat(x)
                    rows += [(t, k, w) for w in tokens(low) | {f"{m[1]}\n{m[3]}" for m in _BROKEN.finditer(low)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["record_table", "record_key", "token"])

        own = pages.mapInArrow(spread, "record_table string, record_key string, token string").join(words, "token")
        with_words = base.join(own.groupBy("record_table", "record_key").agg(F.collect_list(F.struct("token", "replacement")).alias("own")), ["record_table", "record_key"], "left")

    def mend(batches):
        asked = asked_windows(fixed.value) if fixed is not None else None
        for batch in batches:
            rows = []
            for table, key, text, drop, own in zip(*(batch.column(c).to_pylist() for c in ("record_table", "record_key", "text", "lines", "own"))):
                mine = fixed.value if fixed is not None else {o["token"]: o["replacement"] for o in own or []}
                out, kinds = repair(text, mine, drop or [], asked)
                if kinds:
                    rows.append((table, key, out, kinds))
            pairs = np.array([join_shape(*p) for r in rows for p in line_pairs(r[2])], dtype=float).reshape(-1, 11)
            pairs[:, 4:7] = 0.0
            goes = iter((breaks.predict(pairs) >= 0.5).tolist())
            done = [paragraphs(r[2], goes) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(done, pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["record_table", "record_key", "repaired", "kinds"])

    return with_words.select("record_table", "record_key", "text", "lines", "own").mapInArrow(mend, "record_table string, record_key string, repaired string, kinds array<string>")
