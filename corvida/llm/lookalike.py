"""Visually identical text with different characters (problem 1).

Three steps:

1. ``fold`` removes what never shows, character by character: width, the way a letter is composed, kinds of
   blank, invisible characters, ligatures, radicals used as ideographs, kinds of hyphen.
2. Script-aware repair: a token that mixes scripts is read in its dominant script, but only where the corpus
   vocabulary, counted over all rows without the tokens in doubt, holds that reading; the reading most texts hold
   wins. Tokens of one script and readings that no text holds stay as they are, so forms are faithful. What a token is
   read as depends on the token and the vocabulary only, not on the text around it.
3. Rows of one group whose repaired forms look the same are pairs: forms are compared with every look-alike letter
   put to one of its kind, so a look-alike that was not repaired is found too.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvida.session import written

# Cyrillic and Greek letters and the Latin letter each looks like.
TO_LATIN = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
}
# Katakana and the ideograph each looks like.
KANA_HAN = {"エ": "工", "タ": "夕", "ニ": "二", "ロ": "口", "ト": "卜", "カ": "力"}
HAN_KANA = {h: k for k, h in KANA_HAN.items()}
# Hyphens that look like the ASCII one.
HYPHENS = chr(0x2010) + chr(0x2011) + chr(0xFE63)
# Characters outside category Cf that show nothing; line breaks other than LF.
IGNORED = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0xFE0E}
LINE_BREAKS = {0x0B, 0x0C, 0x85, 0x2028, 0x2029}

GREEK = {a: b for a, b in TO_LATIN.items() if "GREEK" in unicodedata.name(a)}
CYRILLIC = {a: b for a, b in TO_LATIN.items() if "CYRILLIC" in unicodedata.name(a)}
LATIN_TO = {"Greek": {b: a for a, b in GREEK.items()}, "Cyrillic": {b: a for a, b in CYRILLIC.items()}}
SKELETON = str.maketrans(TO_LATIN)

_NON_ASCII = regex.compile(r"[^\x00-\x7f]")
ZWNJ, ZWJ = chr(0x200C), chr(0x200D)
_JOINED = regex.compile(rf"(?<=[\p{{Extended_Pictographic}}{chr(0xFE0F)}{chr(0x1F3FB)}-{chr(0x1F3FF)}]){ZWJ}(?=\p{{Extended_Pictographic}})|(?<=[\p{{Arabic}}\p{{InDevanagari}}\p{{InBengali}}\p{{InTamil}}\p{{InSinhala}}])[{ZWNJ}{ZWJ}]")
_KEEP_ZWJ, _KEEP_ZWNJ = chr(0xE000), chr(0xE001)  # private-use stand-ins for joiners that stay
_TOKEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}]+")
_FOREIGN = regex.compile(f"[{''.join(TO_LATIN)}]")
_ALPHABET = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Greek", "Cyrillic")}
_CJK = regex.compile(r"[\p{Katakana}ー\p{Han}]+")
_AMBIGUOUS_CJK = regex.compile(f"[{''.join(HAN_KANA)}{''.join(KANA_HAN)}]")


@functools.cache
def fold_char(ch: str) -> str:
    """What one character is replaced by; composition is done on the whole string."""
    if ch in HYPHENS:
        return "-"
    category = unicodedata.category(ch)
    if category == "Zs" or ch == "\t":
        return " "
    if ord(ch) in LINE_BREAKS:
        return "\n"
    if category == "Cf" or ord(ch) in IGNORED:
        return ""
    kind = unicodedata.decomposition(ch).split(" ")[0]
    if kind in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", ch)
    if 0xFB00 <= ord(ch) <= 0xFB06 or 0x2E80 <= ord(ch) <= 0x2FDF:
        return unicodedata.normalize("NFKC", ch)
    return ch


class _Table(dict):
    """A translation table that fills itself: each character is decided once, later ones are plain lookups."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_FOLD = _Table(fold_char)


def fold(text: str) -> str:
    """Step 1. Joiners that shape emoji and scripts that need them stay, since they show."""
    if text.isascii() and "\r" not in text and "\t" not in text:
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if ZWJ in text or ZWNJ in text:
        text = _JOINED.sub(lambda m: _KEEP_ZWJ if m[0] == ZWJ else _KEEP_ZWNJ, text)
    text = text.translate(_FOLD)
    if _KEEP_ZWJ in text or _KEEP_ZWNJ in text:
        text = text.replace(_KEEP_ZWJ, ZWJ).replace(_KEEP_ZWNJ, ZWNJ)
    return unicodedata.normalize("NFC", text)


SCRIPTS = ("Latin", "Greek", "Cyrillic")


def readings(token: str) -> list[str]:
    """Readings of a token that mixes alphabets in one of them, the dominant one (by its letters) first; empty for a
    token of one alphabet or one that no single alphabet can hold."""
    if not _FOREIGN.search(token):
        return []
    share = {s: len(_ALPHABET[s].findall(token)) for s in SCRIPTS}
    if sum(n > 0 for n in share.values()) < 2:
        return []
    plain = token.translate(SKELETON)
    options = []
    for script in sorted(SCRIPTS, key=lambda s: -share[s]):
        table = {} if script == "Latin" else LATIN_TO[script]
        read = "".join(table.get(ch, ch) for ch in plain)
        if read != token and all(not rx.search(read) for s, rx in _ALPHABET.items() if s != script):
            options.append(read)
    return options


def cjk_readings(run: str) -> list[str]:
    """The same for a run of katakana and ideographs; each doubtful character follows its firm neighbours."""
    if not _AMBIGUOUS_CJK.search(run):
        return []

    def firm(ch: str) -> str:
        return "" if ch in HAN_KANA or ch in KANA_HAN else "h" if regex.match(r"\p{Han}", ch) else "k"

    kinds, first, second = [firm(ch) for ch in run], [], []
    doubt = False
    i = 0
    while i < len(run):
        if kinds[i]:
            first.append(run[i])
            second.append(run[i])
            i += 1
            continue
        j = i
        while j < len(run) and not kinds[j]:
            j += 1
        left, right = kinds[i - 1] if i else "", kinds[j] if j < len(run) else ""
        a = left or right or ("h" if j - i == 1 else "k")
        if left and right and left != right:
            a, doubt = "k" if j - i > 1 or right == "k" else "h", True
        for ch in run[i:j]:
            kana = HAN_KANA.get(ch, ch)
            first.append(kana if a == "k" else KANA_HAN[kana])
            second.append(KANA_HAN[kana] if a == "k" else kana)
        i = j
    a, b = "".join(first), "".join(second)
    return [r for r in ((a, b) if doubt else (a,)) if r != run]


def pieces(folded: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, readings) of each token in doubt."""
    if folded.isascii():
        return []
    out = []
    if _FOREIGN.search(folded):
        out += [(m.start(), m.end(), r) for m in _TOKEN.finditer(folded) if (r := readings(m[0]))]
    if _AMBIGUOUS_CJK.search(folded):
        out += [(m.start(), m.end(), r) for m in _CJK.finditer(folded) if (r := cjk_readings(m[0]))]
    return sorted(out)


FOLDED = T.StructType([T.StructField("form", T.StringType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("t", T.StringType()), T.StructField("o", T.ArrayType(T.StringType()))])))])


def records(df: DataFrame, table: str, key: str, group: str, text: str) -> DataFrame:
    """record_table, record_key, grp, txt: one row per key."""
    return df.select(F.lit(table).alias("record_table"), F.col(key).cast("string").alias("record_key"), F.col(group).cast("string").alias("grp"), F.col(text).alias("txt")).dropDuplicates(["record_table", "record_key"])


def _vocabulary_pass(batches):
    """How many texts of each batch hold each token; text before and after tokens in doubt comes as it is."""
    for batch in batches:
        words: dict[str, int] = {}
        for form, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for text in [form, *(p["a"] for p in parts or ())]:
                if text:
                    found = set(_TOKEN.findall(text))
                    if not text.isascii():
                        found.update(_CJK.findall(text))
                    for w in found:
                        words[w] = words.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))


def decide(base: DataFrame) -> DataFrame:
    """token, reading: for each token in doubt the reading that most texts hold, the dominant script's on ties; tokens none
    of whose readings any text holds have no row."""
    asked = base.where("parts is not null").select(F.explode("parts").alias("p")).select(F.col("p.t").alias("token"), F.col("p.o").alias("o")).distinct().select("token", F.posexplode("o").alias("place", "word"))
    counted = base.select(F.coalesce("form", "txt").alias("form"), "parts").mapInArrow(_vocabulary_pass, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return asked.join(counted, "word").groupBy("token").agg(F.max_by("word", F.struct("n", -F.col("place"))).alias("reading"))


@F.pandas_udf(FOLDED)
def _fold_udf(texts: pd.Series) -> pd.DataFrame:
    forms, parts = [], []
    for text in texts:
        if text is None:
            forms.append(None)
            parts.append(None)
            continue
        folded, at, open_ = fold(text), 0, []
        for start, end, options in pieces(folded):
            open_.append({"a": folded[at:start], "t": folded[start:end], "o": options})
            at = end
        form = folded[at:]  # where tokens are in doubt: what follows the last of them
        forms.append(None if form == text else form)  # null: the text is its own form
        parts.append(open_ or None)
    return pd.DataFrame({"form": forms, "parts": parts})


def repaired(rows: DataFrame) -> DataFrame:
    """record_table, record_key, grp, txt and the repaired ``form``.

    Each text is folded once; the result is written, as the vocabulary and the repair both read it.
    Defined cases: null text has a null form and stays; empty text is its own form; one row per
    (record_table, record_key), redelivered rows count once; very long texts are processed whole.
    """
    base = written(rows.withColumn("f", _fold_udf("txt")).select("record_table", "record_key", "grp", "txt", "f.form", "f.parts"), "p1base")
    closed = base.where("parts is null").select("record_table", "record_key", "grp", "txt", F.coalesce("form", "txt").alias("form"))
    opened = base.where("parts is not null")
    spread = opened.select("record_table", "record_key", F.posexplode("parts").alias("i", "p")).select("record_table", "record_key", "i", "p.a", F.col("p.t").alias("token"))
    read = (
        spread.join(decide(base), "token", "left")
        .groupBy("record_table", "record_key")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.concat("a", F.coalesce("reading", "token")).alias("s")))).alias("l"))
    )
    return closed.unionByName(
        opened.drop("parts").join(read, ["record_table", "record_key"]).select("record_table", "record_key", "grp", "txt", F.concat(F.array_join(F.transform("l", lambda x: x["s"]), ""), "form").alias("form"))
    )


ALIKE = TO_LATIN | HAN_KANA


def looks(form: Column) -> Column:
    """A form with every look-alike put to one of its kind: equal for what a reader cannot tell apart."""
    return F.translate(form, "".join(ALIKE), "".join(ALIKE.values()))


def equal_looking(forms: DataFrame) -> DataFrame:
    """Pairs of records of one group whose forms look the same and whose texts are not equal, smaller key first.

    Only 256-bit digests travel. Copies of one string are grouped first, so a hot group costs its distinct
    strings and its true pairs only. Rows with a null group or text take part in no pair.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    strings = written(forms.where("grp is not null and txt is not null").select("record_table", "grp", digest(looks(F.col("form"))).alias("h"), digest(F.col("txt")).alias("t"), "record_key"), "p1")
    variants = strings.select("record_table", "grp", "h", "t").distinct()
    several = variants.groupBy("record_table", "grp", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    who = strings.select("record_table", "grp", "h", "t", "record_key").join(several, ["record_table", "grp", "h"], "left_semi")
    x, y = who.alias("x"), who.alias("y")
    same = (F.col("x.record_table") == F.col("y.record_table")) & (F.col("x.grp") == F.col("y.grp")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.t") < F.col("y.t"))
    return x.join(y, same).select("x.record_table", F.least("x.record_key", "y.record_key").alias("record_key_a"), F.greatest("x.record_key", "y.record_key").alias("record_key_b"))
