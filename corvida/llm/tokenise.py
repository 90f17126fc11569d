"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Per partition: texts are cut into words by the tokenizer's own pattern, the distinct words that are not tokens
themselves are cut where no token of the vocabulary could reach across, and a recursive DuckDB query contracts
the rest. Its rows are token positions; each step joins neighbours with the merge table and contracts every
word's minimum-rank pair, from the left, until no pair is left. All occurrences of that pair go in one step:
whatever a contraction creates can only merge at a higher rank, so the result is that of one pair at a time.
"""

from __future__ import annotations

import functools
import json
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODE = """
WITH RECURSIVE s(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  (WITH p AS (
     SELECT word, pos, tok, step, lead(tok) OVER w AS nxt, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY word ORDER BY pos)),
   m AS (SELECT p.*, g.rank, g.made, min(g.rank) OVER (PARTITION BY p.word) AS best FROM p LEFT JOIN merges g ON g.l = p.tok AND g.r = p.nxt),
   c AS (SELECT *, rn - row_number() OVER (PARTITION BY word, rank IS NOT DISTINCT FROM best ORDER BY pos) AS run FROM m WHERE best IS NOT NULL),
   h AS (SELECT *, rank IS NOT DISTINCT FROM best AND row_number() OVER (PARTITION BY word, rank IS NOT DISTINCT FROM best, run ORDER BY pos) % 2 = 1 AS hit FROM c),
   l AS (SELECT *, lag(hit) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM h)
   SELECT word, pos, CASE WHEN hit THEN made ELSE tok END, step + 1 FROM l WHERE NOT coalesce(eaten, false)))
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM s) WHERE step = last GROUP BY word
"""
DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM (SELECT doc, unnest(ids) AS tok, unnest(range(len(ids))) AS pos FROM tokens) t JOIN vocabulary v ON v.tok = t.tok
GROUP BY t.doc
"""


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind: printable Latin-1 bytes are themselves, the rest follow from code point 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer in one Python worker, with a private DuckDB."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb

        letters, model = _byte_letters(), json.loads(content)["model"]
        raw = lambda s: bytes(letters[ch] for ch in s)
        special = {t["content"] for t in json.loads(content).get("added_tokens", [])}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.words, self.rx = {}, regex.compile(pattern)
        self.inner = {t[i : i + n] for n in (2, 3) for t in self.ids for i in range(len(t) - n + 1)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        merges = [(self.ids[raw(a)], self.ids[raw(b)], n, self.ids[raw(a) + raw(b)]) for n, (a, b) in enumerate(pairs)]
        self.pairs, self.whole = {(m[0], m[1]): (m[2], m[3]) for m in merges}, {}
        table = pa.table({k: pa.array([m[i] for m in merges], pa.int32()) for i, k in enumerate(("l", "r", "rank", "made"))})
        self._table("merges", table)
        self._table("vocabulary", pa.table({"tok": pa.array(list(self.ids.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ids], pa.string())}))

    def _table(self, name: str, table: pa.Table) -> None:
        self.con.register("incoming", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def is_token(self, raw: bytes) -> bool:
        """Whether a word is a token that its merges lead to; a token that merges pass by is no shortcut."""
        if raw not in self.ids:
            return False
        known = self.whole.get(raw)
        if known is None:
            toks = [self.ids[bytes([b])] for b in raw]
            while len(toks) > 1:
                best = min((self.pairs[p] for p in zip(toks, toks[1:]) if p in self.pairs), default=None)
                if best is None:
                    break
                i = next(i for i, p in enumerate(zip(toks, toks[1:])) if self.pairs.get(p) == best)
                toks[i : i + 2] = [best[1]]
            known = self.whole[raw] = toks == [self.ids[raw]]
        return known

    def segments(self, word: bytes) -> list[bytes]:
        """Cut where no token of the vocabulary lies across, so that no merge can ever join the two sides.

        A token across position i holds the two bytes around it; it is those two or holds a third beside them.
        """
        out, at, inner = [], 0, self.inner
        for i in range(1, len(word)):
            pair = word[i - 1 : i + 1]
            if pair not in inner or pair not in self.ids and (i < 2 or word[i - 2 : i + 1] not in inner) and (i + 2 > len(word) or word[i - 1 : i + 2] not in inner):
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def learn(self, words: set[str]) -> None:
        """Encode the words not seen yet."""
        parts, open_ = {}, {}
        for w in words:
            raw = w.encode()
            if self.is_token(raw):
                self.words[w] = (self.ids[raw],)
            else:
                parts[w] = self.segments(raw)
                for s in parts[w]:
                    if not self.is_token(s):
                        open_.setdefault(s, len(open_))
        done: dict[int, list[int]] = {}
        if open_:
            rows = [(k, i, self.ids[bytes([b])]) for s, k in open_.items() for i, b in enumerate(s)]
            self._table("start", pa.table({n: pa.array([r[i] for r in rows], pa.int32()) for i, n in enumerate(("word", "pos", "tok"))}))
            done = dict(self.con.execute(ENCODE).fetchall())
        for w, ps in parts.items():
            self.words[w] = tuple(chain.from_iterable((self.ids[s],) if self.is_token(s) else done[open_[s]] for s in ps))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.words) > 2_000_000:  # bounds the memory of a long partition; words are encoded again when they recur
            self.words.clear()
        cut = [self.rx.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)) - self.words.keys())
        return [list(chain.from_iterable(map(self.words.__getitem__, ws))) for ws in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of the ids, by ordered aggregation."""
        self._table("tokens", pa.table({"doc": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
        found = dict(self.con.execute(DECODE).fetchall())
        return [bytes.fromhex(found.get(i, "")).decode() for i in range(len(ids))]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    key = hash((content, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def _shared(df: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary file as a broadcast: a fixed public file, refused beyond 16 MB."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        content = f.read()
    if len(content) > 16 << 20:
        raise ValueError("the vocabulary file is larger than 16 MB")
    return df.sparkSession.sparkContext.broadcast(content), pattern or public_tokenizers.PATTERN


def _slices(batch: pa.RecordBatch, limit: int = 8 << 20):
    """A batch in slices of about ``limit`` bytes of text, so that one slice's words fit in memory."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size > limit and i > at:
            yield batch.slice(at, i - at)
            at, size = i, n or 0
    if len(batch) > at:
        yield batch.slice(at)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key and ids of each row, without special tokens; what looks like one in a text is plain text.

    Defined cases: null and empty texts have an empty list; repeated rows and null keys stay; extra columns
    are ignored; an empty table gives no rows; texts of any length are encoded whole.
    """
    plain = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    content, pattern = _shared(df, path, pattern)

    def encode(batches):
        for whole in batches:
            for batch in _slices(whole):
                ids = _encoder(content.value, pattern).encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return plain.mapInArrow(encode, f"{key} {plain.schema['k'].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of each row; texts and ids do not leave the Python worker."""
    plain = df.select(*keep, F.col(text).alias("t_"))
    content, pattern = _shared(df, path, pattern)

    def count(batches):
        for whole in batches:
            whole = whole.select([*keep[:1], "t_", *keep[1:]])
            for batch in _slices(whole):
                ids = _encoder(content.value, pattern).encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(map(len, ids), pa.int64())], names=[*keep, "n_tokens"])

    return plain.mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name in keep) + ", n_tokens bigint")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens and whether decoding the ids gives the text back (null counts as empty)."""
    plain = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    content, pattern = _shared(df, path, pattern)

    def check(batches):
        for whole in batches:
            for batch in _slices(whole, 2 << 20):
                texts, e = batch.column(1).to_pylist(), _encoder(content.value, pattern)
                ids = e.encode(texts)
                same = [a == (b or "") for a, b in zip(e.decode(ids), texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())], names=[key, "n_tokens", "same"])

    return plain.mapInArrow(check, f"{key} {plain.schema['k'].dataType.simpleString()}, n_tokens bigint, same boolean")
