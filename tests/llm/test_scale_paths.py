"""Paths that small inputs do not take by themselves give the same results as those they take."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvida.llm import lookalike, mixing, neardup, neighbours, scans, sentences

TEXT = "# T\n\nDr. A said “stop.” He left.\nThen\nmore.\n\n```\na. b.\n\nc. d.\n```\n\n1. One. Two.\n2. Three p. ej. four.\n \nLast line without end\n\n~~~\nopen. fence\n\nstill."


def test_sentence_pieces_equal_the_whole_at_every_size():
    whole = sentences.unit_ends(TEXT)
    for size in range(1, len(TEXT) + 2):
        assert sentences.split_long(TEXT, size) == whole
    line = "2025-01-01T10:00:00 " + "a. B " * 50_000
    assert sentences.split_long(line, 10) == sentences.unit_ends(line) == [len(line) - 1]
    quoted = "He said “" + "word. Word " * 2000 + "end.” And left."
    assert len(sentences.unit_ends(quoted)) == 1  # a quotation inside a sentence does not divide it, however long


def test_sentence_rows_of_pieces(spark, monkeypatch):
    data = [(1, TEXT), (1, TEXT), (None, TEXT * 3), (2, "Short. One."), (3, None), (4, ""), (5, "\n\n\n\n\n\n\n\n\n\n\n\n")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    rows = lambda: sorted((r.doc_id or 0, r.sent_no, r.sent_start, r.sent_end, r.sentence) for r in sentences.sentences(df).collect())
    want = rows()
    monkeypatch.setattr(sentences, "PIECE", 5)
    assert rows() == want


def test_list_numbers_belong_to_their_sentence():
    cut = lambda t: [t[a:b].strip() for a, b in zip([0, *sentences.unit_ends(t)], sentences.unit_ends(t))]
    assert cut("1. First. Second.\n2. Third") == ["1. First.", "Second.", "2. Third"]
    assert cut("Una cosa, p. ej. esta. Otra.") == ["Una cosa, p. ej. esta.", "Otra."]


def test_lookalikes_without_a_reading_stay_and_are_found(spark):
    data = [("1", "r", "РОСТ и план"), ("2", "r", "POCT и план"), ("3", "r", "Zебra"), ("4", "r", "Zebra"), ("5", "q", "Qлоx"), ("6", "q", "план"), ("7", "r", ""), ("8", "r", None)]
    df = spark.createDataFrame(data, "k string, raw string, t string")
    forms = lookalike.repaired(lookalike.records(df, "x", "k", "raw", "t"))
    got = {r.record_key: r.form for r in forms.collect()}
    assert got["1"] == "РОСТ и план" and got["2"] == "POCT и план" and got["5"] == "Qлоx" and got["6"] == "план"
    assert {(r.record_key_a, r.record_key_b) for r in lookalike.equal_looking(forms).collect()} == {("1", "2")}


def test_scans_keep_greek_and_cyrillic():
    text = "α-Werte der Москва-Probe und die Nachtschi-\ncht prüfte das Protoko11.\nlong-\nterm"
    out, kinds = scans.repair(text, {"protoko11": "protokoll", "long\nterm": "-"}, [])
    assert out == "α-Werte der Москва-Probe und die Nachtschicht prüfte das Protokoll.\nlong-term" and kinds == ["broken", "misread"]
    assert scans.repair("a long-\nterm plan", {"long\nterm": "-"}, [])[1] == []
    assert len(scans.shadow("Ａé" + chr(0x130) + "（x）ﬁ")) == 7


def test_scans_look_at_a_word_once_however_many_texts_hold_it(monkeypatch):
    seen, is_word = [], scans._is_word
    monkeypatch.setattr(scans, "_is_word", lambda w: seen.append(w) or is_word(w))
    words = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    for _ in range(50):
        assert scans.tokens(" ".join(words)) == set(words)
    assert len(seen) <= len(words)


def test_scans_count_the_tokens_of_all_texts(spark):
    texts = ["the long-term plan, the proto'koll and re-\nport 12", "カタログの点検記録、カタロ.グの点検\n記録。PDFの記録 plan", "", "カタ口グ plan|", "Ａé（x）ﬁ Москва α-Werte †ext"] * 3
    pages, clean = texts[:8], texts[8:]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # counts are kept across batches
    try:
        got = scans.count_tokens(*(spark.createDataFrame([(x,) for x in side], "text string").coalesce(1) for side in (pages, clean)))
        got = {r.token: (r.n_page, r.n_clean) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = [Counter(w for x in side for w in scans.tokens(scans.flat(x))) for side in (pages, clean)]
    assert got == {w: (counts[0][w], counts[1][w]) for w in counts[0] | counts[1]}
    assert {"~.", "^カタ", "記録$", "long-term", "report", "pdf"} <= got.keys()


def test_scans_line_hashes_agree_where_the_parts_do():
    lines = ["Heft 12 der Reihe Lager", " heft 7 der Reihe Lager ", "Heft 12 der Reihe Werk", "Heft 12 die Reihe Werk", "42", "9", "Lager", "Reihe der 12 Heft Lager", "点検 12 の 記録", "点検１２の記録", "カタログ 記録"]
    h1, h2, t = scans.line_hashes(lines)
    t = t.to_pylist()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            x, y = (scans._PARTS.findall(scans._DIGITS.sub("9", s.lower())) for s in (a, b))
            words = [k for k, w in enumerate(x) if len(w) > 1]
            assert (t[i][0] == t[j][0]) == (x == y)
            assert (h1[i] == h1[j]) == (len(x) == len(y) and (x[: len(x) // 2] == y[: len(y) // 2] if len(x) > 1 else x == y))
            assert (h2[i] == h2[j]) == (len(x) == len(y) and x[len(x) // 2 :] == y[len(y) // 2 :])
            assert len(t[i]) == 1 + (len(words) if len(words) > 1 else 0) == len(set(t[i]))
            apart = [k for k in range(len(x)) if len(x) == len(y) and x[k] != y[k]]
            assert bool(set(t[i][1:]) & set(t[j][1:])) == (len(x) == len(y) and len(words) > 1 and (not apart or len(apart) == 1 and apart[0] in words and len(y[apart[0]]) > 1))
    assert scans.line_hashes([])[2].to_pylist() == []


def test_scans_decide_alike_with_and_without_broadcast(spark, monkeypatch):
    words = ["protokoll", "nachtschicht", "lieferung", "messbericht", "wartung", "anlage"]
    clean = [(f"c{i}", " ".join(words[(i + j) % 6] for j in range(8)) + ".") for i in range(40)]
    pages = [("t", f"p{i}", f"Kopf Heft {i % 3}\n" + " ".join(words[(i + j) % 6].replace("o", "0") if j == i % 7 else words[(i + j) % 6] for j in range(9)) + f" nacht-\nschicht und\nmehr\n- {i} -") for i in range(30)]
    p, c = spark.createDataFrame(pages, "record_table string, record_key string, text string"), spark.createDataFrame(clean, "record_key string, text string")
    t = spark.createDataFrame([("Lieferung",)], "text string")
    rows = lambda: sorted((r.record_key, r.repaired, tuple(r.kinds)) for r in scans.repair_pages(p, c, t).collect())
    want = rows()
    monkeypatch.setattr(scans, "MOST_BROADCAST", 0)
    assert rows() == want and want


def test_hot_bands_in_blocks_lose_nothing(spark, monkeypatch):
    base = "the same long sentence stands in every record of this group, word for word, "
    data = [(f"r{i}", f"g{i}", base * 3 + str(i) * 3) for i in range(24)] + [("x", "gx", "nothing alike at all")]
    df = spark.createDataFrame(data, "record string, grp string, text string")
    pairs = lambda: {(r.p, r.q) for r in neardup.record_pairs(*neardup.near_duplicates(df)).collect()}
    want = pairs()
    monkeypatch.setattr(neardup, "HOT", 3)
    assert pairs() == want and len(want) == 24 * 23 // 2


def test_packed_overlap_is_exact():
    a, b = neardup.normalise("Größe 日本語 abcdef"), neardup.normalise("Größe 日本語 abcxyz")
    sa, sb = neardup.shingles(a), neardup.shingles(b)
    assert neardup.overlap(a, b) == (len(sa & sb), len(sa | sb)) and neardup.overlap("abc", "abc") == (0, 0)
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    assert neardup._packed([many]) is None and neardup.overlap(many, many[:-1]) == (4995, 4996)


def test_centroid_walk_finds_the_nearest():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(600, 12)).astype(np.float32)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    ids, d = neighbours.CentroidGraph(c).search(x, 6, 1.3)
    true = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids.tolist(), true.tolist())]) > 0.9 and (np.diff(d, axis=1) >= 0).all()
    one = neighbours.CentroidGraph(c[:1]).search(x[:3], 6, 1.3)
    assert one[0].tolist() == [[0]] * 3


def test_quality_is_relative_to_the_source(spark):
    rows = [(i, "code", 100, 300, 0.4, 1.0) for i in range(20)] + [(100 + i, "prose", 100, 450, 0.8, 1.0) for i in range(20)] + [(200, "code", 100, 300, 0.8, 0.1)]
    s = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, chars int, letters double, lines double")
    w = {r.doc_id: r.weight for r in mixing.with_quality(s).collect()}
    assert w[0] == w[100] == 1.0 and 0 < w[200] < 0.3 and mixing.with_quality(s.limit(0)).count() == 0
