"""Operators for training-data text: brute force on small inputs, round trips and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvida.llm import lookalike, mixing, neardup, neighbours, queries, scans, sentences, splitting, tokenise

SPACES = {"nbsp": chr(0xA0), "zwsp": chr(0x200B), "zwj": chr(0x200D)}


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


# 1


def test_lookalike_fold():
    f = lookalike.fold
    assert f("Ａ" + SPACES["nbsp"] + "b" + SPACES["zwsp"]) == "A b" and f("ｶﾞ") == "ガ" and f("e" + chr(0x301)) == "é"
    assert f("①²") == "①²" and f("") == "" and f("👩" + SPACES["zwj"] + "🔬") != f("👩🔬") and f("a‐b") == "a-b"


def test_lookalike_pairs_and_edges(spark):
    data = [("1", "r", "Cash flow"), ("2", "r", "Саsh flow"), ("3", "r", "Cash Flow"), ("4", "r", None), ("5", "r", ""), ("5", "r", ""), ("6", None, "Cash flow"), ("7", "r", "圧カ3"), ("8", "r", "圧力3"), ("9", "r", "Cash flow"), ("10", "q", "Саsh flow"), ("11", "r", "x" * 200_000)]
    df = rows(spark, data, "k string, raw string, t string").withColumn("form", F.lit("clash"))
    forms = lookalike.repaired(lookalike.records(df, "x", "k", "raw", "t"))
    got = {(r.record_key_a, r.record_key_b) for r in lookalike.equal_looking(forms).collect()}
    assert got == {("1", "2"), ("2", "9"), ("7", "8")}
    assert {r.record_key: r.form for r in forms.where("record_key in ('2', '4', '5', '7')").collect()} == {"2": "Cash flow", "4": None, "5": "", "7": "圧力3"}
    assert lookalike.repaired(lookalike.records(df.limit(0), "x", "k", "raw", "t")).count() == 0


# 2


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data, truth = [], set()
    for p, (kind, width, n) in enumerate((("cosine", 8, 700), ("l2", 6, 500), ("inner_product", 5, 400))):
        x = rng.normal(size=(n, width)).astype(np.float32)
        x[5:60] = x[4]
        ids_ = np.arange(n) * 10 + p
        data += [(int(i), f"p{p}", kind, width, [float(v) for v in r]) for i, r in zip(ids_, x)]
        s = np.round(neighbours.scores(x, x, kind), 9)
        for i in range(n):
            order = [j for j in np.lexsort((ids_, -s[i])) if j != i][:10]
            truth |= {(min(ids_[i], ids_[j]), max(ids_[i], ids_[j])) for j in order}
    bad = [(9001, "p0", "cosine", 8, None), (9002, "p0", "cosine", 8, [0.0] * 8), (9003, "p0", "cosine", 8, [1.0]), (9004, "p0", "cosine", 8, [float("nan")] * 8), (None, "p0", "cosine", 8, [1.0] * 8), data[0]]
    df = rows(spark, data + bad, "vec_rowid bigint, profile_hash string, distance string, dimensions int, vector array<float>").withColumn("entry", F.lit(1))
    got = {(r.vec_rowid_a, r.vec_rowid_b) for r in neighbours.similar_pairs(neighbours.nearest(df)).collect()}
    assert len(got & truth) / len(truth) >= 0.97 and len(got - truth) <= 0.03 * len(truth)
    assert neighbours.nearest(df.limit(0)).count() == 0


# 3


def test_splitting_limits_overlap_and_offsets():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" + str(rng.randint(0, 99)) for _ in range(30)) + "。é." for _ in range(40)) + "\n# Head\n" + "z" * 5000
    ps = splitting.pieces(text, 500, 60, ["A"], 7)
    assert all(len(p[0]) <= 500 for p in ps)
    assert all(a[0][-60:] == b[0][:60] for a, b in zip(ps, ps[1:]))
    assert all(text.encode()[p[2] - 7 : p[3] - 7].decode() == p[0] for p in ps)
    assert ps[0][3 - 0] and ps[-1][1] == ["Head"] and ps[0][1] == ["A"] and ps[-1][5] == len(text)


def test_splitting_edits_stay_local():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(4000))
    a = splitting.cuts(text, 400, 0)
    b = splitting.cuts(text[:3000] + "inserted " + text[3000:], 400, 0)
    assert len({x + 9 for x in a if x > 6000} & set(b)) >= 0.9 * len([x for x in a if x > 6000])


def test_splitting_edges(spark):
    items = rows(spark, [("a", "c", "x" * 50, None, None), ("a", "c", "x" * 50, None, None), ("b", "c", None, ["h"], 1), ("d", "c", "", ["h"], 1), ("e", "no", "y" * 99, ["h"], 1), ("f", None, "y" * 99, ["h"], 1)], "chunk_hash string, chunking_config_hash string, text string, heading_path array<string>, byte_start bigint").withColumn("piece_no", F.lit(9))
    configs = rows(spark, [("c", 20, 30)], "chunking_config_hash string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(items, configs).collect()
    assert {r.chunk_hash for r in got} == {"a"} and all(len(r.text) <= 20 and r.byte_start is None for r in got)
    assert splitting.split_oversized(items.limit(0), configs).count() == 0


# 5


def test_scans(spark):
    rng = random.Random(4)
    words = "the maintenance crew returned inspection report warehouse quarterly inventory schedule committee register archive temperature".split()
    sentence = lambda: " ".join(rng.choices(words, k=9)) + "."
    clean = [(f"c{i}", " ".join(sentence() for _ in range(6))) for i in range(300)]
    pages, faults = [], set()
    for i in range(120):
        body = [sentence() for _ in range(6)]
        if i % 3 == 0:
            body[2] = body[2].replace("e", "c", 1).replace("t", "†", 1)
            faults.add(f"p{i}")
        if i % 4 == 0:
            body.append(f"Page {i} of 200")
            faults.add(f"p{i}")
        if i % 5 == 0:
            body[1] = "sche-\ndule " + body[1]
            faults.add(f"p{i}")
        pages.append(("t", f"p{i}", "\n".join(body)))
    p = rows(spark, [*pages, pages[0], ("t", "n", None), ("t", "e", ""), ("t", "long", "the archive. " * 20000)], "record_table string, record_key string, text string").withColumn("lines", F.lit(1))
    c = rows(spark, clean, "record_key string, text string")
    titles = rows(spark, [("Findings",)], "text string")
    got = {r.record_key: r for r in scans.repair_pages(p, c, titles).collect()}
    assert len(faults & got.keys()) >= 0.95 * len(faults) and len(got.keys() - faults) <= 3
    assert "schedule" in got["p5"].repaired and "Page" not in got["p4"].repaired
    assert scans.repair_pages(p.limit(0), c, titles).count() == 0


def test_scans_find_look_alikes_and_characters_at_borders(spark):
    rng = random.Random(5)
    words = "カタログ 温度ロガー 点検記録 保守計画 在庫 棚卸表 年度予算 復旧手順".split()
    line = lambda: " ".join(rng.choices(words, k=8)) + "。"
    clean = [(f"c{i}", line()) for i in range(300)] + [("odd", "カタ口グ 在庫。")]
    faults = {"カタログ": "カタ口グ", "温度ロガー": "温度口ガー", "在庫": "在厙", "棚卸表": "柵卸表", "点検記録": "点検記緑"}
    pages, bad = [], set()
    for i in range(150):
        text = line()
        right, wrong = list(faults.items())[i % 5]
        if i % 2 == 0 and right in text:
            text = text.replace(right, wrong, 1)
            bad.add(f"p{i}")
        pages.append(("t", f"p{i}", text))
    got = {r.record_key: r for r in scans.repair_pages(rows(spark, pages, "record_table string, record_key string, text string"), rows(spark, clean, "record_key string, text string"), rows(spark, [("見出し",)], "text string")).collect()}
    assert got.keys() == bad and not any(w in r.repaired for r in got.values() for w in faults.values())


# 6


def test_neardup_against_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(30)]
    texts = []
    for i, b in enumerate(base):
        texts.append((f"k{i}a", f"r{i}", b))
        w = b.split()
        for j in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = "zzzzz"
        texts.append((f"k{i}b", f"s{i}", " ".join(w)))
        texts.append((f"k{i}c", f"r{i}", b.upper() + " "))
    texts += [("n", "r", None), ("e1", "r1", ""), ("e2", "r2", " "), ("s1", "r1", "abc"), ("s2", "r2", "ABC"), ("x", None, base[0]), texts[0]]
    df = rows(spark, texts, "record string, grp string, text string").withColumn("cls", F.lit(1))
    got = {(r.p, r.q) for r in neardup.record_pairs(*neardup.near_duplicates(df)).collect()}
    seen = {r: (g, neardup.normalise(t)) for r, g, t in texts if t is not None and g is not None}
    want = set()
    for a in seen:
        for b in seen:
            if a < b and seen[a][0] != seen[b][0]:
                x, y = neardup.shingles(seen[a][1]), neardup.shingles(seen[b][1])
                if seen[a][1] == seen[b][1] or (x | y and len(x & y) >= 0.7 * len(x | y)):
                    want.add((a, b))
    assert got == want
    signed, links = neardup.near_duplicates(df)
    g = {r.record: r.group_id for r in neardup.groups(signed, links).collect()}
    assert all(g[a] == g[b] for a, b in want) and "n" not in g
    assert neardup.near_duplicates(df.limit(0))[1].count() == 0


# 7


def test_tokenise_is_the_public_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello world's  test\n\n", "<|endoftext|>", "復旧計画を確認した。", "aaaaaaaaaaaaaaab" * 50, "नमस्ते สวัสดี 👩" + SPACES["zwj"] + "🔬", "", None, "x" * 30000]
    df = rows(spark, [(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in tokenise.token_ids(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert all(r.same for r in tokenise.round_trip(df).collect())
    assert tokenise.token_ids(df.limit(0)).count() == 0


# 8


def test_mixing_shares_and_caps(spark):
    rng = random.Random(8)
    docs = [(i, "a" if i % 3 else "b", rng.randint(1, 50), rng.random()) for i in range(3000)] + [(9000 + i, "small", 10, 1.0) for i in range(20)] + [(9999, "small", 10, None)]
    sizes = rows(spark, docs, "doc_id bigint, source string, n_tokens bigint, weight double").withColumn("epochs", F.lit(5)).select("doc_id", "source", "n_tokens", "weight")
    targets = rows(spark, [("m", "a", 0.5, 1), ("m", "b", 0.4, 2), ("m", "small", 0.1, 3), ("z", "none", 1.0, 1), (None, "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    plan = mixing.budgets(sizes, targets)
    out = {(r.mix_name, r.source): r for r in mixing.shares(mixing.draw(sizes, plan), plan).collect()}
    assert out["m", "small"].most_uses == 3 and abs(out["m", "a"].actual_share - 0.5) < 0.02 and abs(out["m", "b"].actual_share - 0.4) < 0.02
    assert out["z", "none"].used_tokens == 0 and all(r.most_uses <= r.max_repeats for r in out.values())
    tight = mixing.budgets(sizes, targets, total_tokens=10**7)
    assert all(r.uses == r.max_repeats for r in mixing.draw(sizes, tight).join(tight.select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).collect())
    assert mixing.draw(sizes.limit(0), mixing.budgets(sizes.limit(0), targets)).count() == 0


def test_mixes_are_drawn_from_the_whole_corpus(spark, tmp_path):
    docs = [(i, "big" if i % 2 else "other", "The archive keeps every inspection report of the quarter. " * 4) for i in range(80)] + [(999, "tiny", "One short note.")]
    rows(spark, docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows(spark, [("m", "big", 0.3, 1), ("m", "other", 0.2, 1), ("m", "tiny", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    mix = queries.p8_mix(spark, str(tmp_path)).groupBy("source").agg(F.count("*").alias("n"), F.max("uses").alias("uses")).collect()
    n = {r.source: r.n for r in mix}
    assert n["big"] in (23, 24, 25) and n["other"] in (15, 16, 17) and n["tiny"] == 1 and {r.uses for r in mix if r.source == "tiny"} == {2}
    out = {r.source: r for r in queries.p8_shares(spark, str(tmp_path)).collect()}
    assert not out["tiny"].reached and out["tiny"].actual_share < 0.05 and out["tiny"].used_tokens == out["tiny"].budget


# 9


def test_sentences_cases():
    cut = lambda t: [t[a:b].strip() for a, b in zip([0, *sentences.unit_ends(t)], sentences.unit_ends(t))]
    assert cut('He met Dr. Lee at 9 p.m. "It works." (See No. 4.) Then 3.5 ended... Next') == ["He met Dr. Lee at 9 p.m.", '"It works."', "(See No. 4.)", "Then 3.5 ended...", "Next"]
    assert cut("「終わった。」次は「未完了。要確認。」と書いた。") == ["「終わった。」", "次は「未完了。要確認。」と書いた。"]
    assert cut("# H\nText one.\ntwo\n\n| a | b |\n```\nx. y.\n\nz\n```\n- item one. item two.") == ["# H", "Text one.", "two", "| a | b |", "```\nx. y.\n\nz\n```", "- item one.", "item two."]
    assert cut("กะกลางคืน ย้ายแล้ว") == ["กะกลางคืน", "ย้ายแล้ว"] and cut("Τι είναι; Ναι.") == ["Τι είναι;", "Ναι."]
    assert sentences.unit_ends(None) == sentences.unit_ends("") == sentences.unit_ends(" \n ") == []


def test_long_texts_by_pieces_equal_the_whole():
    rng = random.Random(9)
    parts = ["One sentence here. Another one!", "```\ncode. more.\n\nx\n```", "- item a\n- item b", "“Quoted. Twice.” said Dr. Who.", "日本語の文。次の文。", "long " * 300 + "end."]
    text = "\n\n".join(rng.choice(parts) for _ in range(3000))
    assert len(text) > 2 * sentences.PIECE and sentences.split_long(text) == sentences.run(text, 0, len(text), sentences.OUT)[1]
    unbroken = "A short sentence of prose. " * 20000
    assert sentences.split_long(unbroken) == sentences.run(unbroken, 0, len(unbroken), sentences.OUT)[1]


def test_sentences_frame(spark):
    df = rows(spark, [(1, "A. B c."), (None, "Only one."), (2, None)], "doc_id bigint, text string").withColumn("sent_end", F.lit(0))
    assert sorted((r.doc_id or 0, r.sent_no, r.sentence) for r in sentences.sentences(df).collect()) == [(0, 0, "Only one."), (1, 0, "A. B c.")]
    assert sentences.sentences(df.limit(0)).count() == 0
