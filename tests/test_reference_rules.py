"""Rules of the archive at their edges: text, Markdown, cursors, ledger, history, stores, adapters."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from corvida.adapters import mock, units
from corvida.functions import markdown, text
from corvida.operators import chunking, cursors, history, ledger, lifecycle, search
from corvida.sources import files, pdf
from corvida.streaming import metrics


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slugs_keep_underscores_and_compose(spark):
    assert column(spark, ["API_Token  v2", "e" + chr(0x301) + "tat - Résumé", "認証 仕様・案", "--", "", None], text.slug) == ["api_token-v2", "tat-rsum", "認証-仕様・案", "", "", None]


def test_secret_tiers_and_media_types(spark):
    names = ["a/.env.production", "id_rsa.pub", ".ssh/known_hosts", "x/.ssh/known", "/.AWS/config", "state.tfstate.backup", ".pypirc", "my-Credentials.txt", "credential.txt", "notes.md", None]
    assert column(spark, names, text.secret_tier) == ["A", "A", "A", None, "A", "A", "A", "B", None, None, None]
    assert column(spark, ["A.MARKDOWN", "m.rs", "p.webp", "p.html", ".md", "noext"], text.media_type) == ["text/markdown", "text/x-code", "image/webp", "application/octet-stream", "application/octet-stream", "application/octet-stream"]
    assert column(spark, ["a/b-c_dE2F.tar.gz", "---.md", ".hidden"], text.filename_context) == ["b c d E2 F.tar", None, ".hidden"]


def test_detectors(spark):
    assert column(spark, ["a < b > c", "<div>", "</p", "see <https://x.y>", "<a@b>", "<a @b>", "x <\n>", None], text.has_raw_html) == [False, True, False, True, True, True, False, None]
    assert column(spark, ["ok", "", "  ", "\x01" * 9, "a\x7f\x80\x81", "line\n" + chr(0x85) + "x"], text.is_real_text) == [True, False, False, False, False, True]
    assert column(spark, ["007", "000", "12"], lambda c: text.unit_key(F.lit("page"), c)) == ["page:7", "page:1", "page:12"]
    assert column(spark, ["A#2", "e" + chr(0x301)], lambda c: text.unit_key(F.lit("sheet"), c)) == ["sheet:A##2", "sheet:é"]
    assert column(spark, ["99999999999999999999s", "3w", "1m", "-1s", ""], text.duration_seconds) == [None, 1814400, 60, None, None]
    assert column(spark, ["CON.txt", "a.", "a:b", "", "x" * 256, "ok.md"], text.portable_leaf_error) == ["reserved_name", "trailing_dot_or_space", "forbidden_character", "empty", "too_long", None]


def test_markdown_forms(spark):
    assert column(spark, ["期限 7\\/10", "&lt;div&gt;", "&amp;amp\\;", "`a\\*` \\*", "```\n\\*\n```", "Q&A", None], markdown.resolved) == ["期限 7/10", "<div>", "&amp;", "`a\\*` *", "```\n\\*\n```", "Q&A", None]
    assert markdown.normal_form(chr(0xFEFF) + "T\r\n===\r\na  \n\n\n") == "# T\na\n"
    assert [markdown.form_error(t) for t in ("a\n", "a", "a \n", "~~~\n", "a\n--\n", "<b>\n", "```\n<b>\n```\n")] == [None, "final_newline", "trailing_blank", "tilde_fence", "underlined_heading", "raw_html", None]
    assert markdown.split_spans("aaa\n\nbbb\n\n\nccc", 0, 14, 9) == [(0, 5), (5, 14)]
    assert markdown.split_spans("x" * 10, 0, 10, 4) == [(0, 4), (4, 8), (8, 10)] and markdown.split_spans("\n\n", 0, 2, 9) == []
    with pytest.raises(ValueError):
        markdown.split_spans("a", 0, 1, 0)
    assert markdown.grid_to_markdown([["Title"], [], ["a", "", "b"], ["1", "", "x|y"], [], ["end"]]) == "Title\n\n| a | b |\n| --- | --- |\n| 1 | x\\|y |\n\nend"
    assert markdown.html_to_markdown("<table border=1><tr><td>a</td><td>b|c</td></tr></table>") == "| | |\n| --- | --- |\n| a | b\\|c |"
    assert markdown.html_to_markdown("<table><tr><th>a</th></tr></table>").startswith("<table>") and markdown.html_to_markdown('<div><img src="p.png" width=3></div>') == "![](p.png)"
    esc = column(spark, ["a<b & *c*\r\nd\x00"], markdown.source_escape)
    assert esc == ["a&lt;b &amp; \\*c\\*\nd"]


def test_chunks_of_a_document(spark):
    d = spark.createDataFrame([(1, "intro é\n\n# A\nx\n\ny\n# A\nz"), (2, "\n\n\n"), (3, None), (4, "# B\n")], "doc_id bigint, text string")
    rows = [(r.doc_id, r.section_id, r.text, r.byte_end - r.byte_start) for r in chunking.chunks(d, 6).orderBy("doc_id", "byte_start").collect()]
    assert rows == [(1, None, "intro ", 6), (1, None, "é\n\n", 4), (1, "a", "# A\nx\n", 6), (1, "a", "y\n", 2), (1, "a#2", "# A\nz", 5), (4, "b", "# B\n", 4)]


def test_cursors_and_selectors():
    token = cursors.encode_cursor({"b": 1, "a": "é"}, b"key")
    assert cursors.decode_cursor(token, b"key") == {"a": "é", "b": 1}
    for bad in (token[:-1] + ("A" if token[-1] != "A" else "B"), token.split(".")[0], "x." + token.split(".")[1], ""):
        with pytest.raises(ValueError):
            cursors.decode_cursor(bad, b"key")
    with pytest.raises(ValueError):
        cursors.decode_cursor(token, b"other")
    assert cursors.selector()[0] == "current" and cursors.selector(all_history=True, since="60s")[0] == "since"
    for bad in ({"at": "x", "all_history": True}, {"since": "60s"}, {"include_deleted": True, "all_history": True}, {"at": "a\x00"}):
        with pytest.raises(ValueError):
            cursors.selector(**bad)


def test_query_plans_and_modes():
    assert search.query_plan("スコープが 3600") == (["スコープが", "スコープ", "3600", "3,600"], [])
    assert search.query_plan("計画 3") == ([], [["計画", "plan"], ["3"]])
    assert search.query_plan("C++ read/write")[0] == ["C++", "read/write", "read", "write"]
    with pytest.raises(ValueError):
        search.query_plan(" 　")
    assert search.search_mode("auto") == ("hybrid", None) and search.search_mode("text") == ("text", None)
    assert search.search_mode("auto", offline=True, online_adapter=True, same_profile=False) == ("text", "offline")
    assert search.search_mode("auto", same_profile=False, vectors=False) == ("text", "vector_incompatible")
    assert search.search_mode("auto", vectors=False, text=False) == (None, "vector_unavailable")


def test_ledger_rules(spark):
    c = spark.createDataFrame([(1, "2025-01", "s", "a", 0), (2, "2025-01", "s", "a", 5), (3, "2025-01", "t", "a", 4), (4, "2025-02", "s", "b", 9)], "id int, month string, scope_id string, adapter_kind string, cents bigint")
    t = spark.createDataFrame([("2025-01", "device", "", 95), ("2025-01", "folder", "t", 6)], "month string, layer string, key string, spent bigint")
    got = {r.id: r.verdict for r in ledger.cap_check(c, t, {"device": 100, "folder": 10, "per_adapter": None}).collect()}
    assert got == {1: "exempt", 2: "denied_device", 3: "denied_folder", 4: "allowed"}
    s = spark.createDataFrame([(0, 0, False), (1, 0, False), (1, 1, False), (0, 2, False), (3, 0, True)], "d int, f int, p boolean")
    assert [r.x for r in s.select(ledger.task_state(F.col("d"), F.col("f"), F.col("p")).alias("x")).collect()] == ["pending", "done", "partial", "failed", "failed"]
    assert [ledger.sweep_capacity(*a) for a in ((5, 100, 20, 8), (100, 5, 20, 8), (100, 100, 20, 8), (0, 3, 20, 8))] == [(5, 15), (15, 5), (8, 12), (0, 3)]
    b = spark.createDataFrame([(1, "pages", 2.0, 9), (1, "tokens_in", 10.0, 9), (2, "pages", 2.0, 7), (2, "pages", 1.0, 7), (3, "pages", 1.5, 5), (4, None, None, 3), (5, "odd", 1.0, 2)], "id int, kind string, count double, estimate bigint")
    assert {r.id: (r.billed, r.estimated) for r in ledger.billed(b, {"pages": 20, "tokens_in": 1}).collect()} == {1: (50, False), 2: (7, True), 3: (5, True), 4: (3, True), 5: (2, True)}
    e = spark.createDataFrame([("q", 1, None), ("q", 2, 1.0)], "g string, i int, v double")
    assert [(r.g, r.p50, r.least) for r in ledger.nearest_rank(e, ["g"], "v", [50]).collect()] == [("q", 1.0, 1.0)] and ledger.nearest_rank(e.limit(0), ["g"], "v", [50]).count() == 0


def test_retention_keeps_tips_and_protected(spark):
    now = dt.datetime(2025, 6, 1)
    at = lambda **k: now - dt.timedelta(**k)
    rows = [("a", "auto", at(hours=2)), ("b", "auto", at(days=2, hours=1)), ("c", "auto", at(days=2, minutes=70)), ("d", "auto", at(days=300)), ("tip", "auto", at(days=300)), ("m", "manual", at(days=900))]
    rows += [(f"r{i}", "repaired", at(days=i)) for i in range(7)]
    c = spark.createDataFrame([(h, "s", k, t) for h, k, t in rows], "commit_hash string, scope_id string, commit_type string, created_at timestamp_ntz")
    kept = {r.commit_hash for r in ledger.retention(c, spark.createDataFrame([("tip",)], "commit_hash string"), F.lit("2025-06-01 00:00:00").cast("timestamp")).where("kept").collect()}
    assert {"a", "tip", "m", "r0", "r4"} <= kept and not {"d", "r5", "r6"} & kept and len({"b", "c"} & kept) >= 1


def test_history_cycles_and_chains(spark):
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "commit_hash string, parents array<string>")
    with pytest.raises(ValueError):
        history.walk(loop.select("commit_hash"), history.edges(loop)).collect()
    # a cycle over a second parent is passed over by walks and found by the check
    side = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b", "d"]), ("d", ["a", "c"])], "commit_hash string, parents array<string>")
    e = history.edges(side)
    assert {r.commit for r in history.closure(spark.createDataFrame([("c",)], "commit_hash string"), e).collect()} == {"a", "b", "c", "d"}
    placed, every = history.layers(e, side)
    assert placed < every == 4
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("b", "b"), ("x", "c")], "ancestor string, descendant string")
    assert {(r.ancestor, r.descendant): r.is_ancestor for r in history.is_ancestor(pairs, e).collect()} == {("a", "c"): True, ("c", "a"): False, ("b", "b"): True, ("x", "c"): False}
    none = side.limit(0)
    assert history.closure(none.select("commit_hash"), history.edges(none)).count() == 0


def test_deleted_bindings_fall_back_to_normalised_bytes(spark):
    c = spark.createDataFrame([("1", "s", []), ("2", "s", ["1"]), ("3", "s", ["2"])], "commit_hash string, scope_id string, parents array<string>")
    b = spark.createDataFrame([("1", "p", "x", "T", 0), ("2", "p", "x", None, 0), ("2", "q", "y", None, 0), ("3", "r", "z", "T", 1), ("1", "o", "z", "T", 1)], "commit_hash string, path string, raw_hash string, tool_profile_hash string, gen int")
    head = spark.createDataFrame([("3",)], "commit_hash string")
    got = {(r.path, r.commit_hash, r.is_live) for r in history.plan(b, c, "include_deleted", head).collect()}
    assert got == {("r", "3", True), ("p", "1", False)}
    with pytest.raises(ValueError):
        history.plan(b, c, "sometime", head)


def test_stores(spark):
    ev = spark.createDataFrame([("a", "tombstone", 1, "purged", 1, "x"), ("a", "tombstone", 2, "retired", 2, None), ("b", "receipt", 1, "purged", 1, "x"), ("c", "tombstone", 1, "purged", 3, ""), ("d", "tombstone", 1, "purged", 3, "x"), ("d", "tombstone", 2, "retired", 2, None)], "raw_hash string, marker string, n int, kind string, at int, reason string")
    assert {(r.raw_hash, r.error) for r in lifecycle.event_errors(ev).collect()} == {("b", "not_alternating"), ("c", "no_reason"), ("d", "time_goes_back")}
    s = spark.createDataFrame([("h1", "t1", "p", [1.0]), ("h2", "t2", "p", [2.0])], "embedding_hash string, text_hash string, profile_hash string, vector array<double>")
    new = spark.createDataFrame([("h3", "t1", "q", [3.0])], s.schema)
    kept, fell = search.write_vectors(s, new)
    assert {r.embedding_hash for r in kept.collect()} == {"h2", "h3"} and [r.text_hash for r in fell.collect()] == ["t1"]
    with pytest.raises(ValueError):
        search.write_vectors(s, spark.createDataFrame([("h1", "t1", "p", [9.0])], s.schema))


def test_knn_in_blocks_equals_broadcast(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("item"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    q = rows.where("item % 5 = 0").select(F.col("item").alias("query_id"), F.col("v").alias("q"))
    one = {tuple(r) for r in search.knn(rows, q, 3).collect()}
    monkeypatch.setattr(search, "MOST_QUERIES", 5)
    assert {tuple(r) for r in search.knn(rows, q, 3).collect()} == one and len(one) == 36
    assert search.knn(rows, q.limit(0), 3).count() == 0


def test_reranking(spark):
    r = spark.createDataFrame([("q", f"c{i}", i) for i in range(1, 6)], "query_id string, item string, rank int")
    s = spark.createDataFrame([("q", "c3", 0.5), ("q", "c1", 0.1), ("q", "c2", 0.5)], "query_id string, item string, score double")
    assert [x.item for x in search.rerank(r, s, 2, 3).orderBy("rank").collect()] == ["c2", "c3", "c1", "c4", "c5"]
    with pytest.raises(ValueError):
        search.rerank(r, s.union(s), 2, 3)
    with pytest.raises(ValueError):
        search.rerank(r, s, 2, 1)


def test_adapters_and_pdf(spark, tmp_path):
    v = mock.seeded_vector("abc", 20)
    assert len(v) == 20 and abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-5 and 0 <= mock.fnv_score("q", "t") < 1
    back = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(mock.vector_of(mock.vector_bytes(F.col("v"))).alias("v")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], None]
    body = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld) -300 (next)] TJ ET"
    packed = zlib.compress(body)
    doc = b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n4 0 obj<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj" % (len(packed), packed)
    assert pdf.pages_of(doc) == ["Hello (PDF)\nworld next"]
    f = spark.createDataFrame([("a.pdf", bytearray(doc)), ("b.pdf", bytearray(b"no")), ("c.md", bytearray(b"# x\n"))], "name string, content binary")
    f.createOrReplaceTempView("test_files")
    units.register(spark)
    got = {(r.name, r.unit_key, r.error) for r in spark.sql("SELECT f.name, u.* FROM test_files f, LATERAL prepare(f.name, f.content) u").collect()}
    assert got == {("a.pdf", "page:1", None), ("b.pdf", None, "ValueError"), ("c.md", "doc:1", None)}
    assert files.format_cell("0.256", "0.0%") == "25.6%" and files.format_cell("45672", "yyyy-mm-dd") == "2025-01-15" and files.format_cell("60", "m/d/yy") == "60" and files.format_cell("2.5", '"Q"0') == "2"


def test_restore_is_all_or_nothing(spark, tmp_path):
    f = lambda *names: spark.createDataFrame([(n, bytearray(b"1")) for n in names], "name string, content binary")
    out = str(tmp_path / "out")
    assert files.restore(f("a.md", "b.md"), out) == 2 and {p.name for p in (tmp_path / "out").iterdir()} == {"a.md", "b.md"}
    for bad in (("c.md", "C.md"), ("d.md", "a.md"), ("x/y.md",), ("CON",)):
        with pytest.raises(FileExistsError):
            files.restore(f(*bad), out)
    assert {p.name for p in tmp_path.iterdir()} == {"out"}


def test_streams_lose_nothing(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    os.makedirs(folder)
    for i, day in enumerate((3, 1, 2)):  # the later files are days behind the first
        spark.createDataFrame([(j % 2, dt.datetime(2025, 1, day, j % 24), "x", 1.0) for j in range(30)], "k int, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(folder / f"p{i}"))
    s = spark.readStream.schema("k int, ts timestamp_ntz, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    assert metrics.hourly_complete(s).agg(F.sum("n")).first()[0] == 90
    assert sorted(r.k for r in metrics.settle_once(s.select("k"), ["k"]).collect()) == [0, 1]
