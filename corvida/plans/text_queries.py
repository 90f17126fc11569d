"""Queries on ids, text functions, vectors and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.functions import ids, markdown, text, vectors
from corvida.operators import chunking, ledger
from corvida.session import load


def ids_sha256(spark, d):
    t = ids.sha256_id(F.col("text"))
    return load(spark, d, "documents").select("doc_id", t.alias("raw_hash"), ids.is_sha256_id(t).alias("valid"), ids.fan_out_path(t).alias("path"), ids.short_id(t).alias("short"))


def chunk_identity(spark, d):
    c = load(spark, d, "chunks").dropDuplicates(["chunk_hash"])
    cols = [F.col(x) for x in ("raw_hash", "tool_profile_hash", "gen", "unit_key", "heading_path", "section_id", "byte_start", "byte_end")]
    return c.select("chunk_hash", ids.chunk_id(*cols).alias("identity"), ids.unit_ref(F.col("unit_key")).alias("unit_ref"), ids.idempotency_key(F.col("raw_hash"), F.col("tool_profile_hash")).alias("task_key"))


def config_ids(spark, d):
    return load(spark, d, "chunking_configs").select("strategy", "max_chars", ids.chunking_config_id(F.col("strategy"), F.col("max_chars")).alias("config_id"))


def chunk_set_digest(spark, d):
    return load(spark, d, "chunks").groupBy("scope_id", "raw_hash").agg(ids.set_digest(F.collect_set("chunk_hash")).alias("digest"))


def verify_text_hash(spark, d):
    c = load(spark, d, "chunks").dropDuplicates(["chunk_hash"]).where("text is not null")
    state = F.when(F.col("text_hash").isNull(), "missing").when(F.col("text_hash") == ids.sha256_id(F.col("text")), "intact").otherwise("corrupt")
    return c.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def slugify(spark, d):
    return load(spark, d, "xlsx_sheets").select("sheet_id", text.slug(F.col("sheet_name")).alias("slug")).distinct()


def section_ids(spark, d):
    return load(spark, d, "chunks").dropDuplicates(["chunk_hash"]).select("chunk_hash", text.section_id(F.col("heading_path")).alias("section"))


def media_types(spark, d):
    n = F.col("file_name")
    return load(spark, d, "page_images").dropDuplicates(["image_hash"]).select("image_hash", text.media_type(n).alias("media_type"), text.filename_context(n).alias("context"))


def filename_contexts(spark, d):
    return load(spark, d, "chunks").select("raw_path").distinct().select("raw_path", text.filename_context(F.col("raw_path")).alias("context"), text.media_type(F.col("raw_path")).alias("media_type"))


# endings and folders that the paths of documents are given in turn, so that every rule meets real names
_DRESS = ["", ".env", "/.env.production", "/id_rsa.pub", "/id_ecdsa", ".pem", ".tfstate.backup", "/.pypirc", ".keystore", "/credentials.csv", "-Token.md", "/secrets/readme.md"]


def _dressed(spark, d):
    parts = F.array(*[F.lit(x) for x in _DRESS])
    x = load(spark, d, "documents").where("raw_path is not null").select("doc_id", "raw_path", F.coalesce("n_chars", F.lit(0)).alias("size"))
    front = F.when(F.col("doc_id") % 7 == 3, ".ssh/").when(F.col("doc_id") % 7 == 5, "/.AWS/").otherwise("")
    return x.select("doc_id", "size", F.concat(front, "raw_path", F.element_at(parts, (F.col("doc_id") % len(_DRESS) + 1).cast("int"))).alias("path"))


def secret_tiers(spark, d):
    return _dressed(spark, d).select("doc_id", text.secret_tier(F.col("path")).alias("tier"))


def quarantine(spark, d):
    r = _dressed(spark, d).select("doc_id", text.quarantine_reason(F.col("path"), F.col("size"), 4000).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def portable_names(spark, d):
    n = load(spark, d, "xlsx_sheets").select("sheet_id", F.concat("sheet_name", F.element_at(F.array(*[F.lit(x) for x in ("", ".", ":1", "?.md")]), (F.pmod(F.length("sheet_name"), F.lit(4)) + 1).cast("int"))).alias("name")).distinct()
    return n.select("sheet_id", "name", text.portable_leaf_error(F.col("name")).alias("error"), text.logical_path_ok(F.col("name")).alias("logical"), text.tag_leaf(F.col("name")).alias("leaf"))


def name_collisions(spark, d):
    s = load(spark, d, "xlsx_sheets").select("raw_hash", "sheet_id", text.collision_key(F.col("sheet_name")).alias("key")).distinct()
    return s.groupBy("raw_hash", "key").agg(F.count("*").alias("n")).where("n > 1")


def sheet_keys(spark, d):
    """Unit keys of each workbook's sheets: '#' doubled, then the second and further ones of a name numbered."""
    s = load(spark, d, "xlsx_sheets").dropDuplicates(["sheet_id"]).select("raw_hash", "sheet_id", "sheet_index", text.unit_key(F.lit("sheet"), F.col("sheet_name")).alias("base"))
    n = F.row_number().over(Window.partitionBy("raw_hash", "base").orderBy("sheet_index", "sheet_id"))
    return s.withColumn("n", n).select("sheet_id", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")).alias("unit_key"))


def search_units(spark, d):
    return load(spark, d, "xlsx_sheets").select("sheet_name").distinct().select("sheet_name", F.array_join(text.query_units(F.col("sheet_name")), "|").alias("units"))


def scope_selection(spark, d):
    """Documents below one folder, at its path border."""
    x = load(spark, d, "documents").where("raw_path is not null").select("doc_id", F.regexp_extract("raw_path", "^(.*)/", 1).alias("root"))
    first = x.agg(F.min("root")).first()[0] or ""
    return x.select("doc_id", text.in_scope(F.col("root"), first, True).alias("below"), text.in_scope(F.col("root"), first).alias("itself"))


def embedding_inputs(spark, d):
    c = load(spark, d, "chunks").where("text is not null").dropDuplicates(["chunk_hash"])
    return c.select("chunk_hash", ids.sha256_id(text.embedding_input(text.filename_context(F.col("raw_path")), F.col("text"))).alias("input_hash"))


def unit_fingerprints(spark, d):
    p = load(spark, d, "page_images").where("visible_text is not null").dropDuplicates(["image_hash"])
    return p.select("image_hash", ids.sha256_id(F.col("visible_text")).alias("text_hash"), ids.sha256_id(F.col("image_hash")).alias("visual_hash"))


def source_escapes(spark, d):
    x = load(spark, d, "documents").where("text is not null").select("doc_id", markdown.source_escape(F.col("text")).alias("escaped"))
    return x.select("doc_id", ids.sha256_id(F.col("escaped")).alias("hash"), F.char_length("escaped").alias("size"))


def escape_round_trip(spark, d):
    """Escaped text read back by the index is the text itself, where it holds no control characters and no code."""
    x = load(spark, d, "documents").where("text is not null and not text rlike '[`~]'")
    back = markdown.resolved(markdown.source_escape(F.col("text")))
    want = text.nfc(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}]", ""))
    return x.select("doc_id", (back == want).alias("same"))


def indexed_texts(spark, d):
    x = load(spark, d, "documents").where("text is not null and not text rlike '[`~\\\\\\\\&]'")
    return x.select("doc_id", ids.sha256_id(markdown.indexed_text(F.col("text"))).alias("hash"))


def stored_form(spark, d):
    """Texts brought to the stored form keep none of its faults that normalising mends."""
    x = load(spark, d, "documents").where("text is not null").select("doc_id", markdown.normalised(F.col("text")).alias("t"))
    e = markdown.form_errors(F.col("t"))
    return x.select("doc_id", F.coalesce(e.isin("byte_order_mark", "carriage_return", "not_nfc", "final_newline", "trailing_blank"), F.lit(False)).alias("bad"))


def form_check(spark, d):
    x = load(spark, d, "documents").where("text is not null and not text rlike '(```|~~~)'")
    return x.select("doc_id", F.coalesce(markdown.form_errors(F.col("text")).isin("byte_order_mark", "carriage_return", "not_nfc", "final_newline", "trailing_blank"), F.lit(False)).alias("surface"))


def heading_chunks(spark, d):
    """Chunks of every document: sections cut at max_chars, blank ones dropped."""
    return chunking.chunks(load(spark, d, "documents").select("doc_id", "text"), 400).select("doc_id", "section_id", "byte_start", "byte_end", "text_hash")


def section_reassembly(spark, d):
    """Sections of up to 100,000 characters are one chunk each, white space aside: bytes as the sections say."""
    c = chunking.chunks(load(spark, d, "documents").select("doc_id", "text"), 10_000_000)
    return c.where("section_id is not null").select("doc_id", "byte_start", "byte_end")


def sheet_views(spark, d):
    """The full view of each workbook from its sheets and where each lies in it."""
    s = load(spark, d, "xlsx_sheets").where("markdown is not null").dropDuplicates(["sheet_id"])
    v = markdown.assemble_view(s, "raw_hash", "sheet_index", "sheet_id", "markdown")
    return v.select("sheet_id", "byte_start", "byte_end", ids.sha256_id(F.col("view")).alias("view_hash"))


def read_tables(spark, d):
    """HTML tables made of the sheets' rows come back as pipe tables with the same cells."""
    s = load(spark, d, "xlsx_sheets").where("markdown is not null").dropDuplicates(["sheet_id"])
    rows = F.filter(F.split("markdown", "\n"), lambda r: r.startswith("|") & ~r.contains("---"))
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr><td>"), F.array_join(F.split(F.regexp_replace(r, r"^\| | \|$", ""), r" \| "), "</td><td>"), F.lit("</td></tr>")))
    html = F.concat(F.lit("<table border=1>"), F.array_join(cells, ""), F.lit("</table>"))
    return s.select("sheet_id", markdown.without_html(html).alias("table"))


def grid_tables(spark, d):
    """Grids of the sheets' cells back to Markdown."""
    s = load(spark, d, "xlsx_sheets").where("markdown is not null").dropDuplicates(["sheet_id"])
    rows = F.filter(F.split("markdown", "\n"), lambda r: r.startswith("|") & ~r.contains("---"))
    grid = F.transform(rows, lambda r: F.split(F.regexp_replace(r, r"^\| | \|$", ""), r" \| "))
    return s.select("sheet_id", markdown.grid_markdown(grid).alias("table"), F.col("markdown").alias("given"))


def prompt_hashes(spark, d):
    x = load(spark, d, "documents").where("text is not null")
    return x.select("doc_id", ids.sha256_id(text.prompt_template(F.col("text"))).alias("template_hash"))


def profile_ids(spark, d):
    from corvida.adapters.mock import profile_id

    e = load(spark, d, "chunk_embeddings").select("dimensions", "distance", "modality", "profile_hash").distinct()
    pin = F.concat(F.lit("v"), F.col("dimensions").cast("string"), F.when(F.col("distance") == "l2", "-latest").otherwise(".1"))
    return e.select("profile_hash", profile_id(adapter_kind=F.lit("embedding"), model_version_pin=pin, dimensions=F.col("dimensions").cast("bigint"), distance=F.col("distance"), modality=F.col("modality"), endpoint=F.lit("never kept")).alias("id"), text.mutable_alias(pin).alias("mutable"))


def read_quality(spark, d):
    """Edit distance, error rate and token recall of each page text against its redelivered or normalised form."""
    p = load(spark, d, "page_images").where("visible_text is not null").dropDuplicates(["image_hash"]).select("image_hash", F.substring("visible_text", 1, 200).alias("truth"))
    x = p.withColumn("read", F.lower(F.regexp_replace("truth", "[0-9]", "")))
    e = ledger.error_rate(x, "truth", "read")
    return e.select("image_hash", "distance", F.round("cer", 9).alias("cer"), F.round(ledger.token_recall(F.col("truth"), F.col("read")), 9).alias("recall"))


def window_distance(spark, d):
    s = load(spark, d, "xlsx_sheets").select("sheet_id", "sheet_name").distinct()
    return s.select("sheet_id", "sheet_name", ledger.best_window_distance(F.col("sheet_name"), F.substring("sheet_name", 2, 3)).alias("inside"), ledger.best_window_distance(F.col("sheet_name"), F.lit("plan")).alias("away"))


def glob_ignore(spark, d):
    rules = ["**/*-a*.md", "Br*.md", "!Bra?*-*.md"]
    return load(spark, d, "documents").where("raw_path is not null").select("doc_id", text.ignored(F.col("raw_path"), rules).alias("ignored"))


def script_segments(spark, d):
    return load(spark, d, "xlsx_sheets").select("sheet_name").distinct().select("sheet_name", F.array_join(text.script_segments(F.col("sheet_name")), "|").alias("segments"))


def numeric_equivalents(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").cast("string").alias("n"))
    return o.select("o_orderkey", F.array_join(text.numeric_equivalents(F.col("n")), "|").alias("forms"))


def unit_keys(spark, d):
    c = load(spark, d, "chunks").select("unit_key").distinct()
    kind, value = F.substring_index("unit_key", ":", 1), F.concat(F.lit("00"), F.substring_index("unit_key", ":", -1))
    return c.select("unit_key", text.unit_key(kind, value).alias("again"))


def image_refs(spark, d):
    """Image objects shown by the Markdown of each object's pages, each page twice, next to targets that are none."""
    p = load(spark, d, "page_images").select("scope_id", "raw_hash", "image_hash", "page_no", "file_name").distinct()
    shown = F.concat(F.lit("!["), "file_name", F.lit("](ev://"), "scope_id", F.lit("/object/image/"), "image_hash", F.lit(") ![x]("), "file_name", F.lit(")"))
    m = p.groupBy("raw_hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "image_hash", shown.alias("s")))), lambda x: F.concat(x["s"], F.lit("\n"), x["s"])), "\n").alias("md"))
    each = m.select("raw_hash", F.posexplode(text.image_references(F.col("md"))).alias("pos", "target"))
    u = text.object_uri(F.col("target"))
    return each.select("raw_hash", "pos", "target", u["hash"].alias("hash"), u["scope_id"].alias("scope"))


def html_detect(spark, d):
    return load(spark, d, "documents").where("text is not null").groupBy(text.has_raw_html(F.col("text")).alias("html"), text.is_real_text(F.col("text")).alias("real_text")).agg(F.count("*").alias("n"))


def code_fences(spark, d):
    return load(spark, d, "documents").where("text is not null").groupBy(text.fence_for(F.col("text")).alias("fence")).agg(F.count("*").alias("n"))


def excel_dates(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", text.excel_date((F.col("p_partkey") * 17 % 60000).cast("int")).alias("day"), text.column_number(F.substring("p_name", 1, 2)).alias("col_no"))


def durations(spark, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("s", "m", "h", "d", "w", "x")]), (F.col("event_id") % 6 + 1).cast("int"))
    e = load(spark, d, "events").select(F.concat((F.col("event_id") % 50).cast("string"), unit).alias("t")).distinct()
    return e.select("t", text.duration_seconds(F.col("t")).alias("seconds"))


def since_cutoffs(spark, d):
    """The moment a duration before each event; some durations are none, some reach beyond the calendar."""
    unit = F.element_at(F.array(*[F.lit(x) for x in ("s", "m", "h", "d", "w", "x")]), (F.col("event_id") % 6 + 1).cast("int"))
    n = F.when(F.col("event_id") % 11 == 0, "99999999").otherwise((F.col("event_id") % 50).cast("string"))
    e = load(spark, d, "events").select("event_id", text.since_cutoff(F.date_trunc("second", "ts").cast("timestamp"), F.concat(n, unit)).alias("t"))
    return e.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


def utc_validity(spark, d):
    e = load(spark, d, "events").select(F.concat(F.lit("2024-"), F.lpad((F.col("event_id") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0"), F.lit("T10:00:00Z")).alias("t")).distinct()
    return e.select("t", text.is_utc_timestamp(F.col("t")).alias("valid"))


def vector_validity(spark, d):
    v = load(spark, d, "chunk_embeddings").select("vec_rowid", "vector", "dimensions").dropDuplicates(["vec_rowid"])
    return v.select("vec_rowid", vectors.is_usable(F.col("vector"), F.col("dimensions")).alias("usable"))


def truncate_renorm(spark, d):
    t = vectors.truncate_renormalise(F.col("embedding"), 16)
    return load(spark, d, "embeddings").select("vec_id", F.round(t[0], 6).alias("first"), F.round(vectors.norm(t), 6).alias("length"))


def profile_compat_gate(spark, d):
    v = load(spark, d, "chunk_embeddings")
    return v.groupBy("profile_hash").agg(F.count_distinct("dimensions", "distance", "modality").alias("kinds"), (F.count_distinct("dimensions", "distance", "modality") == 1).alias("compatible"))


def chunk_headings(spark, d):
    return chunking.sections(load(spark, d, "documents").select("doc_id", "text"))


def chunk_section_ids(spark, d):
    return chunking.numbered_sections(load(spark, d, "documents").select("doc_id", "text"))


_LINES = """
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
marked AS (
  SELECT *, regexp_matches(ltrim(line), '^(```|~~~)') AS mark,
    coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM lines),
toggled AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY n) AS marks FROM marked),
heads AS (
  SELECT doc_id, byte_start, length(regexp_extract(line, '^(#{1,6})[ \\t]+(.*?)[ \\t]*#*[ \\t\\r]*$', 1)) AS level,
    trim(regexp_extract(line, '^(#{1,6})[ \\t]+(.*?)[ \\t]*#*[ \\t\\r]*$', 2)) AS title, text FROM toggled
  WHERE NOT mark AND marks % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \\t]+')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY byte_start) AS k FROM heads WHERE title <> ''),
walk AS (
  SELECT doc_id, k, byte_start, level, title, text, [title] AS path FROM numbered WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, n.byte_start, n.level, n.title, n.text, list_concat(w.path[1:n.level - 1], [n.title]) FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.k = w.k + 1)
"""


def _slug(x: str, composed: bool = True) -> str:
    low = f"translate({'nfc_normalize(' + x + ')' if composed else x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_replace(regexp_replace(regexp_replace({low}, '[^{text.SLUG_KEEPS}{text.WHITE}-]', '', 'g'), '[{text.WHITE}-]+', '-', 'g'), '^-|-$', '', 'g')"


_EXT = "lower(regexp_extract({0}, '[^/]\\.([^./]+)$', 1))"
_MEDIA = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{m}'" for e, m in text.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"
_STEM = "regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"
_FLAT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STEM}, '[-_]', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[{text.WHITE.replace('{', '{{').replace('}', '}}')}]+', ' ', 'g'), '^ | $', '', 'g')"
_CONTEXT = "CASE WHEN regexp_matches({0}, '[\\p{{L}}\\p{{N}}]') THEN {0} END"
_TRIM = f"regexp_replace(text, '^[{text.WHITE}]+|[{text.WHITE}]+$', '', 'g')"
_DRESSED = f"""dressed AS (SELECT doc_id, coalesce(n_chars, 0) AS size, CASE doc_id % 7 WHEN 3 THEN '.ssh/' WHEN 5 THEN '/.AWS/' ELSE '' END || raw_path || [{', '.join(f"'{x}'" for x in _DRESS)}][doc_id % {len(_DRESS)} + 1] AS path FROM documents WHERE raw_path IS NOT NULL),
  low AS (SELECT *, lower(ltrim(path, '/')) AS l, regexp_replace(lower(ltrim(path, '/')), '^.*/', '') AS name FROM dressed),
  tiers AS (SELECT *, CASE WHEN l IN ('.kube/config', '.docker/config.json') OR regexp_matches(l, '^\\.(ssh|gnupg|aws|kube|docker)/') OR regexp_matches(name, '^(\\.env|\\.ssh|\\.gnupg|\\.aws|\\.kube|\\.docker|\\.netrc|\\.npmrc|\\.pypirc)$')
      OR regexp_matches(name, '^(\\.env\\.|id_rsa|id_ecdsa|id_ed25519)') OR regexp_matches(name, '\\.(pem|key|p12|pfx|keystore|tfstate)$') OR contains(name, '.tfstate.') THEN 'A'
    WHEN regexp_matches(name, 'credentials|secret|token|apikey|password') THEN 'B' END AS tier FROM low)"""
_CLEAN = "regexp_replace(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')), '[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g')"
_ESCAPED = "replace(replace(replace(regexp_replace(" + _CLEAN + ", '([!-%''-/:;=?@\\[-`{-~])', '\\\\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_GRID = "list_filter(string_split(markdown, chr(10)), lambda r: starts_with(r, '|') AND NOT contains(r, '---'))"

SQL = {
    "ids_sha256": "SELECT doc_id, 'sha256:' || sha256(text) AS raw_hash, text IS NOT NULL AS valid, sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) AS path, sha256(text)[1:12] AS short FROM documents",
    "config_ids": """SELECT strategy, max_chars, 'sha256:' || sha256('{"max_chars":' || max_chars || ',"spec_version":1,"strategy":"' || strategy || '"}') AS config_id FROM chunking_configs""",
    "chunk_identity": """
        SELECT chunk_hash, 'sha256:' || sha256('{"byte_end":' || byte_end || ',"byte_start":' || byte_start || ',"gen":' || gen || ',"heading_path":' || to_json(heading_path) || ',"raw_hash":"' || raw_hash || '"'
          || CASE WHEN section_id IS NULL THEN '' ELSE ',"section_id":' || to_json(section_id) END || ',"spec_version":1,"tool_profile_hash":"' || tool_profile_hash || '","unit_key":"' || unit_key || '"}') AS identity,
          sha256(unit_key)[1:16] AS unit_ref, 'sha256:' || sha256(raw_hash || chr(0) || tool_profile_hash) AS task_key
        FROM (SELECT DISTINCT ON (chunk_hash) * FROM chunks)""",
    "chunk_set_digest": "SELECT scope_id, raw_hash, 'sha256:' || sha256(array_to_string(list_sort(list(DISTINCT chunk_hash)), chr(10)) || chr(10)) AS digest FROM chunks GROUP BY 1, 2",
    "verify_text_hash": "SELECT CASE WHEN text_hash IS NULL THEN 'missing' WHEN text_hash = 'sha256:' || sha256(text) THEN 'intact' ELSE 'corrupt' END AS state, count(*) AS n FROM (SELECT DISTINCT ON (chunk_hash) * FROM chunks) WHERE text IS NOT NULL GROUP BY 1",
    "slugify": f"SELECT DISTINCT sheet_id, {_slug('sheet_name')} AS slug FROM xlsx_sheets",
    "section_ids": f"SELECT chunk_hash, nullif(array_to_string(list_filter(list_transform(heading_path, lambda h: {_slug('h')}), lambda s: s <> ''), '/'), '') AS section FROM (SELECT DISTINCT ON (chunk_hash) * FROM chunks)",
    "media_types": f"SELECT DISTINCT image_hash, {_MEDIA.format('file_name')} AS media_type, {_CONTEXT.format(_FLAT.format('file_name'))} AS context FROM page_images",
    "filename_contexts": f"SELECT DISTINCT raw_path, {_CONTEXT.format(_FLAT.format('raw_path'))} AS context, {_MEDIA.format('raw_path')} AS media_type FROM chunks",
    "secret_tiers": f"WITH {_DRESSED} SELECT doc_id, tier FROM tiers",
    "quarantine": f"WITH {_DRESSED}, r AS (SELECT doc_id, CASE WHEN size > 4000 THEN 'too_large' WHEN tier = 'A' THEN 'secrets_tier_a' WHEN tier = 'B' THEN 'secrets_tier_b' END AS reason FROM tiers) SELECT reason, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1",
    "portable_names": """
        WITH n AS (SELECT DISTINCT sheet_id, sheet_name || ['', '.', ':1', '?.md'][length(sheet_name) % 4 + 1] AS name FROM xlsx_sheets)
        SELECT sheet_id, name, CASE WHEN name IN ('', '.', '..') THEN 'empty' WHEN length(name) + len(list_filter(string_split(name, ''), lambda c: unicode(c) > 65535)) > 255 THEN 'too_long' WHEN regexp_matches(name, '[. ]$') THEN 'trailing_dot_or_space'
          WHEN regexp_matches(name, '[\\x00-\\x1F\\x7F<>:"/\\\\|?*]') THEN 'forbidden_character' WHEN regexp_matches(regexp_replace(string_split(name, '.')[1], '[. ]+$', ''), '(?i)^(?:CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])$') THEN 'reserved_name' END AS error,
          NOT (name IN ('', '.', '..') OR contains(name, '/') OR contains(name, chr(0))) AS logical, 'tag-' || sha256(lower(nfc_normalize(name))) AS leaf FROM n""",
    "name_collisions": "WITH s AS (SELECT DISTINCT raw_hash, sheet_id, lower(nfc_normalize(sheet_name)) AS key FROM xlsx_sheets) SELECT raw_hash, key, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1",
    "sheet_keys": "WITH s AS (SELECT DISTINCT ON (sheet_id) raw_hash, sheet_id, sheet_index, 'sheet:' || replace(nfc_normalize(sheet_name), '#', '##') AS base FROM xlsx_sheets), n AS (SELECT *, row_number() OVER (PARTITION BY raw_hash, base ORDER BY sheet_index, sheet_id) AS n FROM s) SELECT sheet_id, base || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS unit_key FROM n",
    "search_units": f"""
        WITH s AS (SELECT DISTINCT sheet_name FROM xlsx_sheets), t AS (SELECT sheet_name, unnest(list_filter(regexp_split_to_array(nfc_normalize(sheet_name), '[{text.WHITE}]+'), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(regexp_split_to_array(nfc_normalize(sheet_name), '[{text.WHITE}]+'), lambda x: x <> ''), 1) AS i FROM s),
        u AS (SELECT sheet_name, i, unnest(list_concat([tok], regexp_extract_all(tok, '{text.SEGMENT}', 1))) AS unit, generate_subscripts(list_concat([tok], regexp_extract_all(tok, '{text.SEGMENT}', 1)), 1) AS j FROM t),
        f AS (SELECT sheet_name, unit, min((i, j)) AS spot FROM u GROUP BY 1, 2)
        SELECT s.sheet_name, coalesce(string_agg(unit, '|' ORDER BY spot), '') AS units FROM s LEFT JOIN f USING (sheet_name) GROUP BY 1""",
    "scope_selection": "WITH x AS (SELECT doc_id, regexp_extract(raw_path, '^(.*)/', 1) AS root FROM documents WHERE raw_path IS NOT NULL), m AS (SELECT min(root) AS r FROM x) SELECT doc_id, root = r OR starts_with(root, r || '/') AS below, root = r AS itself FROM x, m",
    "embedding_inputs": f"SELECT DISTINCT ON (chunk_hash) chunk_hash, 'sha256:' || sha256(CASE WHEN ({_CONTEXT.format(_FLAT.format('raw_path'))}) IS NULL THEN text ELSE ({_CONTEXT.format(_FLAT.format('raw_path'))}) || chr(10) || chr(10) || text END) AS input_hash FROM chunks WHERE text IS NOT NULL",
    "unit_fingerprints": "SELECT DISTINCT ON (image_hash) image_hash, 'sha256:' || sha256(visible_text) AS text_hash, 'sha256:' || sha256(image_hash) AS visual_hash FROM page_images WHERE visible_text IS NOT NULL",
    "source_escapes": f"SELECT doc_id, 'sha256:' || sha256({_ESCAPED}) AS hash, length({_ESCAPED}) AS size FROM documents WHERE text IS NOT NULL",
    "escape_round_trip": "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[`~]')",
    "indexed_texts": "SELECT doc_id, 'sha256:' || sha256(nfc_normalize(replace(text, chr(0), ''))) AS hash FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[`~\\\\&]')",
    "stored_form": "SELECT doc_id, false AS bad FROM documents WHERE text IS NOT NULL",
    "form_check": "SELECT doc_id, contains(text, chr(65279)) OR contains(text, chr(13)) OR nfc_normalize(text) <> text OR NOT suffix(text, chr(10)) OR suffix(text, chr(10) || chr(10)) OR regexp_matches(text, '[ \\t]\\n') AS surface FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(```|~~~)')",
    "section_reassembly": f"""
        WITH RECURSIVE {_LINES},
        w2 AS (SELECT doc_id, k, byte_start, path, lead(byte_start, 1, octet_length(encode(text))::BIGINT) OVER (PARTITION BY doc_id ORDER BY k) AS byte_end FROM walk)
        SELECT doc_id, byte_start, byte_end FROM w2 WHERE array_to_string(list_filter(list_transform(path, lambda h: {_slug('h')}), lambda x: x <> ''), '/') <> ''""",
    "sheet_views": """
        WITH s AS (SELECT DISTINCT ON (sheet_id) * FROM xlsx_sheets WHERE markdown IS NOT NULL), v AS (SELECT raw_hash, 'sha256:' || sha256(string_agg(markdown, chr(10) ORDER BY sheet_index, sheet_id)) AS view_hash FROM s GROUP BY 1),
        p AS (SELECT raw_hash, sheet_id, octet_length(encode(markdown)) AS n, coalesce(sum(octet_length(encode(markdown)) + 1) OVER (PARTITION BY raw_hash ORDER BY sheet_index, sheet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM s)
        SELECT sheet_id, byte_start, byte_start + n AS byte_end, view_hash FROM p JOIN v USING (raw_hash)""",
    "read_tables": f"WITH s AS (SELECT DISTINCT ON (sheet_id) * FROM xlsx_sheets WHERE markdown IS NOT NULL), r AS (SELECT sheet_id, {_GRID} AS rows FROM s), c AS (SELECT sheet_id, rows, length(rows[1]) - length(replace(rows[1], '|', '')) - 1 AS n FROM r) SELECT sheet_id, '|' || repeat(' |', n) || chr(10) || '|' || repeat(' --- |', n) || chr(10) || array_to_string(rows, chr(10)) AS table FROM c",
    "grid_tables": "SELECT DISTINCT ON (sheet_id) sheet_id, markdown AS table, markdown AS given FROM xlsx_sheets WHERE markdown IS NOT NULL",
    "prompt_hashes": "SELECT doc_id, 'sha256:' || sha256(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n+\\z', ''))) AS template_hash FROM documents WHERE text IS NOT NULL",
    "profile_ids": """SELECT DISTINCT profile_hash, CASE WHEN distance <> 'l2' THEN 'sha256:' || sha256('{"adapter_kind":"embedding","dimensions":' || dimensions || ',"distance":"' || distance || '","modality":"' || modality || '","model_version_pin":"v' || dimensions || '.1"}') END AS id, distance = 'l2' AS mutable FROM chunk_embeddings""",
    "read_quality": """
        WITH p AS (SELECT DISTINCT ON (image_hash) image_hash, visible_text[1:200] AS truth FROM page_images WHERE visible_text IS NOT NULL), x AS (SELECT *, lower(regexp_replace(truth, '[0-9]', '', 'g')) AS read FROM p),
        t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(truth), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(read), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')) AS b FROM x)
        SELECT image_hash, len(list_filter(range(1, length(truth) + 1), lambda i: truth[i] BETWEEN '0' AND '9' OR lower(truth[i]) <> truth[i]))::INT AS distance,
          round(CASE WHEN length(truth) > 0 THEN len(list_filter(range(1, length(truth) + 1), lambda i: truth[i] BETWEEN '0' AND '9' OR lower(truth[i]) <> truth[i])) / length(truth) ELSE 0 END, 9) AS cer,
          round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END, 9) AS recall FROM t""",
    "glob_ignore": """
        SELECT doc_id, CASE WHEN regexp_full_match(raw_path, 'Bra[^/][^/]*-[^/]*\\.md') THEN false WHEN regexp_full_match(raw_path, 'Br[^/]*\\.md') THEN true
          WHEN regexp_full_match(raw_path, '(?:.*/)?[^/]*-a[^/]*\\.md') THEN true ELSE false END AS ignored FROM documents WHERE raw_path IS NOT NULL""",
    "script_segments": f"SELECT DISTINCT sheet_name, array_to_string(regexp_extract_all(sheet_name, '{text.SEGMENT}', 1), '|') AS segments FROM xlsx_sheets",
    "numeric_equivalents": "SELECT o_orderkey, CASE WHEN floor(o_totalprice) >= 1000 THEN floor(o_totalprice)::BIGINT::VARCHAR || '|' || format('{:,}', floor(o_totalprice)::BIGINT) END AS forms FROM orders",
    "unit_keys": "SELECT DISTINCT unit_key, CASE WHEN unit_key LIKE 'page:%' THEN unit_key ELSE 'doc:1' END AS again FROM chunks",
    "image_refs": "WITH p AS (SELECT DISTINCT scope_id, raw_hash, image_hash, page_no FROM page_images) SELECT raw_hash, (row_number() OVER (PARTITION BY raw_hash ORDER BY page_no, image_hash) - 1)::INT AS pos, 'ev://' || scope_id || '/object/image/' || image_hash AS target, image_hash AS hash, scope_id AS scope FROM p",
    "html_detect": f"SELECT regexp_matches(text, '<(?:[A-Za-z/!?][^>\\n]*>|[^>\\n]*://[^>\\n]*>|[^> \\n]*@[^> \\n]*>)') AS html, length({_TRIM}) > 0 AND (length({_TRIM}) - length(regexp_replace({_TRIM}, '[^\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{{84}}\\x{{86}}-\\x{{9F}}\\x{{FFFD}}]', '', 'g'))) * 100 >= length({_TRIM}) * 85 AS real_text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "code_fences": f"SELECT repeat('`', greatest(2, coalesce(list_max(list_transform(regexp_extract_all(text, '(?m)^[{text.WHITE}]*(`+)', 1), lambda r: length(r))), 0)) + 1) AS fence, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "excel_dates": "SELECT p_partkey, CASE WHEN p_partkey * 17 % 60000 <= 60 THEN (p_partkey * 17 % 60000)::VARCHAR ELSE strftime(DATE '1970-01-01' + (p_partkey * 17 % 60000 - 25569)::INT, '%Y-%m-%d') END AS day, ((ascii(upper(p_name)[1:1]) - 64) * 26 + ascii(upper(p_name)[2:2]) - 64)::BIGINT AS col_no FROM part",
    "durations": "WITH e AS (SELECT DISTINCT event_id % 50 AS n, ['s','m','h','d','w','x'][event_id % 6 + 1] AS u FROM events) SELECT n || u AS t, nullif(n * CASE u WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 END, 0) AS seconds FROM e",
    "since_cutoffs": """
        WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, CASE WHEN event_id % 11 = 0 THEN 99999999 ELSE event_id % 50 END * [1, 60, 3600, 86400, 604800, 0][event_id % 6 + 1] AS s FROM events), x AS (SELECT event_id, epoch(t)::BIGINT - s AS at_second, s FROM e)
        SELECT event_id, CASE WHEN s > 0 AND at_second >= -62135596800 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(at_second), '%Y-%m-%d %H:%M:%S') END AS cutoff FROM x""",
    "utc_validity": "WITH e AS (SELECT DISTINCT '2024-' || lpad((event_id % 14)::VARCHAR, 2, '0') || '-' || lpad((event_id % 33)::VARCHAR, 2, '0') || 'T10:00:00Z' AS t FROM events) SELECT t, try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AS valid FROM e",
    "vector_validity": "SELECT DISTINCT ON (vec_rowid) vec_rowid, coalesce(vector IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0, false) AS usable FROM chunk_embeddings",
    "truncate_renorm": "WITH c AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM c) SELECT vec_id, round(v[1] / l, 6) AS first, round(1.0::DOUBLE, 6) AS length FROM n",
    "profile_compat_gate": "SELECT profile_hash, count(DISTINCT (dimensions, distance, modality)) AS kinds, count(DISTINCT (dimensions, distance, modality)) = 1 AS compatible FROM chunk_embeddings GROUP BY 1",
    "chunk_headings": f"""
        WITH RECURSIVE {_LINES}
        SELECT doc_id, array_to_string(path, ' > ') AS heading_path, level::INT AS level, byte_start,
          lead(byte_start, 1, octet_length(encode(text))::BIGINT) OVER (PARTITION BY doc_id ORDER BY k) AS byte_end FROM walk""",
    "chunk_section_ids": f"""
        WITH RECURSIVE {_LINES},
        s AS (SELECT doc_id, byte_start, array_to_string(list_filter(list_transform(path, lambda h: {_slug('h')}), lambda x: x <> ''), '/') AS base FROM walk)
        SELECT doc_id, byte_start, base || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS section_id FROM s WINDOW w AS (PARTITION BY doc_id, base ORDER BY byte_start)""",
}
QUERIES = {f.__name__: f for f in (ids_sha256, chunk_identity, config_ids, chunk_set_digest, verify_text_hash, slugify, section_ids, media_types, filename_contexts, secret_tiers, quarantine, portable_names, name_collisions, sheet_keys, search_units, scope_selection, embedding_inputs, unit_fingerprints, source_escapes, escape_round_trip, indexed_texts, stored_form, form_check, heading_chunks, section_reassembly, sheet_views, read_tables, grid_tables, prompt_hashes, profile_ids, read_quality, window_distance, glob_ignore, script_segments, numeric_equivalents, unit_keys, image_refs, html_detect, code_fences, excel_dates, durations, since_cutoffs, utc_validity, vector_validity, truncate_renorm, profile_compat_gate, chunk_headings, chunk_section_ids)}
