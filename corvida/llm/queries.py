"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.llm import lookalike, mixing, neardup, neighbours, scans, sentences, splitting, tokenise
from corvida.session import load, written


def _p1_rows(spark, d):
    chunks = lookalike.records(load(spark, d, "chunks"), "chunks", "chunk_hash", "raw_hash", "text")
    return chunks.unionByName(lookalike.records(load(spark, d, "xlsx_sheets"), "xlsx_sheets", "sheet_id", "raw_hash", "sheet_name"))


def p1_found(spark, d):
    return lookalike.equal_looking(lookalike.repaired(_p1_rows(spark, d)))


def p1_forms(spark, d):
    return lookalike.repaired(_p1_rows(spark, d)).select("record_table", "record_key", "form")


def p2_nearest(spark, d):
    return neighbours.nearest(load(spark, d, "chunk_embeddings"))


def p2_found(spark, d):
    return neighbours.similar_pairs(p2_nearest(spark, d))


def p3_pieces(spark, d):
    return splitting.split_oversized(load(spark, d, "chunks"), load(spark, d, "chunking_configs"))


def p3_found(spark, d):
    return p3_pieces(spark, d).where("piece_no = 0").select("chunk_hash")


def p3_covered(spark, d):
    """Whether the pieces of each oversized chunk stay within the limit, overlap as configured and cover it from end to end."""
    c = load(spark, d, "chunks").select("chunk_hash", "chunking_config_hash", "text").dropDuplicates(["chunk_hash"]).join(load(spark, d, "chunking_configs"), "chunking_config_hash")
    p = p3_pieces(spark, d).join(c.select("chunk_hash", "max_chars", "overlap_chars", F.char_length("text").alias("chars")), "chunk_hash")
    last = F.lag("char_end").over(Window.partitionBy("chunk_hash").orderBy("piece_no"))
    joined = F.when(F.col("piece_no") == 0, F.col("char_start") == 0).otherwise(F.col("char_start") == F.greatest(last - F.least("overlap_chars", F.col("max_chars") - 1), F.lit(0)))
    g = p.withColumn("joined", joined).groupBy("chunk_hash", "chars").agg(F.bool_and(F.char_length("text") <= F.col("max_chars")).alias("within"), F.bool_and("joined").alias("joined"), F.max("char_end").alias("end"))
    return g.select("chunk_hash", "chars", "within", "joined", (F.col("end") == F.col("chars")).alias("covered"))


def p5_repaired(spark, d):
    chunks = load(spark, d, "chunks")
    page = F.col("unit_key").startswith("page:")
    pages = chunks.where(page).select(F.lit("chunks").alias("record_table"), F.col("chunk_hash").alias("record_key"), "text")
    images = load(spark, d, "page_images").select(F.lit("page_images").alias("record_table"), F.col("image_hash").alias("record_key"), F.col("visible_text").alias("text"))
    clean = chunks.where(~page).select(F.col("chunk_hash").alias("record_key"), "text")
    titles = chunks.select(F.explode("heading_path").alias("text")).where("text is not null")
    return scans.repair_pages(pages.unionByName(images), clean, titles)


def p5_found(spark, d):
    return p5_repaired(spark, d).select("record_table", "record_key")


def _p6_records(spark, d):
    return load(spark, d, "chunks").select(F.col("chunk_hash").alias("record"), F.col("raw_hash").alias("grp"), "text")


def p6_found(spark, d):
    return neardup.record_pairs(*neardup.near_duplicates(_p6_records(spark, d))).select(F.col("p").alias("chunk_hash_a"), F.col("q").alias("chunk_hash_b"))


def p6_groups(spark, d):
    return neardup.groups(*neardup.near_duplicates(_p6_records(spark, d))).withColumnRenamed("record", "chunk_hash")


def p7_ids(spark, d):
    return tokenise.token_ids(load(spark, d, "documents"))


def p7_roundtrip(spark, d):
    return tokenise.round_trip(load(spark, d, "documents")).select("doc_id", "same")


def _p8(spark, d):
    t = F.col("text")
    docs = load(spark, d, "documents").where("source is not null and text is not null and text <> ''").select("doc_id", "source", "text", F.char_length("text").alias("chars"), mixing.letter_share(t).alias("letters"), mixing.line_share(t).alias("lines"))
    counted = tokenise.token_counts(docs, ["doc_id", "source", "chars", "letters", "lines"]).where("n_tokens > 0").dropDuplicates(["doc_id"])
    sizes = written(mixing.with_quality(written(counted, "p8")).select("doc_id", "source", "n_tokens", "weight"), "p8")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0  # a mix as large as the corpus: scarce sources go to their cap, the rest is not cut
    plan = written(mixing.budgets(sizes, load(spark, d, "mix_targets"), total_tokens=total), "p8plan")
    return mixing.draw(sizes, plan), plan


def p8_mix(spark, d):
    return _p8(spark, d)[0]


def p8_shares(spark, d):
    return mixing.shares(*_p8(spark, d))


def p9_found(spark, d):
    return p9_sentences(spark, d).select("doc_id", "sent_end")


def p9_sentences(spark, d):
    return sentences.sentences(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_nearest, p3_found, p3_pieces, p3_covered, p5_found, p5_repaired, p6_found, p6_groups, p7_ids, p7_roundtrip, p8_mix, p8_shares, p9_found, p9_sentences)}
SQL = {
    "p3_found": """
        SELECT DISTINCT c.chunk_hash FROM chunks c JOIN chunking_configs g USING (chunking_config_hash)
        WHERE length(c.text) > g.max_chars""",
    "p3_covered": """
        SELECT DISTINCT c.chunk_hash, length(c.text)::INT AS chars, true AS within, true AS joined, true AS covered FROM chunks c JOIN chunking_configs g USING (chunking_config_hash)
        WHERE length(c.text) > g.max_chars""",
    "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
