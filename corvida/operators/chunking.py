"""Sections of Markdown documents: headings, fences, heading paths and byte offsets as windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions.ids import sha256_id
from corvida.functions.markdown import chunk_spans
from corvida.functions.text import WHITE, nfc_each, section_id, slug_of_nfc

BLANK = f"[{WHITE}]"
HEADING = rf"^(#{{1,6}}){BLANK}+(.*?){BLANK}*#*{BLANK}*$"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, n, line, byte_start, in_fence (fence lines count as inside); null and empty texts have no lines."""
    w = Window.partitionBy("doc_id").orderBy("n")
    each = docs.where("text is not null and text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    mark = F.col("line").rlike(f"^{BLANK}*(```|~~~)")
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("byte_start", start.cast("bigint")).withColumn("mark", mark).withColumn("marks", F.sum(F.col("mark").cast("int")).over(w)).select("doc_id", "n", "line", "byte_start", (F.col("mark") | (F.col("marks") % 2 == 1)).alias("in_fence"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, heads: the headings of each document in order, with the path each one opens.

    A heading of level n cuts the running path to n - 1 parts and adds itself, so skipped levels collapse.
    """
    heads = (
        lines(docs)
        .where(~F.col("in_fence") & F.col("line").rlike(rf"^#{{1,6}}{BLANK}"))
        .select("doc_id", "byte_start", F.char_length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))
        .where("title <> ''")
    )
    ordered = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("byte_start", "level", "title"))).alias("h"))
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<byte_start:bigint,level:int,path:array<string>>>").alias("out"))

    def step(acc, h):
        path = F.concat(F.slice(acc["stack"], F.lit(1), F.least(h["level"] - 1, F.size(acc["stack"]))), F.array(h["title"]))
        return F.struct(path.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["byte_start"].alias("byte_start"), h["level"].alias("level"), path.alias("path")))).alias("out"))

    return ordered.select("doc_id", F.aggregate("h", empty, step, lambda acc: acc["out"]).alias("heads"))


def sections(docs: DataFrame) -> DataFrame:
    """One row per heading: its path, level and the bytes up to the next heading."""
    total = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("total"))
    each = headings(docs).select("doc_id", F.explode("heads").alias("h")).join(total, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("byte_start")
    flat = each.select("doc_id", F.array_join("h.path", " > ").alias("heading_path"), F.col("h.level").alias("level"), F.col("h.byte_start").alias("byte_start"), "total")
    return flat.withColumn("byte_end", F.coalesce(F.lead("byte_start").over(w), "total")).drop("total")


def numbered_sections(docs: DataFrame) -> DataFrame:
    """Section ids: slugs of the path; the second and further ones of a document get #2, #3."""
    each = headings(docs).select("doc_id", F.explode("heads").alias("h"))
    base = F.array_join(F.filter(F.transform(nfc_each(F.col("h.path")), slug_of_nfc), lambda x: x != ""), "/")
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("byte_start"))
    return each.select("doc_id", F.col("h.byte_start").alias("byte_start"), base.alias("base")).withColumn("n", n).select("doc_id", "byte_start", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")).alias("section_id"))


def chunks(docs: DataFrame, max_chars: int) -> DataFrame:
    """doc_id, heading_path, section_id, char_start, char_end, byte_start, byte_end, text, text_hash of every chunk.

    What stands before the first heading is a section without path. Sections longer than ``max_chars`` are cut after
    their last blank line in reach, else at the limit; blank chunks are dropped, which changes no number of the others.
    Null and empty texts have no chunks. Repeated section ids are numbered within their document.
    """
    d = docs.where("text is not null and text <> ''")
    total = F.octet_length("text").cast("bigint")
    head = F.struct(F.lit(0).cast("bigint").alias("byte_start"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("path"))
    heads = F.coalesce("heads", F.array().cast("array<struct<byte_start:bigint,level:int,path:array<string>>>"))
    every = F.when((F.size(heads) > 0) & (heads[0]["byte_start"] == 0), heads).otherwise(F.concat(F.array(head), heads))
    sections_ = d.join(headings(d), "doc_id", "left").withColumn("s", every).select("doc_id", "text", total.alias("total"), "s", F.posexplode("s").alias("i", "h"))
    cut = sections_.select("doc_id", "text", "i", F.col("h.path").alias("heading_path"), F.col("h.byte_start").alias("a"), F.coalesce(F.get("s", F.col("i") + 1)["byte_start"], "total").alias("b"))
    base = cut.withColumn("base", section_id(F.col("heading_path")))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("i"))
    numbered = base.withColumn("n", n).withColumn("section_id", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")))
    spans = numbered.withColumn("span", F.explode(chunk_spans(max_chars)("text", "a", "b")))
    body = F.substring(F.col("text"), (F.col("span.char_start") + 1).cast("int"), (F.col("span.char_end") - F.col("span.char_start")).cast("int"))
    return spans.select("doc_id", "heading_path", "section_id", "span.char_start", "span.char_end", "span.byte_start", "span.byte_end", body.alias("text")).withColumn("text_hash", sha256_id(F.col("text")))
