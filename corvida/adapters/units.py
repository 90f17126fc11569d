"""From files to units and from units to Markdown, as table functions (one file, many rows)."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corvida.functions.markdown import form_error, html_to_markdown, normal_form
from corvida.sources.files import sheets_of
from corvida.sources.pdf import pages_of

UNITS = "unit_key string, n int, body string, text_hash string, error string"


def prepared(name: str, content: bytes) -> list[tuple[str, int, str]]:
    """(unit key, number, text) of a file's units: pages of a PDF, sheets of a workbook, else the one document."""
    ext = name.rsplit(".", 1)[-1].lower()
    if ext == "pdf":
        return [(f"page:{i}", i - 1, t) for i, t in enumerate(pages_of(content), 1)]
    if ext == "xlsx":
        out, seen = [], {}
        for sheet, i, body in sheets_of(content):
            base = "sheet:" + sheet.replace("#", "##")
            seen[base] = seen.get(base, 0) + 1
            out.append((base if seen[base] == 1 else f"{base}#{seen[base]}", i, body))
        return out
    if b"\0" in content:
        raise ValueError("not text")
    return [("doc:1", 0, content.decode())]


@udtf(returnType=UNITS)
class Prepare:
    """Units of one file; a file that cannot be read is one row with its error."""

    def eval(self, name: str, content: bytes):
        try:
            for key, n, body in prepared(name, bytes(content)):
                yield key, n, body, "sha256:" + hashlib.sha256(body.encode()).hexdigest(), None
        except Exception as e:  # noqa: BLE001
            yield None, None, None, None, type(e).__name__


@udtf(returnType="markdown string, error string")
class Markdownize:
    """Markdown of one unit in its stored form, and the first rule it still breaks."""

    def eval(self, body: str):
        text = normal_form(html_to_markdown(body or ""))
        yield text, form_error(text)


def register(spark: SparkSession) -> None:
    """Make both callable from SQL: ``SELECT ... FROM files, LATERAL prepare(name, content)``."""
    spark.udtf.register("prepare", Prepare)
    spark.udtf.register("markdownize", Markdownize)
