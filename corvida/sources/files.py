"""Folder scans, append-only JSON lines, workbook decoding and the restore sink."""

from __future__ import annotations

import hashlib
import io
import os
import re
import shutil
import uuid
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvida.functions.ids import sha256_id
from corvida.functions.markdown import grid_to_markdown
from corvida.functions.text import collision_key, ignored, logical_path_ok, media_type, portable_leaf_error, quarantine_reason

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan_folder(spark: SparkSession, folder: str, most_bytes: int = 256 << 20, rules: list[str] | None = None) -> DataFrame:
    """Direct files of a folder by name: size, raw_hash, media type, and why one is held back (too large, secret).

    Held and ignored files are decided by name and size, and only the others' content is read and hashed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    reason = quarantine_reason(name, F.col("length"), most_bytes)
    held = F.when(reason == "too_large", reason).when(reason.isNotNull(), "secret")
    listed = raw.select("path", "length", name.alias("name"), media_type(name).alias("media_type"), held.alias("held")).where(~ignored(F.col("name"), rules or []))
    free = [r.path for r in listed.where("held is null").select("path").collect()]  # names of one folder's direct files
    held = listed.where("held is not null").select("name", F.col("length").alias("size"), F.lit(None).cast("string").alias("raw_hash"), "media_type", "held")
    if not free:
        return held.orderBy("name")
    read = spark.read.format("binaryFile").load(free)
    hashed = read.select(name.alias("name"), F.col("length").alias("size"), sha256_id(F.col("content")).alias("raw_hash"), media_type(name).alias("media_type"), F.lit(None).cast("string").alias("held"))
    return hashed.unionByName(held).orderBy("name")


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Strict read of an append-only log: a line that does not fit the schema is an error, never guessed at."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


# Built-in number formats of workbooks that change how a number reads.
FORMATS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}


def plain_number(x: float) -> str:
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    s = repr(x)
    return f"{x:.6f}".rstrip("0").rstrip(".") if "e" in s else s


def format_cell(raw: str, code: str | None) -> str:
    """How a stored number reads under a number format: percents, fixed decimals, dates and times; text stays."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    if not code:
        return plain_number(x)
    # literal text, escaped characters and bracketed sections are no format signs
    signs = re.sub(r'\\.|"[^"]*"|\[[^\]]*\]', "", code)
    decimals = max((len(m) for m in re.findall(r"\.([0#?]*)", code)), default=0)
    if "%" in signs:
        return f"{x * 100:.{decimals}f}%"
    day, clock, month = bool(re.search("[yYdD]", code)), bool(re.search("[hHsS]", signs)), bool(re.search("[mM]", signs))
    if re.search("[yYdD]", signs) or clock or month:
        if not 60 < x <= 2_958_465:  # earlier serials hold a day that never was
            return plain_number(x)
        date = day or month and not clock
        at = datetime(1899, 12, 30) + timedelta(days=int(x), seconds=round((x - int(x)) * 86400))
        return at.strftime("%Y-%m-%d" if date and not clock else "%H:%M:%S" if clock and not date else "%Y-%m-%d %H:%M:%S")
    if re.search("[0#?]", signs):
        return f"{x:.{decimals}f}" if decimals else plain_number(float(round(x)))
    return plain_number(x)


def sheets_of(content: bytes) -> list[tuple[str, int, str]]:
    """(sheet name, index, Markdown) of a workbook's sheets: formatted cells, tables parted by blank rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name))
        strings, codes = [], []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in tree("xl/sharedStrings.xml").iter(f"{_MAIN}si")]
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = FORMATS | {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")}
            cells = styles.find(f"{_MAIN}cellXfs")
            codes = [own.get(int(x.get("numFmtId") or 0)) for x in (cells if cells is not None else [])]
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for i, sheet in enumerate(tree("xl/workbook.xml").iter(f"{_MAIN}sheet")):
            root, grid, last = tree("xl/" + targets[sheet.get(f"{_REL}id")].removeprefix("/xl/")), [], 0
            for row in root.iter(f"{_MAIN}row"):
                at = int(row.get("r") or last + 1)
                grid += [[]] * min(at - last - 1, 1)  # rows left out are blank
                last, cells = at, {}
                for c in row.iter(f"{_MAIN}c"):
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        text = ""
                    elif kind == "s":
                        text = strings[int(value.text)]
                    elif kind == "b":
                        text = "TRUE" if value.text == "1" else "FALSE"
                    elif kind in ("str", "e"):
                        text = value.text
                    else:
                        style = int(c.get("s") or 0)
                        text = format_cell(value.text, codes[style] if style < len(codes) else None)
                    column = 0
                    for ch in (c.get("r") or "A").rstrip("0123456789"):
                        column = column * 26 + ord(ch) - 64
                    cells[column - 1] = text
                grid.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), i, grid_to_markdown(grid)))
        return out


def decode_workbooks(files: DataFrame) -> DataFrame:
    """path, sheet_name, sheet_index, markdown, error of binary workbook rows (path, content); a broken file is one row with its error."""

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *s, None) for s in sheets_of(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sheet_name", "sheet_index", "markdown", "error"])

    return files.select("path", "content").mapInPandas(decode, "path string, sheet_name string, sheet_index int, markdown string, error string")


def decode_pdfs(files: DataFrame) -> DataFrame:
    """path, page_no, text, error of binary PDF rows (path, content); a broken or oversized file is one row with its error."""
    from corvida.sources.pdf import pages_of

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(pages_of(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"])

    return files.select("path", "content").mapInPandas(decode, "path string, page_no int, text string, error string")


def restore(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files into a shared folder, all or none.

    Bad and clashing names (case and composition aside) and names that are there already are found before anything is
    written. Files are staged beside the folder under names of their own, so a task that runs twice does no harm, and are
    moved into place only when all are there; a failure on the way leaves the folder as it was.
    """
    names = files.select("name")
    bad = names.where(~logical_path_ok(F.col("name")) | portable_leaf_error(F.col("name")).isNotNull()).limit(1).count()
    clash = names.groupBy(collision_key(F.col("name"))).count().where("count > 1").limit(1).count()
    present = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    taken = names.select("name").toLocalIterator()
    if bad or clash or any(r.name in present for r in taken):
        raise FileExistsError("names clash or are not allowed; nothing was written")
    stage = f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
    os.makedirs(stage)

    def put(rows):
        for r in rows:
            path = os.path.join(stage, hashlib.sha256(r.name.encode()).hexdigest())
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(bytes(r.content))
            os.replace(part, path)

    try:
        files.select("name", "content").foreachPartition(put)
        wanted = [r.name for r in names.toLocalIterator()]
        staged = {n: os.path.join(stage, hashlib.sha256(n.encode()).hexdigest()) for n in wanted}
        if not all(map(os.path.exists, staged.values())):
            raise OSError("a staged file is missing; the folder must be shared by all executors")
        os.makedirs(folder, exist_ok=True)
        done = []
        try:
            for n, path in staged.items():
                os.link(path, os.path.join(folder, n))  # fails where the name has appeared meanwhile
                done.append(n)
        except OSError:
            for n in done:
                os.unlink(os.path.join(folder, n))
            raise
        return len(staged)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
