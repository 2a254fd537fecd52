"""Sources that are files: trees, documents, JSON, and sinks that write them back."""

from __future__ import annotations

import html as entities
import io
import re
import zipfile
import zlib
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.functions.text import company_key
from fairloom.operators.relational import latest_per_key

_MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "csv": "text/csv", "md": "text/markdown", "json": "application/json", "txt": "text/plain"}


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """file_path, title, mime, kind, size_bytes, sha256, modified of all files under a folder; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _MIME.items() for x in p]), ext), F.lit("application/octet-stream"))
    kind = F.when(F.col("path").rlike("(?i)roster|名录|名单"), "roster").when(F.col("path").rlike("(?i)export|导出"), "export").when(ext.isin("md", "docx", "pdf"), "report").when(ext.isin("json", "html", "csv", "xlsx"), "raw").otherwise("note")
    return files.where(~name.startswith(".")).select(F.col("path").alias("file_path"), F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "").alias("title"), mime.alias("mime"), kind.alias("kind"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def with_company(files: DataFrame, companies: DataFrame) -> DataFrame:
    """files with the company whose name a file's title is, letters and digits only; of equal names the last company."""
    known = latest_per_key(companies.select("company_id", company_key(F.col("name")).alias("k")).where("k <> ''"), ["k"], [F.desc("company_id")])
    return files.withColumn("k", company_key(F.regexp_extract("title", r"^([^_-]+)", 1))).join(known, "k", "left").drop("k")


def raw_api_rows(spark: SparkSession, path: str, pattern: str = r"([^/]+)_(\d{8,14})\.json$", field: str = "$.2001.Result.Data") -> DataFrame:
    """name, moment, data of the newest answer for each name among a folder of JSON files."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = text.select(F.regexp_extract("file", pattern, 1).alias("name"), F.regexp_extract("file", pattern, 2).alias("moment"), F.get_json_object("value", field).alias("data")).where("name <> ''")
    return rows.groupBy("name").agg(F.max("moment").alias("moment"), F.max_by("data", "moment").alias("data"))


_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"


def knowledge(spark: SparkSession, path: str, required: Sequence[str] = ("title",)) -> DataFrame:
    """slug, fields (map), body of all <slug>/index.md with the required fields, newest year first."""
    text = spark.read.text(path, wholetext=True).withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)/index\.md$", 1))
    lines = F.filter(F.split(F.regexp_extract("value", _FRONT, 1), r"\n"), lambda s: s.rlike(r"^\w+\s*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^(\w+)\s*:", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(s, r"^\w+\s*:(.*)$", 1)), "^[\"']|[\"']$", "").alias("v")))
    rows = text.where(F.col("slug").rlike(r"^[a-z0-9][a-z0-9-]*$")).select("slug", F.map_from_entries(pairs).alias("fields"), F.regexp_extract("value", _FRONT, 2).alias("body"))
    for name in required:
        rows = rows.where(F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit("")) != "")
    return rows.orderBy(F.try_element_at("fields", F.lit("year")).desc_nulls_last(), F.try_element_at("fields", F.lit("title")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def document_markdown(content: bytes) -> str:
    """A docx file's body in order: headings up to six, bullets, tables, paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    out: list[str] = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p" and (text := said(part)):
            style = part.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.search(r"(?i)heading\s*(\d)", name)
            bullet = part.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(f"{'#' * min(6, int(level[1]))} {text}" if level else f"- {text}" if bullet else text)
        elif part.tag == f"{_W}tbl":
            rows = [[said(cell) for cell in row.iter(f"{_W}tc")] for row in part.iter(f"{_W}tr")]
            for i, row in enumerate(rows):
                out.append("| " + " | ".join(row) + " |")
                if i == 0:
                    out.append("|" + " --- |" * len(row))
    return "\n\n".join(out)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file_path, markdown of docx files; null where a file can't be read."""

    def read(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return document_markdown(data)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.pandas_udf(read, "string")("content").alias("markdown"))


def report_title(markdown: Column, skip: str = r"^(?:[-=*_#\s]*|机密.*|内部.*|.*报告编号.*)$") -> Column:
    """The first line that says something."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^#+\s*", ""))), lambda s: ~s.rlike(skip))
    return F.get(lines, F.lit(0))


def forward_filled(rows: DataFrame, columns: Sequence[str], order: str, group: Sequence[str] = ()) -> DataFrame:
    """Merged cells filled down: each blank takes the last value above it. Sheets are read one at a time; give the
    sheet as group where several are read together."""
    from pyspark.sql import Window

    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.last(F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "/", "-"), F.col(c)), ignorenulls=True).over(above) for c in columns}
    return rows.withColumns({c: F.coalesce(v, F.lit("")) for c, v in filled.items()})


_LOC = re.compile(rb"<loc>\s*(.*?)\s*</loc>", re.DOTALL)


def sitemap_entries(content: bytes, piece: int = 1 << 20) -> tuple[str, list[str]]:
    """Kind ('index' or 'urls') and addresses of a sitemap, plain or gzip; inflated and read piece by piece."""
    inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
    kind, found, held = "urls", [], b""
    for at in range(0, len(content), piece):
        part = content[at : at + piece]
        held += inflate.decompress(part) if inflate else part
        if b"<sitemapindex" in held:
            kind = "index"
        last = 0
        for m in _LOC.finditer(held):
            found.append(entities.unescape(m[1].decode("utf-8", "replace")))
            last = m.end()
        open_ = held.rfind(b"<", last)  # what may be the beginning of an entry stays for the next piece
        start = held.find(b"<loc>", last)
        held = held[start if start >= 0 else max(last, open_) :] if (start >= 0 or open_ >= 0) else b""
    if inflate and not inflate.eof:
        raise zlib.error("the file ends too early")
    return kind, found


def sitemaps(spark: SparkSession, path: str, pattern: str = r"/(\d+)(?:\.html?)?/?$") -> DataFrame:
    """file_path, kind, problem, listed_by, url, id of all sitemaps under a folder: one row for each address, one without
    an address for a sitemap without any and for a broken file (files of no bytes are passed over). listed_by: the index file that names the sitemap, by its file name; id: what
    the pattern finds in an address."""

    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                rows.append((*sitemap_entries(bytes(data)), None))
            except (zlib.error, EOFError) as problem:
                rows.append((None, [], str(problem)))
        return pd.DataFrame(rows, columns=["kind", "urls", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    said = files.select(F.col("path").alias("file_path"), F.pandas_udf(read, "struct<kind:string,urls:array<string>,problem:string>")("content").alias("s")).select("file_path", "s.*")
    name = lambda c: F.element_at(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), -1)
    listed = said.where("kind = 'index'").select(F.col("file_path").alias("listed_by"), F.explode("urls").alias("u")).select("listed_by", name(F.col("u")).alias("name")).groupBy("name").agg(F.min("listed_by").alias("listed_by"))
    rows = said.withColumn("name", name(F.col("file_path"))).join(listed, "name", "left")
    found = F.regexp_extract("url", pattern, 1)
    return rows.select("file_path", "kind", "problem", "listed_by", F.explode_outer("urls").alias("url")).withColumn("id", F.when((F.col("kind") == "urls") & (found != ""), found))


def write_csv(rows: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """CSV files with a header of labels, nulls as blanks."""
    out = rows.select([F.col(c).alias((labels or {}).get(c, c)) for c in rows.columns])
    out.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)


def write_snapshot(rows: DataFrame, folder: str, version: str) -> str:
    """A new version of a table; versions are never overwritten."""
    path = f"{folder}/{version}"
    rows.write.mode("errorifexists").parquet(path)
    return path
