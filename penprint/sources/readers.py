"""Readers: files and tables to documents(doc_id, path, title, author, text, metadata)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import document_id, normalize

SUFFIXES = ("txt", "md", "pdf", "epub")
OUT = "path string, title string, author string, text string, metadata map<string,string>, problem string"
DOCUMENT = (
    "id string, source_path string, title string, author string, text string, segments array<struct<index:int,title:string,text:string,"
    "char_offset_start:int,char_offset_end:int,word_count:int>>, metadata map<string,string>, word_count int"
)
SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class Text(HTMLParser):
    """Visible text of a page, a line a block, and its title."""

    def __init__(self, only: set[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.only, self.parts, self.title, self.open, self.skip = only, [], "", [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.open.append(tag)
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open[-1] != tag:
                self.skip -= self.open.pop() in SKIPPED
            self.skip -= self.open.pop() in SKIPPED
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if "title" in self.open and not self.title:
            self.title = data.strip()
        elif not self.skip and "title" not in self.open and (self.only is None or self.only & set(self.open)):
            self.parts.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of pages (page_id, url, html). Null html gives null title and text."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            found = []
            for html in pdf["html"]:
                p = Text()
                if html is not None:
                    p.feed(html)
                    p.close()
                found.append((None, None) if html is None else (p.title, p.text()))
            yield pdf[["page_id", "url"]].assign(title=[t for t, _ in found], text=[t for _, t in found])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string")


def read_epub(data: bytes) -> tuple[str | None, str | None, str, dict[str, str]]:
    """Title, creator, text and metadata: chapters in spine order, blocks joined by line breaks, chapters by blank lines."""
    book = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    package = ElementTree.fromstring(book.read(root))
    base = root.rpartition("/")[0]
    files = {i.get("id"): i.get("href") for i in package.iterfind(".//{*}manifest/{*}item")}
    first = lambda tag: next((e.text for e in package.iterfind(f".//{{*}}metadata/{{*}}{tag}") if e.text), None)
    chapters = []
    for ref in package.iterfind(".//{*}spine/{*}itemref"):
        p = Text({"p", "h1", "h2", "h3", "h4", "h5", "h6"})
        p.feed(book.read(f"{base}/{files[ref.get('idref')]}".lstrip("/")).decode("utf-8", "replace"))
        if text := p.text():
            chapters.append(text)
    meta = {"chapter_count": str(len(chapters))} | ({"publisher": first("publisher")} if first("publisher") else {})
    return first("title"), first("creator"), "\n\n".join(chapters), meta


def read_pdf(data: bytes) -> tuple[str | None, str | None, str, dict[str, str]]:
    """Title, author, text and page count: text blocks by place, pages joined by blank lines. A second extractor is tried on
    pages that give under 100 characters on average, and wins if it finds more."""
    try:
        import fitz
    except ImportError:
        raise RuntimeError("reading PDF needs PyMuPDF on the executors") from None
    pdf = fitz.open(stream=data, filetype="pdf")
    pages = []
    for page in pdf:
        blocks = sorted((b for b in page.get_text("blocks") if b[6] == 0), key=lambda b: (b[1], b[0]))
        pages.append("\n".join(b[4].strip() for b in blocks))
    text = "\n\n".join(pages)
    if len(text) < 100 * max(1, len(pages)):
        try:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(data)) as other:
                more = "\n\n".join(p.extract_text() or "" for p in other.pages)
            text = more if len(more) > len(text) else text
        except ImportError:
            pass  # the second extractor is optional
    return pdf.metadata.get("title") or None, pdf.metadata.get("author") or None, text, {"page_count": str(len(pages))}


def read_files(spark: SparkSession, path: str, recursive: bool = True, ocr=None) -> DataFrame:
    """Documents of all .txt, .md, .pdf and .epub files under path; other files are left out.

    Text is normalized; doc_id is the id of its content, author the folder that holds the file. problem says why a file
    couldn't be read (its text is null then). ocr: bytes -> text, tried on PDFs that give under 50 characters a page.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    hidden = F.col("path").rlike(r"/\.[^/]*/")
    files = files.where(suffix.isin(*SUFFIXES) & ~hidden)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                kind, title, author, meta, text, problem = path.rsplit(".", 1)[1].lower(), None, None, {}, None, None
                try:
                    if kind in ("txt", "md"):
                        text = data.decode("utf-8")
                    else:
                        title, author, text, meta = (read_epub if kind == "epub" else read_pdf)(data)
                        if kind == "pdf" and ocr and len(text) < 50 * int(meta["page_count"]):
                            text = ocr(data)
                except (UnicodeDecodeError, RuntimeError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    problem = f"{type(e).__name__}: {e}"
                rows.append((path, title, author, text, meta, problem))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "text", "metadata", "problem"])

    raw = files.mapInPandas(run, OUT)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    folder = F.element_at(F.split("path", "/"), -2)
    raw = raw.withColumn("text", normalize(F.col("text")))
    return raw.select(document_id(F.col("text")).alias("doc_id"), "path", F.coalesce("title", stem).alias("title"), F.coalesce("author", folder).alias("author"), "text", "metadata", "problem")


def read_one(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """One uploaded file as a document row."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in SUFFIXES:
        raise ValueError(f"unsupported file type .{kind}; known: {', '.join(SUFFIXES)}")
    title, author, text, meta = (None, None, data.decode("utf-8"), {}) if kind in ("txt", "md") else (read_epub if kind == "epub" else read_pdf)(data)
    row = spark.createDataFrame([(name, title or name.rsplit(".", 1)[0], author, text, meta)], "path string, title string, author string, text string, metadata map<string,string>")
    return row.withColumn("text", normalize(F.col("text"))).withColumn("doc_id", document_id(F.col("text")))


def read_document_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents written as JSON, by explicit schema; files of another shape give rows without id, which are left out."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).where("id is not null and text is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("author string, title string, book_id long, lang string").json(path)
