"""Files to text: a table of parsers by extension, run over Spark's binaryFile scan; feeds and JSON lines.

Parsers of formats that need a model or a library of their own (PDF, audio, video) are passed in; without one such a file gives an
error row, never a failed job.  What a parser raises is kept beside the file's path.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], str]

# Extensions of audio and video files.
MEDIA = ("mp3", "wav", "m4a", "ogg", "flac", "aac", "opus", "wma", "mp4", "mkv", "webm", "mov", "avi", "m4v", "wmv")


def plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class _Markdown(HTMLParser):
    """Headings, list items, paragraphs and table rows as Markdown lines; page furniture is left out."""

    SKIP, BLOCKS = {"script", "style", "nav", "footer", "header"}, {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "p": ""}

    def __init__(self):
        super().__init__()
        self.lines, self.words, self.skipped, self.mark = [], [], 0, None

    def flush(self):
        line = " ".join("".join(self.words).split())
        if line and self.mark is not None:
            self.lines.append(self.mark + line)
        self.words, self.mark = [], None

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        if tag in self.BLOCKS:
            self.flush()
            self.mark = self.BLOCKS[tag]

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIP and self.skipped > 0
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skipped and self.mark is not None:
            self.words.append(data)


def html(raw: bytes) -> str:
    parser = _Markdown()
    parser.feed(plain(raw))
    parser.close()
    parser.flush()
    return "\n\n".join(parser.lines)


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _all(node, name: str):
    return [x for x in node.iter() if _local(x) == name]


def _joined(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in _all(node, name))


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def docx(raw: bytes) -> str:
    """Paragraphs (headings 1 to 3 marked), then tables as pipe rows."""
    body = _part(zipfile.ZipFile(io.BytesIO(raw)), "word/document.xml")
    in_tables = {id(p) for table in _all(body, "tbl") for p in _all(table, "p")}
    out = []
    for p in _all(body, "p"):
        text = _joined(p).strip()
        if text and id(p) not in in_tables:
            style = "".join(v for s in _all(p, "pStyle") for v in s.attrib.values()).lower().replace(" ", "")
            level = next((k for k in (1, 2, 3) if style == f"heading{k}"), 0)
            out.append("#" * level + " " * bool(level) + text)
    for table in _all(body, "tbl"):
        out.append("\n".join("| " + " | ".join(_joined(c).strip() for c in _all(r, "tc")) + " |" for r in _all(table, "tr")))
    return "\n\n".join(out)


def pptx(raw: bytes) -> str:
    """[Slide i] texts, and the slide's notes."""
    book, out = zipfile.ZipFile(io.BytesIO(raw)), []
    slides = sorted((n for n in book.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[1]))))
    for k, name in enumerate(slides, 1):
        texts = [t for p in _all(_part(book, name), "p") if (t := _joined(p).strip())]
        out.append(f"[Slide {k}] " + " | ".join(texts))
        notes = _part(book, f"ppt/notesSlides/notesSlide{k}.xml")
        if notes is not None and (text := " ".join(t for p in _all(notes, "p") if (t := _joined(p).strip()))):
            out.append(f"[Notes {k}] {text}")
    return "\n".join(out)


def xlsx(raw: bytes, rows: int = 10) -> str:
    """JSON of each sheet's columns, number of rows and first rows."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    strings = _part(book, "xl/sharedStrings.xml")
    shared = [_joined(s) for s in _all(strings, "si")] if strings is not None else []
    names = [s.attrib.get("name") for s in _all(_part(book, "xl/workbook.xml"), "sheet")]
    sheets = []
    for k, name in enumerate(names, 1):
        table = []
        for r in _all(_part(book, f"xl/worksheets/sheet{k}.xml"), "row"):
            values = [(c.attrib.get("t"), _joined(c, "v") or _joined(c)) for c in _all(r, "c")]
            table.append([shared[int(v)] if kind == "s" and v else v for kind, v in values])
        sheets.append({"sheet": name, "columns": table[0] if table else [], "row_count": max(len(table) - 1, 0), "sample": table[1 : rows + 1]})
    return json.dumps(sheets, ensure_ascii=False)


def xml(raw: bytes) -> str:
    return "\n".join(t for x in ElementTree.fromstring(raw).itertext() if (t := x.strip()))


def csv_preview(raw: bytes, rows: int = 20) -> str:
    table = list(csv.reader(io.StringIO(plain(raw))))
    return "\n".join(["Columns: " + ", ".join(table[0])] + [", ".join(r) for r in table[1 : rows + 1]]) if table else ""


def first_of(*parsers: Parser) -> Parser:
    """The first parser that neither raises nor returns nothing."""

    def parse(raw: bytes) -> str:
        for p in parsers:
            try:
                if text := p(raw):
                    return text
            except Exception:  # the next parser of the cascade is what a failure asks for
                continue
        return ""

    return parse


PARSERS: dict[str, Parser] = {"html": html, "htm": html, "docx": docx, "pptx": pptx, "xlsx": xlsx, "xml": first_of(xml, html), "csv": csv_preview}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, path: str, formats: list[str] | None = None) -> DataFrame:
    """path, format, modified, size and content of all files below ``path``, of these formats."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select("path", extension(F.col("path")).alias("format"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return found.where(F.col("format").isin([f.lower() for f in formats])) if formats else found


def parse(found: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, format, text and error of each file; unknown formats are plain text, subtitles are cleaned by an expression."""
    from millrace.functions.text import subtitle_text

    table = PARSERS | (parsers or {})

    def one(kind: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            raw = bytes(content)
            if kind in table:
                return table[kind](raw), None
            return (None, f"no parser for {kind}") if kind in MEDIA or kind == "pdf" else (plain(raw), None)
        except Exception as e:  # one broken file must not fail the job
            return None, f"{type(e).__name__}: {e}"[:500]

    parsed = F.udf(one, "text string, error string", useArrow=False)  # some rows at a time: an Arrow batch holds thousands of files
    out = found.select("path", "format", parsed("format", "content").alias("done")).select("path", "format", "done.text", "done.error")
    return out.withColumn("text", F.when(F.col("format").isin("srt", "vtt"), subtitle_text(F.col("text"))).otherwise(F.col("text")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``corrupt`` (the line, where it could not be read); blank lines are skipped."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


FEED = ("url", "title", "published_at", "snippet")


def feed_items(payload: str | None) -> list[tuple[str, str, str, str]]:
    """(url, title, published_at, snippet) of Atom entries, or else of RSS items; no item without a link, none of broken XML."""
    try:
        root = ElementTree.fromstring(payload or "")
    except ElementTree.ParseError:
        return []

    def text(node, *names: str) -> str:
        return next((c.text.strip() for n in names for c in node if _local(c) == n and c.text and c.text.strip()), "")

    entries = [c for c in root if _local(c) == "entry"]
    out = []
    for e in entries or _all(root, "item"):
        links = [c for c in e if _local(c) == "link" and c.attrib.get("href")]
        best = [c for c in links if c.attrib.get("rel", "alternate") == "alternate"] or links
        url = best[0].attrib["href"] if best else "" if entries else text(e, "link", "guid")
        if url:
            out.append((url, text(e, "title").replace("\n", " "), text(e, "published", "updated", "pubDate"), text(e, "summary", "description")[:500]))
    return out


def feed(payloads: DataFrame, key: str, payload: str, tier: str) -> DataFrame:
    """One row for each item of the payloads; items of tier S are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, item) for k, text in enumerate(batch.column(2).to_pylist()) for item in feed_items(text)]
            at = pa.array([k for k, _ in found], pa.int64())
            own = [batch.column(i).take(at) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([item[i] for _, item in found], pa.string()) for i in range(4))], [key, "source_tier", *FEED])

    kind = payloads.schema[key].dataType.simpleString()
    rows = payloads.select(key, F.col(tier).cast("string").alias("source_tier"), payload).mapInArrow(run, f"{key} {kind}, source_tier string, " + ", ".join(f"{c} string" for c in FEED))
    return rows.select(key, "source_tier", (F.col("source_tier") == "S").alias("verified"), *FEED)
