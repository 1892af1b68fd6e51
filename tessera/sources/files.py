"""Files as text: plain text of several encodings, DOCX, PDF and HTML, through Spark's binaryFile source.

Every reader returns rows and never raises for a bad file: `error` says what was wrong. Native parsing has no place in
Spark's functions for DOCX, PDF and old encodings, so these run as Arrow batches over whole files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as FT
from ..functions.text import SKIPPED_TAGS
from ..operators import corpus
from .workspace import Workspace

#: Fixed value: encodings in order; the last takes any bytes.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin-1")
#: Bytes of files that a task decodes before it hands on their texts.
SLICE_BYTES = 4 << 20
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> str:
    """Text by the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def docx_text(raw: bytes) -> str:
    """Non-blank paragraphs outside tables, then non-blank table cells, a line each."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))

    def shown(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter(f"{_WORD}t"))

    tables = list(root.iter(f"{_WORD}tbl"))
    inside = {id(p) for t in tables for p in t.iter(f"{_WORD}p")}
    lines = [shown(p) for p in root.iter(f"{_WORD}p") if id(p) not in inside]
    lines += ["\n".join(shown(p) for p in cell.iter(f"{_WORD}p")).strip() for t in tables for cell in t.iter(f"{_WORD}tc")]
    return "\n".join(x for x in lines if x.strip())


def pdf_text(raw: bytes) -> str:
    """Text of the pages; needs one of two optional libraries."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as pdf:
            text = "\n".join(p.extract_text() or "" for p in pdf.pages)
        if text.strip():
            return text
    except ImportError:
        pass
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.depth += tag in SKIPPED_TAGS

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_visible(html: str) -> str:
    """Visible text by a parser: exact for nested blocks too."""
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(p.parts)


def _read(name: str, raw: bytes) -> tuple[str | None, str | None]:
    ext = name.lower().rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    try:
        if ext in ("txt", "md"):
            return decode(raw), None
        if ext == "docx":
            return docx_text(raw), None
        if ext == "pdf" or raw[:5] == b"%PDF-":
            return pdf_text(raw), None
        if ext in ("html", "htm"):
            return html_visible(raw.decode("utf-8", "ignore")), None
        return None, "convert .doc to .docx" if ext == "doc" else f"unsupported: .{ext}"
    except Exception as e:  # noqa: BLE001  one bad file must not end the scan
        return None, f"{type(e).__name__}: {e}"


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of content, a row at least: a task holds few decoded texts at once."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts(files: DataFrame) -> DataFrame:
    """path, text, error from rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, SLICE_BYTES)):
            got = [_read(p.as_py(), c.as_py() or b"") for p, c in zip(batch.column(0), batch.column(1), strict=True)]
            text, error = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text, error of all files below a folder."""
    return texts(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def sentences(files: DataFrame, min_len: int = FT.MIN_LEN, max_len: int = FT.MAX_LEN) -> tuple[DataFrame, DataFrame]:
    """Sentences (path, pos, sentence) of files (path, content), each once in its first place, and what became of every file.

    The second table has path, kind, n_chars, n_sentences (different ones within the file), error and info, a line that says the same. Files are
    decoded once: texts are written before both tables read them. A blank file has no sentence and no error; files of no bytes are not listed by the source.
    """
    ws = Workspace(files.sparkSession, "files")
    got = ws.stage(texts(files).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))), "texts")
    parts = ws.stage(corpus.sentences(got.where("text is not null"), "path", min_len=min_len, max_len=max_len), "sentences")
    counts = parts.groupBy("path").agg(F.count_distinct("sentence").alias("n"))
    status = got.join(counts, "path", "left").select(
        "path",
        "kind",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
        F.coalesce("n", F.lit(0)).alias("n_sentences"),
        "error",
    )
    info = F.coalesce("error", F.format_string("%s, %d characters, %d sentences", "kind", "n_chars", "n_sentences"))
    return corpus.keep_first(parts, ["sentence"], ["path", "pos"]), status.withColumn("info", info)


def page_texts(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, text by the HTML parser; null for a null page.

    references: the character references that are read (such as "&amp;"); all others stay as they are written. None: all
    that the parser knows, those without a semicolon too.
    """
    other = None if references is None else re.compile("&(?!" + "|".join(re.escape(r[1:]) for r in references) + ")")

    def visible(html: str | None) -> str | None:
        return None if html is None else html_visible(html if other is None else other.sub("&amp;", html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible(h.as_py()) for h in batch.column(1)], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")


def parse_results(responses: DataFrame) -> DataFrame:
    """title, url, description, extra from stored search responses (column body, JSON text)."""
    kind = "web struct<results:array<struct<title:string,url:string,description:string,extra_snippets:array<string>>>>"
    hits = responses.select(F.explode(F.from_json("body", kind).web.results).alias("r"))
    empty = F.lit("")
    return hits.select(
        F.coalesce("r.title", empty).alias("title"),
        F.coalesce("r.url", empty).alias("url"),
        F.coalesce("r.description", empty).alias("description"),
        F.coalesce("r.extra_snippets", F.array().cast("array<string>")).alias("extra"),
    )


def http_hint(code: int) -> str:
    """What an error status of the search service means. Fixed values."""
    return {401: "key wrong or missing (401)", 422: "query parameters wrong (422)", 429: "rate exceeded (429), try later"}.get(code, f"HTTP {code}")
