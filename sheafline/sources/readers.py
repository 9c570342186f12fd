"""Files to documents: one Arrow-batched pass over ``binaryFile`` rows, one row out for each file, errors in columns.

DOCX, EML and legacy DOC (scraped) are read with the standard library. PDF, MSG, recognition of page images and external
converters are optional: without their library or program a file gets ``reader_error = dependency_missing``.
"""

from __future__ import annotations

import email
import email.policy
import importlib.util
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.sources import markup

SUFFIXES = ("pdf", "docx", "doc", "eml", "msg")
#: Limits of recognition and of external converters.
OCR_PAGES, OCR_DPI, CONVERTER_SECONDS = 2, 300, 30
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

LINE = pa.struct([("text", pa.string()), ("page_index", pa.int32()), ("line_index", pa.int32()), ("bbox", pa.list_(pa.float64())), ("block_id", pa.string()), ("confidence", pa.float64())])
SCHEMA = (
    "source_path string, source_type string, plain_text string, lines array<struct<text:string,page_index:int,line_index:int,bbox:array<double>,block_id:string,confidence:double>>, "
    "raw_lines array<string>, reader_notes array<string>, metadata map<string,string>, reader_error string"
)


class ReaderError(Exception):
    code = "reader_error"


class UnsupportedFormat(ReaderError):
    code = "unsupported_format"


class DependencyMissing(ReaderError):
    code = "dependency_missing"


def _clean(s: str) -> str:
    return s.replace("\r", " ").replace("\t", " ").strip()


def _keep_first(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(block, text) without blanks and later repeats, whatever their case."""
    seen, out = set(), []
    for block, text in rows:
        t = _clean(text)
        if t and t.lower() not in seen:
            seen.add(t.lower())
            out.append((block, t))
    return out


def _document(kind: str, rows: list[dict], plain: str, raw: list[str], notes=(), meta=None) -> dict:
    full = {"page_index": 0, "bbox": None, "block_id": None, "confidence": 1.0}
    return {"source_type": kind, "plain_text": plain, "lines": [full | r for r in rows], "raw_lines": raw, "reader_notes": list(notes), "metadata": list((meta or {}).items()), "reader_error": None}


def _text(node) -> str:
    """The text of a paragraph without that of text boxes inside it."""
    out = ""
    for n in node:
        if n.tag.endswith("}txbxContent") or n.tag.endswith("}textbox"):
            continue
        if n.tag == f"{W}t":
            out += n.text or ""
        elif n.tag == f"{W}tab":
            out += " "
        elif n.tag in (f"{W}br", f"{W}cr"):
            out += "\n"
        else:
            out += _text(n)
    return out


def _paragraphs(root) -> list[str]:
    return [t for p in root.iter(f"{W}p") for t in _text(p).split("\n")]


def read_docx(raw: bytes) -> dict:
    """Title and headers, paragraphs, tables (cells joined by bars), text boxes, footers; later repeats dropped."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        part = lambda n: ElementTree.fromstring(z.read(n))
        rows: list[tuple[str, str]] = []
        if "docProps/core.xml" in names:
            rows += [("header", n.text or "") for n in part("docProps/core.xml").iter() if n.tag.endswith("}title")]
        for n in sorted(x for x in names if re.match(r"word/header\d*\.xml$", x)):
            rows += [("header", t) for t in _paragraphs(part(n))]
        body = part("word/document.xml").find(f"{W}body")
        boxes = []
        for n in sorted(x for x in names if x.startswith("word/") and x.endswith(".xml")):
            for e in part(n).iter():
                if e.tag.endswith("}txbxContent") or e.tag.endswith("}textbox"):
                    boxes += [("textbox", t) for t in _paragraphs(e)]
        table = 0
        tables = []
        for e in body:
            if e.tag == f"{W}p":
                rows += [("body", t) for t in _text(e).split("\n")]
            elif e.tag == f"{W}tbl":
                for tr in e.iter(f"{W}tr"):
                    cells = [" ".join(x for x in map(_clean, _paragraphs(tc)) if x) for tc in tr.findall(f"{W}tc")]
                    tables.append((f"table_{table}", " | ".join(c for c in cells if c)))
                table += 1
        rows += tables + boxes
        for n in sorted(x for x in names if re.match(r"word/footer\d*\.xml$", x)):
            rows += [("footer", t) for t in _paragraphs(part(n))]
    kept = _keep_first(rows)
    lines = [{"text": t, "line_index": i, "block_id": b} for i, (b, t) in enumerate(kept)]
    text = "\n".join(t for _, t in kept)
    return _document("docx", lines, text, text.split("\n") if text else [], meta={"line_groups": ",".join(sorted({b for b, _ in kept}))})


def _mail(headers: list[tuple[str, str]], body: str, kind: str, tail: str = "") -> dict:
    text = "\n".join(f"{k}: {v}" for k, v in headers if v) + "\n\n" + re.sub("\n{3,}", "\n\n", body.replace("\r\n", "\n").replace("\r", "\n")).strip()
    text += f"\n\n{tail}" if tail else ""
    raw = text.split("\n")
    seen, lines = set(), []
    for i, t in enumerate(raw):
        t = _clean(t)
        if t and t.lower() not in seen:
            seen.add(t.lower())
            lines.append({"text": t, "line_index": i})
    return _document(kind, lines, text, raw, meta={"email_source_type": kind})


def read_eml(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, rich = [], []
    for p in m.walk():
        if p.is_multipart() or p.get_content_disposition() == "attachment" or p.get_content_maintype() != "text":
            continue
        try:
            content = p.get_content()
        except (LookupError, UnicodeError):
            content = markup.decode(p.get_payload(decode=True))
        (rich if p.get_content_subtype() == "html" else plain).append(content)
    body = "\n\n".join(plain) if any(x.strip() for x in plain) else "\n\n".join(map(markup.html_text, rich))
    return _mail([(h, str(m.get(h) or "")) for h in ("Subject", "From", "To", "Date")], body, "eml")


def read_msg(raw: bytes) -> dict:
    if importlib.util.find_spec("extract_msg") is None:
        raise DependencyMissing("extract_msg is not installed")
    import extract_msg

    with extract_msg.openMsg(io.BytesIO(raw)) as m:
        body = markup.decode(m.body)
        if markup.looks_like_html(body):
            body = markup.html_text(body)
        if not body.strip():
            body = markup.html_text(markup.decode(m.htmlBody)) if m.htmlBody else markup.rtf_text(markup.decode(m.rtfBody), mail=True)
        names = ", ".join(a.longFilename or a.shortFilename or "" for a in m.attachments)
        return _mail([("Subject", m.subject), ("From", m.sender), ("To", m.to), ("Cc", m.cc), ("Date", str(m.date or ""))], body, "msg", f"Attachments: {names}" if names else "")


def _convert(raw: bytes, command: list[str], result: str | None) -> bytes:
    if shutil.which(command[0]) is None:
        raise DependencyMissing(f"{command[0]} is not installed")
    with tempfile.TemporaryDirectory() as d:
        src = Path(d, "in.doc")
        src.write_bytes(raw)
        done = subprocess.run([x.format(src=src, dir=d) for x in command], capture_output=True, timeout=CONVERTER_SECONDS, check=True)
        return Path(d, result).read_bytes() if result else done.stdout


def read_doc(raw: bytes) -> dict:
    """LibreOffice, antiword, then scraping the bytes; what failed is noted."""
    notes = []
    for name, read in (
        ("soffice", lambda: read_docx(_convert(raw, ["soffice", "--headless", "--convert-to", "docx", "--outdir", "{dir}", "{src}"], "in.docx"))["plain_text"]),
        ("antiword", lambda: _convert(raw, ["antiword", "{src}"], None).decode("utf-8", "ignore")),
        ("scrape", lambda: markup.scrape(raw)),
    ):
        try:
            text = read()
        except Exception as e:  # each step of the ladder may fail in its own way  # noqa: BLE001
            notes.append(f"{name}: {e}")
            continue
        kept = _keep_first([("body", t) for t in text.splitlines()])
        return _document("doc", [{"text": t, "line_index": i, "block_id": "body"} for i, (_, t) in enumerate(kept)], text, text.split("\n"), notes)
    raise ReaderError("; ".join(notes))


def read_pdf(raw: bytes) -> dict:
    """Layout lines with boxes, plain page text, recognition of page images, then a second library."""
    rows, notes, pages, images = [], [], 0, []
    if importlib.util.find_spec("fitz"):
        import fitz

        doc = fitz.open(stream=raw, filetype="pdf")
        pages = len(doc)
        for p, page in enumerate(doc):
            k = 0
            for block in page.get_text("dict", sort=True)["blocks"]:
                for line in block.get("lines", []) if block.get("type", 0) == 0 else ():
                    t = _clean("".join(s["text"] for s in line["spans"]))
                    if t:
                        rows.append({"text": t, "page_index": p, "line_index": k, "bbox": list(line["bbox"]), "block_id": str(block.get("number"))})
                        k += 1
            if not k:
                for t in filter(None, map(_clean, page.get_text("text").splitlines())):
                    rows.append({"text": t, "page_index": p, "line_index": k, "confidence": 0.9})
                    k += 1
            images.append(len(page.get_images()))
        if not rows and needs_ocr(pages, images) and importlib.util.find_spec("pytesseract"):
            import pytesseract
            from PIL import Image

            try:
                seen = []
                for p, page in enumerate(doc):
                    text = pytesseract.image_to_string(Image.open(io.BytesIO(page.get_pixmap(dpi=OCR_DPI).tobytes("png"))), lang="eng")
                    seen += [{"text": t, "page_index": p, "line_index": k, "confidence": 0.7} for k, t in enumerate(filter(None, map(_clean, text.splitlines())))]
                rows = seen
                notes.append("text recognised from page images")
            except Exception as e:  # one page that fails ends the recognition  # noqa: BLE001
                notes.append(f"recognition failed: {e}")
    if not rows and importlib.util.find_spec("pypdf"):
        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(raw))
        pages = len(reader.pages)
        for p, page in enumerate(reader.pages):
            text = uni(page.extract_text() or "")
            rows += [{"text": t, "page_index": p, "line_index": k, "confidence": 0.8} for k, t in enumerate(filter(None, map(_clean, text.splitlines())))]
    elif not pages:
        raise DependencyMissing("no library for PDF is installed")
    text = "\n".join(r["text"] for r in rows)
    return _document("pdf", rows, text, text.split("\n") if text else [], notes, {"page_count": str(pages), "ocr_page_limit": str(OCR_PAGES)})


def needs_ocr(pages: int, images: list[int]) -> bool:
    """Recognition is tried for one or two pages of one image each."""
    return 1 <= pages <= OCR_PAGES and all(n == 1 for n in images)


def uni(s: str) -> str:
    """``/uniXXXX`` names decoded."""
    return re.sub(r"/uni([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), s)


READERS = {"pdf": read_pdf, "docx": read_docx, "doc": read_doc, "eml": read_eml, "msg": read_msg}


def read_one(path: str, raw: bytes) -> dict:
    """The document of a file, or its error; never raises."""
    kind = path.rpartition(".")[2].lower() if "." in path else ""
    try:
        if kind not in READERS:
            raise UnsupportedFormat(f"no reader for {kind!r}")
        return {"source_path": path} | READERS[kind](raw)
    except ReaderError as e:
        code, why = e.code, str(e)
    except Exception as e:  # a broken file is a row, not the end of the batch  # noqa: BLE001
        code, why = "reader_error", f"{type(e).__name__}: {e}"
    return {"source_path": path, "source_type": kind, "plain_text": None, "lines": [], "raw_lines": [], "reader_notes": [why], "metadata": [], "reader_error": code}


def read_content(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Documents of rows of paths and bytes; the bytes are dropped at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_one(p, c or b"") for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            col = lambda k, t: pa.array([g[k] for g in got], t)
            yield pa.RecordBatch.from_arrays([
                col("source_path", pa.string()), col("source_type", pa.string()), col("plain_text", pa.string()), col("lines", pa.list_(LINE)), col("raw_lines", pa.list_(pa.string())),
                col("reader_notes", pa.list_(pa.string())), col("metadata", pa.map_(pa.string(), pa.string())), col("reader_error", pa.string()),
            ], names=["source_path", "source_type", "plain_text", "lines", "raw_lines", "reader_notes", "metadata", "reader_error"])

    return files.select(path, content).mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The supported files of a folder as rows of path and content; the filter runs before any file is opened."""
    both = ",".join(x for s in suffixes for x in (s, s.upper()))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + both + "}").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def from_base64(df: DataFrame, path: str, data: str) -> DataFrame:
    return df.select(F.col(path).alias("path"), F.unbase64(data).alias("content"))


def images(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """source_path, name, image of the pictures in DOCX files (and of PDF files where a library is installed); broken files give none."""

    def of(p: str, raw: bytes) -> list[tuple[str, bytes]]:
        try:
            if p.lower().endswith(".docx"):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    return [(n.rpartition("/")[2], z.read(n)) for n in sorted(z.namelist()) if n.startswith("word/media/")]
            if p.lower().endswith(".pdf") and importlib.util.find_spec("fitz"):
                import fitz

                doc = fitz.open(stream=raw, filetype="pdf")
                return [(f"page{i}_{x[0]}.{(e := doc.extract_image(x[0]))['ext']}", e["image"]) for i, page in enumerate(doc) for x in page.get_images()]
        except Exception:  # noqa: BLE001
            return []
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, i) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, i in of(p, c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["source_path", "name", "image"])

    return files.select(path, content).mapInArrow(run, "source_path string, name string, image binary")
