"""Extractors: bytes of one file to text or cells, with the standard library alone."""

from __future__ import annotations

import base64
import csv
import email
import email.policy
import io
import quopri
import re
import zipfile
from collections.abc import Callable
from email.header import decode_header
from xml.etree import ElementTree

from sumiveil.functions.charset import decode_bytes, decode_named
from sumiveil.functions.patterns import MAIL_HEADERS, NARROW_SPACE, RUBY

MAX_ENTRY = 256 * 1024 * 1024
MAX_DEPTH, MAX_PARTS = 20, 512
_RUBY = re.compile(RUBY)


def strip_ruby(text: str) -> str:
    return _RUBY.sub("", text)


def trim(text: str) -> str:
    return text.strip(NARROW_SPACE)


def entry(data: bytes, name: str) -> bytes:
    """An archive's entry, refused if it declares more than ``MAX_ENTRY`` bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo(name).file_size > MAX_ENTRY:
            raise ValueError("an entry of the archive is too large")
        return z.read(name)


def entries(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.namelist()


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _named(node, name: str):
    return [x for x in node.iter() if _local(x) == name]


def _runs(node) -> str:
    return "".join(x.text or "" for x in _named(node, "t"))


def plain(data: bytes) -> str:
    return strip_ruby(decode_bytes(data))


def csv_rows(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of quoted text, ragged as they are; blank lines give none."""
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def docx(data: bytes) -> str:
    """Body paragraphs and tables (a row's cells joined by tabs), in order."""
    body = _named(ElementTree.fromstring(entry(data, "word/document.xml")), "body")
    out: list[str] = []
    for block in body[0] if body else []:
        if _local(block) == "p":
            out.append(_runs(block))
        elif _local(block) == "tbl":
            for row in (x for x in block if _local(x) == "tr"):
                cells = (trim("\n".join(_runs(p) for p in _named(c, "p"))) for c in row if _local(c) == "tc")
                out.append("\t".join(c for c in cells if c))
    return strip_ruby("\n".join(x for x in out if trim(x)))


def _shapes(tree, out: list[str]) -> None:
    for shape in tree:
        kind = _local(shape)
        if kind == "grpSp":
            _shapes(shape, out)
        elif kind == "graphicFrame":
            out.extend(_runs(c) for table in _named(shape, "tbl") for c in _named(table, "tc"))
        elif kind == "sp":
            out.extend(_runs(p) for body in shape if _local(body) == "txBody" for p in _named(body, "p"))


def pptx(data: bytes) -> str:
    """Slides in the order of their numbers; notes are marked."""
    names = entries(data)
    out: list[str] = []
    for n in sorted(int(m[1]) for x in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x))):
        for tree in _named(ElementTree.fromstring(entry(data, f"ppt/slides/slide{n}.xml")), "spTree"):
            _shapes(tree, out)
        links = f"ppt/slides/_rels/slide{n}.xml.rels"
        if links in names and (m := re.search(r'notesSlides/(notesSlide\d+\.xml)"', entry(data, links).decode("utf-8", "replace"))):
            for shape in _named(ElementTree.fromstring(entry(data, f"ppt/notesSlides/{m[1]}")), "sp"):
                if any(x.get("type") == "body" for x in _named(shape, "ph")) and trim(text := "\n".join(_runs(p) for p in _named(shape, "p"))):
                    out.append("[ノート] " + text)
    return strip_ruby("\n".join(x for x in out if trim(x)))


def shared_strings(data: bytes) -> list[str]:
    if "xl/sharedStrings.xml" not in entries(data):
        return []

    def text(node) -> str:
        return "" if _local(node) == "rPh" else (node.text or "") if _local(node) == "t" else "".join(map(text, node))

    return [text(si) for si in ElementTree.fromstring(entry(data, "xl/sharedStrings.xml")) if _local(si) == "si"]


def sheets(data: bytes) -> list[tuple[str, str]]:
    """(name, path) of the sheets, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(entry(data, "xl/_rels/workbook.xml.rels"))}
    out = []
    for s in _named(ElementTree.fromstring(entry(data, "xl/workbook.xml")), "sheet"):
        target = links.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        if target:
            out.append((s.get("name") or "", target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def column_of(reference: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(xml: bytes, shared: list[str]) -> list[tuple[int, int, str]]:
    """(row, column, text) of the filled cells; both count from 1, rows as the sheet numbers them."""
    out, row_at = [], 0
    for row in _named(ElementTree.fromstring(xml), "row"):
        row_at = int(row.get("r") or row_at + 1)
        col = 0
        for c in (x for x in row if _local(x) == "c"):
            col = column_of(c.get("r")) + 1 if c.get("r") else col + 1
            value = next((x.text or "" for x in c if _local(x) == "v"), "")
            if c.get("t") == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif c.get("t") == "inlineStr":
                value = "".join(_runs(x) for x in c if _local(x) == "is")
            if value:
                out.append((row_at, col, value))
    return out


def xlsx_cells(data: bytes, sheet: str | None = None) -> list[tuple[int, int, str]]:
    """Cells of the named sheet, or of the first where there is none of that name."""
    found = sheets(data)
    path = dict(reversed(found)).get(sheet or "", found[0][1] if found else "")
    return sheet_cells(entry(data, path), shared_strings(data)) if path else []


def xlsx(data: bytes) -> str:
    """Rows as lines of tab-joined filled cells, sheet after sheet."""
    shared, out = shared_strings(data), []
    for _, path in sheets(data):
        rows: dict[int, list[tuple[int, str]]] = {}
        for r, c, v in sheet_cells(entry(data, path), shared):
            if trim(v):
                rows.setdefault(r, []).append((c, trim(v)))
        out.extend("\t".join(v for _, v in sorted(rows[r])) for r in sorted(rows))
    return strip_ruby("\n".join(out))


def header_text(value: str) -> str:
    """An encoded header; words in an unknown charset stay as they are written."""
    out, raw = [], value.encode("utf-8", "surrogateescape")
    if not value.isascii():
        value = decode_bytes(raw)
    for part, charset in decode_header(value):
        if isinstance(part, bytes):
            text = decode_named((charset or "utf-8").split("*")[0], part)
            out.append(text if text is not None else part.decode("latin-1") if charset is None else f"=?{charset}?B?{base64.b64encode(part).decode()}?=")
        else:
            out.append(part)
    return "".join(out)


def html_text(html: str) -> str:
    for tag in ("script", "style", "head"):
        html = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "", html)
    text = re.sub("<[^>]+>", "\n", html)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = text.replace(entity, char)
    return "\n".join(x for x in map(trim, text.splitlines()) if x)


def dewrap(text: str) -> str:
    return "".join(x.replace("\n", "") if "。" in x else x for x in re.split(r"(\n[ \t]*\n)", text))


def eml(data: bytes) -> dict:
    """text, attachments (names only) and error of a message."""
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    bodies: dict[str, str] = {}
    attachments: list[str] = []
    state = {"parts": 0, "bad": False}

    def walk(part, depth: int) -> None:
        state["parts"] += 1
        if depth > MAX_DEPTH or state["parts"] > MAX_PARTS:
            return
        name = part.get_filename()
        kind = part.get_content_type()
        if name or part.get_content_disposition() == "attachment" or kind == "message/rfc822":
            attachments.append(header_text(str(name)) if name else "(名前のない添付)")
            return
        if part.is_multipart():
            for p in part.get_payload():
                walk(p, depth + 1)
        elif kind in ("text/plain", "text/html") and kind not in bodies:
            raw = part.get_payload(decode=False)
            raw = raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else b""
            coding = (part.get("Content-Transfer-Encoding") or "").strip().lower()
            if coding == "base64":
                raw = part.get_payload(decode=True) or b""
            elif coding == "quoted-printable":
                raw = quopri.decodestring(raw)
            text = decode_named(part.get_content_charset(), raw) if part.get_content_charset() else decode_bytes(raw)
            if text is None:
                state["bad"] = True
            elif trim(text := text.replace("\r\n", "\n")):
                bodies[kind] = text

    walk(message, 0)
    body = dewrap(bodies["text/plain"]) if "text/plain" in bodies else html_text(bodies["text/html"]) if "text/html" in bodies else ""
    get = lambda k: header_text(str(message[k])) if message[k] else ""
    lines = [f"{label}: {get(key)}" for label, key in (("件名", "Subject"), ("差出人", "From"), ("宛先", "To"), ("Cc", "Cc")) if get(key)]
    rest = [f"{k}: {get(k)}" for k in MAIL_HEADERS if k not in ("From", "To", "Cc") and get(k)]
    if rest:
        lines += ["", "【ヘッダ】", *rest]
    error = "" if trim(body) else "the body's charset is not supported" if state["bad"] else "there is no body"
    text = "\n".join(lines) + ("\n\n" if lines else "") + body
    if attachments:
        text += "\n\n【添付ファイル】\n" + "\n".join(attachments)
    return {"text": strip_ruby(text) if not error else "", "attachments": attachments, "error": error}


#: Extractors by extension; ``register`` adds those that need a library (PDF, MSG).
EXTRACTORS: dict[str, Callable[[bytes], str | dict]] = {"txt": plain, "md": plain, "csv": plain, "docx": docx, "pptx": pptx, "xlsx": xlsx, "eml": eml}


def register(extension: str, extractor: Callable[[bytes], str | dict]) -> None:
    EXTRACTORS[extension.lower()] = extractor


def extract(path: str, data: bytes, extractors: dict | None = None) -> dict:
    """kind, text, attachments and error of a file; errors never carry its contents, nor its text an error."""
    extension = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    known = EXTRACTORS if extractors is None else extractors
    if extension not in known:
        return {"kind": "skipped", "text": "", "attachments": [], "error": f"no extractor for .{extension}"}
    try:
        out = known[extension](data)
    except Exception as e:  # a broken file is a row with an error, not the end of the job
        return {"kind": "skipped", "text": "", "attachments": [], "error": type(e).__name__}
    out = {"text": out, "attachments": [], "error": ""} if isinstance(out, str) else out
    kind = {"txt": "text", "md": "text", "csv": "text", "xlsx": "xlsx-prose"}.get(extension, extension)
    return {"kind": "skipped" if out["error"] else kind, **out}
