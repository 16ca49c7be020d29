"""Parsers of office and text formats into blocks, with the standard library only."""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import html
import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple
from xml.etree import ElementTree


class Block(NamedTuple):
    text: str
    trail: tuple[str, ...] = ()
    locator: str = ""
    kind: str = "text"


Parser = Callable[[bytes, str], list[Block]]
_PARSERS: dict[str, tuple[Parser, str]] = {}


def register(*extensions: str, version: str = "1") -> Callable[[Parser], Parser]:
    """Make a function the parser of some extensions; its version tells whether a file must be parsed anew."""
    def add(parser: Parser) -> Parser:
        for e in extensions:
            _PARSERS[e] = (parser, version)
        return parser

    return add


def versions() -> dict[str, str]:
    return {e: v for e, (_, v) in _PARSERS.items()}


def decode(data: bytes) -> str:
    """Text of unknown encoding: a byte order mark decides, else UTF-8, else Windows-1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def blocks_of(path: str, data: bytes, limits_mb: dict[str, float]) -> list[tuple]:
    """Rows (path, sha, status, detail, ordinal, trail, locator, kind, text) of one file; never raises."""
    sha = hashlib.sha256(data).hexdigest()
    extension = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    only = lambda status, detail="": [(path, sha, status, detail, None, None, None, None, None)]
    if extension not in _PARSERS:
        return only("no parser", extension)
    if len(data) > limits_mb.get(extension, 100) * (1 << 20):
        return only("deferred", f"{len(data)} bytes")
    try:
        found = [b for b in _PARSERS[extension][0](data, path) if b.text.strip()]
    except Exception as error:  # a file of any kind of damage is data, not a failure of the job
        return only("error", f"{type(error).__name__}: {error}"[:500])
    return [(path, sha, "ok", "", i, list(b.trail), b.locator, b.kind, b.text) for i, b in enumerate(found)] or only("empty")


@register("txt", "log", "text")
def text(data: bytes, name: str) -> list[Block]:
    return [Block(decode(data))]


@register("md", "markdown")
def markdown(data: bytes, name: str) -> list[Block]:
    """Sections under their heading trails; fences hide headings; a section of a heading only has it as text."""
    out: list[Block] = []
    trail: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = None

    def close() -> None:
        body = "\n".join(lines).strip()
        if body or trail:
            out.append(Block(body or trail[-1][1], tuple(t for _, t in trail)))
        lines.clear()

    rows = decode(data).splitlines()
    for i, line in enumerate(rows):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark[1][:3]
        heading = None if fence or mark else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        under = None if fence or mark or not lines or not lines[-1].strip() else re.match(r"(=+|-+)\s*$", line)
        if heading:
            level, title = len(heading[1]), heading[2]
        elif under and i and rows[i - 1].strip():
            level, title = (1 if under[1][0] == "=" else 2), lines.pop().strip()
        else:
            lines.append(line)
            continue
        if any(x.strip() for x in lines) or (trail and level <= trail[-1][0]):
            close()
        lines.clear()
        while trail and trail[-1][0] >= level:
            trail.pop()
        trail.append((level, title))
    close()
    return out


@register("rtf")
def rtf(data: bytes, name: str) -> list[Block]:
    """Text of a rich text file: control words dropped, escaped bytes as Windows-1252, destinations skipped."""
    source, out, skip, depth = data.decode("latin-1"), [], None, 0
    for word, number, escaped, symbol, brace, plain in re.findall(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z'])|([{}])|([^\\{}\r\n]+)", source):
        if brace:
            depth += 1 if brace == "{" else -1
            if skip is not None and depth < skip:
                skip = None
            continue
        if symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = depth if skip is None else skip
        if skip is not None:
            continue
        if word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif escaped:
            out.append(bytes([int(escaped, 16)]).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif plain:
            out.append(plain)
    return [Block(re.sub(r"\n{3,}", "\n\n", "".join(out)).strip())]


def sniff_delimiter(head: str) -> str | None:
    """The delimiter that splits most lines into one same number of fields; none if it is prose."""
    lines = [x for x in head[:8192].splitlines() if x.strip()][:100]
    best = None
    for d in (",", ";", "\t", "|"):
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        if widths:
            width, n = widths.most_common(1)[0]
            if width > 1 and n >= 0.6 * len(lines) and (best is None or (n, width) > best[:2]):
                best = (n, width, d)
    return best[2] if best else None


WINDOW_ROWS = 30


def sheet_blocks(title: str, rows: list[list[str]]) -> list[Block]:
    """Windows of rows with the header repeated, after a card that names the sheet's columns."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return []
    head, body = rows[0], rows[1:]
    out = [Block(f"{title}: {len(body)} rows; columns: {', '.join(head)}", (title,), "", "card")]
    step = WINDOW_ROWS if len(body) <= 200 else 200
    for at in range(0, len(body), step):
        part = body[at : at + step]
        lines = [" | ".join(r) for r in [head, *part]]
        out.append(Block("\n".join(lines), (title,), f"{at + 2}-{at + 1 + len(part)}", "table"))
    return out


@register("csv", "tsv")
def delimited(data: bytes, name: str) -> list[Block]:
    source = decode(data)
    delimiter = sniff_delimiter(source)
    if delimiter is None:
        return [Block(source)]
    return sheet_blocks(name.rsplit("/", 1)[-1], list(csv.reader(io.StringIO(source), delimiter=delimiter)))


_HIDDEN = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>")
_BREAK = re.compile(r"(?i)</?(p|div|br|tr|li|h[1-6]|table|ul|ol|blockquote|hr|section|article)\b[^>]*>")


def text_of_html(source: str) -> str:
    plain = html.unescape(re.sub(r"(?s)<[^>]*>", "", _BREAK.sub("\n", _HIDDEN.sub(" ", source))))
    return re.sub(r"\n{2,}", "\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\xa0]+", " ", plain))).strip()


@register("html", "htm")
def markup(data: bytes, name: str) -> list[Block]:
    return [Block(text_of_html(decode(data)))]


#: Lines that open an older message inside a reply.
_OLDER = re.compile(r"(?im)^\s*(-{2,}\s*(original message|mensagem original)\s*-{2,}|on .{5,120} wrote:|em .{5,120} escreveu:)\s*$")
_HEADER = re.compile(r"(?i)^\s*>?\s*(to|para|sent|enviado|subject|assunto|date|data)\s*:")


def split_thread(body: str) -> list[str]:
    """Messages of a reply chain, newest first; a From: line that no other kind of header follows within four lines cuts nothing."""
    lines = body.splitlines()
    cuts = [0]
    for i, line in enumerate(lines):
        opens = re.match(r"(?i)^\s*>?\s*(from|de)\s*:", line) and sum(bool(_HEADER.match(x)) for x in lines[i + 1 : i + 5]) >= 1
        if i and (opens or _OLDER.match(line)):
            cuts.append(i)
    parts = ["\n".join(lines[a:b]).strip() for a, b in zip(cuts, [*cuts[1:], len(lines)])]
    return [p for p in parts if p]


@register("eml")
def mail(data: bytes, name: str) -> list[Block]:
    """An envelope, then a block per message of the thread, under the subject."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    subject = str(message.get("subject", "") or "").strip()
    trail = (subject,) if subject else ()
    lines = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if message[h]]
    lines += [f"Attachment: {p.get_filename()}" for p in message.iter_attachments() if p.get_filename()]
    body = message.get_body(("plain", "html"))
    content = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        content = text_of_html(content)
    return [Block("\n".join(lines), trail, "", "envelope"), *(Block(p, trail, f"message {i + 1}", "message") for i, p in enumerate(split_thread(content)))]


_CUE = re.compile(r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*(?:-->|,)\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")
PARAGRAPH_CHARS, SILENCE_S = 1500, 8.0


def _seconds(mark: str) -> float:
    total = 0.0
    for part in mark.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def cues(source: str) -> list[tuple[float, float, str, str]]:
    """(start, end, speaker, text) of every cue of a VTT, SRT or SBV transcript."""
    out = []
    for chunk in re.split(r"\n\s*\n", source.replace("\r\n", "\n")):
        lines = chunk.strip().split("\n")
        at = next((i for i, x in enumerate(lines) if _CUE.match(x)), None)
        if at is None or lines[0].startswith("NOTE"):
            continue
        start, end = _CUE.match(lines[at]).groups()
        body = " ".join(x.strip() for x in lines[at + 1 :])
        voice = re.match(r"<v\s+([^>]+)>", body)
        body = html.unescape(re.sub(r"<[^>]*>", "", body)).strip()
        loose = None if voice else re.match(r"([A-ZÀ-Ý][\w .'-]{1,40}):\s+(.*)", body)
        speaker = voice[1] if voice else loose[1] if loose else ""
        if body:
            out.append((_seconds(start), _seconds(end), speaker, loose[2] if loose else body))
    return out


@register("vtt", "srt", "sbv")
def transcript(data: bytes, name: str) -> list[Block]:
    """Paragraphs of a transcript, cut at a long silence or when long enough; captions that roll on are absorbed."""
    out: list[Block] = []
    words: list[str] = []
    begin = last_end = 0.0
    speaker = before = ""

    def close() -> None:
        if words:
            minutes, rest = divmod(int(begin), 60)
            out.append(Block(" ".join(words), (), f"{minutes // 60}:{minutes % 60:02d}:{rest:02d}" if minutes >= 60 else f"{minutes:02d}:{rest:02d}", "transcript"))
            words.clear()

    for start, end, voice, body in cues(decode(data)):
        if words and (start - last_end >= SILENCE_S or sum(map(len, words)) + len(words) >= PARAGRAPH_CHARS):
            close()
            speaker = ""
        if not words:
            begin = start
        last_end = max(last_end, end)
        if before and body.startswith(before):  # a rolling caption repeats the line before it
            body, before = body[len(before) :].strip(), body
        else:
            before = body
        if body:
            words.append(f"{voice}: {body}" if voice and voice != speaker else body)
            speaker = voice or speaker
    close()
    return out


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(n.text or "" for n in node.iter() if _tag(n) == name)


@register("docx")
def word(data: bytes, name: str) -> list[Block]:
    """Paragraphs under their heading trail, and tables, in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = next(n for n in _xml(archive, "word/document.xml").iter() if _tag(n) == "body")
    out: list[Block] = []
    trail: list[tuple[int, str]] = []
    for node in body:
        if _tag(node) == "tbl":
            rows = [[_texts(c) for c in r if _tag(c) == "tc"] for r in node if _tag(r) == "tr"]
            out.append(Block("\n".join(" | ".join(r) for r in rows), tuple(t for _, t in trail), "", "table"))
        elif _tag(node) == "p":
            content = _texts(node).strip()
            style = next((v for n in node.iter() if _tag(n) == "pStyle" for k, v in n.attrib.items() if k.endswith("val")), "")
            level = re.match(r"(?i)(?:heading|titulo|título|ttulo)\s*(\d)", style)
            if level and content:
                while trail and trail[-1][0] >= int(level[1]):
                    trail.pop()
                trail.append((int(level[1]), content))
            elif content:
                out.append(Block(content, tuple(t for _, t in trail)))
    return out


@register("pptx")
def slides(data: bytes, name: str) -> list[Block]:
    """A block per slide under its title, and one per slide's notes."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        names = archive.namelist()
        for slide in sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number):
            parts = [_texts(p).strip() for p in _xml(archive, slide).iter() if _tag(p) == "p"]
            parts = [p for p in parts if p]
            trail = (parts[0],) if parts else ()
            out.append(Block("\n".join(parts), trail, f"slide {number(slide)}", "slide"))
            notes = f"ppt/notesSlides/notesSlide{number(slide)}.xml"
            if notes in names:
                out.append(Block("\n".join(filter(None, (_texts(p).strip() for p in _xml(archive, notes).iter() if _tag(p) == "p"))), trail, f"slide {number(slide)}", "notes"))
    return out


@register("xlsx")
def workbook(data: bytes, name: str) -> list[Block]:
    """Windows of rows of every sheet."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = [_texts(s) for s in _xml(archive, "xl/sharedStrings.xml") if _tag(s) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [n.attrib.get("name", "") for n in _xml(archive, "xl/workbook.xml").iter() if _tag(n) == "sheet"]
        sheets = sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
        for title, sheet in zip(titles, sheets):
            rows: list[list[str]] = []
            for row in (n for n in _xml(archive, sheet).iter() if _tag(n) == "row"):
                values: dict[int, str] = {}
                for i, cell in enumerate(c for c in row if _tag(c) == "c"):
                    letters = re.match(r"[A-Z]*", cell.attrib.get("r", ""))[0]
                    column = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters))) - 1 if letters else i
                    raw = next((v.text or "" for v in cell if _tag(v) == "v"), "")
                    kind = cell.attrib.get("t")
                    values[column] = shared[int(raw)] if kind == "s" and raw else _texts(cell) if kind == "inlineStr" else raw[:-2] if raw.endswith(".0") else raw
                rows.append([values.get(i, "") for i in range(max(values, default=-1) + 1)])
            out += sheet_blocks(title, rows)
    return out
