"""Office files (zipped XML) as chunks, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from .cells import parsed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relations of a part: id to (type, path in the archive)."""
    folder, _, name = part.rpartition("/")
    rels = _xml(z, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in rels if rels is not None else ():
        steps: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for step in r.get("Target", "").lstrip("/").split("/"):
            if step == "..":
                steps.pop()
            elif step != ".":
                steps.append(step)
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], "/".join(steps))
    return out


def parse_docx(content: bytes, document_id: str) -> Iterator[tuple]:
    """Paragraphs with text; those in style ``heading N`` open a section of that level."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root, styles = _xml(z, "word/document.xml"), _xml(z, "word/styles.xml")
    names = {s.get(f"{_W}styleId"): (s.find(f"{_W}name").get(f"{_W}val") or "") for s in (styles.iter(f"{_W}style") if styles is not None else ()) if s.find(f"{_W}name") is not None}
    section: list[str] = []
    ordinal = 0
    body = root.find(f"{_W}body") if root is not None else None
    for i, p in enumerate(body.findall(f"{_W}p") if body is not None else ()):
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style_id = style.get(f"{_W}val") if style is not None else ""
        level = re.fullmatch(r"heading ?(\d+)", (names.get(style_id) or style_id or "").lower())
        if level:
            section = section[: int(level[1]) - 1] + [text]
        yield (f"{document_id}:docx:p{i + 1}", document_id, "docx", text, "heading" if level else "paragraph", None, list(section), f"Paragraph: {i + 1}", ordinal)
        ordinal += 1


#: The built-in number formats that are dates or times.
DATE_FORMATS = frozenset((*range(14, 23), 45, 46, 47))


def _kinds(z: zipfile.ZipFile) -> list[str]:
    """By a cell's style: "date", "span" (a number of hours that may pass a day) or ""."""
    styles = _xml(z, "xl/styles.xml")
    if styles is None:
        return []
    codes = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}

    def kind(number: int) -> str:
        code = codes.get(number)
        if code is None:
            return "span" if number == 46 else "date" if number in DATE_FORMATS else ""
        first = re.sub(r'"[^"]*"|\\.|[_*].', "", code.split(";")[0])
        if re.search(r"\[(h+|m+|s+)\]", first, re.IGNORECASE):
            return "span"
        return "date" if re.search("[dmhys]", re.sub(r"\[[^\]]*\]", "", first), re.IGNORECASE) else ""

    formats = styles.find(f"{_S}cellXfs")
    return [kind(int(x.get("numFmtId", "0"))) for x in (formats if formats is not None else ())]


def _shown(raw: str, kind: str, epoch: datetime, leap: bool) -> str:
    """A stored number as its value is written: a whole number, a float, or by its ``kind`` a date, time or span.

    Days count from ``epoch``; the first two months of 1900 are a day late (``leap``).
    """
    number = float(raw)
    if kind == "span":
        return str(timedelta(milliseconds=round(number * 86_400_000)))
    if kind == "date":
        days = number + (1 if leap and 1 <= number < 60 else 0)
        try:
            at = epoch + timedelta(milliseconds=round(days * 86_400_000))
        except OverflowError:
            return raw
        return str(at.time()) if 0 <= number < 1 else str(at)
    return raw if raw.lstrip("-").isdigit() else str(number)


def parse_xlsx(content: bytes, document_id: str) -> Iterator[tuple]:
    """Cells with a stored value, sheet by sheet, as their values are: dates, times, True and False, numbers, texts.

    A formula counts by its last result.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in (shared.findall(f"{_S}si") if shared is not None else ())]
        book, targets, kinds = _xml(z, "xl/workbook.xml"), _targets(z, "xl/workbook.xml"), _kinds(z)
        settings = book.find(f"{_S}workbookPr") if book is not None else None
        late = settings is not None and settings.get("date1904") in ("1", "true")
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        ordinal = 0
        for sheet in book.iter(f"{_S}sheet") if book is not None else ():
            page = _xml(z, targets.get(sheet.get(f"{_R}id", ""), ("", ""))[1])
            for cell in page.iter(f"{_S}c") if page is not None else ():
                value, form = cell.find(f"{_S}v"), cell.get("t", "n")
                if form == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                elif value is None or value.text is None:
                    continue
                elif form == "s":
                    text = strings[int(value.text)]
                elif form == "b":
                    text = str(value.text == "1")
                elif form == "d":
                    text = str(datetime.fromisoformat(value.text))
                elif form == "n":
                    style = int(cell.get("s", "0"))
                    text = _shown(value.text, kinds[style] if style < len(kinds) else "", epoch, not late)
                else:
                    text = value.text
                if text.strip():
                    name, at = sheet.get("name", ""), cell.get("r", "")
                    yield (f"{document_id}:xlsx:{name}:{at}", document_id, "xlsx", text.strip(), "cell", None, [name], f"Sheet: {name}, Cell: {at}", ordinal)
                    ordinal += 1


def parse_pptx(content: bytes, document_id: str) -> Iterator[tuple]:
    """Shapes with text as paragraphs and speaker notes as captions; a slide is a page."""
    def texts(shape: ElementTree.Element) -> str:
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")).strip()

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        show, targets = _xml(z, "ppt/presentation.xml"), _targets(z, "ppt/presentation.xml")
        ordinal = 0
        for n, slide_id in enumerate(show.iter(f"{_P}sldId") if show is not None else (), 1):
            part = targets.get(slide_id.get(f"{_R}id", ""), ("", ""))[1]
            slide = _xml(z, part)
            found = [(texts(s), "paragraph") for s in (slide.iter(f"{_P}sp") if slide is not None else ())]
            for kind, target in _targets(z, part).values():
                notes = _xml(z, target) if kind == "notesSlide" else None
                for s in notes.iter(f"{_P}sp") if notes is not None else ():
                    place = s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    if place is not None and place.get("type") == "body":
                        found.append((texts(s), "caption"))
            for k, (text, kind) in enumerate(x for x in found if x[0]):
                yield (f"{document_id}:pptx:s{n}:{k}", document_id, "pptx", text, kind, n, [], f"Slide: {n}", ordinal)
                ordinal += 1


PARSERS = {"docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx}


def chunks(files: DataFrame, fmt: str, skip_damaged: bool = False) -> DataFrame:
    return parsed(files, PARSERS[fmt], skip_damaged)
