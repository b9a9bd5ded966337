"""Word and spreadsheet files as relations, with the standard library's zip and XML readers.

A document becomes rows of ``cell``, ``paragraph``, ``run`` and ``xml_node``; the same tree is edited in place to write values.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
BODY = "word/document.xml"


def q(tag: str) -> str:
    return f"{{{W}}}{tag}"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _names(data: bytes) -> None:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not prefix.startswith("ns") or not prefix[2:].isdigit():
            ET.register_namespace(prefix, uri)


class Docx:
    """The body tree of a .docx and the archive around it."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        data = self.archive.read(BODY)
        _names(data)
        self.root = ET.fromstring(data)
        self.body = self.root.find(q("body"))

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.archive.infolist():
                data = ET.tostring(self.root, encoding="UTF-8", xml_declaration=True) if item.filename == BODY else self.archive.read(item.filename)
                z.writestr(item.filename, data)
        return out.getvalue()

    def paragraphs(self) -> list:
        return [] if self.body is None else self.body.findall(q("p"))

    def tables(self) -> list:
        return [] if self.body is None else self.body.findall(q("tbl"))


def run_text(r) -> str:
    out = []
    for x in r:
        tag = local(x.tag)
        out.append(x.text or "" if tag == "t" else "\t" if tag == "tab" else "\n" if tag in ("br", "cr") else "")
    return "".join(out)


def paragraph_text(p) -> str:
    return "".join(run_text(r) for r in p.iter(q("r")))


def cell_text(tc) -> str:
    return "\n".join(paragraph_text(p) for p in tc.findall(q("p")))


def _value(x, path: str, default=None):
    found = x.find("/".join(q(p) for p in path.split("/")))
    return default if found is None else found.get(q("val"), "")


def spans(tc) -> tuple[int, str | None]:
    span = _value(tc, "tcPr/gridSpan", "1") or "1"
    return (int(span) if span.isdigit() else 1), _value(tc, "tcPr/vMerge")


def grid(table) -> list[list[dict]]:
    """Rows of cells with all four ordinals. A cell that continues a vertical merge shows the text of its origin and is, as an element,
    the origin; unique ordinals count elements a row, first place only."""
    above: dict[int, dict] = {}
    rows = []
    for r, tr in enumerate(table.findall(q("tr"))):
        cells, start, seen, expanded = [], 0, {}, 0
        now: dict[int, dict] = {}
        for ord_, tc in enumerate(tr.findall(q("tc"))):
            span, merge = spans(tc)
            origin = above.get(start) if merge is not None and merge != "restart" else None
            home = origin or {"element": tc, "r": r, "text": cell_text(tc)}
            key = id(home["element"])
            first = key not in seen
            if first:
                seen[key] = len(seen)
            cells.append(
                {"tc": tc, "r": r, "c_unique": seen[key] if first else None, "c_expanded": list(range(expanded, expanded + span)), "tc_ord": ord_, "grid_start": start, "grid_span": span, "vmerge_raw": merge, "origin_r": home["r"], "text": home["text"], "own_text": cell_text(tc)}
            )
            for g in range(start, start + span):
                now[g] = home
            start += span
            expanded += span
        above = now
        rows.append(cells)
    return rows


def style(tc) -> tuple[str | None, float | None, str | None]:
    """STY1: shading, first font size in points, first alignment."""
    fill = tc.find(f"{q('tcPr')}/{q('shd')}")
    size = next((x.get(q("val")) for x in tc.iter(q("sz"))), None)
    align = next((x.get(q("val")) for x in tc.iter(q("jc"))), None)
    return (None if fill is None else fill.get(q("fill"))), (int(size) / 2 if size and size.isdigit() else None), align


def is_underlined(r) -> bool:
    return (_value(r, "rPr/u", "none") or "none") != "none"


def cell_rows(doc_id: str, d: Docx):
    for t, table in enumerate(d.tables()):
        for row in grid(table):
            for c in row:
                fill, size, align = style(c["tc"])
                yield (doc_id, t, c["r"], c["c_unique"], c["c_expanded"], c["tc_ord"], c["grid_start"], c["grid_span"], c["vmerge_raw"], c["origin_r"], c["text"], fill, size, align)


def paragraph_rows(doc_id: str, d: Docx):
    for p, x in enumerate(d.paragraphs()):
        yield doc_id, p, paragraph_text(x), _value(x, "pPr/jc")


def run_rows(doc_id: str, d: Docx):
    def runs(p):
        for i, r in enumerate(p.findall(q("r"))):
            rpr = r.find(q("rPr"))
            tags = [] if rpr is None else [local(x.tag) for x in rpr]
            text = run_text(r) if r.find(q("t")) is not None or len(r) else None
            yield i, text, is_underlined(r), None if rpr is None else ET.tostring(rpr, encoding="unicode"), tags

    for p, x in enumerate(d.paragraphs()):
        for i, text, under, rpr, tags in runs(x):
            yield doc_id, "body", p, None, None, None, i, text, under, rpr, tags
    for t, table in enumerate(d.tables()):
        for r, tr in enumerate(table.findall(q("tr"))):
            for c, tc in enumerate(tr.findall(q("tc"))):
                for p, x in enumerate(tc.findall(q("p"))):
                    for i, text, under, rpr, tags in runs(x):
                        yield doc_id, "cell", p, t, r, c, i, text, under, rpr, tags


def node_rows(doc_id: str, d: Docx):
    if d.body is None:
        return
    stack, node = [(d.body, -1, 0, "")], 0
    while stack:
        x, parent, ord_, parent_tag = stack.pop()
        me, node = node, node + 1
        yield doc_id, me, parent, ord_, local(x.tag), parent_tag
        stack += [(child, me, i, local(x.tag)) for i, child in enumerate(x)][::-1]


def docx_text(content: bytes) -> str:
    """SRC4, SRC5: paragraphs, then tables: two-cell tables as label and value lines, others as piped rows; blank rows go."""
    d = Docx(content)
    out = [x for p in d.paragraphs() if (x := paragraph_text(p).strip())]
    for table in d.tables():
        rows = [[cell_text(tc).strip() for tc in tr.findall(q("tc"))] for tr in table.findall(q("tr"))]
        pairs = len(rows) >= 2 and all(len(r) == 2 for r in rows)
        for r in rows:
            if any(r):
                out.append(f"{r[0]}：{r[1]}" if pairs else " | ".join(r))
    return "\n".join(out)


def xlsx_text(content: bytes) -> str:
    """SRC6: the values of all sheets, a line a row, empty cells left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    n = f"{{{S}}}"
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in x.iter(n + "t")) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    out = []
    for name in sorted((x for x in z.namelist() if x.startswith("xl/worksheets/sheet")), key=lambda x: (len(x), x)):
        for row in ET.fromstring(z.read(name)).iter(n + "row"):
            found = []
            for c in row.iter(n + "c"):
                v = c.find(n + "v")
                if c.get("t") == "inlineStr":
                    found.append("".join(t.text or "" for t in c.iter(n + "t")))
                elif v is not None and v.text is not None:
                    found.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            if found := [x for x in found if x != ""]:
                out.append(", ".join(found))
    return "\n".join(out)


def new_docx(tables: list[list[list]], paragraphs: list[str] = ()) -> bytes:
    """A small .docx of plain tables; a cell is a text, or a dict of text, span and merge. For fixtures and generated output."""
    from xml.sax.saxutils import escape

    def para(text: str) -> str:
        return "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))

    def cell(c) -> str:
        c = c if isinstance(c, dict) else {"text": c}
        props = (f'<w:gridSpan w:val="{c["span"]}"/>' if c.get("span", 1) > 1 else "") + ("" if c.get("merge") is None else "<w:vMerge/>" if c["merge"] == "" else f'<w:vMerge w:val="{c["merge"]}"/>')
        return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(c.get('text', ''))}</w:tc>"

    rows = "".join("<w:tbl><w:tblPr/><w:tblGrid/>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    body = "".join(p if p.startswith("<w:p") else para(p) for p in paragraphs) + rows + "<w:sectPr/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr(BODY, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
