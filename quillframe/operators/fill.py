"""Filling (FIL3-FIL7, FIL9-FIL11, SNK1): a plan of edits as a relation, applied document by document.

``edits`` decides which cell gets what, with joins only. ``apply`` writes them: one Arrow pass over (content, edits), a document
a row, as a document's XML is edited as one tree.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import relational as R
from quillframe.operators.cells import continues
from quillframe.operators.fields import checkbox_groups
from quillframe.sources import ooxml
from quillframe.sources.ooxml import q

EDIT = ["doc_id", "kind", "t", "r", "c", "ordinal", "op", "label", "existing", "value"]


def label_edits(fields: DataFrame, values: DataFrame) -> DataFrame:
    """FIL3, FIL10, JN16, D14: a cell edit for each row of a field with a value, by field_id or by label; tick boxes apart."""
    f = fields.filter("pattern <> 'checkbox'")
    v = values.filter(T.strip(F.coalesce("value", F.lit(""))) != "").select("doc_id", F.col("label").alias("key"), "value")
    by_id = f.withColumn("key", F.col("field_id")).join(v, ["doc_id", "key"]).withColumn("tier", F.lit(0))
    by_label = f.withColumn("key", F.col("label")).join(v, ["doc_id", "key"]).withColumn("tier", F.lit(1))
    best = by_id.unionByName(by_label).groupBy("doc_id", "field_id").agg(F.min_by(F.struct("pattern", "fill_mode", "t", "c", "label", "raw_label", "existing_value", "row_indices", "value"), "tier").alias("f")).select("doc_id", "f.*")
    return best.select(
        "doc_id",
        F.when(F.col("pattern") == "paragraph_underline", "paragraph").otherwise("cell").alias("kind"),
        "t",
        F.explode("row_indices").alias("r"),
        "c",
        F.lit("unique").alias("ordinal"),
        F.col("fill_mode").alias("op"),
        F.coalesce("raw_label", "label").alias("label"),
        F.col("existing_value").alias("existing"),
        "value",
    )


def fill_groups(classified_cells: DataFrame, rows: DataFrame) -> DataFrame:
    """FLD5b: groups of tick boxes as filling knows them: its own option words, merge rule and title. That is the first
    text over TITLE_SPAN columns or more up to two rows above or, in narrower tables, over a whole row."""
    x = F.col("x")
    option = (x != "") & (x.isin(V.FILL_OPTION_WORDS) | T.squeeze(x).isin(V.FILL_OPTION_WORDS))
    c = classified_cells.withColumns({"is_option": option, "continues": continues(F.col("vmerge_raw"), "fill")})
    wide = c.filter((F.col("grid_span") >= V.TITLE_SPAN) & (x != "")).groupBy("doc_id", "t", "r").agg(F.min_by("x", "c_unique").alias("wide"))
    w = W.partitionBy("doc_id", "t").orderBy("r")
    above = rows.select("doc_id", "t", "r", "one_cell_text").join(wide, ["doc_id", "t", "r"], "left").withColumn("wide", F.coalesce("wide", "one_cell_text")).withColumn("title", F.coalesce(F.lag("wide", 1).over(w), F.lag("wide", 2).over(w)))
    return checkbox_groups(c, V.FILL_OPTION_WORDS).join(above.select("doc_id", "t", "r", "title"), ["doc_id", "t", "r"], "left")


def checkbox_edits(classified_cells: DataFrame, rows: DataFrame, values: DataFrame) -> DataFrame:
    """FIL5b, FIL6, JN17: a tick in the blank beside each chosen option, the value found by label, title or an option itself, in that order."""
    g = fill_groups(classified_cells, rows)
    bare = lambda c: F.translate(c, "\n 　", "")
    v = values.select("doc_id", F.col("label").alias("key"), F.col("value").alias("chosen"))
    pair = g.join(v, "doc_id")
    named = lambda x: F.exists("options", lambda o: o["o"] == x)
    tier = (
        F.when(F.col("label") == F.col("key"), 0)
        .when(bare(F.col("label")) == bare(F.col("key")), 1)
        .when(F.col("label").isNull() & F.contains(bare(F.col("title")), bare(F.col("key"))), 2)
        .when(named(F.col("key")), 3)
        .when(F.col("label").isNull() & named(T.squeeze("key")), 4)
    )
    best = pair.withColumn("tier", tier).filter("tier IS NOT NULL").groupBy("doc_id", "t", "r", "grp").agg(F.min_by(F.struct("options", "chosen"), F.struct("tier", "key")).alias("b"))
    each = best.select("doc_id", "t", "r", F.explode("b.options").alias("o"), T.comma_parts(F.col("b.chosen")).alias("chosen"))
    hit = F.array_contains("chosen", F.col("o.o")) | F.exists("chosen", lambda x: T.squeeze(x) == F.col("o.o"))
    return each.filter(hit).select("doc_id", F.lit("cell").alias("kind"), "t", "r", (F.col("o.c_unique") + 1).alias("c"), F.lit("unique").alias("ordinal"), F.lit("set").alias("op"), F.lit("").alias("label"), F.lit("").alias("existing"), F.lit(V.TICK).alias("value"))


def row_group_edits(groups: DataFrame, cells: DataFrame, values: DataFrame) -> DataFrame:
    """FIL7, D12: two-dimensional data on the rows of a group: blank or placeholder cells in order; merged cells take their datum unwritten;
    rows beyond the template's are clones of its last row as it was, in order."""
    data = values.select("doc_id", F.col("label").alias("group_id"), F.from_json("value", "array<array<string>>").alias("m")).filter("m IS NOT NULL")
    g = groups.filter("NOT is_complex").join(data, ["doc_id", "group_id"])
    rows = g.select("doc_id", "group_id", "t", "start_row", "template_row_count", F.posexplode("m").alias("i", "data"))
    model = F.least(F.col("i"), F.col("template_row_count") - 1) + F.col("start_row")
    rows = rows.withColumns({"r": model.cast("int"), "clone": F.col("i") >= F.col("template_row_count")})
    x = T.strip(F.coalesce("text", F.lit("")))
    merged = F.coalesce(F.col("vmerge_raw") == "", F.lit(False))
    slots = cells.withColumn("merged", merged).filter(merged | x.isin("", "%", "…", "……")).withColumn("d", F.row_number().over(W.partitionBy("doc_id", "t", "r").orderBy("tc_ord")) - 1)
    put = rows.join(slots.select("doc_id", "t", "r", "tc_ord", "d", "merged"), ["doc_id", "t", "r"]).withColumn("value", F.get("data", F.col("d"))).filter("value IS NOT NULL")
    kind = F.when(F.col("merged"), "none").when(F.col("clone"), F.concat(F.lit("clone:"), F.col("i").cast("string"))).otherwise("cell")
    return put.select("doc_id", kind.alias("kind"), "t", "r", F.col("tc_ord").alias("c"), F.lit("tc").alias("ordinal"), F.lit("set").alias("op"), F.lit("").alias("label"), F.lit("").alias("existing"), "value", "group_id", "i", "d")


def edits(fields: DataFrame, groups: DataFrame, cells: DataFrame, classified_cells: DataFrame, rows: DataFrame, values: DataFrame) -> DataFrame:
    """All edits of a document's values: (doc_id, label, value) from ``expand.expanded``."""
    grouped = row_group_edits(groups, cells, values).filter("kind <> 'none'").select(*EDIT)
    return label_edits(fields, values).select(*EDIT).unionByName(checkbox_edits(classified_cells, rows, values).select(*EDIT)).unionByName(grouped)


def field_values(fields: DataFrame, values: DataFrame, grouped: DataFrame) -> DataFrame:
    """JN16, SET5: what each field id and row-group cell now holds."""
    ids = label_edits(fields, values).join(fields.select("doc_id", F.coalesce("raw_label", "label").alias("label"), "field_id").distinct(), ["doc_id", "label"]).select("doc_id", "field_id", "value", F.lit(0).alias("p"))
    cells = grouped.select("doc_id", F.concat(F.col("group_id"), F.format_string("_R%d_C%d", "i", "d")).alias("field_id"), "value", F.lit(1).alias("p"))
    return ids.unionByName(cells).groupBy("doc_id", "field_id").agg(F.max_by("value", F.struct("p", "value")).alias("value"))


# writing
_DATE = re.compile(r"年[\s　]*月[\s　]*日(?:\s*(?:上午|下午|上|下))?")
_REAL_DATE = re.compile(r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def set_run(r, text: str) -> None:
    """FIL9: one text node with the text; the run's format stays."""
    nodes = r.findall(q("t"))
    for extra in nodes[1:]:
        r.remove(extra)
    node = nodes[0] if nodes else ooxml.ET.SubElement(r, q("t"))
    node.text = text
    node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def target_run(p):
    """FIL9: the run to write: a blank one, else one with a placeholder, else the first with text, else the first, else a new one."""
    runs = p.findall(q("r"))
    text = {id(r): ooxml.run_text(r) for r in runs}
    for good in (lambda x: not x.strip() and x != "", lambda x: bool(_DATE.search(x)) or any(m in x for m in V.PLACEHOLDER_TEXTS), lambda x: x != "", lambda x: True):
        for r in runs:
            if good(text[id(r)]):
                return r
    return ooxml.ET.SubElement(p, q("r"))


def set_paragraph(p, text: str) -> None:
    chosen = target_run(p)
    for r in p.findall(q("r")):
        if r is not chosen:
            for t in r.findall(q("t")):
                t.text = ""
    set_run(chosen, text)


def set_cell(tc, text: str) -> None:
    """A paragraph a line; more lines clone the last paragraph, surplus paragraphs are blanked."""
    lines = text.split("\n")
    paragraphs = tc.findall(q("p")) or [ooxml.ET.SubElement(tc, q("p"))]
    while len(paragraphs) < len(lines):
        fresh = copy.deepcopy(paragraphs[-1])
        tc.insert(list(tc).index(paragraphs[-1]) + 1, fresh)
        paragraphs.append(fresh)
    for p, line in zip(paragraphs, lines + [""] * (len(paragraphs) - len(lines))):
        set_paragraph(p, line)


def append_after(tc, label: str, value: str) -> None:
    """FIL4: the value in a run of its own after the label's run and its colon; a label across runs is written in one."""
    paragraphs = tc.findall(q("p"))
    for p in paragraphs:
        if label not in ooxml.paragraph_text(p):
            continue
        for r in p.findall(q("r")):
            text = ooxml.run_text(r)
            if label in text:
                cut = text.index(label) + len(label)
                cut += 1 if text[cut : cut + 1] in ("：", ":") else 0
                rest = text[cut:]
                set_run(r, text[:cut])
                at = list(p).index(r) + 1
                for part in (value, rest):
                    if part:
                        fresh = copy.deepcopy(r)
                        set_run(fresh, part)
                        p.insert(at, fresh)
                        at += 1
                return
        text = ooxml.paragraph_text(p)
        set_paragraph(p, text.replace(label, label + value, 1))
        return
    if paragraphs:
        set_paragraph(paragraphs[0], ooxml.paragraph_text(paragraphs[0]) + value)


def replace_date(tc, label: str, value: str) -> None:
    """FIL4, DT2: the first empty date after the label gives way to the value; without a real date in the value the date stays and the value goes after the label."""
    for p in tc.findall(q("p")):
        text = ooxml.paragraph_text(p)
        at = text.find(label) if label else -1
        if at >= 0 and _DATE.search(text, at):
            if not _REAL_DATE.search(value) and "签" in label:
                append_after(tc, label, value)
            else:
                head = text[: at + len(label)]
                set_paragraph(p, head + _DATE.sub(lambda m: value, text[len(head) :], count=1))
            return
    set_cell(tc, f"{label} {value}" if label and label in ooxml.cell_text(tc) else value)


def apply_edits(content: bytes, plan: list[dict]) -> bytes:
    d = ooxml.Docx(content)
    tables = d.tables()
    grids = [ooxml.grid(t) for t in tables]
    clones: dict[tuple[int, int], dict[int, list[dict]]] = {}
    for e in plan:
        value = _CONTROL.sub("", e["value"])
        if e["kind"] == "paragraph":
            p = d.paragraphs()[e["r"]]
            blank = next((r for r in p.findall(q("r")) if ooxml.is_underlined(r) and not ooxml.run_text(r).strip()), None)
            if blank is not None:
                set_run(blank, f" {value} ")
        elif e["kind"].startswith("clone:"):
            clones.setdefault((e["t"], e["r"]), {}).setdefault(int(e["kind"][6:]), []).append({**e, "value": value})
    fresh_rows = []
    for (t, r), by_row in clones.items():  # cloned before anything is written (D12)
        model = tables[t].findall(q("tr"))[r]
        for i, row_edits in sorted(by_row.items()):
            tr = copy.deepcopy(model)
            for e in row_edits:
                set_cell(tr.findall(q("tc"))[e["c"]], e["value"])
            fresh_rows.append((tables[t], model, i, tr))
    for e in plan:
        if e["kind"] != "cell" or e["t"] >= len(grids) or e["r"] >= len(grids[e["t"]]):
            continue
        row = grids[e["t"]][e["r"]]
        found = [c for c in row if (c["c_unique"] if e["ordinal"] == "unique" else c["tc_ord"]) == e["c"]]
        if not found:
            continue
        tc, value = found[0]["tc"], _CONTROL.sub("", e["value"])
        if e["op"] == "append":
            append_after(tc, e["label"], value)
        elif e["op"] == "replace" and e["existing"] and _DATE.search(e["existing"]):
            replace_date(tc, e["label"], value)
        else:
            set_cell(tc, value)
    for table, model, i, tr in sorted(fresh_rows, key=lambda x: -x[2]):
        table.insert(list(table).index(model) + 1, tr)
    return d.save()


def apply(files: DataFrame, plan: DataFrame) -> DataFrame:
    """SNK1: path, content (filled), error. The edits of a document travel as one list, as its size is bounded by the document's."""
    packed = plan.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct(*EDIT[1:]))).alias("plan"))
    both = files.join(packed, files["path"] == packed["doc_id"]).select("path", "content", "plan")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            out = []
            for path, content, text in zip(frame["path"], frame["content"], frame["plan"]):
                rows = [{"existing": "", "label": "", "value": "", **e} for e in json.loads(text)]
                try:
                    out.append((path, apply_edits(bytes(content), rows), None))
                except Exception as e:  # noqa: BLE001  one broken document is a row
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return both.mapInPandas(run, "path string, content binary, error string")


def merged_cells_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two documents by position with the kind of difference (see relational.compared)."""
    return R.compared(a, b, ["t", "r", "tc_ord"], "text")
