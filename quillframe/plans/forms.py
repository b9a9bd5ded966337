"""The engine's paths end to end: templates, prefill, sessions, documents, checks, previews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import cells as C
from quillframe.operators import expand, extract, fields as FL, fill, preview, reports, state, validate
from quillframe.session import checkpointed
from quillframe.sources import files as SRC


@dataclass
class Template:
    """The relations of the template files of one scan."""

    files: DataFrame
    cells: DataFrame
    paragraphs: DataFrame
    runs: DataFrame
    nodes: DataFrame
    fields: DataFrame
    groups: DataFrame

    @property
    def roles(self) -> tuple[DataFrame, DataFrame]:
        c = C.classified(self.cells)
        return c, C.row_roles(c)


def open_templates(spark: SparkSession, *paths: str) -> Template:
    """Path A, templates: one scan, decoded and analysed."""
    files, _ = SRC.accepted(SRC.scan(spark, *paths), [".docx", ".doc"])
    cells, paragraphs, runs = SRC.cells(files), SRC.paragraphs(files), SRC.runs(files)
    fields, groups = FL.analyze(cells, paragraphs, runs)
    return Template(files, cells, paragraphs, runs, SRC.nodes(files), fields, groups)


def list_templates(registry: DataFrame) -> DataFrame:
    return registry.orderBy("name")


def prefill_from_files(spark: SparkSession, template: Template, knowledge: list[str], extractor: extract.Extractor | None = None) -> DataFrame:
    """Path A over one template and many knowledge files."""
    texts = SRC.texts(SRC.scan(spark, *knowledge)).filter("success")
    return extract.prefill(spark, texts.select(F.col("path").alias("file"), "text"), expand.user_view(template.fields), extractor, "file")


def parse_knowledge_file(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    texts = SRC.texts(SRC.scan(spark, path)).filter("success").select(F.col("path").alias("file"), "text")
    return extract.rule_extract(spark, texts, spark.createDataFrame([(x,) for x in labels], "label string"), "file")


def extract_facts(spark: SparkSession, *paths: str) -> DataFrame:
    return extract.facts(SRC.texts(SRC.scan(spark, *paths)).filter("success").select(F.col("path").alias("file"), "text"), "file")


def form_status(template: Template, writes: DataFrame) -> DataFrame:
    """Path B as a batch."""
    return state.form_state(template.fields.select("field_id", "label", "ord"), state.fold(writes))


def generate(template: Template, data: DataFrame, generic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Path C. data (doc_id, json); gives the filled files and the edits."""
    kept = lambda df: checkpointed(data.sparkSession, df)  # noqa: E731  used several times by the next step
    values = kept(expand.expanded(expand.kv_rows(data), template.fields, generic))
    classified, rows = template.roles
    plan = kept(fill.edits(template.fields, template.groups, template.cells, kept(classified), kept(rows), values))
    return kept(fill.apply(template.files, plan)), plan


def check(spark: SparkSession, template: Template, filled: DataFrame) -> dict[str, DataFrame]:
    """VAL1, VAL9, JN15, FIX1-FIX3: validate, compare, diff and repair filled files (path, content) against their templates, which have the same path."""
    out = filled.select("path", F.lit(".docx").alias("ext"), F.length("content").cast("long").alias("length"), "content")
    cells, runs, nodes = (checkpointed(spark, d) for d in (SRC.cells(out), SRC.runs(out), SRC.nodes(out)))
    documents = out.select(F.col("path").alias("doc_id"))
    found = validate.issues(nodes, cells, runs, documents)
    rows = validate.diff(template.cells, cells).unionByName(validate.underline_diff(template.runs, runs))
    return {
        "issues": found,
        "verdicts": validate.verdicts(documents, found),
        "dimensions": validate.dimension_changes(template.cells, cells),
        "diff": rows,
        "summary": validate.diff_summary(rows),
        "repaired": validate.repaired(out),
    }


def extract_from_old_report(template: Template, template_path: str, reports_scan: DataFrame) -> DataFrame:
    """EXT8: values of old documents at the fields of one template."""
    mark = lambda d: d.withColumn("template_id", F.lit(template_path))
    fields = template.fields.filter(F.col("doc_id") == template_path)
    return reports.extracted(fields, mark(SRC.cells(reports_scan)), mark(SRC.runs(reports_scan)))


def fill_checklist(template: Template) -> DataFrame:
    """AGG7: the preparation list."""
    return expand.checklist(template.fields)


def previews(template: Template) -> DataFrame:
    """Path D."""
    return preview.html(template.cells, template.paragraphs, template.fields)
