"""Templates end to end: decode, analyse, fill, check, preview, on small hand-written documents."""

import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import expand, validate
from quillframe.plans import forms
from quillframe.sources import files as SRC
from quillframe.sources import ooxml

GRID = [
    [
        ["课程名称：", "教师姓名", ""],
        [{"text": "教学运行数据管理部门审批意见", "span": 3}],
        [{"text": "负责人签名：  年  月  日", "span": 3}],
        ["开课时间", "必修", ""],
        ["题号", "一题", "二题"],
        ["人数", "", ""],
        ["比例", "%", "%"],
        [{"text": "二、考试方式", "span": 3}],
        ["开卷", "", "备注文字甲"],
    ],
    [["姓甲", "姓乙", "姓丙"], ["", "", ""], ["", "", ""], ["", ""]],
    [[{"text": "年　月　日上午", "span": 2}]],
]
BLANK = '<w:p><w:r><w:t>教材名称</w:t></w:r><w:r><w:rPr><w:u w:val="single"/></w:rPr><w:t xml:space="preserve">    </w:t></w:r></w:p>'


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "a.docx"
    path.write_bytes(ooxml.new_docx(GRID, [BLANK, "正文"]))
    t = forms.open_templates(spark, str(path))
    t.fields = t.fields.cache()
    t.groups = t.groups.cache()
    return t


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_fields(template):
    got = rows(template.fields, "field_id", "pattern", "fill_mode", "label")
    assert ("T0_R0_C0_L0", "colon", "append", "课程名称") in got
    assert ("T0_R0_C2", "label_blank", "set", "教师姓名") in got
    assert ("T0_R3_C2", "label_blank", "set", "开课时间") in got
    assert any(g[1] == "colon" and g[3].endswith("-负责人签名") and g[2] == "replace" for g in got)
    assert {("T0_R5_C1", "multi_col", "set", "人数_一题"), ("T0_R5_C2", "multi_col", "set", "人数_二题")} <= got
    assert {("T0_R6_C1", "multi_col", "replace", "比例_一题")} <= got
    assert ("T0_R8_CHK", "checkbox", "check", "考试方式") in got
    assert ("P0", "paragraph_underline", "paragraph_underline", "教材名称") in got
    assert any(g[1] == "standalone_placeholder" and g[3] == "考试时间" for g in got)
    assert [r["ord"] for r in template.fields.orderBy("ord").collect()] == list(range(template.fields.count()))


def test_row_groups(template):
    got = template.groups.filter("t = 1").orderBy("start_row").collect()
    assert [(g["start_row"], g["template_row_count"], g["header_row_idx"], g["num_cols"]) for g in got] == [(1, 2, 0, 3), (3, 1, 0, 3)]
    assert got[0]["column_labels"] == ["姓甲", "姓乙", "姓丙"] and not got[0]["is_complex"]


def test_fill_check_preview(spark, template):
    group = template.groups.filter("t = 1 AND start_row = 1").first()["group_id"]
    path = template.files.first()["path"]
    data = {"课程名称": "数学\x07", "教师姓名": "李明", "人数": "3,4", "考试方式": "开卷", "教材名称": "代数", group: [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"], ["j", "k", "l"]]}
    frame = spark.createDataFrame([(path, json.dumps(data, ensure_ascii=False))], "doc_id string, json string")
    filled, plan = forms.generate(template, frame, generic=False)
    out = filled.collect()[0]
    assert out["error"] is None
    d = ooxml.Docx(bytes(out["content"]))
    grids = [ooxml.grid(t) for t in d.tables()]
    text = lambda t, r, c: grids[t][r][c]["text"]
    assert text(0, 0, 0) == "课程名称：数学" and text(0, 0, 2) == "李明"
    assert (text(0, 5, 1), text(0, 5, 2)) == ("3", "4") and text(0, 8, 1) == "√"
    assert [[c["text"] for c in row] for row in grids[1]][:5] == [["姓甲", "姓乙", "姓丙"], ["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"], ["j", "k", "l"]]
    assert ooxml.paragraph_text(d.paragraphs()[0]) == "教材名称 代数 "
    checks = forms.check(spark, template, filled)
    assert rows(checks["verdicts"], "passed") == {(True,)}
    assert ("rows_more", "warning") in rows(checks["dimensions"], "change", "severity")
    diff = rows(checks["diff"], "field_id", "kind", "value")
    assert ("T0_R0_C2", "filled", "李明") in diff and ("P0_U0", "filled", "代数") in diff
    html = forms.previews(template).first()["html"]
    assert 'data-field="T0_R0_C2"' in html and 'colspan="3"' in html and html.index("<p>") < html.index("<table>")


def test_old_report(spark, template, tmp_path):
    path = template.files.first()["path"]
    grid = [[list(r) for r in t] for t in GRID]
    grid[0][0] = ["课程名称：物理", "教师姓名", "王芳"]
    (tmp_path / "old.docx").write_bytes(ooxml.new_docx(grid, [BLANK]))
    got = dict(rows(forms.extract_from_old_report(template, path, SRC.scan(spark, str(tmp_path))), "label", "value"))
    assert got["课程名称"] == "物理"


def test_checklist(template):
    got = dict(rows(forms.fill_checklist(template), "category", "n"))
    assert got["must_fill"] >= 2 and sum(got.values()) == template.fields.count()


def test_validation_finds_faults(spark, tmp_path):
    good = ooxml.new_docx([[["a", "b"]]])
    bad = ooxml.Docx(good)
    tc = bad.tables()[0].find(f"{ooxml.q('tr')}/{ooxml.q('tc')}")
    tc.remove(tc.find(ooxml.q("p")))
    p = bad.tables()[0].findall(f"{ooxml.q('tr')}/{ooxml.q('tc')}")[1].find(ooxml.q("p"))
    ooxml.ET.SubElement(p, ooxml.q("pPr"))
    sect = bad.body.find(ooxml.q("sectPr"))
    bad.body.remove(sect)
    bad.body.insert(0, sect)
    (tmp_path / "bad.docx").write_bytes(bad.save())
    (tmp_path / "tall.docx").write_bytes(ooxml.new_docx([[["x"] * 31] + [["x"]] * 200]))
    files = SRC.scan(spark, str(tmp_path))
    docs = files.select(F.col("path").alias("doc_id"))
    found = validate.issues(SRC.nodes(files), SRC.cells(files), SRC.runs(files), docs)
    got = {(r["doc_id"].rsplit("/", 1)[1], r["check"]) for r in found.collect()}
    assert got == {("bad.docx", "cell_paragraph"), ("bad.docx", "element_order"), ("bad.docx", "section_last"), ("tall.docx", "dimensions")}
    fixed, n = validate.repair(bad.save())
    assert n["paragraphs_added"] == 1 and n["reordered"] == 1


def test_expand(spark, template):
    f = spark.createDataFrame([("d", f"F{i}", x, "set", i) for i, x in enumerate(["学生班级", "学生班级_应到", "学生班级_实到", "分数分布_<60", "分数分布_60-69", "分数分布(续)_第1列", "分数分布_第1列", "分数分布_第2列", "及百分比_一题", "及百分比_二题"])], "doc_id string, field_id string, label string, fill_mode string, ord int")
    data = {"考勤数据": {"应到": 45, "实到": "43"}, "分数分布_<60": "1", "分数分布_60-69": "3", "及百分比": ["40", "60"], "学生班级": "一班"}
    kv = expand.kv_rows(spark.createDataFrame([("d", json.dumps(data))], "doc_id string, json string"))
    got = dict(rows(expand.expanded(kv, f), "label", "value"))
    assert got["学生班级_应到"] == "45" and got["学生班级_实到"] == "43" and got["及百分比_二题"] == "60" and got["学生班级"] == "一班"
    assert got["分数分布_第1列"] == "25.0%" and got["分数分布_第2列"] == "75.0%"
    view = {r["label"]: r for r in expand.simplified(f).collect()}
    assert view["考勤数据"]["sub_labels"] == ["应到", "实到"] and view["及百分比"]["fill_mode"] == "group"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("课程".encode("gbk"))
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    (tmp_path / "c.docx").write_bytes(ooxml.new_docx([[["名", "值"], ["甲", "乙"]], [["x", "y", "z"]]], ["段"]))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in SRC.texts(SRC.scan(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["text"] == "课程" and got["b.csv"]["text"] == "a, b\n1, 2"
    assert got["c.docx"]["text"] == "段\n名：值\n甲：乙\nx | y | z"
    assert not got["d.pdf"]["success"] and not got["e.docx"]["success"] and got["e.docx"]["error"]
    ok, no = SRC.accepted(SRC.scan(spark, str(tmp_path)), [".txt"], 1)
    assert ok.count() == 0 and rows(no, "reason") == {("size",), ("type",)}
    assert SRC.safe_path("/tmp/a/../b.txt", ["/tmp"]) == "/tmp/b.txt"
    with pytest.raises(ValueError):
        SRC.safe_path("/tmpx/a", ["/tmp"])
