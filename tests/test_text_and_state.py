import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import extract, state
from quillframe.streaming import sessions


def value(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], [*inputs]) if inputs else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("[1, 2]", "[1, 2]"), ("```json\n[1]\n```", "[1]"), ("see [3] here", "[3]"), ('{"a": 1}', "[]"), ("```\n[1\n```", "[]"), ("", "[]")],
)
def test_json_ladder(spark, raw, want):
    assert value(spark, T.json_ladder("raw"), raw=raw) == want


def test_text_functions(spark):
    v = lambda c, **k: value(spark, c, **k)
    assert v(T.strip("a"), a="　 x\t y　") == "x\t y"
    assert v(T.squeeze("a"), a="闭 　卷") == "闭卷"
    assert v(T.label_value_pairs("a"), a="甲：1:2\n乙: x\nno\n甲：3") == {"甲": "3", "乙": "x"}
    assert v(T.strip_label(F.col("a"), F.lit("姓名")), a="姓名：李") == "李" and v(T.strip_label(F.col("a"), F.lit("姓名")), a="其他\n姓名 王") == "王"
    assert v(T.strip_label(F.col("a"), F.lit("姓名")), a="无") is None
    assert v(T.replace_first_date_placeholder(F.col("a"), F.lit("2024年1月2日")), a="签 年 月 日 年月日") == "签 2024年1月2日 年月日"
    assert v(T.is_real_date(F.col("a")), a="２０２４年1月2日") and not v(T.is_real_date(F.col("a")), a="年月日")
    assert v(T.percent(F.col("a"), F.col("b")), a=1.0, b=3.0) == "33.3%" and v(T.percent(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert v(T.safe_number("a"), a=" 3.5 ") == 3.5 and v(T.safe_number("a"), a="x") == 0
    assert [v(T.status_of(F.col("a")), a=c) for c in (0.8, 0.79, 0.4, 0.39)] == ["confirmed", "review", "review", "empty"]
    assert tuple(v(T.field_id_parts("a"), a="T1_R2_C3_L4x")) == (1, 2, 3, 4) and tuple(v(T.field_id_parts("a"), a="T1_R2_CHK")) == (None,) * 4
    assert v(T.extension(F.col("a")), a="/x/y.tar.GZ") == ".gz" and v(T.extension(F.col("a")), a="/x.d/y") == ""
    at = F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert v(T.file_stamp(F.lit("out"), F.lit("a b"), at)) == "out/a_b_20240102030405.docx"
    assert v(T.comma_parts("a"), a="1， 2,3") == ["1", "2", "3"]


TEXTS = {
    "课程性质：专业必修课。": "专业必修课",
    "x\n课程性质＝选修 | y": "选修",
    "甲 | 课程性质 | 专业课; | z": "专业课",
    "这门课程性质是公共课，很好": "公共课",
    "【课程性质】 通识；": "通识",
    "课程类别: 限选": "限选",
    "课程性质：课程性质": None,
    "课程性质：" + "长" * 100: None,
    "前文课程性质：无": None,
}


def test_rules(spark):
    rows = list(enumerate(TEXTS))
    texts = spark.createDataFrame(rows, "file_ord int, text string")
    labels = spark.createDataFrame([("课程性质",)], "label string")
    got = {r["file_ord"]: r["value"] for r in extract.rule_extract(spark, texts, labels).collect()}
    assert {i: got.get(i) for i, _ in rows} == {i: TEXTS[t] for i, t in rows}


def test_prefill_with_a_recorded_model(spark):
    texts = spark.createDataFrame([(1, "课程性质：必修"), (2, "课程性质：选修")], "file_ord int, text string")
    fields = spark.createDataFrame([("A", "课程性质"), ("B", "教师 姓名"), ("C", "别的")], "field_id string, label string")

    def model(text, labels):
        if "选修" in text:
            raise RuntimeError("no answer")
        return [{"label": "教师姓名：", "value": "李", "confidence": 0.9, "source": "model"}, {"label": "别的", "value": "无", "confidence": 1.0}]

    got = {r["field_id"]: r for r in extract.prefill(spark, texts, fields, model).collect()}
    assert (got["B"]["value"], got["B"]["confidence"], got["B"]["status"]) == ("李", 0.9, "confirmed")
    assert (got["A"]["value"], got["A"]["confidence"], got["A"]["status"]) == ("必修", 0.6, "review")
    assert (got["C"]["value"], got["C"]["confidence"], got["C"]["status"]) == (None, 0.0, "empty")


def writes(seed=1, n=200):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 3)}", i, f"f{rng.randint(0, 5)}", rng.choice(["a", "b", "0", "", " ", None]), rng.choice([None, 0.5, 0.8, 1.0])) for i in range(n)]


SCHEMA = "session_id string, seq long, field_id string, value string, confidence double"


def test_fold_equals_the_model(spark):
    rows = writes()
    got = {(r["session_id"], r["field_id"]): (r["seq"], r["value"], r["confidence"], r["status"]) for r in state.fold(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == sessions.reference_fold(rows)
    assert state.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def test_states(spark):
    fields = spark.createDataFrame([(f"f{i}", f"标签{i}" + ("签字" if i == 4 else ""), i) for i in range(6)], "field_id string, label string, ord int")
    rows = [("s", 1, "f0", "a", 0.5), ("s", 2, "f1", "b", 1.0), ("s", 3, "f1", "c", 0.5), ("s", 4, "nope", "c", 0.5)]
    w = spark.createDataFrame(rows, SCHEMA)
    states = state.form_state(fields, state.fold(w)).cache()
    assert {r["field_id"]: r["status"] for r in states.collect()} == {"f0": "filled", "f1": "confirmed", **{f"f{i}": "empty" for i in range(2, 6)}}
    assert [r["field_id"] for r in state.next_batch(states, ["签字"], 2).orderBy("rank").collect()] == ["f4", "f2"]
    assert {(r["seq"], r["outcome"]) for r in state.split_keys(w, states).collect()} == {(1, "matched"), (2, "skipped"), (3, "skipped"), (4, "unmatched")}
    up = state.confirm(states, spark.createDataFrame([("s", "f0"), ("s", "f2")], "session_id string, field_id string"))
    assert {r["field_id"] for r in up.filter("status = 'confirmed'").collect()} == {"f0", "f1"}
    again = state.from_json(state.as_json(states))
    assert {(r["field_id"], r["status"], r["value"]) for r in again.collect()} == {(r["field_id"], r["status"], r["value"]) for r in states.collect()}
    assert state.missing(states).count() == 4 and state.needs_review(states).count() == 1


def test_streaming_fold(spark, tmp_path):
    rows = writes(3, 60)
    source = tmp_path / "in"
    source.mkdir()
    out: dict = {}

    def keep(frame, _):
        out.update({(r["session_id"], r["field_id"]): (r["seq"], r["value"], r["confidence"], r["status"]) for r in frame.collect()})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(["session_id", "seq", "field_id", "value", "confidence"], r))) for r in rows[i * 20 : i * 20 + 20]))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by time
    q = sessions.sessions(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and out == sessions.reference_fold(rows)


def test_message_window(spark):
    rows = [("t", i, "ai" if i == 3 else "tool" if i == 45 else "human", ["c"] if i == 3 else None, "c" if i == 45 else None) for i in range(1, 46)]
    m = spark.createDataFrame(rows, "thread_id string, seq int, type string, tool_call_ids array<string>, tool_call_id string")
    assert {r["seq"] for r in state.windowed_messages(m).collect()} == set(range(6, 45))
    assert {r["seq"] for r in state.windowed_messages(m, 45).collect()} == set(range(1, 46))


def test_error_categories():
    from quillframe.functions import errors

    class Own(ConnectionResetError):
        pass

    assert errors.category_of(Own)[0] == "infra" and errors.category_of(UnicodeDecodeError)[0] == "input"
    assert errors.category_of(FileNotFoundError) == ("input", "文件不存在，请确认路径") and errors.category_of(RuntimeError)[0] == "unknown"


def test_values_of_old_reports_and_run_formats(spark):
    """What counts as a value of an old report, as a tick, as a direct format."""
    from pyspark.sql import functions as F

    from quillframe.functions import values as V
    from quillframe.operators import cells, reports

    texts = ["xxx", "请填写", "%", "—", "请在课前提交", "签名：", "实现途径:\n评价方法:", "数学"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", cells.is_meaningful_value(F.col("x")).alias("m")).collect()
    assert {r["x"] for r in got if r["m"]} == {"—", "请在课前提交", "数学"}
    marks = spark.createDataFrame([(x,) for x in ["√", "✓", "☑", "是", "合格", "有", "否"]], "x string")
    got = marks.select("x", reports.value_by_mode(F.col("x"), F.lit("a"), F.lit("check")).alias("v")).collect()
    assert [r["v"] for r in got] == ["√", "✓", "☑", "是", "合格", "有", None]
    assert "vanish" in V.RUN_FORMATS and "spacing" not in V.RUN_FORMATS and "优秀" not in V.FILL_OPTION_WORDS
