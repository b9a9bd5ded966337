"""Word lists, patterns and thresholds of the form domain, as templates and their users write them."""

# fixed values: label texts that are headings or decoration, never fields
LABEL_BLACKLIST = ["序号", "编号", "合计", "总计", "备注", "说明", "项", "次", "类", "号"]
# fixed values: option words beside tick boxes
OPTION_WORDS = [
    "选修", "必修", "开卷", "闭卷", "半开卷", "试题库", "试卷库", "教师组题", "是", "否",
    "优秀", "良好", "中等", "及格", "不及格", "A", "B", "C", "D", "√", "✓", "○", "●",
    "本人阅卷", "同行阅卷", "集体阅卷", "机器阅卷", "其他",
]
# fixed values: texts that stand for a value still to come
PLACEHOLDER_TEXTS = ["%", "…", "……", "...", "—", "--", "___", "□", "○"]
# fixed values: headings without a number
SECTION_TITLES = ["试卷分析", "试　卷　分　析", "课程目标与试卷题目的对应关系"]
# fixed values: words of header rows
HEADER_WORDS = ["试题", "题号", "分数", "得分", "评卷人", "项目", "内容", "签名", "日期"]
# fixed values: how prompts begin
PROMPT_STARTS = ["请在", "请填写", "请勾选", "请在此", "请选择"]
# fixed values: other names of a field
ALIASES = {
    "课程名称": ["课程名", "课程", "科目名称", "科目", "课程代码名称"],
    "学时数": ["学时", "总学时", "课时", "总课时", "教学时数"],
    "教师姓名": ["任课教师", "授课教师", "主讲教师", "教师", "任课老师"],
    "开课单位": ["开课院系", "教学单位", "院系", "所在院系", "开课学院"],
    "课程性质": ["课程类别", "课程类型", "修读性质"],
    "学生班级": ["教学班", "班级", "授课班级", "教学班级"],
    "开课时间": ["学期", "开课学期", "授课学期"],
    "考试类别": ["考核方式", "考试方式"],
    "考试形式": ["考试类型"],
    "平均分": ["平均成绩", "均分"],
    "最高分": ["最高成绩"],
    "最低分": ["最低成绩"],
    "标准差": ["标准偏差", "成绩标准差"],
}
# fixed values: confidence of a rule hit, bands, cap of conflicting sources
RULE_CONFIDENCE, RULE_SOURCE = 0.75, "规则匹配"
CONFIRM_FROM, REVIEW_FROM, CONFLICT_CAP = 0.8, 0.4, 0.6
USER_CONFIDENCE, OLD_REPORT_CONFIDENCE = 0.8, 0.9
# fixed values: limits
FIELDS_PER_BATCH, MESSAGES_KEPT, SIMPLE_GROUP_COLUMNS, UPLOAD_BYTES = 40, 40, 15, 10 * 1024 * 1024
TABLE_ROWS, TABLE_COLUMNS, DIRECT_FORMATS = 200, 30, 4
NUMERALS = "一二三四五六七八九十"
# fixed values: direct run attributes counted as formatting
RUN_FORMATS = ["rFonts", "color", "sz", "szCs", "b", "i", "u", "highlight", "shd", "strike", "vanish"]
# fixed values: suffixes of sub-fields, of attendance, of score bands
ATTENDANCE = ["应到", "实到", "缺考", "缓考", "作弊", "取消考试资格"]
BANDS = ["<60", "60-69", "70-79", "80-89", "90-100"]
SUB_SUFFIXES = ["第1列", "第2列", "第3列", "第4列", "第5列", "一题", "二题", "三题", "四题", "五题", "六题", "七题", "八题", "九题", *BANDS, *ATTENDANCE]
GENERIC_SUFFIXES = ["课程目标", "实现途径", "评价方法", "实际平均分", "目标达成评价值"]
ATTENDANCE_KEY, BAND_BASE = "考勤数据", "分数分布"
# fixed values: categories of the preparation list, by keyword
CATEGORIES = [
    ("must_fill", ["课程名称", "教学班级", "教师", "开课", "学期", "学院", "课程性质", "考核方式", "命题形式", "考试形式"]),
    ("computable", ["平均分", "最高分", "最低分", "标准差", "达成度", "达成评价", "百分比", "占比", "比例", "及格率"]),
]
OPTIONAL_WORDS = ["签字", "参与人", "备注", "说明", "建议", "改进"]
# fixed values: marks of a ticked box
TICK = "√"
CHECK_VALUES = ["√", "✓", "☑", "是", "合格", "有"]
# fixed values: texts in an old report that are no value
OLD_PLACEHOLDERS = ["%", "…", "……", "xxx", "yyy", "yyyy", "请填写"]
# fixed values: option words beside tick boxes that filling knows
FILL_OPTION_WORDS = [
    "选修", "必修", "开卷", "闭卷", "半开卷", "是", "否",
    "试题库", "试卷库", "教师组题", "本人阅卷", "同行阅卷",
    "集体阅卷", "机器阅卷", "其他",
]
# fixed values: a cell that spans so many grid columns is a title to the tick boxes under it
TITLE_SPAN = 5
