"""Column functions over text: trimming, patterns, pairs, JSON ladders, bands and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import values as V

# white space as form texts have it: ASCII, no-break, ideographic
SPACES = " \t\n\r\x0b\x0c 　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """STR1: white space off both ends, full-width space included."""
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """STR2: without ASCII and full-width spaces."""
    return F.translate(col(c), " 　", "")


def sanitize(c: Column | str) -> Column:
    """STR6: without control characters (tab, line feed and carriage return stay)."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def html_escape(c: Column | str) -> Column:
    """STR7: & < > " ' as entities, & first."""
    out = col(c)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def one_of(c: Column, words: list[str]) -> Column:
    return c.isin(words)


def is_option(c: Column) -> Column:
    return one_of(c, V.OPTION_WORDS) | one_of(squeeze(c), V.OPTION_WORDS)


def is_date_placeholder(c: Column, loose: bool = True) -> Column:
    """DT1: an empty date, alone; loosely, a text that begins with one."""
    strict = c.rlike(r"^年[\s　]*月[\s　]*日?[\s　]*$")
    return strict | c.rlike(r"^年[\s　]*月[\s　]*日") if loose else strict


def is_real_date(c: Column) -> Column:
    """DT2: a written date."""
    return c.rlike(r"(?U)\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日")


def replace_first_date_placeholder(c: Column, date: Column) -> Column:
    """DT2: the first empty date gives way to ``date``, others stay."""
    at = F.regexp_instr(c, F.lit(r"年[\s　]*月[\s　]*日"))
    size = F.length(F.regexp_extract(c, r"(年[\s　]*月[\s　]*日)", 1))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), date, F.substring(c, at + size, F.length(c)))).otherwise(c)


def file_stamp(prefix: Column, name: Column, at: Column) -> Column:
    """SNK3, DT3: prefix/name_with_underscores_yyyyMMddHHmmss.docx."""
    return F.concat(prefix, F.lit("/"), F.translate(name, " ", "_"), F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"), F.lit(".docx"))


def extension(path: Column) -> Column:
    """STR11: lower-cased extension with its dot, empty if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def truncated(c: Column | str, most: int, marker: str = "") -> Column:
    """SRT6, SRT7: at most ``most`` code points, then the marker."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(marker))).otherwise(c)


def field_id_parts(c: Column | str) -> Column:
    """RX1: t, r, c, line of a positional id; line is -1 where there is none, all are null for other ids."""
    c = col(c)
    pattern = r"^T(\d+)_R(\d+)_C(\d+)(?:_L(\d+))?"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("int")
    hit = c.rlike(pattern)
    return F.struct(*[F.when(hit, part(i)).alias(n) for i, n in ((1, "t"), (2, "r"), (3, "c"))], F.when(hit, F.coalesce(part(4), F.lit(-1))).alias("line"))


def label_value_pairs(c: Column | str) -> Column:
    """STR5: line by line, label and value around the first full-width colon, else the first colon; the last of equal labels wins."""
    lines = F.split(col(c), "\n")
    sep = lambda x: F.when(F.contains(x, F.lit("：")), F.lit("：")).when(F.contains(x, F.lit(":")), F.lit(":"))
    at = lambda x: F.locate("：", x)
    place = lambda x: F.when(at(x) > 0, at(x)).otherwise(F.locate(":", x))
    pairs = F.transform(
        F.filter(lines, lambda x: sep(x).isNotNull()),
        lambda x: F.struct(strip(F.substring(x, F.lit(1), place(x) - 1)).alias("key"), strip(F.substring(x, place(x) + 1, F.length(x))).alias("value")),
    )
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def strip_label(value: Column, label: Column) -> Column:
    """STR4: what follows the label and a separator, in the whole text or else in the first line that has it; null if no line has it."""
    found = F.transform(F.split(value, "\n"), lambda x: _after(strip(x), label))
    return F.coalesce(_after(strip(value), label), F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))


def _after(x: Column, label: Column) -> Column:
    rest = F.substring(x, F.length(label) + 1, F.length(x))
    first = F.left(rest, F.lit(1))
    return F.when(F.startswith(x, label) & first.isin("：", ":", " "), strip(F.substring(rest, F.lit(2), F.length(rest))))


def comma_parts(c: Column | str, full_width: bool = True) -> Column:
    """STR9: trimmed parts between commas, full-width ones too."""
    c = col(c)
    return F.transform(F.split(F.translate(c, "，", ",") if full_width else c, ","), strip)


def percent(part: Column, whole: Column) -> Column:
    """AGG6, STR10: one decimal and a percent sign; null where the whole is zero."""
    return F.when(whole > 0, F.format_string("%.1f%%", (part * 100.0 / whole).cast("double")))


def safe_number(c: Column | str) -> Column:
    """MT4: the number, or 0."""
    return F.coalesce(strip(col(c)).try_cast("double"), F.lit(0.0))


def status_of(confidence: Column) -> Column:
    """MT3: confirmed from 0.8, review from 0.4, else empty."""
    return F.when(confidence >= V.CONFIRM_FROM, "confirmed").when(confidence >= V.REVIEW_FROM, "review").otherwise("empty")


def json_ladder(c: Column | str, kind: str = "array") -> Column:
    """JS1, JS2: the text as JSON, else its fenced block, else from the outermost bracket to the last; the JSON text, or the empty one.

    A step counts only if it parses to an array (or object).
    """
    c = strip(col(c))
    opened, closed, empty = ("[", "]", "[]") if kind == "array" else ("{", "}", "{}")
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(c, rf"(?s)(\{opened}.*\{closed})", 1)
    good = lambda x: F.when(F.startswith(x, F.lit(opened)) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(c), good(strip(fence)), good(inner), F.lit(empty))


def matched_category(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """CL1: the first category one of whose keywords the text contains."""
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
