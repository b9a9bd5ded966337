"""EX1: categories of errors, by exception type and its parents."""

from __future__ import annotations

import builtins
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: category and message by exception
CATEGORIES: dict[type, tuple[str, str]] = {
    json.JSONDecodeError: ("input", "JSON格式错误，请检查输入数据"),
    FileNotFoundError: ("input", "文件不存在，请确认路径"),
    PermissionError: ("input", "文件权限不足，无法读取"),
    IsADirectoryError: ("input", "路径是目录而非文件"),
    ValueError: ("input", "参数值无效"),
    TypeError: ("input", "参数类型错误"),
    KeyError: ("input", "缺少必要字段"),
    ConnectionError: ("infra", "网络连接失败，请稍后重试"),
    TimeoutError: ("infra", "请求超时，请稍后重试"),
    OSError: ("infra", "系统IO异常"),
    MemoryError: ("infra", "内存不足"),
}
UNKNOWN = ("unknown", "操作失败")


def category_of(kind: type) -> tuple[str, str]:
    """Category and message of an exception type: its own, else its nearest parent's, else unknown."""
    return next((CATEGORIES[k] for k in kind.__mro__ if k in CATEGORIES), UNKNOWN)


def error_name(name: Column, detail: Column) -> Column:
    """(category, message) of an error recorded by its type's name and detail; the library's and Python's own types are known."""
    known = {k.__name__: k for k in [*CATEGORIES, *vars(builtins).values()] if isinstance(k, type) and issubclass(k, Exception)}
    category, message = F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1])
    for answer in dict.fromkeys(map(category_of, known.values())):
        names = [n for n, k in known.items() if category_of(k) == answer]
        category, message = F.when(name.isin(names), F.lit(answer[0])).otherwise(category), F.when(name.isin(names), F.lit(answer[1])).otherwise(message)
    return F.struct(category.alias("category"), F.concat(message, F.lit("（"), F.coalesce(detail, F.lit("")), F.lit("）")).alias("message"))
