"""Tokenising engineering text: built-in expressions for ASCII, an Arrow UDF for CJK runs and domain terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, dictionary and stop words that must equal the reference's for equal results.
ASCII_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[._:-][A-Za-z0-9]+)*|[0-9]+"
CJK_RUN = "[一-鿿]+"
CAMEL_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SEPARATORS = r"[._:/\\#@$+,\-\s]+"
CJK_TERMS = tuple(
    "知识库 上下文 多路召回 向量检索 关键词检索 混合检索 结构化索引 关系索引 代码索引 查询路由 重排序 来源引用 可追溯 工程知识 业务规则 风险点 风险标签 状态 流转 状态流转 "
    "状态机 接口文档 设计文档 表结构 数据库 数据表 字段 主键 索引 实体关系 模块 核心类 相关类 方法 类名 方法名 调用链 影响分析 单元测试 异常处理 错误码 幂等 重试 补偿 回滚 "
    "权限 审计 支付 订单 支付订单 报文 支付报文 校验 审批 审批流 现金流 现金流审批 资金 资金安全 风控 对账 清算 结算 账务 交易 金额 付款 收款 退款 入账 出账 余额 账户 商户 "
    "客户 凭证 限额 费率 汇率".split()
)
CJK_STOPWORDS = frozenset("一个 一些 这个 那个 哪些 什么 怎么 如何 是否 以及 或者 并且 相关 涉及 需要 当前".split())
CJK_LEAST, CJK_MOST_GRAM = 2, 4

_RUN = re.compile(CJK_RUN)


def split_token(token: Column) -> Column:
    """The pieces of one ASCII token: its parts, their camel-case pieces, and the dotted whole if it has several parts."""
    parts = F.filter(F.split(token, SEPARATORS), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lower(p)), F.transform(F.split(p, CAMEL_BOUNDARY), F.lower))))
    dotted = F.when(F.size(parts) > 1, F.array(F.lower(F.array_join(parts, ".")))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(pieces, dotted)), lambda p: F.length(p) > 1)


def ascii_tokens(text: Column) -> Column:
    """All tokens of a text, one set of pieces for each occurrence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ASCII_TOKEN), F.lit(0))
    return F.flatten(F.transform(found, split_token))


class Segmenter:
    """Segments CJK runs by longest dictionary match, unknown spans by n-grams of falling length."""

    def __init__(self, domain_terms: Iterable[str] = ()):
        self.domain = sorted({t for x in domain_terms if len(t := x.strip().lower()) > 1})
        terms = {*CJK_TERMS, *(t for t in self.domain if _RUN.search(t))}
        self.terms = sorted(terms, key=lambda t: (-len(t), t))
        self.longest_first = re.compile("|".join(map(re.escape, self.terms)))

    def _grams(self, span: str) -> list[str]:
        sizes = range(min(CJK_MOST_GRAM, len(span)), CJK_LEAST - 1, -1)
        return [span[i : i + size] for size in sizes for i in range(len(span) - size + 1)]

    def run(self, run: str) -> list[str]:
        """Distinct tokens of one CJK run, in order of discovery."""
        found = [run, *(t for t in self.terms if t in run)]
        at = 0
        for m in self.longest_first.finditer(run):
            found += [*self._grams(run[at : m.start()]), m.group()]
            at = m.end()
        found += self._grams(run[at:])
        return [t for t in dict.fromkeys(found) if len(t) >= CJK_LEAST and t not in CJK_STOPWORDS and _RUN.search(t)]

    def text(self, text: str | None) -> list[str]:
        """Tokens of the domain terms in a text, and of its CJK runs."""
        if not text:
            return []
        low = text.lower()
        out: list[str] = []
        for term in self.domain:
            if term in low:
                out += Segmenter((term,)).run(term) if _RUN.search(term) else ascii_pieces(term)
        for run in _RUN.findall(text):
            out += self.run(run.lower())
        return out


def ascii_pieces(token: str) -> list[str]:
    """split_token for a driver-side string."""
    parts = [p for p in re.split(SEPARATORS, token) if p]
    pieces = {q.lower() for p in parts for q in (p, *re.split(CAMEL_BOUNDARY, p))}
    if len(parts) > 1:
        pieces.add(".".join(parts).lower())
    return sorted(p for p in pieces if len(p) > 1)


def cjk_tokens(text: Column, domain_terms: Sequence[str] = ()) -> Column:
    terms = tuple(domain_terms)
    kept: dict[str, Segmenter] = {}

    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        s = kept.setdefault("", Segmenter(terms))
        return texts.map(s.text)

    # texts without a CJK character go to the worker as nulls
    return segment(text) if terms else segment(F.when(text.rlike(CJK_RUN), text))


def text_tokens(text: Column, domain_terms: Sequence[str] = (), cjk: bool = True) -> Column:
    """All tokens of a text, repeated as they occur."""
    return F.concat(cjk_tokens(text, domain_terms), ascii_tokens(text)) if cjk or domain_terms else ascii_tokens(text)


def query_tokens(text: Column, domain_terms: Sequence[str] = (), cjk: bool = True) -> Column:
    return F.array_sort(F.array_distinct(text_tokens(text, domain_terms, cjk)))


def symbol_terms(text: Column) -> Column:
    """Terms to look symbols up by: each ASCII token as written, in lower case, and its pieces."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ASCII_TOKEN), F.lit(0)), lambda t: F.length(t) > 1)
    terms = F.flatten(F.transform(found, lambda t: F.concat(F.array(t, F.lower(t)), split_token(t))))
    return F.array_sort(F.array_distinct(terms))


def token_cost(*texts: Column) -> Column:
    """Estimated tokens of texts joined by blanks: a quarter of the ASCII and half of the other characters, at least 1."""
    text = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    cost = F.floor(ascii_chars / 4) + F.floor((F.length(text) - ascii_chars) / 2)
    return F.greatest(F.lit(1), cost).cast("int")


def flat_metadata(metadata: Column) -> Column:
    return F.array_join(F.map_values(metadata), " ")


def glob_regex(pattern: str) -> str:
    """A file glob (case matters, * crosses /) as a regular expression for the whole path."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"
