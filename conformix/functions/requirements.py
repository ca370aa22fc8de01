"""Columns that read requirements out of specification text: sentences, numbering, modality, direction, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from conformix.functions.text import QUANTITY, fixed, fmt, nfkc
from conformix.schema import UNIT_MM

# Phrases for "at least" and "at most".
AT_LEAST = (
    "不應小於 不應少於 不應低於 不宜小於 不宜少於 不宜低於 不可小於 不可少於 不能小於 不能少於 不得小於 不得少於 不得低於 不得短於 不小於 不少於 不低於 不短於 "
    "大於或等於 大於等於 至少 最小 最低 最短 >= ≥"
).split() + ["not less than", "no less than", "at least", "minimum", "min."]
AT_MOST = (
    "不應大於 不應超過 不應多於 不應高於 不宜大於 不宜超過 不宜高於 不可大於 不可超過 不能大於 不能超過 不得大於 不得超過 不得多於 不得高於 不得長於 不得逾 "
    "不大於 不多於 不超過 不高於 不長於 小於或等於 小於等於 至多 最多 最大 最高 最長 <= ≤"
).split() + ["not more than", "no more than", "not exceed", "shall not exceed", "at most", "maximum", "max."]
# Words that make a sentence advice, a duty, or a permission.
SOFT = r"(?i)建議|宜(?!用)|儘量|盡量|儘可能|盡可能|最好|適宜|should|recommend|preferabl|if possible"
DUTY = r"(?i)不得|不可|不應|禁止|嚴禁|必須|必需|應(?![用力變])|須|需(?=要|於|設|保|留|有)|至少|shall|must"
ADVICE = r"(?i)宜|可(?!能)|\bmay\b"
# What may stand before a clause, and the characters between which no blank is put.
NUMBERING = (
    r"^\s*(?:[(（]?[0-9一二三四五六七八九十]+[.)、）]\s*|\d+(?:\.\d+)+\s+|第[一二三四五六七八九十百\d]+[章節條款項]\s*|"
    r"[A-Z]\.\d+(?:\.\d+)*\s+|[A-Za-z][.．、)）]\s+|附錄\s*[A-Z](?:-\d+)?\s*|[附錄]+\s*)+"
)
MARKDOWN = r"^\s*(?:[-*+>]\s+|#{1,6}\s+|\|+\s*)+"
IDEOGRAPH = "[　-鿿豈-﫿＀-￯]"
# Numerals of counts.
NUMERALS = {"一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

_PHRASES = "|".join(re.escape(w) for w in sorted(AT_LEAST + AT_MOST, key=len, reverse=True))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def join_lines(text: Column) -> Column:
    """A paragraph's lines as one string: a blank at each break, none beside an ideograph."""
    lines = F.filter(F.transform(F.split(text, r"\R"), _stripped), lambda x: x != "")

    def led(x: Column, i: Column) -> Column:
        beside = F.element_at(lines, F.greatest(i, F.lit(1))).rlike(IDEOGRAPH + "$") | x.rlike("^" + IDEOGRAPH)
        return F.when((i == 0) | beside, x).otherwise(F.concat(F.lit(" "), x))

    return F.array_join(F.transform(lines, led), "")


def sentences(text: Column) -> Column:
    """array<string>: sentences of a paragraph; a point ends one only before a blank and a capital."""
    cut = F.split(join_lines(text), r"(?<=[。；;！？!?])|(?<=\.)(?=\s+[A-Z])")
    return F.filter(F.transform(cut, _stripped), lambda x: x != "")


def without_numbering(sentence: Column) -> Column:
    return _stripped(F.regexp_replace(F.regexp_replace(sentence, MARKDOWN, ""), NUMBERING, ""))


def modality(sentence: Column) -> Column:
    t = nfkc(sentence)
    return F.when(t.rlike(SOFT), "advisory").when(t.rlike(DUTY), "mandatory").when(t.rlike(ADVICE), "advisory").otherwise("unknown")


def direction(sentence: Column) -> Column:
    """struct<operator, words, problem>: the comparison that phrases state; both ways in one sentence is a problem."""
    found = F.regexp_extract_all(nfkc(sentence), F.lit(f"(?i)({_PHRASES})"), F.lit(1))
    ways = F.array_distinct(F.transform(found, lambda w: F.when(F.lower(w).isin(AT_LEAST), ">=").otherwise("<=")))
    one = F.size(ways) == 1
    return F.struct(F.when(one, F.get(ways, F.lit(0))).alias("operator"), F.when(one, F.get(found, F.lit(0))).alias("words"), F.when(F.size(ways) > 1, "BOTH_DIRECTIONS").alias("problem"))


def postfix_direction(sentence: Column) -> Column:
    """The comparison of "300 mm 以上" and the like; null for 以外 and without such words."""
    word = F.regexp_extract(nfkc(sentence), QUANTITY.replace("(?![A-Za-z0-9²³/^·×])", r"?\s*(以上|以下|以內|以外)"), 3)
    return F.when(word == "以上", ">=").when(word.isin("以下", "以內"), "<=")


def to_mm(value: Column, unit: Column) -> Column:
    factor = F.create_map(*[F.lit(x) for u, mm in UNIT_MM.items() for x in (u, str(mm))])
    return F.round(value.cast("decimal(28,9)") * F.try_element_at(factor, unit).cast("decimal(9,3)"), 6).cast("double")


def count_of(token: Column) -> Column:
    """A number written in digits or in numerals from 1 to 99; null for anything else."""
    digit = F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (k, v)])
    tens, ones = F.regexp_extract(token, "^(.?)十(.?)$", 1), F.regexp_extract(token, "^(.?)十(.?)$", 2)
    of = lambda c, empty: F.when(c == "", empty).otherwise(F.try_element_at(digit, c))
    return F.when(token.rlike("^[0-9]+$"), token.cast("int")).when(token.rlike("^.?十.?$"), of(tens, F.lit(1)) * 10 + of(ones, F.lit(0))).otherwise(F.try_element_at(digit, token))


def fmt_num(v: Column) -> Column:
    """At most six decimals, no trailing zeros; nothing for null."""
    return F.coalesce(F.regexp_replace(fixed(v, 6), r"\.?0+$", ""), F.lit(""))


def fmt_gap(v: Column) -> Column:
    """A shortfall, never rounded down to nothing."""
    return F.when((v > 0) & (v < 0.005), "<0.01").otherwise(fmt(v))
