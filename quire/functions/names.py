"""Names of characters and claims about them, as columns. The patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import stripped

LONGEST = 30
WRAPPERS = "[「」『』\"'.。 ]"
IN_BRACKETS = r"\s*[（(][^）)]{1,30}[）)]\s*$"
TITLE = r"^(?:第[0-9一二三四五六七八九十百]+皇子|皇太子|皇女|皇子|皇帝|皇后|国王|王妃|公爵|侯爵|伯爵|子爵|男爵)\s*"
HONORIFIC = r"(?:さん|さま|様|殿|君|くん|ちゃん|陛下|閣下|嬢)"
ROLES = "皇帝 皇后 皇太子 皇子 皇女 国王 王妃 武官 文官 官吏 女官 女官長 侍女 兵 兵士 護衛 宦官 側近 店主 主人 母 父 兄 姉 弟 妹".split()
ROLE_OF = r"^.{1,12}(?:国|宮|家|軍)の(?:皇帝|皇后|国王|王妃|武官|文官|官吏|女官|兵|護衛)$"
CJK_NAME = r"^[㐀-鿿々〆ヵヶ]{3,5}$"


def unwrapped(raw: Column) -> Column:
    return F.regexp_replace(stripped(raw), f"^{WRAPPERS}+|{WRAPPERS}+$", "")


def character_name(raw: Column) -> Column:
    """A name without wrappers, brackets, title and honorifics; null for a mere role, nothing, or over 30 characters."""
    name = stripped(F.regexp_replace(unwrapped(raw), "(?U)" + IN_BRACKETS, ""))
    name = stripped(F.regexp_replace(name, "(?U)" + TITLE, ""))
    name = stripped(F.regexp_replace(name, rf"(?U)(?:{HONORIFIC}\s*)+$", ""))
    return F.when((name != "") & (F.length(name) <= LONGEST) & ~name.isin(*ROLES) & ~name.rlike(ROLE_OF), name)


def character_names(raw: Column) -> Column:
    """The names of a list with commas of either kind, each once, in order."""
    parts = F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("、"), F.lit(",")), ",")
    return F.array_distinct(F.array_compact(F.transform(parts, character_name)))


def short_forms(name: Column) -> Column:
    """Forms of a name that count only with repeated evidence: without the first of three to five CJK characters, or the part
    of four characters or more before a middle dot."""
    first = stripped(F.substring_index(name, "・", 1))
    none = F.array().cast("array<string>")
    return F.when(name.rlike(CJK_NAME), F.array(F.substr(name, F.lit(2)))).when(F.contains(name, F.lit("・")) & (F.length(first) >= 4), F.array(first)).otherwise(none)


def merged_entries(entries: DataFrame, group: str, place: str, name: str, summary: str) -> DataFrame:
    """(group, name, summary, aliases): entries of one normalised name put together in order, without empty summaries."""
    rows = entries.select(group, place, character_name(F.col(name)).alias("__n"), unwrapped(F.col(name)).alias("__a"), F.trim(F.coalesce(summary, F.lit(""))).alias("__s"))
    rows = rows.filter("__n is not null and __s <> ''")
    lists = rows.groupBy(group, "__n").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("__s").alias("s"), F.col("__a").alias("a")))).alias("__l"))
    parts = lambda f: F.array_distinct(F.transform("__l", lambda x: x[f]))
    return lists.select(group, F.col("__n").alias(name), F.array_join(parts("s"), "\n").alias(summary), F.array_union(F.filter(parts("a"), lambda a: a != ""), F.array("__n")).alias("aliases"))


def claims(summary: Column) -> Column:
    """The sentences of a summary, line by line, trimmed, without empty ones."""
    lines = F.transform(F.split(F.coalesce(summary, F.lit("")), r"\r\n|[\n\r]"), stripped)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[。！？!?])")))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")
