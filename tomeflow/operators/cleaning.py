"""Advertisement and author's notes among a chapter's paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomeflow.functions.text import contains_any

# Words, and patterns, of advertisement.
AD_WORDS = [
    "推荐票", "月票", "收藏本站", "加入书签", "更新最快", "最新章节", "求订阅", "求月票", "求推荐", "求收藏", "投推荐票", "投月票",
    "手打", "无弹窗", "笔趣", "手机看", "手机阅读", "手机用户", "正版订阅", "正版首发", "首发更新", "首发网站",
    "请收藏", "请投", "请支持", "请投票", "微信公众号", "微信搜索", "微信上搜", "下载app", "下载APP", "APP免费",
    "粉丝节", "起点币", "起点中文网首发", "公众号", "公众账号",
]
AD_PATTERNS = [r"(?i)https?://", r"(?iU)www\.\S+", "(?d)（?本文来自.+）?", "(?d)（?求.{0,6}票.{0,6}）", r"(?dU)PS[\.\s：:].{0,80}(月票|推荐|粉丝节|投票|支持|赞赏)"]
# Words that an advertisement may have.
WEAK_WORDS = [
    "兄弟姐妹", "书友", "感谢", "拜谢", "多谢", "致歉", "抱歉", "请假", "今天", "明天", "昨天", "更新", "上传", "补上", "加更", "爆更",
    "新书", "完结", "上架", "免费", "冲榜", "成绩", "订阅", "读者", "辰东", "作者", "作品",
]
MAX_SUSPICIOUS, FIRST, LAST, BATCH = 200, 2, 3, 15


def is_ad(text: str, words: list[str] | None = None, patterns: list[str] | None = None) -> F.Column:
    found = contains_any(text, AD_WORDS if words is None else words)
    for p in AD_PATTERNS if patterns is None else patterns:
        found = found | F.col(text).rlike(p)
    return found


def is_suspicious(text: str, index: str, total: str, words: list[str] | None = None) -> F.Column:
    """Short, among the first or last of its chapter, and with a weak word."""
    edge = (F.col(index) < FIRST) | (F.col(index) >= F.col(total) - LAST)
    return (F.length(text) <= MAX_SUSPICIOUS) & edge & contains_any(text, WEAK_WORDS if words is None else words)


def judged(suspicious: DataFrame, text_col: str, classifier) -> DataFrame:
    """(text, is_ad): a classifier's verdict on each distinct text, in batches; failures mean no."""
    import pandas as pd

    def run(pdfs):
        for pdf in pdfs:
            texts, out = list(pdf.iloc[:, 0]), []
            for i in range(0, len(texts), BATCH):
                part = texts[i : i + BATCH]
                try:
                    out += [bool(x) for x in classifier(part)]
                except Exception:  # a provider's failure of any kind
                    out += [False] * len(part)
            yield pd.DataFrame({"text": texts, "is_ad": out})

    return suspicious.select(F.col(text_col).alias("text")).distinct().mapInPandas(run, "text string, is_ad boolean")


def clean(paragraphs: DataFrame, key: list[str], classifier=None) -> DataFrame:
    """``paragraphs`` (key, index, text) without advertisement; chapters left empty vanish and the rest are renumbered as chapter_no."""
    rows = paragraphs.where(~is_ad("text"))
    if classifier is not None:
        # only short texts with a weak word can be suspicious, so no other is joined with its chapter's size
        weak = rows.where((F.length("text") <= MAX_SUSPICIOUS) & contains_any("text", WEAK_WORDS))
        total = paragraphs.groupBy(*key).agg(F.count("*").alias("total"))
        verdicts = judged(weak.join(total, key).where(is_suspicious("text", "index", "total")), "text", classifier)
        rows = rows.join(verdicts.where("is_ad"), "text", "left_anti")
    w = Window.partitionBy(key[:-1]).orderBy(key[-1])
    numbers = rows.select(*key).distinct().withColumn("chapter_no", F.row_number().over(w))
    return rows.join(numbers, key).select(*key, "chapter_no", "index", "text")
