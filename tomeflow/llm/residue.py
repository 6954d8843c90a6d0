"""Problem 1: template residue, filler text, error pages and script notices among summaries.

An unfilled placeholder, in the notation of a template language, decides alone: such a slot inside
a story is residue too. All else is decided by a sum of evidence, of which no part is enough alone:

* terms: how much more often the body's terms (words, pairs of Chinese characters) occur in
  responses than in stories, as a mean of log-odds. They are learnt from the corpus: *responses* are
  bodies with the mark of a machine (or two words of the web) that share no term with their title
  or address slug; *stories* are bodies without a mark that do share one. Every different body counts
  once, however often it was sent;
* marks: a status line, markup, an error object, a request's id, a script's name, the published
  filler vocabularies. A story that mentions such a thing has stories' terms around it;
* fit: whether the body shares a term with its title or its source's slug;
* duplication: the same body, without heading, numbers, ids and repeats, under several sources, none
  of which it fits, as a low-information response that belongs to no page in particular would be;
* host: the rate of responses of the source that it came from, shrunk towards the corpus rate.

Short true summaries that recur ("They part.") have no response's terms and stay. Null, empty and
blank summaries aren't residue. Repeated rows are judged alike, whatever their number.

A response in words that no marked response of the corpus has can't be told from a short summary
and stays. Only the terms' counts, (signature, source) pairs and one row for each source are shuffled.
The vocabulary sent to the workers holds the terms in at least ``MIN_SHARE`` of a class's bodies, so it has at most (mean distinct terms of a body) * 2 / ``MIN_SHARE`` entries.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from tomeflow.session import checkpointed

THRESHOLD, MIN_SOURCES, MIN_SHARE, HOST_PRIOR = 1.3, 3, 0.0005, 20.0
MARK, WEB, DUPLICATE, UNFIT, FIT, HOST, CLIP = 0.75, 0.5, 0.5, 0.25, -0.5, 0.25, 3.0

# The notations of template languages with the names of their slots, the reason phrases
# of HTTP, and the words of browsers, servers, editors and filler texts.
SLOT_WORDS = "书名|卷名|章节|章名|主角|配角|情节|剧情|摘要|内容|作者|人物|标题|姓名|简介|概要|正文|title|name|chapter|summary|content|plot|author|hero|protagonist|volume|insert|novel|book"
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|<\?=[^?\n]{1,60}\?>|%\([\w.]{1,40}\)[sdr]|%[A-Z][A-Z_]{2,30}%"
    r"|@@[\w. ]{1,40}@@|(?<![A-Za-z0-9_])__[A-Za-z一-鿿][\w.]{0,40}?__(?![A-Za-z0-9_])|\[\[[^\[\]\n]{1,60}\]\]|##[\w.]{2,40}##"
    r"|[\[<【（(]\s*(?:insert|your|enter|put|add)\b[^\]>】）)\n]{1,60}[\]>】）)]|[\[【<（(][^\]】>）)\n]{0,16}(?:待填|待补|待定|待写|占位)[^\]】>）)\n]{0,6}[\]】>）)]"
    rf"|\$(?:[^\s$\d]{{0,8}})(?:{SLOT_WORDS})[^\s$\d]{{0,8}}\$|[<\[](?:[^\s<>\[\]]{{0,6}})(?:{SLOT_WORDS})(?:[^\s<>\[\]]{{0,6}})[>\]]",
    re.I,
)
SLOT_SIGN = re.compile(r"[{$%<@_\[#【（(]")
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed|"
    "payload too large|unsupported media type|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out"
)
MARKS = [
    re.compile(p, re.A)  # Chinese characters bound a word, too
    for p in (
        rf"\b[1-5]\d\d\b\W*(?:{REASONS})\b|\bhttp[ /]?\d|\bstatus\W{{0,3}}[1-5]\d\d\b|\btraceback\b|\bexception\b|\btime-?out\b",
        r"<(?:!doctype|html|head|body|noscript|center|title|h1)\b|\"(?:error|code|status|message)\"\s*:",
        r"\bjava ?script\b|\bjs\b|\bcookies?\b|\bscripting\b",
        r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,32}\b",
        r"\blorem\b|\bipsum\b|\b(?:tbd|todo|tba|n/a|asdf|qwerty|qwer|foo|bar|baz|xxx+)\b|\btest test\b|\b(?:placeholder|sample|dummy|demo|filler)\b.{0,12}\b(?:text|content)\b",
        r"占位|待补充|待完善|示例|测试文本|测试内容|默认(?:描述|内容|文字)|(?:内容|正文)略|替换为",
    )
]
WEB_WORDS = re.compile(r"\b(?:pages?|server|browser|reload|refresh|request(?:ed|s)?|loading|loaded|error|access|denied|gateway|website|url|session|scripts?)\b|脚本|页面|服务器|浏览器|刷新|请求|加载|错误|网址|网站|首页|跳转|访问|登录|系统|数据库", re.A)
HEADING = re.compile(r"^\s*(?:第\s*[\d〇零一二三四五六七八九十百千两]{1,9}\s*[章回节话話卷][^\n]{0,60}|(?:chapter|part|book)\s+[\divxlc]+\b[^\n]{0,80})\n", re.I)
RUN = re.compile(r"[a-zà-ɏ0-9/'’]+|[㐀-鿿]+")
REPEAT = re.compile(r"(.{2,24}?)\1+", re.S)
NUMBER = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b|\d+", re.A)
NO_LETTER = re.compile(r"[\W_]+")


def body_of(text: str, title: str | None) -> str:
    """The summary without a heading above it."""
    if title and text.startswith(title):
        text = text[len(title) :]
    return HEADING.sub("", text, count=1).strip()


def has_placeholder(text: str) -> bool:
    return SLOT_SIGN.search(text) is not None and PLACEHOLDER.search(text) is not None


def terms(text: str) -> set[str]:
    """Words and short numbers, without ids, and pairs of Chinese characters, of lower-case text."""
    out: set[str] = set()
    for run in RUN.findall(text):
        if run[0] >= "㐀":
            out.update([run[i : i + 2] for i in range(len(run) - 1)] or [run])
        elif run.isalpha() or len(run) < 4 or not any(c.isdigit() for c in run):
            out.add(run)
    return out


@lru_cache(maxsize=4096)
def _own_terms(title: str, slug: str) -> frozenset[str]:
    """The terms that a body must share to fit: of the title and the slug, without short and numbering words."""
    found = terms(f"{title} {slug.replace('-', ' ').replace('_', ' ')}".lower())
    return frozenset(t for t in found if t[0] >= "㐀" or len(t) > 3) - {"chapter", "part", "book", "volume"}


def signature(body: str) -> str:
    """A body without numbers, ids, space, punctuation and repeats, hashed."""
    plain = REPEAT.sub(r"\1", NO_LETTER.sub("", NUMBER.sub("#", body.lower())))
    return hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=12).hexdigest()


def look(text: str, title: str | None, slug: str | None) -> tuple[str, set[str], int, bool, bool]:
    """(body, its terms, kinds of marks, whether it has two words of the web, whether it fits title or slug)."""
    body = body_of(text, title)
    low = body.lower()
    found = terms(low)
    web = False
    first = WEB_WORDS.search(low)
    if first:
        web = any(m[0] != first[0] for m in WEB_WORDS.finditer(low, first.end()))
    return body, found, sum(p.search(low) is not None for p in MARKS), web, not found.isdisjoint(_own_terms(title or "", slug or ""))


class Vocabulary:
    """How much more often each term occurs in responses than in stories."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_responses: int, n_stories: int):
        self.weight = {t: max(-CLIP, min(CLIP, math.log((a + 0.5) / (n_responses + 1)) - math.log((b + 0.5) / (n_stories + 1)))) for t, (a, b) in counts.items()}

    def mean(self, found: set[str]) -> float:
        get = self.weight.get
        return sum(get(t, 0.0) for t in found) / len(found) if found else 0.0

    def score(self, text: str | None, title: str | None, slug: str | None) -> float:
        """The evidence of a row's own, without that of its copies and its host."""
        if text is None or not text.strip():
            return -CLIP
        if has_placeholder(text):
            return 2 * THRESHOLD
        _, found, marks, web, fits = look(text, title, slug)
        return self.mean(found) + MARK * min(2, marks) + WEB * web + (FIT if fits else UNFIT)


def vocabulary(rows: DataFrame, min_share: float = MIN_SHARE) -> Vocabulary:
    """Out of rows of (source, title, text)."""

    def classed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for source, title, text in zip(pdf["source"], pdf["title"], pdf["text"]):
                if text is None or not text.strip() or has_placeholder(text):
                    continue
                body, found, marks, web, fits = look(text, title, source)
                if found and (marks or web) != fits:
                    out.append((signature(body), source, not fits, sorted(found)))
            yield pd.DataFrame(out, columns=["signature", "source", "response", "terms"]).astype({"response": bool})

    each = rows.select("source", "title", "text").mapInPandas(classed, f"signature string, source {dict(rows.dtypes)['source']}, response boolean, terms array<string>").groupBy("signature", "source", "response").agg(F.min("terms").alias("terms"))
    counted = checkpointed(each.select("response", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.sum(F.col("response").cast("bigint")).alias("a"), F.sum((~F.col("response")).cast("bigint")).alias("b")))
    total = counted.where("term = ''").first()  # a term that every body has
    n_responses, n_stories = (total["a"], total["b"]) if total else (0, 0)
    common = counted.where((F.col("term") != "") & ((F.col("a") >= max(1.0, min_share * n_responses)) | (F.col("b") >= max(1.0, min_share * n_stories))))
    table = common.toArrow()
    return Vocabulary({t: (a, b) for t, a, b in zip(*(table.column(i).to_pylist() for i in range(3)))}, n_responses, n_stories)


def residue_scores(rows: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """(table_name, record_id, score, placeholder, own, duplicated, host_shift) for rows of (table_name, record_id, source, title, text); null texts have the lowest score.

    own: the row's own evidence; duplicated: whether it is one of several sources' same body and fits none;
    host_shift: what its source's rate adds. A placeholder's score is above every threshold.
    """
    kinds = dict(rows.dtypes)
    known = rows.sparkSession.sparkContext.broadcast(vocabulary(rows))

    def judged(batches: Iterator) -> Iterator:
        import pandas as pd

        words = known.value
        for pdf in batches:
            out = []
            for source, title, text in zip(pdf["source"], pdf["title"], pdf["text"]):
                if text is None or not text.strip():
                    out.append((False, -CLIP, None))
                elif has_placeholder(text):
                    out.append((True, 2 * THRESHOLD, None))
                else:
                    body, found, marks, web, fits = look(text, title, source)
                    own = words.mean(found) + MARK * min(2, marks) + WEB * web + (FIT if fits else UNFIT)
                    out.append((False, own, None if fits or not body else signature(body)))
            yield pd.concat([pdf[["table_name", "record_id", "source"]], pd.DataFrame(out, columns=["placeholder", "own", "signature"], index=pdf.index)], axis=1)

    schema = f"table_name string, record_id {kinds['record_id']}, source string, placeholder boolean, own double, signature string"
    table = checkpointed(rows.select("table_name", "record_id", "source", "title", "text").mapInPandas(judged, schema))
    found = F.col("own") >= THRESHOLD
    rates = table.groupBy(F.col("source").alias("host")).agg(F.sum((found & ~F.col("placeholder")).cast("bigint")).alias("hits"), F.count("*").alias("n"))
    total = rates.agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).first()
    base = min(max((total["hits"] or 0) / max(1, total["n"] or 0), 1e-3), 0.5)
    logit = lambda c: F.log(c / (1 - c))
    rate = F.greatest(F.lit(1e-3), F.least(F.lit(0.999), (F.col("hits") + HOST_PRIOR * base) / (F.col("n") + HOST_PRIOR)))
    hosts = rates.select("host", (HOST * (logit(rate) - math.log(base / (1 - base)))).alias("host_shift"))
    copies = table.where("signature IS NOT NULL").select("signature", "source").distinct().groupBy("signature").agg(F.count("*").alias("n_sources")).where(F.col("n_sources") >= min_sources)
    out = table.join(copies, "signature", "left").join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    duplicated = F.col("n_sources").isNotNull()
    score = F.when(F.col("placeholder") | (F.col("own") <= -CLIP), F.col("own")).otherwise(F.col("own") + F.when(duplicated, DUPLICATE).otherwise(0.0) + F.coalesce("host_shift", F.lit(0.0)))
    return out.select("table_name", "record_id", score.alias("score"), "placeholder", "own", duplicated.alias("duplicated"), "host_shift")


def summaries(spark, sf_dir: str) -> DataFrame:
    audited = spark.read.parquet(f"{sf_dir}/suspicious_summaries.parquet").select(F.lit("suspicious_summaries").alias("table_name"), F.col("audit_id").alias("record_id"), F.col("novel_id").alias("source"), "title", F.col("summary").alias("text"))
    states = spark.read.parquet(f"{sf_dir}/chapter_task_states.parquet").select(F.lit("chapter_task_states").alias("table_name"), F.col("state_id").alias("record_id"), F.col("novel_id").alias("source"), "title", F.col("chapter_summary").alias("text"))
    return audited.unionByName(states)


def p1_found(spark, sf_dir: str) -> DataFrame:
    return residue_scores(summaries(spark, sf_dir)).where(F.col("score") >= THRESHOLD).select("table_name", "record_id")


def p1_clean(spark, sf_dir: str) -> DataFrame:
    """The summaries that are left, with their texts; those without text are left out."""
    rows = summaries(spark, sf_dir)
    kept = rows.join(p1_found(spark, sf_dir), ["table_name", "record_id"], "left_anti")
    return kept.where(F.length(F.regexp_replace("text", r"(?U)\s", "")) > 0).select("table_name", "record_id", "text")
