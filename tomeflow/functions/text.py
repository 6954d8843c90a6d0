"""Text expressions. All are built-in Column expressions; lengths are code points.

Java's ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` is set, and ``^`` and ``.`` know more line ends
than ``\\n`` unless ``(?d)`` is, so both are set wherever they matter. Null in, null out, unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CJK = r"[\x{4e00}-\x{9fff}]"

# What a failed, refused or placeholder answer of a summariser looks like.
FAILURE_PATTERNS = [
    r"请提供.*(内容|主题|文本)",
    r"未提供.*(主题|内容|文本)",
    r"无法生成.*(总结|摘要)",
    r"我是一个ai助手",
    r"这是一个(示例|通用|简短).*(总结|摘要)",
    r"rate\s*limit|429|too\s*many\s*requests|api\s*error|providererror",
]
# The ingest filter knows two more.
INVALID_PATTERNS = [*FAILURE_PATTERNS[:5], r"json格式的输出", r"return\s+json", FAILURE_PATTERNS[5]]
# Words of an unsure answer.
UNSURE = ["我不知道", "无法回答", "不确定", "不清楚", "没有找到", "I don't know", "cannot answer", "not sure", "not found", "INSUFFICIENT"]
# The kinds of question by the words that give them away; the first kind that fits holds.
QUESTION_KINDS = [
    ("listing", ["有哪些", "有什么", "列举", "列出", "哪些", "多少", "几个"]),
    ("comparative", ["区别", "不同", "比较", "对比", "差异"]),
    ("causal", ["为什么", "原因", "如何导致", "来历", "来源"]),
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def non_empty(c: Column | str) -> Column:
    """``c``, or null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def collapse_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def shorten(c: Column | str, n: int) -> Column:
    """Collapsed, and cut to n code points, the last of them an ellipsis, where it is longer."""
    s = collapse_space(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def normalize_key(c: Column | str) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(col(c)), r"(?U)\s+", "")


def keyword_count(text: Column | str, query: str) -> Column:
    """Occurrences of ``query`` in ``text`` that don't overlap, without regard to case, as int; 0 for null."""
    if not query:
        raise ValueError("an empty query is rejected")
    low, q = F.lower(F.coalesce(col(text), F.lit(""))), query.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("int")


def contains_any(text: Column | str, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | col(text).contains(w)
    return found


def slugify(c: Column | str) -> Column:
    """Lower case, all but letters and numbers as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def chapter_id(index: Column | str) -> Column:
    return F.format_string("ch_%04d", col(index))


def volume_title(title: Column | str) -> Column:
    """The volume that a chapter title opens, else null."""
    t = col(title)
    return F.coalesce(
        non_empty(F.regexp_extract(t, "(?d)第.{1,6}卷", 0)),
        non_empty(F.regexp_extract(t, r"(?iU)Volume\s+\w+", 0)),
        F.when(t.contains("卷") & (F.length(t) <= 20), strip(t)),
    )


def heading(text: Column | str) -> Column:
    """The chapter heading in a text's first 200 code points: its first word, if that is one, and the next; else null."""
    words = F.split(strip(F.substring(col(text), 1, 200)), r"(?U)\s+")
    first = F.get(words, F.lit(0))
    return F.when(first.rlike(r"^第[〇零一二三四五六七八九十百千万两0-9]+章$"), F.concat_ws(" ", first, F.get(words, F.lit(1))))


def tokens(c: Column | str) -> Column:
    """Search tokens in order: words of A-Z in lower case; of other words the CJK characters, then their neighbouring pairs."""
    words = F.filter(F.split(F.regexp_replace(col(c), r"(?U)[^\w\s\x{4e00}-\x{9fff}]", " "), r"(?U)\s+"), lambda w: w != "")
    one = lambda w: F.regexp_extract_all(w, F.lit(f"({CJK})"), F.lit(1))

    def of(w: Column) -> Column:
        def with_pairs(chars: Column) -> Column:
            n = F.greatest(F.size(chars) - 1, F.lit(0))
            return F.concat(chars, F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))

        # an array of one binds the characters to a name, so that they are looked for once
        return F.when(w.rlike("^[a-zA-Z]+$"), F.array(F.lower(w))).otherwise(F.transform(F.array(one(w)), with_pairs)[0])

    return F.flatten(F.transform(words, of))


def matches_failure(c: Column | str, patterns: list[str] | None = None) -> Column:
    found = F.lit(False)
    for p in FAILURE_PATTERNS if patterns is None else patterns:
        found = found | col(c).rlike("(?idU)" + p)
    return found


def sanitized_summary(c: Column | str) -> Column:
    """Stripped text, or nothing where it is a failed answer or null."""
    s = strip(F.coalesce(col(c), F.lit("")))
    return F.when(matches_failure(F.lower(s), INVALID_PATTERNS), "").otherwise(s)


def summary_status(content: Column | str, summary: Column | str, failed: Column | str) -> Column:
    blank = lambda c: F.length(strip(F.coalesce(col(c), F.lit("")))) == 0
    return F.when(blank(content), "chapter_content_empty").when(col(failed), "model_summary_error").when(blank(summary), "model_summary_empty").otherwise("ok")


def compact_error(c: Column | str, n: int = 240) -> Column:
    """One line for an error text; an HTML page becomes a code."""
    s, low = F.coalesce(col(c), F.lit("")), F.lower(F.coalesce(col(c), F.lit("")))
    html = low.contains("<!doctype html") | low.contains("<html")
    gateway = low.contains("502") | low.contains("bad gateway")
    return F.when(html & gateway, "upstream_502_bad_gateway_html").when(html, "upstream_html_error_response").otherwise(shorten(s, n))


def length_tier(c: Column | str, short: int, long: int) -> Column:
    n = F.length(F.coalesce(col(c), F.lit("")))
    return F.when(n <= short, "short").when(n >= long, "long").otherwise("medium")


def question_kind(c: Column | str, kinds: list[tuple[str, list[str]]] | None = None) -> Column:
    kinds = QUESTION_KINDS if kinds is None else kinds
    q = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.when(contains_any(q, kinds[0][1]), kinds[0][0])
    for name, words in kinds[1:]:
        out = out.when(contains_any(q, words), name)
    return out.otherwise("general")


def confident(c: Column | str, unsure: list[str] | None = None) -> Column:
    a = F.coalesce(col(c), F.lit(""))
    return ~contains_any(F.lower(a), [w.lower() for w in (UNSURE if unsure is None else unsure)]) & (F.length(strip(a)) > 10)


def extract_keywords(c: Column | str, n: int = 5) -> Column:
    """The first runs of CJK characters."""
    return F.slice(F.regexp_extract_all(col(c), F.lit(f"({CJK}+)"), F.lit(1)), 1, n)


def hash_key(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def summary_from_json(c: Column | str) -> Column:
    """The summary in a model's raw answer: parsed whole, else from the first to the last brace, else the text itself.

    Of an object, the first non-empty of summary, answer, content and raw counts: a string stripped, an
    object by its own summary, answer or content, a list as its elements joined by line breaks.
    """
    t = F.coalesce(col(c), F.lit(""))
    stripped = strip(t)
    inner = F.regexp_extract(stripped, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(stripped), F.try_parse_json(non_empty(inner)))
    out = []
    for key in ("summary", "answer", "content", "raw"):
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
        text = F.try_variant_get(parsed, f"$.{key}", "string")
        nested = F.coalesce(*(non_empty(strip(F.try_variant_get(parsed, f"$.{key}.{k}", "string"))) for k in ("summary", "answer", "content")))
        items = F.filter(F.transform(F.try_variant_get(parsed, f"$.{key}", "array<string>"), strip), lambda x: x != "")
        out.append(F.when(kind.startswith("OBJECT"), nested).when(kind.startswith("ARRAY"), non_empty(F.array_join(items, "\n"))).otherwise(non_empty(strip(text))))
    return F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), stripped).otherwise(F.coalesce(*out, F.lit("")))


#: An array of JSON strings and nothing else.
_STRINGS = r'(?s)\[\s*("(\\.|[^"\\])*+"(\s*,\s*"(\\.|[^"\\])*+")*+)?\s*\]'


def string_array(c: Column | str, n: int = 5) -> Column:
    """The first n strings of the JSON array in free text, from its first bracket to its last; null where that isn't an array of strings."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)\[.*\]", 0)
    return F.when(found.rlike(f"^{_STRINGS}$"), F.slice(F.from_json(found, "array<string>"), 1, n))


def utc_now() -> Column:
    """The query's time in UTC, as ISO text with microseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# What tells a provider's errors apart, in the order in which it is looked for.
ERROR_KINDS = [
    ("quota_exhausted", "disable", ["allocationquota", "quota", "insufficient"]),
    ("upstream_5xx", "throttle", ["502", "503", "504", "bad gateway", "cloudflare"]),
    ("rate_limited", "throttle", ["429", "rate limit", "too many requests"]),
    ("network_error", "throttle", ["timeout", "timed out", "connection"]),
]


def error_decision(c: Column | str) -> Column:
    """struct(action, reason) of a provider's error; null for one that calls for nothing."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = None
    for reason, action, words in ERROR_KINDS:
        held = low.contains(words[0])
        for w in words[1:]:
            held = held | low.contains(w)
        one = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        out = F.when(held, one) if out is None else out.when(held, one)
    return out
