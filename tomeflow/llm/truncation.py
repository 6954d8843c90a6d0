"""Problem 3: values that break off before their end, and how often each source's do.

A value that opens JSON and doesn't close it, or ends in the stub of a character, is cut by its
form. For the text of all others a backward character n-gram model is trained: for the last
1, 2, 3 and 5 characters of a value it compares how often they end a text with how often text goes
on after them, per class of text (language and shape), with each order backing off to the next
shorter one. A value's own end is left out of its counts, and repeated texts train once. A value is cut if
the log-odds of ending at its final context are below the threshold of its class and column, which
is placed in the valley of their own log-odds, from ``BELOW`` under the class's log-odds of ending at
any of its characters to ``ABOVE`` over it.

Only contexts that end some value are counted: a bit for each, in a filter of ``FILTER_BITS`` bits,
is known to the counting tasks, and what the filter lets through by chance drops out of a join.
Contexts are 64-bit hashes of their characters. Null, empty and blank values and residue (problem 1,
by a row's own evidence) aren't cases and train nothing. Copied rows are judged alike.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tomeflow.llm import residue
from tomeflow.session import checkpointed

ORDERS = (1, 2, 3, 5)
SMOOTHING = 4.0
BELOW, ABOVE, STEP = 0.0, 2.0, 0.25
FILTER_BITS = 1 << 24

JSON_KEYS = ("summary", "answer", "content", "raw")
NUMBERED = re.compile(r"^\s*(?:[-*•·]|\d{1,3}[.、)）])\s*")
KANA, HAN, HANGUL, CYRILLIC, WORD = re.compile(r"[぀-ヿ]"), re.compile(r"[㐀-鿿]+"), re.compile(r"[가-힣]"), re.compile(r"[Ѐ-ӿ]"), re.compile(r"[a-zà-ÿ]+")
# Common words that tell languages in Latin script apart.
COMMON_WORDS = {
    "en": "the and of to in is that was for with his her as on but they an at by from".split(),
    "fr": "le la les de des du et un une est dans que qui pour sur pas au".split(),
    "de": "der die das und ist nicht ein eine den dem zu mit von auf sich".split(),
    "es": "el los las y una es en que por con para del se su no".split(),
}
LANGUAGE_OF = {w: [n for n, words in COMMON_WORDS.items() if w in words] for words in COMMON_WORDS.values() for w in words}


def inner_text(value: str) -> tuple[str | None, bool]:
    """(text to judge, whether the form alone says that the value is cut)."""
    text = value.strip()
    fenced = re.match(r"^```\w*\s*(.*?)\s*(```)?$", text, re.S)
    if fenced:
        if not fenced[2]:
            return None, True
        text = fenced[1]
    if text.endswith("�"):
        return None, True
    if not re.match(r"^[{\[]\s*[\"{\[]", text):
        return text, False
    try:
        parsed = json.loads(text, strict=False)
    except ValueError:
        return (text, False) if _balanced(text) else (None, True)
    if isinstance(parsed, list) and parsed:
        parsed = parsed[-1]
    if isinstance(parsed, dict):
        parsed = next((parsed[k] for k in JSON_KEYS if isinstance(parsed.get(k), str)), None)
    if not isinstance(parsed, str) or not parsed.strip():
        return None, False
    parsed = parsed.strip()
    return (None, True) if parsed.endswith("�") else (parsed, False)


def _balanced(text: str) -> bool:
    """Whether all strings and brackets of a text that isn't valid JSON are closed."""
    depth, quoted, escaped = 0, False, False
    for c in text:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), quoted and (c != '"' or escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return depth <= 0 and not quoted


def language_of(text: str) -> str:
    """The language by script and, in Latin script, by its common words; what has none of them is "latin"."""
    if KANA.search(text):
        return "ja"
    if sum(map(len, HAN.findall(text))) * 4 > len(text):
        return "zh"
    if HANGUL.search(text):
        return "ko"
    if CYRILLIC.search(text):
        return "ru"
    votes: dict[str, int] = {}
    for word in WORD.findall(text.lower()):
        for name in LANGUAGE_OF.get(word, ()):
            votes[name] = votes.get(name, 0) + 1
    return max(votes, key=lambda n: (votes[n], n)) if votes else "latin"


def class_of(text: str, *beside: str | None) -> str:
    """Language and shape. beside: texts that tell the language of one in Latin script that is too short to."""
    first = NUMBERED.match(text)
    language = language_of(text)
    if language == "latin":
        language = next((n for n in map(language_of, filter(None, beside)) if n in COMMON_WORDS), language)
    return f"{language}/{'list' + first[0].strip()[-1] if first else 'prose'}"


def hashed(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k characters in a row."""
    n = max(0, len(codes) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def contexts_of(tail: str) -> list[int | None]:
    """The hashes of a value's last characters in each order; null for those longer than it."""
    c = codes_of(tail)
    return [int(hashed(c[-k:], k).view(np.int64)[0]) if len(c) >= k else None for k in ORDERS]


def context_counts(texts: list[str], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, how often text goes on after it, how often it ends one), of those that the filter knows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = codes_of("".join(texts))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the text's end
    keys, ends = [], []
    for k in ORDERS:
        h = hashed(codes, k)
        inside = left[: len(h)] >= k
        h, last = h[inside], left[: len(h)][inside] == k
        if bits is not None:
            at = h & np.uint64(FILTER_BITS - 1)
            known = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            h, last = h[known], last[known]
        keys.append(h)
        ends.append(last)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    last = np.concatenate(ends)
    n_end = np.bincount(at[last], minlength=len(key))
    return key.view(np.int64), np.bincount(at, minlength=len(key)) - n_end, n_end


def filter_of(table: DataFrame) -> np.ndarray:
    """The bits of all contexts of ``table``: at most FILTER_BITS / 64 rows reach the driver."""
    slot = F.col("context").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = table.select(F.explode("contexts").alias("context")).where("context IS NOT NULL").select(slot.alias("slot")).distinct()
    rows = words.groupBy((F.shiftrightunsigned("slot", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint64)


def valley(bins: dict[float, int], low: float, high: float) -> float:
    """The middle of the emptiest stretch between low and high; bins: values by log-odds."""
    steps = [low + STEP * i for i in range(int((high - low) / STEP) + 1)]
    weight = lambda x: sum(n for b, n in bins.items() if x - 1.5 * STEP <= b <= x + 1.5 * STEP)
    least = min(map(weight, steps))
    best = [x for x in steps if weight(x) == least]
    return best[len(best) // 2]


def values(states: DataFrame) -> DataFrame:
    """(state_id, field_name, segment_no, model_name, source, title, value) of all non-blank summaries and segment results."""
    keys = ["state_id", "model_name", F.col("novel_id").alias("source"), "title"]
    whole = states.select(*keys, F.lit("chapter_summary").alias("field_name"), F.lit(-1).cast("bigint").alias("segment_no"), F.col("chapter_summary").alias("value"))
    parts = states.select(*keys, F.lit("segment_results").alias("field_name"), F.explode("segment_results").alias("segment_no", "value")).withColumn("segment_no", F.col("segment_no").cast("bigint"))
    return whole.unionByName(parts).where(F.col("value").rlike(r"(?U)\S"))


def truncated_values(states: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(state_id, field_name, segment_no, model_name, truncated, log_odds): one row for each non-blank value.

    states: (state_id, novel_id, title, model_name, chapter_summary, segment_results). The vocabulary
    that tells residue is learnt from chapter_summary, the column that residue is defined for.
    """
    context = states.sparkSession.sparkContext
    kinds = dict(states.dtypes)
    words = context.broadcast(residue.vocabulary(states.select(F.col("novel_id").alias("source"), "title", F.col("chapter_summary").alias("text"))))

    def parsed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for source, title, value in zip(pdf["source"], pdf["title"], pdf["value"]):
                if words.value.score(value, title, source) >= residue.THRESHOLD:
                    out.append((None, None, None, None, False, True))
                    continue
                text, cut = inner_text(value)
                out.append((class_of(text, title, (source or "").replace("-", " ")), text, text[-ORDERS[-1] :], contexts_of(text[-ORDERS[-1] :]), cut, False) if text else (None, None, None, None, cut, False))
            yield pd.concat([pdf[["state_id", "field_name", "segment_no", "model_name"]], pd.DataFrame(out, columns=["class", "text", "tail", "contexts", "cut", "residue"], index=pdf.index)], axis=1)

    schema = f"state_id {kinds['state_id']}, field_name string, segment_no bigint, model_name {kinds['model_name']}, class string, text string, tail string, contexts array<bigint>, cut boolean, residue boolean"
    table = checkpointed(values(states).mapInPandas(parsed, schema))
    with_text = table.where(F.col("text").isNotNull())
    bits = context.broadcast(filter_of(with_text))

    def counted(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, texts in pdf.groupby("class")["text"]:
                key, on, end = context_counts(list(texts), bits.value)
                yield pd.DataFrame({"class": name, "context": key, "goes_on": on, "ends": end})

    texts = with_text.select("class", "text").distinct()
    tails = with_text.select("class", "tail", "contexts").groupBy("class", "tail").agg(F.first("contexts").alias("contexts"))
    suffixes = tails.select("class", "tail", F.posexplode("contexts").alias("k", "context")).where("context IS NOT NULL")
    counts = texts.mapInPandas(counted, "class string, context bigint, goes_on bigint, ends bigint").groupBy("class", "context").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    # classes are few by construction: a few languages and shapes
    totals = {r["class"]: math.log(r["n"] / (r["chars"] + 1)) for r in texts.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    start = F.create_map(*(F.lit(x) for pair in totals.items() for x in pair))[F.col("class")] if totals else F.lit(0.0)
    by_order = suffixes.join(counts, ["class", "context"]).groupBy("class", "tail").agg(*(F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}_{k}") for i, k in enumerate(ORDERS) for c in ("goes_on", "ends")))
    # the chance of going on has a column of its own: at some 50,000 ends of a context that nothing follows, 1 - p is 0
    p, q = F.exp(start), -F.expm1(start)
    for k in ORDERS:
        # one end is the value's own
        ends = F.greatest(F.lit(0), F.coalesce(F.col(f"ends_{k}"), F.lit(1)) - 1)
        on = F.coalesce(F.col(f"goes_on_{k}"), F.lit(0))
        p, q = (ends + SMOOTHING * p) / (ends + on + SMOOTHING), (on + SMOOTHING * q) / (ends + on + SMOOTHING)
    scored = by_order.select("class", "tail", (F.log(p) - F.log(q)).alias("log_odds"))
    judged = checkpointed(table.select("state_id", "field_name", "segment_no", "model_name", "cut", "residue", "class", "tail").join(scored, ["class", "tail"], "left"))
    # two columns, a few classes, and steps of log-odds
    bins: dict[tuple[str, str], dict[float, int]] = {}
    for r in judged.where(F.col("log_odds").isNotNull()).groupBy("field_name", "class", (F.floor(F.col("log_odds") / STEP) * STEP).alias("bin")).count().collect():
        bins.setdefault((r["field_name"], r["class"]), {})[r["bin"]] = r["count"]
    limits = {"|".join(name): valley(b, totals[name[1]] - below, totals[name[1]] + above) for name, b in bins.items()}
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.concat_ws("|", "field_name", "class")] if limits else F.lit(None).cast("double")
    cut = ~F.col("residue") & (F.col("cut") | F.coalesce(F.col("log_odds") < limit, F.lit(False)))
    return judged.select("state_id", "field_name", "segment_no", "model_name", cut.alias("truncated"), "log_odds")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return truncated_values(spark.read.parquet(f"{sf_dir}/chapter_task_states.parquet")).where("truncated").select("state_id", "field_name", "segment_no")


def p3_rates(spark, sf_dir: str) -> DataFrame:
    """For each model_name, its non-empty values and the share of them that break off."""
    rows = truncated_values(spark.read.parquet(f"{sf_dir}/chapter_task_states.parquet"))
    return rows.groupBy("model_name").agg(F.count("*").alias("n_values"), F.sum(F.col("truncated").cast("bigint")).alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"))
