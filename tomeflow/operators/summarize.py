"""Map-reduce summarising behind a provider: segments, then their summaries joined until they fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomeflow.functions.text import sanitized_summary, summary_from_json, truncate
from tomeflow.operators.segment import packed, segments
from tomeflow.providers import Limiter
from tomeflow.session import checkpointed

PASSES = 3


def mapped(rows: DataFrame, key: list[str], text_col: str, provider, per_second: float = 0.0, retries: int = 2) -> DataFrame:
    """(key, result, error): the provider's summary of each text, in Arrow batches, paced in each task."""
    kinds = dict(rows.dtypes)

    def run(pdfs):
        import json

        import pandas as pd

        limiter = Limiter(per_second)
        for pdf in pdfs:
            results, errors = [], []
            for text in pdf[text_col]:
                answer, error = None, None
                for _ in range(retries + 1):
                    limiter.wait()
                    try:
                        answer, error = json.dumps(provider.analyze_plot(text or ""), ensure_ascii=False), None
                        break
                    except Exception as e:  # a provider's failure of any kind
                        error = str(e)
                results.append(answer)
                errors.append(error)
            yield pdf[key].assign(result=pd.Series(results, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    return rows.select(*key, text_col).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", result string, error string")


def strictly_mapped(rows: DataFrame, key: list[str], text_col: str, provider, **limits) -> DataFrame:
    """As ``mapped``, but one error that names the failures, five at most, where any text failed. The results are written first, so nothing is asked twice."""
    told = checkpointed(mapped(rows, key, text_col, provider, **limits))
    bad = told.where("error IS NOT NULL")
    n = bad.count()
    if n:
        named = "; ".join(f"{'/'.join(str(r[k]) for k in key)}: {r['error']}" for r in bad.orderBy(*key).limit(5).collect())
        raise RuntimeError(f"{n} failed: {named}")
    return told.drop("error")


def _told(parts: DataFrame, key: list[str], provider) -> DataFrame:
    """(key, text, had_error): the clean summaries of each key's pieces (pos, segment), joined in order.

    It is written before anything reads it, or a plan that reads it twice would ask the provider twice.
    """
    told = mapped(parts, [*key, "pos"], "segment", provider)
    rows = told.select(*key, "pos", F.col("error").isNotNull().alias("had_error"), sanitized_summary(summary_from_json("result")).alias("text"))
    gathered = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"), F.max("had_error").alias("had_error"))
    joined = F.array_join(F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != ""), "\n")
    return checkpointed(gathered.select(*key, joined.alias("text"), "had_error"))


def until_fit(rows: DataFrame, key: list[str], provider, segment_max: int, max_chars: int, passes: int = PASSES) -> DataFrame:
    """(key, summary, had_error) of rows (key, text, had_error): while a text is longer than max_chars, its segments are
    summarised and joined, at most ``passes`` times and only as long as that leaves something shorter; then it is cut to
    max_chars and summarised once more. A pass holds only the texts that are still too long."""
    long = F.length("text") > max_chars
    done, left = rows.where(~long), rows.where(long)
    for _ in range(passes):
        if left.isEmpty():
            break
        parts = left.select(*key, F.posexplode(segments("text", segment_max)).alias("pos", "segment"))
        told = _told(parts, key, provider).select(*key, F.col("text").alias("_new"), F.col("had_error").alias("_error"))
        both = left.join(told, key, "left")
        shorter = F.coalesce((F.length("_new") > 0) & (F.length("_new") < F.length("text")), F.lit(False))
        both = checkpointed(both.select(*key, F.when(shorter, F.col("_new")).otherwise(F.col("text")).alias("text"), (F.col("had_error") | F.coalesce("_error", F.lit(False))).alias("had_error"), shorter.alias("_shorter")))
        done = done.unionByName(both.where(~F.col("_shorter") | ~long).drop("_shorter"))
        left = both.where(F.col("_shorter") & long).drop("_shorter")
    ready = done.unionByName(left).select(*key, truncate("text", max_chars).alias("text"), "had_error")
    last = mapped(ready.where("text != ''"), [*key, "had_error"], "text", provider)
    whole = last.select(*key, sanitized_summary(summary_from_json("result")).alias("summary"), (F.col("had_error") | F.col("error").isNotNull()).alias("had_error"))
    return checkpointed(whole.unionByName(ready.where("text = ''").select(*key, F.lit("").alias("summary"), "had_error")))


def chapter_summaries(chapters: DataFrame, key: list[str], text_col: str, provider, segment_max: int = 4000, max_chars: int | None = None) -> DataFrame:
    """(key, summary, had_error): a text's packed segments summarised and joined, and that summarised until it fits. An empty or null text has an empty summary without a call. The key is unique and not null."""
    rows = chapters.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = rows.select(*key, F.posexplode(segments("text", segment_max)).alias("pos", "segment"))
    told = until_fit(_told(parts, key, provider), key, provider, segment_max, max_chars or segment_max)
    return told.unionByName(rows.where("text = ''").select(*key, F.lit("").alias("summary"), F.lit(False).alias("had_error")))


def item_summaries(groups: DataFrame, key: list[str], items_col: str, provider, segment_max: int = 4000, max_chars: int | None = None) -> DataFrame:
    """(key, summary, had_error): a list's items packed whole into chunks of max_chars, the chunks summarised and joined, and that summarised until it fits. An empty list has an empty summary."""
    most = max_chars or segment_max
    rows = groups.select(*key, packed(F.filter(items_col, lambda x: x.isNotNull()), most).alias("chunks"))
    told = until_fit(_told(rows.select(*key, F.posexplode("chunks").alias("pos", "segment")), key, provider), key, provider, segment_max, most)
    return told.unionByName(rows.where(F.coalesce(F.size("chunks"), F.lit(0)) <= 0).select(*key, F.lit("").alias("summary"), F.lit(False).alias("had_error")))
