"""Problem 9: keyword-stuffed pages and link lists.

Each document gets content and link features: shares of its characters in links, hashtags, price
labels and lists of short items, sentence ends, repeats of words, pairs, lines and clauses, and others.
Weak labels come from columns of their own (``LABELS``), which the trees don't see: spam is what is
nearly all listed, or nearly all clauses around one phrase; plain is what lists next to nothing and is
made of sentences, or of long runs of digits, symbols or one character. All between stays unlabelled.
Bagged decision trees learn from a bounded sample of the weakly labelled rows and give each document a
spam probability, which is smoothed with the rate of its source: the log-odds are shifted by a part of
the source's own, shrunk towards the corpus rate by ``prior`` documents.

Bounds: about ``sample_rows`` labelled rows are used to fit the trees, a third each of spam, of plain
rows that look unusual, and of all other plain rows, weighted by the inverse of their sampling rates.
Features, rates and scores cover all rows and whole texts. Null, empty and blank texts aren't spam and
have a page score of 0. A corpus whose weak labels are all alike is decided by the share of listed
characters, or of clauses around one phrase, alone. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tomeflow.session import checkpointed

SAMPLE_ROWS, TREES, DEPTH, SEED = 21_000, 20, 8, 11
HOST_WEIGHT, HOST_PRIOR = 0.25, 20.0
THRESHOLD = 0.5
#: The share of a text that its commonest phrase fills where it is stuffed with it.
STUFFED = 0.3

LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\[[^\]\n]{1,120}\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"'，。；、|｜）)\]]+", re.I | re.S)
HASHTAG = re.compile(r"(?:#[^\s#]{1,40})+#*")
LINKISH = re.compile(r"https?://|www\.|<a\s|\[url=", re.I)
PRICE = re.compile(r"[$€£¥￥]\s?\d|\d+\.\d\d\b|(?<![\w])\d{1,4}\s+(?:new|sale|in stock|包邮|现货|限量|sold)", re.I)
SEPARATOR = re.compile(r"\s*(?:[|｜>›»/／·•、,，;；_\t]|\s[-–—]\s|\s{2,})\s*")
CLOSED = tuple(".!?。！？…”\"»’'」』）):：")
MARK_CHARS = ".!?。！？…"
SENTENCE_MARK = re.compile(r"[.!?。！？…](?:[\s”\"»’'」』]|$)")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
RUN = re.compile(r"(.{1,8}?)\1{3,}", re.S)
CLAUSE = re.compile(r"[.,!?;。，！？；、\n]+")

#: what the weak labels are made of, and the trees don't see
LABELS = ["listed", "stuffed", "top_phrase", "sentences", "noise"]
FEATURES = ["links", "tags", "prices", "items", "closed_lines", "marks", "distinct", "top_pair", "entropy", "compressed", "short_lines", "log_chars", "digits", "repeat_lines", "repeat_clauses", "symbols", "runs"]


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """Which code points are letters or numbers."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _cjk(codes: np.ndarray) -> np.ndarray:
    """Which code points CJK matches."""
    return (codes >= 0x3040) & (codes <= 0x30FF) | (codes >= 0x3400) & (codes <= 0x9FFF)


def _items(line: str) -> list[str]:
    """The items of a line that is a list, else nothing."""
    parts = [p for p in SEPARATOR.split(line) if p]
    if len(parts) >= 4:
        return parts
    if " " in line and CJK.search(line):
        parts = line.split()
        return parts if len(parts) >= 4 else []
    return []


def _commonest(ids: np.ndarray, gram: int, bits: int, least: int = 1) -> tuple[int, int]:
    """(where it first is, how often) of the commonest ``gram`` of a row of numbers below 2 ** bits; the first of equals. Where none occurs ``least`` times, the place is 0."""
    key = ids[: len(ids) - gram + 1].astype(np.uint64)
    for i in range(1, gram):
        if bits * (i + 1) > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << np.uint64(bits)) | ids[i : len(ids) - gram + 1 + i].astype(np.uint64)
    ordered = np.sort(key)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    n = np.diff(starts)
    most = int(n.max())
    if most < least:
        return 0, most
    return min(int((key == best).argmax()) for best in ordered[starts[:-1][n == most]]), most


def _counts(values: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    ordered = np.sort(values)
    return np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))


def _units(text: str) -> tuple[np.ndarray, list[str]]:
    """(a text's units as numbers, its words): characters where words aren't separated, else words, numbered."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes[_cjk(codes)]
    if len(wide):
        return wide, []
    words = WORD.findall(text)
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    return np.fromiter(map(number.__getitem__, words), np.uint32, len(words)), words


def _stuffed(units: np.ndarray, words: list[str], clauses: list[str]) -> tuple[float, float]:
    """(share of characters in clauses that hold the commonest phrase, share of the phrase itself).

    The phrase is three words, or four characters where words aren't separated. Only a phrase that
    fills many of the clauses, and not as a whole clause that returns like a refrain, counts.
    """
    gram, bits, joined = (3, max(1, int(units.max()).bit_length()), " ") if words else (4, 16, "")
    if len(units) < 12 * gram:
        return 0.0, 0.0
    least = max(5, math.ceil(0.12 * len(units) / gram))
    at, n = _commonest(units, gram, bits, least)
    top = n * gram / len(units)
    if n < least:
        return 0.0, top
    key = joined.join(words[at : at + gram] or map(chr, units[at : at + gram].tolist()))
    hold = [c for c in clauses if key in " ".join(c.split())]
    # a refrain brings its phrase back in the same clause; keywords come in many, or many to a clause
    if len(set(hold)) < 3 and n < 2.5 * len(hold):
        return 0.0, 0.0
    return sum(map(len, hold)) / max(1, sum(map(len, clauses))), top


def features(text: str | None) -> list[float]:
    if text is None or not text.strip():
        return [0.0] * len(LABELS + FEATURES)
    total = max(1, len(text) - text.count(" ") - text.count("\n") - text.count("　"))
    size = lambda s: len(s) - s.count(" ")
    linked = tagged = priced = listed = closed = short = short_run = item_chars = 0
    run: list[int] = []
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]

    def end_run() -> int:
        """Short unpunctuated lines count as a menu only where several come one after another."""
        n = sum(run) if len(run) >= 4 else 0
        run.clear()
        return n

    if LINKISH.search(text):
        # links first, as one may span lines; what is left of a line of links is their label
        kept = []
        for line in lines:
            found = [m.span() for m in LINK.finditer(line)]
            if not found:
                kept.append(line)
                continue
            inside = sum(size(line[a:b]) for a, b in found)
            linked += inside
            rest = LINK.sub(" ", line)
            if size(rest) <= max(60, inside // 2) and not SENTENCE_MARK.search(rest):
                linked += size(rest)
            else:
                kept.append(rest)
        body = kept
    else:
        body = lines
    for line in body:
        n = size(line)
        if "#" in line:
            tags = HASHTAG.findall(line)
            if len(tags) >= 3 or sum(t.count("#") for t in tags) >= 4:
                tagged += sum(size(t) for t in tags)
                n -= sum(size(t) for t in tags)
                short_run += end_run()
                if n < 20:
                    continue
        has_price = DIGIT.search(line) is not None and PRICE.search(line) is not None
        if line.endswith(CLOSED) and not has_price:
            closed += n
            short_run += end_run()
            continue
        if has_price:
            parts = [p for p in re.split(r"\s*[|｜;；\n、]\s*|,\s", line) if p]
            good = [p for p in parts if PRICE.search(p) or re.search(r"\d", p) and len(p) < 60]
            if good and sum(map(len, parts)) / len(parts) < 60:
                priced += sum(size(p) for p in good)
                short_run += end_run()
                continue
        parts = _items(line)
        if parts and sum(map(len, parts)) / len(parts) < 32 and max(map(len, parts)) < 70:
            item_chars += n
            short_run += end_run()
            continue
        if len(line) <= 40 or (not SENTENCE_MARK.search(line) and len(line) <= 90 and not CJK.search(line)):
            run.append(n)
            short += 1
            continue
        short_run += end_run()
    short_run += end_run()
    raw = text.encode("utf-8", "replace")
    packer = zlib.compressobj(1)
    packed = (sum(len(packer.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(packer.flush())) / len(raw)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # of up to eight characters again and again; letters of a text repeat at any distance about once in twelve
    runs = max((np.count_nonzero(codes[lag:] == codes[:-lag]) / (len(codes) - lag) for lag in range(1, 9)), default=0.0) if len(codes) > 8 else 0.0
    digits, symbols = np.count_nonzero((codes >= 48) & (codes <= 57)) / total, 1 - np.count_nonzero(_alnum()[codes]) / total
    # such a run is no phrase, so it counts once in what is about repeats
    calm = RUN.sub(r"\1", text) if runs > 0.15 else text
    units, words = _units(calm)
    clauses = [c for c in map(str.strip, CLAUSE.split(calm)) if c]
    grams, distinct, top_pair, entropy = max(0, len(units) - 1), 1.0, 0.0, 1.0
    if grams:
        wide = units.astype(np.uint64)
        n = _counts((wide[:-1] << np.uint64(21)) | wide[1:])
        distinct, top_pair = len(n) / grams, int(n.max()) / grams
        n = _counts(units)
        entropy = 1 - float((n * np.log(n)).sum() / len(units)) / math.log(len(units))
    stuffed, top = _stuffed(units, words, clauses) if grams else (0.0, 0.0)
    sure = min(total, linked + tagged + priced + item_chars + short_run)
    again = sum(len(x) * c for x, c in Counter(clauses).items() if c > 2) / max(1, sum(map(len, clauses)))
    counts = Counter(lines)
    row = [
        sure / total, stuffed, top, sum(size(line) for line in lines if line[-1] in MARK_CHARS or SENTENCE_MARK.search(line)) / total, max(runs, digits, symbols),
        linked / total, tagged / total, priced / total, (item_chars + short_run) / total, closed / total, 100 * len(SENTENCE_MARK.findall(text)) / total,
        distinct, top_pair, entropy, packed, short / max(1, len(lines)), math.log10(len(text)), digits,
        sum(c for c in counts.values() if c > 1) / max(1, len(lines)), again,
        symbols, runs,
    ]
    return [float(x) for x in row]


def _featured(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = [features(t) for t in pdf["text"]]
        out = pd.DataFrame(rows, columns=LABELS + FEATURES, index=pdf.index, dtype="float64")
        yield pd.concat([pdf[["doc_id", "source"]], out], axis=1)


def weak_label() -> F.Column:
    """1, 0 or null (between the rules)."""
    spam = (F.col("listed") >= 0.8) | (F.col("stuffed") >= 0.8) & (F.col("top_phrase") >= STUFFED)
    plain = (F.col("listed") <= 0.1) & ((F.col("top_phrase") < STUFFED) & (F.col("sentences") >= 0.5) | (F.col("noise") >= 0.3))
    return F.when(spam, 1.0).when(plain, 0.0)


def stratum() -> F.Column:
    """2 for spam, 1 for plain rows that lists, repeats or symbols make unusual, 0 for other plain rows; null without a label."""
    unusual = (F.col("distinct") < 0.6) | (F.col("symbols") > 0.3) | (F.col("listed") > 0.01) | (F.col("runs") > 0.1)
    return F.when(F.col("label") == 1, 2).when(F.col("label") == 0, unusual.cast("int"))


def spam_scores(df: DataFrame, id_col: str, text_col: str, source_col: str, sample_rows: int = SAMPLE_ROWS, host_weight: float = HOST_WEIGHT, prior: float = HOST_PRIOR) -> DataFrame:
    """(id, source, page_score, source_rate, score, listed): one row for each row of ``df``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    schema = f"doc_id {kinds[id_col]}, source {kinds[source_col]}, " + ", ".join(f"{f} double" for f in LABELS + FEATURES)
    featured = rows.mapInPandas(_featured, schema).withColumn("label", F.when(F.col("log_chars") > 0, weak_label()))
    table = checkpointed(featured.withColumn("stratum", stratum()))
    counts = {r["stratum"]: r["n"] for r in table.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, sample_rows / 3 / n) for k, n in counts.items() if k is not None}
    if 2 in rates and len(rates) > 1:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
        weight = F.create_map(*(F.lit(x) for k, rate in rates.items() for x in (k, 1.0 / rate)))[F.col("stratum")]
        sample = table.where(F.col("stratum").isNotNull()).sampleBy("stratum", rates, SEED).withColumn("weight", weight)
        trees = RandomForestClassifier(labelCol="label", featuresCol="vector", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=3, seed=SEED)
        model = trees.fit(vector.transform(sample))
        scored = model.transform(vector.transform(table)).withColumn("page_score", vector_to_array("probability")[1])
    else:
        scored = table.withColumn("page_score", F.when((F.col("listed") > 0.5) | (F.col("stuffed") > 0.5) & (F.col("top_phrase") >= STUFFED), 1.0).otherwise(0.0))
    scored = scored.withColumn("page_score", F.when(F.col("log_chars") > 0, F.col("page_score")).otherwise(0.0))
    scored = scored.select("doc_id", "source", "page_score", "listed")
    # the rates are one row for each source, summed map-side; their join leaves the choice to the planner
    rates = scored.groupBy("source").agg(F.sum("page_score").alias("s"), F.count("*").alias("n"))
    overall = rates.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    base = min(max((overall["s"] or 0.0) / max(1, overall["n"] or 0), 1e-3), 1 - 1e-3)
    rates = rates.select(F.col("source").alias("host"), ((F.col("s") + prior * base) / (F.col("n") + prior)).alias("source_rate"))
    clamp = lambda c: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    logit = lambda c: F.log(clamp(c) / (1 - clamp(c)))
    joined = scored.join(rates, F.col("source").eqNullSafe(F.col("host")))
    shifted = logit(F.col("page_score")) + host_weight * (logit(F.col("source_rate")) - math.log(base / (1 - base)))
    return joined.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "page_score", "source_rate", (1 / (1 + F.exp(-shifted))).alias("score"), "listed")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return spam_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source").where(F.col("score") > THRESHOLD).select("doc_id")
