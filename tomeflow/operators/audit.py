"""The audit of summaries: a score of what looks wrong, with its reasons."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tomeflow.functions.text import col, matches_failure, normalize_key, shorten, strip

MIN_LENGTH, SIMILARITY = 20, 0.72
#: Fingerprints are a hand-written list; a larger table isn't broadcast but refused.
MAX_FINGERPRINTS = 10_000


def fingerprints(lines: DataFrame, text_col: str) -> DataFrame:
    """(pos, text, normalized): a list's lines in order, without blank ones and comments."""
    rows = lines.select(F.col("pos"), strip(text_col).alias("text"))
    return rows.where((F.col("text") != "") & ~F.col("text").startswith("#")).withColumn("normalized", normalize_key("text"))


def _sized(prints: DataFrame) -> list:
    rows = prints.orderBy("pos").limit(MAX_FINGERPRINTS + 1).collect()
    if len(rows) > MAX_FINGERPRINTS:
        raise ValueError(f"more than {MAX_FINGERPRINTS} fingerprints")
    return rows


class Fingerprints:
    """A list of (text, normalized) to look texts up in.

    No ratio is computed that two bounds rule out, neither of which is ever below it: the one by
    lengths, and the one by counts of characters in ``SLOTS`` slots, for all fingerprints at once.
    """

    SLOTS = 128

    def __init__(self, prints: list[tuple[str, str]]):
        import numpy as np

        self.prints = [(i, text, norm) for i, (text, norm) in enumerate(prints) if norm]
        self.counts = np.stack([self._count(norm) for _, _, norm in self.prints]) if self.prints else np.zeros((0, self.SLOTS), np.int32)
        self.sizes = np.array([len(norm) for _, _, norm in self.prints], np.int64)
        self.cache: dict[str, tuple[float, str, str | None]] = {}

    def _count(self, text: str):
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bincount(codes % self.SLOTS, minlength=self.SLOTS).astype(np.int32)

    def look(self, text: str, least: float) -> tuple[float, str, str | None]:
        """(largest ratio, its fingerprint, the first fingerprint that the text contains); ratios below ``least`` count as 0, the first of equals wins."""
        import difflib

        import numpy as np

        if text in self.cache:
            return self.cache[text]
        held = next((t for _, t, norm in self.prints if norm in text), None)
        top, name, best = 0.0, "", len(self.prints)
        if self.prints:
            bound = 2 * np.minimum(self.counts, self._count(text)).sum(axis=1) / np.maximum(1, self.sizes + len(text))
            likely = np.flatnonzero(bound >= max(least, 1e-9))
            # by bound, and in the list's order among equals: what comes later can't be above its bound
            for i in likely[np.argsort(-bound[likely], kind="stable")].tolist():
                if bound[i] < top:
                    break
                m = difflib.SequenceMatcher(None, text, self.prints[i][2])
                if m.quick_ratio() >= max(least, top) and ((r := m.ratio()) > top or r == top > 0 and i < best) and r >= least:
                    top, name, best = r, self.prints[i][1], i
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[text] = (top, name, held)
        return top, name, held


def likeness(normalized: Column | str, prints: list[tuple[str, str]], least: float = 0.0) -> Column:
    """struct(ratio, text, held): the fingerprint with the largest sequence-matching ratio, if that is at least ``least``,
    and the first fingerprint that is contained. Repeated texts of a task are looked up once."""

    @F.pandas_udf("ratio double, text string, held string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Fingerprints(prints)
        for texts in batches:
            yield pd.DataFrame([known.look(t or "", least) for t in texts], columns=["ratio", "text", "held"])

    return best(col(normalized))


def audit(rows: DataFrame, prints: DataFrame | None = None, min_length: int = MIN_LENGTH, threshold: float = SIMILARITY, patterns: list[str] | None = None) -> DataFrame:
    """All columns of ``rows`` (with a ``summary``), and score and reasons; only rows with a reason. Blank and null summaries are skipped."""
    text = F.coalesce(F.col("summary"), F.lit(""))
    checked = rows.where(strip(text) != "").withColumn("_n", normalize_key("summary"))
    parts = [
        (F.length("_n") < min_length, F.lit(0.45), F.lit(f"too_short<{min_length}")),
        (matches_failure("summary", patterns), F.lit(0.9), F.lit("matches_failure_pattern")),
    ]
    listed = _sized(prints) if prints is not None else []
    if listed:
        checked = checked.withColumn("_sim", likeness("_n", [(p["text"], p["normalized"]) for p in listed], threshold))
        ratio = F.col("_sim.ratio")
        parts.append(((ratio >= threshold) & (ratio > 0), F.greatest(F.lit(0.3), ratio), F.concat(F.lit("fingerprint_sim="), F.format_string("%.2f", ratio), F.lit(":"), shorten("_sim.text", 50))))
        parts.append((F.col("_sim.held").isNotNull(), F.lit(1.0), F.concat(F.lit("contains_fingerprint:"), shorten("_sim.held", 50))))
    parts.append((F.col("summary").rlike(r"(?d)(.)\1{8,}"), F.lit(0.3), F.lit("repeated_chars")))
    score = sum((F.when(cond, points).otherwise(0.0) for cond, points, _ in parts), F.lit(0.0))
    reasons = F.filter(F.array(*(F.when(cond, reason) for cond, _, reason in parts)), lambda r: r.isNotNull())
    return checked.withColumn("score", F.round(score, 3)).withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("_n", "_sim")


def without_findings(rows: DataFrame, findings: DataFrame, key: list[str], min_score: float) -> DataFrame:
    """``rows`` without those that a finding of at least min_score points to."""
    return rows.join(findings.where(F.col("score") >= min_score).select(*key).distinct(), key, "left_anti")


def rewritten(spark, folder: str, findings: DataFrame, key: list[str], min_score: float = 0.0, backup: bool = True) -> int:
    """Takes what the findings point to out of a folder of parquet and returns how many rows that was; the former folder stays as ``<folder>.bak``."""
    from tomeflow.session import checkpointed

    rows = spark.read.parquet(folder)
    kept = checkpointed(without_findings(rows, findings, key, min_score))
    gone = rows.count() - kept.count()
    if gone:
        path, former = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, f"{folder}.bak"))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        new = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.new")
        kept.write.mode("overwrite").parquet(f"{folder}.new")  # whole before anything is replaced
        files.delete(former, True)
        files.rename(path, former)
        files.rename(new, path)
        if not backup:
            files.delete(former, True)
        spark.catalog.refreshByPath(folder)
    return gone
