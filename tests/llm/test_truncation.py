import math
import random

from pyspark.sql import functions as F

from tomeflow.llm.truncation import FILTER_BITS, ORDERS, SMOOTHING, class_of, context_counts, contexts_of, inner_text, truncated_values, valley

SCHEMA = "state_id long, novel_id string, title string, chapter_summary string, segment_results map<int,string>, model_name string, segment_no int, value string"


def sentence(rng):
    return f"{rng.choice(['虞照夜', '岚止水', '沐烬'])}在{rng.choice(['雾港码头', '白塔顶层', '药王谷口', '祖祠偏殿'])}{rng.choice(['得到', '藏起', '打碎'])}{rng.choice(['一只空鸟笼', '三枚铜钱', '半张海图'])}，{rng.choice(['由此卷入旧怨', '引对方现身', '被迫分头突围'])}。"


def test_form():
    assert inner_text('{"summary": "a"}') == ("a", False) and inner_text('{"summary": "a') == (None, True) and inner_text("abc�") == (None, True)
    assert inner_text('{"summary": "a", "s') == (None, True) and inner_text("```json\n{\"summary\": \"x\"}\n```") == ("x", False) and inner_text("```json\n{") == (None, True)
    assert inner_text("{a} b") == ("{a} b", False) and inner_text('["a", "b"]') == ("b", False) and inner_text("{}") == (None, False) or inner_text("{}")[1] is False


def test_valley():
    assert -4.5 < valley({-8.0: 10, -7.0: 5, -1.0: 50, 0.0: 90}, -5.0, -2.5) < -2.5


def test_classes():
    assert class_of("the end of it") == "en/prose" and class_of("1. le roi et la reine") == "fr/list." and class_of("他离开了。") == "zh/prose" and class_of("それは夜。") == "ja/prose"
    assert class_of("Zorvex Umbral") == "latin/prose" and class_of("Zorvex Umbral", None, "The Tide of Glass") == "en/prose"


def test_context_counts():
    """Against counting by hand, with and without the filter."""
    import numpy as np

    texts = ["abcabcd", "bcd", "a", "漢字漢字"]
    on, end = {}, {}
    for t in texts:
        for k in ORDERS:
            for i in range(len(t) - k + 1):
                h = contexts_of(t[i : i + k])[ORDERS.index(k)]
                side = end if i + k == len(t) else on
                side[h] = side.get(h, 0) + 1
    key, n_on, n_end = context_counts(texts)
    assert {k: n for k, n in zip(key.tolist(), n_on.tolist()) if n} == on and {k: n for k, n in zip(key.tolist(), n_end.tolist()) if n} == end
    wanted = [h for h in contexts_of("漢字漢字") if h is not None]
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for h in wanted:
        slot = h & (FILTER_BITS - 1)
        bits[slot >> 6] |= np.uint64(1 << (slot & 63))
    key, n_on, n_end = context_counts(texts, bits)
    assert set(wanted) == set(key.tolist()) and dict(zip(key.tolist(), n_on.tolist())) == {h: on.get(h, 0) for h in wanted}


def test_cut_values(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(400):
        whole = "".join(sentence(rng) for _ in range(rng.randint(2, 5)))
        if i % 10 == 0:
            at = rng.randint(8, len(whole) - 2)
            while whole[at - 1] == "。":
                at += 1
            whole = whole[:at]
            cut.add((i, "chapter_summary", -1))
        results = {0: "".join(sentence(rng) for _ in range(2)), 1: None, 2: " "}
        if i % 20 == 1:
            results[3] = '{"summary": "' + sentence(rng)
            cut.add((i, "segment_results", 3))
        rows.append((i, "n", "t", whole, results, f"m{i % 2}", 7, "x"))
    rows += [(1000, None, "t", None, None, None, 1, None), (1001, "n", "t", "", {}, "m0", 1, ""), (1002, "n", "t", "{{summary}}", None, "m0", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.state_id, r.field_name, r.segment_no) for r in truncated_values(df).where("truncated").collect()}
    missed, extra = cut - got, got - cut
    assert len(missed) <= 0.1 * len(cut) and len(extra) <= 0.02 * len(rows), (missed, extra)
    assert truncated_values(df.limit(0)).count() == 0
    twice = df.unionByName(df.where("state_id < 40"))
    assert truncated_values(twice).count() == truncated_values(df).count() + 40 + 40 + 2


def test_ends_that_nothing_follows(spark):
    """So many ends of contexts that never go on that the chance of ending is 1 as a double."""
    n = 60_000
    whole = F.concat(F.lit("第"), F.col("id"), F.lit("夜，虞照夜在雾港码头藏起半张海图。（未完待续）"))
    value = F.when(F.col("id") % 100 == 0, F.substring_index(whole, "海图", 1)).otherwise(whole)
    df = spark.range(n, numPartitions=4).select(F.col("id").alias("state_id"), F.lit("n").alias("novel_id"), F.lit("雾港").alias("title"), value.alias("chapter_summary"), F.lit(None).cast("map<int,string>").alias("segment_results"), F.lit("m").alias("model_name"))
    got = truncated_values(df).toPandas()
    assert len(got) == n and set(got["state_id"][got["truncated"]]) == set(range(0, n, 100))
    chars = df.select(F.sum(F.length("chapter_summary"))).first()[0]
    goes_on = (1 - n / (chars + 1)) * (SMOOTHING / (n - n // 100 - 1 + SMOOTHING)) ** len(ORDERS)
    assert math.isclose(got["log_odds"].max(), math.log1p(-goes_on) - math.log(goes_on), rel_tol=1e-12)
