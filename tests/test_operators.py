import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import access, audit, chunks, cleaning, export, progress, search, segment, summarize, volumes
from tomeflow.providers import HashProvider, NoProvider, create, register

CHAPTERS = "row_id long, novel_id string, chapter_id string, chapter_index int, title string, content string, metadata map<string,string>"


def chapters(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], CHAPTERS)


def test_txt_chapters(spark):
    df = spark.createDataFrame([(1, "pre\n第一章 甲\nx\n第二章 乙\ny"), (2, "no heading "), (3, "Chapter 1 a\r\nb"), (4, ""), (5, None)], "raw_id long, content string")
    rows = [(r.raw_id, r.chapter_id, r.title, r.content) for r in segment.txt_chapters(df, "content").orderBy("raw_id", "chapter_index").collect()]
    assert rows == [(1, "ch_0000", "第一章", "第一章 甲\nx"), (1, "ch_0001", "第二章", "第二章 乙\ny"), (2, "ch_0000", "", "no heading"), (3, "ch_0000", "Chapter 1", "Chapter 1 a\r\nb"), (4, "ch_0000", "", "")]


def test_epub_chapters(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["a"], ["x", "y"]), (3, None, None)], "raw_id long, toc array<string>, parts array<string>")
    rows = [(r.raw_id, r.chapter_id, r.title, r.content) for r in segment.epub_chapters(df, "toc", "parts").orderBy("raw_id", "chapter_index").collect()]
    assert rows == [(1, "ch_0000", "a", "x"), (1, "ch_0001", "b", ""), (2, "ch_0000", "a", "x"), (2, "ch_0001", "Chapter 2", "y")]


def test_volume_runs(spark):
    ch = chapters(spark, [("n", f"c{i}", i, t, "") for i, t in enumerate(["a", "第一卷 x", "b", "Volume II", "c"])])
    sums = spark.createDataFrame([(i, "n", f"c{i}", "", f"s{i}") for i in (0, 1, 2, 4)], "item_pos long, novel_id string, chapter_id string, title string, summary string")
    rows = [(r.volume_title, r.start_chapter, r.end_chapter, r["items"]) for r in volumes.volume_groups(ch, sums).orderBy("run").collect()]
    assert rows == [("未分卷", "a", "a", ["a: s0"]), ("第一卷", "第一卷 x", "b", ["第一卷 x: s1", "b: s2"]), ("Volume II", "c", "c", ["c: s4"])]


def brute_bm25(paragraphs, terms, k1=1.5, b=0.75):
    n, avg = len(paragraphs), sum(map(len, paragraphs)) / len(paragraphs)
    df = Counter(t for p in paragraphs for t in set(p))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * p.count(t) * (k1 + 1) / (p.count(t) + k1 * (1 - b + b * len(p) / avg)) for t in terms) for p in paragraphs]


def test_bm25(spark):
    texts = ["red fox runs over red hills", "blue fox sleeps", "a red red red lantern", "green hills", "fox fox"]
    ch = chapters(spark, [("n", f"c{i}", i, "t", t) for i, t in enumerate(texts)] + [("m", "c0", 0, "t", "fox den"), ("m", "c1", 1, "t", ""), ("m", "c2", 2, "t", None)])
    got = {(r.novel_id, r.chapter_index): r.score for r in search.bm25(ch, "red fox red", 10, min_len=1).collect()}
    want = {("n", i): round(s, 6) for i, s in enumerate(brute_bm25([t.split() for t in texts], ["red", "fox", "red"])) if s > 0}
    assert {k: v for k, v in got.items() if k[0] == "n"} == pytest.approx(want)
    assert search.bm25(ch, "red", 10, "n", (1, 2), 1).select("chapter_index").collect()[0][0] == 2
    assert search.bm25(ch, "123", 5).count() == 0  # no tokens: a keyword


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.8), ("b", 0.4)], "k string, score double")
    b = spark.createDataFrame([("b", 5), ("c", 10)], "k string, score int")
    assert [(r.k, r.score) for r in search.fuse(v, b, ["k"]).collect()] == [("a", 0.6), ("b", 0.5), ("c", 0.4)]
    assert [(r.k, r.score) for r in search.fuse(v, b.limit(0), ["k"]).collect()] == [("a", 0.8), ("b", 0.4)]


def test_chapter_search_excludes_by_chapter_id(spark):
    ch = chapters(spark, [("n", "c0", 0, "", "lamp lamp"), ("n", "c1", 1, "", "lamp"), ("m", "c0", 0, "", "lamp")])
    s = spark.createDataFrame([(1, "n", "c0", "T", "a lamp")], "item_pos long, novel_id string, chapter_id string, title string, summary string")
    assert [(r.stage, r.novel_id, r.chapter_id, r.chapter_title) for r in search.chapter_search(s, ch, "LAMP").collect()] == [(1, "n", "c0", "T"), (2, "n", "c1", "")]
    assert search.chapter_search(s, ch, "LAMP", qualified_keys=True).count() == 3


def test_audit(spark):
    long = "一段足够长的正常摘要，讲述了主角在雾港的经历，以及后来的事情。"
    rows = [(1, "短"), (2, long), (3, long + "哈" * 9), (4, "rate limit exceeded for this very long request text"), (5, " "), (6, None), (7, long + "指 纹"), (8, "a" * 7 + "啊" * 8 + long)]
    prints = audit.fingerprints(spark.createDataFrame([(0, "# c"), (1, ""), (2, " 指纹 ")], "pos int, line string"), "line")
    got = {r.id: (r.score, r.reasons) for r in audit.audit(spark.createDataFrame(rows, "id int, summary string"), prints).collect()}
    assert got[1] == (0.45, ["too_short<20"]) and got[3] == (0.3, ["repeated_chars"]) and got[4] == (0.9, ["matches_failure_pattern"])
    assert got[7] == (1.0, ["contains_fingerprint:指纹"]) and set(got) == {1, 3, 4, 7}
    near = audit.audit(spark.createDataFrame([(1, "指纹")], "id int, summary string"), prints, min_length=0).first()
    assert near.reasons == ["fingerprint_sim=1.00:指纹", "contains_fingerprint:指纹"] and near.score == 2.0
    left = audit.without_findings(spark.createDataFrame(rows, "id int, summary string"), audit.audit(spark.createDataFrame(rows, "id int, summary string"), prints), ["id"], 0.9)
    assert sorted(r.id for r in left.collect()) == [1, 2, 3, 5, 6, 8]


def test_progress(spark):
    ch = chapters(spark, [("n", f"c{i}", i * 2, f"t{i}", "") for i in range(5)] + [("m", "c0", 0, "t", "")])
    s = spark.createDataFrame([(0, "n", "c0", "t0", "a"), (1, "n", "c1", "x", " "), (2, "n", "c3", "t3", "d"), (3, "n", "c9", "t9", "e")], "item_pos long, novel_id string, chapter_id string, title string, summary string")
    assert {r.novel_id: (r.chapter_count, r.done_index) for r in progress.contiguous(ch, s).collect()} == {"n": (5, 2), "m": (1, 0)}
    assert {r.novel_id: (r.kept, r.done_index) for r in progress.restored(ch, s).collect()} == {"n": (2, 1), "m": (0, 0)}
    assert sorted((r.novel_id, r.chapter_id) for r in progress.pending(ch, s).collect()) == [("m", "c0"), ("n", "c1"), ("n", "c2"), ("n", "c4")]
    forced = spark.createDataFrame([("n", "c0")], "novel_id string, chapter_id string")
    assert progress.pending(ch, s, forced).count() == 5
    assert sorted((r.chapter_id, r.issue) for r in progress.consistency(ch, s).where("novel_id = 'n'").collect()) == [("c2", "missing_summary"), ("c4", "missing_summary"), ("c9", "extra_summary")]
    assert [r.chapter_id for r in progress.title_mismatches(ch, s).collect()] == ["c1"]
    assert {r.chapter_id: (r.title, r.title_state) for r in progress.synced_titles(s, ch).collect()} == {"c0": ("t0", "same"), "c1": ("t1", "updated"), "c3": ("t3", "same"), "c9": ("t9", "missing")}


def test_characters(spark):
    rows = [("n", 0, " Ann ", "a", None), ("n", 1, "ann", "b", None), ("n", 2, "", "x", "y"), ("n", 3, None, "x", "y"), ("n", 4, "", "x", "y")]
    got = progress.first_characters(spark.createDataFrame(rows, "novel_id string, pos long, name string, role string, relationships string")).collect()
    assert sorted(r.pos for r in got) == [0, 2, 3]


def test_cleaning(spark):
    rows = [("n", "c0", i, t) for i, t in enumerate(["感谢书友", "正文", "求月票！", "正文二", "http://x", "尾"])] + [("n", "c1", 0, "最新章节"), ("n", "c2", 0, "x")]
    df = spark.createDataFrame(rows, "novel_id string, chapter_id string, index int, text string")
    plain = [(r.chapter_id, r.chapter_no, r.text) for r in cleaning.clean(df, ["novel_id", "chapter_id"]).orderBy("chapter_no", "index").collect()]
    assert plain == [("c0", 1, "感谢书友"), ("c0", 1, "正文"), ("c0", 1, "正文二"), ("c0", 1, "尾"), ("c2", 2, "x")]
    judged = cleaning.clean(df, ["novel_id", "chapter_id"], lambda texts: [True] * len(texts))
    assert "感谢书友" not in [r.text for r in judged.collect()]

    def fails(texts):
        raise OSError

    assert cleaning.clean(df, ["novel_id", "chapter_id"], fails).count() == 5


def test_chunk_store(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path / "store"))
    schema = "chunk_id string, novel_id string, content_type string, content string, embedding array<float>"
    store.upsert(spark.createDataFrame([("a", "n/1", "p", "old", [1.0]), ("b", "n/1", "p", "b", [1.0]), ("c", "m", "p", "c", None), ("d", "m", "q", "d", [])], schema))
    assert store.count() == 2 and store.count("m") == 0
    store.upsert(spark.createDataFrame([("a", "n/1", "p", "new", [2.0]), ("e", "m", "p", "e", [3.0])], schema))
    assert sorted((r.chunk_id, r.content) for r in store.read().collect()) == [("a", "new"), ("b", "b"), ("e", "e")]
    store.delete_novel("n/1")
    assert [r.chunk_id for r in store.read().collect()] == ["e"]


def test_build_export_and_access(spark):
    novels = spark.createDataFrame([("n", "T", "S", ["f"], None, "2020"), ("m", "U", "", None, None, None)], "novel_id string, title string, summary string, features array<string>, characters array<struct<name:string>>, created_at string")
    plots = spark.createDataFrame([("n", 0, None, "a", "b", "p")], "novel_id string, plot_index int, volume_title string, start_chapter string, end_chapter string, summary string")
    ch = chapters(spark, [("n", "c0", 0, "第一卷", "x" * 120), ("m", "c0", 0, "t", "open")])
    s = spark.createDataFrame([(0, "n", "c0", "", "sum")], "item_pos long, novel_id string, chapter_id string, title string, summary string")
    built = {r.chunk_id: (r.content, r.volume_title) for r in chunks.build(novels, plots, ch, s).collect()}
    assert built == {"n/overall/overall": ("【全书总结】S", None), "n/plot/v_0": ("【未分卷】a - b\np", "未分卷"), "n/chapter_summary/c0": ("【第一卷】sum", "第一卷"), "n/paragraph/c0_p0": ("x" * 120, "第一卷"), "m/paragraph/c0_p0": ("open", None)}
    made = chunks.embedded(chunks.build(novels, plots, ch, s), HashProvider(8))
    assert made.count() == 5 and chunks.embedded(chunks.build(novels, plots, ch, s), NoProvider()).count() == 0
    out = {r.id: r.content for r in export.export_chunks(novels, ch).collect()}
    assert out["n:summary"] == "S" and out["m:summary"] == "open" and out["m:c0"] == "open" and len(out) == 4
    users = spark.createDataFrame([], "user_id string, name string, api_key string, created_at timestamp")
    users = access.registered(users, "ann", "key", "1")
    assert access.verified(users, "ann", "key") and not access.verified(users, "ann", "no")
    with pytest.raises(ValueError):
        access.registered(users, "ann", "k", "2")
    own = access.assigned(spark.createDataFrame([("ann", "n")], "name string, novel_id string"), spark.createDataFrame([("ann", "n"), ("bob", "m")], "name string, novel_id string"))
    assert own.count() == 2 and access.owned(ch, own, "bob").count() == 1 and access.unassigned(own, own).count() == 0
    assert [x.count() for x in access.removed(users, own, "ann")] == [0, 1]


def test_summaries_by_provider(spark):
    ch = spark.createDataFrame([("c0", "One. Two. " * 30), ("c1", ""), ("c2", None)], "chapter_id string, content string")
    got = {r.chapter_id: (r.summary, r.had_error) for r in summarize.chapter_summaries(ch, ["chapter_id"], "content", HashProvider(), 50).collect()}
    assert got["c0"][0].startswith("One.") and got["c1"] == ("", False) and got["c2"] == ("", False)
    assert {r.chapter_id for r in summarize.chapter_summaries(ch.limit(0), ["chapter_id"], "content", HashProvider(), 50).collect()} == set()
    register("mine", HashProvider)
    assert create("mine", dim=4).dim == 4
    with pytest.raises(ValueError):
        create("other")


def test_rerank_and_semantic(spark):
    class Length:
        def score(self, queries, texts):
            return [len(t) for t in texts]

    df = spark.createDataFrame([("a", 3.0, "x"), ("b", 1.0, "long")], "id string, score double, snippet string")
    assert [r.id for r in search.rerank(df, "q", Length(), 2, ties=("id",)).collect()] == ["b", "a"]
    assert [r.id for r in search.rerank(df, "q", None, 1, ties=("id",)).collect()] == ["a"]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [(r.id, r.score) for r in search.semantic(v, "v", [1.0, 0.0], 5, "id").select("id", "score").collect()] == [("a", 1.0), ("c", 0.0)]


def test_provider_calls(spark, tmp_path):
    """Once for each segment, again only for what is too long and shrinks, and once at the end."""
    log = str(tmp_path / "calls")

    class Counting(HashProvider):
        def __init__(self, share):
            self.share = share

        def analyze_plot(self, text):
            if text == "bad":
                raise ValueError("no")
            with open(log, "a") as f:
                f.write(f"{len(text)}\n")
            return {"summary": text[: max(1, int(len(text) * self.share))]}

    def calls(rows, share, **sizes):
        open(log, "w").close()
        out = summarize.chapter_summaries(spark.createDataFrame(rows, "id string, text string"), ["id"], "text", Counting(share), **sizes)
        got = {r.id: (r.summary, r.had_error) for r in out.collect()}
        return got, len(open(log).read().split())

    assert calls([("a", "x" * 40)], 0.5, segment_max=100) == ({"a": ("x" * 10, False)}, 2)
    assert calls([("a", ""), ("b", None)], 0.5, segment_max=100) == ({"a": ("", False), "b": ("", False)}, 0)
    long = "\n\n".join("y" * 90 for _ in range(10))
    # ten segments of 90, ten halves joined (459), of which five segments of up to 100 are left (229), and so on until 100 fit
    got, n = calls([("a", long), ("b", "z" * 20)], 0.5, segment_max=100)
    assert got["b"] == ("z" * 5, False) and len(got["a"][0]) <= 50 and 10 + 5 + 2 < n < 30
    # nothing shrinks: one pass more, then it is cut and told once
    got, n = calls([("a", long)], 1.0, segment_max=100)
    assert len(got["a"][0]) == 100 and n == 10 + 10 + 1
    got, n = calls([("a", "bad"), ("b", "ok")], 1.0, segment_max=100)
    assert got == {"a": ("", True), "b": ("ok", False)}
    out = summarize.item_summaries(spark.createDataFrame([("a", ["p" * 30, "q" * 30, None]), ("b", [])], "id string, items array<string>"), ["id"], "items", Counting(1.0), 40).collect()
    assert {r.id: r.summary for r in out} == {"a": ("p" * 30 + "\n" + "q" * 9), "b": ""}


def test_rerank_fails_open(spark):
    class Broken:
        def score(self, queries, texts):
            raise RuntimeError("no model")

    df = spark.createDataFrame([("a", 3.0, "x"), ("b", 1.0, "long"), ("c", 2.0, None)], "id string, score double, snippet string")
    assert [r.id for r in search.rerank(df, "q", Broken(), 2, ties=("id",)).collect()] == ["a", "c"]


def test_audit_of_ten_thousand_fingerprints(spark):
    import difflib
    import random

    rng = random.Random(1)
    words = ["lantern", "harbour", "mirror", "ledger", "oath", "frost", "cipher", "vigil", "tide", "thorn"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    prints = spark.createDataFrame([(i, line(6) + f" {i}") for i in range(10_000)], "pos int, line string")
    listed = [(r["text"], r["normalized"]) for r in audit.fingerprints(prints, "line").collect()]
    texts = [listed[7000][0], listed[5][0][:-6] + "xx", "They part.", line(40) + " " + listed[123][0] + " " + line(3), line(6)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None), (10, " ")], "id int, summary string")
    got = {r.id: (r.score, list(r.reasons)) for r in audit.audit(df, audit.fingerprints(prints, "line"), 0, 0.9, ["(?!)"]).collect()}
    assert got[0][0] == 2.0 and got[0][1] == [f"fingerprint_sim=1.00:{listed[7000][0]}", f"contains_fingerprint:{listed[7000][0]}"]
    assert any(r.startswith("contains_fingerprint") for r in got[3][1]) and 2 not in got and 9 not in got and 10 not in got
    # against every ratio
    known = audit.Fingerprints(listed[:300])
    for t in [line(6), line(2), listed[3][1], ""]:
        best = max(((difflib.SequenceMatcher(None, t, n).ratio(), -i) for i, (_, n) in enumerate(listed[:300])))
        top, name, _ = known.look(t, 0.5)
        assert (top, name) == ((best[0], listed[-best[1]][0]) if best[0] >= 0.5 else (0.0, ""))


def test_kept_index_finds_what_bm25_finds(spark, tmp_path):
    import random

    rng = random.Random(5)
    words = ["lantern", "harbour", "mirror", "铜灯", "白塔", "frost"]
    rows = [(f"n{i % 3}", f"c{i}", i, f"t{i}", "\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 20))) for _ in range(4))) for i in range(30)]
    ch = spark.createDataFrame(rows, "novel_id string, chapter_id string, chapter_index int, title string, content string")
    index = search.Bm25Index(spark, str(tmp_path / "index"))
    index.build(ch, 20)
    order = lambda df: sorted(map(tuple, df.collect()))
    for query, options in (("铜灯 lantern", {}), ("白塔", {"novel_id": "n1"}), ("frost frost 灯", {"chapter_range": (3, 20)}), ("nowhere", {})):
        assert order(index.search(query, 7, **options)) == order(search.bm25(ch, query, 7, min_len=20, **options))
    assert index.search(" ", 5).count() == 0


def test_by_meaning(spark):
    p = HashProvider()
    ch = spark.createDataFrame([("n", "a", 0, "t", "the bronze lantern went out " * 3, None), ("n", "b", 1, "u", "a sealed letter came at dawn " * 3, [1.0] * 64), ("n", "c", 2, "v", None, [1.0] * 64)], "novel_id string, chapter_id string, chapter_index int, title string, content string, embedding array<double>")
    q = p.embed("the bronze lantern")
    assert search.paragraph_by_meaning(ch, q, p, 1, min_len=10).first().chapter_id == "a"
    assert [r.chapter_id for r in search.chapter_by_meaning(ch, [1.0] * 64, 5).collect()] == ["b"]
    plots = spark.createDataFrame([("n", 0, "v", "a", "b", "the bronze lantern"), ("n", 1, "w", "a", "b", None)], "novel_id string, plot_index int, volume_title string, start_chapter string, end_chapter string, summary string")
    assert search.plot_by_meaning(plots, q, p).first().score == 1.0 and search.plot_by_meaning(plots, q, p).count() == 1
    novels = spark.createDataFrame([("n", "T", "the bronze lantern", ["f"], None, None), ("m", "U", "a letter", None, None, [1.0] * 64), ("o", "V", None, None, None, None)], "novel_id string, title string, summary string, features array<string>, characters array<string>, summary_embedding array<double>")
    assert [(r.novel_id, r.features) for r in search.novel_by_meaning(novels, q, 1, p).collect()] == [("n", ["f"])] and search.novel_by_meaning(novels, q, 5).count() == 1


def test_reindex_and_rewrite(spark, tmp_path):
    p, store = HashProvider(), chunks.ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("n/1", "n", "paragraph", "the lantern"), ("n/2", "n", "paragraph", ""), ("m/1", "m", "paragraph", "a letter")], "chunk_id string, novel_id string, content_type string, content string")
    assert {(r.novel_id, r.stored, r.skipped) for r in chunks.reindex(store, rows, p).collect()} == {("n", 1, False), ("m", 1, False)}
    assert {(r.novel_id, r.stored, r.skipped) for r in chunks.reindex(store, rows, p).collect()} == {("n", 1, True), ("m", 1, True)}
    assert {(r.novel_id, r.stored, r.skipped) for r in chunks.reindex(store, rows.where("chunk_id = 'n/1'"), p, True).collect()} == {("n", 1, False)}
    assert store.count() == 2
    summary, chapter = chunks.record_vectors(spark.createDataFrame([("n", "s s"), ("m", None)], "novel_id string, summary string"), spark.createDataFrame([("n", "c", "x y")], "novel_id string, chapter_id string, content string"), p)
    assert {r.novel_id: r.summary_embedding is not None for r in summary.collect()} == {"n": True, "m": False} and len(chapter.first().embedding) == 64
    folder = str(tmp_path / "summaries")
    spark.createDataFrame([(1, "bad"), (2, "good")], "id int, summary string").write.parquet(folder)
    found = spark.createDataFrame([(1, 0.9)], "id int, score double")
    assert audit.rewritten(spark, folder, found, ["id"], 0.5) == 1 and audit.rewritten(spark, folder, found, ["id"], 0.5) == 0
    assert [r.id for r in spark.read.parquet(folder).collect()] == [2] and spark.read.parquet(folder + ".bak").count() == 2


def test_answers_of_providers(spark):
    from tomeflow.functions.text import error_decision, string_array, utc_now

    rows = ['queries: ["a", "b \\" c", "d"] ok', "[1, 2]", "none", None, '["x", 1]', "[]", '["1","2","3","4","5","6"]']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.a for r in df.select(string_array("t").alias("a")).collect()] == [["a", 'b " c', "d"], None, None, None, None, [], ["1", "2", "3", "4", "5"]]
    errors = spark.createDataFrame([("HTTP 502 Bad Gateway",), ("Insufficient quota 429",), ("timed out",), ("odd",), (None,)], "t string")
    assert [tuple(r.d) if r.d else None for r in errors.select(error_decision("t").alias("d")).collect()] == [("throttle", "upstream_5xx"), ("disable", "quota_exhausted"), ("throttle", "network_error"), None, None]
    assert spark.range(1).select(utc_now().alias("n")).first().n.endswith("Z")

    class Failing(HashProvider):
        def analyze_plot(self, text):
            if "x" in text:
                raise ValueError("no")
            return {"summary": text}

    texts = spark.createDataFrame([("a", "ok"), ("b", "x")], "id string, text string")
    with pytest.raises(RuntimeError, match="1 failed: b: no"):
        summarize.strictly_mapped(texts, ["id"], "text", Failing(), retries=0)
    assert summarize.strictly_mapped(texts.where("id = 'a'"), ["id"], "text", Failing()).count() == 1


def test_paragraphs_of_a_long_text(spark):
    """Against the rule in Python; and the work grows with the text, not with its square."""
    import random
    import time

    from tomeflow.operators.segment import paragraphs_a

    rng = random.Random(3)
    block = lambda: " ".join(rng.choice(["ab", "cde\nfg", "铜灯"]) for _ in range(rng.choice([1, 2, 3, 30])))
    texts = ["\n\n".join(block() for _ in range(n)) for n in (0, 1, 5, 40)] + ["\n \n", None]

    def by_hand(text):
        out = []
        for b in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
            if len(b) >= 60:
                out.append(b)
                continue
            line = " ".join(filter(None, (x.strip() for x in b.split("\n"))))
            if out:
                out[-1] += " " + line
            else:
                out.append(line)
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(paragraphs_a("t").alias("p")).collect()] == [None if t is None else by_hand(t) for t in texts]
    took = []
    for n in (20_000, 80_000):
        one = spark.createDataFrame([("\n\n".join("x" * 70 for _ in range(n)),)], "t string")
        began = time.time()
        assert one.select(F.size(paragraphs_a("t"))).first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 2
