import random

import pytest

pytest.importorskip("tiktoken")
from tomeflow.llm import tokens
from tomeflow.llm.packing import BestFit, pack

TEXTS = ["", None, "Hello  world\n\n it's <|endoftext|>", "章节" * 300 + "。\n\n  b", "a" * 2000, " " * 1500, "'ll'll 's\n\n\n b  c 1234 " * 60, "é́\u0085x y" * 100]


def test_ids_equal_one_pass_and_decode(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "b ", "\n", "'", "'s", "'ll", "1", "中", "。", "  "]) for _ in range(900)) for _ in range(5)]
    df = spark.createDataFrame([(None if i == 3 else i, t, "clash") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, ids string")
    one = tokens.encoder().encode_ordinary
    got = sorted(((r.doc_id or -1), list(r.ids)) for r in tokens.token_ids(df, "doc_id", "text", chunk_chars=100, overlap=24).collect())
    want = sorted((-1 if i in (0, 3) else i, one(t) if t else []) for i, t in enumerate([*texts, texts[2]]))
    assert got == want
    for i, t in enumerate(texts):
        if t:
            assert tokens.decode(one(t)) == t
    counts = sorted((r.doc_id or -1, r.n_tokens) for r in tokens.token_counts(df, "doc_id", "text", chunk_chars=100, overlap=24).collect())
    assert counts == sorted((i, len(x)) for i, x in want)


def test_pieces_against_one_pass(spark):
    """Pieces at pre-token boundaries whatever the chunks, endless runs and repeats of them included."""
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "'", "'s", "'ll", "1", "中", "。", "é", "  "]
    one = tokens.encoder().encode_ordinary
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(30, 400))) for _ in range(120)]
    texts += [" " * 90 + "x", "a" * 95 + " b" * 40 + "c" * 95, "'s" * 90, " " * 50 + "a" * 60 + " " * 70 + "1" * 50, "\n" * 200, ("z" * 45 + " ") * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    for step, lap in ((20, 8), (31, 16)):
        found: dict = {}
        for r in tokens.long_pieces(df, step, lap).collect():
            found.setdefault(r.key, []).append((r.piece_no, r.piece))
        for i, t in enumerate(texts):
            pieces = [p for _, p in sorted(found[i])]
            assert "".join(pieces) == t
            assert [x for p in pieces for x in one(p)] == one(t)
    assert tokens.long_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.long_pieces(df, 10, 10)


def test_no_task_gets_a_long_text(spark):
    """All pieces are as short as chunks, and their sizes say that none was gathered."""
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "中文。", "it's ", "\n"]) for _ in range(60_000))
    rows = tokens.long_pieces(spark.createDataFrame([(1, text)], "key long, text string"), 4096, 256).collect()
    assert len(rows) > len(text) // 4096 and max(len(r.piece) for r in rows) <= 4096 + 512


def test_time_grows_with_the_length(spark):
    import time

    rng = random.Random(4)
    unit = "".join(rng.choice(["word ", "中文。", "it's ", "\n"]) for _ in range(50_000))
    took = []
    for n in (8, 32):
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        began = time.time()
        assert tokens.token_counts(df, "doc_id", "text").first().n_tokens > 0
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 3


def test_best_fit(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 3, 50, 99, 100, 101, 250, 1000]) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(None, None)], "doc_id long, n_tokens long").repartition(3)
    rows = pack(df, "doc_id", "n_tokens", 100, open_bins=8).collect()
    used, tokens_of = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        tokens_of.setdefault(r.doc_id, []).append((r.part_no, r.token_from, r.n_tokens))
    assert max(used.values()) <= 100
    for i, n in enumerate(sizes):
        parts = sorted(tokens_of[i])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == n
        assert [p[1] for p in parts] == [100 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-n // 100))
    assert tokens_of[None] == [(0, 0, 0)]
    assert sum(sizes) / (100 * len(used)) > 0.9
    assert pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n_tokens", 0)


def test_fullest_closes_first():
    fit = BestFit(10, open_bins=2)
    assert [fit.add(n)[0][0] for n in (6, 7, 8, 3, 4)] == [0, 1, 2, 0, 3]
