import random

import pytest

from tomeflow.llm.splitting import spill_items, split_files, split_items


def text(seed, n):
    rng = random.Random(seed)
    parts = ["字", "a", "中文", " ", ". ", "。", "！”", "\n", "\r\n", "\n\n", "word ", "？", "…", "!!!!", "x" * 30]
    return "".join(rng.choice(parts) for _ in range(n))


def checked(pieces, original, size, overlap):
    end = 0
    for start, piece in pieces:
        assert 0 < len(piece) <= size
        assert original[start : start + len(piece)] == piece
        assert start == max(0, end - overlap)
        end = start + len(piece)
    assert end == len(original)


@pytest.mark.parametrize("range_chars", [1 << 16, 200])
def test_pieces_rebuild_their_items(spark, range_chars):
    texts = [text(i, 400) for i in range(20)] + ["a" * 3000, "\n" * 2000, "!" * 1000 + "b" * 1000, "", None, "short", " " * 1500 + "end. " + " " * 900]
    df = spark.createDataFrame([(i, t, 50, 10, "other") for i, t in enumerate(texts)], "id long, body string, most int, lap int, piece string")
    rows = split_items(df.drop("piece"), ["id"], "body", "most", "lap", range_chars).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.piece_no, r.start, r.piece) for r in rows if r.id == i)
        assert [m[0] for m in mine] == list(range(len(mine)))
        if not t or len(t) <= 50:
            assert [m[2] for m in mine] == [t]
        else:
            checked([m[1:] for m in mine], t, 50, 10)


def test_cuts_at_boundaries(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine. Ten.", 32, 4)], "id long, body string, most int, lap int")
    pieces = [r.piece for r in split_items(df, ["id"], "body", "most", "lap").orderBy("piece_no").collect()]
    assert pieces[0] == "One two three. Four five six."
    assert pieces[1].startswith("six.")


def test_files_by_byte_ranges(spark, tmp_path):
    originals = {}
    for i in range(4):
        t = text(100 + i, 3000 if i else 0)
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
        originals[str(tmp_path / f"{i}.txt")] = t
    rows = split_files(spark, list(originals), 60, 8, range_bytes=960).collect()
    for path, t in originals.items():
        mine = sorted((r.piece_no, r.start, r.piece) for r in rows if r.path == path)
        assert [m[0] for m in mine] == list(range(len(mine)))
        if t:
            checked([m[1:] for m in mine], t, 60, 8)
        else:
            assert [m[2] for m in mine] == [""]


def test_overlap_must_be_smaller(spark):
    df = spark.createDataFrame([(1, "a" * 50, 10, 10)], "id long, body string, most int, lap int")
    with pytest.raises(Exception, match="smaller than the limit"):
        split_items(df, ["id"], "body", "most", "lap").collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, body string, most int, lap int")
    assert split_items(df, ["id"], "body", "most", "lap").count() == 0


def test_long_values_as_files_have_the_same_text(spark, tmp_path):
    texts = {i: text(200 + i, 2000).replace("\r", "") for i in range(3)}
    df = spark.createDataFrame([*texts.items(), (9, None)], "id long, body string")
    paths = {r.id: r.path for r in spill_items(df, ["id"], "body", str(tmp_path)).collect()}
    rows = split_files(spark, list(paths.values()), 60, 8, range_bytes=960).collect()
    for i, t in texts.items():
        checked([m[1:] for m in sorted((r.piece_no, r.start, r.piece) for r in rows if r.path == paths[i])], t, 60, 8)
    assert [r.piece for r in rows if r.path == paths[9]] == [""]


def test_time_grows_with_the_length(spark):
    import time

    unit = text(7, 40_000)
    took = []
    for n in (8, 32):
        df = spark.createDataFrame([(1, unit * n, 1000, 100)], "id long, body string, most int, lap int")
        began = time.time()
        assert split_items(df, ["id"], "body", "most", "lap").count() > 40 * n
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 3
