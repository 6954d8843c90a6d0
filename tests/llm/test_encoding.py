import random

import numpy as np
import pytest

from tomeflow.llm.encoding import garbled, inverse, segments


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(200):
        x = np.array([rng.choice([1.0, -0.5, -1.5]) for _ in range(30)])
        found = segments(x)
        best = max((x[i:j].sum() for i in range(30) for j in range(i + 1, 31)))
        if best > 0:
            assert max(s for *_, s in found) == pytest.approx(best)
            assert all(s == pytest.approx(x[a:b].sum()) and s > 0 for a, b, s in found)
    assert segments(np.zeros(0)) == []


def test_inverse():
    text = "海面上亮起一排幽蓝的光。"
    assert inverse(text.encode().decode("latin-1"), "latin-1", "utf-8") == text
    assert inverse("é".encode().decode("cp1252").encode().decode("cp1252"), "cp1252", "utf-8") == "é"
    assert inverse(text, "cp1252", "utf-8") is None


def story(rng, lang):
    if lang == "zh":
        return "\n".join("".join(f"{rng.choice(['虞照夜', '岚止水', '沐烬'])}在{rng.choice(['雾港码头', '白塔顶层', '药王谷口'])}{rng.choice(['得到', '藏起', '打碎'])}{rng.choice(['一只空鸟笼', '三枚铜钱', '半张海图'])}，海面上亮起一排幽蓝的光。" for _ in range(3)) for _ in range(4))
    return "\n".join(f"« Tu le savais déjà », répondit {rng.choice(['Gaël', 'Théo'])} près de la forêt gelée, où brûlait {rng.choice(['la lanterne fêlée', 'le registre à demi brûlé'])}." for _ in range(5))


def test_restores_and_spares(spark):
    rng = random.Random(2)
    rows, want, texts = [], set(), {}
    for i in range(300):
        t = story(rng, "zh" if i % 3 else "fr")
        if i % 25 == 0:
            t += "\nÅngvold wrote “Übermut”, § 7; она ждёт, αβγδ, ไฟ 𝔐 🏮, 烎槑嘦。"
        texts[i] = t
        if i % 15 == 4:
            lines = t.split("\n")
            if i % 3:
                used = [("gbk", "utf-8"), ("latin-1", "utf-8"), ("latin-1", "gbk"), ("utf-16-be", "utf-16-le")][i // 15 % 4]
                lines[1] = lines[1].encode(used[1]).decode(used[0], "replace")
            else:
                lines[1] = lines[1].encode().decode("cp1252", "replace")
            t = "\n".join(lines)
            want.add(i)
        rows.append((i, t, "c"))
    rows += [(500, None, ""), (501, "", ""), (502, "plain", ""), (503, "caf� cass�", ""), (4, rows[4][1], "c")]
    want.add(503)
    df = spark.createDataFrame(rows, "raw_id long, content string, restored string")
    got = garbled(df, "raw_id", "content").collect()
    assert {r.raw_id for r in got} == want and len(got) == len(want) + 1
    exact = [r.raw_id for r in got if r.content == texts.get(r.raw_id)]
    assert len(exact) >= 0.4 * len(want)
    assert garbled(df.limit(0), "raw_id", "content").count() == 0


def test_half_width_katakana():
    chinese, japanese = "他在雾港码头得到一只空鸟笼，海面上亮起一排幽蓝的光。", "夜が明けると、港の鐘が三度鳴り、誰も口を開かなかった。"
    for text, right in ((chinese, "gbk"), (japanese, "euc-jp"), (japanese, "utf-8")):
        damaged = text.encode(right).decode("cp932", "replace")
        back = inverse(damaged, "cp932", right)
        assert back and sum(a in back for a in text) >= 0.6 * len(text)
    assert inverse(chinese, "cp932", "gbk") is None


def test_few_wide_characters(spark):
    rng = random.Random(5)
    rows = [(i, story(rng, "zh" if i % 3 else "fr")) for i in range(120)]
    french, chinese = story(rng, "fr"), story(rng, "zh")
    accents = french.replace("«", "“").replace("»", "”").replace("à ", "").replace("déjà", "")
    texts = {200 + i: (accents.encode("cp1252").decode(used, "replace"), accents) for i, used in enumerate(("gbk", "big5", "cp932"))}
    texts[203] = (chinese + "\n" + "铜钱".encode().decode("gbk") + "\n" + chinese, chinese + "\n铜钱\n" + chinese)
    names = {300: french + " Ångvold 烎槑嘦 et 虞照夜.", 301: chinese + "\n烎槑嘦\n" + chinese}
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in texts.items()] + list(names.items()), "raw_id long, content string")
    got = {r.raw_id: r for r in garbled(df, "raw_id", "content").collect()}
    assert set(got) == set(texts) and all(r.restored for r in got.values())
    assert got[203].content == texts[203][1]
    for i in (200, 201):
        assert got[i].content.count("é") >= 0.8 * accents.count("é")
    assert inverse("gel閑�", "gbk", "cp1252") == "gelée�"


@pytest.mark.parametrize(("used", "right", "lang"), [("cp1252", "utf-8", "fr"), ("latin-1", "utf-8", "zh"), ("mac-roman", "cp1252", "fr"), ("latin-1", "gbk", "zh")])
def test_a_third_damaged_alike(spark, used, right, lang):
    rng = random.Random(6)
    clean = {i: story(rng, "fr" if i % 2 else "zh") for i in range(240)}
    want = {i for i in clean if i % 3 == 0 and (lang == "fr") == bool(i % 2)}
    rows = [(i, t.encode(right).decode(used) if i in want else t) for i, t in clean.items()]
    got = {r.raw_id: r.content for r in garbled(spark.createDataFrame(rows, "raw_id long, content string"), "raw_id", "content").collect()}
    assert set(got) == want
    if right == "utf-8":
        assert all(got[i] == clean[i] for i in want)
