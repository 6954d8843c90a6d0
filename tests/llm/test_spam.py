import random

from tomeflow.llm.spam import FEATURES, LABELS, STUFFED, features, spam_scores, weak_label

COLUMNS = LABELS + FEATURES


def share(text):
    row = dict(zip(COLUMNS, features(text)))
    return max(row["listed"], row["stuffed"] if row["top_phrase"] >= STUFFED else 0.0)


def story(rng, n):
    who, what, where = ["Ann", "Bexley", "Corrin", "Draya"], ["a lantern", "the iron key", "a sealed letter", "the map", "a broken bell"], ["the harbour", "an old inn", "the glass orchard", "the lower decks"]
    verbs = ["hid", "found", "carried", "returned", "studied"]
    return "\n".join(f"{rng.choice(who)} {rng.choice(verbs)} {rng.choice(what)} near {rng.choice(where)}, and nobody in {rng.choice(where)} spoke of it for {rng.randint(2, 90)} days." for _ in range(n))


def spam(rng, n):
    words = ["latest chapter", "read free", "web novel", "no ads", "light novel", "full book pdf", "Home", "Log in"]
    kind = rng.randrange(5)
    if kind == 0:
        return rng.choice([" | ", "\n", ", ", " > "]).join(rng.choice(words) for _ in range(4 * n))
    if kind == 1:
        return "\n".join(f'<a href="https://a{rng.randint(1, 99)}.test/read/{i}">{rng.choice(words)}</a>' for i in range(n))
    if kind == 2:
        return " ".join(f"#{rng.choice(['Web', 'Light', 'Free'])}Novel{rng.choice(['Oath', 'Tide', 'Mask'])}" for _ in range(3 * n))
    if kind == 3:
        return "；".join(f"Pale Oath {rng.choice(['mug', 'poster', 'hoodie'])} ${rng.randint(10, 99)}.90 sale" for _ in range(2 * n))
    return " ".join(rng.choice(["Looking for Pale Oath read free? Pale Oath read free here, Pale Oath read free now.", "Get Pale Oath read free and more Pale Oath read free."]) for _ in range(n))


def test_shares():
    rng = random.Random(1)
    for i in range(60):
        assert share(spam(rng, 12)) > 0.8 and share(story(rng, 12)) < 0.1
    verse = "\n".join(f"While the tide of {i} years came in,\ncome home, come home, you who sleep." for i in range(20))
    assert share(verse) < 0.4
    assert share("I have waited twelve years for this! " * 3 + story(rng, 10)) < 0.4
    assert share("啊" * 500) < 0.4 and share("4" * 800) < 0.4 and share("-*" * 400) < 0.4
    assert features(None) == features(" \n") == [0.0] * len(COLUMNS)


def test_scores(spark):
    rng = random.Random(2)
    rows = [(i, story(rng, 15), "good") for i in range(60)] + [(100 + i, spam(rng, 15), "bad") for i in range(60)]
    rows += [(200, None, "good"), (201, "", None), (202, " ", "good"), (100, rows[60][1], "bad"), (None, story(rng, 9), "x"), (203, story(rng, 3000), "good")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, score double")
    got = [(r.doc_id, r.score > 0.5) for r in spam_scores(df, "doc_id", "text", "source").collect()]
    assert len(got) == len(rows)
    assert {i for i, s in got if s} == {100 + i for i in range(60)}
    assert sum(1 for i, s in got if i == 100 and s) == 2
    assert spam_scores(df.limit(0), "doc_id", "text", "source").count() == 0
    alike = spam_scores(df.where("source = 'good'"), "doc_id", "text", "source")
    assert alike.where("score > 0.5").count() == 0


def test_phrase_between_changing_words(spark):
    # three words of a phrase to two others, four characters to three: over half is keywords, few word pairs recur
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    char = lambda: chr(rng.randint(0x4E00, 0x9000))
    english = " ".join(f"{word()} novel chapter latest {word()}" + "." * (i % 5 == 4) for i in range(60))
    chinese = "".join(f"{char()}免费小说{char()}{char()}" + "。" * (i % 5 == 4) for i in range(60))
    at = COLUMNS.index
    rows = [features(english), features(chinese)]
    for f in rows:
        assert f[at("distinct")] > 0.55 and f[at("stuffed")] > 0.9 and f[at("top_phrase")] > 0.5
    labels = spark.createDataFrame(rows, COLUMNS).select(weak_label().alias("label")).collect()
    assert all(r.label == 1.0 for r in labels)


def test_commonest_is_the_first_of_equals():
    import numpy as np
    from collections import Counter

    from tomeflow.llm.spam import _commonest

    rng = random.Random(4)
    for bits, gram in ((16, 4), (21, 3), (30, 3), (32, 3)):
        ids = [rng.choice([0, 1, 2, (1 << bits) - 1]) for _ in range(300)]
        gram_at, n = _commonest(np.array(ids, np.uint32), gram, bits)
        assert (tuple(ids[gram_at : gram_at + gram]), n) == Counter(zip(*(ids[i:] for i in range(gram)))).most_common(1)[0]


def test_compressed_is_of_the_whole_text():
    head, tail = "a" * (1 << 20), "".join(random.Random(5).choices("bcdefghijklmnopqrstuvwxyz", k=1 << 20))
    at = COLUMNS.index("compressed")
    assert features(head + tail)[at] > 0.25 and features(head)[at] < 0.02


def test_trees_decide_without_the_labels_columns(spark):
    """Running keywords that no list shows have no weak label, and are found by what they share with labelled spam."""
    assert not set(LABELS) & set(FEATURES)
    rng = random.Random(6)
    words = ["latest chapter", "read free", "web novel", "no ads", "light novel", "full book", "Pale Oath", "top romance"]
    mixed = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(20)]
    rows = [(i, story(rng, rng.randint(3, 30)), f"s{i % 7}") for i in range(300)] + [(1000 + i, spam(rng, 15), f"s{i % 7}") for i in range(120)] + [(2000 + i, x, f"s{i % 7}") for i, x in enumerate(mixed)]
    rows += [(3000 + i, c * 400 + story(rng, 2), "s1") for i, c in enumerate(["a", "ab", "éäñ", "-", "7"])]
    labels = spark.createDataFrame([features(x) for x in mixed], COLUMNS).select(weak_label().alias("label")).collect()
    assert all(r.label is None for r in labels)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id for r in spam_scores(df, "doc_id", "text", "source").where("score > 0.5").collect()}
    assert not found & (set(range(300)) | set(range(3000, 3005)))
    assert len(found & set(range(2000, 2020))) >= 18 and len(found & set(range(1000, 1120))) >= 118


def test_host_rate_moves_what_is_between(spark):
    """The same uncertain page is likelier spam where all else is spam."""
    rng = random.Random(7)
    rows = [(i, story(rng, 10), "good") for i in range(80)] + [(100 + i, spam(rng, 12), "bad") for i in range(80)]
    doubtful = "\n".join(spam(rng, 4).split("\n")[:6]) + "\n" + story(rng, 4)
    rows += [(500, doubtful, "good"), (501, doubtful, "bad")]
    got = {r.doc_id: r for r in spam_scores(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").where("doc_id >= 500").collect()}
    assert got[500].page_score == got[501].page_score and got[500].score < got[501].score
