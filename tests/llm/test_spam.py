import random

from conftest import rows

from graphlake.llm.spam import ProseModel, abnormal_words, spam_pages, spam_scores, spam_share

R = random.Random(5)
NOUNS = ["harbour", "lantern", "meadow", "clerk", "wagon", "brewery", "school", "bridge", "orchard", "signal", "council", "market"]
VERBS = ["opened", "mended", "praised", "crossed", "visited", "painted"]
TOWNS = ["Garby", "Lorsea", "Venden", "Tanlow", "Ulmere", "Wesham"]


def sentence():
    n = lambda: R.choice(NOUNS)
    return R.choice([f"The {n()} of {R.choice(TOWNS)} {R.choice(VERBS)} the {n()} near the {n()}.", f"In {R.choice(TOWNS)} the {n()} and the {n()} {R.choice(VERBS)} quickly.", f"Mr. {R.choice(TOWNS)} {R.choice(VERBS)} the old {n()} because the {n()} {R.choice(VERBS)} it."])


def prose(n=12):
    return " ".join(sentence() for _ in range(n))


PROSE = [prose() for _ in range(60)]
MODEL = ProseModel(PROSE)
KEYS = ["pills", "boots", "tea", "cheap", "buy", "best"]


def share(t):
    return spam_share(MODEL, t.split())[0]


def keywords(n=120):
    return " ".join(R.choice(KEYS) for _ in range(n))


def test_spam_of_every_kind():
    links = " ".join(f"www.{R.choice(NOUNS)}-{R.choice(KEYS)}.test/{R.choice(KEYS)}?p={R.randrange(99)}" for _ in range(60))
    doorway = " ".join(f"{R.choice(KEYS)} {R.choice(TOWNS)} |" for _ in range(70))
    counts = " ".join(f"{R.choice(NOUNS + KEYS)} ({R.randrange(200)})" for _ in range(80))
    tags = " ".join(f"#{R.choice(NOUNS + KEYS)}" for _ in range(80))
    for t in (keywords(), links, doorway, counts, tags):
        assert share(t) > 0.7, t[:60]
        assert share(prose(5) + " " + t) > 0.3


def test_no_spam():
    timetable = " ".join(f"{t} {R.randrange(24)}.{R.randrange(10, 60)}" for _ in range(20) for t in TOWNS)
    prices = " ".join(f"{n.title()} {R.randrange(60)}s. {R.randrange(12)}d. per" for _ in range(8) for n in NOUNS)
    results = " ".join(f"{R.choice(TOWNS)} {R.randrange(6)} {R.choice(TOWNS)} {R.randrange(6)};" for _ in range(50))
    names = " ".join(f"Mr. {R.choice('ABCDEFGH')}{R.choice(NOUNS)}, {R.choice(TOWNS)};" for _ in range(60))
    for t in (prose(), timetable, prices, results, names, prose() + " www.garby-tea.test/tea " + prose(), prose().replace("meadow", "tea").replace("clerk", "tea")):
        assert share(t) < 0.15, t[:60]


def test_operator_with_nulls_empty_long_and_clashing_columns(spark):
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    docs = [(1, keywords()), (2, prose()), (3, None), (4, ""), (5, keywords(100_000)), (6, "||| --- |"), (1, keywords()), (7, "pills " * 300)]
    d = spark.createDataFrame([(i, t, None, 0.5) for i, t in docs], f"doc_id bigint, text string, lines {box}, spam_share double")
    p = spark.createDataFrame([(t, "en") for t in PROSE] + [(None, "en")], "text string, doc_id string")
    assert rows(spam_pages(d, p)) == [(1,), (1,), (5,), (7,)]
    assert {r["doc_id"]: r["spam_share"] for r in spam_scores(d, p).collect()}[3] == 0
    assert rows(spam_pages(d.limit(0), p)) == []
    assert rows(spam_pages(d, p.limit(0))) == []


def test_columns_are_read_by_their_boxes(spark):
    left, right = [keywords(4) for _ in range(25)], [prose(1)[:30] for _ in range(25)]
    mixed = "\n".join(v for q in zip(left, right, strict=True) for v in q)
    boxes = [(x, 20 * i, x + 400, 20 * i + 15, 1.0) for i in range(25) for x in (100, 1300)]
    d = spark.createDataFrame([(1, mixed, boxes)], "doc_id bigint, text string, lines array<struct<x0:int,y0:int,x1:int,y1:int,conf:double>>")
    got = spam_scores(d, spark.createDataFrame([(t,) for t in PROSE], "text string")).first()["spam_share"]
    assert 0.2 < got < 0.7


def kinds_of_spam():
    return [keywords(), " ".join(f"#{R.choice(NOUNS + KEYS)}" for _ in range(80)), " ".join(f"{R.choice(KEYS)} {R.choice(TOWNS)} /" for _ in range(70)), " ".join(f"go www.{R.choice(NOUNS)}-{R.choice(KEYS)}.test/{R.choice(KEYS)}" for _ in range(60))]


def test_the_model_alone_decides(monkeypatch):
    """With a model that finds every word equally likely no page is spam."""
    assert all(share(t) > 0.5 for t in kinds_of_spam())
    monkeypatch.setattr(ProseModel, "_bits", lambda self, x, y, z: 5.0)
    constant = ProseModel(PROSE)
    assert all(spam_share(constant, t.split())[0] == 0 for t in [*kinds_of_spam(), prose()])


def test_perplexity_counts_on_both_sides():
    assert abnormal_words([1.0] * 50 + [9.0] * 50, 0.5, 3.0) == 50
    assert abnormal_words([1.0] * 50 + [0.0] * 50, 0.5, 3.0) == 50
    assert abnormal_words([1.0] * 50 + [9.0] + [1.0] * 50, 0.5, 3.0) == 0
    assert abnormal_words([9.0] * 30 + [1.0] * 40 + [9.0] * 30, 0.5, 3.0) == 60
    assert abnormal_words([], 0.5, 3.0) == 0


def test_function_words_are_learned_from_the_prose():
    assert {"the", "of", "and"} <= set(MODEL.word) and not set(MODEL.word) & set(NOUNS)


def test_long_pages_of_many_keywords_are_spam():
    many = [a + b for a in ("tob", "car", "gen", "lam") for b in ("acco", "pets", "uine", "ps", "ors")] * 4
    assert share(" ".join(R.choice(many) for _ in range(20_000))) > 0.9


def test_more_prose_than_the_bound_is_sampled(spark, monkeypatch):
    from graphlake.llm import spam

    monkeypatch.setattr(spam, "MAX_PROSE_WORDS", 2500)
    d = spark.createDataFrame([(1, keywords(), None), (2, prose(), None)], "doc_id bigint, text string, lines array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>")
    p = spark.createDataFrame([(t, "en") for t in PROSE], "text string, lang string")
    assert rows(spam_pages(d, p, prose_lang="lang")) == [(1,)]


def test_all_prose_counts_beyond_what_the_driver_reads(spark, monkeypatch):
    """Prose beyond the bound gives the model of the whole prose, to the last bit."""
    from graphlake.llm import spam

    texts = [*PROSE, *(prose().replace("the", "der").replace("The", "Der") for _ in range(20)), PROSE[0], "", "Of 3 it", "||| ---", prose(1)]
    langs = ["en"] * 60 + ["de"] * 20 + ["en", None, "fr", "fr", None]
    pages = [(i, t, None) for i, t in enumerate([*kinds_of_spam(), *(prose() for _ in range(10)), PROSE[3] + keywords(70), "", "Of a it na"])]
    d = spark.createDataFrame(pages, "doc_id bigint, text string, lines array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>")
    p = spark.createDataFrame([*zip(texts, langs, strict=True), (None, "en")], "text string, lang string").repartition(3)
    whole = ProseModel(texts, [lang or "" for lang in langs])
    wanted = [(i, *spam_share(whole, t.split())) for i, t, _ in pages]
    assert rows(spam_scores(d, p, prose_lang="lang")) == wanted
    monkeypatch.setattr(spam, "MAX_PROSE_WORDS", 500)
    assert rows(spam_scores(d, p, prose_lang="lang")) == wanted
    clean = p.selectExpr("text AS t", "coalesce(lang, '') AS l").filter("t IS NOT NULL")
    for most in (0, 100, spam.MAX_MEANS):  # thresholds found in several steps or at once
        monkeypatch.setattr(spam, "MAX_MEANS", most)
        got = spam._model_of(clean)
        for a in ("word", "short", "follow", "after", "kinds", "opening", "low", "high"):
            assert getattr(got, a) == getattr(whole, a), a
    nothing = spam._model_of(clean.filter("t = ''"))
    assert (nothing.low, nothing.high) == (-float("inf"), float("inf"))
