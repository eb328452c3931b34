import random

import pytest
from conftest import rows

from graphlake.llm import contamination as C
from graphlake.llm.pages import columns, pieces

RNG = random.Random(9)
WORDS = [a + b + c for a in ("gar", "lom", "tin", "ver", "sul", "peb") for b in ("a", "o", "i") for c in ("don", "lick", "mer", "tash", "burn")]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


ITEM = text(40, 1)
OTHER = text(40, 2)
BOX = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"


def finder(min_words=14):
    return C.LeakFinder(C.Automaton.build([(1, " ".join(ITEM)), (2, " ".join(OTHER))]), min_words)


def lay(words, width=5):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def leaks(lines, x0=None, y0=None, **kw):
    return finder(**kw).leaks("\n".join(lines), x0, y0)


def test_automaton_lengths_match_brute_force():
    items = [[RNG.choice("abc") for _ in range(12)] for _ in range(5)]
    a = C.Automaton.build([(i, " ".join(w)) for i, w in enumerate(items)])
    spans = {tuple(w[i:j]) for w in items for i in range(12) for j in range(i + 1, 13)}
    f = C.LeakFinder(a, 3)
    for _ in range(30):
        s = [RNG.choice("abcd") for _ in range(20)]
        state = size = 0
        for k, w in enumerate(s):
            to = a.nxt[state].get(w)
            state, size = (to, size + 1) if to is not None else f._restart(state, w)
            best = max((n for n in range(k + 2) if n == 0 or tuple(s[k + 1 - n : k + 1]) in spans))
            assert size == best


def test_threshold():
    pad = text(12, 5)
    assert leaks(lay(pad + ITEM[3:17] + pad)) == {1: 14}
    assert leaks(lay(pad + ITEM[3:16] + pad)) == {}


def test_case_punctuation_and_misreads():
    got = ITEM[:20]
    got[0], got[4], got[9] = "X" + got[0][1:], got[4][:2] + "," + got[4][2:], got[9][:-1]
    assert leaks(lay([w.upper() + ";" for w in got])) == {1: 20}
    bad = list(ITEM[:20])
    bad[10] = "zzzzzz"
    assert leaks(lay(bad)) == {}


def test_first_exact_words_late_in_a_passage():
    got = [w if k % 3 else w[:-1] + "q" for k, w in enumerate(ITEM[:11])] + ITEM[11:14]
    assert leaks([" ".join(got)]) == {1: 14}
    assert leaks([" ".join(got[1:])]) == {}


def test_misread_short_words_inside_a_passage():
    item = ITEM[:7] + ["of"] + ITEM[7:14] + ["a"] + ITEM[14:30]
    f = C.LeakFinder(C.Automaton.build([(1, " ".join(item))]), 14)
    for wrong in ("oi", "f", "off"):
        got = [*item[:7], wrong, *item[8:15]]
        assert f.leaks(" ".join(got), None, None) == {1: 15}, wrong
        # at the head of a line, behind an advert too
        assert f.leaks("\n".join([" ".join(got[:7]), " ".join(got[7:])]), None, None) == {1: 15}, wrong
        assert f.leaks("\n".join([" ".join(got[:7]), "on sale", " ".join(got[7:])]), None, None) == {1: 15}, wrong
    assert f.leaks(" ".join([*item[8:15], "o", *item[16:23]]), None, None) == {1: 15}
    # another word is no misreading, and neither is the head of any later line
    assert f.leaks(" ".join([*item[:7], "up", *item[8:15]]), None, None) == {}
    g = C.LeakFinder(C.Automaton.build([(1, " ".join(ITEM[:13] + ["of"] + ITEM[13:]))]), 14)
    assert g.leaks("\n".join([" ".join(ITEM[:13]), "x y", "on sale"]), None, None) == {}


def test_words_broken_at_line_ends():
    s = " ".join(ITEM[:18])
    for mark in ("-", "=", "¬", "~", "­", ""):
        lines, rest = [], s
        while rest:
            cut = min(len(rest), 23)
            head, rest = rest[:cut], rest[cut:]
            broken = rest and head[-1] != " " and rest[0] != " "
            lines.append(head.strip() + (mark if broken else ""))
            rest = rest.strip()
        assert leaks(lines).get(1, 0) >= 17, (mark, lines)


def test_adverts_between_lines():
    lines = lay(ITEM[:20])
    lines[2:2] = ["MILLER'S TEA", "3/6. for sale", "Box 12, this office"]
    assert leaks(lines) == {1: 20}


def test_columns_down_across_and_run_together():
    left, right = lay(ITEM[:20]), lay(text(20, 6))
    x = [100, 102, 99, 101] + [1300] * 4
    y = [10, 20, 30, 40] * 2
    assert leaks(left + right, x, y) == {1: 20}
    mixed = [v for p in zip(left, right, strict=True) for v in p]
    assert leaks(mixed, [100, 1300] * 4, [10, 10, 20, 20, 30, 30, 40, 40]) == {1: 20}
    assert leaks(mixed) == {1: 20}
    for gap in ("    ", " | "):
        joined = [a + gap + b for a, b in zip(left, right, strict=True)]
        assert leaks(joined, [100] * 4, [10, 20, 30, 40]) == {1: 20}
    # from the foot of one column to the head of the next
    two = [a + "   " + b for a, b in zip(lay(text(10, 7)) + lay(ITEM[:10]), lay(ITEM[10:20]) + lay(text(10, 8)), strict=True)]
    assert leaks(two, [100] * 4, [10, 20, 30, 40]) == {1: 20}


def test_scattered_and_reworded_passages_are_none():
    scattered = [w for k in range(0, 40, 6) for w in ITEM[k : k + 6] + text(8, 50 + k)]
    assert leaks(lay(scattered)) == {}
    reworded = [w if k % 6 else "changed" for k, w in enumerate(ITEM)]
    assert leaks(lay(reworded)) == {}


def test_two_items_and_shared_words():
    assert leaks(lay(ITEM + OTHER)) == {1: 40, 2: 40}
    a = C.Automaton.build([(1, " ".join(ITEM[:20])), (2, " ".join(ITEM[:20])), (3, " ".join(ITEM[5:20]))])
    assert C.LeakFinder(a, 14).leaks(" ".join(ITEM[:20]), None, None) == {1: 20, 2: 20, 3: 15}


def test_operator_with_nulls_empty_long_and_clashing_columns(spark):
    s = " ".join
    long = s(text(200_000, 11) + ITEM)
    docs = [(1, s(ITEM), None, "x"), (1, s(ITEM), None, "x"), (2, None, None, "x"), (3, "", [], "x"), (4, long, None, "x"), (5, s(ITEM), [(1, 1, 1, 1, None)] * 3, "x"), (6, s(ITEM), [(None, None, None, None, None)], "x"), (None, s(ITEM), None, "x")]
    d = spark.createDataFrame(docs, f"doc_id bigint, text string, lines {BOX}, item_id string")
    items = spark.createDataFrame([(1, s(ITEM), 0), (2, None, 0), (3, "too short", 0)], "item_id bigint, text string, doc_id int")
    got = sorted(((r["doc_id"] or 0), r["item_id"], r["n_words"]) for r in C.leaked_items(d, items).collect())
    assert got == [(0, 1, 40), (1, 1, 40), (1, 1, 40), (4, 1, 40), (5, 1, 40), (6, 1, 40)]
    assert sorted(r["doc_id"] or 0 for r in C.remove_leaks(d, C.leaked_items(d, items)).collect()) == [0, 2, 3]
    assert rows(C.leaked_items(d.limit(0), items)) == [] and rows(C.leaked_items(d, items.limit(0))) == []


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ITEM_WORDS", 10)
    d = spark.createDataFrame([(1, "a", None)], f"doc_id bigint, text string, lines {BOX}")
    with pytest.raises(ValueError):
        C.leaked_items(d, spark.createDataFrame([(1, " ".join(ITEM))], "item_id bigint, text string"))


def test_pieces_and_columns():
    assert pieces("a b   c | d") == ["a b", "c", "d"] and pieces("  ") == []
    assert columns(["a", "b", "c"], [100, 1300, 101], [1, 1, 2]) == [["a", "c"], ["b"]]
    assert columns(["a   b", "c"], [100, 1300], [1, 2]) == [["a"], ["b", "c"]]
    assert columns([], [], []) == []


def wrong(word, k=2):
    return word[:k] + "q" + word[k + 1 :]


@pytest.mark.parametrize("n", [2, 9, 20, 200])
def test_a_misread_word_where_many_items_branch(n):
    stem = text(10, 21)
    branches = [f"{'bcdfghklmnprstvw'[k % 16]}{'aeiou'[k // 16 % 5]}{'rlnm'[k // 80]}tingale" for k in range(n)]
    f = C.LeakFinder(C.Automaton.build([(k, " ".join(stem + [w] + text(20, 100 + k))) for k, w in enumerate(branches)]))
    for k in (0, n - 1):
        got = stem + [wrong(branches[k], 5)] + text(20, 100 + k)[:3]
        assert f.leaks("\n".join(lay(text(9, 7)) + lay(got) + lay(text(9, 8))), None, None) == {k: 14}


@pytest.mark.parametrize("bad", [(2, 5, 8, 11), (0, 2, 4, 6, 8, 10, 12), (1, 3, 5, 7, 9, 11, 13), range(1, 14), range(13)])
def test_many_misread_words(bad):
    got = [wrong(w) if k in bad else w for k, w in enumerate(ITEM[4:18])]
    assert leaks(lay(text(9, 7)) + lay(got) + lay(text(9, 8))) == {1: 14}
    assert leaks(lay(text(9, 7)) + lay(got[1:]) + lay(text(9, 8))) == {}


@pytest.mark.parametrize("n", [1, 7, 9, 30, 300])
@pytest.mark.parametrize("at", [1, 2])
def test_any_number_of_adverts_between_lines(n, at):
    lines = lay(ITEM[:15])
    lines[at:at] = [f"MILLER'S TEA no. {k}" if k % 2 else "3/6. for sale" for k in range(n)]
    assert leaks(lines) == {1: 15}
    boxes = [100] * len(lines), list(range(len(lines)))
    assert leaks(lines, *boxes) == {1: 15}


def test_a_word_broken_around_adverts():
    lines = [" ".join(ITEM[:7]) + " " + ITEM[7][:4] + "-", *["MILLER'S TEA"] * 12, ITEM[7][4:] + " " + " ".join(ITEM[8:15])]
    assert leaks(lines) == {1: 15}


def test_the_end_of_a_passage_that_another_item_goes_on_with():
    items = [(1, " ".join(ITEM)), (2, " ".join(OTHER[:5] + ITEM[14:18] + ["the", "end"] + OTHER[5:20]))]
    got = [wrong(w) if k in (3, 6, 9, 12) else w for k, w in enumerate(ITEM[4:18])] + ["the", "other"]
    assert C.LeakFinder(C.Automaton.build(items)).leaks(" ".join(got), None, None) == {1: 14}


def test_misread_letters():
    for a, b, letters, same in (("of", "oi", 1, True), ("of", "f", 1, True), ("barn", "bam", 1, True), ("abc", "xbd", 1, False), ("abc", "xbd", 2, True), ("ab", "ba", 1, False), ("", "ab", 1, False), ("corner", "c0mer", 2, True), ("ab", "cd", 1, False)):
        assert C.misread(a, b, letters) == C.misread(b, a, letters) == same, (a, b)


def test_near_words_match_brute_force():
    r = random.Random(4)
    vocabulary = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(60)}
    v = C.Vocabulary(vocabulary)

    def one(a, b):
        return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))) and abs(len(a) - len(b)) == 1)

    for _ in range(300):
        read = "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
        assert set(v.near(read)) == {w for w in vocabulary if one(read, w)}, read


def test_repeated_text_builds_in_linear_space():
    a = C.Automaton.build([(1, " ".join(["so"] * 30_000)), (2, " ".join(["so", "it"] * 10_000))])
    assert len(a.flat) == 50_000
    assert C.LeakFinder(a).leaks(" ".join(["so"] * 14 + ["x"]), None, None) == {1: 14}


def test_spans_cover_the_passage_and_nothing_else():
    left, right = lay(ITEM[:20]), lay(text(20, 6))
    left.insert(2, "MILLER'S TEA")
    joined = [a + "    " + b for a, b in zip(left, [*right, "foot"], strict=True)]
    page = "\n".join(joined)
    spans, bad, total = finder().spans(page, [100] * 5, [10, 20, 30, 40, 50])
    assert [page[x:y] for _, x, y in spans] == [left[0], left[1], left[3], left[4]] and {i for i, _, _ in spans} == {1}
    assert (bad, total) == (20, 43)
    assert finder().spans("nothing here", None, None) == ([], 0, 2) and finder().spans(None, None, None) == ([], 0, 0)


def test_cut_leaks(spark):
    s = " ".join
    pad = text(40, 13)
    docs = [(1, s(pad + ITEM[:20] + pad), None, "x"), (2, s(ITEM[:30]), None, "x"), (3, None, None, "x"), (4, "", [], "x"), (None, s(pad + ITEM[:14]), None, "x"), (5, s(pad), None, "x"), (5, s(pad), None, "x")]
    d = spark.createDataFrame(docs, f"doc_id bigint, text string, lines {BOX}, pieces string")
    items = spark.createDataFrame([(1, s(ITEM)), (2, s(OTHER))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in C.cut_leaks(d, items).collect()}
    assert got[1]["text"].split() == pad + pad and got[1]["n_cut"] == len(s(ITEM[:20])) and abs(got[1]["coverage"] - 0.2) < 1e-9
    assert 2 not in got and got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"].split() == pad
    assert C.cut_leaks(d, items).filter("doc_id = 5").count() == 2
    assert C.cut_leaks(d, items, max_coverage=1.0).filter("doc_id = 2").first()["text"].strip() == ""
    assert rows(C.leak_spans(d.limit(0), items)) == []


def test_parts_find_what_one_automaton_finds(spark, monkeypatch):
    s = " ".join
    all_items = [(k, s(text(30, 300 + k))) for k in range(12)]
    d = spark.createDataFrame([(k, s(text(9, 7) + text(30, 300 + k % 12)[5:25]), None) for k in range(20)], f"doc_id bigint, text string, lines {BOX}")
    items = spark.createDataFrame(all_items, "item_id bigint, text string")
    whole = rows(C.leaked_items(d, items))
    assert len(whole) >= 20
    monkeypatch.setattr(C, "MAX_ITEM_WORDS", 100)
    assert rows(C.leaked_items(d, items)) == whole
