"""Evaluation texts leaking into training text (problem 6).

A generalised suffix automaton is built over the words of all test items. The
words of a page, in reading order, are streamed through it; the state knows
the longest suffix of what was read that stands in some item. A word that the
items do not continue with is looked up among the item words one misread
letter away, by the words they share without one letter, so that the number of
possible next words does not matter. Where a match ends it is followed leftward
with the same tolerance. At the end of a line a match is kept open, so that it
goes on behind adverts, and with the two halves of a broken word put together.
A match that reaches ``min_words`` is a leak.

The words of a leak are known by their place on the page: ``leak_spans`` gives
the character ranges and ``cut_leaks`` takes them out of the text, or drops the
page where they cover too much of it.

Items of more than ``MAX_ITEM_WORDS`` words are built in parts, one automaton
after the other, so that neither the driver nor a task holds more than one.
Pages are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.pages import columns, lists, placed_pieces
from graphlake.storage import Rounds

MIN_WORDS = 14
#: Words of a match from which it is followed both ways, and a word is misread although it is a word of the items.
SEED = 3
#: Letters of a word that a single misread letter leaves hardly recognisable: it counts as misread only where a match is open.
SHORT = 2
#: Letters of a word of which two may be misread.
LONG = 7
#: Words of test items built into one automaton: about half a kilobyte each.
MAX_ITEM_WORDS = 400_000
#: Lines after which a match goes on only with ``SEED`` words at once (or all words of a line); there is no line after which it ends.
PATIENCE = 8
#: The same where boxes are missing and lines of other columns stand in between.
PATIENCE_NO_BOXES = 24
#: Share of the words of a page in leaks above which the page is dropped and not cut.
MAX_COVERAGE = 0.5

_OTHER = re.compile(r"[\W_]+")
_BLANK = re.compile(r"\S+")
#: Letters read and letters meant, of one misread letter.
_ONE = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2))


def words(line: str) -> list[str]:
    """Folded words: what stands between blanks, letters and digits only, lower case."""
    return [w for w in (_OTHER.sub("", x) for x in line.lower().split()) if w]


def misread(a: str, b: str, letters: int) -> bool:
    """Whether up to so many (two at most) misread letters make the two equal: a letter missing, put in, changed or read as two, or two as one.

    Two side by side are three letters for two at most.
    """
    if a == b:
        return True
    n, m = len(a), len(b)
    if not letters or abs(n - m) > letters:
        return False
    i, most = 0, min(n, m)
    while i < most and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    n, m = len(a), len(b)
    if letters == 1:
        return (n, m) in _ONE
    if n <= 3 and m <= 3:
        return n + m <= 5 or a[1] == b[1]
    return any(misread(a[x:], b[y:], letters - 1) for x, y in _ONE if x <= n and y <= m)


class Vocabulary:
    """The words of the items, found by what is read for them; remembers what it decided."""

    def __init__(self, item_words: set[str]):
        self.words = item_words
        self.longest = max(map(len, item_words), default=0)
        self.cut: dict[str, list[str]] = {}
        for w in sorted(item_words):
            for short in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                self.cut.setdefault(short, []).append(w)
        self.found: dict[str, tuple[str, ...]] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def near(self, read: str) -> tuple[str, ...]:
        """All other item words that one letter put in, left out or changed turns into what was read."""
        got = self.found.get(read)
        if got is None:
            if len(self.found) > 500_000:
                self.found.clear()
            got = self.found[read] = self._near(read) if len(read) <= self.longest + 1 else ()
        return got

    def _near(self, read: str) -> tuple[str, ...]:
        cut, n = self.cut, len(read)
        out = dict.fromkeys(cut.get(read, ()))
        for i in range(n):
            rest = read[i + 1 :]
            for w in cut.get(read[:i] + rest, ()):
                # the word without that letter, or with another one in its place
                if len(w) < n or len(w) == n and w[i + 1 :] == rest and w[:i] == read[:i]:
                    out[w] = None
        out.pop(read, None)
        return tuple(out)

    def like(self, read: str, word: str) -> bool:
        """Whether a read word can be the given item word."""
        if read == word:
            return True
        if abs(len(read) - len(word)) > 2 or read[0] != word[0] and read[-1] != word[-1] and len(word) > 1:
            return False  # one edge of a word at least is read right
        key = (read, word)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[key] = word in self.near(read) if len(word) <= SHORT else misread(read, word, 2 if len(word) >= LONG else 1)
        return got


class Automaton:
    """Generalised suffix automaton over the word sequences of the items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.nxt: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(items):
            last = 0
            for pos, w in enumerate(ws):
                last = self._extend(last, w)
                own.setdefault(last, []).append((k, pos))
        self._order_ends(own)

    @classmethod
    def build(cls, items: Sequence[tuple[int, str]]) -> Automaton:
        return cls([(i, words(t or "")) for i, t in items])

    def _order_ends(self, own: dict[int, list[tuple[int, int]]]) -> None:
        """An end belongs to all shorter states on its suffix path: one list in the order of the tree, a range of it a state."""
        below: list[list[int]] = [[] for _ in self.size]
        for s in range(1, len(self.size)):
            below[self.link[s]].append(s)
        self.flat: list[tuple[int, int]] = []
        self.lo, self.hi = [0] * len(self.size), [0] * len(self.size)
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                self.hi[s] = len(self.flat)
                continue
            self.lo[s] = len(self.flat)
            self.flat.extend(own.get(s, ()))
            stack.append((s, True))
            stack.extend((c, False) for c in below[s])

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(item, position) of every place where the words of the state end."""
        return self.flat[self.lo[state] : self.hi[state]]

    def _new(self, size: int, nxt: dict[str, int], link: int) -> int:
        self.size.append(size)
        self.nxt.append(nxt)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        """A state for the shorter words of q that are reached from p."""
        c = self._new(self.size[p] + 1, dict(self.nxt[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.nxt[p].get(w) == q:
            self.nxt[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.nxt[last].get(w)
        if q is not None:  # the words up to here stand in an earlier item
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        cur, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.nxt[p]:
            self.nxt[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.nxt[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return cur


class _Page:
    """The words of a page in reading order, and where its lines begin."""

    def __init__(self, near):
        self.words: list[str] = []
        self.heads: list[int] = []  # index of the first word of each line
        self.is_head: set[int] = set()
        self._near = near
        self.jumps: dict[tuple[int, int, int], int] = {}  # words found leftward from the foot of a line
        self._feet: dict[str, list[int]] | None = None

    def feet(self, word: str) -> list[int]:
        """Indexes of the last words of lines that can be read as the word."""
        if self._feet is None:
            self._feet = {}
            for i in [h - 1 for h in self.heads[1:]]:
                for w in (self.words[i], *self._near(self.words[i])):
                    self._feet.setdefault(w, []).append(i)
        return self._feet.get(word, [])


class _Older:
    """Matches open since further up than patience goes, by the words they can go on with."""

    def __init__(self, nxt: list[dict[str, int]]):
        self.nxt = nxt
        self.any = False
        self.expect: dict[str, dict[int, tuple]] = {}
        self.broken: list[tuple] = []
        self.seen: set[tuple[int, str]] = set()

    def add(self, held: tuple) -> None:
        line, match, last, before = held
        if match[1] >= SEED:
            self.any = True
            for w in self.nxt[match[0]]:
                at = self.expect.setdefault(w, {})
                if match[0] not in at or at[match[0]][1][1] <= match[1]:
                    at[match[0]] = (line, match)
        if before[1] >= SEED and (before[0], last) not in self.seen:
            self.seen.add((before[0], last))
            for w in self.nxt[before[0]]:
                if len(w) > len(last) and misread(w[: len(last)], last, 1):
                    self.any = True
                    self.broken.append((last, w, before))

    def with_word(self, word: str) -> Sequence[tuple]:
        got = self.expect.get(word)
        return list(got.values()) if got else ()


class LeakFinder:
    """Streams pages through the automaton."""

    def __init__(self, automaton: Automaton, min_words: int = MIN_WORDS):
        self.a = automaton
        self.min = min_words
        self.v = Vocabulary({w for _, ws in automaton.items for w in ws})
        self.folded: dict[str, str] = {}
        self.places = [h - x for h, x in zip(automaton.hi, automaton.lo, strict=True)]
        self.shared = self._shared()

    def _shared(self) -> set[int]:
        """States with a suffix, long enough to be a leak, that stands in further places."""
        a, out = self.a, set()
        for s in sorted(range(1, len(a.size)), key=lambda x: a.size[x]):
            up = a.link[s]
            if up > 0 and (a.size[up] >= self.min and self.places[up] > self.places[s] or up in out):
                out.add(s)
        return out

    def _fold(self, line: str) -> list[str]:
        """``words`` of a line, remembering the words of earlier lines."""
        known, out = self.folded, []
        for x in line.split():
            w = known.get(x)
            if w is None:
                if len(known) > 500_000:
                    known.clear()
                w = known[x] = _OTHER.sub("", x.lower())
            if w:
                out.append(w)
        return out

    def _misread(self, state: int, size: int, read: str, short: bool = True) -> int:
        """The state behind the next word of the match that can be read like this, or 0."""
        if not size or size < SEED and read in self.v.words:
            return 0
        nxt, least_like = self.a.nxt[state], 0
        for w in self.v.near(read):
            to = nxt.get(w)
            if to is not None:
                if len(w) > SHORT:
                    return to
                if short and size >= SEED and not least_like:
                    least_like = to
        if least_like:
            return least_like
        if size >= SEED and read not in self.v.words:
            first, last = read[0], read[-1]
            for w, to in nxt.items():
                if len(w) > SHORT and (w[0] == first or w[-1] == last) and self.v.like(read, w):
                    return to
        return 0

    def _step(self, state: int, size: int, read: str, short: bool = True) -> tuple[int, int]:
        """The match after one more word if it continues, else (0, 0); ``short`` takes misread short words too."""
        to = self.a.nxt[state].get(read) or self._misread(state, size, read, short)
        return (to, size + 1) if to else (0, 0)

    def _restart(self, state: int, read: str) -> tuple[int, int]:
        """The longest suffix of the match that the word continues, read exactly."""
        link, nxt, size = self.a.link, self.a.nxt, self.a.size
        s = link[state] if state else -1
        while s >= 0:
            to = nxt[s].get(read)
            if to is not None:
                return to, size[s] + 1
            s = link[s]
        return 0, 0

    def _goes_on(self, state: int, size: int, ws: list[str]) -> bool:
        """Whether the first words of a line continue a match, so many of them that it is no chance."""
        for w in ws[:SEED]:
            state, size = self._step(state, size, w)
            if not size:
                return False
        return True

    def _taken(self, held: list[tuple], older: _Older, ws: list[str], n_line: int) -> tuple[int, int, int] | None:
        """State, size and start behind the first word of a line, of the open match that goes on with it.

        Held are (line, (state, size, start), last word, (state, size, start) before that word).
        """
        nxt, first, v = self.a.nxt, ws[0], self.v
        best, rank = None, (0, 0)
        # a match that goes on with the very word comes before one that goes on with a likeness
        for line, (state, size, start), _, _ in held:
            if (size, line) > rank and first in nxt[state]:
                best, rank = (nxt[state][first], size + 1, start), (size, line)
        for line, (state, size, start) in older.with_word(first):
            if (size, line) > rank and first in nxt[state] and self._goes_on(state, size, ws):
                best, rank = (nxt[state][first], size + 1, start), (size, line)
        if best and best[1] > 1:
            return best
        like = v.near(first)
        by_size = sorted(held, key=lambda h: (-h[1][1], -h[0])) if len(held) > 1 else held
        if like and len(ws) > 1 and any(len(w) <= SHORT for w in like):
            # many lines begin with a word that is like a short one: the next word decides
            for _, (state, size, start), _, _ in by_size:
                if size >= SEED:
                    s, n = self._step(state, size, first)
                    if n and self._step(s, n, ws[1], False)[1]:
                        return s, n, start
        # the last word of that line and the first of this one may be one word
        for _, _, last, (before, fewer, begun) in reversed(held):
            if fewer and last + first in nxt[before]:
                return nxt[before][last + first], fewer + 1, begun
        half = first not in v.words
        for line, (state, size, start), last, (before, fewer, begun) in by_size:
            if size and (like or line == n_line - 1):
                to = self._misread(state, size, first, False)
                if to:
                    return to, size + 1, start
            if fewer >= SEED and (half or last not in v.words):
                for w, to in nxt[before].items():
                    if len(w) > len(last) and w[0] == last[0] and misread(last + first, w, 1):
                        return to, fewer + 1, begun
        for w in like:
            for _, (state, size, start) in older.with_word(w):
                if w in nxt[state] and self._goes_on(state, size, ws):
                    return nxt[state][w], size + 1, start
        for last, word, (before, fewer, begun) in older.broken:
            if misread(last + first, word, 1):
                to = nxt[before][word]
                if self._goes_on(to, fewer + 1, ws[1:]):
                    return to, fewer + 1, begun
        for line, (state, size, start), _, _ in by_size:
            if size >= SEED and line == n_line - 1:
                s, n = self._step(state, size, first)
                if n:
                    return s, n, start
        return None

    def _stream(self, cols: Sequence[Sequence[str]], patience: int) -> tuple[_Page, list[tuple[int, int, int, int]]]:
        """The page, and (state, size, first word, last word) of the matches to follow."""
        a = self.a
        nxt, link, sizes, places, shared, least = a.nxt, a.link, a.size, self.places, self.shared, min(SEED, self.min)
        known, near = self.v.words, self.v.near
        page = _Page(near)
        toks = page.words
        held: list[tuple] = []
        older = _Older(nxt)
        out: list[tuple[int, int, int, int]] = []
        told: set[int] = set()
        n_line = 0
        for col in cols:
            for line in col:
                ws = self._fold(line)
                if not ws:
                    continue
                n_line += 1
                page.heads.append(len(toks))
                state = size = start = p_state = p_size = p_start = 0
                taken = None
                if held:
                    while held and n_line - held[0][0] > patience:
                        older.add(held.pop(0))
                    taken = self._taken(held, older, ws, n_line)
                elif older.any:
                    taken = self._taken(held, older, ws, n_line)
                if taken:
                    state, size, start = taken
                    toks.append(ws[0])  # the match stays open: this line may only look like its next one
                    del ws[0]
                for w in ws:
                    p_state, p_size, p_start = state, size, start
                    to = nxt[state].get(w)
                    if to is None and size:
                        to = self._misread(state, size, w) or None
                    if to is not None:
                        # places that do not go on are lost to the longer match
                        if size >= least and places[to] < places[state] and state not in told:
                            out.append((state, size, start, len(toks) - 1))
                        state = to
                        size += 1
                    else:
                        if size >= least:
                            out.append((state, size, start, len(toks) - 1))
                        s = link[state] if state else -1
                        state = size = 0
                        while s >= 0:
                            to = nxt[s].get(w)
                            if to is not None:
                                state, size = to, sizes[s] + 1
                                break
                            s = link[s]
                        if not size and w not in known:
                            for x in near(w)[:1]:  # a passage may begin with a misread word
                                state, size = nxt[0][x], 1
                        start = len(toks) - size + 1
                    toks.append(w)
                    if size >= self.min and state in shared and state not in told:
                        told.add(state)
                        out.append((state, size, start, len(toks) - 1))
                if size >= least:
                    out.append((state, size, start, len(toks) - 1))
                if size or p_size:
                    held.append((n_line, (state, size, start), toks[-1], (p_state, p_size, p_start)))
        page.is_head = set(page.heads)
        return page, out

    def runs(self, cols: Sequence[Sequence[str]], patience: int = PATIENCE) -> Iterator[tuple[int, int, int, int, _Page]]:
        """(item index, position of its last word, words, index of the last word read, page) of every match that may be long enough."""
        page, out = self._stream(cols, patience)
        a = self.a
        seen: set[tuple[int, int, int]] = set()
        for state, size, start, last in out:
            left: int | None = start
            while state > 0 and size >= min(SEED, self.min):
                for at in range(a.lo[state], a.hi[state]):
                    item, end = a.flat[at]
                    if end + 1 < self.min or (at, last, size) in seen:
                        continue
                    seen.add((at, last, size))
                    ws = a.items[item][1]
                    if left is not None:
                        n = size + self._leftward(ws, end - size, page, left - 1, size)
                    else:
                        n = self._leftward(ws, end, page, last, 0)
                    if n >= self.min:
                        yield item, end, n, last, page
                # the same words, fewer of them, may stand in further items
                state = a.link[state]
                size, left = min(size, a.size[state]), None

    def _leftward(self, item: list[str], at: int, page: _Page, i: int, have: int, path: list[int] | None = None) -> int:
        """How many words of the item up to ``at`` stand before and at word ``i`` of the page; ``path`` gets their indexes.

        A word may be misread or broken over two lines. At the head of a line the
        passage goes on at the foot of the line before, or of any line further
        up if at least ``SEED`` words stand there.
        """
        toks, heads, like = page.words, page.is_head, self.v.like
        n = 0
        crossed: tuple[int, int, int] | None = (at, i, 0) if i + 1 in heads else None
        while at >= 0 and i >= 0:
            if like(toks[i], item[at]):
                if path is not None:
                    path.append(i)
                i -= 1
            elif i > 0 and i in heads and like(toks[i - 1] + toks[i], item[at]):
                if path is not None:
                    path += [i, i - 1]
                i -= 2
                crossed = None
            else:
                break
            n, at = n + 1, at - 1
            if i + 1 in heads:
                crossed = (at, i, n)
        if crossed and n - crossed[2] < SEED <= have + crossed[2] and have + crossed[2] + crossed[0] + 1 >= self.min:
            at, i, before = crossed
            best, where = n - before, None
            if at >= 0:
                for j in page.feet(item[at]):
                    if j >= i:
                        break
                    key = (id(item), at, j)
                    r = page.jumps.get(key)
                    if r is None:
                        page.jumps[key] = 0  # no passage goes through the same place twice
                        r = page.jumps[key] = self._leftward(item, at, page, j, have + before)
                    if r >= max(SEED, best):
                        best, where = r, j
            if where is not None:
                if path is not None:
                    del path[len(path) - (n - before) :]
                    self._leftward(item, at, page, where, have + before, path)
                return before + best
        return n

    def _boxed(self, lines: Sequence[str], x0: Sequence[int] | None) -> int:
        return PATIENCE if x0 is not None and len(x0) == len(lines) else PATIENCE_NO_BOXES

    def leaks(self, text: str | None, x0: Sequence[int] | None, y0: Sequence[int] | None) -> dict[int, int]:
        """Item id to the words of its longest passage on the page, of at least ``min_words``."""
        if not text:
            return {}
        lines = text.split("\n")
        found: dict[int, int] = {}
        for item, _, n, _, _ in self.runs(columns(lines, x0, y0), self._boxed(lines, x0)):
            key = self.a.items[item][0]
            found[key] = max(n, found.get(key, 0))
        return found

    def spans(self, text: str | None, x0: Sequence[int] | None, y0: Sequence[int] | None) -> tuple[list[tuple[int, int, int]], int, int]:
        """(item id, start, end) of the pieces of text that leak, end not included; words that leak; words of the page."""
        if not text:
            return [], 0, 0
        lines = text.split("\n")
        page, read = None, {}
        for item, end, n, last, page in self.runs(columns(lines, x0, y0), self._boxed(lines, x0)):  # noqa: B007
            path: list[int] = []
            self._leftward(self.a.items[item][1], end, page, last, SEED, path)
            read.setdefault(item, set()).update(path)
        if page is None:
            return [], 0, sum(len(self._fold(x)) for x in lines)
        begins, at = [], 0
        for line in lines:
            begins.append(at)
            at += len(line) + 1
        # character ranges of all words in the same order
        chars = [(begins[k] + start + m.start(), begins[k] + start + m.end()) for col in columns(range(len(lines)), x0, y0, lambda k: placed_pieces(k, lines[k])) for k, start, piece in col for m in _BLANK.finditer(piece) if _OTHER.sub("", m.group().lower())]
        out = []
        for item, where in sorted(read.items()):
            run: list[int] = []
            for i in [*sorted(where), -1]:
                line = bisect_right(page.heads, i)
                if run and (i != run[1] + 1 or line != run[2]):
                    out.append((self.a.items[item][0], chars[run[0]][0], chars[run[1]][1]))
                    run = []
                if i >= 0:
                    run = [run[0] if run else i, i, line]
        return out, len(set().union(*read.values())), len(page.words)


def _pages(documents: DataFrame, doc_id: str, text: str, lines: str | None) -> DataFrame:
    none = F.lit(None).cast("array<int>")
    boxes = [F.col(f"{lines}.{c}").cast("array<int>") if lines else none for c in ("x0", "y0")]
    return documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t"), boxes[0].alias("x0"), boxes[1].alias("y0"))


def _read(b: pa.RecordBatch) -> Iterator[tuple]:
    ids, texts, x0, y0 = b.column(0).to_pylist(), b.column(1).to_pylist(), lists(b.column(2)), lists(b.column(3))
    return ((ids[k], text, x0(k), y0(k)) for k, text in enumerate(texts))


def _leak_batches(automaton: Automaton, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = LeakFinder(automaton, min_words)
        for b in batches:
            rows = [(d, item, n) for d, t, x0, y0 in _read(b) for item, n in finder.leaks(t, x0, y0).items()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_words"])

    return run


def _span_batches(automaton: Automaton, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = LeakFinder(automaton, min_words)
        for b in batches:
            rows = []
            for d, t, x0, y0 in _read(b):
                spans, bad, total = finder.spans(t, x0, y0)
                rows += [(d, item, start, end, bad, total) for item, start, end in spans]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "item_id", "start", "end", "leaked_words", "page_words"])

    return run


def _parts(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """(i, t, part) of the items with a text, and the number of parts of at most ``MAX_ITEM_WORDS`` words."""
    held_out = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    size = F.size(F.split("t", r"\s+"))
    total, largest = held_out.agg(F.sum(size), F.max(size)).first()
    if (largest or 0) > MAX_ITEM_WORDS:
        raise ValueError(f"an item of {largest} words; one automaton holds {MAX_ITEM_WORDS}")
    n = -(-(total or 0) // MAX_ITEM_WORDS)
    while True:
        parts = held_out.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1))).cast("int"))
        if n < 2 or not parts.groupBy("part").agg(F.sum(size).alias("n")).filter(F.col("n") > MAX_ITEM_WORDS).count():
            return parts, max(n, 1)
        n *= 2


def _over_parts(items: DataFrame, item_id: str, item_text: str, run) -> DataFrame:
    """The rows of ``run(automaton)`` for each part of the items; of several, each is written before the next is built."""
    parts, n = _parts(items, item_id, item_text)
    build = lambda df: Automaton.build(sorted((r["i"], r["t"]) for r in df.select("i", "t").collect()))
    if n == 1:
        return run(build(parts))
    store = Rounds(items.sparkSession, "leaks")
    parts, _ = store.write(parts)
    out = None
    for k in range(n):
        found, _ = store.write(run(build(parts.filter(F.col("part") == k))))
        out = found if out is None else out.unionAll(found)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", lines: str | None = "lines", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words): pages with a passage of an item of at least ``min_words`` consecutive words.

    A null or empty page has no leaks, a null item or one of fewer than
    ``min_words`` words leaks nowhere. ``lines`` gives the boxes that tell the
    reading order of several columns; a page without boxes, or with another
    number of boxes than lines, is read with more patience instead. Repeated
    passages of an item on a page give one row with the longest; a repeated
    page id gives its rows once for each page. Only the named columns are read.
    A single item of more than ``MAX_ITEM_WORDS`` words is refused.
    """
    pages = _pages(documents, doc_id, text, lines)
    return _over_parts(items, item_id, item_text, lambda a: pages.mapInArrow(_leak_batches(a, min_words), "doc_id bigint, item_id bigint, n_words int"))


def leak_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", lines: str | None = "lines", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, leaked_words, page_words): the pieces of the text that leak, from character start to end, end not included.

    One row a piece: a passage is cut by the ends of its lines, by adverts and by
    other columns. ``leaked_words`` counts the words of the page in leaks of any
    item of the part. Nulls, empty and repeated pages as in ``leaked_items``.
    """
    pages = _pages(documents, doc_id, text, lines)
    kind = '`doc_id` bigint, `item_id` bigint, `start` int, `end` int, leaked_words int, page_words int'
    return _over_parts(items, item_id, item_text, lambda a: pages.mapInArrow(_span_batches(a, min_words), kind))


def cut_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, doc_id: str = "doc_id", text: str = "text", lines: str | None = "lines", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text, n_cut, coverage): the pages without the pieces that leak; ``n_cut`` characters are gone.

    ``coverage`` is the share of the words in leaks; pages above
    ``max_coverage`` are dropped. A page without leaks, null and empty ones
    included, is kept as it is. Only the leaking pages have rows to be joined
    to the others, by page id and hash of the text; a page that comes twice
    is kept twice.
    """
    # pages of one id may have different texts
    page = F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    pages = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), page.alias("page"), *([F.col(lines).alias("lines")] if lines else []))
    spans = leak_spans(pages, items, min_words, doc_id="page", lines="lines" if lines else None, item_id=item_id, item_text=item_text)
    piece = F.struct("start", "end", "leaked_words", "page_words")
    found = spans.groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_set(piece)).alias("pieces"))
    joined = pages.select("doc_id", "text", "page").join(found, F.col("page") == F.col("d"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, pieces in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not pieces:
                    rows.append((d, t, 0, 0.0))
                    continue
                kept, at = [], 0
                for p in pieces:
                    kept.append(t[at : max(at, p["start"])])
                    at = max(at, p["end"])
                left = "".join(kept) + t[at:]
                rows.append((d, left, len(t) - len(left), max(p["leaked_words"] for p in pieces) / max(p["page_words"] for p in pieces)))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "text", "n_cut", "coverage"])

    return joined.select("doc_id", "text", "pieces").mapInArrow(cut, "doc_id bigint, text string, n_cut int, coverage double").filter(F.col("coverage") <= max_coverage)


def remove_leaks(documents: DataFrame, leaks: DataFrame, min_items: int = 1, doc_id: str = "doc_id") -> DataFrame:
    """The documents without the pages that leak at least ``min_items`` items."""
    leaky = leaks.groupBy(doc_id).agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= min_items).select(doc_id)
    return documents.join(leaky, doc_id, "left_anti")
