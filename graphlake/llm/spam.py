"""Keyword-stuffed and link-list pages (problem 8).

An n-gram model over function words and word classes is trained on clean
prose. Each page is read through it word by word, and the perplexity of each
stretch is compared with that of prose: a stretch beyond the highest or the
lowest perplexity that prose shows is abnormal. A page is spam if more than
half of its words stand in abnormal stretches.

Everything the verdict rests on is learned from the prose:

* function words are the lower-case words that surely stand in a good part of
  the prose of their language and follow many others; they keep their identity, all other words are
  known by their class;
* the class of a content word tells its case and how many lower-case content
  words came since the last function word or full stop, since sentences never
  put many of them in a row and lists of keywords do;
* short words are one class; one that the prose does not know belongs to it at
  the head of a phrase and is content elsewhere; words with several marks
  inside them are a class that prose lacks;
* figures end a phrase as a full stop does and are not scored themselves, and a
  capital behind a mark is no evidence, so that columns of times, prices,
  scores and names are short capitalised phrases;
* the range of perplexity of prose, with some of its words in pieces as on
  scanned pages, gives both thresholds.

The stretches are found by the best path through three states (normal, too
surprising, too predictable) whose changes cost ``CHANGE`` bits. The model has
a few thousand entries whatever the corpus; pages are scored where they are,
without a shuffle. It is learned from the whole prose: the driver reads a small
one itself, a large one is counted where it lies, with the same result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.pages import columns, lists
from graphlake.storage import Rounds

#: Words of prose that the driver reads itself, about; more are counted by tasks. All prose is read either way.
MAX_PROSE_WORDS = 5_000_000
#: Window means of prose that are told apart at once when a threshold is looked for among more.
MAX_MEANS = 1 << 16
#: Share of a page's words in abnormal stretches above which it is spam.
MIN_SHARE = 0.5
#: Words over which the perplexity of prose is averaged to find its range.
WINDOW = 21
#: The range of prose is taken from the prose with one word in so many in pieces, since pages are scanned.
DAMAGE = 12
#: Share of prose windows on either side that may lie outside of the range.
TAIL = 1e-3
#: Bits that a change between normal and abnormal must gain.
CHANGE = 10.0
#: Bits that a single word adds at most.
MOST_BITS = 12.0
#: Share of the pieces of ``PIECE`` words of its language that a function word stands in, at the lower end of its confidence range.
FUNCTION_SHARE = 0.2
PIECE = 65
#: Letters of a short word.
SHORT = 3
#: Lower-case content words in a row that are told apart.
MAX_ROW = 10

_SKIP, _FIGURE, _STRANGE, _SHORT, _NEW_SHORT, _LOWER, _UPPER, _FIRST_WORD = range(8)
_STOPS = ".!?"
#: Added to the symbol of a word that is no evidence: a capitalised one behind a mark, as phrases and the entries of lists begin.
_CAPITAL = 1 << 20


def bare(token: str) -> str:
    """The token without the marks around it."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


class _Bare(dict):
    """``bare`` of tokens, each worked out once."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        got = self[token] = bare(token)
        return got


def _surely(n: int, of: int) -> float:
    """Lower end of the range of a share seen n times in so many, two deviations wide."""
    p, z = n / of, 4.0 / of
    return (p + z / 2 - 2 * math.sqrt((p * (1 - p) + z / 4) / of)) / (1 + z)


def piece_words(tokens: Sequence[str]) -> Iterator[set[str]]:
    """The lower-case words of each piece of a text."""
    for at in range(0, len(tokens), PIECE):
        if at and len(tokens) - at < PIECE // 2:
            break  # what is left over says too little
        yield {t for t in tokens[at : at + PIECE] if t[:1].islower()}


def function_words(texts: Sequence[str], langs: Sequence[str | None]) -> set[str]:
    """Lower-case words that stand in a good part of the pieces of text of one language, behind ever other words."""
    seen: dict[str | None, Counter] = {}
    pieces, before, most = Counter(), Counter(), Counter()
    for text, lang in zip(texts, langs, strict=True):
        tokens = [bare(t) for t in text.split()]
        before.update(zip(["", *tokens], tokens, strict=False))
        for words in piece_words(tokens):
            pieces[lang] += 1
            seen.setdefault(lang, Counter()).update(words)
    often = {w for lang, words in seen.items() for w, n in words.items() if _surely(n, pieces[lang]) >= FUNCTION_SHARE}
    total: Counter = Counter()
    for (_, w), n in before.items():
        if w in often:
            total[w] += n
            most[w] = max(most[w], n)
    # a noun mostly follows its article
    return {w for w in often if most[w] <= total[w] / 2}


def short_words(tokens: Iterable[str]) -> set[str]:
    """The short words among bare tokens, in lower case."""
    return {t.lower() for t in tokens if len(t) <= SHORT and t.isalpha()}


def trigrams(s: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """Each symbol that is no break, behind the two before it; it may carry ``_CAPITAL``, those before it do not."""
    x = y = 0
    for z in s:
        if z:  # breaks are context and never predicted
            yield x, y, z
            z %= _CAPITAL
        elif not y:
            continue
        x, y = y, z


class ProseModel:
    """Interpolated trigrams over function words and word classes, with the range of perplexity of prose."""

    def __init__(self, texts: Sequence[str], langs: Sequence[str | None] | None = None):
        """``texts`` are clean prose; ``langs`` their languages, without which they count as one."""
        texts = list(texts)
        self.know(function_words(texts, langs or [None] * len(texts)), {w for t in texts for w in short_words(map(bare, t.split()))})
        counts: Counter = Counter()
        for text in texts:
            counts.update(trigrams(self.symbols(text.split())))
        self.learn(counts)
        means = [m for text in texts for m in self.means(text)]
        # without prose there is no range, and nothing is outside of it
        self.low, self.high = (float(q) for q in np.quantile(means, [TAIL, 1 - TAIL])) if means else (-math.inf, math.inf)

    def know(self, common: Iterable[str], short: set[str]) -> None:
        """Take these function words and short words, and forget all else."""
        common = sorted(common)
        self.word = {w: _FIRST_WORD + i for i, w in enumerate(common)}
        self.short = short
        #: symbols: 0 is a break, then the classes and words, then the rows
        self.row = _FIRST_WORD + len(common)
        self.k = self.row + 2 * (MAX_ROW + 1)
        self.cache: dict[str, tuple[int, bool]] = {}
        self.known: dict[int, float] = {}

    def learn(self, counts: dict[tuple[int, int, int], int]) -> None:
        """Take the counts of the ``trigrams`` of the prose."""
        self.uni, self.follow, self.after, self.kinds = Counter(), Counter(), Counter(), Counter()
        for (x, y, z), n in counts.items():
            z %= _CAPITAL
            self.uni[z] += n
            for ctx, seq in ((y, (y, z)), ((x, y), (x, y, z))):
                self.kinds[ctx] += not self.follow[seq]
                self.follow[seq] += n
                self.after[ctx] += n
        self.total = sum(self.uni.values())
        # a capitalised word behind a mark is no evidence: it counts as much as the mean word
        plain = {s: n for s, n in counts.items() if s[2] < _CAPITAL}
        bits = math.fsum(n * min(self._bits(*s), MOST_BITS) for s, n in plain.items())
        self.opening = bits / sum(plain.values()) if plain else 0.0

    def means(self, text: str) -> np.ndarray:
        """The mean bits of each window of a text of prose, as if it were scanned."""
        return _windows(self.surprisals(self.symbols(scanned(text.split()))))

    def classify(self, token: str) -> tuple[int, bool]:
        """(class or function word, whether a phrase ends behind it)."""
        b = bare(token)
        if not b:
            return _SKIP, False
        digits, letters = sum(c.isdigit() for c in b), sum(c.isalpha() for c in b)
        if digits >= letters:
            return _FIGURE, True
        stop = token[-1] in _STOPS
        low = b.lower()
        if len(b) <= SHORT and letters == len(b):
            return (_SHORT if low in self.short else _NEW_SHORT), stop
        known = self.word.get(low)
        if known is not None:
            return known, stop
        if len(b) - digits - letters > 1:
            return _STRANGE, stop
        return (_UPPER if b[0].isupper() else _LOWER), stop

    def symbols(self, tokens: Sequence[str]) -> list[int]:
        """The sequence the model sees; 0 is a break between phrases.

        A capitalised word behind any mark carries ``_CAPITAL``.
        """
        out, row, cache, first, rows = [], 0, self.cache, _FIRST_WORD, self.row
        marked = True
        for t in tokens:
            got = cache.get(t)
            if got is None:
                if len(cache) > 300_000:
                    cache.clear()
                got = cache[t] = self.classify(t)
            c, stop = got
            if c == _NEW_SHORT:
                if not out or not out[-1]:  # at the head of a phrase it may be any function word
                    out.append(_SHORT + _CAPITAL)
                else:
                    c = _UPPER if t[0].isupper() else _LOWER
            if c == _LOWER:
                if row < MAX_ROW:
                    row += 1
                out.append(rows + 2 * row)
            elif c == _UPPER:
                out.append(rows + 2 * row + 1 + marked * _CAPITAL)
            elif c >= first or c == _SHORT:
                row = 0
                out.append(c + _CAPITAL if marked and t[0].isupper() else c)
            elif c == _STRANGE:
                out.append(c)
            if stop:
                row = 0
                out.append(0)
            marked = stop or not t[-1].isalnum()
        return out

    def surprisals(self, s: Sequence[int]) -> list[float]:
        """Bits of each symbol that is no break, given the two symbols before it."""
        out, k, known = [], self.k, self.known
        x = y = 0
        for z in s:
            if z:
                if z >= _CAPITAL:
                    z -= _CAPITAL
                    out.append(self.opening)
                    x, y = y, z
                    continue
                key = (x * k + y) * k + z
                bits = known.get(key)
                if bits is None:
                    bits = known[key] = min(self._bits(x, y, z), MOST_BITS)
                out.append(bits)
            elif not y:
                continue
            x, y = y, z
        return out

    def _bits(self, x: int, y: int, z: int) -> float:
        """Witten-Bell: a context counts as much as it has been seen, less for each kind of symbol it led to."""
        p = (self.uni[z] + 0.5) / (self.total + 0.5 * self.k)
        for ctx, seq in ((y, (y, z)), ((x, y), (x, y, z))):
            n, kinds = self.after[ctx], self.kinds[ctx]
            if n:
                p = (self.follow[seq] + kinds * p) / (n + kinds)
        return -math.log2(p)


def scanned(tokens: Sequence[str]) -> list[str]:
    """The words with every ``DAMAGE``-th of them in two pieces, as broken lines and misread blanks leave them."""
    out: list[str] = []
    for i, t in enumerate(tokens):
        half = len(t) // 2 if i % DAMAGE == DAMAGE - 1 else 0
        out += [t[:half], t[half:]] if half > 1 else [t]
    return out


def _windows(x: Sequence[float]) -> np.ndarray:
    """Means over all windows; none if there are fewer words than one window has."""
    if len(x) < WINDOW:
        return np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


def abnormal_words(bits: Sequence[float], low: float, high: float) -> int:
    """How many words lie in stretches with a perplexity above ``high`` or below ``low``, on the best path.

    Each state carries the gain of its best path and the abnormal words on it.
    """
    normal, above, below = 0.0, -CHANGE, -CHANGE
    n_normal = n_above = n_below = 0
    for v in bits:
        best, n = normal, n_normal
        if above > best:
            best, n = above, n_above
        if below > best:
            best, n = below, n_below
        best -= CHANGE
        if best > normal:
            normal, n_normal = best, n
        if best > above:
            above, n_above = best, n
        if best > below:
            below, n_below = best, n
        above += v - high
        below += low - v
        n_above += 1
        n_below += 1
    return max((normal, n_normal), (above, n_above), (below, n_below), key=lambda s: s[0])[1]


def spam_share(model: ProseModel, tokens: Sequence[str]) -> tuple[float, float]:
    """(share of words in abnormal stretches, mean bits a word); figures and marks are no words."""
    bits = model.surprisals(model.symbols(tokens))
    if not bits:
        return 0.0, 0.0
    return abnormal_words(bits, model.low, model.high) / len(bits), sum(bits) / len(bits)


def _score_batches(model: ProseModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, x0, y0 = b.column(1).to_pylist(), lists(b.column(2)), lists(b.column(3))
            scores = []
            for k, text in enumerate(texts):
                cols = columns(text.split("\n"), x0(k), y0(k)) if text else []
                scores.append(spam_share(model, " ".join([line for col in cols for line in col]).split()))
            share, bits = (pa.array([s[i] for s in scores], pa.float64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), share, bits], names=["doc_id", "spam_share", "mean_bits"])

    return run


def _counted(prose: DataFrame, keys: str, count: Callable[[Sequence[str], Sequence[str]], Counter]) -> DataFrame:
    """The keys and n: ``count`` of the texts and languages of each batch, added up over all prose; a key is a tuple."""
    names = [*(k.split()[0] for k in keys.split(", ")), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count(b.column(0).to_pylist(), b.column(1).to_pylist())
            cols = [*zip(*counts, strict=True)] if counts else [()] * (len(names) - 1)
            types = [pa.string() if k.endswith("string") else pa.int64() for k in keys.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(counts.values(), pa.int64())], names=names)

    return prose.mapInArrow(run, f"{keys}, n bigint").groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _count_pieces(texts: Sequence[str], langs: Sequence[str]) -> Counter:
    """(language, word): pieces it stands in; (language, ''): pieces; (None, word): short words."""
    seen: dict[str | None, Counter] = {None: Counter()}
    known = _Bare()
    for text, lang in zip(texts, langs, strict=True):
        tokens = [known[t] for t in text.split()]
        seen[None].update(short_words(tokens))
        words = seen.setdefault(lang, Counter())
        for piece in piece_words(tokens):
            words[""] += 1
            words.update(piece)
    return Counter({(lang, w): n for lang, words in seen.items() for w, n in words.items()})


def _count_before(often: set[str]):
    def count(texts: Sequence[str], langs: Sequence[str]) -> Counter:
        counts: Counter = Counter()
        known = _Bare()
        for text in texts:
            tokens = [known[t] for t in text.split()]
            counts.update((w, v) for v, w in zip(["", *tokens], tokens, strict=False) if w in often)
        return counts

    return count


def _count_trigrams(model: ProseModel):
    def count(texts: Sequence[str], langs: Sequence[str]) -> Counter:
        counts: Counter = Counter()
        for text in texts:
            counts.update(trigrams(model.symbols(text.split())))
        return counts

    return count


def _count_means(model: ProseModel, shift: int, within: set[int] | None, upper: int):
    """(key,): window means whose bits without the last ``shift`` are the key, of those that are ``within`` without the last ``upper``."""

    def count(texts: Sequence[str], langs: Sequence[str]) -> Counter:
        # the bits of doubles that are not negative are ordered as they are
        bits = np.concatenate([np.zeros(0), *map(model.means, texts)]).view(np.int64)
        if within is not None:
            bits = bits[np.isin(bits >> upper, list(within))]
        keys, n = np.unique(bits >> shift, return_counts=True)
        return Counter({(k,): m for k, m in zip(keys.tolist(), n.tolist(), strict=True)})

    return count


def _prose_range(prose: DataFrame, model: ProseModel) -> tuple[float, float]:
    """The same quantiles of all window means as in ``ProseModel``: their leading bits are counted, then those behind the ones looked for."""
    shift, upper, within = 40, 64, None
    ranks: list[tuple[int, int]] = []  # (leading bits, rank among the means that have them)
    parts: list[float] = []
    while True:
        tally = sorted((r["k"], r["n"]) for r in _counted(prose, "k bigint", _count_means(model, shift, within, upper)).collect())
        if within is None:
            total = sum(n for _, n in tally)
            if not total:
                return -math.inf, math.inf
            for at in ((total - 1) * TAIL, (total - 1) * (1 - TAIL)):
                parts.append(at - math.floor(at))
                ranks += [(0, math.floor(at)), (0, min(math.floor(at) + 1, total - 1))]
        found = []
        for lead, rank in ranks:
            for k, n in tally:
                if within is not None and k >> (upper - shift) != lead:
                    continue
                if rank < n:
                    found.append((k, rank))
                    break
                rank -= n
        ranks, within = found, {k for k, _ in found}
        if not shift:
            break
        upper, left = shift, sum(n for k, n in tally if k in within)
        shift = max(shift - 16, 0) if left > MAX_MEANS else 0
    low0, low1, high0, high1 = np.array([k for k, _ in ranks], np.int64).view(np.float64)
    return float(np.quantile([low0, low1], parts[0])), float(np.quantile([high0, high1], parts[1]))


def _model_of(prose: DataFrame) -> ProseModel:
    """The ``ProseModel`` of prose (t, l) of any size: only words of its own, class counts and thresholds come to the driver."""
    rounds = Rounds(prose.sparkSession, "prose")
    pieces, _ = rounds.write(_counted(prose, "l string, w string", _count_pieces))
    of = pieces.filter((F.col("w") == "") & F.col("l").isNotNull()).select("l", F.col("n").alias("of"))
    # the lower end of a share is not above the share
    words = pieces.filter(F.col("w") != "").join(of, "l").filter(F.col("n") >= FUNCTION_SHARE * F.col("of")).collect()
    often = {r["w"] for r in words if _surely(r["n"], r["of"]) >= FUNCTION_SHARE}
    short = {r["w"] for r in pieces.filter(F.col("l").isNull()).select("w").collect()}
    rounds.drop(pieces)
    before = _counted(prose, "w string, v string", _count_before(often)).groupBy("w").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    model = ProseModel(())
    model.know((r["w"] for r in before.collect() if r["most"] <= r["total"] / 2), short)
    model.learn({(r["x"], r["y"], r["z"]): r["n"] for r in _counted(prose, "x bigint, y bigint, z bigint", _count_trigrams(model)).collect()})
    model.low, model.high = _prose_range(prose, model)
    return model


def spam_scores(documents: DataFrame, prose: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str | None = "lines", prose_text: str = "text", prose_lang: str | None = None) -> DataFrame:
    """(doc_id, spam_share, mean_bits): share of words in abnormal stretches and mean surprisal, one row per page.

    A null or empty text has share 0. ``lines`` gives the boxes for the
    reading order of columns; without them the lines are read as they stand.
    A repeated page id gives a row each time. Only the named columns are read.
    The prose may be any clean text; without it the model knows no sequence
    and every page looks alike, so that no page is spam. ``prose_lang`` tells
    the languages apart whose function words are learned. All prose is read:
    by the driver up to ``MAX_PROSE_WORDS`` words, else in some five passes of
    tasks that bring counts to it.
    """
    lang = F.col(prose_lang).cast("string") if prose_lang else F.lit(None).cast("string")
    clean = prose.select(F.col(prose_text).cast("string").alias("t"), F.coalesce(lang, F.lit("")).alias("l")).filter(F.col("t").isNotNull())
    total = clean.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    if total > MAX_PROSE_WORDS:
        model = _model_of(clean)
    else:
        texts = clean.collect()
        model = ProseModel([r["t"] for r in texts], [r["l"] for r in texts])
    none = F.lit(None).cast("array<int>")
    boxes = [F.col(f"{lines}.{c}").cast("array<int>") if lines else none for c in ("x0", "y0")]
    pages = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t"), boxes[0].alias("x0"), boxes[1].alias("y0"))
    return pages.mapInArrow(_score_batches(model), "doc_id bigint, spam_share double, mean_bits double")


def spam_pages(documents: DataFrame, prose: DataFrame, min_share: float = MIN_SHARE, **names) -> DataFrame:
    """(doc_id) of the pages of ``spam_scores`` that are spam: more than ``min_share`` of their words are abnormal."""
    return spam_scores(documents, prose, **names).filter(F.col("spam_share") > min_share).select("doc_id")
