"""Copies hidden by formatting (problem 2): case, blanks, punctuation and field order.

The text of a batch is streamed through a skip-and-fold table: a code point
maps to its folded code, or to 0 and is skipped. The codes that are left feed
rolling polynomial hashes, without any canonical string being built. Lines
with equal hashes are then compared with their smallest line by two pointers
that skip and fold as they go, so that a hash collision cannot merge records.

Three fields of a line, in any columns, are two vertex ids (the first letter
or digit is a letter) and a weight (it is a digit). Ids count by letters and
digits, ignoring case; weights by their value, of any length and with either
decimal mark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators import skew
from graphlake.storage import Rounds

# Two primes below 2**31, so that products fit 64 bits; bases are arbitrary odd constants.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(911382323), np.uint64(972663749))
_MARKS = (ord("."), ord(","))
_MINUS = (ord("-"), 0x2212)

_TABLE: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code per code point of the basic plane: lower case of letters and digits, 0 for all else."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            ch = chr(cp)
            if ch.isalpha() or unicodedata.category(ch)[0] == "N":
                low = ch.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _TABLE = t
    return _TABLE


def _fold_one(cp: int) -> int:
    if cp < 0x10000:
        return int(fold_table()[cp])
    ch = chr(cp)
    return ord(ch.lower()) if ch.isalpha() or unicodedata.category(ch)[0] == "N" else 0


class _Column:
    """The code points of one column of a batch, with the start of each row."""

    def __init__(self, col: pa.Array):
        col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
        rows = len(col)
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=rows + 1, offset=8 * col.offset) if rows else np.zeros(1, dtype=np.int64)
        data = col.buffers()[2]
        raw = bytes(data)[offs[0] : offs[-1]] if data is not None else b""
        lead = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80  # first bytes of code points
        at = np.concatenate([[0], np.cumsum(lead)])
        self.start = at[offs - offs[0]].astype(np.int64)
        self.cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        self.null = np.array(col.is_null()) if col.null_count else np.zeros(rows, dtype=bool)
        self.codes = self._fold()
        self.row = np.repeat(np.arange(rows), np.diff(self.start))

    def _fold(self) -> np.ndarray:
        high = self.cps >= 0x10000
        codes = fold_table()[np.where(high, 0, self.cps)]
        if high.any():
            odd, back = np.unique(self.cps[high], return_inverse=True)
            codes = codes.copy()
            codes[high] = np.array([_fold_one(int(c)) for c in odd], dtype=np.uint32)[back]
        return codes

    def first_kept(self) -> np.ndarray:
        """Code point of the first kept position of each row, 0 if there is none."""
        out = np.zeros(len(self.start) - 1, dtype=np.uint32)
        kept = np.flatnonzero(self.codes)
        rows, at = np.unique(self.row[kept], return_index=True)
        out[rows] = self.cps[kept[at]]
        return out


def _poly(codes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of the codes of each row, by both primes: sum of code * base**position."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    pos = np.arange(len(codes)) - first[row]
    out = []
    for p, b in zip(_PRIMES, _BASES, strict=True):
        power = np.ones(int(n.max()) + 1 if rows and len(codes) else 1, dtype=np.uint64)
        for i in range(1, len(power)):
            power[i] = power[i - 1] * b % p
        term = codes.astype(np.uint64) * power[pos] % p
        # a hash is the sum over a row; sums of up to 2**32 terms fit 64 bits
        total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        end = first + n
        out.append((total[end] - total[first]) % p)
    return out[0], out[1]


def _mix(h: tuple[np.ndarray, np.ndarray], extra: np.ndarray) -> np.ndarray:
    """One 64-bit key of a field from its hashes and its length."""
    k = (h[0] << np.uint64(32)) | h[1]
    k ^= extra.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def _id_keys(c: _Column) -> np.ndarray:
    keep = c.codes != 0
    rows = len(c.start) - 1
    return _mix(_poly(c.codes[keep], c.row[keep], rows), np.bincount(c.row[keep], minlength=rows))


def _weight_keys(c: _Column) -> np.ndarray:
    """Keys of numbers: significant digits, place of the decimal mark and sign."""
    rows = len(c.start) - 1
    digit = (c.cps >= 48) & (c.cps <= 57)
    at = np.arange(len(c.cps))
    first = np.full(rows, len(c.cps))
    np.minimum.at(first, c.row[digit], at[digit])
    mark = np.isin(c.cps, _MARKS)
    # the mark is the one right before a digit; marks before the number do not precede its first digit by more than one place
    follows = np.zeros(len(c.cps), dtype=bool)
    follows[:-1] = digit[1:] & (c.row[:-1] == c.row[1:])
    dec = np.full(rows, len(c.cps))
    ok = mark & follows
    np.minimum.at(dec, c.row[ok], at[ok])
    frac = digit & (at > dec[c.row]) if rows else digit
    whole = digit & ~frac
    nonzero = digit & (c.cps != 48)
    lo = np.full(rows, len(c.cps))
    hi = np.full(rows, -1)
    np.minimum.at(lo, c.row[nonzero], at[nonzero])
    np.maximum.at(hi, c.row[nonzero], at[nonzero])
    sig = digit & (at >= lo[c.row]) & (at <= hi[c.row]) if rows else digit
    # power of ten of the first significant digit; 0 has none
    up = np.bincount(c.row[whole & (at >= lo[c.row])], minlength=rows) if rows else np.zeros(0)
    down = np.bincount(c.row[frac & (at < lo[c.row])], minlength=rows) if rows else np.zeros(0)
    scale = np.where(hi >= 0, up.astype(np.int64) - down.astype(np.int64), 0)
    minus = np.zeros(rows, dtype=np.int64)
    lead = np.isin(c.cps, _MINUS) & follows
    neg = lead & (at + 1 == np.minimum(first, dec)[c.row]) if rows else lead
    minus[c.row[neg]] = 1
    minus[hi < 0] = 0
    return _mix(_poly(c.cps[sig] - 47, c.row[sig], rows), (scale + 100_000) * 2 + minus)


def _record_keys(cols: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are records, and the key of each."""
    cols = [_Column(c) for c in cols]
    first = np.stack([c.first_kept() for c in cols])
    digit = (first >= 48) & (first <= 57)
    whole = (first != 0).all(axis=0) & ~np.any([c.null for c in cols], axis=0) & (digit.sum(axis=0) == 1)
    ids, weights = np.stack([_id_keys(c) for c in cols]), np.stack([_weight_keys(c) for c in cols])
    w = np.where(digit, weights, 0).sum(axis=0, dtype=np.uint64)
    id_keys = np.where(digit, 0, ids)
    big = id_keys.max(axis=0)
    small = id_keys.sum(axis=0, dtype=np.uint64) - big
    k = (big * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (small + np.uint64(0x165667B19E3779F9))
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    k ^= w * np.uint64(0xD6E8FEB86659FD93)
    keep = np.flatnonzero(whole)
    return keep, k[keep].view(np.int64)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, keys = _record_keys([b.column(i) for i in (1, 2, 3)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(keep))], names=["h", "line_id"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_hash_batches`` with their three fields beside them."""
    for b in batches:
        for keyed in _hash_batches(iter([b])):
            at = pc.index_in(keyed.column(1), value_set=b.column(0)) if len(keyed) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([keyed.column(0), keyed.column(1), *(b.column(i).take(at) for i in (1, 2, 3))], names=["h", "line_id", "f0", "f1", "f2"])


def same_letters(a: str, b: str) -> bool:
    """Whether two ids agree in letters and digits, ignoring case; two pointers, no copies."""
    i, j, n, m = 0, 0, len(a), len(b)
    while True:
        x = y = 0
        while i < n and not (x := _fold_one(ord(a[i]))):
            i += 1
        while j < m and not (y := _fold_one(ord(b[j]))):
            j += 1
        if x != y:
            return False
        if not x:
            return True
        i, j = i + 1, j + 1


def _number(s: str) -> tuple[int, int, int, int, bool]:
    """Where a number stands: first significant digit, decimal mark, last significant digit, place of the mark, sign."""
    n = len(s)
    first = next((i for i in range(n) if "0" <= s[i] <= "9"), n)
    dec = next((i for i in range(n - 1) if s[i] in ".," and "0" <= s[i + 1] <= "9"), n)
    lo = next((i for i in range(n) if "1" <= s[i] <= "9"), n)
    hi = next((i for i in range(n - 1, -1, -1) if "1" <= s[i] <= "9"), -1)
    at = min(first, dec)
    neg = 0 < at < n and ord(s[at - 1]) in _MINUS and hi >= 0
    scale = 0 if hi < 0 else (sum("0" <= s[i] <= "9" for i in range(lo, dec)) if lo < dec else -sum(s[i] == "0" for i in range(dec + 1, lo)))
    return lo, hi, dec, scale, neg


def same_number(a: str, b: str) -> bool:
    """Whether two decimal numbers are equal, digit by digit; of any length."""
    i, ie, _, sa, na = _number(a)
    j, je, _, sb, nb = _number(b)
    if (ie < 0) != (je < 0):
        return False
    if ie < 0:
        return True
    if sa != sb or na != nb:
        return False
    while True:
        while i <= ie and not "0" <= a[i] <= "9":
            i += 1
        while j <= je and not "0" <= b[j] <= "9":
            j += 1
        if i > ie or j > je:
            return i > ie and j > je
        if a[i] != b[j]:
            return False
        i, j = i + 1, j + 1


def same_record(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether two lines of three fields state the same record."""

    def split(x: Sequence[str]) -> tuple[list[str], list[str]]:
        number = ["0" <= next((c for c in f if _fold_one(ord(c))), "a") <= "9" for f in x]
        return [f for f, d in zip(x, number, strict=True) if d], [f for f, d in zip(x, number, strict=True) if not d]

    (wa, ia), (wb, ib) = split(a), split(b)
    if len(wa) != len(wb) or len(wa) != 1 or not same_number(wa[0], wb[0]):
        return False
    return (same_letters(ia[0], ib[0]) and same_letters(ia[1], ib[1])) or (same_letters(ia[0], ib[1]) and same_letters(ia[1], ib[0]))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each line with the first of its hash; only lines written otherwise are read by pointers."""
    for b in batches:
        f = [b.column(i) for i in range(3, 9)]
        alike = pc.and_(pc.and_(pc.equal(f[0], f[3]), pc.equal(f[1], f[4])), pc.equal(f[2], f[5]))
        same = np.array(alike, dtype=bool)
        rest = np.flatnonzero(~same)
        if len(rest):
            g = [c.take(pa.array(rest)).to_pylist() for c in f]
            same[rest] = [same_record(x[:3], x[3:]) for x in zip(*g, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(same, pa.bool_())], names=["h", "line_id", "rep", "same"])


_FIELDS = ("f0", "f1", "f2")
_HEAD = ("g0", "g1", "g2")


def _raw(lines: DataFrame, line_id: str, fields: Sequence[str]) -> DataFrame:
    return lines.select(F.col(line_id).cast("bigint").alias("line_id"), *(F.col(c).cast("string").alias(f) for f, c in zip(_FIELDS, fields, strict=True)))


def format_copies(lines: DataFrame, line_id: str = "line_id", fields: Sequence[str] = ("src_id", "dst_id", "weight"), max_rounds: int = 20) -> DataFrame:
    """(line_id_a, line_id_b): the smallest line of a record with each further line of it.

    A line with a null field, a field without letter or digit, or not exactly
    one number among its fields is in no record. Only the four columns are
    read. An empty table gives no rows. ``line_id`` must be unique.

    The hash pass carries the fields, so that the text is shuffled once, by
    hash, and the smallest line of each hash is found where its lines lie.
    Hashes with very many lines are not shuffled at all: their smallest lines,
    a bounded number, are broadcast to where the copies stand. Lines that turn
    out to differ from the smallest line are grouped again by themselves until
    none are left.
    """
    store = Rounds(lines.sparkSession, "format-copies")
    open_lines, seen = store.write(_raw(lines, line_id, fields).mapInArrow(_text_batches, "h bigint, line_id bigint, f0 string, f1 string, f2 string"), n=F.count(F.lit(1)))
    done = None
    for _ in range(max_rounds):
        groups, _ = store.write(open_lines.groupBy("h").agg(F.min("line_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
        checked, found = store.write(_with_heads(open_lines, groups, seen["n"]).mapInArrow(_verify_batches, "h bigint, line_id bigint, rep bigint, same boolean"), wrong=F.count_if(~F.col("same")))
        good = checked.filter("same").select(F.col("rep").alias("line_id_a"), F.col("line_id").alias("line_id_b"))
        done = good if done is None else done.unionAll(good)
        store.drop(groups)
        if not found["wrong"]:
            store.drop(open_lines)
            return done
        # hashes that met by chance are few
        again, seen = store.write(open_lines.join(checked.filter("not same").select("line_id"), "line_id", "left_semi"), n=F.count(F.lit(1)))
        store.drop(open_lines)
        open_lines = again
    raise RuntimeError("hash groups did not resolve")


def _with_heads(open_lines: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """(h, line_id, rep, fields, fields of rep) of all lines that are not the smallest of their hash."""
    hot = F.col("n") > skew.hot_bound(total)
    cold = open_lines.join(groups.filter(~hot), "h")
    first = Window.partitionBy("h").orderBy("line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = cold.select("h", "line_id", "rep", *_FIELDS, *(F.first(f).over(first).alias(g) for f, g in zip(_FIELDS, _HEAD, strict=True)))
    if total > skew.HOT_ROWS:
        few = F.broadcast(groups.filter(hot).select("h", "rep"))  # at most MOST_HOT rows, and their heads below
        heads = open_lines.join(F.broadcast(groups.filter(hot).select(F.col("rep").alias("line_id"))), "line_id", "left_semi").select("h", *(F.col(f).alias(g) for f, g in zip(_FIELDS, _HEAD, strict=True)))
        beside = beside.unionByName(open_lines.join(few, "h").join(F.broadcast(heads), "h"))
    return beside.filter(F.col("line_id") != F.col("rep")).select("h", "line_id", "rep", *_FIELDS, *_HEAD)


def record_counts(lines: DataFrame, copies: DataFrame, line_id: str = "line_id", fields: Sequence[str] = ("src_id", "dst_id", "weight")) -> DataFrame:
    """(line_id, n_copies) of the kept line of each record, itself included; 1 for a record without copies.

    ``copies`` come from ``format_copies``. Lines that are in no record have no row.
    """
    records = _raw(lines, line_id, fields).mapInArrow(_hash_batches, "h bigint, line_id bigint")
    head = records.join(copies, F.col("line_id") == F.col("line_id_b"), "left").select(F.coalesce("line_id_a", "line_id").alias(line_id))
    return head.groupBy(line_id).agg(F.count(F.lit(1)).alias("n_copies"))
