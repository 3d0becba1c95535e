"""Periodic runs of words, found over a run-length grammar made by recompression.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``exponent`` periods and
``least`` words. Any such run of period q repeats its words q apart over (exponent - 1) * q places or more, so it crosses a grid of that
width; for each q the grid's places are the candidates (n log n of them, the harmonic series over q). A candidate whose own and
neighbouring words do not repeat can not be inside a run; texts without another candidate need no grammar.

All other texts of a batch get one grammar: in turn, blocks of equal symbols become one symbol, and pairs of a left and a right symbol
become one, where symbols are dealt to the two sides anew each time, until every text is one symbol. Equal stretches of a text are cut
alike but for their ends, so the longest common extension of two places takes a few steps on each level: up, over equal symbols, as long as both places begin
one, and down again into the first two that differ. Blocks are passed in one step, whatever their length. The extensions to the
right and to the left of a place and the one a period later are the run, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.hashing import U, mixed, pieces, text_bytes, word_hashes

LEAST = 6
EXPONENT = 4
PIECE = 2 << 20
CANDIDATES = 2_000_000
PLAIN = np.arange(256, dtype=np.uint8)


class Grammar:
    """Run-length grammar of a sequence of symbols by recompression.

    ``symbols[l]`` are the symbols of level l; even levels are followed by block compression, odd ones by pair
    compression. ``child[l][k]`` is the place on level l - 1 that symbol k of level l begins at, ``parent[l][k]`` the place on level l + 1
    that symbol k belongs to, ``start[l][k]`` the word that it begins at. Negative symbols mark ends: they are all different and never join.
    """

    def __init__(self, sequence: np.ndarray):
        ends = np.flatnonzero(sequence < 0)
        words = np.unique(sequence, return_inverse=True)[1].ravel()
        self.symbols, self.start = [words], [np.arange(len(sequence) + 1)]
        self.child, self.parent = [None], []
        fixed = sequence < 0
        while len(self.symbols[-1]) > 2 * len(ends) - 1 or len(self.symbols) % 2 == 0:
            last = self.symbols[-1]
            if len(self.symbols) % 2:
                begins = np.append(True, (last[1:] != last[:-1]) | fixed[1:])
                at = np.flatnonzero(begins)
                key = last[at].astype(np.int64) << 32 | np.diff(np.append(at, len(last)))
            else:
                side = mixed(last.astype(U) << U(8) | U(len(self.symbols) % 256)) >> U(63) == 1
                free = ~fixed[:-1] & ~fixed[1:]
                ahead, behind = (free & (side[:-1] == s) & (side[1:] != s) for s in (True, False))
                joins = np.append(ahead if ahead.sum() >= behind.sum() else behind, False)
                at = np.flatnonzero(~np.append(False, joins[:-1]))
                key = (last[at].astype(np.int64) + 1) << 32
                key[joins[at]] += last[at[joins[at]] + 1].astype(np.int64) + 1
            fixed = fixed[at]
            self.symbols.append(np.unique(key, return_inverse=True)[1].ravel())
            self.child.append(np.append(at, len(last)))
            self.parent.append(np.repeat(np.arange(len(at)), np.diff(self.child[-1])))
            self.start.append(self.start[-1][self.child[-1]])

    def _equal_right(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places to move on over equal symbols: the rest of the shorter block, or one symbol."""
        if level % 2 == 0 and level < len(self.parent):
            left = lambda k: self.child[level + 1][self.parent[level][k] + 1] - k
            return np.minimum(left(p), left(q))
        return np.ones(len(p), np.int64)

    def _equal_left(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if level % 2 == 0 and level < len(self.parent):
            left = lambda k: k - self.child[level + 1][self.parent[level][k]] + 1
            return np.minimum(left(p), left(q))
        return np.ones(len(p), np.int64)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on (a < b, in one text)."""
        p, q = a.copy(), b.copy()
        top = np.zeros(len(a), np.int64)
        rising = np.arange(len(a))
        for level in range(len(self.symbols)):
            same = self.symbols[level][p[rising]] == self.symbols[level][q[rising]]
            top[rising] = level
            rising = rising[same]
            if not len(rising) or level == len(self.parent):
                break
            up, child = self.parent[level], self.child[level + 1]
            begins = lambda: (child[up[p[rising]]] == p[rising]) & (child[up[q[rising]]] == q[rising])
            go = rising[~begins()]
            step = self._equal_right(level, p[go], q[go])
            p[go] += step
            q[go] += step
            rising = rising[begins()]
            p[rising], q[rising] = up[p[rising]], up[q[rising]]
        for level in range(int(top.max(initial=0)), -1, -1):
            on = np.flatnonzero(top >= level)
            deep = on[top[on] > level]
            p[deep], q[deep] = self.child[level + 1][p[deep]], self.child[level + 1][q[deep]]
            go = on[self.symbols[level][p[on]] == self.symbols[level][q[on]]]
            step = self._equal_right(level, p[go], q[go])
            p[go] += step
            q[go] += step
        return p - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``, going back; the words at ``a - 1`` and ``b - 1`` come first."""
        p, q = a - 1, b - 1  # the symbols that end at the places; the first end mark lies at 0
        top = np.zeros(len(a), np.int64)
        rising = np.arange(len(a))
        for level in range(len(self.symbols)):
            same = self.symbols[level][p[rising]] == self.symbols[level][q[rising]]
            top[rising] = level
            rising = rising[same]
            if not len(rising) or level == len(self.parent):
                break
            up, child = self.parent[level], self.child[level + 1]
            ends = lambda: (child[up[p[rising]] + 1] == p[rising] + 1) & (child[up[q[rising]] + 1] == q[rising] + 1)
            go = rising[~ends()]
            step = self._equal_left(level, p[go], q[go])
            p[go] -= step
            q[go] -= step
            rising = rising[ends()]
            p[rising], q[rising] = up[p[rising]], up[q[rising]]
        for level in range(int(top.max(initial=0)), -1, -1):
            on = np.flatnonzero(top >= level)
            deep = on[top[on] > level]
            p[deep], q[deep] = self.child[level + 1][p[deep] + 1] - 1, self.child[level + 1][q[deep] + 1] - 1
            go = on[self.symbols[level][p[on]] == self.symbols[level][q[on]]]
            step = self._equal_left(level, p[go], q[go])
            p[go] -= step
            q[go] -= step
        return a - 1 - p


def _periods(count: int, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(period, width)`` of the grids of a text of so many words: a run repeats its words over ``width`` places at least."""
    period = np.arange(1, count // exponent + 1 if count >= least else 1)
    return period, np.maximum(least, exponent * period) - period


def _candidates(words: np.ndarray, first: np.ndarray, least: int, exponent: int):
    """Grid places that may lie in a run, a piece at a time: ``(place, period)``, places as positions in ``words``."""
    for text in range(len(first) - 1):
        count = int(first[text + 1] - first[text])
        own = words[first[text]:first[text + 1]]
        period, width = _periods(count, least, exponent)
        many = -(-(count - period) // width)
        low = 0
        while low < len(period):
            high = max(low + 1, int(np.searchsorted(np.cumsum(many[low:]), CANDIDATES)) + low)
            q = np.repeat(period[low:high], many[low:high])
            at = (np.arange(len(q)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])) * np.repeat(width[low:high], many[low:high])
            on = own[at] == own[at + q]
            at, q = at[on], q[on]
            if len(at):
                # the grid place lies in three equal ones in a row at least, since no grid is narrower than three
                equal = lambda d: (at + d >= 0) & (at + d + q < count) & (own[np.clip(at + d, 0, count - 1)] == own[np.clip(at + d + q, 0, count - 1)])
                before, after = equal(-1), equal(1)
                on = (before & after) | (after & equal(2)) | (before & equal(-2))
                if on.any():
                    yield at[on] + first[text], q[on]
            low = high


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """``(text, start, length, period)`` of every run, by text, start and period; ``first`` as in :func:`word_hashes`."""
    none = (np.zeros(0, np.int64),) * 4
    found = list(_candidates(words, first, least, exponent))
    if not found:
        return none
    place, period = (np.concatenate(c) for c in zip(*found))
    text = np.searchsorted(first, place, "right") - 1
    used = np.unique(text)
    # the texts with candidates, each with an end mark behind it and one before the first
    size = first[used + 1] - first[used]
    begin = np.cumsum(size + 1) - size  # one mark lies before each text
    sequence = np.full(int((size + 1).sum()) + 1, -1, np.int64)
    sequence[np.append(0, begin + size)] = -1 - np.arange(len(used) + 1)
    inside = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(first[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sequence[inside] = np.unique(words[source], return_inverse=True)[1].ravel()
    grammar = Grammar(sequence)
    own = np.searchsorted(used, text)
    a = place - first[text] + begin[own]
    ahead, behind = grammar.right(a, a + period), grammar.left(a, a + period)
    length = ahead + behind + period
    start = a - behind - begin[own]
    long_enough = length >= np.maximum(least, exponent * period)
    text, start, length, period = (x[long_enough] for x in (text, start, length, period))
    # of the periods of one stretch the smallest counts
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(text) else np.zeros(0, bool)
    text, start, length, period = (x[new] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, length, period))


def _word_edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of :func:`word_hashes` begin and end."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    return begins, ends


def _collapsed(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Per text its kept words, joined by one space."""
    size = np.where(kept, ends - begins + 1, 0)
    total = int(size.sum())
    out = np.full(total, 32, np.uint8)
    b, s = begins[kept], size[kept] - 1
    to = np.cumsum(size[kept]) - size[kept]
    shift = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
    out[np.repeat(to, s) + shift] = raw[np.repeat(b, s) + shift]
    bounds = np.append(0, np.cumsum(size))[first]
    body = out.tobytes()
    return [body[a:max(a, z - 1)] for a, z in zip(bounds[:-1], bounds[1:])]


def _batches(batches, least: int, exponent: int, columns: list[str]):
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        raw, offsets = text_bytes(batch.column(len(columns)))
        for low, high in pieces(offsets, PIECE):
            part, inside = raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            words, first = word_hashes(part, inside, PLAIN)
            begins, ends = _word_edges(part, inside)
            text, start, length, period = find_runs(words, first, least, exponent)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, first[text] + start + period, 1)
            np.add.at(change, first[text] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            struct = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            bounds = pa.array(np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(low, high - low) for k in range(len(columns))]
                + [pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(bounds, struct).cast(shape), pa.array(_collapsed(part, begins, ends, first, kept), pa.binary()).cast(pa.string())],
                names=[*columns, "n_words", "runs", "collapsed"])


def collapse_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``(key, n_words, runs, collapsed)`` per row of ``df``: all runs by start and period, and the text without repeats.

    Words are what spaces and the bytes 9 to 13 separate; they are told apart by 64-bit hashes. ``collapsed`` joins by one space the words
    that no run contains after its first period. Null and empty texts have no words, no runs and an empty result; null keys stay null, repeated rows
    get equal results, an empty table an empty one. Of runs of one stretch the smallest period counts; runs of different periods
    may overlap. Other columns are not read, so none can clash. Texts are whole in one task, in pieces of about 2 MB or one text.
    """
    if least < 6 or exponent < 4:
        raise ValueError("runs of under four periods or six words need a closer grid")
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _batches(batches, least, exponent, ["key"]),
        f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("key", key)


def strongest(runs: str = "runs"):
    """The run of greatest length / period, compared exactly; ties to the smallest start, then period. Null without runs."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    return F.aggregate(runs, F.get(F.col(runs), F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
