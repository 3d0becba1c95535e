"""Exact repeats of long byte strings, found by sorting suffixes a bucket at a time.

A byte goes if it is covered by a string of ``least`` bytes that also starts anywhere else. Suffixes are compared as far as
``least`` bytes, so a suffix is the window of that many bytes at its start, and suffixes that are too short take no part.

1. Every window is dealt to a bucket by its content: the 64-byte string in it with the smallest hash, the leftmost of equal ones (its
   anchor). Equal windows have equal anchors at the same place. Neighbouring windows share their anchor, so a bucket gets one row for each
   *span* of windows, about one per hundred bytes. A bucket with one row holds no repeat.
2. Spans of a bucket that are equal as a whole repeat as a whole; one of them goes on to the sort if the bucket has others.
3. The bytes of the remaining spans travel to blocks of buckets of bounded size. A block sorts the suffixes that share their first
   73 bytes, one such bucket beside the other; ties are resolved by ranks of the cover sample: suffixes whose
   position modulo 73 is in a difference cover are ranked once by prefix doubling, and for any two suffixes the cover has a distance under 73
   at which both are in the sample. Neighbours in the order that share ``least`` bytes are repeats.
4. A bucket of more than ``bucket_spans`` different spans is too large for a block. Its windows become rows, counted under
   128-bit fingerprints.

Each text's rows are as many as its bytes allow, copies of a text are sorted once, and no step holds a bucket that grows with the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.hashing import U, mixed, pieces, text_bytes
from kinfold.session import cut

LEAST = 400
GRAM = 64
BUCKET_SPANS = 1_024
BLOCK_BYTES = 2 << 20
MOST_BROADCAST = 500_000  # of 12 bytes each
PERIOD = 73
#: The powers of two modulo 73: every difference modulo 73 occurs among them.
COVER = np.array(sorted({pow(2, k, PERIOD) for k in range(9)}))

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def cover_shifts(period: int = PERIOD, cover: np.ndarray = COVER) -> np.ndarray:
    """``[r, s]``: the smallest distance that takes both remainders into the cover."""
    inside = np.isin(np.arange(period), cover)
    out = np.full((period, period), -1)
    for d in range(period - 1, -1, -1):
        now = np.roll(inside, -d)
        out[np.ix_(now, now)] = d
    if (out < 0).any():
        raise ValueError("not a difference cover")
    return out


SHIFT = cover_shifts()
SLOT = np.zeros(PERIOD, np.int64)
SLOT[COVER] = np.arange(len(COVER))


class Fingerprints:
    """Polynomial fingerprints of all strings of a byte array: equal strings have equal ones."""

    def __init__(self, raw: np.ndarray, salt: int = 0):
        size = len(raw) + 1
        code = mixed(np.arange(1, 257, dtype=U) * U(2 * salt + 1))
        power = np.full(size, U(BASE))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.full(size, U(BACK))
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(size, U)
        np.cumsum(code[raw] * power[:-1], out=self.sums[1:])

    def __call__(self, low, high) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.back[low])


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours: of a prefix and a suffix of two aligned pieces."""
    grid = np.concatenate((keys, np.full(-len(keys) % width, ~U(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:len(keys) - width + 1], ahead[width - 1:len(keys)])


def spans_of(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``(text, gram, span, low, high)`` of the spans of windows: the anchor's hash, a fingerprint of the span with its
    anchor's place, and the first and last window as positions in ``raw``."""
    if len(raw) < least:
        return (np.zeros(0, np.int64),) * 5
    prints = Fingerprints(raw)
    starts = np.arange(len(raw) - GRAM + 1)
    grams = prints(slice(0, len(starts)), slice(GRAM, len(raw) + 1))
    keys = (grams & ~U(0xFFFFFFFF)) | starts.astype(U)
    anchor = (_least_of(keys, least - GRAM + 1) & U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + least <= offsets[1:][doc])
    if not len(window):
        return (np.zeros(0, np.int64),) * 5
    anchor, doc = anchor[window], doc[window]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    low, high, at = window[new], window[np.append(new[1:], len(window)) - 1], anchor[new]
    span = mixed(prints(low, high + least) ^ ((at - low).astype(U) << U(32)) ^ (high - low).astype(U))
    return doc[new], grams[at].view(np.int64), span.view(np.int64), low, high


def _span_table(batches, least: int):
    for batch in batches:
        raw, offsets = text_bytes(batch.column(2))
        for first, last in pieces(offsets, 4 << 20):
            inside = offsets[first:last + 1] - offsets[first]
            doc, gram, span, low, high = spans_of(raw[offsets[first]:offsets[last]], inside, least)
            take, base = pa.array(doc + first), inside[doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(gram), pa.array(span), pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32))],
                names=["doc", "size", "gram", "span", "low", "high"])


def sample_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes in the cover sample, in the order of their first ``depth`` bytes at least.

    Position p of the sample has place ``p // 73 * 9 + SLOT[p % 73]``. Ranks of the first 80 bytes come from sorting ten
    words; then a rank and the one a reach of whole periods later are ranked as a pair until the depth is reached.
    """
    periods = len(x) // PERIOD + 1
    place = (np.arange(periods)[:, None] * PERIOD + COVER).ravel()
    words = np.ndarray((len(x) + 80,), ">u8", np.concatenate((x, np.zeros(88 + PERIOD, np.uint8))), strides=(1,))
    keys = [words[np.minimum(place + 8 * k, len(words) - 1)].astype(U) for k in range(10)]
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(place), bool)
    for key in keys:
        step[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(place), np.int64)
    rank[order] = np.cumsum(step) + 1
    reach = 80
    while reach < depth:
        ahead = reach // PERIOD
        later = np.zeros_like(rank)
        later[:len(rank) - ahead * len(COVER)] = rank[ahead * len(COVER):]
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].ravel() + 1
        reach += ahead * PERIOD
    return rank


def _network(size: int):
    """The passes of odd-even merge sort: pairs of places that may be compared side by side."""
    p = 1
    while p < size:
        k = p
        while k:
            a = np.arange(k % p, size - k)
            a = a[((a - k % p) % (2 * k) < k) & (a // (2 * p) == (a + k) // (2 * p))]
            yield a, a + k
            k //= 2
        p *= 2


def repeated_windows(x: np.ndarray, windows: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which of the windows of ``least`` bytes at these positions of ``x`` equal another of them."""
    repeated = np.zeros(len(windows), bool)
    if len(windows) < 2:
        return repeated
    head = Fingerprints(x)(windows, windows + PERIOD)
    order = np.argsort(head, kind="stable")
    same = np.append(False, head[order][1:] == head[order][:-1])
    first = np.flatnonzero(~same)
    count = np.diff(np.append(first, len(order)))
    rank = sample_ranks(x, least)
    at = windows[order]

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` comes after the one at ``b``; both share their first 73 bytes."""
        d = SHIFT[a % PERIOD, b % PERIOD]
        u, w = a + d, b + d
        return rank[u // PERIOD * len(COVER) + SLOT[u % PERIOD]] > rank[w // PERIOD * len(COVER) + SLOT[w % PERIOD]]

    size = 2
    while size < 2 * count.max():
        own = np.flatnonzero((count > size // 2) & (count <= size))
        for low, high in _network(size) if len(own) else ():
            for part in np.array_split(own, -(-len(own) * len(low) // 2_000_000)):
                both = (high[None, :] < count[part][:, None])
                p = (first[part][:, None] + low[None, :])[both]
                q = p + (high - low)[0]
                swap = later(at[p], at[q])
                p, q = p[swap], q[swap]
                at[p], at[q], order[p], order[q] = at[q], at[p], order[q], order[p]
        size *= 2
    pair = np.flatnonzero(same)
    words = np.ndarray((len(x) - 7,), ">u8", np.ascontiguousarray(x), strides=(1,))
    for k in [*range(0, least - 8, 8), least - 8]:
        pair = pair[words[at[pair] + k] == words[at[pair - 1] + k]]
    repeated[order[pair]] = repeated[order[pair - 1]] = True
    return repeated


def _joined(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(x, windows, piece, shift)``: the pieces' bytes, all of their windows, the piece of each and its number in it."""
    raw = block.column("piece").to_pylist()
    size = np.array([len(p) for p in raw], np.int64)
    start = np.append(0, np.cumsum(size))
    many = (block.column("high").to_numpy() - block.column("low").to_numpy()).astype(np.int64) + 1
    piece = np.repeat(np.arange(len(raw)), many)
    shift = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    return np.frombuffer(b"".join(raw), np.uint8), start[piece] + shift, piece, shift


def _block(least: int):
    def sort(block: pa.Table) -> pa.Table:
        x, windows, piece, shift = _joined(block)
        found = np.flatnonzero(repeated_windows(x, windows, least))
        piece, shift = piece[found], shift[found]
        new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (shift[1:] != shift[:-1] + 1))) if len(found) else found
        last = np.append(new[1:], len(found)) - 1 if len(found) else found
        low = block.column("low").to_numpy()[piece[new]]
        take = pa.array(piece[new])
        return pa.table({"doc": block.column("doc").take(take), "size": block.column("size").take(take),
                         "low": pa.array((low + shift[new]).astype(np.int32)), "high": pa.array((low + shift[last]).astype(np.int32))})
    return sort


def _window_rows(least: int):
    def rows(batches):
        for batch in batches:
            for part in (batch.slice(k, 2_000) for k in range(0, len(batch), 2_000)):
                table = pa.Table.from_batches([part])
                x, windows, piece, shift = _joined(table)
                take = pa.array(piece)
                at = (table.column("low").to_numpy()[piece] + shift).astype(np.int32)
                a, b = (Fingerprints(x, salt)(windows, windows + least).view(np.int64) for salt in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), table.column("doc").take(take).combine_chunks(), table.column("size").take(take).combine_chunks(), pa.array(at)], names=["a", "b", "doc", "size", "low"])
    return rows


def repeated_spans(df: DataFrame, text: str = "text", least: int = LEAST, bucket_spans: int = BUCKET_SPANS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc, size, low, high)``: spans of windows of a text that occur elsewhere, by the first and last window.

    ``doc`` is the hash of the text and ``size`` its bytes, which together name it: equal texts have equal spans.
    """
    if least < GRAM + PERIOD:
        raise ValueError(f"strings of under {GRAM + PERIOD} bytes are not supported")
    texts = df.select(F.xxhash64(text).alias("doc"), F.octet_length(text).alias("size"), F.col(text).alias("text")).where(F.col("size") >= least)
    spans = cut(texts.mapInArrow(lambda batches: _span_table(batches, least), "doc long, size int, gram long, span long, low int, high int"))
    # buckets with more than one span, and whether these are all equal
    shared = spans.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("b")).where("n > 1")
    # written first, so that a bucket with very many rows can be split in the join
    shared = cut(shared.select("gram", (F.col("a") == F.col("b")).alias("equal")))
    met = cut(spans.join(shared, "gram"))
    whole = met.where("equal").select("doc", "size", "low", "high")
    unequal = met.where("not equal")
    kinds = cut(unequal.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "size", "low", "high")).alias("at")))
    twice = unequal.join(kinds.where("n > 1").select("gram", "span"), ["gram", "span"], "left_semi").select("doc", "size", "low", "high")
    # one span of each kind goes on, cut from its text
    wide = kinds.groupBy("gram").agg((F.count("*") > bucket_spans).alias("wide"))
    wanted = kinds.join(wide, "gram").groupBy("at.doc", "at.size").agg(F.collect_list(F.struct("gram", "at.low", "at.high", "wide")).alias("all"))
    wanted = cut(wanted)
    if wanted.count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(wanted.select("doc", "size")), ["doc", "size"], "left_semi")  # beyond that all texts are shuffled
    one = texts.groupBy("doc", "size").agg(F.min("text").alias("text")).join(wanted, ["doc", "size"])
    cutout = F.substring(F.col("text").cast("binary"), F.col("s.low") + 1, F.col("s.high") - F.col("s.low") + least)
    cutouts = cut(one.select("doc", "size", "text", F.explode("all").alias("s")).select(
        "doc", "size", "s.gram", "s.low", "s.high", "s.wide", cutout.alias("piece")))
    total = cutouts.where("not wide").agg(F.coalesce(F.sum(F.octet_length("piece").cast("long")), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    dealt = cutouts.where("not wide").withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks))).select("block", "doc", "size", "low", "high", "piece")
    sorted_out = dealt.groupBy("block").applyInArrow(_block(least), "doc long, size int, low int, high int")
    loose = cutouts.where("wide").select("doc", "size", "low", "high", "piece").mapInArrow(_window_rows(least), "a long, b long, doc long, size int, low int")
    often = loose.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    apart = loose.join(often, ["a", "b"], "left_semi").select("doc", "size", "low", F.col("low").alias("high"))
    return whole.unionByName(twice).unionByName(sorted_out).unionByName(apart)


def _without(least: int):
    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def without(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for body, packed in zip(raw, spans):
            if body is None or packed is None or not len(packed):
                out.append((body, 0, 0))
                continue
            found = np.sort(np.asarray(packed, np.int64))
            low, end = found >> 32, (found & 0xFFFFFFFF) + least
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
            begins, stops = low[new], reach[np.append(new[1:], len(low)) - 1]
            kept = b"".join(body[a:b] for a, b in zip(np.append(0, stops), np.append(begins, len(body))))
            out.append((kept, len(body) - len(kept), len(new)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])
    return without


def remove_repeats(df: DataFrame, text: str = "text", least: int = LEAST, bucket_spans: int = BUCKET_SPANS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``df`` as ``row``, with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Bytes covered by a string of ``least`` bytes that also starts elsewhere, in any text or the same one, go; what repeats is
    judged on the input, strings do not cross texts, overlapping ones count. ``n_spans`` are the maximal removed runs. What stays may
    break a character, so it is binary. Repeated rows are texts of their own, so all of their bytes go if there are ``least``. Null and empty
    texts, and those under ``least`` bytes, keep what they have (null: empty). An empty table gives an empty one; no column but the text
    is looked at, and none of the others can clash, since they come back in ``row``. A text is held whole by one task at a time.
    """
    found = repeated_spans(df, text, least, bucket_spans, block_bytes)
    packed = F.shiftleft(F.col("low").cast("long"), 32) + F.col("high")
    found = found.groupBy("doc", "size").agg(F.collect_set(packed).alias("spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(text).alias("doc"), F.octet_length(text).alias("size"))
    both = rows.join(found, ["doc", "size"], "left")
    raw = F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")
    both = both.withColumn("w", F.when(F.col("spans").isNotNull(), _without(least)(raw, F.col("spans"))))
    return both.select(
        "row", F.coalesce("w.kept", raw).alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"),
        F.coalesce("w.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("w.n_spans", F.lit(0).cast("long")).alias("n_spans"))
