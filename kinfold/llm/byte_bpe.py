"""Byte-level BPE of whole texts in parallel chunks, and decoding.

A text longer than ``chunk`` characters becomes overlapping chunks, one row each, which are dealt to the
tasks. Every chunk is pre-tokenised on its own. In the overlap of two neighbours the first position at
which both have a boundary is where they resynchronise: the pattern looks at no character before a
match, so from a common boundary on both see the same matches. Each chunk then encodes its pieces from
its own such position to the next one. A boundary of the left chunk counts only if its match ended before
the chunk did, since what follows could still change a match that touches the end.

Where an overlap has no common boundary (one match longer than the overlap), the text is encoded by
one task as a whole, which is as exact. Texts within one chunk are encoded where they are read.
"""

from __future__ import annotations

import functools
import itertools
from array import array
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.llm.vocabulary import byte_encoding, ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32_768
OVERLAP = 1_024
ROWS_OUT = 512


class ByteEncoder:
    """Whole runs of pattern matches to ids (little-endian, four bytes each), and ids back to bytes."""

    def __init__(self, name: str = RANKS):
        import public_tokenizers
        import regex

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = byte_encoding(name)
        table = ranks(name)
        self.raw = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.raw[i] = token

    def ids(self, run: str) -> bytes:
        """``run`` starts and ends at boundaries of the text, so it matches alone as it does inside."""
        return self.encoding.encode_to_numpy(run, disallowed_special=()).astype("<u4").tobytes()

    def bounds(self, text: str) -> list[int]:
        """Starts of the matches and the end."""
        return [0, *itertools.accumulate(map(len, self.pattern.findall(text)))]

    def text(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, array("I", ids)))


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> ByteEncoder:
    return ByteEncoder(name)


def _ids(name: str):
    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name)
        for texts in batches:
            for low in range(0, len(texts), ROWS_OUT):  # short batches go back, so that few ids are held at once
                yield pd.Series([own.ids(t) if t else b"" for t in texts.iloc[low:low + ROWS_OUT]], dtype=object)

    return ids


def _bounds(name: str, reach: int):
    """Boundaries near both ends of a chunk, counted from the start of its text."""

    @F.pandas_udf("struct<head:array<long>,tail:array<long>>")
    def bounds(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        own = encoder(name)
        for start, texts, last in batches:
            head, tail = [], []
            for s, t, final in zip(start, texts, last):
                found = own.bounds(t)
                sure = found if final else found[:-2]  # the last match touches the end, its start is settled by the one before
                head.append([s + b for b in sure if b < reach])
                tail.append([s + b for b in sure if b >= len(t) - reach])
            yield pd.DataFrame({"head": head, "tail": tail})

    return bounds


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = RANKS, chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """All rows and columns of ``df`` with ``out``: the ids as binary, four little-endian bytes each.

    Null and empty texts give no ids. Repeated rows and clashing column names are kept as they are
    (working columns start with ``_bpe_`` and are made after ``df``'s own were packed away).
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be positive and smaller than a chunk")
    ids = _ids(name)
    length = F.coalesce(F.length(F.col(text)), F.lit(0))
    short = df.where(length <= chunk).withColumn(out, ids(F.col(text)))
    rows = df.where(length > chunk).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.expr("uuid()").alias("id"))
    from kinfold.session import cut

    rows = cut(rows)  # the random ids must not change when a task is repeated
    body = F.col(f"row.`{text}`")
    starts = rows.select("id", F.length(body).alias("total"), F.posexplode(
        F.sequence(F.lit(0), F.length(body) - 1, F.lit(chunk))).alias("k", "start"), body.alias("body"))
    parts = starts.select(
        "id", "k", "total", F.col("start").cast("long").alias("start"),
        F.substring("body", F.col("start") + 1, F.lit(chunk + overlap)).alias("part")
    ).repartition("id", "k")
    parts = parts.withColumn("b", _bounds(name, overlap)(F.col("start"), F.col("part"), F.col("start") + chunk + overlap >= F.col("total")))
    parts = cut(parts)
    doc = Window.partitionBy("id").orderBy("k")
    met = parts.withColumn("common", F.array_min(F.array_intersect("b.head", F.lag("b.tail").over(doc))))
    met = met.select(
        "id", "k", "total", "start", "part",
        F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("common")).cast("long").alias("first"),
        F.lead("common").over(doc).alias("next"), F.lead("k").over(doc).isNull().alias("last"))
    own = F.when(F.col("first").isNotNull() & (F.col("last") | F.col("next").isNotNull()), F.substring(
        "part", (F.col("first") - F.col("start") + 1).cast("int"),
        F.when(F.col("last"), F.lit(chunk + overlap)).otherwise(F.col("next") - F.col("first")).cast("int")))
    done = met.select("id", "k", own.alias("own")).withColumn("got", ids(F.col("own")))
    joined = done.groupBy("id").agg(
        F.every(F.col("own").isNotNull()).alias("met"),
        F.aggregate(F.array_sort(F.collect_list(F.struct("k", "got"))), F.lit("").cast("binary"),
                    lambda a, x: F.concat(a, x["got"])).alias("got"))
    long = rows.join(joined, "id")
    whole = F.when(F.col("met"), F.lit(None)).otherwise(body)
    long = long.withColumn("again", ids(whole)).select(
        "row.*", F.when(F.col("met"), F.col("got")).otherwise(F.col("again")).alias(out))
    return short.unionByName(long)


def decode(ids: str, name: str = RANKS) -> Column:
    """The raw bytes of an id column as :func:`encode` makes it; null gives null."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name)
        for found in batches:
            for low in range(0, len(found), ROWS_OUT):
                yield pd.Series([None if x is None else own.text(bytes(x)) for x in found.iloc[low:low + ROWS_OUT]], dtype=object)

    return raw(F.col(ids))
