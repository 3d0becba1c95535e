"""How far the sources of a language use its terms differently, over a term-major index.

Terms are runs of letters and of characters beyond ASCII. Each language keeps the terms that occur in ``least_texts`` of its rows. A
group (language and source) gives each kept term a share p = 1 + floor(10^9 (count + 1) / (N + V)), and (p - q)^2 / q, rounded down, is what a term
adds to the divergence from a group of shares q.

All pairs of groups of a language are needed, for all kept terms. Most counts are zero, so a pair starts from a baseline: what all terms would add if
neither group had any, plus for each *different* count of either group the change if the other has none, times the terms with
that count. Only terms that both groups have need a correction. For these the rows of the group-term matrix are accumulated as
in Gustavson's product: a task holds a block of the term-major index (for each term the groups that have it, with counts); each group
scatters its terms through it into one dense array, a number per peer. No pair of postings is ever a row; a task gives one row per group and peer.

Arithmetic is in whole numbers: shares by long division in steps of a thousand, sums modulo 2^64, which no final sum exceeds.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.session import cut

SCALE = 10 ** 9
LEAST_TEXTS = 3
TOP = 200
BLOCK_POSTINGS = 200_000
FLUSH = 1_000_000
SCATTER = 4_000_000

#: Byte by byte: A-Z become a-z, other ASCII that is no letter a gap.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _term_table(batches):
    """``(lang, source, term, n, texts)``, partial sums: one row per term and group as long as they fit in memory."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (counts, texts) in groups.items():
            terms = list(counts)
            for k in range(0, len(terms), 50_000):
                some = terms[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([counts[t] for t in some], pa.int64()), pa.array([texts[t] for t in some], pa.int64())],
                    names=["lang", "source", "term", "n", "texts"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not text:
                continue
            own = Counter(text.encode("utf-8", "replace").translate(TERM_BYTES).split())
            counts, texts = groups.setdefault((lang, source), (Counter(), Counter()))
            counts.update(own)
            texts.update(own.keys())
        if sum(len(counts) for counts, _ in groups.values()) > FLUSH:
            yield from flush()
    yield from flush()


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, texts)``: occurrences of each term in a group, and how many of its rows have it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(text).alias("text")).mapInArrow(
        _term_table, "lang string, source string, term string, n long, texts long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exact for a whole below 9 * 10^15."""
    rest, got = np.broadcast_arrays(np.asarray(count, np.int64) + 1, np.asarray(whole, np.int64))[0].copy(), 0
    for _ in range(3):
        rest = rest * 1000
        got = got * 1000 + rest // whole
        rest = rest % whole
    # a count can't exceed the whole, so the quotient is 10^9 at most
    return got + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _share(count: str, whole: str):
    """The same in SQL; decimals keep the product exact at any size."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(25, 0)) * {SCALE}) div cast({whole} as decimal(25, 0))")


def _apart(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _baseline(own: pa.Table, peers: pa.Table) -> pa.Table:
    """What a pair adds if no term were in both, for the groups of a block against all of their language."""
    shape = pa.schema([("lang", pa.string()), ("own", pa.int32()), ("peer", pa.int32()), ("value", pa.int64())])
    if not own.num_rows or not peers.num_rows:
        return shape.empty_table()
    lang = own.column("lang")[0].as_py()
    read = lambda t: [(r["number"], r["whole"], r["kinds"], np.array([h["n"] for h in r["counts"]], np.int64), np.array([h["terms"] for h in r["counts"]], np.int64)) for r in t.to_pylist()]
    mine, others = read(own), sorted(read(peers), key=lambda r: r[0])
    number = np.array([o[0] for o in others], np.int32)
    none = np.array([int(shares(np.array([0]), np.array([o[1]]))[0]) for o in others], np.int64)
    edge = np.append(0, np.cumsum([len(o[3]) for o in others]))
    theirs = np.concatenate([shares(o[3], np.array(o[1])) for o in others]) if edge[-1] else np.zeros(0, np.int64)
    times = np.concatenate([o[4] for o in others]) if edge[-1] else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(others)), np.diff(edge))
    parts = []
    for me, whole, kinds, counts, terms in mine:
        p0 = int(shares(np.array([0]), np.array([whole]))[0])
        ground = apart(np.int64(p0), none)
        value = kinds * ground
        p = shares(counts, np.array(whole))
        for low in range(0, len(p), 512):
            value = value + ((apart(p[low:low + 512, None], none[None, :]) - ground) * terms[low:low + 512, None]).sum(0)
        np.add.at(value, owner, (apart(np.int64(p0), theirs) - ground[owner]) * times)
        parts.append(pa.table([pa.array([lang] * len(others)), pa.array(np.full(len(others), me, np.int32)), pa.array(number), pa.array(value)], schema=shape))
    return pa.concat_tables(parts)


def _scatter(block: pa.Table) -> pa.Table:
    """Corrections for the terms that two groups share: rows ``(lang, own, peer, value)`` of one block of the term-major index."""
    lang = block.column("lang")[0].as_py()
    block = block.sort_by("term")
    _, term = np.unique(block.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
    group, n, whole = (block.column(c).to_numpy().astype(np.int64) for c in ("number", "n", "whole"))
    p, zero = shares(n, whole), shares(np.zeros_like(n), whole)
    order = np.argsort(term, kind="stable")
    term, group, p, zero = term[order], group[order], p[order], zero[order]
    edge = np.searchsorted(term, np.arange(term[-1] + 2))
    by_group = np.argsort(group, kind="stable")
    names, first = np.unique(group[by_group], return_index=True)
    first = np.append(first, len(group))
    mark = np.bincount(group, minlength=int(names[-1]) + 1)
    out = ([], [], [])
    for k, me in enumerate(names):
        mine = by_group[first[k]:first[k + 1]]
        many = edge[term[mine] + 1] - edge[term[mine]]
        row = np.zeros(len(mark), np.int64)
        cuts = np.searchsorted(np.cumsum(many), np.arange(SCATTER, int(many.sum()) + SCATTER, SCATTER), "right")
        low = 0
        for high in [*np.unique(cuts[cuts > 0]), len(mine)]:
            part, width = mine[low:high], many[low:high]
            low = high
            if not len(part):
                continue
            at = np.repeat(edge[term[part]] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
            a, a0 = np.repeat(p[part], width), np.repeat(zero[part], width)
            b, b0 = p[at], zero[at]
            np.add.at(row, group[at], apart(a, b) - apart(a, b0) - apart(a0, b) + apart(a0, b0))
        hit = names[row[names] != 0]
        out[0].append(np.full(len(hit), me)), out[1].append(hit), out[2].append(row[hit])
    own, peer, value = (np.concatenate(c) for c in out)
    return pa.table({"lang": pa.array([lang] * len(own), pa.string()), "own": pa.array(own.astype(np.int32)), "peer": pa.array(peer.astype(np.int32)), "value": pa.array(value)})


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_texts: int = LEAST_TEXTS,
                      top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: per group every other source of the language (``pair``) by the divergence over all
    kept terms, and its ``top`` terms (``term``) that it uses more than the language does, by what they add to the divergence from it.

    Null text, language and source count as empty ones; an empty name is a name like others. Rank 1 is the largest value, ties go to the smaller
    item in the order of UTF-8 bytes. Every (language, source) that occurs is a group, also without terms; without a kept term all pairs
    are 0. Repeated rows count each, texts of any length are counted whole, an empty table gives no rows; other columns are not read. The
    output holds all pairs of the sources of a language, so it grows with their square, and so do the partial sums of a block.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = cut(term_counts(df, text, lang, source))
    kept = counted.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sum("n").alias("all")).where(F.col("texts") >= least_texts).select("lang", "term", "all")
    kept = cut(kept)
    own = cut(counted.drop("texts").join(kept, ["lang", "term"]))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all").alias("lang_total"))
    # one row per group; numbers are dense within a language
    groups = df.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = F.lit(0).cast("long")
    groups = cut(groups.select("lang", "source", "number", F.coalesce("kinds", zero).alias("kinds"), (F.coalesce("total", zero) + F.coalesce("kinds", zero)).alias("whole"),
                               (F.coalesce("lang_total", zero) + F.coalesce("kinds", zero)).alias("lang_whole")))
    entries = cut(own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "all", "number", "whole", "lang_whole"))

    sizes = entries.groupBy("lang", "number", "n").agg(F.count("*").alias("terms")).groupBy("lang", "number").agg(F.collect_list(F.struct("n", "terms")).alias("counts"))
    rows = groups.where("kinds > 0").join(sizes, ["lang", "number"], "left").withColumn("counts", F.coalesce("counts", F.expr("cast(array() as array<struct<n: bigint, terms: bigint>>)")))
    rows = cut(rows.select("lang", "number", "whole", "kinds", "counts", F.floor(F.col("number") / 64).alias("block")))
    blocks = rows.select("lang", F.col("block").alias("b")).distinct()
    mine = rows.groupBy("lang", "block")
    all_peers = rows.select(*[F.col(c).alias(c) for c in ("lang", "number", "whole", "kinds", "counts")]).join(blocks, "lang").groupBy("lang", "b")
    kind = "lang string, own int, peer int, value long"
    base = mine.cogroup(all_peers).applyInArrow(_baseline, kind)
    parts = 1 + entries.count() // block_postings
    index = entries.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"), "term", "number", "n", "whole")
    both = index.groupBy("lang", "part").applyInArrow(_scatter, kind)
    values = base.unionByName(both).groupBy("lang", "own", "peer").agg(F.sum("value").alias("value")).where("own <> peer")
    # languages without a kept term have no baseline: their pairs are 0
    name = groups.select("lang", F.col("number").alias("own"), "source")
    bare = groups.where("kinds = 0").select("lang", F.col("number").alias("own"))
    flat = bare.join(bare.select("lang", F.col("own").alias("peer")), "lang").where("own <> peer").withColumn("value", zero)
    pairs = values.unionByName(flat.select("lang", "own", "peer", "value")).join(name, ["lang", "own"]).join(
        name.select("lang", F.col("own").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    used = entries.withColumn("p", _share("n", "whole")).withColumn("q", _share("`all`", "lang_whole")).where("p > q")
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
