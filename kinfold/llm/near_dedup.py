"""Near-duplicate documents with HyperMinHash sketches.

A document's set holds its distinct runs of five lower-cased words. Each shingle hash falls into one of 128
buckets; a bucket keeps, of its smallest hash, the number of leading zeros and some bits behind the
first one (26 by default, so a register takes four bytes). Equal sets are one class from the start. Bands
of five registers propose candidates; the share of equal registers, less the expected chance collisions,
estimates the Jaccard similarity and drops what lies five standard errors below the threshold; all others are
confirmed on the full sets.

Groups of near copies may be very large, so candidates are not all pairs of a band's bucket. In each
round every member is compared with one leader of its bucket only, and found links are contracted to
components; then buckets whose members are all in one component are done, since further links inside
it change nothing. What is left after the leader rounds is compared in full across components, so no
candidate is lost.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.llm.hashing import U, mixed, pieces, shingle_hashes, text_bytes, word_hashes
from kinfold.operators.graph import components
from kinfold.session import cut

SHINGLE = 5
BUCKET_BITS = 7
MANTISSA_BITS = 26
ROWS = 5
LEADERS_TRIED = 2
SMALL = 64
BLOCK = 2_048
BLOCK_SHINGLES = 2_000_000
MOST_BROADCAST = 500_000  # ids of a few bytes
CHUNK = 2_048
ERRORS = 5.0


def registers(sets: list[np.ndarray], mantissa: int = MANTISSA_BITS) -> np.ndarray:
    """One row of 128 registers per sorted set of hashes; 0 marks an empty bucket.

    The bucket is the top seven bits, so in a sorted set each bucket's smallest hash comes first.
    """
    rest_bits = 64 - BUCKET_BITS
    out = np.zeros((len(sets), 1 << BUCKET_BITS), np.uint32)
    if not sets:
        return out
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    doc = np.repeat(np.arange(len(sets)), sizes)
    all_hashes = np.concatenate(sets)
    bucket = (all_hashes >> U(rest_bits)).astype(np.int64)
    cell = doc << BUCKET_BITS | bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = (all_hashes[first] & U((1 << rest_bits) - 1)) | U(1)
    top = np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)  # position of the first one
    top -= (rest >> top.astype(U)) == 0  # rounding up to the next power of two
    zeros = rest_bits - 1 - top
    behind = np.where(top >= mantissa, rest >> np.maximum(top - mantissa, 0).astype(U), rest << np.maximum(mantissa - top, 0).astype(U))
    value = (np.minimum(zeros + 1, 63).astype(U) << U(mantissa)) | (behind & U((1 << mantissa) - 1))
    out.reshape(-1)[cell[first]] = value
    return out


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of registers; 0 where all of its registers are empty."""
    bands = regs.shape[1] // rows
    cells = regs[:, :bands * rows].reshape(len(regs), bands, rows).astype(U)
    key = np.arange(1, bands + 1, dtype=U)[None, :] * np.ones((len(regs), 1), U)
    for k in range(rows):
        key = mixed((key + cells[:, :, k]) * U(0x9E3779B97F4A7C15))
    return np.where(cells.any(2), key | U(1), U(0))


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, offsets = text_bytes(texts)
    for low, high in pieces(offsets):
        part = raw[offsets[low]:offsets[high]]
        found, first = shingle_hashes(*word_hashes(part, offsets[low:high + 1] - offsets[low]), size)
        yield low, [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:])]


def sketches(df: DataFrame, key: str, text: str, rows: int = ROWS, mantissa: int = MANTISSA_BITS, size: int = SHINGLE) -> DataFrame:
    """``(key, n_shingles, set_key, registers, bands)`` per row; null texts have the empty set."""

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, sets in _sets(batch.column(1), size):
                regs = registers(sets, mantissa)
                keys = band_keys(regs, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array([k[k != 0] for k in keys], pa.list_(pa.int64()))],
                    names=[key, "n_shingles", "set_key", "registers", "bands"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        sketch, f"`{key}` {kind}, n_shingles long, set_key binary, registers binary, bands array<long>")


def _estimate(pairs: DataFrame, share: float, mantissa: int, kind: str) -> DataFrame:
    """Keep pairs whose estimated similarity can belong to a true link, with the estimate."""

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            used = ((a > 0) | (b > 0)).sum(1)
            chance = 0.169919487159739 * 2.0 ** -mantissa * 4 * na * nb / (na + nb) ** 2
            found = (((a == b) & (a > 0)).sum(1) - used * chance) / used
            keep = found >= share - ERRORS * np.sqrt(share * (1 - share) / used)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(found[keep])], names=["a", "b", "estimate"])

    return pairs.mapInArrow(estimate, f"a {kind}, b {kind}, estimate double")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on the full sets."""

    def confirm(batches):
        own, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "sa", "sb"))):
                if own != (a, x):
                    own, left = (a, x), np.frombuffer(x, U)
                right = np.frombuffer(y, U)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("members").alias("sb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("members").alias("sa")), "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(confirm, f"a {kind}, b {kind}").distinct()


def _spanning(near: np.ndarray, labels: list) -> list[tuple[int, int]]:
    """Of the near pairs of a block, enough to join the components that they join."""
    parent = {c: c for c in labels}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    kept = []
    for i, j in near:
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def _dense_links(hot: DataFrame, full: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links between the components inside groups of documents that meet in large buckets.

    ``hot`` holds ``(band, id, component, n_shingles)``. The buckets' stars are joined to groups; a group is cut into blocks of
    about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles, and each pair of blocks is compared exactly as a product of token matrices.
    Only links that join components leave a task, so the output grows with the documents, not with their pairs.
    """
    lead = hot.groupBy("band").agg(F.min("id").alias("a"))
    group = cut(components(hot.join(lead, "band").select("a", F.col("id").alias("b")).distinct(), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group")))
    member = hot.select("id", "component", "n_shingles").distinct().join(group, "id")
    parts = member.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    member = member.drop("n_shingles").join(parts, "group").join(full, "id")
    member = member.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "group", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component", "members")

    def compare(block: pa.Table) -> pa.Table:
        ids, labels = block.column("id").to_pylist(), block.column("component").to_pylist()
        own, p, q = (block.column(c).to_numpy() for c in ("own", "p", "q"))
        sets = [np.frombuffer(x, U) for x in block.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        doc = np.repeat(np.arange(len(sets)), sizes)
        _, token, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = uses[token] > 1
        column = np.cumsum(uses > 1) - 1
        doc, token = doc[often], column[token[often]]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, CHUNK):
            at = slice(*np.searchsorted(token, (low, low + CHUNK)))
            grid = np.zeros((len(sets), CHUNK), np.float32)
            grid[doc[at], token[at] - low] = 1
            both += grid[left] @ grid[right].T
        both = both.astype(np.int64)
        number = {c: k for k, c in enumerate(dict.fromkeys(labels))}
        lab = np.array([number[c] for c in labels])
        near = (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)) & (lab[left][:, None] != lab[right][None, :])
        kept = _spanning(np.stack([left[np.nonzero(near)[0]], right[np.nonzero(near)[1]]], 1), labels)
        return pa.table({"a": pa.array([ids[i] for i, _ in kept], block.schema.field("id").type), "b": pa.array([ids[j] for _, j in kept], block.schema.field("id").type)})

    return dealt.groupBy("group", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, rows: int = ROWS,
                    mantissa: int = MANTISSA_BITS, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: ``(key, n_shingles, component_id, kept)``.

    ``component_id`` is the smallest key that can be reached over links of at least ``percent`` / 100, ``kept`` says
    that it is the row's own. Empty and null texts have no shingles and link with nothing. Repeated rows
    get the same component; rows sharing a key count as one document. Rows with a null key link with
    nothing, their component is null and they are kept. Further columns are not read. An empty table gives an empty one; texts of
    any length are hashed whole, one at a time.
    """
    kind = df.schema[key].dataType.simpleString()
    base = cut(sketches(df, key, text, rows, mantissa, size).withColumnRenamed(key, "id"))
    usable = base.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = cut(usable.groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "registers", "bands")).alias("r")).select("set_key", "r.*"))
    exploded = classes.select("id", "n_shingles", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = cut(exploded.join(shared.select("band"), "band").distinct())
    regs = classes.select("id", F.col("registers"), F.col("n_shingles").alias("n"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def full_sets(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, sets in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([ids.slice(low, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    # the full sets of all documents that share a bucket, once for every round
    ids = cut(members.select("id").distinct())
    near_ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids  # beyond that the texts are shuffled
    full = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(near_ids, "id")
    full = cut(full.mapInArrow(full_sets, f"id {kind}, members binary"))

    def confirmed(met: DataFrame, best: int | None) -> DataFrame | None:
        """Links among the met pairs ``(a, b, na, nb)``; with ``best``, of each ``b`` only the most likely are tried."""
        met = met.where(near).distinct()
        met = met.join(regs.select(F.col("id").alias("a"), F.col("registers").alias("ra")), "a").join(
            regs.select(F.col("id").alias("b"), F.col("registers").alias("rb")), "b").select("a", "b", "na", "nb", "ra", "rb")
        likely = _estimate(met, percent / 100, mantissa, kind)
        if best is not None:
            order = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
            likely = likely.withColumn("k", F.row_number().over(order)).where(F.col("k") <= best)
        likely = cut(likely.select("a", "b"))
        if likely.isEmpty():
            return None
        return cut(_confirm(likely, full, percent, kind))

    def labelled(links: DataFrame) -> DataFrame:
        return cut(components(links, "a", "b").select(F.col("node").alias("id"), "component"))

    # every member with two leaders of each of its buckets
    orders = (F.struct("id"), F.struct(F.xxhash64("id", "band"), F.col("id")))
    lead = cut(members.groupBy("band").agg(*[F.min_by(F.struct("id", "n_shingles"), o).alias(f"l{k}") for k, o in enumerate(orders)]))
    met = reduce(DataFrame.unionByName, [
        members.join(lead, "band").where(F.col("id") != F.col(f"l{k}.id")).select(
            F.col(f"l{k}.id").alias("a"), F.col("id").alias("b"), F.col(f"l{k}.n_shingles").alias("na"), F.col("n_shingles").alias("nb"))
        for k in range(len(orders))])
    links = confirmed(met, LEADERS_TRIED)
    label = None if links is None else labelled(links)
    # what lies in different components then
    current = members.withColumn("component", F.col("id")) if label is None else members.join(label, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_bands = current.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    current = cut(current.join(open_bands.select("band", "c"), "band"))
    hot = current.where(F.col("c") > SMALL).select("band", "id", "component", "n_shingles")
    few = current.where(F.col("c") <= SMALL)
    other = few.select(F.col("band").alias("o"), F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"))
    rest = few.join(other, (F.col("band") == F.col("o")) & (F.col("component") < F.col("cb"))).select(
        F.col("id").alias("a"), "b", F.col("n_shingles").alias("na"), "nb")
    found = [confirmed(rest, None)]
    if not hot.isEmpty():
        found.append(cut(_dense_links(hot, full, percent, kind)))
    found = [f for f in found if f is not None and not f.isEmpty()]
    if found:
        label = labelled(reduce(DataFrame.unionByName, found if links is None else [links, *found]))
    reps = classes.select("set_key", F.col("id").alias("rep"))
    if label is not None:
        reps = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    else:
        reps = reps.select("set_key", F.col("rep").alias("component"))
    # repeated rows aside, a class of one document that has no link needs no lookup; the rest joins by class
    return base.select("id", "n_shingles", "set_key").join(reps, "set_key", "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when((F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("id")).alias("c")).select(
        key, "n_shingles", F.when(F.col(key).isNotNull(), F.col("c")).alias("component_id"),
        F.coalesce(F.col(key) == F.col("c"), F.lit(True)).alias("kept"))
