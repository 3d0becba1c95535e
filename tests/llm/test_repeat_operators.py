"""Periodic runs, repeated strings and source divergence against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinfold.llm import divergence, lines, repeats, runs


def all_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 9))
def test_runs_equal_brute_force(texts, period, place):
    texts = [t[:place] + (t[place:place + period] * 6 if t[place:] else []) + t for t in texts]
    first = np.append(0, np.cumsum([len(t) for t in texts]))
    words = np.array([w for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text, start, length, q = runs.find_runs(words, first)
    for k, t in enumerate(texts):
        own = text == k
        assert sorted(zip(start[own].tolist(), length[own].tolist(), q[own].tolist())) == all_runs(t)


def test_grammar_extends_long_repeats_exactly():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, 2000)
    words = np.concatenate((base, base, np.zeros(3000, np.int64), base[:700], [9]))
    sequence = np.concatenate(([-1], words, [-2]))
    grammar = runs.Grammar(sequence)
    assert len(grammar.symbols[-1]) == 3 and len(grammar.symbols) < 200
    a = rng.integers(1, len(words) - 1, 500)
    b = a + rng.integers(1, len(words) - a + 1)
    for x, y, right, left in zip(a, b, grammar.right(a, b), grammar.left(a, b)):
        n = 0
        while sequence[x + n] == sequence[y + n]:
            n += 1
        m = 0
        while sequence[x - 1 - m] == sequence[y - 1 - m]:
            m += 1
        assert (right, left) == (n, m)


def test_collapse_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 40), (4, "a " * 40), (None, "x y " * 9 + "z"), (5, "é b " * 6), (6, "w" * 100_000), (7, "a\x0bA " * 5)]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, runs long, key string")
    got = collections.defaultdict(list)
    for r in runs.collapse_runs(df).withColumn("best", runs.strongest("runs")).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["n_words"] == got[2][0]["n_words"] == got[3][0]["n_words"] == 0 and got[3][0]["collapsed"] == "" and got[1][0]["best"] is None
    assert len(got[4]) == 2 and got[4][0]["collapsed"] == "a" and tuple(got[4][0]["best"]) == (0, 40, 1)
    assert got[None][0]["collapsed"] == "x y z" and tuple(got[None][0]["best"]) == (0, 18, 2)
    assert got[5][0]["collapsed"] == "é b" and got[6][0]["collapsed"] == "w" * 100_000 and got[7][0]["collapsed"] == "a A"
    assert runs.collapse_runs(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "a a a a a a b c c c c c c")], "doc_id long, text string")
    assert tuple(runs.collapse_runs(ties).select(runs.strongest("runs").alias("b")).first()["b"]) == (0, 6, 1)


def test_cover_reaches_every_pair():
    inside = set(repeats.COVER.tolist())
    assert len(inside) == 9
    for r in range(repeats.PERIOD):
        for s in range(repeats.PERIOD):
            d = int(repeats.SHIFT[r, s])
            assert 0 <= d < repeats.PERIOD and {(r + d) % repeats.PERIOD, (s + d) % repeats.PERIOD} <= inside


def test_sample_ranks_order_suffixes():
    x = np.random.default_rng(2).integers(97, 99, 4000).astype(np.uint8)
    x[2000:3500] = x[:1500]
    rank = repeats.sample_ranks(x, 400)
    place = [(p, i) for i, p in enumerate((np.arange(len(x) // 73 + 1)[:, None] * 73 + repeats.COVER).ravel()) if p < len(x) - 700]
    body = x.tobytes()
    place.sort(key=lambda t: body[t[0]:t[0] + 400])
    assert all(rank[a[1]] <= rank[b[1]] or body[a[0]:a[0] + 400] == body[b[0]:b[0] + 400] for a, b in zip(place, place[1:]))


def without_repeats(rows, least=400):
    raw = [(t or "").encode() for _, t in rows]
    many = collections.Counter(b[i:i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for (key, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if many[b[i:i + least]] > 1:
                gone[i:i + least] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((key, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("spans, block", [(1024, 2 << 20), (2, 2 << 20), (1024, 3000)])
def test_repeated_strings_equal_brute_force(spark, spans, block):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 3000))) for _ in range(30)]
    texts = list(base)
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i = rng.randint(0, max(0, len(a) - 300))
        texts.append(b[:200] + a[i:i + rng.randint(380, 900)] + "é" * rng.randint(0, 300) + b[100:600])
    texts += [None, "", "a" * 399, "b" * 400, "c" * 401, base[3], base[3], "xyz" * 500, "q" * 60_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "xyz" * 300)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, kept long, spans string")
    got = repeats.remove_repeats(df, bucket_spans=spans, block_bytes=block).collect()
    assert sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == without_repeats(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def term_rows(rows):
    """The contract read literally, term by term."""
    import re
    pattern = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", pattern.findall((text or "").translate(low))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in collections.Counter(t for d in own for t in set(d[2])).items() if n >= 3]
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        total = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s],
                     "term": [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < 200]
    return sorted(out)


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_source_divergence_equals_brute_force(spark, block):
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "çà"]
    rows = [(" ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(words[:20]).upper() for _ in range(rng.randint(0, 120))),
             rng.choice(["a", "b", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None])) for _ in range(90)]
    rows += [(None, "a", "bare"), ("", "c", "s1"), ("one", "c", "s2"), (None, None, None), ("12 + 3", "d", "s"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string")
    got = sorted(tuple(r) for r in divergence.source_divergence(df, block_postings=block).collect())
    assert got == term_rows(rows)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        whole = rng.randint(1, 8 * 10 ** 15)
        count = rng.randint(0, whole - 1)
        assert int(divergence.shares(np.array([count]), np.array([whole]))[0]) == 1 + 10 ** 9 * (count + 1) // whole


def test_line_segments_find_changed_words(spark):
    """The query's own search against brute force on its definition: an equal segment, few bits that differ, edit similarity."""
    from kinfold.llm.hashing import word_hashes
    rng = random.Random(21)
    pool = []
    for size in (7, 14, 30, 60):
        for _ in range(6):
            base = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(10, 999)}" for _ in range(size)]
            pool.append(" ".join(base))
            for _ in range(4):
                new = list(base)
                for i in rng.sample(range(size), rng.randint(1, 3)):
                    new[i] = f"x{rng.randint(10, 999)}"
                pool.append(" ".join(new))
    rng.shuffle(pool)
    pool = list(dict.fromkeys(pool))

    def signature(line):
        raw = np.frombuffer(line.encode(), np.uint8)
        sim, parts, _ = lines.segment_hashes(*word_hashes(raw, np.array([0, len(raw)]), lines.GAPS))
        return int(sim[0]), set(parts.tolist())

    made = [signature(t) for t in pool]
    label = list(range(len(pool)))
    for a in range(len(pool)):
        for b in range(a + 1, len(pool)):
            most = int(max(len(pool[a]), len(pool[b])) * 0.2 + 1e-9)
            if made[a][1] & made[b][1] and bin(made[a][0] ^ made[b][0]).count("1") <= lines.UNLIKE_BITS and lines.edit_distance(pool[a], pool[b], most) <= most:
                x, y = sorted((label[a], label[b]))
                label = [x if k == y else k for k in label]
    df = spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedupe_lines(df, search="segments", equal_least=1).select("row.doc_id", "n_removed").collect()}
    assert got == {k: int(label[k] != k) for k in range(len(pool))} and sum(got.values()) > 60


def test_a_word_put_in_leaves_an_equal_segment_and_frequent_words_make_none():
    """A line and the same with a word more share a window; lines that only share a word used twice in a segment do not."""
    from kinfold.llm.hashing import word_hashes

    def segments(words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        return set(lines.segment_hashes(*word_hashes(raw, np.array([0, len(raw)]), lines.GAPS))[1].tolist())

    rng = random.Random(5)
    for size in (6, 7, 11, 23, 31, 40, 63, 150, 700):
        base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(size)]
        for at in range(size + 1):
            assert segments(base) & segments([*base[:at], "new", *base[at:]])
    assert not segments("the the one a b c".split()) & segments("the the two d e f".split())
    assert not segments("one two three four five".split())
