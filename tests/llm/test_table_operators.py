"""Deduplication, mixing, neighbours, archives and the pipeline against brute force on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import ann, lines, mixing, near_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def changed(rng, words, k):
    words = words.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = text(rng, 1)
    return " ".join(words)


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def grouped(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # large buckets are compared in blocks
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(1)
    base = text(rng, 120)
    rows = [(i, changed(rng, base, rng.randint(0, 4))) for i in range(70)] + [(100 + i, text(rng, rng.randint(1, 80))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a  B"), (205, base), (205, base), (206, text(rng, 20_000))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, band string, component long")
    got = near_dedup.near_duplicates(df).collect()
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = grouped(ids, near)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    one = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((str(r["component_id"]), r["kept"]) for r in one) == [("1", True), ("None", True), ("None", True)]


def test_register_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2 ** 63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[500:], rng.integers(0, 2 ** 63, 500, dtype=np.uint64) * np.uint64(2))))
    regs = near_dedup.registers([a, b, a[:0]])
    assert abs((regs[0] == regs[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.16
    assert not regs[2].any() and not near_dedup.band_keys(regs)[2].any()


def test_lines_keep_one_of_each_group(spark):
    rng = random.Random(2)
    line = text(rng, 60)
    near = changed(rng, line, 1)
    rows = [(3, "short\n" + line + "\nshort"), (1, line.upper() + "!\nown " + text(rng, 30)), (2, near), (4, None), (5, ""), (6, line), (6, line), (7, "a\n\n" + text(rng, 3000) + "\n"),
            (None, text(rng, 30))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, line long, gone string")
    got = collections.defaultdict(list)
    for r in lines.dedupe_lines(df).select("row.doc_id", "row.text", "kept_text", "n_lines", "n_removed").collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["n_removed"] == 0 and got[3][0]["kept_text"] == "short\nshort" and got[6][0]["kept_text"] == "" and len(got[6]) == 2
    assert got[4][0]["kept_text"] is None and got[5][0]["kept_text"] == "" and got[7][0]["kept_text"] == got[7][0]["text"]
    # the near line goes exactly if its SimHash lies within the bits
    texts = [line.upper() + "!", near]
    raw = "\n".join(texts).encode()
    from kinfold.llm.hashing import word_hashes
    raw8 = np.frombuffer(raw, np.uint8)
    sims = lines.simhashes(*word_hashes(raw8, np.array([0, len(texts[0].encode()) + 1, len(raw)]), lines.GAPS))
    within = bin(int(sims[0]) ^ int(sims[1])).count("1") <= lines.BITS
    assert (got[2][0]["n_removed"] == 1) == within
    assert lines.dedupe_lines(df.limit(0)).count() == 0


def test_line_groups_equal_brute_force(spark):
    rng = random.Random(6)
    base = [text(rng, 50) for _ in range(4)]
    pool = [changed(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(80)]
    rows = [(i, "\n".join(pool[4 * i:4 * i + 4])) for i in range(20)]
    from kinfold.llm.hashing import word_hashes

    def sim(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return int(lines.simhashes(*word_hashes(raw, np.array([0, len(raw)]), lines.GAPS))[0])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    sims = [sim(t) for t in pool]
    close = [(a, b) for a in range(80) for b in range(a + 1, 80) if bin(sims[a] ^ sims[b]).count("1") <= 3]
    group = grouped(range(80), [(a, b) for a, b in close if distance(pool[a], pool[b]) <= int(max(len(pool[a]), len(pool[b])) * 0.2 + 1e-9)])
    want = {i: "\n".join(pool[k] for k in range(4 * i, 4 * i + 4) if group[k] == k) for i in range(20)}
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "kept_text").collect()}
    assert got == want


@pytest.mark.parametrize("words, changes", [((6, 14), 1), ((15, 30), 2), ((40, 60), 3)])
def test_near_lines_are_found_by_bands(spark, words, changes):
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 100:
        a = text(rng, rng.randint(*words))
        b = changed(rng, a, changes)
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        if len(a) >= 20 and a != b and lines.edit_distance(a, b, most) <= most:
            pairs.append((a, b))
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, b) in enumerate(pairs)], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedupe_lines(df, search="bands").select("row.doc_id", "n_removed").collect()}
    assert sum(removed[1000 + i] for i in range(100)) >= 97 and not any(removed[i] for i in range(100))


def test_short_lines_go_where_equal(spark):
    docs = spark.createDataFrame(
        [(1, "Next!\nown words of one\n--\n\n--"), (2, "next\nnexa\n--\né"), (3, "é\nx\nX\n")], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {1: "Next!\nown words of one\n--\n\n--", 2: "nexa\n--\né", 3: "x\n"}


def test_common_grams_bound_the_distance():
    rng = random.Random(12)
    xs, ys = (["".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))) for _ in range(1000)] for _ in range(2))
    most = np.array([rng.randint(0, 6) for _ in xs])
    assert all(ok or lines.edit_distance(x, y, m) > m for x, y, m, ok in zip(xs, ys, most.tolist(), lines.alike(xs, ys, most)))


def test_mix_meets_its_rules(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(700, None, "a"), (701, "", None), (5, "x y", "d")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, place long")
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    by = collections.defaultdict(list)
    sources = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    for r in got:
        by[sources[r["doc_id"], r["size"]]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert len(got) == len(rows) and abs(sum(v[0]["target"] for v in by.values()) - sum(r["size"] for r in got)) < 1
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
        assert own[0]["target"] <= 3 * own[0]["source_size"]
    assert mixing.mix(df.limit(0)).count() == 0


def test_neighbours_have_high_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1500, 16)).astype(np.float32)
    points[300:340] = points[7]
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0, 2.0]), (2500, []), (0, points[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, shard int")
    index = ann.build_index(df, shard_rows=500)
    got = collections.defaultdict(list)
    for r in ann.search(index, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(0, 1500, 100)}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hit += len({i for i, _ in found} & set(best.tolist()))
        assert all(abs(s - d[i]) < 1e-9 for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hit >= 0.9 * 10 * len(got)
    assert ann.search(ann.build_index(df.limit(0)), df).count() == 0
    assert ann.search(index, df.limit(0)).count() == 0


@pytest.mark.parametrize("clusters", [8, 40])
def test_neighbours_are_found_in_tight_clusters(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 64))
    points = (centres[rng.integers(clusters, size=3000)] + rng.normal(scale=0.02, size=(3000, 64))).astype(np.float64)
    graph = ann.Graph(points).build()
    reached = np.zeros(len(points), bool)
    graph._reached(graph.entries, reached)
    assert reached.all()
    asked = np.arange(0, 3000, 20)
    nodes, _ = graph.search(points[asked], ann.SEARCH_BEAM)
    hit = 0
    for q, found in zip(asked, nodes):
        near = np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[:11]
        hit += len(set(near.tolist()) & set(found[:11].tolist()))
    assert hit >= 0.9 * 11 * len(asked)


def test_copies_of_a_vector_are_rows_of_the_index_and_few_candidates_are_all_given(spark):
    df = spark.createDataFrame([(i, [1.0, float(i > 40)]) for i in range(45)], "vec_id long, embedding array<double>")
    index = ann.build_index(df)
    assert index.count() == 45 and index.where("edges is not null").count() == 2
    got = collections.defaultdict(list)
    for r in ann.search(index, df.where("vec_id in (0, 3, 44)")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[3] == [(i, 0.0) for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)]
    assert got[44] == [(i, 0.0) for i in (41, 42, 43)] + [(i, 1.0) for i in range(7)]
    few = df.where("vec_id > 41")
    assert [r["vec_id"] for r in ann.search(ann.build_index(few), few.where("vec_id = 43")).orderBy("rank").collect()] == [42, 44]


def foreign(block: bytes, kind: str = "response") -> bytes:
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), len(block)) + block + b"\r\n\r\n"


def test_foreign_http_headers_of_any_length(spark, tmp_path):
    body = "päge\r\n\r\nmore".encode()
    heads = [b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 5_000, b"HTTP/1.1 200 OK\r\nX-Name: " + "é".encode() * 4_000, b"HTTP/1.1 200 OK"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc").write_bytes(b"".join(foreign(h + b"\r\n\r\n" + body) for h in heads))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert [(r["payload_bytes"], r["payload_digest"]) for r in got] == [(len(body), hashlib.sha1(body).hexdigest())] * 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.warc").write_bytes(foreign(b"HTTP/1.1 200 OK\r\nno blank line"))
    with pytest.raises(Exception, match="without an HTTP header"):
        warc.read(spark, str(tmp_path / "b")).collect()


def test_archives_read_back_whole(spark):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"u{i}", fake * (i % 5) + "é" * (i % 400)) for i in range(60)] + [
        (-5, None, None), (700, "a\r\nb", ""), (701, "z", fake * 30), (702, "z", fake * 30), (703, "q", "WARC/1.1\r\n" * 3), (704, "q", "\r\n\r\n" * 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size long").repartition(3)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = collections.Counter(map(tuple, warc.archive_round_trip(df).collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    top = collections.defaultdict(list)
    for i, _, t in rows:
        top[sha(t)].append(i)
    want = collections.Counter()
    for i, _, t in rows:
        size, again = len((t or "").encode()), len((t or "").encode()) >= 1000 and i < max(top[sha(t)])
        want[(i, size, sha(t), "revisit" if again else "response", max(top[sha(t)]) if again else None)] += 1
    assert got == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_with_very_long_urls(spark, tmp_path):
    rows = [(i, u, f"page {i} " * 200) for i, u in enumerate(["u", "data:," + "x" * 70_000, "q?" + "é\r\n" * 40_000, "u" * 65_400, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.archive_round_trip(df, str(tmp_path / "a")).collect()}
    assert got == {i: (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}
    targets = {r["target"] for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert targets == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in rows}


def test_a_broken_chain_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(5)], "page_id long, url string, html string")
    path = warc.write(warc.records(df).coalesce(1).withColumn("record", F.replace("record", F.lit("Content-Length: 1"), F.lit("Content-Length: 2"))), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="chain of records"):
        warc.read(spark, path)


def test_pipeline_stages_one_by_one(spark):
    rng = random.Random(8)
    whole = [text(rng, 80) for _ in range(12)]
    shared = text(rng, 25)
    rows = [(i, f"{t}\n{shared}", "en", f"s{i % 3}", 1) for i, t in enumerate(whole)]
    rows += [(50, changed(rng, whole[0], 1), "en", "s0", 1), (51, None, "en", "s1", 1), (52, "", None, None, 1), (53, whole[3] + "\n" + shared, "en", None, 1), (53, whole[3] + "\n" + shared, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    kept = stages["quality_rules"](spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(12)) | {50, 53} and kept.columns == docs.columns
    clean = stages["line_dedup"](spark, kept, "")
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and shared in got[0]["text"] and all(shared not in got[i]["text"] for i in range(1, 12)) and 53 not in got
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    one = stages["near_dedup"](spark, clean, "")
    ids = sorted(r["doc_id"] for r in one.collect())
    left = sorted(got)
    linked = [(a, b) for a in left for b in left if a < b and 100 * len(shingles(got[a]["text"]) & shingles(got[b]["text"])) >= 80 * len(shingles(got[a]["text"]) | shingles(got[b]["text"]))]
    assert ids == sorted(set(grouped(left, linked).values())) and one.columns == docs.columns
    mixed = stages["mix_sources"](spark, one, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(one.withColumn("k", F.xxhash64("doc_id", "text")), key="k").join(
        one.select("doc_id", F.xxhash64("doc_id", "text").alias("k")), "k").collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: c for i, c in copies.items() if c}) and mixed.columns == docs.columns
    last = stages["byte_bpe"](spark, mixed, "").collect()
    assert len(last) == mixed.count() and all(r["same_text"] for r in last)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, none, "").count() == 0


def test_edit_distance_is_levenshteins():
    rng = random.Random(9)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert lines.edit_distance(a, b, 99) == row[-1]
        most = rng.randint(0, 6)
        assert (lines.edit_distance(a, b, most) <= most) == (row[-1] <= most)
