"""Token counts, byte-level BPE, chat formatting, language identification and quality rules on small tables."""

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pytest

from kinfold.llm import byte_bpe, chat, langid, prefix_tokens, quality
from kinfold.llm.vocabulary import byte_encoding

DOCS = "doc_id long, text string, lang string, words long, row string"
ODD = [
    (1, None, "en", 0, "a"), (2, "", "en", 0, "b"), (3, " \t\n ", None, 0, "c"), (4, "<s> ▁▁ <0x41> é梦😀\x00 don't  stop\n\n", "en", 1, "d"),
    (5, "a" * 5000, "en", 1, "e"), (5, "a" * 5000, "en", 1, "e"), (None, "x  y   z " * 300, "fr", 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_every_prefix_count_is_the_librarys():
    own = prefix_tokens.PrefixCounter()
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("  \n▁tehanoiésß梦é1<s>_\t\x00😀 ") for _ in range(rng.randint(0, 30)))
        counts = np.frombuffer(own.changes(text), np.int8).cumsum()
        assert [len(own.library.encode(text[:k])) for k in range(1, len(text) + 1)] == counts.tolist()


def test_prefix_counts_of_odd_rows(spark, odd):
    own = prefix_tokens.counter(prefix_tokens.MODEL)
    got = odd.withColumn("p", prefix_tokens.prefix_changes("text")).select("text", "p.*").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["n_tokens"] == len(own.library.encode(r["text"] or "")) and len(r["changes"]) == len(r["text"] or "")


def test_truncation_and_budget_questions(spark):
    own = prefix_tokens.counter(prefix_tokens.MODEL)
    text = "the quick brown fox jumps over it"
    df = spark.createDataFrame([(text, 7, 4)], "text string, k long, budget long").withColumn("p", prefix_tokens.prefix_changes("text"))
    df = df.select("*", "p.changes")
    r = df.select(prefix_tokens.tokens_at("changes", "k").alias("at"), prefix_tokens.longest_within("changes", "budget").alias("within")).first()
    assert r["at"] == len(own.library.encode(text[:7]))
    assert r["within"] == max(k for k in range(len(text) + 1) if len(own.library.encode(text[:k])) <= 4)


def test_chunks_are_stitched_exactly(spark, odd):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", " of", "\n", "  ", "é", "12", "'ll", "!?", "😀", " x"]) for _ in range(rng.randint(0, 3000))) for _ in range(30)]
    df = odd.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(100 + i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string"))
    got = byte_bpe.encode(df, chunk=500, overlap=40).withColumn("raw", byte_bpe.decode("ids")).collect()
    assert len(got) == len(ODD) + len(texts)
    for r in got:
        want = byte_encoding(byte_bpe.RANKS).encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want) and bytes(r["raw"]) == (r["text"] or "").encode()


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert byte_bpe.encode(none).count() == 0
    assert none.select(prefix_tokens.prefix_changes("text")).count() == 0
    assert quality.divergence_rules(none).count() == 0
    assert langid.train(none) == {}
    assert none.select(langid.predict({}, "text")).count() == 0


def test_template_language():
    run = lambda source, messages=(): "".join(t for t, _ in chat.compiled(source)(messages))
    assert run("{{ 'a' ~ (1 + 2) }}{% if 1 == 2 %}x{% else %}y{% endif %}") == "a3y"
    two = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]
    source = "{% for m in messages %}{{ loop.index }}{{ m.role | upper }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}"
    assert run(source, two) == "1USER,2ASSISTANT."
    assert run("{% for m in messages %}{{ loop.previous.role }}-{% endfor %}", iter(two)) == "-user-"
    assert chat.fold(chat._Parser("a{{ 'b' }}{% if false %}x{% endif %}c").body()[0]) == [chat.Output(chat.Const("abc"))]
    for bad in ("{{ m.__class__ }}", "{{ messages }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ a | exec }}", "{{ open() }}", "{{ 'a }}",
                "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% include 'x' %}",
                "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\\nnp>ai") for _ in range(rng.randint(0, 14)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_line(chat.escape_line(text)) == text and "\n" not in chat.escape_line(text)


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_conversations_read_back(spark, piece):
    rows = [(1, 1, "assistant", "ok <|im_end|>\n"), (1, 0, "user", None), (2, 0, None, "a\\|b"), (2, 0, None, "a\\|b"), (None, None, "assistant", ""),
            (3, 0, "a\nb|c", "<|im_start|>assistant\nx<|im_end|>\n" * 20), (3, 1, "assistant", "long " * 40), (3, 2, "assistant", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", rows_literal())
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df, piece_chars=piece)).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] or -9, r[1] or -9, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def rows_literal():
    from pyspark.sql import functions as F

    return F.lit("a column that clashes with one of the result")


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "of", "house", "water"], "bb": ["der", "und", "haus", "wasser"]}
    made = lambda code: " ".join(rng.choice(words[code]) for _ in range(40))
    train = spark.createDataFrame([(made(c), c) for c in words for _ in range(40)] + [("x", None), (None, "aa"), ("", "bb")], "text string, lang string")
    learned = langid.train(train)
    assert learned == langid.train(train.repartition(7)) and set(learned) == {"aa", "bb"}
    texts = [(made(c), c) for c in words for _ in range(10)] + [(None, "und"), ("", "und"), ("123 !?", "und"), (made("aa") * 3000, "aa")]
    got = spark.createDataFrame(texts, "text string, want string").select("want", langid.predict(learned, "text").alias("p")).select("want", "p.*").collect()
    assert all(r["want"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)


def test_quality_counts_and_rules(spark, odd):
    rng = random.Random(4)
    clean = [(10 + i, " ".join(rng.choice(["the", "of", "water", "House", "runs,", "green", "sky."]) + rng.choice("abcdefgh") for _ in range(120)), "en", 9, "z") for i in range(30)]
    junk = [(90, "### *** %%% " + " ".join(f"w{i}x*** $$$" for i in range(60)), "en", 9, "z"), (91, "one two three four five six seven eight nine ten\n" * 9, "en", 9, "z")]
    got = quality.divergence_rules(odd.unionByName(spark.createDataFrame(clean + junk, DOCS))).select("row.doc_id", "row.text", "*").collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in got:
        text = r["text"] or ""
        w = word.findall(text)
        runs = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        own = [x for x in text.split("\n") if word.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(own) - len(set(own)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[10 + i] for i in range(30)) and not kept[90] and not kept[91] and not kept[1] and not kept[2]


def test_common_words_may_have_any_length(spark):
    rng = random.Random(5)
    common, rare = ["क्योंकि", "विश्वविद्यालय", "अंतर्राष्ट्रीय"], ["परीक्षा", "पुस्तकालय", "स्वतंत्रता", "प्रधानमंत्री"]
    fine = [(i, " ".join(rng.choice(common) if k % 2 else rng.choice(rare) + str(rng.randrange(10**6)) for k in range(100)), "hi", 9, "z") for i in range(20)]
    odd = [(90, " ".join(rng.choice(rare) + str(rng.randrange(10**6)) for k in range(100)), "hi", 9, "z")]
    got = {r["doc_id"]: r for r in quality.divergence_rules(spark.createDataFrame(fine + odd, DOCS)).select("row.doc_id", "*").collect()}
    assert got[90]["word_distance"] > 0.33 and not got[90]["kept"] and not got[90]["base_failed"]
    assert all(got[i]["word_distance"] < 0.33 for i in range(20))
