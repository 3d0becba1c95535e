"""Quality rules on how far a document's distributions lie from those of its language.

Two histograms are held against references gathered from all documents of the same ``lang``: character
classes (upper case, symbols, punctuation, spaces, the extra bytes of non-ASCII characters, the rest) and the most common words (one bin each, and one for all other words). The distance is Jensen-Shannon's,
the square root of the divergence in bits, 0 to 1. Short documents have noisy histograms, so each
distance rejects from its own number of words on. Only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import cut

SYMBOLS = r"[#*$%&|<>]"
CLASSES = 6
MOST_BROADCAST = 10_000  # languages of about one KB each
SHARE_DIGITS = 4  # of the shares that medians are taken from: 10,001 different ones at most, however many documents


@dataclass(frozen=True)
class Rules:
    common_words: int = 16
    character_guard: int = 20
    character_distance: float = 0.16
    word_guard: int = 50
    word_distance: float = 0.33
    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30


def _spaced(text: Column) -> Column:
    """The text with every other separator as a space; null is empty. Plain replacements, no pattern."""
    return reduce(lambda c, gap: F.replace(c, F.lit(gap), F.lit(" ")), "\t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))


def _doubled(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long, from those of runs of ``step`` words; the last ones lack a partner."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.transform(F.array(value), use)[0]


def _covered(runs: Column, size: int) -> Column:
    """Words inside runs that occur twice or more.

    Sorting (hash, position) brings equal runs together. In order of position each repeated run then adds
    the words since the last one, ``size`` at most.
    """
    pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    repeated = _once(pairs, lambda p: F.array_sort(F.transform(
        F.filter(p, lambda x, k: same(p, x, k - 1) | same(p, x, k + 1)), lambda x: x["i"])))
    return F.aggregate(
        repeated, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def measures(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df``'s columns packed as ``row``, with the text, its ``spaced`` form and the base counts."""
    if rules.window & (rules.window - 1):
        raise ValueError("the window must be a power of two, since runs are doubled")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"), _spaced(F.col(text)).alias("spaced"))
    packed = packed.withColumn("words", F.array_remove(F.split("spaced", " "), ""))
    packed = packed.withColumn("runs", F.when(F.size("words") >= rules.window, F.transform("words", lambda w: F.xxhash64(w))))
    step = 1
    while step < rules.window:
        packed = packed.withColumn("runs", _doubled(F.col("runs"), step))
        step *= 2
    packed = packed.withColumn("runs", F.slice("runs", 1, F.greatest(F.size("words") - (rules.window - 1), F.lit(0))))
    packed = packed.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return packed.select(
        "row", "body", "spaced", F.size("words").cast("long").alias("n_words"),
        F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("runs") > F.size(F.array_distinct("runs")), _covered(F.col("runs"), rules.window)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


def with_classes(measured: DataFrame) -> DataFrame:
    """Adds ``classes``, the shares of the character classes; letters and digits are the rest."""
    counted = measured.withColumns({"upper": F.regexp_count("body", F.lit(r"\p{Lu}")), "marks": F.regexp_count("body", F.lit("[.,;:!?]"))})
    chars, at_least_one = F.length("body"), F.greatest(F.octet_length("body"), F.lit(1))
    spaces, extra = chars - F.col("word_chars"), F.octet_length("body") - chars
    rest = F.greatest(F.col("word_chars") - F.col("upper") - F.col("marks") - F.col("n_symbols"), F.lit(0))
    return counted.withColumn("classes", F.array(*[c / at_least_one for c in (F.col("upper"), F.col("n_symbols"), F.col("marks"), spaces, extra, rest)])).drop("upper", "marks")


def _padded(spaced: Column) -> Column:
    """Lower-cased words, each between two bars, so that counting a word is counting ``|word|``."""
    return F.concat(F.lit("|"), F.replace(F.replace(F.lower(spaced), F.lit("|"), F.lit("")), F.lit(" "), F.lit("||")), F.lit("|"))


def references(measured: DataFrame, lang: str, rules: Rules = Rules()) -> DataFrame:
    """Per language the median share of each class over its documents (so that junk does not move it), and
    its most common words with their counts and the count of all.

    Gathered from all words of all documents; a null language is a language of its own. Ties go to the smaller word. The medians are
    exact for shares of ``SHARE_DIGITS`` digits, so they don't depend on the partitioning. No document, no reference.
    """
    own = with_classes(measured).select(F.col(f"row.`{lang}`").alias("lang"), "n_words", "classes", "spaced")
    classes = own.groupBy("lang").agg(F.sum("n_words").cast("double").alias("all_words"), F.array(*[F.percentile(F.round(F.col("classes")[k], SHARE_DIGITS), F.lit(0.5)) for k in range(CLASSES)]).alias("ref_classes"))
    words = own.select("lang", F.explode(F.split(F.replace(F.lower("spaced"), F.lit("|"), F.lit("")), " ")).alias("word")).where((F.col("word") != ""))
    counted = words.groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rules.common_words)
    listed = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "count"))).alias("t"))
    listed = listed.select("lang", F.col("t.word").alias("ref_words"), F.col("t.count").alias("ref_counts"))
    return classes.join(listed.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of the same length; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    def term(x, y):
        m = (x + y) / 2
        return (part(x, m) + part(y, m)) / 2
    sp, sq = total(p), total(q)
    scaled = lambda a, s: F.transform(a, lambda x: x / s)
    got = F.aggregate(F.zip_with(scaled(p, sp), scaled(q, sq), term), F.lit(0.0), lambda s, x: s + x)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(got, F.lit(0.0))))


def divergence_rules(df: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """All columns of ``df`` in ``row``, with base counts, both distances, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules; so do texts under ``least_words`` words or
    with over ``repeat_percent`` % of words in repeated runs. Repeated rows get equal results, a null ``lang`` is
    compared with the documents of null ``lang``. A distance that can't be told (no reference) rejects nothing. An empty table gives an empty
    one; very long texts are read whole, one row each; clashing column names lie inside ``row`` and do no harm.
    """
    measured = measures(df, text, rules)
    ref = cut(references(measured, lang, rules).withColumnRenamed("lang", "ref_lang"))
    if ref.count() <= MOST_BROADCAST:
        ref = F.broadcast(ref)  # about one KB a row; beyond that a join by language
    joined = with_classes(measured).withColumn("padded", _padded(F.col("spaced"))).join(ref, F.col(f"row.`{lang}`").eqNullSafe(F.col("ref_lang")), "left")
    size = lambda w: F.regexp_count("padded", F.concat(F.lit(r"\|\Q"), w, F.lit(r"\E\|"))).cast("double")
    hits = F.transform("ref_words", size)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    joined = joined.withColumn("hits", hits)
    other = F.greatest(F.col("n_words").cast("double") - total(F.col("hits")), F.lit(0.0))
    ref_counts = F.transform("ref_counts", lambda x: x.cast("double"))
    word_distance = _distance(F.concat("hits", F.array(other)), F.concat(ref_counts, F.array(F.col("all_words") - total(ref_counts))))
    judged = joined.withColumns({
        "character_distance": _distance(F.col("classes"), F.col("ref_classes")), "word_distance": word_distance, "base_failed": base_failed(rules)})
    above = lambda name, most, guard: (F.coalesce(F.col(name), F.lit(0.0)) > most) & (F.col("n_words") >= guard)
    far = above("character_distance", rules.character_distance, rules.character_guard) | above("word_distance", rules.word_distance, rules.word_guard)
    return judged.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "character_distance", "word_distance", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"))
