"""Language identification by compression.

For every language a raw-content zstandard dictionary is made from a bounded sample of its labelled texts.
A lower-cased text is encoded with each dictionary in pieces of fixed size (so that a long text can't stand in for the
dictionary), and the language with the smallest sum of sizes is chosen. Where the second smallest is hardly
larger, the text is encoded once more at a higher level; if the margin stays narrow, the choice is marked as
rejected. Ties go to the language with more labelled texts, then to the smaller code.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bounds of the sample: pieces per language and characters per piece; and the number of languages.
SAMPLE_TEXTS = 96
SAMPLE_CHARS = 1_024
MOST_LANGUAGES = 1_000
PIECE_CHARS = 1_024
LEVELS = (9, 12)
NARROW = 0.01


def train(df: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language from rows with a text and a language.

    The sample is the ``texts`` different texts of each language with the smallest hashes, ``chars`` characters
    from the middle of each: at most ``texts * chars`` characters a language, whatever the size of the input, and
    the same on every run. Only texts under a hash limit (set from the number of different texts) come to the
    driver, each once. An empty table gives no language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    share = {r["lang"]: min(1.0, 4.0 * texts / max(r["n"], 1)) for r in sizes}
    limit = F.create_map(*[x for code, s in share.items() for x in (F.lit(code), F.lit(min(2 ** 63 - 1, int(s * 2.0 ** 64) - 2 ** 63)))])
    middle = F.greatest((F.length("text") - chars) / 2, F.lit(0)).cast("int") + 1
    few = rows.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min(F.substring("text", middle, F.lit(chars))).alias("part"))
    found: dict[str, list] = {}
    for r in few.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["part"]))
    order = sorted(found, key=lambda code: (-{r["lang"]: r["n"] for r in sizes}[code], code))
    return {code: "\n".join(p for _, p in sorted(found[code])[:texts]).lower().encode("utf-8") for code in order}


class Classifier:
    """Languages in the order of ``contents`` where sizes tie."""

    def __init__(self, contents: dict[str, bytes], levels: tuple[int, ...] = LEVELS):
        import zstandard

        self.codes = list(contents)
        self.levels = []
        for level in levels:
            encoders = []
            for code in self.codes:
                own = zstandard.ZstdCompressionDict(contents[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=level)
                encoders.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.levels.append(encoders)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, score, rejected)``; the score is the share of bytes saved against the second best."""
        if not text or not self.codes or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        if len(self.codes) == 1:
            return self.codes[0], 1.0, False
        text = text.lower()
        pieces = [text[k:k + PIECE_CHARS].encode("utf-8") for k in range(0, len(text), PIECE_CHARS)]
        for encoders in self.levels:
            sizes = sorted((sum(len(e.compress(p)) for p in pieces), k) for k, e in enumerate(encoders))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            if margin >= NARROW:
                break
        return self.codes[sizes[0][1]], min(margin, 1.0), margin < NARROW


def predict(contents: dict[str, bytes], text: str) -> Column:
    """Struct ``(lang_pred, score, rejected)`` of the whole text.

    ``und`` with score 0 where the text is null, empty or without a letter, or nothing was learned.
    ``rejected`` marks those and choices with a margin under ``NARROW``. The dictionaries travel with the
    query: ``MOST_LANGUAGES`` times the sample bound at most.
    """
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Classifier(contents)
        for texts in batches:
            yield pd.DataFrame([own(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return classify(F.col(text))
