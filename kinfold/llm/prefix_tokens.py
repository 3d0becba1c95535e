"""Exact token counts at every prefix of a text, by dynamic programming over its last token.

Byte-pair merges have this property: the encoding of a prefix ends in exactly one vocabulary piece that
(a) is what the merges make of its own characters and (b) stays apart from the last piece of the prefix
before it when both are merged together. So one left-to-right pass that looks up all pieces ending at a
position (Aho-Corasick) and tests neighbouring pairs gives the token count of every prefix; no prefix is
encoded again. No piece holds a space mark behind another character (checked when the vocabulary is
read), hence merges never cross from a word into the following space, and a text is the sum of its
words. Each distinct word is solved once per Python worker.

The counts are kept as one signed byte per character, the change from one prefix to the next (a longer
prefix may need fewer tokens). Truncation and budget questions are running sums over these bytes.
"""

from __future__ import annotations

import functools
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from kinfold.llm.vocabulary import place

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONGEST_KEPT = 64
MOST_KEPT = 600_000


class PrefixCounter:
    """Prefix counts of one SentencePiece BPE vocabulary with byte fallback.

    Words up to ``LONGEST_KEPT`` characters are remembered; the memory is emptied at ``MOST_KEPT``
    words. This affects speed only.
    """

    def __init__(self, model: str = MODEL):
        import ahocorasick
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=place(model))
        self.scores = {
            lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.scores)
        self.pieces = [p for p in self.scores if self.merged(p) == [p]]
        self.ends = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces):
            self.ends.add_word(piece, (len(piece), number))
        self.ends.make_automaton()
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.run = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges make of a short string."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 2 * MOST_KEPT:
                self.apart.clear()
            pair = [self.pieces[left], self.pieces[right]]
            known = self.apart[key] = self.merged(pair[0] + pair[1]) == pair
        return known

    def solve(self, word: str) -> list[int] | None:
        """Token count of every prefix of ``word``; None where no last piece fits."""
        counts, last = [0] * (len(word) + 1), [None] * (len(word) + 1)
        known, done = self.apart, 0
        last[0] = -1
        for at, (size, piece) in self.ends.iter(word):
            while done < at:
                done += 1
                if last[done] is None and not self._alone(word, done, counts, last):
                    return None
            if last[at + 1] is not None:
                continue
            before = at + 1 - size
            left = last[before]
            if left >= 0:
                fits = known.get(left << 32 | piece)
                if fits is None:
                    fits = self.stay_apart(left, piece)
                if not fits:
                    continue
            counts[at + 1] = counts[before] + 1
            last[at + 1] = piece
        while done < len(word):
            done += 1
            if last[done] is None and not self._alone(word, done, counts, last):
                return None
        return counts

    def _alone(self, word: str, at: int, counts: list, last: list) -> bool:
        """A character outside the vocabulary: its bytes, which merge with nothing."""
        if word[at - 1] in self.scores:
            return False
        counts[at] = counts[at - 1] + len(word[at - 1].encode("utf-8"))
        last[at] = -1
        return True

    def word(self, word: str) -> bytes:
        """Change of the token count at each character of a word that starts with its space marks.

        Should a vocabulary break the rule above, so that no last piece fits, every prefix of that word
        is merged on its own instead, which is slower and equally exact.
        """
        counts = self.solve(word)
        if counts is None:
            size = lambda piece: 1 if piece in self.scores else len(piece.encode("utf-8"))
            counts = [sum(map(size, self.merged(word[:k]))) for k in range(len(word) + 1)]
        return bytes([b - a & 255 for a, b in zip(counts, counts[1:])])

    def look(self, tail: str) -> bytes:
        """:meth:`word` of the mark and ``tail``, remembered."""
        got = self.known.get(tail)
        if got is None:
            got = self.word(MARK + tail)
            if len(tail) <= LONGEST_KEPT:
                if len(self.known) >= MOST_KEPT:
                    self.known.clear()
                self.known[tail] = got
        return got

    def changes(self, text: str) -> bytes:
        """One signed byte per character of ``text``."""
        if not text:
            return b""
        if self.splits and MARK not in text and text[0] != " " and "  " not in text:
            whole = b"".join(map(self.look, text.split(" ")))
        else:
            marked = MARK + text.replace(" ", MARK)
            parts = self.run.findall(marked) if self.splits else [marked]
            whole = b"".join(self.look(p[1:]) if p[0] == MARK else self.word(p) for p in parts)
        # the mark that the library puts before a text is no character of it
        return bytes(((whole[0] + whole[1]) & 255,)) + whole[2:]


@functools.lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def prefix_changes(text: str, model: str = MODEL) -> Column:
    """Struct ``(n_tokens, changes)`` of the text column; null texts count as empty.

    ``changes`` is binary with a signed byte per character: its running sum at character k is the exact
    token count of the first k characters. Empty texts give 0 and no bytes. Any length is handled, each
    text on its own, so ties, repeated rows and further columns do not matter.
    """

    @F.pandas_udf("n_tokens long, changes binary")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        own = counter(model)
        for texts in batches:
            found = [own.changes(t) if t else b"" for t in texts]
            total = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in found]
            yield pd.DataFrame({"n_tokens": total, "changes": found})

    return solve(F.col(text))


def _counts(changes: bytes):
    import numpy as np

    return np.frombuffer(changes, np.int8).cumsum(dtype=np.int64)


def tokens_at(changes: str, characters: str) -> Column:
    """Token count of the first ``characters`` characters; past the end, of the whole text."""

    @F.pandas_udf("long")
    def at(found: pd.Series, upto: pd.Series) -> pd.Series:
        return pd.Series([int(_counts(c)[min(int(k), len(c)) - 1]) if c and k > 0 else 0 for c, k in zip(found, upto)])

    return at(F.col(changes), F.col(characters))


def longest_within(changes: str, budget: str) -> Column:
    """Length in characters of the longest prefix that needs at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def within(found: pd.Series, most: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for c, b in zip(found, most):
            fits = np.flatnonzero(_counts(c) <= b) if c else ()
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out)

    return within(F.col(changes), F.col(budget))
