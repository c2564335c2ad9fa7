"""What built-in functions can't express: fuzzy quotation and the search for the best excerpt."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import vocab


#: Lengths of the runs of characters that windows are screened by.
GRAMS = (2, 3)
#: In windows of so many characters the comparison passes over frequent ones as seeds: those that occur more than once in a hundred and once.
LONG_WINDOW = 200


def gram_bounds(quote: str, source: str, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window the most characters that it can match in order with the quote.

    The places of the quote's runs are looked up once for the source, and
    counted for all windows at once. M characters matched in b unbroken runs
    share at least M - b(q - 1) of the q-grams, and between two runs at least
    one character is left over: b - 1 <= (n - M) + (width - M).
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (quote, source)]
    most = np.full(len(starts), min(len(quote), width))
    for q in GRAMS:
        if width < q:
            continue
        ours, theirs = (sum(c[i : len(c) - q + 1 + i] << np.uint64(21 * (q - 1 - i)) for i in range(q)) if len(c) >= q else np.zeros(0, np.uint64) for c in codes)
        places = np.concatenate([[0], np.cumsum(np.isin(theirs, ours))])
        shared = places[starts + width - q + 1] - places[starts]
        most = np.minimum(most, (shared + (q - 1) * (1 + len(quote) + width)) // (2 * q - 1))
    return most


class Comparison:
    """Windows against one quote, as sets of places in it that are bits of a number.

    matched() is the number of characters in the blocks of the
    Ratcliff-Obershelp comparison: the longest common block (of equal ones the
    first in the quote, then in the window), then the same before and after it.
    """

    def __init__(self, quote: str):
        self.quote = quote
        self.places: dict[str, int] = {}
        for i, c in enumerate(quote):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.compared = 0

    def in_order(self, held: list[int], start: int, end: int) -> int:
        """The longest common subsequence of a piece and the quote's places from start to end: no comparison exceeds it."""
        full = (1 << end - start) - 1
        left = full
        for h in held:
            if h and (hit := left & h >> start):
                left = (left + hit | left - hit) & full
        return end - start - left.bit_count()

    def longest(self, held: list[int]) -> tuple[int, int, int]:
        """The longest run (end in the quote, end in the window, length) where held has the places of each character of the window."""
        run, size, last = held, 0, held
        while any(run):
            size, last = size + 1, run
            run = [0, *[(r << 1) & h for r, h in zip(run, held[1:])]]
        if not size:
            return 0, 0, 0
        lows = [r & -r for r in last]
        low = min(x for x in lows if x)
        return low.bit_length(), lows.index(low) + 1, size

    def blocks(self, window: str, above: int) -> tuple[int, bool]:
        """The characters matched in all blocks (True), or a bound that is no more than `above` (False).

        What is matched and what the pieces between blocks have in order bound
        the sum; each block makes the bound tighter.
        """
        held = [self.places.get(c, 0) for c in window]
        bound = self.in_order(held, 0, len(self.quote))
        matched, todo = 0, [(bound, held, 0, len(self.quote))]
        while todo:
            if bound <= above:
                return bound, False
            had, held, start, end = todo.pop()
            bound -= had
            at, to, size = self.longest(held)
            matched, bound = matched + size, bound + size
            for piece, first, last in ((held[: to - size], start, at - size), (held[to:], at, end)) if size else ():
                if piece and first < last:
                    within = (1 << last) - (1 << first)
                    piece = [h & within for h in piece]
                    if most := self.in_order(piece, first, last):
                        todo.append((most, piece, first, last))
                        bound += most
        self.compared += 1
        return matched, True

    def seeds(self, window: str) -> int:
        """The most that a long window matches: what begins both, and the longest run around each of its infrequent characters."""
        quote, n, width = self.quote, len(self.quote), len(window)
        most = next((i for i, (a, b) in enumerate(zip(quote, window)) if a != b), min(n, width))
        counts = Counter(window)
        for j, c in enumerate(window):
            if c in self.places and counts[c] <= width // 100 + 1:
                best, i = 0, quote.find(c)
                while i >= 0:
                    back, on = 0, 1
                    while back < i and back < j and quote[i - back - 1] == window[j - back - 1]:
                        back += 1
                    while i + on < n and j + on < width and quote[i + on] == window[j + on]:
                        on += 1
                    best, i = max(best, back + on), quote.find(c, i + 1)
                most += best
        return most

    def matched(self, window: str, above: int) -> tuple[int, bool]:
        """The characters matched, exactly (True), or a bound on them that is no more than `above` (False)."""
        if len(window) < LONG_WINDOW:
            return self.blocks(window, above)
        bound = self.seeds(window)
        if bound <= above:
            return bound, False
        self.compared += 1
        return sum(m.size for m in difflib.SequenceMatcher(None, self.quote, window).get_matching_blocks()), True


def best_ratio(quote: str, source: str, compare: Comparison | None = None) -> float:
    """The best Ratcliff-Obershelp ratio of the quote with windows of its length, a quarter of it apart; the first that is accepted ends the search.

    Only windows that could be accepted are compared first, in order. If none
    is, the others are compared from the highest bound down, until no bound is
    over the best.
    """
    if not quote:
        return 1.0
    if not source:
        return 0.0
    n, width = len(quote), min(len(quote), len(source))
    starts = np.arange(0, max(1, len(source) - n + 1), max(1, n // 4))
    bounds = gram_bounds(quote, source, starts, width)
    ratio = lambda m: 2.0 * m / (n + width)
    compare, best = compare or Comparison(quote), 0
    window = lambda i: source[starts[i] : starts[i] + width]
    unacceptable = next(m for m in range(width, -1, -1) if m == 0 or ratio(m) < vocab.FUZZY_ACCEPT)
    exact = set()
    for i in np.flatnonzero(bounds > unacceptable).tolist():
        bounds[i], known = compare.matched(window(i), unacceptable)
        if known:
            exact.add(i)
            best = max(best, int(bounds[i]))
            if bounds[i] > unacceptable:
                return ratio(int(bounds[i]))
    for i in np.argsort(-bounds, kind="stable").tolist():
        if bounds[i] <= best:
            break
        if i not in exact:
            m, known = compare.matched(window(i), best)
            best = max(best, m) if known else best
    return ratio(best)


def quote_ratios(pairs: list[tuple[Column, Column]]) -> Column:
    """array<double>: best_ratio of each pair of a normalised quote and source, null where the quote is; one call for all pairs."""

    def of(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([[None if q is None else best_ratio(q, s or "") for q, s in zip(r[::2], r[1::2])] for r in rows], dtype=object)

    return F.pandas_udf(of, T.ArrayType(T.DoubleType()))(*[c for pair in pairs for c in pair])


def prose(window: str) -> int:
    """Sentences for, links (those to fragments twice) and bullets against."""
    links = window.count("](") + window.count("](#")
    return 2 * window.count(". ") - 3 * links - window.count("\n-") - window.count("\n*")


def best_excerpt(text: str, words: list[str], width: int = 900, before: int = 200) -> str:
    """The window around a keyword that reads most like prose; the first of equals, the head without a keyword."""
    low, best, best_score = text.lower(), text[:width], None
    for w in words:
        at = low.find(w)
        while at >= 0:
            start = max(0, at - before)
            window = text[start : start + width]
            score = prose(window)
            if best_score is None or score > best_score:
                best, best_score = window, score
            at = low.find(w, at + 1)
    return " ".join(best.split())


def excerpt(text: Column, words: list[str], width: int = 900, before: int = 200) -> Column:
    """best_excerpt of each text; the empty text has a fixed notice."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_excerpt(t, words, width, before) if t else "NO POLICY RETRIEVED")

    return of(text)
