"""Periodic runs of words: stretches that repeat themselves with a smallest period, and texts with the repeats taken out.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), that is at least
``min_words`` and 2 q long and that no neighbouring word extends keeping period q.

Method: online sparse dynamic programme over diagonals.  A diagonal is a lag q; it is active while the word at i equals the
word at i - q, and its match length grows with every such word.  Going through the text once, each word meets its earlier
occurrences: those on an active diagonal go on with it, the others begin one; an active diagonal whose word does not match
ends, and if its stretch is long enough the run is emitted there and then.  Three exact reductions keep it sparse:

- The matches of a run number at least half of ``min_words`` in a row, so the programme's letters are windows of so many
  words.  A window that stands once in the text takes no part, which leaves next to nothing of a text without repeats.
- A diagonal begins where the windows match and the ones before them do not; occurrences are kept by the window before, so
  only beginnings are enumerated, not every pair of occurrences.  One that cannot last (its period of words is compared at
  once) is not begun.
- A multiple of an active lag whose stretch begins at the same word describes the same stretch up to its end and is left out;
  what remains of a stretch is its smallest period.

So a text of one word repeated n times costs n steps.  Quadratic time is left for a text that holds very many separate
stretches of the same few words, in the number of those stretches.

Plan: one narrow map over the documents, no shuffle; memory is one batch of texts and the tables of one text.

Defined results: null or empty text has no words and no runs and stays as it is; fewer than min_words words have no runs;
equal rows give equal results; an empty table gives an empty one; columns of docs named like the results are replaced.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.llm.shared import fresh

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(words: list, min_words: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period."""
    width = (min_words + 1) // 2
    if len(words) < max(min_words, 2):
        return []
    windows = list(zip(*(words[k:] for k in range(width)))) if width > 1 else words
    count = Counter(windows)
    n = len(windows)
    if len(count) == n:
        return []
    code = {w: k for k, w in enumerate(count)}
    codes = np.fromiter((code[w] for w in windows), np.uint32, n)
    repeats = np.fromiter(count.values(), np.int64, len(count)) > 1
    live, raw, at = np.flatnonzero(repeats[codes]).tolist(), codes.tobytes(), codes.tolist()
    places: dict[int, dict[int, array]] = {}  # of a window, by the window before it
    active: dict[int, int] = {}  # lag: the first matching window
    found: dict[tuple[int, int], int] = {}

    def lasting(i: int, earlier: array) -> list[int]:
        """The earlier occurrences whose diagonal can last as far as its last window tells."""
        if len(earlier) < 32:
            return [j for j in earlier if (end := i + max(min_words - i + j, i - j) - width) < n and at[end] == at[end - i + j]]
        j = np.frombuffer(earlier, np.int64)
        end = i + np.maximum(min_words - i + j, i - j) - width
        j, end = j[inside := end < n], end[inside]
        return j[codes[end] == codes[end - i + j]].tolist()

    def emit(lag: int, end: int) -> None:
        start = active.pop(lag) - lag
        length = end + width - 1 - start
        if length >= min_words and length >= 2 * lag:
            found[start, length] = min(lag, found.get((start, length), lag))

    last = -1
    for i in live:
        here, before = at[i], at[i - 1] if last == i - 1 and i else -1  # -1: a window that stands once, and so matches none
        if active:
            for lag in list(active):
                if i != last + 1 or at[i - lag] != here:
                    emit(lag, last + 1)
        mine = places.setdefault(here, {})
        for other, earlier in mine.items():
            if other == before and before >= 0:
                continue  # these matched one window ago: their diagonals are active, or were not worth beginning
            for j in lasting(i, earlier):
                lag = i - j
                need = max(min_words - lag, lag) - width + 1
                if any(lag % d == 0 and first - d == j for d, first in active.items()):
                    continue
                if raw[4 * i : 4 * (i + need)] == raw[4 * j : 4 * (j + need)]:
                    active[lag] = i
        mine.setdefault(before, array("q")).append(i)
        last = i
    for lag in list(active):
        emit(lag, last + 1)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    kept, upto = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > upto:
            kept += words[upto : max(begin, upto)]
            upto = end
    return kept + words[upto:]


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = 12) -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start, then period) and collapsed: the kept words joined by one
    blank, or the text as it stands where nothing is dropped."""

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = t.encode().split() if t is not None else []  # bytes part at ASCII white space and nothing else
                runs = find_runs(words, min_words)
                kept = b" ".join(collapse(words, runs)).decode() if runs else t
                rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], kept))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    new, name = ("n_words", "runs", "collapsed"), fresh(docs, "found_runs")
    kept = [c for c in docs.columns if c.lower() not in new]
    return docs.select(*kept, scan(F.col(text)).alias(name)).select(*kept, *(F.col(name)[c].alias(c) for c in new))
