"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over whole labelled texts (at most ``chars`` characters, a documented bound).
A text is parsed greedily into the longest phrases that occur in that language's text; a character that the language's text
does not have is a phrase of its own.  phrases * log2(reference length) / characters estimates the cross-entropy, and the
language with the fewest normalised phrases wins.

Every language has the alphabet of its own text.  Steps by its ``DENSE`` most frequent characters are one completed table (a
missing step starts a new phrase at the root), steps by rarer ones a sorted list, so large alphabets cost a search and not
a wide table.  Whole texts are parsed in one piece, all texts of a group in step and for all languages at once, and the long
tails of the longest character by character; inside one map over the documents: no shuffle, no skew, bounded state.

Defined results: null text, or text without a letter, is ``und`` with score 0; with no labelled text at all every text is
``und``; ties go to the first language by name; repeated rows get equal answers; results have their own columns, so clashing
names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a language whose steps are in the table; those of all others are searched.
DENSE = 96
#: Texts fewer than this are parsed one by one from where the others end.
FEW = 24
_letter = regex.compile(r"\p{L}")


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by online construction."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        now = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return steps


class Automaton:
    """One language's completed automaton.  A step gives the next state + 1, negative where it begins a new phrase.

    Codes: 0 is a character that the text does not have, 1 to DENSE its most frequent characters, above those the others.
    """

    def __init__(self, text: str):
        points = _points(text)
        seen, counts = np.unique(points, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        self.codes = np.zeros(len(seen), np.int64)
        self.codes[order] = np.arange(1, len(seen) + 1)
        self.alphabet, self.bits = seen, np.log2(max(2, len(text)))
        steps = suffix_automaton(self.encode(points))
        self.width = min(DENSE, len(seen)) + 1
        root = np.zeros(len(seen) + 1, np.int32)  # after a missing step: where the character leads from the root
        for c, s in steps[0].items():
            root[c] = s
        self.root = -(root + 1)
        table = np.tile(self.root[: self.width], (len(steps), 1))
        rare: dict[int, int] = {}
        for s, out in enumerate(steps[1:], 1):
            for c, to in out.items():
                if c < self.width:
                    table[s, c] = to + 1
                else:
                    rare[s * (len(seen) + 1) + c] = to + 1
        self.table, self.rare = table.ravel(), rare
        self.rare_keys = np.array(sorted(rare), np.int64)
        self.rare_steps = np.array([rare[k] for k in self.rare_keys.tolist()], np.int32)
        self.size = len(seen) + 1

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(points), np.int64)
        i = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == points, self.codes[i], 0)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.width == self.size:
            return self.table[state * self.width + code]
        to = self.table[state * self.width + np.where(code < self.width, code, 0)]
        i = np.flatnonzero(code >= self.width)
        if len(i):
            to[i] = self.root[code[i]]
            if len(self.rare_keys):
                key = state[i] * self.size + code[i]
                at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
                hit = self.rare_keys[at] == key
                to[i[hit]] = self.rare_steps[at[hit]]
        return to

    def walk(self, state: int, codes: list[int]) -> int:
        """Phrases that begin on the way from a state."""
        table, width, root, rare, size, n = memoryview(self.table), self.width, self.root, self.rare, self.size, 0
        for c in codes:
            to = table[state * width + c] if c < width else rare.get(state * size + c) or int(root[c])
            if to < 0:
                n, to = n + 1, -to
            state = to - 1
        return n


class CrossParser:
    """Automata of several languages."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        self.automata = [Automaton(references[k].lower()) for k in self.languages]
        self.bits = np.array([a.bits for a in self.automata])

    def phrases(self, texts: list[str], group: int = 1024) -> np.ndarray:
        """texts x languages: exact phrase counts of the whole texts."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        points = [_points(t.lower()) for t in texts]
        order = sorted(range(len(texts)), key=lambda k: -len(points[k]))
        for first in range(0, len(order), group):
            these = order[first : first + group]
            lengths = np.array([len(points[k]) for k in these])
            shared = int(lengths[FEW - 1]) if len(these) >= FEW else 0  # places that FEW texts have at least
            flat = np.concatenate([points[k][:shared] for k in these])
            starts = np.cumsum(np.minimum(lengths, shared)) - np.minimum(lengths, shared)
            active = np.searchsorted(-lengths, -np.arange(shared), side="left")  # texts longer than each place
            for language, automaton in enumerate(self.automata):
                codes = automaton.encode(flat)
                state, count = np.zeros(len(these), np.int64), np.zeros(len(these), np.int64)
                for place in range(shared):
                    n = int(active[place])
                    to = automaton.step(state[:n], codes[starts[:n] + place])
                    count[:n] += to < 0
                    state[:n] = np.abs(to) - 1
                for i in np.flatnonzero(lengths > shared):
                    count[i] += automaton.walk(int(state[i]), automaton.encode(points[these[i]][shared:]).tolist())
                out[these, language] = count
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def reference_texts(labelled: DataFrame, id_col: str, text: str, lang: str, chars: int, docs_per_language: int = 400, seed: int = 1) -> dict[str, str]:
    """Whole texts of each language, at most ``chars`` characters together, of about docs_per_language documents by a hash of the id.

    A text that no longer fits is passed over, and one longer than an eighth of ``chars`` is not read, so that several texts
    stand for a language; where no text is that short, the shortest that fits does.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & (F.length(text) <= chars))
    short = F.length(text) <= chars // 8
    counts = {r[0]: (r[1], r[2]) for r in labelled.groupBy(lang).agg(F.count(F.when(short, 1)), F.min(F.length(text))).collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000))
    bound, fits = F.lit(0), F.lit(False)
    for name in sorted(counts):
        several, least = counts[name]
        bound = F.when(F.col(lang) == name, F.lit(int(min(1.0, docs_per_language / several) * 1_000_000) if several else 1_000_000)).otherwise(bound)
        fits = F.when(F.col(lang) == name, short if several else F.length(text) == least).otherwise(fits)
    chosen = labelled.filter(fits & (place < bound)).select(F.col(lang).alias("lang"), place.alias("place"), F.col(text).alias("whole"))
    rows = chosen.orderBy("place", "lang", "whole").limit(4 * docs_per_language * len(counts)).collect()
    out: dict[str, list[str]] = {}
    left = dict.fromkeys(counts, chars)
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["whole"])):
        if len(r["whole"]) + 1 <= left[r["lang"]] or r["lang"] not in out:
            out.setdefault(r["lang"], []).append(r["whole"])
            left[r["lang"]] -= len(r["whole"]) + 1
    return {name: "\n".join(texts) for name, texts in out.items()}


def predict_language(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy) for every row: score is 1 - best / second-best normalised phrase count."""
    shared = docs.sparkSession.sparkContext.broadcast(references)  # bounded: languages * chars
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                texts = [t or "" for t in part["text"]]
                known = np.array([bool(_letter.search(t)) for t in texts]) if parser.languages else np.zeros(len(texts), bool)
                names, score, entropy = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if known.any():
                    i = np.flatnonzero(known)
                    rate = parser.phrases([texts[k] for k in i]) * parser.bits / np.array([len(texts[k].lower()) for k in i])[:, None]
                    ranked = np.sort(rate, axis=1)
                    names[i] = np.array(parser.languages, object)[rate.argmin(axis=1)]
                    entropy[i] = ranked[:, 0]
                    score[i] = 1 - ranked[:, 0] / ranked[:, 1] if rate.shape[1] > 1 else 1.0
                yield pd.DataFrame({"id": part["id"].to_numpy(), "lang_pred": names, "score": score, "entropy": entropy})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(predict, f"id {id_type}, lang_pred string, score double, entropy double").withColumnRenamed("id", id_col)


_parsers: dict[int, CrossParser] = {}


def _parser(references: dict[str, str]) -> CrossParser:
    """Built once in a worker process and kept for its later tasks."""
    key = hash(tuple(sorted(references.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(references)
    return _parsers[key]
