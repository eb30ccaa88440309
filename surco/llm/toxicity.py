"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Words are lower-cased, look-alike letters and digits or signs inside words are folded to the letters they stand for.
The lexicon's terms (words, and beginnings of words) and their weights are learnt from labelled texts, and so are
the phrases in which a term is harmless. A text's score rests on the weight of its matches, as a sum and for its
length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surco.llm.common import fresh, give_back, held_out
from surco.llm.labelled import SAMPLE_ROWS, logistic, sample
from surco.session import written_once

# Letters of other scripts, signs and digits, and the Latin letters that they imitate.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
_LETTERS = {ord(k): v for k, v in LOOK_ALIKES.items() if k.isalpha()}
_LETTERS |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_LETTERS |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
_SIGNS = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![\w@$!])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+\b")
_DIGITS = {ord(k): v for k, v in LOOK_ALIKES.items() if not k.isalpha()}
_WORD = re.compile(r"[^\W\d_]+")

TERM_LETTERS = (4, 24)
PREFIX_LETTERS = (4, 5, 6)
MIN_DOCS, MIN_ODDS = 4, 3.0
MAX_TERMS = 5_000
TERMS_HELD = 200_000  # terms that a task counts before it hands them on
BLANK_SCORE = 0.0


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs in words as letters."""
    return _SIGNS.sub(lambda m: m[0].translate(_DIGITS), text.lower().translate(_LETTERS))


@dataclass
class Lexicon:
    """Terms ``word`` or ``prefix*`` with weights, and harmless phrases of a term and a neighbour word."""

    weights: dict[str, float]
    harmless: frozenset[tuple[str, str, str]] = frozenset()  # word before, term's word, word after; one of the two is empty
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.weights, self.harmless

    def __setstate__(self, state):
        self.weights, self.harmless, self._machine = *state, None

    def matches(self, folded: str) -> Iterator[tuple[str, str, str, str]]:
        """Matched term with the word it stands in and the words before and after."""
        if not self.weights:
            return
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term in self.weights:
                self._machine.add_word(term.rstrip("*"), term)
            for term in self.weights:  # a word and a prefix of the same letters
                if term.endswith("*"):
                    self._machine.add_word(term[:-1], term)
            self._machine.make_automaton()
        done = -1
        for end, term in self._machine.iter(folded):
            start = end + 1 - len(term.rstrip("*"))
            if start <= done or start and folded[start - 1].isalpha() or not term.endswith("*") and folded[end + 1:end + 2].isalpha():
                continue
            stop = end + 1
            while stop < len(folded) and folded[stop].isalpha():
                stop += 1
            done = stop - 1
            before = _WORD.findall(folded[max(0, start - 40):start])
            after = _WORD.match(folded, stop) or _WORD.search(folded, stop, stop + 40)
            yield term, folded[start:stop], before[-1] if before else "", after[0] if after else ""

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """Matched weight as a sum (logarithm) and for the length, and whether there is any."""
        folded = fold(text or "")
        total = sum(
            self.weights[t] for t, w, a, b in self.matches(folded)
            if not self.harmless or not ({(a, w, ""), ("", w, b)} & self.harmless))
        return math.log1p(total), total / math.sqrt(1 + len(folded) / 6), float(total > 0)


def _terms(text: str) -> set[str]:
    words = {w for w in _WORD.findall(fold(text)) if len(w) >= TERM_LETTERS[0]}
    return {w for w in words if len(w) <= TERM_LETTERS[1]} | {w[:k] + "*" for w in words for k in PREFIX_LETTERS if len(w) > k}


def _count_terms(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bad, all_ = Counter(), Counter()

    def counts() -> pd.DataFrame:
        out = pd.DataFrame({"term": list(all_), "n_bad": [bad[t] for t in all_], "n": list(all_.values())})
        bad.clear()
        all_.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            found = _terms(text or "")
            all_.update(found)
            if label:
                bad.update(found)
            if len(all_) > TERMS_HELD:  # the counts of a task's parts are added up later
                yield counts()
                give_back()
    yield counts()
    give_back()


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and coefficients from up to ``rows`` labelled texts that are not held out.

    Copies of a text count once. A term enters if enough toxic texts hold it and its odds are high; a longer term whose beginning is already
    in adds nothing. Without any labelled text the lexicon is empty and every score is 0.
    """
    marked = written_once(sample(docs, labels, "toxic", rows).dropDuplicates(["text", "label"]))
    tally = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = tally.get(1, 0), tally.get(0, 0)
    if not n_bad:
        return Lexicon({}), np.zeros(4)
    counted = marked.select("text", "label").mapInPandas(_count_terms, "term string, n_bad bigint, n bigint").groupBy("term").agg(
        F.sum("n_bad").alias("n_bad"), F.sum("n").alias("n")).filter(F.col("n_bad") >= MIN_DOCS)
    odds = F.log((F.col("n_bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("n") - F.col("n_bad") + 0.5) / (n_good + 1.0))
    best = counted.withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc("n_bad"), F.desc("odds"), "term").limit(MAX_TERMS).collect()
    chosen: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"].rstrip("*")), r["term"])):
        letters = r["term"].rstrip("*")
        if not any(f"{letters[:k]}*" in chosen for k in range(TERM_LETTERS[0], len(letters) + 1)):
            chosen[r["term"]] = float(r["odds"])
    lexicon = Lexicon(chosen)

    def phrases(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(x, w, y, int(label or 0)) for text, label in zip(batch["text"], batch["label"])
                    for _, w, a, b in lexicon.matches(fold(text or "")) for x, y in ((a, ""), ("", b)) if x or y]
            yield pd.DataFrame(rows, columns=["a", "w", "b", "label"])
            give_back()

    spared = marked.select("text", "label").mapInPandas(phrases, "a string, w string, b string, label int").groupBy("a", "w", "b").agg(
        F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).filter("bad = 0 AND n >= 3").orderBy(F.desc("n"), "a", "w", "b").limit(MAX_TERMS).collect()
    lexicon = Lexicon(chosen, frozenset((r["a"], r["w"], r["b"]) for r in spared))
    measure = _measures(lexicon)
    seen = marked.select("label", measure(F.col("text")).alias("m")).select("label", "m.*").toPandas()  # at most ``rows`` rows
    x = np.column_stack([np.ones(len(seen)), seen[["total", "dense", "any"]].to_numpy()])
    return lexicon, logistic(x, seen["label"].to_numpy(float))


def _measures(lexicon: Lexicon):
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([lexicon.measures(t) for t in texts], columns=["total", "dense", "any"])
        give_back()
        return out

    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("total", "dense", "any")])
    return F.pandas_udf(run, kind)


def score_of(text: Column, model: tuple[Lexicon, np.ndarray]) -> Column:
    """Score between 0 and 1; null, empty and blank texts match nothing and score as a text without a match."""
    lexicon, beta = model
    m = _measures(lexicon)(text)
    if not lexicon.weights:
        return F.when(text.isNull(), BLANK_SCORE).otherwise(BLANK_SCORE)
    line = F.lit(float(beta[0])) + sum(float(b) * m[c] for b, c in zip(beta[1:], ("total", "dense", "any")))
    return 1 / (1 + F.exp(-line))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; repeated rows get equal scores, each in its row."""
    model = learn(docs, labels)
    scored = docs.select("doc_id", score_of(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    mark, = fresh(docs, "toxic_score")
    return docs.withColumn(mark, score_of(F.col("text"), learn(docs, labels))).filter(F.col(mark) < 0.5).select(*docs.columns)
