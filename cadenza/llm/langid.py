"""Language identification by word-first backoff.

A word that training saw is scored by its log frequency in each language. An unseen word falls back to its character
n-grams, longest first: the first length of which any n-gram is known decides, by the mean of their log frequencies;
with none known down to single characters the word has no vote. A term that a language lacks costs the same in every
language, however little text that language had. The model has every term of the sample of labelled rows that it is fitted on. A document's language has the largest total, the first
in alphabetical order on ties.

Edge cases: a text that is null or has no letter is ``und`` with score 0. Texts of any length are read whole. Ids and
languages may be null; rows with a null text or language teach nothing. With no training rows all texts are ``und``.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import small_batches, stored

WORDS = regex.compile(r"\p{L}+(?:\p{M}+\p{L}*)*")
ASCII_WORDS = re.compile(r"[a-z]+")  # the same words, faster
LONGEST = 5
KEPT = 200_000  # words whose places in the model a task remembers
CACHE = 1 << 20  # votes of unseen words that a task remembers, words times languages


def words(text: str | None) -> list[str]:
    t = (text or "").lower()
    return ASCII_WORDS.findall(t) if t.isascii() else WORDS.findall(t)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; single characters without the marks."""
    s = word if n == 1 else f"<{word}>"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def digest(term: str, size: int) -> int:
    """What stands for a term in the model: 64 bits of a word (size 0) or of an n-gram."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), size)


@dataclass
class Model:
    """Log frequencies by language, sparse: term i, by its digest in ``terms``, has entries ``at[i]`` to ``at[i + 1]``.

    An entry is a language and by how much its log frequency is above that of languages that lack the term, which is ``floors[size]``
    for all of them. So the model's size is that of the sample's counts, however many languages there are.
    """

    langs: list[str]
    terms: np.ndarray  # sorted
    at: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    floors: np.ndarray
    cache: dict[str, np.ndarray | None] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)  # of words met before

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.at, self.lang, self.above))

    def find(self, digests: list[int]) -> np.ndarray:
        """Indexes of the terms, -1 for unknown ones."""
        h = np.array(digests, np.uint64)
        i = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
        return np.where(self.terms[i] == h, i, -1) if len(self.terms) else np.full(len(h), -1)

    def rows_of(self, some: list[str]) -> np.ndarray:
        """Indexes of words; a task remembers those of frequent ones."""
        out = np.fromiter((self.rows.get(w, -2) for w in some), np.int64, len(some))
        new = np.flatnonzero(out == -2)
        if len(new):
            out[new] = self.find([digest(some[i], 0) for i in new])
            if len(self.rows) < KEPT:
                self.rows.update((some[i], int(out[i])) for i in new)
        return out

    def votes(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Per language, what the terms add above the floor."""
        n = self.at[rows + 1] - self.at[rows]
        where = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.lang[where], weights=self.above[where] * np.repeat(times, n), minlength=len(self.langs))

    def back_off(self, word: str) -> np.ndarray | None:
        """The vote of a word that training did not see."""
        if word in self.cache:
            return self.cache[word]
        found = None
        for n in range(LONGEST, 0, -1):
            rows = self.find([digest(g, n) for g in grams(word, n)])
            rows = rows[rows >= 0]
            if len(rows):
                found = self.floors[n] + self.votes(rows, np.ones(len(rows))) / len(rows)
                break
        if len(self.cache) * len(self.langs) < CACHE:
            self.cache[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and its softmax share of the mean log score per voting word."""
        found = words(text)
        if not self.langs or not found:
            return "und", 0.0
        counts = Counter(found)
        some = list(counts)
        rows, times = self.rows_of(some), np.fromiter(counts.values(), float, len(some))
        known = rows >= 0
        n = float(times[known].sum())
        total = self.votes(rows[known], times[known]) + n * self.floors[0]
        for i in np.flatnonzero(~known):
            if (v := self.back_off(some[i])) is not None:
                total += times[i] * v
                n += times[i]
        if not n:
            return self.langs[0], 1 / len(self.langs)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp((total - total[best]) / n).sum())


def fit(labelled: DataFrame, docs_per_lang: int = 2000, docs: int = 100_000) -> Model:
    """Learn from (doc_id, text, lang).

    Counts come from a bounded sample of labelled rows: about ``docs_per_lang`` of each language and ``docs`` in all, by hash of id and text,
    all rows where there are fewer. These bounds are the only ones: all words and n-grams of the sample are in the model. The model is
    built by Spark and comes to the driver as columns of numbers, a row for each term and language that has it.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.withColumn("place", F.row_number().over(Window.orderBy("lang")) - 1), "sizes")  # one row a language
    langs = [r["lang"] for r in sizes.orderBy("place").select("lang").collect()]
    if not langs:
        none = np.zeros(0)
        return Model([], none.astype(np.uint64), np.zeros(1, np.int64), none.astype(np.int32), none.astype(np.float32), np.zeros(LONGEST + 1))
    most = min(docs_per_lang, max(1, docs // len(langs)))
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_000)) * F.col("n") < F.lit(most * 1_000_000)
    sample = rows.join(sizes, "lang").where(chance)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for text, lang in zip(b["text"], b["lang"], strict=True):
                found.update((lang, w) for w in words(text))
            if found:
                yield pd.DataFrame([(lang, w, c) for (lang, w), c in found.items()], columns=["lang", "term", "n"])

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for lang, w, c in zip(b["lang"], b["term"], b["n"], strict=True):
                found[lang, 0, w] += c
                for size in range(1, LONGEST + 1):
                    for g in grams(w, size):
                        found[lang, size, g] += c
            if found:
                h = np.array([digest(g, size) for _, size, g in found], np.uint64).view(np.int64)
                yield pd.DataFrame({"lang": [k[0] for k in found], "size": [k[1] for k in found], "h": h, "n": list(found.values())})

    seen = sample.select("text", "lang").mapInPandas(count_words, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    terms = stored(seen.mapInPandas(count_terms, "lang string, size int, h long, n long").groupBy("lang", "size", "h").agg(F.sum("n").alias("n")), "terms")
    totals = stored(terms.groupBy("lang", "size").agg((F.sum("n") + 1).alias("total")), "totals")  # six rows a language
    largest = {r["size"]: r["total"] for r in totals.groupBy("size").agg(F.max("total").alias("total")).collect()}
    floors = np.array([np.log(0.1 / largest.get(size, 1)) for size in range(LONGEST + 1)])
    floor = F.get(F.array(*[F.lit(float(x)) for x in floors]), F.col("size"))
    above = F.log(F.col("n") / F.col("total") + F.exp(floor)) - floor
    table = terms.join(totals, ["lang", "size"]).join(sizes.select("lang", "place"), "lang").select("h", F.col("place").cast("int").alias("place"), above.cast("float").alias("above")).toArrow()
    h, lang, above = (table[c].to_numpy() for c in ("h", "place", "above"))
    order = np.lexsort((lang, h.view(np.uint64)))
    h = h.view(np.uint64)[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return Model(langs, h[first], np.append(first, len(h)), lang[order], above[order], floors)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``lang`` and ``score`` (0 to 1) of each text; one pass, no shuffle. Tasks hold the model, whose size ``fit`` bounds."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    tagged = docs.withColumn("_cz_p", predict(F.col("text")))
    return tagged.select(*[tagged[c] for c in docs.columns], F.col("_cz_p.lang").alias(lang), F.col("_cz_p.score").alias(score))
