"""Language ID, word first.

A text's words are scored by language: a known word by its log frequency in each language, any other by the longest
character n-grams of it that are known, from LONGEST down to single characters. Scores add up over the whole text.

The model is fitted on at most about SAMPLE labelled documents of each language, chosen by a hash of key and text, and
keeps the VOCABULARY most frequent words and GRAMS most frequent n-grams of each language. So what reaches the driver
and every executor is bounded by these numbers times the number of languages, whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, VOCABULARY, GRAMS, LONGEST = 3000, 20_000, 10_000, 4
#: A word seen once in a language's sample is not known: it would stand for the language all by itself.
LEAST_COUNT = 2
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: No letters; what mostly stands at the ends of words.
MARKS = ".,;:!?\"'()[]*#$%&|<>-"
CACHE = 1 << 17


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between marks for its ends; single characters without them."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Model:
    """counts: {language: {n: {string: count}}}; n = 0 are words."""

    def __init__(self, counts: dict[str, dict[int, dict[str, int]]], longest: int = LONGEST) -> None:
        self.langs, self.longest = sorted(counts), longest
        self.tables: list[dict[str, np.ndarray]] = []
        for n in range(longest + 1):
            of = [counts[x].get(n, {}) for x in self.langs]
            known = set().union(*of) if of else set()
            base = np.array([math.log(sum(c.values()) + len(known) + 1) for c in of])
            self.tables.append({s: np.log([c.get(s, 0) + 1.0 for c in of]) - base for s in known})

    def word(self, word: str) -> np.ndarray:
        """Log likelihood by language; zeros if nothing of the word is known."""
        if (got := self.tables[0].get(word)) is not None:
            return got
        for n in range(self.longest, 0, -1):
            got = [x for g in grams_of(word, n) if (x := self.tables[n].get(g)) is not None]
            if got:
                return np.sum(got, axis=0) / n
        return np.zeros(len(self.langs))


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, vocabulary: int = VOCABULARY, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """A model of the rows of docs whose text and lang are not null, from at most about `sample` rows of each language.

    Rows are drawn by a hash of key and text, so a missing or repeated key draws no others with it; rows that repeat both
    count once, here and in the number of rows that the share is of.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("hash"))
    size = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model({}, longest)
    share = F.create_map(*(x for k, n in size.items() for x in (F.lit(k), F.lit(min(1 << 30, math.ceil((1 << 30) * sample / n))))))
    chosen = rows.where(F.pmod("hash", F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "hash"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(x, Counter()).update(words_of(t.as_py()))
        for x, words in found.items():
            all_ = Counter({(0, w): c for w, c in words.items()})
            for w, c in words.items():
                for n in range(1, longest + 1):
                    for g in grams_of(w, n):
                        all_[n, g] += c
            items = list(all_.items())
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(items), pa.string()), pa.array([k[0] for k, _ in items], pa.int32()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([c for _, c in items], pa.int64())], names=["lang", "n", "s", "c"])

    counted = chosen.mapInArrow(count, "lang string, n int, s string, c long").groupBy("lang", "n", "s").agg(F.sum("c").alias("c")).where(f"c >= {LEAST_COUNT}")
    best = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "s")
    top = counted.withColumn("r", F.row_number().over(best)).where(f"r <= if(n = 0, {vocabulary}, {grams})")
    counts: dict[str, dict[int, dict[str, int]]] = {x: {} for x in size}
    for batch in top.select("lang", "n", "s", "c").toArrow().to_batches():
        for x, size_, string, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            counts[x].setdefault(size_, {})[string] = c
    return Model(counts, longest)


class Scorer:
    """A model with the scores of what it has met lately: of a string between spaces, as texts repeat these."""

    def __init__(self, model: Model) -> None:
        self.model = model
        known = [x for x in model.tables[0] if any(map(str.isalpha, x))]
        self.words = {x: k + 1 for k, x in enumerate(known)}  # row 0 is for strings without a letter
        self.rows = np.zeros((len(known) + CACHE // 16, len(model.langs)))
        for x, k in self.words.items():
            self.rows[k] = model.tables[0][x]
        self.grams = [{g: tuple(v.tolist()) for g, v in t.items()} for t in model.tables]
        self._coded()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.used = len(self.words) + 1

    def unknown(self, word: str) -> list[float]:
        """As Model.word() of a word that the model doesn't know."""
        for n in range(self.model.longest, 0, -1):
            if got := list(filter(None, map(self.grams[n].get, grams_of(word, n)))):
                return [sum(x) / n for x in zip(*got, strict=True)]
        return [0.0] * len(self.model.langs)

    def _coded(self) -> None:
        """The known n-grams as sorted numbers, with their scores: letters count from 1, so that 0 stands for all others."""
        letters = sorted({x for t in self.grams[1:] for g in t for x in g} | set("<>"))
        self.code = np.zeros(ord(letters[-1]) + 2, dtype=np.int64)
        self.code[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.coded = self.base**self.model.longest < 1 << 62
        self.keys, self.scores = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(self.model.langs)))]
        for n in range(1, self.model.longest + 1 if self.coded else 0):
            found = list(self.grams[n])
            key = self._numbers("".join(found), n)[::n] if found else np.zeros(0, dtype=np.int64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.scores.append(np.array([self.grams[n][g] for g in found], dtype=float).reshape(len(found), len(self.model.langs))[order])

    def _numbers(self, text: str, n: int) -> np.ndarray:
        """A number for the n letters from each place of text."""
        of = self.code[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(self.code) - 1)]
        size = max(0, len(of) - n + 1)
        out = np.zeros(size, dtype=np.int64)
        for t in range(n):
            out *= self.base
            out += of[t : t + size]
        return out

    def unknown_all(self, words: list[str]) -> np.ndarray:
        """unknown() of each word. No n-gram of the model reaches over the marks between two words."""
        if not self.coded:
            return np.array([self.unknown(w) for w in words])
        out, left = np.zeros((len(words), len(self.model.langs))), np.arange(len(words))
        for n in range(self.model.longest, 0, -1):
            if not len(left) or not len(self.keys[n]):
                continue
            marked = [f"<{words[k]}>" if n > 1 else words[k] for k in left.tolist()]
            key = self._numbers("".join(marked), n)
            at = np.searchsorted(self.keys[n], key)
            hit = np.flatnonzero(self.keys[n][np.minimum(at, len(self.keys[n]) - 1)] == key)
            if not len(hit):
                continue
            of = np.repeat(np.arange(len(left)), [len(x) for x in marked])[hit]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[left[of[first]]] = np.add.reduceat(self.scores[n][at[hit]], first, axis=0) / n
            left = np.delete(left, of[first])
        return out

    def place_all(self, strings: list[str]) -> None:
        """Gives each string the row of its score, the sum of its words' scores; 0 if there is none."""
        alone, rows = [], []
        for string in strings:
            word = string.lower().strip(MARKS)  # most strings are one word and a mark
            if (k := self.words.get(word)) is not None:
                self.number[string] = k
                continue
            found = [word] if word.isalpha() else [w for w in words_of(string) if any(map(str.isalpha, w))]
            if len(found) == 1 and found[0] in self.words:
                k = self.words[found[0]]
            elif not found:
                k = 0
            else:
                if self.used == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                k, self.used = self.used, self.used + 1
                if len(found) == 1:
                    alone.append(found[0])
                    rows.append(k)
                else:
                    self.rows[k] = 0
                    for w in found:
                        self.rows[k] += self.rows[self.words[w]] if w in self.words else self.unknown(w)
            self.number[string] = k
        if alone:
            self.rows[rows] = self.unknown_all(alone)

    def judge(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability."""
        if not self.model.langs or not text:
            return UNKNOWN, 0.0
        if len(self.number) >= CACHE:
            self.clear()
        counts = Counter(text.split())
        at = list(map(self.number.get, counts))
        if None in at:
            self.place_all([x for x, k in zip(counts, at, strict=True) if k is None])
            at = list(map(self.number.get, counts))
        if not any(at):
            return UNKNOWN, 0.0
        total = np.fromiter(counts.values(), dtype=np.float64, count=len(at)) @ self.rows[at]
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, and lang_pred and score: the likeliest of the model's languages and its probability (0 to 1, equal priors).

    lang_pred is `und`, with score 0, if the text is null or has no letter, or if the model has no language. Equal
    scores go to the first language by code point. All rows and columns stay; columns of these names are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # its size is bounded: see fit()
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = Scorer(sent.value)
        for batch in batches:
            got = [scores_of.judge(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            keep = [batch.schema.get_field_index(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(run, schema)
