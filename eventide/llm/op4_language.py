"""Language ID by rank-order n-gram profiles.

A profile is the list of a language's ``PROFILE`` most frequent letter n-grams
(one to three letters, words padded with a blank on either side) by falling
frequency. A document's own list is compared with every profile: each of its
n-grams adds how far out of place it is in the profile, or ``PROFILE`` if it is not
there. The language with the least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import held_out, pick, read

PROFILE = 300
#: Bound of the training sample: ids per language. Their whole texts are read.
TRAIN_ROWS = 1_500
UNKNOWN = "und"
#: A text this far from every profile shares next to nothing with any learnt language (clean ones stay below 0.6).
NO_LANGUAGE = 0.95
_BLANK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, packed into 64 bits in ascending order, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one blank after each word
    c = np.concatenate([[_BLANK], np.where(letter, codes, _BLANK)[kept], [_BLANK] if letter[-1] else []]).astype(np.int64)
    word = c != _BLANK
    one = c[word]
    two = (c[:-1] | c[1:] << 21)[word[:-1] | word[1:]]
    three = (c[:-2] | c[1:-1] << 21 | c[2:] << 42)[word[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranking(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the packed n-gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")][:size]


@dataclass(frozen=True)
class Profiles:
    """All profiles as one table: n-grams in ascending order and their rank in each language."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(ranked: dict[str, list[int]]) -> Profiles:
        languages = sorted(ranked)
        keys = np.array(sorted({k for v in ranked.values() for k in v}), np.int64)
        ranks = np.full((len(keys), len(languages)), -1, np.int64)
        for j, language in enumerate(languages):
            ranks[np.searchsorted(keys, ranked[language]), j] = np.arange(len(ranked[language]))
        return Profiles(languages, keys, ranks)

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranking to every language, as a share of the largest possible."""
        total = np.full(len(self.languages), len(top) * PROFILE, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[at] == top)
            ranks = self.ranks[at[known]]
            total -= np.where(ranks < 0, 0, PROFILE - np.abs(ranks - known[:, None])).sum(0)
        return total / max(1, len(top) * PROFILE)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language (ties: the first by name), score and distance of a whole text."""
        top = ranking(*ngrams(text))
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0, 1.0
        distance = self.distances(top)
        best = int(distance.argmin())
        rest = np.delete(distance, best)
        second = float(rest.min()) if len(rest) else 1.0
        score = (second - float(distance[best])) / second if second > 0 else 0.0
        return self.languages[best], score, float(distance[best])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows_per_language: int = TRAIN_ROWS) -> Profiles:
    """Profiles from the whole texts of ``rows_per_language`` ids of each language (all, if fewer), the first by a hash
    of the id among those that are not held out. Of repeated rows of an id one text is read, chosen by a hash."""
    known = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out(F.col("doc_id")))
    known = known.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = known.select("lang", "doc_id").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    chosen = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows_per_language).drop("place")
    # languages times rows_per_language ids at most: the texts are not shuffled
    sample = known.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("first")).select("lang", "first.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(lang, {})
                for key, n in zip(*(x.tolist() for x in ngrams(text))):
                    own[key] = own.get(key, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())],
                                             names=["lang", "ngram", "n"])

    grams = sample.mapInArrow(count, "lang string, ngram bigint, n bigint").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    part = grams.withColumn("part", F.pmod(F.xxhash64("ngram"), F.lit(64)))
    order = [F.col("n").desc(), F.col("ngram")]
    first = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= PROFILE)
    top = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= PROFILE)
    ranked: dict[str, list[int]] = {}
    for r in top.select("lang", "rank", "ngram").orderBy("lang", "rank").collect():  # PROFILE rows per language
        ranked.setdefault(r.lang, []).append(r.ngram)
    return Profiles.of(ranked)


def predict_documents(docs: DataFrame, fitted: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every whole text: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``distance``.

    ``score`` is how much nearer the language is than the second (0 to 1);
    ``distance`` is the out-of-place distance (0 to 1; 1: no n-gram in common).
    Null texts and texts without a letter give ``und`` with score 0 and distance 1, and so does
    every text if no language could be learnt. One row per input row, repeated
    rows and null ids too; other input columns are not read. No shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # PROFILE numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()),
                 pa.array([x for _, _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score", "distance"])

    schema = f"doc_id {kind}, lang_pred string, score double, distance double"
    out = pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance")


def keep_known(docs: DataFrame, fitted: Profiles, text_col: str = "text", distance_from: float = NO_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are in a learnt language: rejected are
    texts without a letter and texts as far as ``distance_from`` from every profile."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and distance < distance_from for lang, _, distance in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict_documents(docs, profiles(docs))
