"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
toxic text. The toxic one is trained on whole windows of toxic rows, on their passages
(word triples that several of them use and ordinary rows hardly do) or on the words
that toxic rows use in several different contexts and that ordinary rows use far more
rarely (copies of one row repeat a context and so count once): on whichever describes
best the rows that it was not trained on. Every window of a text is compressed twice: with
the ordinary dictionary, and with the toxic one put before it. Windows without
toxic content find the same matches either way, so the difference of the two
lengths stays near zero; toxic content shortens the second.

The differences of a text (largest, three largest, mean, windows above the
calibrated threshold) give its score through a logistic calibration that is
fitted across two folds: rows are described by dictionaries that never saw them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import col, held_out, pick, read

WINDOW_WORDS, LEVEL, TOXIC_FROM = 16, 9, 0.3
#: Bounds of the training sample: rows per class, and windows of one row, chosen all over its text.
TRAIN_ROWS, TRAIN_WINDOWS = 2_500, 210
#: Windows of ordinary rows that set the threshold of a difference, at most.
THRESHOLD_WINDOWS = 20_000
ORDINARY_BYTES = 65_536
#: Toxic dictionaries to choose from by validation across the folds: what they are trained on, the least
#: contexts of a word or rows of a passage, and bytes.
KINDS = (("words", 4, 4_096), ("words", 2, 16_384), ("passages", 3, 16_384), ("windows", 0, 16_384))
#: A toxic excerpt: a word at least this many times as frequent as in ordinary rows.
MIN_RATIO, PREFIXES = 20.0, (4, 5, 6)
#: The threshold of a window: this share of ordinary windows lies below it.
ORDINARY_BELOW = 0.999


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    """The text's words, lower-cased, in windows of ``size``."""
    words = (text or "").lower().split()
    return [f" {' '.join(words[at:at + size])} ".encode() for at in range(0, len(words), size)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=plain, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; samples too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _contexts(texts: list[str]) -> dict[str, int]:
    """Words and in how many different contexts (word before, word after) they stand."""
    number: dict[str, int] = {"": 0}
    keys = []
    for text in texts:
        ids = np.array([0, *[number.setdefault(w, len(number)) for w in text.lower().split()], 0], np.uint64)
        around = ids[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ ids[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        keys.append(ids[1:-1] << np.uint64(40) | around >> np.uint64(24))
    seen = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    counts = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=len(number)).tolist()
    return {w: counts[i] for w, i in number.items() if w}


def _excerpts(toxic: dict[str, int], ordinary: dict[str, int], contexts: int) -> dict[str, int]:
    """Words that mark toxic text, by themselves or by their first letters (endings vary)."""

    def units(counts: dict[str, int]) -> dict[str, int]:
        total: dict[str, int] = {}
        for word, n in counts.items():
            for unit in {word, *(word[:k] for k in PREFIXES if k < len(word))}:
                total[unit] = total.get(unit, 0) + n
        return total

    n_toxic, n_ordinary = max(1, sum(toxic.values())), max(1, sum(ordinary.values()))
    plain = units(ordinary)
    marked = {u for u, n in units(toxic).items()
              if n >= contexts and n / n_toxic > MIN_RATIO * (plain.get(u, 0) + 0.5) / n_ordinary}
    return {w: n for w, n in toxic.items() if w in marked or any(w[:k] in marked for k in PREFIXES)}


def _passages(toxic: list[str], ordinary: list[str], least: int) -> list[str]:
    """Passages of toxic rows: runs of word triples that at least ``least`` of these use and ordinary rows
    use far more rarely, whatever their single words are."""
    number: dict[str, int] = {}

    def triples(words: list[str]) -> np.ndarray:
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
        return ((ids[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ ids[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ ids[2:]) * np.uint64(0x165667B19E3779F9)

    rows = [text.lower().split() for text in dict.fromkeys(toxic)]
    own = [triples(words) for words in rows]
    kinds, count = np.unique(np.concatenate([np.unique(x) for x in own] or [np.zeros(0, np.uint64)]), return_counts=True)
    kinds, count = kinds[count >= least], count[count >= least]
    plain = np.zeros(len(kinds), np.int64)
    for text in ordinary:
        plain += np.isin(kinds, triples(text.lower().split()))
    marked = kinds[count / max(1, len(rows)) > MIN_RATIO * (plain + 0.5) / max(1, len(ordinary))]
    out = []
    for words, found in zip(rows, own):
        covered = np.zeros(len(words) + 2, bool)
        for k in np.flatnonzero(np.isin(found, marked)).tolist():
            covered[k + 1:k + 4] = True
        edges = np.flatnonzero(np.diff(covered)).tolist()
        out += [" ".join(words[i:j]) for i, j in zip(edges[::2], edges[1::2])]
    return out


@dataclass(frozen=True)
class Dictionaries:
    """The two trained dictionaries and the window threshold."""

    ordinary: bytes
    toxic: bytes
    threshold: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibrated weights; a few tens of kilobytes."""

    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])
        # row by row: a matrix product rounds by the place in the batch
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(1), -30, 30)))


def differences(text: str | None, compressors: tuple) -> np.ndarray:
    """Ordinary minus toxic compressed length of every window of a text."""
    ordinary, toxic = compressors
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], np.float64)


def features(found: np.ndarray, threshold: float) -> list[float]:
    """What the calibration sees of a text; zeros if it has no windows."""
    if not len(found):
        return [0.0] * 6
    top = np.sort(found)[::-1][:3]
    over = int((found >= threshold).sum())
    return [float(top[0]), float(top.sum()), float(found.mean()), np.log1p(over), over / len(found),
            np.log1p(len(found)) * min(1.0, over)]


def train_dictionaries(toxic: list[str], ordinary: list[str], kind: tuple = KINDS[0]) -> Dictionaries:
    return _train_kinds(toxic, ordinary, (kind,))[0]


def _train_kinds(toxic: list[str], ordinary: list[str], kinds: tuple) -> list[Dictionaries]:
    """One pair per kind; the ordinary dictionary is theirs in common."""
    plain = [w for text in ordinary for w in windows(text)]
    order = np.random.default_rng(0).permutation(len(plain))
    plain = [plain[i] for i in order]
    base = _dictionary(plain[:len(plain) * 3 // 4] or [b" "], ORDINARY_BYTES)
    one, rest = _compressor(base), plain[len(plain) * 3 // 4:][:THRESHOLD_WINDOWS]
    lengths = [len(one.compress(w)) for w in rest]
    used, plainly = _contexts(toxic), _contexts(ordinary)
    out = []
    for what, least, size in kinds:
        if what == "windows":
            samples = [w for text in dict.fromkeys(toxic) for w in windows(text)]
        elif what == "passages":
            samples = [f" {x} ".encode() for x in _passages(toxic, ordinary, least)]
        else:
            samples = [f" {w} ".encode() for w, n in sorted(_excerpts(used, plainly, least).items()) for _ in range(n)]
        samples = [samples[i] for i in np.random.default_rng(1).permutation(len(samples))]
        focus = _dictionary(samples, size)
        both = _compressor(focus + base)
        found = [n - len(both.compress(w)) for n, w in zip(lengths, rest)]
        out.append(Dictionaries(base, focus, max(1.0, float(np.quantile(found, ORDINARY_BELOW))) if found else 1.0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression by Newton steps; features are standardised."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def train(texts: list[str], toxic: list[int], weight: list[float]) -> Model:
    """Fit on a bounded sample. ``weight`` undoes a different sampling of the classes."""
    y = np.array(toxic, np.float64)
    fold = np.array([zlib.crc32(text.encode()) % 2 for text in texts], np.int64)  # equal texts share their fold
    rows = np.zeros((len(KINDS), len(texts), 6))
    for part in (0, 1):
        learn = [i for i in range(len(texts)) if fold[i] != part]
        own = _train_kinds([texts[i] for i in learn if y[i]], [texts[i] for i in learn if not y[i]], KINDS)
        one, both = _compressor(own[0].ordinary), [x.compressors()[1] for x in own]
        for i in np.flatnonzero(fold == part):
            cut = windows(texts[i])
            plain = np.array([len(one.compress(w)) for w in cut], np.float64)
            for k, with_toxic in enumerate(both):
                rows[k, i] = features(plain - [len(with_toxic.compress(w)) for w in cut], own[k].threshold)
    halves = [t for t, k in zip(texts, y) if k], [t for t, k in zip(texts, y) if not k]
    if len(texts) == 0:
        return Model(train_dictionaries(*halves), np.zeros(6), np.ones(6), np.array([-5.0] + [0.0] * 6))
    fits = [_logistic(x, y, np.array(weight)) for x in rows]
    losses = [_loss(Model(own[0], *fit).scores(x), y, np.array(weight)) for x, fit in zip(rows, fits)]
    best = int(np.argmin(losses))
    return Model(train_dictionaries(*halves, KINDS[best]), *fits[best])


def _loss(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of rows that the dictionaries never saw."""
    return float(-(weight * np.log(np.clip(np.where(y == 1, scores, 1 - scores), 1e-12, 1))).sum() / weight.sum())


def excerpt(text: str | None, most: int = TRAIN_WINDOWS, size: int = WINDOW_WORDS) -> str:
    """The text, or ``most`` of its windows of ``size`` words, chosen by a hash all over it, in their order."""
    words = (text or "").split()
    if len(words) <= most * size:
        return text or ""
    starts = range(0, len(words), size)
    chosen = sorted(sorted(starts, key=lambda at: zlib.crc32(f"{at} {' '.join(words[at:at + size])}".encode()))[:most])
    return " ".join(" ".join(words[at:at + size]) for at in chosen)  # only the last can be short: it is cut the same way again


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows_per_class: int) -> tuple[list[str], list[int], list[float]]:
    """The texts (``excerpt``) of at most ``rows_per_class`` labelled ids of each class that are not held out.

    Ids are chosen by a hash; repeated labels of an id count once (the largest), and of
    repeated rows of an id one text is read, chosen by a hash: every sampled id has its text
    however often others are repeated, and the sample is the same in every run.
    """
    known = (pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    share = {k: min(1.0, rows_per_class / n) for k, n in counts.items()}
    place = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.where(F.col("label") == k).orderBy(place, "doc_id").limit(rows_per_class) for k in (0, 1)]
    text = F.coalesce(col("text"), F.lit("")).alias("text")
    # two times rows_per_class ids at most: the texts are not shuffled
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    one = (pick(docs, doc_id=id_col, text=text_col).join(sample, "doc_id").select("doc_id", "label", text)
           .groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("first")))
    kind = one.schema["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([excerpt(t) for t in batch.column(2).to_pylist()], pa.string())],
                                             names=["doc_id", "label", "text"])

    whole = one.select("doc_id", F.col("label").cast("int").alias("label"), "first.text")
    rows = whole.mapInArrow(cut, f"doc_id {kind.dataType.simpleString()}, label int, text string").collect()  # one row per sampled id
    rows.sort(key=lambda r: (str(r.doc_id), r.text))
    return [r.text for r in rows], [r.label for r in rows], [1 / share[r.label] for r in rows]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    toxic_from: float = TOXIC_FROM) -> DataFrame:
    """Score every whole text: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``toxic_from``).

    One row per input row, also for null and empty texts (no windows: the score of
    a text without any difference), null ids and repeated rows. Other input
    columns are not read. No shuffle; a task holds the model and one batch.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        pair, threshold = fitted.dictionaries.compressors(), fitted.dictionaries.threshold
        for batch in batches:
            if batch.num_rows:
                rows = [features(differences(t, pair), threshold) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(np.array(rows)))], names=["doc_id", "score"])

    scored = pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxic_from).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``toxic_from``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        pair, threshold = fitted.dictionaries.compressors(), fitted.dictionaries.threshold
        for batch in batches:
            if batch.num_rows:
                rows = [features(differences(t, pair), threshold) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(fitted.scores(np.array(rows)) < toxic_from))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", rows_per_class: int = TRAIN_ROWS) -> DataFrame:
    """Train on a bounded sample of the labelled rows and score all documents.

    Without labelled rows nothing can be learnt: every score is near zero.
    """
    model = train(*training_sample(docs, labels, id_col, text_col, label_col, rows_per_class))
    return score_documents(docs, model, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
