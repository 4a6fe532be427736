import random
import zlib

import numpy as np
import pytest

from eventide.llm.op1_toxicity import (
    WINDOW_WORDS, classify, differences, excerpt, features, keep_ordinary, score_documents, train, train_dictionaries, training_sample,
    windows,
)

BAD = ["foulword", "slurring", "nastyterm", "vileness"]


def text_of(rng, toxic, n=120):
    words = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(6 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(0)
    return [(i, text_of(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def tables(spark, rows):
    return (spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id BIGINT, text STRING"),
            spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id BIGINT, quality INT, toxic INT"))


def test_held_out_rows_are_found(spark, labelled):
    got = {r.doc_id: r for r in classify(*tables(spark, labelled)).collect()}
    assert len(got) == 400 and all(r.held_out == held(i) for i, r in got.items())
    out = [(got[i].predicted, y) for i, _, y in labelled if held(i)]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_passages_of_ordinary_words_are_found():
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=9)) for _ in range(6)]

    def row(toxic):
        parts = [rng.choice(words) for _ in range(100)]
        if toxic:
            parts[(at := rng.randrange(90)):at] = [rng.choice(passages)]
        return " ".join(parts)

    rows = [(row(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    model = train([t for t, _ in rows[:600]], [y for _, y in rows[:600]], [1.0] * 600)
    pair = model.dictionaries.compressors()
    found = model.scores(np.array([features(differences(t, pair), model.dictionaries.threshold) for t, _ in rows[600:]])) >= 0.3
    assert sum(int(p) == y for p, (_, y) in zip(found, rows[600:])) >= 0.95 * 200


def test_labels_of_held_out_rows_are_never_read(spark, labelled):
    docs, labels = tables(spark, labelled)
    flipped = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in labelled], labels.schema)
    read = [training_sample(docs, x, "doc_id", "text", "toxic", 2_500) for x in (labels, flipped)]
    assert read[0] == read[1] and len(read[0][0]) == sum(not held(i) for i, _, _ in labelled)


def test_the_sample_is_bounded_and_weighted(spark, labelled):
    texts, toxic, weight = training_sample(*tables(spark, labelled), "doc_id", "text", "toxic", 40)
    assert sum(toxic) == len(toxic) - sum(toxic) == 40
    assert {w for w, y in zip(weight, toxic) if not y} != {1.0}


def test_a_much_repeated_id_does_not_crowd_out_others(spark, labelled):
    docs, labels = tables(spark, labelled)
    hot = next(i for i, _, y in labelled if not held(i) and not y)
    many = docs.unionByName(spark.range(2_000).selectExpr(f"{hot}L AS doc_id", "concat('text ', id) AS text"))
    read = [training_sample(x, labels, "doc_id", "text", "toxic", 20) for x in (many.repartition(1), many.repartition(7))]
    assert read[0] == read[1]
    every = training_sample(many, labels, "doc_id", "text", "toxic", 100)
    whole = training_sample(docs, labels, "doc_id", "text", "toxic", 100)
    assert len(every[0]) == len(whole[0]) and every[1:] == whole[1:] and len(set(every[0]) - set(whole[0])) <= 1


def test_toxic_windows_get_shorter(labelled):
    own = train_dictionaries([t for _, t, y in labelled if y], [t for _, t, y in labelled if not y])
    pair = own.compressors()
    rng = random.Random(9)
    clean, toxic = (np.concatenate([differences(text_of(rng, y, WINDOW_WORDS), pair) for _ in range(200)]) for y in (False, True))
    assert (toxic >= own.threshold).mean() > 0.9 and (clean >= own.threshold).mean() < 0.05


def test_edge_rows(spark, labelled, edge, empty):
    model = train([t for _, t, _ in labelled], [y for _, _, y in labelled], [1.0] * len(labelled))
    rows = score_documents(edge, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())
    nothing = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(nothing) == 1 and all(r.score is not None for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert score_documents(empty, model).collect() == [] and windows("  ") == [] and features(np.zeros(0), 1.0) == [0.0] * 6
    kept = keep_ordinary(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.score < 0.3 for r in rows)


def test_without_labels_or_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (77, 0, 1)], "doc_id BIGINT, quality INT, toxic INT")
    assert all(r.predicted == 0 for r in classify(edge, labels).collect())
    assert classify(empty, labels).collect() == []


def test_long_texts_are_read_all_over():
    """Of a text longer than the bound windows are chosen all over it, and cut again the same way."""
    text = " ".join(f"W{i}" for i in range(50_000))
    cut = excerpt(text)
    chosen = windows(cut)
    assert len(chosen) == 210 and set(chosen) <= set(windows(text)) and cut == excerpt(text)
    places = [int(w.split()[0][1:]) for w in chosen]
    assert places == sorted(places) and places[-1] > 45_000 and places[0] < 5_000
    assert excerpt("a  B\n c") == "a  B\n c" and excerpt(None) == ""
