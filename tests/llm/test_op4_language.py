import zlib
from collections import Counter

import numpy as np

from eventide.llm.op4_language import PROFILE, Profiles, keep_known, ngrams, predict_documents, profiles, ranking

SENTENCES = {
    "en": "the weather was fine and they walked through the old town with their friends until the evening",
    "de": "das wetter war schön und sie gingen mit ihren freunden durch die alte stadt bis zum späten abend",
    "fr": "le temps était beau et ils marchaient dans la vieille ville avec leurs amis jusqu'au soir tombé",
}


def plain_counts(text):
    out = Counter()
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f"\x01{word}\x01"
            out.update(word)
            for n in (2, 3):
                out.update(g for g in (padded[i:i + n] for i in range(len(padded) - n + 1)) if g.strip("\x01"))
            word = ""
    return out


def pack(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def test_ngrams_equal_a_plain_count():
    for text in (None, "", "a", "ab c", "It's  9 Über-naïve!\n漢字 𝒳x", "x" * 50, "a.b,c"):
        keys, counts = ngrams(text)
        want = {}
        for gram, n in plain_counts(text).items():
            want[pack(gram)] = want.get(pack(gram), 0) + n
        assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_ranking_breaks_ties_by_the_ngram():
    keys = np.arange(1000)
    counts = np.where(keys % 2, 5, 3)
    want = sorted(keys.tolist(), key=lambda k: (-counts[k], k))[:PROFILE]
    assert ranking(keys, counts).tolist() == want


def test_distance_is_out_of_place():
    own = Profiles.of({"a": [10, 20, 30], "b": [30, 10]})
    top = np.array([30, 99, 10])
    far = PROFILE
    assert np.allclose(own.distances(top), np.array([2 + far + 2, 0 + far + 1]) / (3 * far))
    assert Profiles.of({}).predict("text") == ("und", 0.0, 1.0)
    assert own.predict("123 ...") == ("und", 0.0, 1.0)


def corpus(spark, n=60):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(s.split())), lang) for i, (lang, s) in
            enumerate((lang, s) for _ in range(n) for lang, s in SENTENCES.items())]
    return rows, spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id BIGINT, text STRING, lang STRING, lang_pred STRING, score DOUBLE")


def test_held_out_accuracy_and_no_leak(spark):
    rows, docs = corpus(spark)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    fitted = profiles(docs)
    got = {r.doc_id: r for r in predict_documents(docs, fitted).collect()}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    other = profiles(wrong)
    assert other.languages == fitted.languages and (other.ranks == fitted.ranks).all()


def test_edge_rows(spark, edge, empty):
    _, docs = corpus(spark)
    fitted = profiles(docs)
    rows = predict_documents(edge, fitted).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, 7}
    assert all(r.score == 0 and r.distance == 1 for r in rows if r.lang_pred == "und")
    kept = keep_known(edge, fitted)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {1, 5, None}
    assert not {r.doc_id for r in kept.collect()} & {2, 3, 4, 7}
    assert predict_documents(empty, fitted).collect() == [] and profiles(edge).languages == profiles(empty).languages == []


def test_a_language_on_few_much_repeated_ids_gets_its_profile(spark):
    rows = [(7, "einerlei viele zeilen", "de")] * 3000 + [(i, f"many different lines {i}", "en") for i in range(200)]
    long = "zzz " * 30_000 + "qqqq xxxx " * 60_000  # what comes late counts
    rows += [(i, long, "late") for i in (1001, 1004)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    fitted = profiles(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), rows_per_language=20)
    assert {"en", "late"} <= set(fitted.languages) and (("de" in fitted.languages) == any(r[0] == 7 for r in rows))
    assert fitted.predict("qqqq xxxx qqqq")[0] == "late"
