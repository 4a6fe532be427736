from collections import Counter

import corpus_pipeline
from eventide.llm.op1_toxicity import TRAIN_ROWS, score_documents, train, training_sample
from test_op2_packing import check
from test_op8_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "simhash_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = train(*training_sample(docs, labels, "doc_id", "text", "toxic", TRAIN_ROWS))
    clean = {r.doc_id for r in score_documents(docs, model).collect() if not r.predicted}
    kept = stage["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean

    odd = spark.createDataFrame([(9001, "12 34 ...", None, "s", 9), (9002, None, None, "s", None), (9003, "Ένα δύο", None, "s", 7)], docs.schema)
    known = stage["language_id"](spark, docs.unionByName(odd), SF)
    assert known.columns == docs.columns and sorted(known.collect()) == sorted(docs.collect())  # all clean ones stay

    again = docs.unionByName(docs.where("doc_id % 3 = 0"))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in again.collect()]
    firsts = stage["simhash_dedup"](spark, again, SF)
    assert firsts.columns == docs.columns
    assert sorted(r.doc_id for r in firsts.collect()) == sorted(set(plain_components(rows)))

    check(stage["packing"](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert corpus_pipeline.ORACLE_SQL is None
