from collections import Counter

import corpus_pipeline
from epitrail.llm.common import DOC_COLUMNS, saved
from epitrail.llm.simhash import near_duplicates
from tests.llm.helpers import awkward, documents, empty


def test_stages_on_documents(spark, tmp_path):
    df = documents(spark, 60)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing_sources", "best_fit_packing"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert tuple(docs.columns) == DOC_COLUMNS
        seen[name] = docs.collect()
    assert {r.doc_id for r in seen["language_id"]} == set(range(60))  # clean documents stay
    lines = Counter(line for r in seen["line_dedup"] for line in r.text.split("\n") if line)
    assert set(lines.values()) == {1}
    kept = near_duplicates(spark.createDataFrame(seen["line_dedup"], docs.schema)).where("doc_id = component_id")
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"]) == sorted(r.doc_id for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in seen["mixing_sources"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_stages_on_awkward_and_empty(spark):
    for df in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            out.collect()
            if name != "best_fit_packing":
                assert tuple(out.columns) == DOC_COLUMNS
