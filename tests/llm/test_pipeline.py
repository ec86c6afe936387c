"""The pipeline: columns stage by stage, and the registered queries against their SQL."""

import pytest

import corpus_pipeline
from oracle import compare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts, frames = [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, str(small)))
        assert docs.columns == COLUMNS, name
        frames.append(docs)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    words = [sum(len((r.text or "").split()) for r in f.select("text").collect()) for f in frames[3:]]
    assert abs(words[0] - words[1]) <= 20
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(small)).collect()
    assert len(last) == counts[-1] and all(r.restored for r in last)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_quality_rules", "op10_warc_round_trip"])
def test_query_matches_its_sql(spark, duck, small, name):
    verdict, _, _ = compare(spark, duck, name, small)
    assert verdict.startswith("ok"), verdict
