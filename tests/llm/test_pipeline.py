"""The pipeline on a small table against what its stages must keep."""

import re

import corpus_pipeline
from tests.llm.fixtures import documents


def test_stages_keep_clean_documents_and_pack_the_rest(spark, tmp_path):
    rows = documents(spark)
    path = str(tmp_path)
    rows.write.parquet(f"{path}/documents.parquet")
    docs, kept = rows, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, path)
        assert docs.columns == rows.columns
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept.append(docs.collect())
    has_letter = [r for r in rows.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(kept[0]) == len(has_letter)
    after = [r["doc_id"] for r in kept[1]]
    assert 5 in after and not {6, 8, 27, 40} & set(after) and after.count(7) == 1 and {0, 9, 10, 11, 24} <= set(after)  # another document has id 7, too
    texts = {r["doc_id"]: r["text"] for r in kept[2]}
    assert len(texts[10]) < 600 and texts[0] == [r["text"] for r in has_letter if r["doc_id"] == 0][0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept[3]} and max(r["offset"] + r["length"] for r in packed) <= 2048
    assert corpus_pipeline.run(spark, path).count() == len(packed)
