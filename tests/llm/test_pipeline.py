import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from ledgerloom.llm import mixing, toxicity
from tests.llm.test_near_dedup import classes

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = [n for n in E.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(re.match(r"op(\d+)_|pipeline", n)[1] or "0" for n in names) == sorted(map(str, range(14)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pipeline_keeps_what_its_stages_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity.scored(docs, toxicity.trained(docs, labels))
    clean = {r["doc_id"] for r in scores.filter("predicted = 0").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in clean}
    best = {}
    for doc, text in texts.items():
        normal = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[normal] = min(best.get(normal, (1, 0)), (-len(text), doc))
    rows = [(doc, texts[doc]) for _, doc in best.values()]
    novel = [min(group) for group in classes(rows)]
    kept = docs.filter(F.col("doc_id").isin(novel))
    sampled = {r["doc_id"] for r in mixing.mixed(kept).filter("kept").collect()}
    made = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in made} == sampled
    assert all(0 < r["length"] <= 4096 for r in made)
