"""The pipeline on the smallest tables: each stage keeps the columns and does its part."""
import corpus_pipeline
from pairlane.llm import decontaminate, jaccard
from pairlane.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark):
    docs = table(spark, SF, "documents")
    first = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, SF).cache()
        assert docs.columns == first.columns and docs.count() <= before.count()
    ids = docs.select("doc_id")
    comp = jaccard.jaccard_components(docs, 5, 80)
    assert comp.where("doc_id <> component_id").count() == 0
    assert decontaminate.contaminated(docs, table(spark, SF, "benchmark")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == ids.count() > 0.5 * first.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
