from collections import Counter

import corpus_pipeline
from armwatch.llm.byte_bpe import decoder
from armwatch.session import stored


def test_each_stage_works_on_what_the_one_before_kept(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], path)))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert all(after <= before for before, after in zip(ids, ids[1:]))
    assert ids[2] == ids[3] and len(ids[2]) < len(ids[0])
    mixed = Counter(r.text for r in kept[4].select("text").collect())
    found = corpus_pipeline.run(spark, path).collect()
    assert Counter(decoder(None).decode(r.ids).decode() for r in found) == mixed
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
