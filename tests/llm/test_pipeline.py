"""The pipeline's stages against what their operators say, one after another."""

import corpus_pipeline
from treeslab.llm import decontaminate, mixing, neardup, quality


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
        left, right = ({r.doc_id: r.text for r in x.collect()} for x in (before, docs))
        if name == "quality rules":
            crf = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert set(right) == {r.doc_id for r in quality.judge(before, crf).where("kept").collect()}
        elif name == "near-dedup":
            assert set(right) == {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
        elif name == "decontamination":
            assert set(right) == {r.doc_id for r in decontaminate.hits(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").collect()}
        elif name == "pii":
            assert set(right) == set(left) and any(right[x] != left[x] for x in left)
        else:
            assert {(r.doc_id, r.mix_copies * r.mix_words) for r in docs.collect()} == {(r.doc_id, r.taken) for r in mixing.mix(before).collect() if r.taken}
        if name != "mixing":
            assert docs.columns == columns
        if name != "pii":
            assert all(right[x] == left[x] for x in right)
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] > kept[5] > 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(right)
