"""The pipeline against its stages, judged one by one."""

import corpus_pipeline
from weftline.llm import contamination, language, mixing, near_dedup


def test_stages(spark, tmp_path, docs):
    folder = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{folder}/documents.parquet")
    leak = plain.filter("doc_id = 15").first().text
    spark.createDataFrame([(1, " ".join(leak.split()[10:40]))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, at, folder)
        if k < 4:
            assert out.columns == plain.columns
        before, after = sorted(r.doc_id for r in at.collect()), sorted(r.doc_id for r in out.collect())
        if name == "language_id":
            want = [r.doc_id for r in language.identify(at).collect() if r.lang_pred != "und" and r.score >= 0.5]
        elif name == "near_dedup":
            want = {r.doc_id for r in near_dedup.near_duplicates(at).collect() if r.kept}  # one row of each group, of repeated rows too
        elif name == "decontamination":
            want = [r.doc_id for r in contamination.contaminated(at, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if not r.matches.n_hit]
            assert 15 in before and 15 not in after
        elif name == "mixing":
            want = [r.doc_id for r in mixing.mix(mixing.described(at)).collect() if r.kept]
        else:
            want = before
        assert after == sorted(want)
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
    ran = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect())
    assert ran == sorted((r.doc_id, r.shard, r.slot) for r in at.collect())
