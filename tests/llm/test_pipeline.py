import corpus_pipeline
import public_tokenizers
from tests.llm.test_lines import brute as line_classes
from tests.llm.test_neardup import brute as near_classes
from tests.llm.test_packing import check


def test_stages_and_run(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_neardup", "source_mixing", "best_fit_packing"]
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, at).cache()
    assert kept.count() == docs.count() and kept.columns == docs.columns
    deduped = corpus_pipeline.line_dedup(spark, kept, at).cache()
    rows = [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()]
    classes = line_classes([(d, "\n".join(x for x in t.split("\n"))) for d, t in rows]) if sum(len(t) for _, t in rows) < 200_000 else None
    firsts = {}
    for d, t in rows:
        for nr, x in enumerate(t.split("\n")):
            firsts.setdefault(x, (d, nr))
    for r in deduped.collect():
        own = dict(rows)[r.doc_id].split("\n")
        assert all(x in own for x in r.text.split("\n")) and r.n_chars == len(r.text) or r.n_chars == len(dict(rows)[r.doc_id])
        if classes is None:
            # No line stays that stands whole in an earlier place.
            assert all(firsts[x][0] == r.doc_id for x in r.text.split("\n") if x.strip(" "))
    lone = corpus_pipeline.minhash_neardup(spark, deduped, at).cache()
    want = near_classes([(r.doc_id, r.text) for r in deduped.collect()], 5, 80)
    assert sorted(r.doc_id for r in lone.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    mixed = corpus_pipeline.source_mixing(spark, lone, at).cache()
    assert mixed.columns == docs.columns and lone.count() < mixed.count() <= 2 * lone.count()
    packed = corpus_pipeline.best_fit_packing(spark, mixed, at).collect()
    check(packed, [(r.doc_id, r.text) for r in mixed.collect()], 2048)
    assert public_tokenizers
    assert len(corpus_pipeline.run(spark, at).collect()) == len(packed)


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            assert k == 4 or out.columns == docs.columns
            rows = out.collect()
            assert docs is not none or rows == []


def test_repeated_ids_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (2, "q r s t u v"), (None, "a b c d e f")], "doc_id long, text string")
    rows = corpus_pipeline.minhash_neardup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v")]
