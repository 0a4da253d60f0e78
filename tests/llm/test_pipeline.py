"""The pipeline's stages against brute-force versions of their decisions."""

from collections import defaultdict

import corpus_pipeline
from quillgraph.llm import hyperdim, pu_toxicity
from tests.llm.test_shingle_copies import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    kept = {name: {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/{name}").select("doc_id", "text").collect()}
            for name in list(given)[:-1]}
    before = {name: {r["doc_id"]: r["text"] for r in given[name].select("doc_id", "text").collect()} for name in given}

    prototypes = hyperdim.learn_prototypes(given["language_id"])
    own, names = hyperdim.profiler(hyperdim.DIMENSIONS, hyperdim.ORDER, hyperdim.SEED), sorted(prototypes)
    for doc_id, text in before["language_id"].items():
        vector = own.bundle([text])[0]
        best = max(float(vector @ prototypes[n]) / float((prototypes[n] ** 2).sum() ** 0.5) for n in names)
        assert (doc_id in kept["language_id"]) == (best >= corpus_pipeline.MIN_LANGUAGE_SCORE)

    weights, bias = pu_toxicity.learn(given["toxicity"], spark.read.parquet(f"{SF}/labels.parquet"))
    for doc_id, text in before["toxicity"].items():
        score = sum(weights[w] for w in pu_toxicity.features(text)) + bias
        assert (doc_id in kept["toxicity"]) == (1 / (1 + 2.718281828459045 ** -score) < pu_toxicity.THRESHOLD)

    ids = sorted(before["simhash_dedup"])
    groups = plain_groups([before["simhash_dedup"][i] for i in ids])
    assert set(kept["simhash_dedup"]) == {ids[g] for g in groups}

    sequences = defaultdict(int)
    for r in docs.collect():
        sequences[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in docs.collect()} == set(kept["simhash_dedup"])
    assert max(sequences.values()) <= 2048


def test_run_equals_stages(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert made.count() > 0


def test_repeated_and_null_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away into the dark forest"
    rows = [(7, text), (7, text), (3, text), (None, text), (None, "something else entirely is written in this one"), (5, None), (5, "12")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 3, 5, 5]
    assert corpus_pipeline.identify_language(spark, docs, SF).count() == 5
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_python_is_handed_few_texts_at_once(spark, monkeypatch):
    """The judging stages and packing bound the rows of a batch, whoever runs their result; the setting is put back."""
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def noted(module):
        inner = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, *more: (seen.append(int(spark.conf.get(name))), inner(df, *more))[1])

    noted(corpus_pipeline)
    noted(corpus_pipeline.bin_slack)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_toxic, corpus_pipeline.pack_sequences):
        made = stage(spark, docs, SF)
        if stage is not corpus_pipeline.pack_sequences:
            assert "MapInArrow" not in made._jdf.queryExecution().logical().toString()
    assert seen and max(seen) <= 512 and spark.conf.get(name) == before
