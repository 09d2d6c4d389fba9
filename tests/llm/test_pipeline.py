"""The pipeline stage by stage against what the operators say, on a small corpus."""

import random

import corpus_pipeline

from stratal.llm import decontamination, jaccard_join, quality, toxicity

WORDS = ["river", "stone", "light", "carry", "window", "paper", "garden", "silver", "morning", "quiet", "letters", "bridge", "under", "over"]


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(3)
    item = " ".join(f"item{k}" for k in range(25))
    docs, labels = [], []
    for k in range(300):
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)]
        bad, toxic = k % 6 == 1, k % 6 == 2
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[5] = "grobnik"
        if k % 6 == 3:
            words += item.split()
        docs.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(1000 + k, docs[0][1] + " extra", "en", "s", 1) for k in range(5)] + [(2000, None, None, None, None)]
    root = str(tmp_path)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    lab = spark.read.parquet(f"{root}/labels.parquet")
    ids, current = [], spark.read.parquet(f"{root}/documents.parquet")
    expected = [
        lambda x: {r["doc_id"] for r in quality.quality(x, lab).where("predicted = 1").collect()},
        lambda x: {r["doc_id"] for r in toxicity.toxicity(x, lab).where("predicted = 0").collect()},
        lambda x: {r["component_id"] for r in jaccard_join.jaccard_join(x, 5, 80).collect()},
        lambda x: {r["doc_id"] for r in x.collect()} - {r["doc_id"] for r in decontamination.tile(x, spark.read.parquet(f"{root}/benchmark.parquet")).collect()},
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        out = stage(spark, current, root)
        assert out.columns == d.columns
        out.write.parquet(f"{root}/{name}")
        wanted, current = want(current), spark.read.parquet(f"{root}/{name}")
        ids.append({r["doc_id"] for r in current.collect()})
        assert ids[-1] == wanted
    clean = {k for k in range(300) if k % 6 in (0, 4, 5)}
    assert len(clean - ids[-1]) <= 3  # the classifiers learn from 240 documents here
    assert not ids[-1] & ({k for k in range(300) if k % 6 in (1, 2, 3)} | set(range(1000, 1005)))
    packed = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"] for r in packed} == ids[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double"


def _write(spark, root, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "an item of some words"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_an_empty_table(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    text = lambda k: " ".join(rng.choice(WORDS).upper() + "!!" if k % 4 == 0 else rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(50)) + (" grobnik" if k % 5 == 0 else "")
    docs = [(k, text(k), None, "s", None, 7, 0.5) for k in range(40)]
    docs += [docs[3], docs[3], (None, docs[7][1], "de", None, 1, None, None), (None, "quiet words without an id", None, None, None, None, None), (None, None, None, None, None, None, None), (50, None, "en", "s", 0, 1, 1.0), (51, "", "en", "s", 0, 1, 1.0), (52, "calm river " * 20_000, "en", "s", 1, 1, 1.0)]
    _write(spark, tmp_path, docs)
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, str(tmp_path))
        assert out.schema.simpleString() == current.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        before, current = current, spark.read.parquet(f"{tmp_path}/{name}")
        assert current.exceptAll(before).count() == 0  # whole rows, none twice
    ids = [r["doc_id"] for r in current.collect()]
    assert len(ids) == len([i for i in ids if i is None]) + len({i for i in ids if i is not None})  # repeats are gone
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == sorted({str(i) for i in ids})


def test_results_of_python_workers_come_in_small_batches(spark, tmp_path):
    """Whole texts pass through the workers' result of a stage by 4 MB, not by Spark's 10,000 rows."""
    _write(spark, tmp_path, [(k, f"{k} calm river " * 2_000, "en", "s", 1, 1, 1.0) for k in range(400)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.toxicity_classifier, corpus_pipeline.benchmark_leaks):
            spark.conf.unset(key)
            stage(spark, docs, str(tmp_path))
            assert int(spark.conf.get(key)) <= 4_000_000
        sizes = docs.select("text").mapInArrow(lambda batches: (b.append_column("n", [b.num_rows] * b.num_rows).select(["n"]) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) < 400
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_a_worker_gives_back_what_it_kept_before_it_makes_more(monkeypatch):
    from stratal.llm import common

    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append("freed"))
    common.process_cache("first_of_two", list)
    common.process_cache("second_of_two", lambda: freed.append("made"))
    assert freed[-2:] == ["freed", "made"]
    common.forget_caches()
