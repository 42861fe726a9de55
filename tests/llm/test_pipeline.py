"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [a + b + c for a in ("ta", "lo", "mi", "re", "sa") for b in ("na", "so", "ku", "pe") for c in ("r", "n", "st", "l", "")]
    prose = lambda n=150: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    clean = [(i, prose()) for i in range(60)]
    long = prose(600)
    item = prose(40)
    rows = [
        *clean, (100, clean[0][1]), (101, long), (102, long.replace(" ", "  ")), (103, prose().upper().replace(" ", "!! ")), (104, prose(80) + " " + item), (105, None), (106, ""),
        *((200 + i, " ".join((prose(20)[:-1], "grobunde", "grobal", prose(20)))) for i in range(8)), (300, "You moron. " + prose(30) + " Idiot, scum."),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marked = [(i, 1, 0) for i, _ in clean[:40]] + [(200 + i, 1, 1) for i in range(6)]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.collect()}
    assert ids == {i for i, _ in clean[1:]} | {100, 101}
    assert ids == {r.doc_id for r in at.collect()}
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
