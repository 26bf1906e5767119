import re

import corpus_pipeline
from posada.llm import bpe, quality

from .test_decontaminate import words
from .test_jaccard_join import brute as groups


def test_stages_equal_brute_force(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}

    good = stage["quality"](spark, docs, sf)
    scores = {r.doc_id: r.s for r in quality.score(docs, quality.fit(docs, labels), output="s").collect()}
    assert good.columns == docs.columns and set(by_id(good)) == {i for i, s in scores.items() if s >= 0.5}

    one = stage["near_duplicates"](spark, good, sf)
    parts = groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert one.columns == docs.columns and set(by_id(one)) == {i for i, (_, c) in parts.items() if i == c}

    windows = {tuple(w[j : j + 10]) for r in items.collect() for w in [words(r.text)] for j in range(len(w) - 9)}
    clean = stage["decontamination"](spark, one, sf)
    before, after = by_id(one), by_id(clean)
    for i, r in after.items():
        w = words(r.text)
        assert r.text == before[i].text or not any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))
    hit = {i for i, r in before.items() for w in [words(r.text)] if any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))}
    assert hit and all(after[i].text == r.text for i, r in before.items() if i not in hit) and all(i not in after or after[i].text != before[i].text for i in hit)

    masked = stage["personal_data"](spark, clean, sf)
    assert masked.columns == docs.columns
    for i, r in by_id(masked).items():
        assert not re.search(r"[a-z0-9.]+@[a-z0-9]+\.example", r.text) and (r.text == after[i].text or "[" in r.text)

    last = by_id(stage["bpe"](spark, masked, sf))
    v = bpe.vocabulary(bpe.vocabulary_path())
    assert {i: r.n_tokens for i, r in last.items()} == {i: len(v.encode(r.text)) // 4 for i, r in by_id(masked).items()}
    assert by_id(corpus_pipeline.run(spark, sf)) == last


def test_stages_on_empty_and_null_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (2, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, sf).count() <= 3, name
