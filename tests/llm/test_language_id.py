import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from posada.llm import language_id
from posada.llm.bpe import vocabulary_path
from posada.llm.language_id import Lattice, Scorer, Vocabulary, identify, long_word, read_vocabulary, word_scores

PIECES = [b" ", b"a", b"b", b"c", b" a", b"ab", b"abc", b"bc", b" ab", b"cab", b"\xc3", b"\xa9", b"\xc3\xa9"]
DOCS = "doc_id long, text string, lang string"


def segmentations(word):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in PIECES:
            for rest in segmentations(word[i:]):
                yield [PIECES.index(word[:i]), *rest]


def random_model(languages=3, seed=1):
    p = np.random.default_rng(seed).dirichlet(np.ones(len(PIECES)), languages).T
    return Vocabulary(PIECES), np.log(p), p


def test_forward_sums_all_segmentations():
    vocabulary, logs, p = random_model()
    for word in (b" a", b" abc", b" abcabcab", b" cabb", b" \xc3\xa9ab"):
        want = sum(np.prod(p[s], axis=0) for s in segmentations(word))
        row = np.frombuffer(word, np.uint8)[None]
        assert np.allclose(np.exp(Lattice(row, vocabulary).forward(logs)[-1, 0]), want)
        assert np.allclose(np.exp(long_word(row[0], vocabulary, logs)), want)
        assert np.allclose(np.exp(long_word(row[0], vocabulary, logs, step=2)), want)


def test_expected_uses_are_those_of_all_segmentations():
    vocabulary, logs, p = random_model()
    word, out = b" abcabca", np.zeros(len(PIECES))
    weights = [(np.prod(p[s, 1]), s) for s in segmentations(word)]
    want = sum(w * np.bincount(s, minlength=len(PIECES)) for w, s in weights) / sum(w for w, _ in weights)
    Lattice(np.frombuffer(word, np.uint8)[None], vocabulary).uses(logs[:, 1:2], np.array([7]), out)
    assert np.allclose(out, 7 * want)


def test_scores_of_texts_are_sums_over_words():
    vocabulary, logs, p = random_model()
    texts = ["abc  ab,cab 12 ABC", None, "", "a" * 300 + " bc", "abc"]
    scorer = Scorer(vocabulary, logs, np.zeros(3))
    found = scorer.scores(pa.array(texts))
    one = lambda w: np.log(sum(np.prod(p[s], axis=0) for s in segmentations(b" " + w)))
    assert np.allclose(found[0], 2 * one(b"abc") + one(b"ab") + one(b"cab"))
    assert (found[1] == 0).all() and (found[2] == 0).all()
    assert np.allclose(found[3], long_word(np.frombuffer(b" " + b"a" * 300, np.uint8), vocabulary, logs) + one(b"bc"))
    assert (scorer.scores(pa.array(texts)) == found).all()  # remembered words give the same


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    vocabulary, logs, _ = random_model()
    monkeypatch.setattr(language_id, "REMEMBERED", 10)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abc", k=5)) for _ in range(8)) for _ in range(20)]
    scorer, whole = Scorer(vocabulary, logs, np.zeros(3)), Scorer(vocabulary, logs, np.zeros(3)).scores(pa.array(texts))
    assert all((scorer.scores(pa.array([t]))[0] == w).all() for t, w in zip(texts, whole, strict=True))


def test_every_word_can_be_spelled():
    vocabulary = read_vocabulary(vocabulary_path(language_id.VOCABULARY))
    logs = np.zeros((len(vocabulary.pieces), 1))
    data = np.frombuffer("zażółć漢字ъ".encode() + bytes(range(0x80, 0x100)), np.uint8)
    assert np.isfinite(word_scores(data, np.array([0]), np.array([len(data)]), vocabulary, logs)).all()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r["lang"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def corpus(spark, n=80):
    rng = random.Random(3)
    english, german = "the of and that which house water little", "der und nicht schön straße wasser kleine haus"
    rows = [(i, " ".join(rng.choices((english if i % 2 else german).split(), k=12)), "en" if i % 2 else "de") for i in range(n)]
    return rows


def test_odd_rows(spark):
    rows = corpus(spark)
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 — !? 😀", "de"), (None, "der schön straße nicht", None), (None, "the water which", "en"), (1003, "DIE STRASSE UND DAS WASSER " * 30_000, None), (1003, "THE", "de"), (1004, "ъ", None), (1005, "x" * 100_000, None)]
    df = spark.createDataFrame(rows + odd, DOCS)
    found = identify(df).collect()
    assert len(found) == len(rows) + len(odd)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1000] == by[1001] == by[1002] == [("und", 0.0)]
    assert sorted(x[0] for x in by[None]) == ["de", "en"]
    assert sorted(x[0] for x in by[1003]) == ["de", "en"]
    assert all(x[0] in ("de", "en") for i in (1004, 1005) for x in by[i])
    again = {(r.doc_id, r.lang_pred, r.score) for r in identify(df.repartition(9)).collect()}
    assert {(i, p, round(s, 9)) for i, p, s in again} == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in found}


def test_nothing_to_learn_and_empty(spark):
    none = spark.createDataFrame([(1, "the house", None), (2, None, "en")], DOCS)
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify(none).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert identify(spark.createDataFrame([], DOCS)).collect() == []


def test_clashing_names_and_held_out_rows_are_not_learned_from(spark):
    rows = corpus(spark)
    df = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in ("id", "score", "held_out", "lang_pred", "word", "n", "rank", "source")})
    kept = F.col("doc_id") < 60
    first = {(r.doc_id, r.lang_pred, r.score) for r in identify(df, held_out=~kept).collect()}
    turned = df.withColumn("lang", F.when(kept, F.col("lang")).otherwise(F.lit("zz")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify(turned, held_out=~kept).collect()} == first


def test_posterior(spark):
    rows = corpus(spark)
    found = identify(spark.createDataFrame([*rows, (5000, "haus", None)], DOCS), held_out=F.col("doc_id") >= 5000).collect()
    assert all(0.5 <= r.score <= 1 and not math.isnan(r.score) for r in found)
