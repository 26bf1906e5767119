import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from posada.llm import samples, textops
from posada.llm import suffix_tree_lm as lm
from posada.llm.queries import op8_suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def in_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    c = Counter()
    for i, t in rows:
        if not in_fold(i):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    return {
        i: (in_fold(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*tokens(t), None])) for i, t in rows
    }


def check(got, want):
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert tuple(r[:4]) == want[i][:4]
        assert math.isclose(r[4], want[i][4], rel_tol=1e-9, abs_tol=1e-6)


def collected(df):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def spelling(words):
    """The spelling tree of the words from counts in plain Python."""
    levels = [{} for _ in range(lm.DEPTH + 1)]
    total = 0
    for w in words:
        seq = b" " * lm.DEPTH + w.encode() + b" "
        for i in range(lm.DEPTH, len(seq)):
            total += 1
            for d in range(lm.DEPTH + 1):
                level = levels[d].setdefault(seq[i - d : i], Counter())
                level[seq[i]] += 1
    return lm.Tree([{c: n for c, n in level.items() if sum(n.values()) >= lm.LEAST_SHARE * total} for level in levels])


def slow_spelt(tree, word):
    """Each byte under the longest retained suffix, found anew at each place."""
    state = {c: i for i, c in enumerate(tree.contexts)}
    seq = b" " * lm.DEPTH + word.encode() + b" "
    total = 0.0
    for i in range(lm.DEPTH, len(seq)):
        c = next(seq[i - d : i] for d in range(lm.DEPTH, -1, -1) if seq[i - d : i] in state)
        total += float(tree.log10[state[c], tree.classes[seq[i]]])
    return total


def slow_scores(rows):
    """Scores by the definition: every symbol under the longest retained context before it, with dictionaries."""
    train = [[*tokens(t), None] for i, t in rows if not in_fold(i)]
    one, two, three = Counter(), Counter(), Counter()
    for s in train:
        one.update(s)
        two.update(zip(s, s[1:]))
        three.update(zip(s, s[1:], s[2:]))
    n, v = sum(one.values()), len(one)
    cost = math.log2(v + 2)
    tree = spelling([w for w in one if w is not None])

    def root(x):
        if one[x]:
            return one[x] / (n + v + 1)
        return (v + 1) / (n + v + 1) * 10 ** (float(tree.log10[0, tree.classes[10]]) if x is None else slow_spelt(tree, x))

    def fit(counts, of_context, shorter):
        found = {}
        for run, m in counts.items():
            size = of_context[run[:-1] if len(run) > 2 else run[0]]
            if m >= lm.FOLLOWER_LEAST and size >= lm.CONTEXT_LEAST:
                share = (m - lm.DISCOUNT) / size
                bits = m * math.log2(share / shorter(run))
                if bits >= cost:
                    found.setdefault(run[:-1], []).append((run[-1], m, share, bits, size))
        out = {}
        for c, followers in found.items():
            size = followers[0][4]
            mass = 1 - sum(f[2] for f in followers)
            if sum(f[3] for f in followers) + (size - sum(f[1] for f in followers)) * math.log2(mass) >= lm.EVIDENCE:
                out[c] = mass, {f[0]: f[2] for f in followers}
        return out

    def under(contexts, c, x, shorter):
        if c not in contexts:
            return shorter
        mass, shares = contexts[c]
        return shares.get(x, 0.0) + mass * shorter

    level1 = fit(two, one, lambda run: root(run[-1]))
    p1 = lambda b, x: under(level1, (b,), x, root(x))
    level2 = fit(three, two, lambda run: p1(run[1], run[2]))
    out = {}
    for i, t in rows:
        s, total = [*tokens(t), None], 0.0
        for j, x in enumerate(s):
            p = root(x)
            if j:
                p = p1(s[j - 1], x)
            if j > 1:
                p = under(level2, (s[j - 2], s[j - 1]), x, p)
            total += math.log10(p)
        out[i] = total
    return out, len(level1), len(level2)


def corpus(n, seed=3):
    """Texts of some phrases and many words."""
    rng = random.Random(seed)
    phrases = ["new york city", "in the end", "of the sea", "as well as", "the red fox runs"]
    vocabulary = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(60)]
    return [(i, " ".join(rng.choice(phrases) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_scores_equal_definition(spark, monkeypatch):
    rows = [*corpus(500), (900, None), (901, "zzz Zürich unknownword " + "x" * 700), (902, "New York city the red")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, ones, twos = slow_scores(rows)
    assert ones > 3 and twos > 1
    for often in (0, 40, 1 << 19):
        monkeypatch.setattr(lm, "FREQUENT", often)
        monkeypatch.setattr(samples, "FILTER_BITS", 1 << (7 if often == 40 else 20))
        got = collected(lm.score_documents(df))
        check(got, base(rows))
        for i, r in got.items():
            assert math.isclose(r[5], want[i], rel_tol=1e-5, abs_tol=1e-4), i


def test_query_counts_and_held_out_scores(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collected(op8_suffix_tree(spark, sf))
    check(got, base(rows))
    want, _, _ = slow_scores(rows)
    assert all(math.isclose(r[5], want[i], rel_tol=1e-4, abs_tol=1e-3) for i, r in got.items())


def test_model_grows_with_the_corpus(spark):
    sizes = []
    for n in (300, 2500):
        df = spark.createDataFrame([(t,) for _, t in corpus(n)], "text string")
        sizes.append(lm.Model(df).values.count())
    assert sizes[1] > 1.5 * sizes[0]


def test_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "A a\tb", "ab " * 700, "\x00x \x00x", "é É", "ß z"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as base", "2 as n", "'y' as word")
    got = collected(lm.score_documents(df))
    check(got, base(rows))
    assert got[0][5] == got[1][5] < 0
    assert lm.score_documents(df.where("false")).count() == 0
    # Rows without an id are learned from; equal rows score alike; without training texts all is spelt.
    again = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b")], "doc_id long, text string")
    scores = [(r.n_known, r.train_tokens, r.score) for r in lm.score_documents(again).collect()]
    assert len(scores) == 3 and len(set(scores)) == 1 and scores[0][:2] == (3, 9)
    from pyspark.sql import functions as F

    none = [(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_documents(again, held_out=F.lit(True)).collect()]
    assert none[0][:3] == (0, 0, 0.0) and none[0][3] < -9


def test_automaton_equals_longest_suffix(spark, sf):
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() for w in tokens(r.text)})
    df = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    tree = lm.fit_tree(lm.count_runs(df), 1e-3)
    data, offsets = textops.text_buffers(pa.array([*words, "q", "\x01ÿ", "x" * 3000]))
    assert len(tree.contexts) > 50
    assert np.allclose(tree.spelt(data, offsets[:-1], offsets[1:]), [slow_spelt(tree, w) for w in [*words, "q", "\x01ÿ", "x" * 3000]], rtol=1e-4)
    p = 10.0 ** tree.log10.astype(float)
    assert np.allclose(p[:, :-1].sum(axis=1) + p[:, -1] * (256 - (p.shape[1] - 1)), 1, atol=1e-3)


def test_long_spans_hash_alike(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdé", k=rng.choice([1, 3, 900]))) for _ in range(60))
    data, offsets = textops.text_buffers(pa.array([text]))
    starts, ends, _ = textops.words(data, offsets, textops.NON_BLANK)
    whole = textops.word_hashes(data, starts, ends)
    monkeypatch.setattr(textops, "STRIDE", 256)
    assert (textops.word_hashes(data, starts, ends) == whole).all()
