import hashlib

import numpy as np
from tokenizers import Tokenizer

from posada.llm import bpe
from posada.llm.queries import op1_bpe

TEXTS = [
    None, "", " ", "Hello, World's end! 123", "<|startoftext|>Hi<|endoftext|> there <|x|>", "ΑΣ ΣΑΣ. İstanbul ﬁ ǅ", "a\x1cb c\x1d", "日本語 テキスト ½ ² 10x ①", "é é  x　y", "a" * 4000, "ab" * 3000 + " " + "!" * 2000,
    "😀😀 👨‍👩‍👧 ñ", "\u0085x", "'s't're 'll", "\x00\x01",
]


def expected(texts):
    t = Tokenizer.from_file(bpe.vocabulary_path())
    out = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_query_equals_library(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op1_bpe(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows]), strict=True))


def test_edge_cases_and_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens")
    out = bpe.encode_documents(df, with_ids=True)
    assert [tuple(r)[1:4] for r in sorted(out.collect())] == expected(TEXTS)
    decoded = {r.doc_id: r.decoded for r in bpe.decode_ids(out).collect()}
    assert decoded[3] == "hello</w> ,</w> world</w> 's</w> end</w> !</w> 1</w> 2</w> 3</w>" and decoded[0] == ""
    assert bpe.encode_documents(df.where("false")).count() == 0


def test_classes_equal_library_over_all_code_points():
    t, v = Tokenizer.from_file(bpe.vocabulary_path()), bpe.vocabulary(bpe.vocabulary_path())
    texts = [f"a{c}b {c}1" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)])]
    for k in range(0, len(texts), 50_000):
        part = texts[k : k + 50_000]
        assert [e.ids for e in t.encode_batch(part, add_special_tokens=False)] == [np.frombuffer(v.encode(x), "<u4").tolist() for x in part]


def test_rank_tree_yields_leftmost_lowest():
    import random

    rng = random.Random(4)
    for n in (1, 2, 31, 32, 33, 1025, 2000):
        ranks = [rng.choice([bpe.NONE, rng.randint(0, 9)]) for _ in range(n)]
        tree = bpe.RankTree(list(ranks))
        for _ in range(60):
            low = min(ranks)
            assert tree.first_lowest() == (-1 if low == bpe.NONE else ranks.index(low))
            at, ranks[at] = (at := rng.randrange(n)), rng.choice([bpe.NONE, rng.randint(0, 9)])
            tree.put(at, ranks[at])
