import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from posada.llm import filter_audit


def failed(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" * (len(words) < 100)
    out += "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    out += "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * copy


def plain_audit(docs, labels):
    """The definition, row by row, for every order."""
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    rows = []
    for i, text, lang in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)
        rows.append((lang or "", failed(text, copy), good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                there = [r for r in own if not set(r[1]) & set(order[: step - 1])]
                gone = [r for r in there if letter in r[1]]
                late = [r for r in own if letter in r[1] and set(r[1]) & set(order[: step - 1])]
                removed[letter] += len(gone)
                out[part, order, step] = [len(there) - len(gone), len(gone), len(late), sum(r[1] == letter for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed[order[step - 1]])
    return {k: tuple(map(int, v)) for k, v in out.items()}


DOC, LABEL = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def audited(spark, docs, labels, **more):
    rows = filter_audit.audit_documents(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), **more).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in (*filter_audit.MEASURES, "shapley")) for r in rows}


def test_equal_to_the_definition_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "de"), (None, long, "de"), (0, long + " #", "en"), (4, None, ""), (5, "", None), (6, "A" * 500, "de"),
        (7, "ab " * 400, "de"), (8, "AB* " * 400, "xx"), (9, "é ü ß " * 60 + "Z" * 39, "fr"), (9, "é ü ß " * 60 + "Z" * 40, "fr"), (10, "x " * 200_000, "fr"), (1, long, "fr"), (11, "AB* " * 400, "xx"),
    ]
    labels = [(1, 1, 0), (2, None, 1), (2, 0, None), (6, 1, 1), (7, None, None), (None, 1, 1), (99, 1, 1), (10, 1, 0)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, "a", "en")], [])) == 600


def test_columns_with_clashing_names_and_own_filters(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a")], "key long, body string")
    odd = docs.withColumns({n: F.lit("x") for n in ("part", "mask", "digest", "good", "n", "least", "text", "lang", "__id")})
    labels = spark.createDataFrame([(1, 1, 1)], LABEL).withColumnRenamed("doc_id", "key")
    text = F.col("text")
    found = filter_audit.audit_documents(odd, labels, {"X": F.length(text) < 2, "Y": filter_audit.COPY}, id_col="key", text_col="body").collect()
    assert {(r.part, r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in found} == {("x", "XY", 1, 1, 2, 3), ("x", "XY", 2, 1, 0, 1), ("x", "YX", 1, 2, 1, 1), ("x", "YX", 2, 1, 1, 3)}


def test_sums_on_the_whole_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = filter_audit.audit_documents(docs, labels).collect()
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    for part, n in counts.items():
        for order in {r.filter_order for r in rows}:
            steps = [r for r in rows if (r.part, r.filter_order) == (part, order)]
            assert min(r.kept for r in steps) + sum(r.removed for r in steps) == n


def test_too_many_filters(spark):
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFG")
