"""Queries and their SQL on rows that the given tables seldom have."""

import pytest

import __spark_entry__
from tests.compare import difference

PAGES = [
    "A &amp", "B &amp&amp;lt; &lt", "C &#39 &#128; &#x20AC &#xD800;&#7;x", "D &nosuch; &eacute &eacute; &", "E &amp;amp; &middot &middot;", "F &hellip; &#99999999999999;", "G &&& &amp&", "Z",
]
TEXTS = [
    "With", "ßachzu und", "ŉd x", "Garage sale", "City hall", "Pool", "With*** city", "ǆep y", "Ánimo", "a/b c", "city", "O'Neil x",
]


def folder(spark, path, lang="zz"):
    pages = [(i, f"https://x{i % 2}.example/{i}", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>body {t}</p></article></body></html>") for i, t in enumerate(PAGES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    docs = [(7 * i + k, f"{t}\nmore", lang, "src1", 20) for i, t in enumerate(TEXTS) for k in range(7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, "mnopqrst")], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    spark.createDataFrame([(1, 0, "u", f"{lang} mno"), (2, 0, "u", f"mno {lang}"), (3, 0, "u", "mno"), (4, 0, "u", lang)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", [
    "f1_clean", "f2_clean_no_brackets", "s10_visible_text", "s8_extract_plain", "e0_hosts", "f9_clean_place", "f10_clean_place_first_part", "f11_clean_place_sterling", "f12_clean_place_final", "f13_clean_place_titled",
])
def test_query_equals_its_sql(spark, tmp_path, name):
    assert difference(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], folder(spark, tmp_path)) is None


@pytest.mark.parametrize("lang", ["bb", "zz"])
def test_keys_at_one_place_go_by_their_names(spark, tmp_path, lang):
    """The language's key comes at 0 + 5, as the part's; 'mno' has region 0, 'bb' 3, 'zz' 2."""
    path = folder(spark, tmp_path, lang)
    query, sql = __spark_entry__.queries()["f27_region_first_key"], __spark_entry__.oracle_sql()["f27_region_first_key"]
    found = {r.body: r.region for r in query(spark, path).collect()}
    assert {found["zz mno" if lang == "zz" else "bb mno"], found["mno zz" if lang == "zz" else "mno bb"]} == {"R0" if lang == "zz" else "R3"}
    assert difference(spark, query, sql, path) is None


def test_places_are_cut_step_by_step(spark):
    """As the reference does: what an earlier step leaves is what a later one sees."""
    from pyspark.sql import functions as F

    from posada.functions import places

    row = spark.createDataFrame([("With / With city",)], "s string").select(places.clean_place(F.col("s")), places.title_case(F.lit("ßachzu o'neil"))).first()
    assert tuple(row) == ("With /", "Ssachzu O'Neil")
