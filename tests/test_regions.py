import pytest
from pyspark.sql import functions as F

from posada import queries
from posada.functions.text import folded_lower
from posada.queries import bind


@pytest.mark.parametrize("name", ["j11_region_longest_whole", "f39_region_first_key_whole"])
def test_keys_are_searched_in_whole_texts(spark, tmp_path, name):
    texts = ["nothing\nblue Ox", "blue\nblue oxen", "zz\nzz\nÓxide", "ox", "zz", None]
    spark.createDataFrame([(i, t, "qq") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, "ox"), (5, "blue"), (6, "oxen"), (7, "oxide")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    longest = name.startswith("j")
    keys = {r.key: (-len(r.key) if longest else 0, r.ord, r.region) for r in bind.gazetteer(spark, str(tmp_path)).where("key != ''").collect()}
    fold = folded_lower(F.col("text")) if longest else F.lower("text")
    bodies = {r.b for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select(fold.alias("b")).collect() if r.b is not None}
    want = {b: min((v for k, v in keys.items() if k in b), default=(None,))[-1] for b in bodies}
    got = {r.body: r.region for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == want and want["nothing\nblue ox"] is not None


def test_every_portal_has_one_name():
    from posada.sources import details, pages

    of_details = {s for rule in details.LATER for s in rule.sources} | {"ThinkSpain"}
    only_lists = {"Kyero", "Fotocasa", "Habitaclia", "plain"}  # no later visit to these
    assert set(pages.PORTALS) - only_lists <= of_details and of_details - {"ThinkSpain"} <= set(pages.PORTALS)
