from pyspark.sql import functions as F

from posada.operators import candidates, model
from posada.queries import QUERIES, bind


def test_rows_of_one_small_file_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bind, "ROWS_A_TASK", 10)
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("red mint").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("TIN").alias("p_type"), F.lit(7).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("s8_extract_others", "s8_extract_portals", "s8_extract_more", "s8_regex_cards", "s9_luxury_listing", "s9_luxury_again", "s9_think", "s9_idealista", "f1_references"):
        found = QUERIES[name](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 20, name


def test_best_cards_by_name_equal_those_of_all_pairs(spark):
    """Many licences and cards of few names; towns and names with nulls and repeated words."""
    names = ["Casa Sol Ronda 1", "Sol Casa Ronda 1", "casa sol ronda", "Hotel Mar", None, "", "Sol sol Ronda"]
    licences = spark.createDataFrame([(i, names[i % 7], ["Ronda", None, "Lugo"][i % 3]) for i in range(60)], "id long, name string, town string")
    cards = spark.createDataFrame([(100 - i, ["hotel sol ronda 1", "Mar Hotel", "casa ronda sol", None, "Sol Ronda"][i % 5]) for i in range(40)], "id long, name string")
    score = lambda new, old: model.match_score(F.bround(1 - F.levenshtein(new, old) / F.greatest(F.length(new), F.length(old)), 6), F.col("town"), F.lit(None).cast("string"), F.col(old))
    met = candidates.candidates(licences, cards).join(licences.select(F.col("id").alias("licence"), "town", F.col("name").alias("new")), "licence").join(cards.select(F.col("id").alias("card"), F.col("name").alias("old")), "card")
    want = met.withColumn("score", score("new", "old")).groupBy("licence").agg(F.min_by(F.struct("card", "score"), F.struct(-F.col("score"), F.col("card"))).alias("best")).select("licence", "best.*")
    found = candidates.best_by_name(licences, cards, score("name", "card_name"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 20
