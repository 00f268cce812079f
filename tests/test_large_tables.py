"""Plans and patterns that keep large tables cheap, with the results they must not change."""
from pyspark.sql import functions as F

from shopaudit.catalog import page_queries
from shopaudit.functions import text, urls
from shopaudit.session import positions


def test_ranked_rows_are_joined_without_sorting_them(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    ranked = positions(rows, ["k"], "o", target=10)
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["o"]): r["position"] for r in ranked.collect()} == {(i % 3, i): i // 3 for i in range(100)}


def test_made_pages_are_spread_before_they_are_read(spark, tmp_path):
    spark.range(8).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "REPARTITION_BY_NUM" in page_queries.nested_buttons(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_a_term_is_looked_for_where_its_first_letter_stands(spark):
    assert text.term_pattern(["eco", "bio*"]).startswith("(?=[be])")
    hits = spark.createDataFrame([("an eco bag",), ("biology",), ("economy",), ("beco",)], "t string").select(text.has_term(F.col("t"), ["eco", "bio*"]))
    assert [r[0] for r in hits.collect()] == [True, True, False, False]


def test_canonical_addresses_are_taken_as_they_stand(spark):
    plain = ["https://a.example/p/q.html?x=1#f", "http://shop1.de", "https://a-b.fr/x//y/"]
    other = ["https://a.example/.x/../y", "https://127.0.0.1/", "https://A.example/", "https://a.example:443/", "https://a.example/é"]
    df = spark.createDataFrame([(u,) for u in plain + other], "u string").select(
        F.col("u").rlike(urls.PLAIN).alias("plain"), urls.parse(F.col("u")).alias("own"),
        # Upper case takes the long way and comes to the same parts.
        urls.parse(F.regexp_replace("u", "^http", "HTTP")).alias("long"))
    rows = df.collect()
    assert [r["plain"] for r in rows] == [True] * len(plain) + [False] * len(other)
    assert all(r["own"] == r["long"] and r["own"] is not None for r in rows)
