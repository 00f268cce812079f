"""Short ways for plain texts and pages, with the results of the long ways, and work that is done once and by all tasks."""
import re

from pyspark.sql import functions as F

from shopaudit.catalog import page_queries, shop_queries
from shopaudit.checks import signals
from shopaudit.functions import text
from shopaudit.operators import classify, extract

TEXTS = ["", " ", "a", "plain words here", "two  gaps", " edge ", "tab\tinside", "a-b_c", "it`s", "it’s é", "no break", "x\n", "line one\nline two",
         " l1 \n\n l2  x", "ends \x85", "ctrl \x01 sign", "thin x", "a " * 20_000 + "a"]


def results(spark, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r[1] for r in df.select("i", function(F.col("t"))).sort("i").collect()]


def test_plain_texts_take_the_short_way_to_the_same_result(spark):
    long_way = {
        text.collapse: lambda t: F.trim(F.regexp_replace(t, f"{text.SPACES}+", " ")),
        text.trim_all: lambda t: F.regexp_replace(t, f"^{text.SPACES}+|{text.SPACES}+$", ""),
        text.fold: lambda t: text._fold(t, False),
        (lambda t: text.fold(t, keep_lines=True)): lambda t: text._fold(t, True)}
    for short, long in long_way.items():
        assert results(spark, short) == results(spark, long)
    taken = [results(spark, lambda t, p=p: t.rlike(p)) for p in (text.SINGLE_SPACED, text.TRIMMED, text.FOLDED, text.FOLDED_LINES)]
    assert [row[3] for row in taken] == [True] * 4 and [row[4] for row in taken] == [False, True, False, False]


def test_buttons_without_and_with_roles(spark):
    pages = ['<button>One</button><input type=submit value="Two"><div role=button>Three</div>', '<button>One</button><input type="text" value="no">',
             "<p>none</p>", '<button>Out <i>in</i></button>']
    df = spark.createDataFrame([(p,) for p in pages], "m string").select(extract.buttons_of(F.col("m")), F.col("m").rlike(extract._ROLE_HINT))
    assert [tuple(r) for r in df.collect()] == [(["One", "Two", "Three"], True), (["One"], False), ([], False), (["Out in"], False)]


def test_hints_hold_wherever_a_postcode_or_address_does(spark):
    lines = ["Lindenstraße 1, 10115 Berlin", "Weg 2 1010 Wien", "Kade 3 1012 AB Amsterdam", "1 High Street D02 AF30"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(signals.address_line(F.col("t")), F.col("t").rlike(signals.POSTCODE_HINT))
    assert [tuple(r) for r in df.collect()] == [(x, True) for x in lines]
    spelled = spark.createDataFrame([("info (at) shop [dot] de",), ("look at this",)], "t string").select(signals.has_email(F.col("t")))
    assert [r[0] for r in spelled.collect()] == [True, False]


def test_own_categories_are_read_on_one_side_of_the_join(spark):
    rows = [("s", 1, "https://s.de/imprint", "https://s.de/imprint", "Imprint", [(1, "Imprint")], []),
            ("s", 2, "https://s.de/x", "https://s.de/privacy", "x", [], [("Imprint", "", "https://s.de/x")])]
    docs = spark.createDataFrame(rows, "site string, page_id long, url string, final_url string, title string, "
                                 "headings array<struct<level:int,text:string>>, links array<struct<text:string,href:string,abs:string>>")
    found = classify.page_categories(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"inline\(array\(struct\(own", plan)) == 1
    assert "imprint" in {r["page_id"]: r["categories"] for r in found.collect()}[1]


def test_pages_are_dealt_to_all_tasks_before_extraction(spark, tmp_path):
    spark.createDataFrame([(i, f"https://a.example/{i}", "<p>x</p>") for i in range(8)], "page_id long, url string, html string").coalesce(1).write.parquet(
        f"{tmp_path}/pages.parquet")
    assert "REPARTITION_BY_NUM" in page_queries._documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_claims_join_findings_that_are_stored_once(spark):
    claims = shop_queries.shop_claims(spark, "/root/testdata/sf0.001")
    plan = claims._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Relation") == 2


def test_signals_hold_where_one_test_for_all_terms_comes_first(spark):
    said = ["Free within calendar days. Monats. Nichts.", "Wir liefern in die EU, nach Europa.", "We use cookies. You chat with an AI assistant.", "Nothing at all here."]
    rows = [("s", i, i, f"https://s.de/{i}", 200, "other", "", "en", t) for i, t in enumerate(said)]
    none = lambda kind: F.array().cast(kind)
    docs = spark.createDataFrame(rows, "site string, page_id long, position long, final_url string, status_code int, kind string, title string, lang string, text string").select(
        "*", none("array<struct<level:int,text:string>>").alias("headings"), none("array<struct<text:string,href:string,abs:string>>").alias("links"),
        F.array(F.lit("Accept all")).alias("buttons"), none(extract.FORMS).alias("forms"), none("array<string>").alias("scripts"), none(extract.IMAGES).alias("images"),
        F.create_map().cast("map<string,string>").alias("meta"), F.lit(False).alias("js_shell"))
    found = signals.page_signals(docs)
    assert "worded" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["page_id"]: r for r in found.collect()}
    assert [got[i]["shipping"] for i in range(4)] == [None, said[1], None, None]
    assert [got[i]["banner"] is not None and got[i]["banner"]["accept"] for i in range(4)] == [False, False, "Accept all", False]
    assert got[2]["disclosure"] == "You chat with an AI assistant."


def test_every_unit_of_time_has_the_hint(spark):
    units = "days day calendar days working days tag tage tagen kalendertage werktagen jours giorni dias dagen kalenderdagen month monate mois mese meses maanden".split()
    df = spark.createDataFrame([(f"14 {u}",) for u in units if u not in ("calendar", "working")], "t string")
    assert df.filter(~F.col("t").rlike(signals.PERIOD_HINT)).count() == 0
    assert df.filter(F.size(signals.periods_in_days(F.col("t"))) == 0).count() == 0
