import hashlib
import base64
import json

from pyspark.sql import functions as F

from shopaudit.checks import signals
from shopaudit.functions import scalars, text, urls


def values(spark, inputs, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_match_form_folds_accents_dashes_and_apostrophes(spark):
    assert values(spark, ["Où  l’Öl-Preis – Straße", "½ ﬁx"], text.match_form) == ["ou l'ol preis strasse", "1⁄2 fix"]


def test_terms_match_whole_words_and_prefixes(spark):
    found = lambda terms: lambda c: text.has_term(text.match_form(c), terms)
    assert values(spark, ["an ECO bag", "economy", "eco-bag"], found(["eco"])) == [True, False, True]
    assert values(spark, ["Widerrufsrecht", "unserem Öko-Siegel", "Öko-Siegel"], found(["widerruf*", "unser* oko siegel"])) == [True, True, False]
    assert values(spark, ["Our AI", "ai clienti"], lambda c: text.has_term(text.match_form(c, True), ["AI"], True)) == [True, False]


def test_sentences_and_excerpts(spark):
    assert values(spark, ["One. Two! three\nFour z.B. five"], text.sentences) == [["One.", "Two! three", "Four z.B. five"]]
    assert values(spark, ["short", "one two three four five"], lambda c: text.excerpt(c, 12)) == ["short", "one two…"]


def test_references(spark):
    assert values(spark, ["&amp;lt; &copy 1 &#8364; &#x20AC; &#150; &zzz; &"], text.decode_references) == ["&lt; © 1 € € – &zzz; &"]


def test_urls(spark):
    assert values(spark, ["HTTPS://Shop.Example:443/A/?#x", "mailto:a@b.c", "http://h.x/é/../b/"], urls.normalise) == [
        "https://shop.example/A", None, "http://h.x/b"]
    base = urls.parse(F.lit("https://h.x/d/e?f=1"))
    assert values(spark, ["/a/", "b", "?x", "#f", "//o.x/p", "../z", "mailto:A@b.c"], lambda c: urls.resolve(c, base)) == [
        "https://h.x/a/", "https://h.x/d/b", "https://h.x/d/e?x", "https://h.x/d/e?f=1#f", "https://o.x/p", "https://h.x/z", "mailto:A@b.c"]


def test_screening(spark):
    refused = ["ftp://s.example/", "http://2130706433/", "http://0x7f.0.0.1/", "http://[::1]/", "https://a.local/", "intranet", "not a url",
               "https://u:p@s.example/", "https://s.example:22/", "http://[64:ff9b::10.0.0.1]/"]
    reasons = values(spark, refused + ["shop.example", "https://8.8.8.8/"], lambda c: urls.screen_target(c)["reason"])
    assert all(reasons[:-2]) and reasons[-2:] == [None, None]


def test_fingerprint_equals_the_plain_hash(spark):
    df = spark.createDataFrame([(["https://b/", "https://a/", "https://b/"],)], "u array<string>")
    got = df.select(scalars.fingerprint(F.lit("x"), F.lit("fail"), F.col("u"))).first()[0]
    text_ = json.dumps(["x", "fail", ["https://a/", "https://b/"]], separators=(",", ":"))
    assert got == base64.urlsafe_b64encode(hashlib.sha256(text_.encode()).digest()).decode()[:22]


def test_next_run(spark):
    rows = [("2026-09-01 10:00:00", "2026-09-15 00:00:00"), (None, "2026-09-15 07:00:00"), ("2026-01-01 00:00:00", "2026-09-15 05:00:00")]
    df = spark.createDataFrame(rows, "l string, n string")
    got = [str(r[0]) for r in df.select(scalars.next_run(F.col("l").cast("timestamp"), F.lit(30), F.col("n").cast("timestamp")).cast("string")).collect()]
    assert got == ["2026-10-02 06:00:00", "2026-09-16 06:00:00", "2026-09-15 06:00:00"]


def test_periods_and_numbers(spark):
    assert values(spark, ["within 14 days", "vierzehn Tage oder ein Monat", "1.5 days", "14 daydreams"],
                  lambda c: signals.periods_in_days(text.match_form(c))) == [[14], [14, 30], [], []]
    assert values(spark, ["DE 123456789", "HRB 12345", "prices include VAT", "© 2026 Shop"], signals.is_registration) == [True, True, False, False]
