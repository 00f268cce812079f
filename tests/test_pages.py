"""One small shop through extraction and all nine checks, and a site whose pages are filled by scripts."""
import pytest

from shopaudit.checks import findings
from shopaudit.operators import extract
from shopaudit.session import stored

ROOT = "https://shop.example"
PAGES = [
    ("/", '<html lang="en"><head><title>A &amp; B</title><script src="https://client.crisp.chat/l.js"></script></head><body><h1>Hi</h1>'
          "<!-- <a href='/no'>no</a> --><p>Only € 5. We ship to the European Union.</p><p>We are carbon neutral. We offset all.</p><p>Our eco label.</p>"
          '<p>We use cookies</p><button>Accept all</button><button>Reject</button><img src="x.png"><a href="/imprint">Legal notice</a>'
          '<a href="/withdraw">W</a><a href="/t">Returns</a><a href="/acc">Accessibility</a></body></html>'),
    ("/imprint", '<html lang="de"><body><h1>Imprint</h1><p>Lindenstraße 12<br>10115 Berlin</p><p>a [at] b.de</p><p>HRB 123456</p></body></html>'),
    ("/t", '<html lang="de"><body><h1>Text</h1><p>Sie haben dreissig Tage Zeit.</p><p>Oder vierzehn Tage.</p><p>You chat with an AI assistant.</p></body></html>'),
    ("/acc", '<html lang="en"><body><h1>Acc</h1><p>We are partially compliant with WCAG.</p><form><label>Q <input name=q></label><input name=r></form></body></html>')]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "shop.example", i, ROOT + u, ROOT + u, 200, h) for i, (u, h) in enumerate(PAGES)]
    shell = "<html><body><div id=root></div></body></html>"
    rows.append((90, "app.example", 0, "https://app.example/", "https://app.example/", 200, shell))
    df = spark.createDataFrame(rows, "page_id long, site string, position long, url string, final_url string, status_code int, html string")
    return stored(extract.documents(df), "test_documents")


def test_extraction(documents):
    page = documents.filter("page_id = 0").first()
    assert (page["title"], page["lang"], page["kind"], page["js_shell"]) == ("A & B", "en", "home", False)
    assert [x["abs"] for x in page["links"]] == [ROOT + p for p in ("/imprint", "/withdraw", "/t", "/acc")]
    assert page["buttons"] == ["Accept all", "Reject"] and page["images"][0]["alt"] is None
    assert page["text"].split("\n")[:2] == ["Hi", "Only € 5. We ship to the European Union."]
    form = documents.filter("page_id = 3").first()["forms"][0]
    assert [(i["name"], i["labelled"]) for i in form["inputs"]] == [("q", True), ("r", False)]


def test_findings(spark, documents):
    audit = findings.audit(documents, "2026-12-01 00:00:00")
    rows = {(r["site"], r["code"]): r for r in audit.findings.collect()}
    assert len(rows) == 18
    assert {c: rows["shop.example", c]["status"] for s, c in rows if s == "shop.example"} == {
        "withdrawal_function": "pass", "withdrawal_policy": "pass", "green_claims": "fail", "accessibility_statement": "pass",
        "a11y_sample": "fail", "ai_disclosure": "pass", "cookie_parity": "pass", "legal_notice": "pass", "eu_targeting": "pass"}
    assert {r["status"] for (s, _), r in rows.items() if s == "app.example"} == {"unknown"}
    assert [e["quote"] for e in rows["shop.example", "withdrawal_policy"]["evidence"]] == ["Oder vierzehn Tage."]
    assert rows["shop.example", "legal_notice"]["evidence"][0]["quote"] == "Lindenstraße 12 10115 Berlin"
    total = sum(r["evidence_total"] for r in rows.values())
    assert audit.evidence.count() == total


def test_a_check_that_breaks_stays_alone(documents, spark):
    whole = {(r["site"], r["code"]): r.asDict(True) for r in findings.audit(documents, "2026-12-01").findings.collect()}
    broken = spark.createDataFrame([("shop.example", "cookie_parity", "boom"), ("shop.example", "cookie_parity", "later"), ("nowhere", "a11y_sample", "x")],
                                   "site string, code string, error string")
    after = {(r["site"], r["code"]): r.asDict(True) for r in findings.audit(documents, "2026-12-01", broken=broken).findings.collect()}
    assert after.keys() == whole.keys() and len(after) == 18
    hit = after.pop(("shop.example", "cookie_parity"))
    assert hit["status"] == "unknown" and '"error":"boom"' in hit["meta"] and hit["evidence"] == [] and hit["evidence_total"] == 0
    whole.pop(("shop.example", "cookie_parity"))
    assert after == whole


def test_answers_are_read_whole_or_not_at_all(spark):
    rows = [("a", '[{"index":1,"verdict":"not_environmental","reason":"r"},{"index":0,"verdict":"x","reason":"s","rewording":"w"}]'), ("b", "[{"), ("c", "[]"),
            ("d", '{"index":1}'), ("e", None)]
    verdicts, broken = findings.read_answers(spark.createDataFrame(rows, "site string, answer string"))
    assert [(r["site"], r["seq"], r["idx"], r["verdict"], r["rewording"]) for r in verdicts.orderBy("site", "seq").collect()] == [
        ("a", 0, 1, "not_environmental", None), ("a", 1, 0, "x", "w")]
    assert {(r["site"], r["code"]) for r in broken.collect()} == {("b", "green_claims"), ("d", "green_claims"), ("e", "green_claims")}


def test_suggested_labels_pass_the_check_they_are_for(spark):
    from pyspark.sql import functions as F
    from shopaudit.functions.text import has_term, match_form
    from shopaudit.vocab import copy, rules
    rows = spark.createDataFrame([(k, v[0], v[1]) for k, v in copy.LABELS.items()], "lang string, button string, notice string")
    found = rows.select("lang", has_term(match_form(F.col("button")), rules.WITHDRAWAL_ACTION).alias("named"))
    assert {r["lang"]: r["named"] for r in found.collect()} == {k: True for k in copy.LABELS}


def test_long_lists_are_whole_in_the_evidence(spark):
    links = "".join(f'<a href="/withdraw/{i}">Withdraw here {i}</a>' for i in range(25))
    rows = [(1, "s.example", 0, "https://s.example/", "https://s.example/", 200, f"<html lang=en><body><h1>a</h1>{links}</body></html>")]
    df = spark.createDataFrame(rows, "page_id long, site string, position long, url string, final_url string, status_code int, html string")
    audit = findings.audit(stored(extract.documents(df), "test_long"), "2026-12-01")
    row = audit.findings.filter("code = 'withdrawal_function'").first()
    assert row["status"] == "pass" and len(row["evidence"]) == 10 and row["evidence_total"] == 25
    assert audit.evidence.filter("code = 'withdrawal_function'").count() == 25
