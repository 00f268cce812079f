"""The filter audit against a plain replay of every order."""
import itertools
import re

from pyspark.sql import functions as F

from shopaudit.llm import filter_audit

SCHEMA = "page_id long, site string, text string, n long, digest string, good string"


def replay(rows, marks):
    good, toxic = {p for p, g, _ in marks if g and p is not None}, {p for p, _, t in marks if t and p is not None}
    texts = [(p, s or "", t or "") for p, s, t in rows]
    lowest = {}
    for page, _, text in texts:
        if page is not None:
            lowest[text] = min(page, lowest.get(text, page))
    failing = []
    for page, site, text in texts:
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": page is not None and page > lowest[text]}
        failing.append((page, site, {k for k, v in fails.items() if v}))
    out = {}
    for site in {s for _, s, _ in texts}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failing if f[1] == site]
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if letter in f[2]]
                left = [f for f in left if letter not in f[2]]
                out[site, "".join(order), step] = [
                    len(left), len(removed), sum(letter in f[2] for f in failing if f[1] == site) - len(removed),
                    sum(f[2] == {letter} for f in failing if f[1] == site), sum(f[0] in good for f in removed), sum(f[0] in toxic for f in removed)]
    for (site, order, step), row in out.items():
        row.append(sum(v[1] for (s, o, k), v in out.items() if s == site and o[k - 1] == order[step - 1] and len(v) >= 6))
    return out


def audited(spark, rows, marks):
    pages = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)
    found = filter_audit.audit_filters(pages, spark.createDataFrame(marks, "page_id long, good boolean, toxic boolean"))
    return {(r.site, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in found.collect()}


PROSE = " ".join(f"word{i}" for i in range(60))


def test_against_replay(spark):
    rows = [(1, "a", PROSE), (2, "a", PROSE), (3, "b", PROSE), (4, "a", "short"), (5, "b", "SHORT #"), (6, "a", "same " * 80), (7, "b", PROSE.upper()),
            (8, "a", PROSE + " 100%"), (9, None, None), (10, "b", ""), (11, "a", "same " * 80), (12, "a", " \t\n"), (4, "a", "short"), (4, "b", "short"),
            (3, "a", PROSE), (None, "a", PROSE), (None, None, "short"), (13, "b", "é" * 30 + " ÀÉ x"), (14, "a", "big " * 200_000)]
    marks = [(1, True, False), (2, True, True), (2, False, False), (5, None, True), (None, True, True), (99, True, True), (3, True, None)]
    assert audited(spark, rows, marks) == replay(rows, marks)


def test_no_rows(spark):
    assert audited(spark, [], [(1, True, True)]) == {}
    one = audited(spark, [(1, "a", PROSE)], [])
    assert len(one) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in one.values())


def test_fields_do_not_meet():
    wide = filter_audit.wide_counters("ABCDE")
    many = (1 << 63) - 1
    fields = filter_audit.unpacked(many * wide[0b10101], "ABCDE")
    assert set(fields.ravel().tolist()) == {0, many}
    assert (filter_audit.unpacked(5 * wide[1] + 7 * wide[3], "ABCDE") == 5 * filter_audit.unpacked(wide[1], "ABCDE")
            + 7 * filter_audit.unpacked(wide[3], "ABCDE")).all()


def test_own_checks_on_pages_of_shops(spark):
    from shopaudit.operators.extract import documents
    from shopaudit.sources.pages import read_pages

    html = "<html><body><p>{}</p></body></html>"
    raw = spark.createDataFrame([(1, "https://a.example/", html.format("Returns within 14 days")), (2, "https://b.example/", html.format("Cart")),
                                 (3, "https://b.example/x", html.format("Cart"))], "page_id long, url string, html string")
    marks = spark.createDataFrame([(3, True, False)], "page_id long, good boolean, toxic boolean")
    found = filter_audit.audit_filters(documents(read_pages(raw)), marks, {"X": F.col("n_words") < 2}, "Z")
    rows = {(r.site, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost) for r in found.collect()}
    assert rows["a.example", "XZ", 2] == (1, 0, 0, 0) and rows["b.example", "XZ", 1] == (0, 2, 0, 1) and rows["b.example", "ZX", 1] == (1, 1, 0, 1)
    assert rows["b.example", "ZX", 2] == (0, 1, 1, 0)
