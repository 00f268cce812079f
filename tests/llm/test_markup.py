"""Template-markup matching against a plain reading of the templates, and on pages of shops."""
import re

import pytest

from shopaudit.llm import markup

FORM = {"withdrawal-form": """i [[we]] hereby give notice that i [[we]] withdraw from my [[our]] contract of {{sale/service}} of the
    following [[goods]] {{goods 1-6}} ordered on {{date 1-3}} [[received on {{date 1-3}}]] [[name of consumer [[s]]]]"""}


def plain(template):
    """A template as a pattern over words that each follow a blank."""
    out = []
    for part in re.split(r"(\[\[|\]\]|\{\{.*?\}\})", template):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part.startswith("{{") and "/" in part:
            out.append(" (?:" + "|".join(" ".join(markup.words_of(x)) for x in part[2:-2].split("/")) + ")")
        elif part.startswith("{{"):
            out.append("(?: [^ ]+){" + part[2:-2].split()[-1].replace("-", ",") + "}")
        else:
            out += [" " + w for w in markup.words_of(part)]
    return re.compile("".join(out) + r"(?= |$)")


def scanned(spark, rows, phrases, templates):
    df = spark.createDataFrame(rows, "page_id long, text string, places string, n_words string, score int")
    return markup.matched_templates(df, phrases, templates).collect()


def test_places_against_patterns(spark):
    texts = ["I hereby give notice that I withdraw from my contract of sale of the following goods: two red chairs, ordered on 3 May",
             "I/We hereby give notice that I/we withdraw from my/our contract of service of the following lessons ordered on 2026-01-02 "
             "received on 2026-01-05 Name of consumer(s)",
             "I hereby give notice that I withdraw from my contract of lease of the following goods x ordered on y",
             "I hereby give notice that I withdraw from my contract of sale of the following goods ordered on ordered on ordered on",
             "Licensed under the Apache License, Version 2.0. mit license MIT License; GNU GENERAL PUBLIC LICENSE or CC-BY 4.0 CC BY",
             "released under the terms of the MIT license and released under the mit licence", "the Kcc by", "CC BY cc bý cc by"]
    found = scanned(spark, [(i, t, "x", "y", 1) for i, t in enumerate(texts)], markup.PHRASES, markup.NOTICES | FORM)
    patterns = [(x, "phrase", plain(t)) for x, t in markup.PHRASES.items()] + [
        (x, "template", plain(t)) for x, t in (markup.NOTICES | FORM).items()]
    for row in found:
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[row.page_id]))
        assert row.n_words == len(words)
        line, expected = "".join(" " + w for w in words), set()
        for begin in range(len(words)):
            at = sum(len(w) + 1 for w in words[:begin])
            for label, kind, pattern in patterns:
                ends = [e for e in range(begin, len(words)) if pattern.fullmatch(line[at:at + sum(len(w) + 1 for w in words[begin:e + 1])])]
                if ends:
                    expected.add((label, kind, begin, max(ends)))
        assert {tuple(p) for p in row.places} == expected, texts[row.page_id]
        assert row.places == sorted(row.places, key=lambda p: p.first_word)
    labels = {r.page_id: {p.label for p in r.places} for r in found}
    assert "withdrawal-form" in labels[0] and "withdrawal-form" in labels[1] and labels[2] == set() and "withdrawal-form" in labels[3]
    assert {"apache", "apache-2.0", "mit", "gpl", "cc-by"} <= labels[4] and "mit-notice" in labels[5] and labels[6] == set()
    scores = {r.page_id: r.score for r in found}
    assert scores[2] == 0 and 0 < scores[4] < scores[0] < 1


def test_odd_rows(spark):
    long = "word, " * 300_000 + "the MIT License" + " x" * 400_000
    rows = [(None, "mit license", None, None, None), (1, None, "p", "q", 2), (2, "", "", "", 0), (3, " \n\t", "", "", 0), (4, "cc by", "", "", 0),
            (4, "cc by", "", "", 0), (5, long, "", "", 0), (6, "permission is hereby granted free of charge " * 2000, "", "", 0)]
    found = scanned(spark, rows, markup.PHRASES, markup.NOTICES)
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    assert [by_id[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and by_id[1].places == [] and by_id[1].score == 0
    assert by_id[None].places[0].label == "mit" and sum(r.page_id == 4 for r in found) == 2
    assert by_id[5].n_words == 700_003 and [(p.first_word, p.last_word) for p in by_id[5].places] == [(300_001, 300_002)]
    assert by_id[6].places == []
    assert scanned(spark, [], markup.PHRASES, markup.NOTICES) == []


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(markup, "_PIECE", 7)
    scanner = markup.Scanner(markup.compiled(markup.PHRASES, {}))
    assert scanner.scan("a gnu general public license, then cc by!")[:2] == (8, [("gpl", "phrase", 1, 4), ("cc-by", "phrase", 6, 7)])


def test_templates_that_are_no_templates():
    for template in ("a [[b", "a ]] b", "[[only optional]]", "{{free 1-3}}", "a {{x 3-1}}"):
        with pytest.raises(ValueError):
            markup.compiled({}, {"t": template})


def test_documents_of_a_shop(spark):
    from shopaudit.operators.extract import documents
    from shopaudit.sources.pages import read_pages

    raw = spark.createDataFrame([
        (1, "https://shop.example/", "<html><body><h1>Shop</h1><p>Fonts released under the <b>MIT</b> License.</p></body></html>"),
        (2, "https://shop.example/withdraw", "<html><body><p>I hereby give notice that I withdraw from my contract of sale of the following "
         "goods: [ ] chairs</p><p>Ordered on 1 March</p></body></html>")], "page_id long, url string, html string")
    found = {r.page_id: [p.label for p in r.places] for r in markup.matched_templates(
        documents(read_pages(raw)).select("page_id", "text"), markup.PHRASES, markup.NOTICES | FORM).collect()}
    assert found == {1: ["mit-notice", "mit"], 2: ["withdrawal-form"]}
