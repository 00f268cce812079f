"""What each page contributes to the checks: one row per page, built without a shuffle.

Matchers first run on the match form of the whole page; only pages that hit are searched sentence by sentence.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import excerpt, has_term, match_form, primary_language, sentence_forms
from ..session import built_once, let
from ..vocab import rules


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_text(items: Column, test, gate: Column | None = None) -> Column:
    """Quote of the first sentence that passes ``test``; nothing is searched where ``gate`` is false."""
    found = excerpt(F.get(F.filter(items, test), 0)["text"])
    return found if gate is None else F.when(gate, found)


def matches(text: Column, patterns: list[str]) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def periods_in_days(form: Column) -> Column:
    """Periods stated in a sentence (in match form), in days; a month counts 30."""
    words = {w: n for n, ws in rules.NUMBER_WORDS.items() for w in ws.split()}
    number = r"(?<![\p{L}\p{N}.,])(\d{1,3}|" + "|".join(words) + ")"
    by_size = lambda tok: reduce(lambda acc, n: acc.when(
        tok.isin(*rules.NUMBER_WORDS[n].split()), F.lit(n)), rules.NUMBER_WORDS, F.when(
            tok.rlike(r"^\d+$"), tok.cast("int"))).otherwise(0)
    found = lambda unit, factor: F.transform(
        F.regexp_extract_all(form, F.lit(number + r"\s*" + unit + r"(?!\p{L})"), F.lit(1)), lambda t: by_size(t) * factor)
    return F.filter(F.concat(found(rules.DAY_UNIT, 1), found(rules.MONTH_UNIT, rules.DAYS_PER_MONTH)), lambda n: n > 0)


# Beginnings or parts that every form of ``rules.DAY_UNIT`` and ``rules.MONTH_UNIT`` has in it.
PERIOD_HINT = "(?=[djgtm])(?:day|tag|jour|giorni|dias|dagen|month|monat|mois|mes|maand)"
# All prefixes begin with two capitals, which few characters are.
VAT_CANDIDATE = (r"(?=[A-Z]{2})(?<![A-Za-z0-9])(?:" + "|".join(rules.VAT_NUMBERS) + r")[\s.-]?(?:(?:[0-9A-Z+*][\s.-]?){7,14})")
VAT_NUMBER = "^(?:" + "|".join(k + v for k, v in rules.VAT_NUMBERS.items()) + ")"
# JavaScript's word boundary is the ASCII one.
EUR_PRICE = (rules.EUR_PRICE.replace(r"\bEUR", "(?<![A-Za-z0-9_])EUR").replace(r"EUR\b", "EUR(?![A-Za-z0-9_])"))


def has_vat_number(line: Column) -> Column:
    return F.exists(F.regexp_extract_all(line, F.lit(VAT_CANDIDATE), F.lit(0)),
                    lambda c: F.regexp_replace(c, r"[\s.-]", "").rlike(VAT_NUMBER))


# Signs that every postcode, and every e-mail address that is spelled out, has somewhere in it.
POSTCODE_HINT = r"\d{4}(?:\s|[A-Z])|[A-Z]\d{2}"
SPELLED_HINT = r"(?i)[\[(]\s*at\s*[\])]"


def address_line(text: Column) -> Column:
    """First line with a street and house number whose postcode is on the same or the next line."""
    def find(lines: Column) -> Column:
        def judge(line: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            return F.when(matches(line, rules.STREETS), F.when(matches(line, rules.POSTCODES), line)
                          .when(matches(after, rules.POSTCODES), F.concat_ws(" ", line, after)))
        return F.get(F.filter(F.transform(lines, judge), lambda x: x.isNotNull()), 0)
    return F.when(text.rlike(POSTCODE_HINT) & matches(text, rules.POSTCODES) & matches(text, rules.STREETS), find(F.split(text, "\n")))


def is_registration(line: Column) -> Column:
    return has_vat_number(line) | (line.rlike(rules.LONG_NUMBER) & has_term(match_form(line), rules.REGISTER_WORDS))


def registration_line(text: Column) -> Column:
    return F.when(text.rlike(VAT_CANDIDATE) | text.rlike(rules.LONG_NUMBER),
                  F.get(F.filter(F.split(text, "\n"), is_registration), 0))


def has_email(text: Column) -> Column:
    return (F.contains(text, F.lit("@")) & text.rlike(rules.EMAIL)) | (text.rlike(SPELLED_HINT) & text.rlike(rules.EMAIL_SPELLED))


def email_line(links: Column, sentences: Column, text: Column) -> Column:
    """First mailto link, else the first sentence with an address, plain or spelled out."""
    mailto = F.get(F.filter(links, lambda x: F.lower(x["abs"]).startswith("mailto:") & x["abs"].rlike(rules.EMAIL)), 0)
    by_link = let(mailto, lambda x: F.when(x["text"] != "", x["text"]).otherwise(F.substring(x["abs"], 8, 10_000)))
    by_text = F.get(F.filter(sentences, lambda s: has_email(s["text"])), 0)["text"]
    return F.coalesce(by_link, F.when(has_email(text), by_text))


def is_disclosure(s: Column) -> Column:
    """A sentence (with its match forms) that tells people they write with a machine."""
    machine = has_term(s["folded"], rules.AI_ACRONYMS, keep_case=True) | has_term(s["form"], rules.AUTOMATED)
    return has_term(s["form"], rules.AI_DISCLOSURE) | (machine & has_term(s["form"], rules.CHAT_CONTEXT))


def vendor_of(url: Column, vendors: dict[str, list[str]]) -> Column:
    """First vendor whose signature occurs in a script address."""
    return let(F.lower(url), lambda u: F.coalesce(*[
        F.when(any_of([F.contains(u, F.lit(p)) for p in patterns]), F.lit(name)) for name, patterns in vendors.items()]))


def vendor_scripts(scripts: Column, vendors: dict[str, list[str]]) -> Column:
    hint = "|".join(p.replace(".", r"\.") for ps in vendors.values() for p in ps)
    hits = F.filter(F.transform(F.filter(scripts, lambda u: F.lower(u).rlike(hint)), lambda u: F.struct(
        vendor_of(u, vendors).alias("name"), u.alias("url"))), lambda h: h["name"].isNotNull())
    return hits


def evidence_item(group: str, part: int, item: Column, quote: Column, key: Column | None = None) -> Column:
    return F.struct(F.lit(group).alias("grp"), F.lit(part).alias("part"), item.cast("int").alias("item"),
                    excerpt(quote).alias("quote"), (F.lit(None).cast("string") if key is None else key).alias("key"))


ITEMS = "array<struct<grp:string,part:int,item:int,quote:string,key:string>>"


def _numbered(items: Column, test, make) -> Column:
    """Items that pass ``test`` with their place in the page."""
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(placed, lambda p: test(p["x"])), lambda p: make(p["x"], p["i"]))


def sample_items(d: dict[str, Column]) -> Column:
    """Evidence of the accessibility sample on one page: language, h1, images, links, fields."""
    group = "sample"
    h1 = F.filter(d["headings"], lambda h: h["level"] == 1)
    h1_text = F.when(F.size(h1) == 0, F.lit("The page has no h1")).otherwise(F.concat(
        F.size(h1).cast("string"), F.lit(" h1 headings: "),
        F.array_join(F.transform(h1, lambda h: F.concat(F.lit('"'), h["text"], F.lit('"'))), ", ")))
    one = lambda g, part, cond, quote: F.filter(F.array(evidence_item(g, part, F.lit(0), quote)), lambda _: cond)
    named = lambda f: F.coalesce(F.nullif(f["name"], F.lit("")), F.nullif(f["id"], F.lit("")), f["type"])
    return F.concat(
        one(group, 0, d["lang"].isNull(), F.lit("The html element has no lang attribute")),
        one(group, 1, F.size(h1) != 1, h1_text), one("sample_h1", 1, F.size(h1) != 1, h1_text),
        _numbered(d["images"], lambda x: x["alt"].isNull(), lambda x, i: evidence_item(
            group, 2, i, F.concat(F.lit("Image without alt attribute: "), x["src"]))),
        _numbered(d["links"], lambda x: F.trim(x["text"]) == "", lambda x, i: evidence_item(
            group, 3, i, F.concat(F.lit("Link without a name: "), F.coalesce(F.nullif(x["abs"], F.lit("")), x["href"])))),
        _numbered(F.flatten(d["forms"]["inputs"]), lambda x: ~x["labelled"], lambda x, i: evidence_item(
            group, 4, i, F.concat(F.lit('Field without a label: "'), named(x), F.lit('" ('), x["type"], F.lit(")")))))


def page_signals(documents: DataFrame, environmental: dict | None = None, offset: list | None = None,
                 neutrality: list | None = None, self_label: list | None = None) -> DataFrame:
    """Signals of every successfully fetched page."""
    ok = documents.filter(F.col("status_code").between(200, 299))
    staged = ok.withColumns(_sentence_columns()).withColumns(_vendor_columns())
    words = (environmental or rules.ENVIRONMENTAL, offset or rules.OFFSET, neutrality or rules.NEUTRALITY, self_label or rules.SELF_LABEL)
    return staged.withColumns({"stated": _stated(), "worded": _worded(*words)}).select(*_signal_columns(*words))


@built_once
def _worded(environmental: dict, offset: list, neutrality: list, self_label: list) -> Column:
    """The page holds a term of some vocabulary that is looked for in whole pages; most hold none."""
    return has_term(F.col("f"), sorted({t for ts in (
        *environmental.values(), neutrality, self_label, rules.EUROPE, rules.COOKIE_WORDS, rules.AI_DISCLOSURE, rules.CHAT_CONTEXT,
        rules.CONFORMANCE, rules.STATEMENT_TITLE, rules.WITHDRAWAL_MAIL) for t in ts}))


@built_once
def _sentence_columns() -> dict[str, Column]:
    return {"s": sentence_forms(F.col("text"))}


@built_once
def _vendor_columns() -> dict[str, Column]:
    return {"f": F.array_join(F.col("s.form"), "\n"), "chat": vendor_scripts(F.col("scripts"), rules.CHAT_VENDORS),
            "cmp": vendor_scripts(F.col("scripts"), rules.CONSENT_VENDORS),
            "b": F.transform("buttons", lambda b: F.struct(b.alias("text"), match_form(b).alias("form")))}


@built_once
def _stated() -> Column:
    return F.when(F.col("f").rlike(PERIOD_HINT), F.filter(F.transform("s", lambda x: F.struct(
        x["text"].alias("text"), periods_in_days(x["form"]).alias("days"))), lambda x: F.size(x["days"]) > 0))


@built_once
def _signal_columns(environmental: dict, offset: list, neutrality: list, self_label: list) -> list[Column]:
    s, f, t = F.col("s"), F.col("f"), F.col("text")
    d = {n: F.col(n) for n in ("lang", "headings", "images", "links", "forms")}
    holds = lambda terms: F.col("worded") & has_term(f, terms)
    reject = lambda b: has_term(b["form"], rules.REJECT)
    accept = lambda b: ~reject(b) & has_term(b["form"], rules.ACCEPT)
    heading_hit = F.exists(d["headings"], lambda h: (h["level"] > 1) & has_term(match_form(h["text"]), rules.WITHDRAWAL_HEADING))
    fields = F.flatten(d["forms"]["inputs"])
    count = lambda items, test: F.size(F.filter(items, test))
    h1 = F.filter(d["headings"], lambda h: h["level"] == 1)
    longest = let(F.array_max(F.transform("stated", lambda x: F.array_max(x["days"]))), lambda top: F.get(F.filter(
        "stated", lambda x: F.array_max(x["days"]) == top), 0))
    items = F.concat(
        _numbered(F.col("b"), lambda b: has_term(b["form"], rules.WITHDRAWAL_ACTION),
                  lambda b, i: evidence_item("function", 1, i, b["text"])),
        _numbered(d["forms"]["action"], lambda a: (a != "") & has_term(match_form(urls.path_words(a)), rules.WITHDRAWAL_ACTION_SLUGS),
                  lambda a, i: evidence_item("function", 2, i, F.concat(F.lit("Form sent to "), a))),
        F.when(holds(rules.WITHDRAWAL_MAIL), _numbered(
            s, lambda x: has_term(x["form"], rules.WITHDRAWAL_MAIL)
            & (x["text"].rlike(rules.EMAIL) | has_term(x["form"], rules.MAIL_WORDS)),
            lambda x, i: evidence_item("route", 1, i, x["text"]))).otherwise(F.array().cast(ITEMS)),
        F.transform("chat", lambda c, i: evidence_item(
            "widget", 0, i, F.concat(c["name"], F.lit(" chat: "), c["url"]), c["url"])),
        sample_items(d))
    return [
        F.col("site"), F.col("page_id"), F.col("position"), F.col("final_url").alias("url"), *[F.col(n) for n in ("kind", "title", "js_shell")],
        primary_language(F.col("lang")).alias("language"),
        F.coalesce(F.nullif(F.get(h1, 0)["text"], F.lit("")), "title").alias("headline"),
        heading_hit.alias("withdrawal_heading"),
        # EU targeting
        first_text(s, lambda x: x["text"].rlike(EUR_PRICE), t.rlike("€|EUR")).alias("price"),
        F.coalesce(*[F.when(F.upper(F.element_at("meta", k)) == "EUR", F.lit(f"{k} = EUR"))
                     for k in rules.CURRENCY_KEYS]).alias("currency"),
        first_text(s, lambda x: has_term(x["form"], rules.SHIPPING) & has_term(x["form"], rules.EUROPE),
                   holds(rules.EUROPE) & has_term(f, rules.SHIPPING)).alias("shipping"),
        F.when(F.get(F.split(F.lower("lang"), "[-_]"), 0).isin(*rules.EU_LANGUAGES),
               F.concat(F.lit('lang="'), F.col("lang"), F.lit('"'))).alias("eu_language"),
        # Cookie banner
        F.get("cmp", 0).alias("vendor"),
        F.when((F.size("cmp") > 0) | holds(rules.COOKIE_WORDS), F.struct(
            excerpt(F.get(F.filter("b", accept), 0)["text"]).alias("accept"),
            excerpt(F.get(F.filter("b", reject), 0)["text"]).alias("reject"))).alias("banner"),
        # Chat disclosure
        first_text(s, is_disclosure, holds(rules.AI_DISCLOSURE) | holds(rules.CHAT_CONTEXT)).alias("disclosure"),
        # Accessibility statement and legal notice
        F.coalesce(first_text(s, lambda x: has_term(x["form"], rules.CONFORMANCE), holds(rules.CONFORMANCE)),
                   first_text(s, lambda x: has_term(x["form"], rules.STATEMENT_TITLE), holds(rules.STATEMENT_TITLE))
                   ).alias("statement"),
        excerpt(email_line(d["links"], s, t)).alias("email"),
        (F.size(fields) > 0).alias("has_fields"),
        excerpt(address_line(t)).alias("address"),
        excerpt(registration_line(t)).alias("registration"),
        # Withdrawal policy
        excerpt(F.get(F.filter("stated", lambda x: F.array_contains(x["days"], rules.STATUTORY_DAYS)), 0)["text"]).alias("statutory"),
        F.array_max(longest["days"]).alias("longest_days"), excerpt(longest["text"]).alias("longest"),
        # Accessibility sample
        d["lang"].isNull().cast("int").alias("missing_lang"),
        (F.size(h1) != 1).cast("int").alias("heading_issues"),
        count(d["images"], lambda x: x["alt"].isNull()).alias("missing_alt"),
        count(fields, lambda x: ~x["labelled"]).alias("unlabelled_inputs"),
        count(d["links"], lambda x: F.trim(x["text"]) == "").alias("empty_links"),
        items.alias("items"),
        claim_sentences(F.col("lang"), s, f, environmental, offset, neutrality, self_label).alias("claims")]


def claim_sentences(lang: Column, s: Column, f: Column, environmental: dict, offset: list, neutrality: list,
                    self_label: list) -> Column:
    """Sentences that may be environmental claims: place, match form (the key), the text and what it counts as.

    Sentences that match no vocabulary on any page cannot win or block a place, so they are left out here.
    """
    every = sorted({t for ts in environmental.values() for t in ts} | set(neutrality) | set(self_label))
    primary = F.coalesce(F.get(F.split(F.lower(lang), "[-_]"), 0), F.lit(""))
    offsets = has_term(F.replace(f, F.lit("\n"), F.lit(" ")), offset)
    locales = list(environmental)

    def by_language(form: Column) -> Column:
        chain = F.when(primary == "en", has_term(form, environmental["en"]))
        for locale in locales:
            if locale != "en":
                chain = chain.when(primary == locale, has_term(form, environmental["en"] + environmental[locale]))
        return chain.otherwise(has_term(form, [t for ts in environmental.values() for t in ts]))

    def describe(x: Column, i: Column) -> Column:
        kind = let(x["form"], lambda form: F.when(has_term(form, self_label), "self_made_label")
                   .when(has_term(form, neutrality) & offsets, "offset_neutrality")
                   .when(by_language(form), "candidate"))
        return F.struct(i.cast("int").alias("item"), x["form"].alias("key"),
                        x["text"].alias("text"), kind.alias("kind"))

    relevant = lambda x: has_term(x["form"], every)
    placed = F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    found = F.transform(F.filter(placed, lambda p: relevant(p["x"])), lambda p: describe(p["x"], p["i"]))
    return F.when(F.col("worded") & has_term(f, every), found)
