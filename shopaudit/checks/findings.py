"""From page signals to findings: exactly nine per site, in a fixed order.

All page signals of a site meet in one aggregation; lists of evidence are deduplicated and cut to the report's length
before they are gathered, so no site, however large, is gathered whole. Full evidence stays in a long table.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars, urls
from ..functions.text import escape_html, excerpt, has_term, lower_first, match_form, primary_language
from ..operators import classify
from ..session import built_once, derive, first_by, let, stored
from ..vocab import copy, rules
from .signals import evidence_item, page_signals

# Evidence a finding shows (the accessibility sample shows more). The evidence table has all of it.
CAPS = {"function": 10, "route": 10, "pdf": 10, "widget": 10, "sample": 12, "sample_h1": 12, "candidate": 10}
# Lists the reports show in full. A finding carries up to this many.
INLINE = scalars.DIRECT_URLS
EVIDENCE = "array<struct<url:string,quote:string>>"


@dataclass(eq=False)
class Audit:
    """``findings``: nine rows per site. ``evidence``: every quote behind them, one row each, in order. ``claims``: every
    environmental claim with its source, rule, reason and rewording."""
    findings: DataFrame
    claims: DataFrame
    build_evidence: Callable[[], DataFrame]

    @cached_property
    def evidence(self) -> DataFrame:
        """Put together when it is first asked for, from the findings' own lists and the stored rows."""
        return self.build_evidence()


def guessed_locales(documents: DataFrame) -> DataFrame:
    """(site, ranked): languages of a site's pages, most frequent first, ties by first appearance."""
    counts = (documents.filter(F.col("status_code").between(200, 299))
              .select("site", "position", primary_language(F.col("lang")).alias("language"))
              .filter(F.col("language").isNotNull())
              .groupBy("site", "language").agg(F.count("*").alias("n"), F.min("position").alias("seen")))
    return counts.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("n"), "seen", "language"))).alias("ranked")).select("site", F.col("ranked.language").alias("ranked"))


def contexts(documents: DataFrame, now: str) -> DataFrame:
    """One row per site: host name, languages, time of the scan, and whether the home page is a script shell."""
    home = documents.groupBy("site").agg(
        F.min_by(F.struct("final_url", "js_shell"), "position").alias("home"),
        F.count_if(F.col("status_code").between(200, 299)).alias("pages"),
        F.min(F.when(F.col("status_code").between(200, 299), F.struct("position", "final_url")))["final_url"].alias("first_url"))
    domain = F.element_at(F.split("hostname", r"\."), -1)
    by_domain = F.element_at(F.create_map(*[F.lit(x) for kv in rules.DOMAIN_LANGUAGE.items() for x in kv]), domain)
    return (home.join(guessed_locales(documents), "site", "left")
            .withColumn("hostname", F.coalesce(urls.parse(F.col("home.final_url"))["host"], "site"))
            .select("site", "hostname", F.col("home.js_shell").alias("js_shell"), "pages", "first_url",
                    domain.alias("domain"), F.lit(now).cast("timestamp").alias("now"),
                    F.coalesce("ranked", F.array_compact(F.array(by_domain))).alias("locales"))
            .withColumn("locale", F.coalesce(F.get(F.filter("locales", lambda x: x.isin(*rules.LOCALES)), 0), F.lit("en"))))


# ---- evidence lists ---------------------------------------------------------------------------------------------

def link_evidence(documents: DataFrame) -> DataFrame:
    """Links that count as evidence. Each target speaks once per site, from the first page that links to it."""
    links = (documents.filter(F.col("status_code").between(200, 299))
             .select("site", "position", F.col("final_url").alias("url"), F.posexplode("links").alias("item", "link"))
             .select("site", "position", "url", "item", "link.text", "link.abs"))
    first = first_by(links, ["site", "abs"], [F.col("position"), F.col("item")])
    staged = derive(first, **_link_forms())
    return staged.select("site", "position", "url", F.explode(_link_items()).alias("e")).select("site", "position", "url", "e.*")


@built_once
def _link_forms() -> dict[str, Column]:
    return {"form": match_form(F.col("text")), "words": match_form(urls.path_words(F.col("abs"))),
            "document": urls.is_document(F.col("abs"))}


@built_once
def _link_items() -> Column:
    path = F.coalesce(urls.path_of(F.col("abs")), "abs")
    form, words = F.col("form"), F.col("words")
    action = has_term(form, rules.WITHDRAWAL_ACTION)
    open_link = ~F.col("document") & ~F.lower("abs").startswith("mailto:")
    label = F.when(F.col("text") != "", F.col("text"))
    item = F.col("item")
    nothing = F.lit(None).cast("struct<grp:string,part:int,item:int,quote:string,key:string>")
    return F.array_compact(F.array(
        F.when(open_link & action, evidence_item("function", 0, item, F.col("text")))
        .when(open_link & has_term(words, rules.WITHDRAWAL_ACTION_SLUGS), evidence_item(
            "function", 0, item, F.trim(F.concat("text", F.lit(" ("), path, F.lit(")"))))).otherwise(nothing),
        F.when(F.col("document") & (has_term(form, rules.WITHDRAWAL_FORM) | has_term(words, rules.WITHDRAWAL_FORM)),
               evidence_item("route", 0, item, F.coalesce(label, path))),
        F.when(F.col("document") & (has_term(form, rules.WITHDRAWAL_LINK) | has_term(words, rules.WITHDRAWAL_LINK)),
               evidence_item("pdf", 0, item, F.coalesce(label, "abs")))))


def evidence_lists(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """(site, grp, o1, o2, o3, url, quote): distinct evidence, all of it."""
    own = signals.select("site", "position", "url", F.explode("items").alias("e")).select("site", "position", "url", "e.*")
    said = signals.filter(F.col("disclosure").isNotNull()).select(
        "site", "position", "url", F.lit("widget").alias("grp"), F.lit(9).alias("part"), F.lit(0).alias("item"),
        F.col("disclosure").alias("quote"), F.lit("disclosure").alias("key"))
    rows = own.unionByName(link_evidence(documents)).unionByName(said)
    # Routes and the disclosure list one source before the other; everything else follows the pages.
    by_part = F.col("grp").isin("route", "widget")
    ordered = rows.withColumns({
        "o1": F.when(by_part, F.col("part")).otherwise(F.col("position")).cast("long"),
        "o2": F.when(by_part, F.col("position")).otherwise(F.col("part")).cast("long"), "o3": F.col("item").cast("long"),
        "key": F.coalesce("key", F.concat_ws("\u0000", "url", "quote"))})
    order = [F.col("o1"), F.col("o2"), F.col("o3")]
    distinct = first_by(ordered.select("site", "grp", "key", "o1", "o2", "o3", "url", "quote"), ["site", "grp", "key"], order)
    return distinct.drop("key")


def category_pages(signals: DataFrame, categories: DataFrame) -> DataFrame:
    """Policy and accessibility pages, with what a finding quotes from each; lists of any length."""
    both = signals.select("site", "page_id", "position", "url", "kind", "title", "headline", "withdrawal_heading").join(
        categories, ["site", "page_id"], "left")
    policy = F.array_contains("categories", "withdrawal") | ((F.col("kind") == "legal") & F.col("withdrawal_heading"))
    rows = F.array_compact(F.array(
        F.when(policy, F.struct(F.lit("policy").alias("grp"), excerpt(F.col("headline")).alias("quote"))),
        F.when(F.array_contains("categories", "accessibility"), F.struct(
            F.lit("statement").alias("grp"),
            excerpt(F.coalesce(F.nullif("title", F.lit("")), "url")).alias("quote")))))
    return both.select("site", F.col("position").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"),
                       F.lit(0).cast("long").alias("o3"), "url", F.explode(rows).alias("r")).select(
        "site", "r.grp", "o1", "o2", "o3", "url", "r.quote")


# ---- environmental claims ---------------------------------------------------------------------------------------

def claim_rows(signals: DataFrame) -> DataFrame:
    """Distinct sentences of a site that are claims by rule or candidates for review, from their first page."""
    found = signals.select("site", "position", "url", F.explode("claims").alias("c")).select("site", "position", "url", "c.*")
    first = first_by(found, ["site", "key"], [F.col("position"), F.col("item")])
    return first.filter(F.col("kind").isNotNull()).select("site", "position", "item", "url", "kind", "text")


def reviewed_claims(claims: DataFrame, verdicts: DataFrame | None, sent_most: int = rules.CLAIM_SENTENCES) -> DataFrame:
    """Claims with verdicts: the first ``sent_most`` candidates of a site, as many as one review takes, are numbered and
    joined to the first valid verdict. Tasks keep that many rows of a site before the shuffle.

    ``verdicts``: (site, seq, idx, verdict, rewording, reason). Unknown verdicts and numbers out of range are ignored.
    """
    candidates = claims.filter(F.col("kind") == "candidate")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("position", "item"))
    sent = candidates.withColumn("rank", rank).filter(F.col("rank") <= sent_most).withColumn("idx", F.col("rank") - 1).drop("rank")
    if verdicts is None:
        return sent.select("*", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rewording"),
                           F.lit(None).cast("string").alias("reason"))
    valid = verdicts.filter(F.col("verdict").isin(*rules.VERDICTS) & F.col("idx").between(0, sent_most - 1)
                            & F.col("reason").isNotNull())
    first = first_by(valid, ["site", "idx"], [F.col("seq")]).select("site", "idx", "verdict", "rewording", "reason")
    return sent.join(first, ["site", "idx"], "left")


def green_claims(signals: DataFrame, verdicts: DataFrame | None = None,
                 failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-site counts and the evidence rows. ``failed`` (site, error) names sites whose review broke down."""
    claims = claim_rows(signals)
    sent = reviewed_claims(claims, verdicts)
    generic = sent.filter(F.col("verdict") == "generic_unsubstantiated")
    totals = claims.groupBy("site").agg(
        F.count_if(F.col("kind") == "candidate").alias("candidates"),
        F.count_if(F.col("kind") != "candidate").alias("rule_claims"),
        F.count_if(F.col("kind") == "offset_neutrality").alias("offset_claims"))
    judged = sent.groupBy("site").agg(
        F.count("*").alias("sent"), F.count_if(F.col("verdict") == "generic_unsubstantiated").alias("generic"),
        F.min(F.when((F.col("verdict") == "generic_unsubstantiated") & (F.coalesce("rewording", F.lit("")) != ""),
                     F.struct("idx", "rewording")))["rewording"].alias("rewording"))
    counts = totals.join(judged, "site", "left")
    if failed is not None:
        counts = counts.join(failed.select("site", F.col("error").alias("review_error")), "site", "left")
        generic = generic.join(failed, "site", "left_anti")
    else:
        counts = counts.withColumn("review_error", F.lit(None).cast("string"))
    ruled = claims.filter(F.col("kind") != "candidate")
    reasons = (F.when(F.col("kind") == "self_made_label", "A label without certification scheme or public authority.")
               .when(F.col("kind") == "offset_neutrality", "Neutral climate impact that rests on offsets."))
    wide = lambda df, grp, part, source, reason, rewording: df.select(
        "site", F.lit(grp).alias("grp"), F.lit(part).cast("long").alias("o1"), F.col("position").cast("long").alias("o2"),
        F.col("item").cast("long").alias("o3"), "url", excerpt(F.col("text")).alias("quote"),
        F.lit(source).alias("source"), F.nullif("kind", F.lit("candidate")).alias("rule"), reason.alias("reason"), rewording.alias("rewording"))
    nothing = F.lit(None).cast("string")
    rows = (wide(ruled, "claim", 0, "rule", reasons, nothing)
            .unionByName(wide(generic, "claim", 1, "classifier", F.col("reason"), F.nullif("rewording", F.lit(""))))
            .unionByName(wide(sent, "candidate", 0, "candidate", nothing, nothing)))
    return counts, rows


def claim_lists(claims: DataFrame) -> DataFrame:
    """(site, claim_list): what a finding says about each claim it quotes, in the order of its evidence, ``INLINE`` at most."""
    order = Window.partitionBy("site").orderBy("o1", "o2", "o3")
    shown = claims.filter(F.col("grp") == "claim").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= INLINE)
    said = F.struct("rn", "url", "quote", "source", "rule", "reason", "rewording")
    return shown.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(said)), lambda c: F.struct(
        c["url"], c["quote"], c["source"], c["rule"], c["reason"], c["rewording"])).alias("claim_list"))


# ---- one row per site -------------------------------------------------------------------------------------------

def site_signals(signals: DataFrame, categories: DataFrame) -> DataFrame:
    """The first page with each signal, and sums: one aggregation over compact rows, partial before the shuffle."""
    p = signals.join(categories, ["site", "page_id"], "left").withColumns({
        "imprint": F.array_contains("categories", "imprint"), "other_legal": F.col("kind") == "legal",
        "accessible": F.array_contains("categories", "accessibility"),
        "policy": F.array_contains("categories", "withdrawal") | ((F.col("kind") == "legal") & F.col("withdrawal_heading"))})
    first = lambda cond, quote: F.min(F.when(cond & quote.isNotNull(), F.struct(
        F.col("position"), F.struct(F.col("url").alias("url"), quote.alias("quote")).alias("e"))))["e"]
    yes = F.lit(True)
    c = F.col
    channel = F.coalesce(c("email"), F.when(c("has_fields"), F.lit("Form on the statement page")))
    banner = c("banner.accept").isNotNull()
    legal = {f"{name}_{where}": first(c(cond), c(name)) for name in ("address", "email", "registration")
             for where, cond in (("imprint", "imprint"), ("legal", "other_legal"))}
    sums = {n: F.sum(n) for n in ("missing_lang", "heading_issues", "missing_alt", "unlabelled_inputs", "empty_links")}
    return p.groupBy("site").agg(*[col.alias(name) for name, col in {
        "price": first(yes, c("price")), "currency": first(yes, c("currency")), "shipping": first(yes, c("shipping")),
        "eu_language": first(yes, c("eu_language")), "disclosure": first(yes, c("disclosure")),
        "vendor": F.min(F.when(c("vendor").isNotNull(), F.struct("position", "url", "vendor"))),
        "banner": F.min(F.when(banner, F.struct("position", "url", "banner"))),
        "statement": first(c("accessible"), c("statement")), "channel": first(c("accessible"), channel),
        "accessible_pages": F.count_if(c("accessible")), "imprint_pages": F.count_if(c("imprint")),
        "imprint_url": F.min(F.when(c("imprint"), F.struct("position", "url")))["url"],
        "legal_pages": F.count_if(c("other_legal")), **legal, "policy_pages": F.count_if(c("policy")),
        "statutory": first(c("policy"), c("statutory")),
        "longest": F.min(F.when(c("policy") & c("longest_days").isNotNull(), F.struct(
            (-c("longest_days")).alias("days"), c("position"), F.struct(c("url").alias("url"), c("longest").alias("quote")).alias("e")))),
        **sums}.items()])


def widget_names(signals: DataFrame) -> DataFrame:
    """(site, widgets): chat vendors of a site in the order they appear; at most one entry per known vendor."""
    seen = (signals.select("site", "position", F.posexplode(F.filter("items", lambda e: e["grp"] == "widget")).alias("i", "e"))
            .groupBy("site", F.regexp_extract("e.quote", "^(.*?) chat: ", 1).alias("name"))
            .agg(F.min(F.struct("position", "i")).alias("seen")))
    return seen.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("seen", "name")))["name"].alias("widgets"))


def listed(rows: DataFrame) -> DataFrame:
    """(site, lists): the evidence lists of a site by name, each cut to what a report shows, with their full lengths."""
    order = Window.partitionBy("site", "grp").orderBy("o1", "o2", "o3")
    cap = reduce(lambda acc, kv: acc.when(F.col("grp") == kv[0], kv[1]), CAPS.items(), F.when(F.lit(False), 0)).otherwise(INLINE)
    # The longest list prunes before the shuffle; each is then cut to its own length.
    shown = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= INLINE).filter(F.col("rn") <= cap)
    arrays = shown.groupBy("site", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "url", "quote"))),
                                                          lambda e: F.struct(e["url"], e["quote"])).alias("evidence"))
    # Order-free digest of all evidence pages, the same as ``page_digest`` of a list that holds them all.
    pages = rows.groupBy("site", "grp", "url").agg(F.count("*").alias("rows")).groupBy("site", "grp").agg(
        F.sum("rows").alias("total"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("url")).alias("a"),
        F.bit_xor(F.xxhash64("url", F.lit(7))).alias("b"))
    both = arrays.join(pages, ["site", "grp"])
    return both.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct(
        "evidence", "total", F.concat_ws("|", "n", "a", "b").alias("digest"))))).alias("lists"))


def page_digest(pages: Column) -> Column:
    """Order-free digest of the distinct addresses of an array: their number and two sums without carry of their hashes."""
    def of(distinct):
        parts = [F.aggregate(F.transform(distinct, hashed), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
                 for hashed in (lambda u: F.xxhash64(u), lambda u: F.xxhash64(u, F.lit(7)))]
        return F.concat_ws("|", F.size(distinct).cast("long"), *parts)

    return let(F.array_distinct(pages), of)


def _fix(code: str, html: Column | None = None) -> Column:
    return F.struct(F.lit(copy.SUMMARIES[code]).alias("summary"),
                    (F.lit(None).cast("string") if html is None else html).alias("html"))


def _label(position: int) -> Column:
    pairs = [x for loc, labels in copy.LABELS.items() for x in (F.lit(loc), F.lit(labels[position]))]
    return F.element_at(F.create_map(*pairs), F.col("locale"))


# A link, and the page it leads to: which contract, where the receipt goes, and a second step that confirms.
WITHDRAWAL_FORM = """<a class="button" href="/withdraw">%s</a>
<form method="post" action="/withdraw">
<p><label for="contract">%s</label> <input id="contract" name="contract" required></p>
<p><label for="receipt">%s</label> <input id="receipt" name="receipt" type="email" required></p>
<p><button type="submit" name="step" value="confirm">%s</button></p>
</form>"""


def _text(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def _evidence(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(EVIDENCE)




class Rules:
    """Verdicts as expressions over the wide site row: status, detail, whether it rests on absence, evidence, meta, fix."""

    def __init__(self, reviewed: bool):
        self.reviewed = reviewed
        c = F.col
        self.shell = F.coalesce(c("js_shell"), F.lit(False))
        self.now = c("now")

    def list_of(self, group: str) -> Column:
        return F.coalesce(F.element_at("lists", group)["evidence"], F.array().cast(EVIDENCE))

    def total(self, group: str) -> Column:
        return F.coalesce(F.element_at("lists", group)["total"], F.lit(0))

    def applies(self, code: str) -> Column:
        start = next(d[5] for d in copy.DEFINITIONS if d[0] == code)
        return scalars.applies_phrase(self.now, F.lit(start).cast("timestamp"))

    def row(self, code: str, cases: list[tuple], meta: Column, fix: Column) -> Column:
        """``cases``: (condition, status, detail, rests on absence, evidence, list name); the first that holds wins."""
        pick = lambda i, kind: reduce(
            lambda acc, case: acc.when(case[0], F.lit(case[i]) if isinstance(case[i], (str, bool)) else case[i]),
            cases, F.when(F.lit(False), F.lit(None).cast(kind)))
        none = F.array().cast(EVIDENCE)
        prepared = [(cond, status, detail, absent, none if ev is None else ev, grp) for cond, status, detail, absent, ev, grp in cases]
        cases = prepared
        absent = self.shell & pick(3, "boolean")
        detail = pick(2, "string")
        return F.struct(
            F.lit(code).alias("code"),
            F.when(absent, "unknown").otherwise(pick(1, "string")).alias("status"),
            F.when(absent, F.concat(F.lit(copy.SHELL_NOTE + " Without scripts: "), lower_first(detail))).otherwise(detail).alias("detail"),
            pick(4, EVIDENCE).cast(EVIDENCE).alias("evidence"), pick(5, "string").alias("grp"),
            F.to_json(F.struct(meta.alias("v"), absent.alias("on_shell"))).alias("meta"), fix.alias("fix"))

    def all(self) -> Column:
        return F.array(self.withdrawal_function(), self.withdrawal_policy(), self.green_claims(), self.statement(),
                       self.sample(), self.disclosure(), self.cookies(), self.legal_notice(), self.eu_targeting())

    def withdrawal_function(self) -> Column:
        applies = self.applies("withdrawal_function")
        fix = _fix("withdrawal_function", _text(WITHDRAWAL_FORM, *[escape_html(_label(i)) for i in (0, 4, 5, 6)]))
        return self.row("withdrawal_function", [
            (self.total("function") > 0, "pass",
             _text("The shop seems to offer withdrawal on the site; confirm the second step by hand. The duty %s.", applies),
             False, self.list_of("function"), "function"),
            (self.total("route") > 0, "warn",
             _text("Withdrawal is only possible by download or e-mail, which is no function on the site. The duty %s.", applies),
             False, self.list_of("route"), "route"),
            (F.lit(True), "fail", _text("No way to withdraw was found on the scanned pages. The duty %s.", applies),
             True, None, ""),
        ], F.struct(F.lit(None).cast("int").alias("none")), fix)

    def withdrawal_policy(self) -> Column:
        c = F.col
        days = -c("longest.days")
        has, longest = c("policy_pages") > 0, c("longest").isNotNull()
        sign = "<p>You may withdraw from this contract within 14 days without giving a reason.</p>"
        return self.row("withdrawal_policy", [
            (has & c("statutory").isNotNull(), "pass", "The policy names the 14-day withdrawal period.", False,
             _evidence(c("statutory")), ""),
            (has & longest & (days > rules.STATUTORY_DAYS), "pass",
             _text("The policy grants %d days, more than the statutory 14.", days), False, _evidence(c("longest.e")), ""),
            (has & longest, "fail", _text("The policy grants %d days; the law grants at least 14.", days), False,
             _evidence(c("longest.e")), ""),
            (has, "warn", "There is a withdrawal policy, but it names no period.", False, self.list_of("policy"), "policy"),
            (self.total("pdf") > 0, "warn", "The withdrawal policy is only a download; publish it as a page.", False,
             self.list_of("pdf"), "pdf"),
            (F.lit(True), "fail", "No withdrawal policy was found on the scanned pages.", True, None, ""),
        ], F.struct(F.when(has & c("statutory").isNotNull(), F.lit(14)).when(has & longest, days).alias("period_days")),
            _fix("withdrawal_policy", F.lit(sign)))

    def green_claims(self) -> Column:
        c = F.col
        n = lambda name: F.coalesce(c(name), F.lit(0).cast("long"))
        used = F.lit(self.reviewed) & c("review_error").isNull()
        generic = F.when(used, n("generic")).otherwise(F.lit(0))
        claims = n("rule_claims") + generic
        open_ones = F.when(used, F.lit(0)).otherwise(n("sent"))
        state = (F.when(F.lit(not self.reviewed), "missing").when(n("sent") == 0, "not_needed")
                 .when(c("review_error").isNotNull(), "error").otherwise("used"))
        applies = self.applies("green_claims")
        good = F.when(used, c("rewording"))
        html = F.concat_ws("\n", F.when(good.isNotNull(), F.concat(F.lit("<p>"), escape_html(good), F.lit("</p>"))),
                           F.when(n("offset_claims") > 0, F.lit("<p>We pay for climate projects; our products are not neutral for that.</p>")),
                           F.when(good.isNull() & (n("offset_claims") == 0), F.lit("<p>Our boxes are made from 100 % recycled board.</p>")))
        meta = F.struct(state.alias("classifier"), n("candidates").alias("candidates"),
                        F.when(state.isin("used", "error"), n("sent")).otherwise(F.lit(0)).alias("sent"),
                        (n("candidates") > n("sent")).alias("truncated"), c("claim_list").alias("claims"), claims.alias("claim_count"),
                        n("rule_claims").alias("rule_claims"), c("review_error").alias("error"))
        return self.row("green_claims", [
            (claims > 0, "fail", _text("%d environmental claims need proof or removal, %d of them by rule; %d more were "
                                       "not reviewed. The ban %s.", claims, n("rule_claims"), open_ones, applies), False,
             self.list_of("claim"), "claim"),
            (open_ones > 0, "unknown", _text("%d sentences with environmental wording wait for a review. The ban %s.",
                                             open_ones, applies), False, self.list_of("candidate"), "candidate"),
            (n("candidates") > 0, "pass", _text("%d sentences were reviewed; none is an unspecific claim. The ban %s.",
                                                n("candidates"), applies), False, None, ""),
            (F.lit(True), "pass", _text("No environmental claims on the scanned pages. The ban %s.", applies), True, None, ""),
        ], meta, _fix("green_claims", html))

    def statement(self) -> Column:
        c = F.col
        lacking = F.concat_ws(" and ", F.when(c("statement").isNull(), "wording on conformance"),
                              F.when(c("channel").isNull(), "a contact"))
        mail = F.concat(F.lit("accessibility@"), F.regexp_replace("hostname", r"^www\.", ""))
        has = c("accessible_pages") > 0
        note = " " + copy.EXEMPTION_NOTE
        return self.row("accessibility_statement", [
            (~has, "fail", "No accessibility statement was found." + note, True, None, ""),
            (c("statement").isNotNull() & c("channel").isNotNull(), "pass",
             "An accessibility statement with a contact was found." + note, False, _evidence(c("statement"), c("channel")), ""),
            (c("statement").isNotNull() | c("channel").isNotNull(), "warn",
             _text("The accessibility page lacks %s.%s", lacking, F.lit(note)), False, _evidence(c("statement"), c("channel")), ""),
            (F.lit(True), "warn", _text("The accessibility page lacks %s.%s", lacking, F.lit(note)), False,
             self.list_of("statement"), "statement"),
        ], F.struct(F.lit(None).cast("int").alias("none")),
            _fix("accessibility_statement", _text('<h1>Accessibility statement</h1>\n<p>Write to <a href="mailto:%s">%s</a>.</p>', mail, mail)))

    def sample(self) -> Column:
        c = F.col
        names = ["missing_lang", "heading_issues", "missing_alt", "unlabelled_inputs", "empty_links"]
        n = {k: F.coalesce(c(k), F.lit(0).cast("long")) for k in names}
        failures = n["missing_lang"] + n["missing_alt"] + n["unlabelled_inputs"] + n["empty_links"]
        note = " " + copy.SAMPLE_NOTE
        meta = F.struct(c("pages").alias("pages_sampled"), *[n[k].alias(k) for k in names])
        language = F.coalesce(F.get("locales", 0), c("locale"))
        html = F.nullif(F.concat_ws(
            "\n", F.when(n["missing_lang"] > 0, F.concat(F.lit('<html lang="'), language, F.lit('">'))),
            F.when(n["heading_issues"] > 0, F.lit("<h1>Linen shirt</h1>")),
            F.when(n["missing_alt"] > 0, F.lit('<img src="/shirt.jpg" alt="Linen shirt">')),
            F.when(n["empty_links"] > 0, F.lit('<a href="/cart" aria-label="Cart"></a>')),
            F.when(n["unlabelled_inputs"] > 0, F.lit('<label for="mail">E-mail</label><input id="mail" name="mail" type="email">'))),
            F.lit(""))
        return self.row("a11y_sample", [
            (self.shell | (c("pages") == 0), "unknown", "No pages to sample." + note, True, None, ""),
            (failures > 0, "fail", _text("%d failures on %d pages: %d without language, %d images without alt, %d fields "
                                         "without label, %d links without name.%s", failures, c("pages"), n["missing_lang"],
                                         n["missing_alt"], n["unlabelled_inputs"], n["empty_links"], F.lit(note)), False,
             self.list_of("sample"), "sample"),
            (n["heading_issues"] > 0, "warn", _text("%d pages do not have exactly one h1.%s", n["heading_issues"], F.lit(note)),
             False, self.list_of("sample_h1"), "sample_h1"),
            (F.lit(True), "pass", _text("Nothing was found on %d pages.%s", c("pages"), F.lit(note)), False, None, ""),
        ], meta, _fix("a11y_sample", html))

    def disclosure(self) -> Column:
        c = F.col
        names = F.coalesce(c("widgets"), F.array().cast("array<string>"))
        applies = self.applies("ai_disclosure")
        listing = F.array_join(names, ", ")
        shown = self.list_of("widget")
        widgets_only = F.filter(shown, lambda e: e["quote"].rlike(" chat: "))
        return self.row("ai_disclosure", [
            (F.size(names) == 0, "pass", _text("No chat widget was found. The duty %s.", applies), True, None, ""),
            (c("disclosure").isNotNull(), "pass", _text("Chat (%s) with wording that names a machine. The duty %s.", listing, applies),
             False, shown, "widget"),
            (F.lit(True), "warn", _text("Chat (%s) without wording that answers may come from a machine. The duty %s.",
                                        listing, applies), True, widgets_only, "widget"),
        ], F.struct(names.alias("widgets")),
            _fix("ai_disclosure", F.concat(F.lit("<p>"), escape_html(_label(1)), F.lit("</p>"))))

    def cookies(self) -> Column:
        c = F.col
        vendor = c("vendor.vendor.name")
        quote = lambda q: F.struct(c("banner.url").alias("url"), q.alias("quote"))
        accept, reject = c("banner.banner.accept"), c("banner.banner.reject")
        return self.row("cookie_parity", [
            (self.shell, "unknown", copy.SHELL_NOTE, False, None, ""),
            (c("banner").isNotNull() & reject.isNotNull(), "pass",
             "The banner has a reject button next to the accept button; compare their weight by hand.", False,
             _evidence(quote(accept), quote(reject)), ""),
            (c("banner").isNotNull(), "warn", "The banner has an accept button but no reject button.", False,
             _evidence(quote(accept)), ""),
            (c("vendor").isNotNull(), "unknown", _text("%s is installed; its banner appears only with scripts.", vendor), False,
             _evidence(F.struct(c("vendor.url").alias("url"), excerpt(F.concat(vendor, F.lit(" script: "), c("vendor.vendor.url"))).alias("quote"))), ""),
            (F.lit(True), "unknown", "No banner in the markup; look in a browser.", False, None, ""),
        ], F.struct(vendor.alias("cmp")),
            _fix("cookie_parity", F.lit('<button type="button">Reject all</button><button type="button">Accept all</button>')))

    def legal_notice(self) -> Column:
        c = F.col
        imprint = c("imprint_pages") > 0
        part = lambda n: F.when(imprint, c(f"{n}_imprint")).otherwise(c(f"{n}_legal"))
        parts = [part("address"), part("email"), part("registration")]
        found = sum(p.isNotNull().cast("int") for p in parts)
        lacking = F.concat_ws(" and ", *[F.when(p.isNull(), F.lit(w)) for p, w in zip(
            parts, ("a postal address", "an e-mail address", "a register or VAT number"))])
        path = F.when(imprint, F.coalesce(urls.path_of(c("imprint_url")), c("imprint_url"))).otherwise(_label(3))
        any_page = imprint | (c("legal_pages") > 0)
        meta = F.struct(*[F.when(any_page, p.isNotNull()).alias(n) for p, n in zip(parts, ("address", "email", "registration"))],
                        F.when(imprint, "imprint").when(any_page, "other_legal").alias("source"))
        return self.row("legal_notice", [
            (~any_page, "fail", "No legal notice or other legal page was found.", True, None, ""),
            (found == 3, "pass", "Address, e-mail and a register or VAT number were found; check names by hand.", False,
             _evidence(*parts), ""),
            (found == 0, "fail", _text("The legal pages show none of the details: %s.", lacking), True, None, ""),
            (F.lit(True), "warn", _text("The legal pages lack %s.", lacking), False, _evidence(*parts), ""),
        ], meta, _fix("legal_notice", F.concat(F.lit('<footer><a href="'), path, F.lit('">'), _label(2), F.lit("</a></footer>"))))

    def eu_targeting(self) -> Column:
        c = F.col
        domain = F.when(c("domain").isin(*rules.EU_DOMAINS), F.struct(
            F.coalesce("first_url", F.concat(F.lit("https://"), "hostname", F.lit("/"))).alias("url"),
            F.concat(F.lit("Domain ends in ."), "domain").alias("quote")))
        signs = [F.coalesce(c("price"), c("currency")), c("shipping"), c("eu_language"), domain]
        names = F.array_compact(F.array(*[F.when(s.isNotNull(), F.lit(n)) for s, n in zip(
            signs, ("eur_prices", "eu_shipping", "eu_language", "eu_domain"))]))
        return self.row("eu_targeting", [
            (F.size(names) > 0, "pass", "The shop shows signs of selling to the EU, so the rules of this report apply.",
             False, _evidence(*signs), ""),
            (F.lit(True), "unknown", "No euro prices, EU delivery, EU language or EU domain was found.", True, None, ""),
        ], F.struct(names.alias("signals")), _fix("eu_targeting"))


@built_once
def verdict_rows(reviewed: bool) -> Column:
    return Rules(reviewed).all()


ANSWER = "array<struct<index:int,verdict:string,rewording:string,reason:string>>"


def read_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored answers of reviews (site, answer: a JSON list of index, verdict, rewording, reason) as verdicts, and the checks
    that an unreadable answer breaks: (site, code, error). An answer is read as a whole or not at all.
    """
    read = answers.select("site", "answer", F.try_parse_json("answer").alias("parsed")).withColumn(
        "rows", F.try_variant_get("parsed", "$", ANSWER))
    problem = F.when(F.col("parsed").isNull(), "The answer of the review is no JSON.").when(
        F.col("rows").isNull(), "The answer of the review is no list of verdicts.")
    broken = read.filter(problem.isNotNull()).select("site", F.lit("green_claims").alias("code"), problem.alias("error"))
    verdicts = read.select("site", F.posexplode("rows").alias("seq", "r")).select(
        "site", "seq", F.col("r.index").cast("long").alias("idx"), "r.verdict", "r.rewording", "r.reason")
    return verdicts, broken


def _contained(details: DataFrame, broken: DataFrame | None) -> DataFrame:
    """Findings of checks that broke on a site become unknown and carry the error; all others stay as they are."""
    if broken is None:
        return details
    errors = broken.groupBy("site", "code").agg(F.min("error").alias("error"))
    hit = F.col("error").isNotNull()
    fix = F.struct(F.lit(copy.BROKEN_FIX).alias("summary"), F.lit(None).cast("string").alias("html"))
    return details.join(errors, ["site", "code"], "left").withColumns({
        "status": F.when(hit, "unknown").otherwise(F.col("status")), "detail": F.when(hit, copy.BROKEN_NOTE).otherwise(F.col("detail")),
        "evidence": F.when(hit, F.array().cast(EVIDENCE)).otherwise(F.col("evidence")), "grp": F.when(hit, "").otherwise(F.col("grp")),
        "meta": F.when(hit, F.to_json(F.struct(F.struct("error").alias("v")))).otherwise(F.col("meta")),
        "fix": F.when(hit, fix).otherwise(F.col("fix"))}).drop("error")


def audit(documents: DataFrame, now: str, verdicts: DataFrame | None = None, failed: DataFrame | None = None,
          keep: bool = True, broken: DataFrame | None = None, **vocabularies) -> Audit:
    """Run the nine checks over all sites. ``keep`` stores the page signals and the evidence rows once,
    as several steps read them. ``broken`` (site, code, error) names checks that could not be completed on a site: they
    become unknown with their error, and nothing else changes."""
    signals = page_signals(documents, **vocabularies)
    categories = classify.page_categories(documents.filter(F.col("status_code").between(200, 299)))
    if keep:
        signals, categories = stored(signals, "signals"), stored(categories, "categories")
    counts, claims = green_claims(signals, verdicts, failed)
    if keep:
        claims = stored(claims, "claims")
    rows = evidence_lists(documents, signals).unionByName(category_pages(signals, categories))
    rows = rows.unionByName(claims.select(*rows.columns))
    if keep:
        rows = stored(rows, "evidence")
    wide = (contexts(documents, now)
            .join(site_signals(signals, categories), "site", "left")
            .join(widget_names(signals), "site", "left")
            .join(counts, "site", "left")
            .join(claim_lists(claims), "site", "left")
            .join(listed(rows), "site", "left"))
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("policy_pages", "accessible_pages", "imprint_pages", "legal_pages")}
    found = wide.withColumns(zero).select("site", "lists", F.posexplode(verdict_rows(verdicts is not None)).alias("position", "f"))
    details = _contained(found.select("site", "position", "f.*", "lists"), broken)
    total = F.when(F.col("grp") != "", F.coalesce(F.element_at("lists", F.col("grp"))["total"], F.lit(0)))
    long_list = F.coalesce(total > F.size("evidence"), F.lit(False))
    # One rule for lists of any length: the digest of all addresses, whether or not the finding carries them all.
    digest = F.when(long_list, F.element_at("lists", F.col("grp"))["digest"]).otherwise(
        page_digest(F.coalesce("evidence.url", F.array().cast("array<string>"))))
    print_ = F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("|", "code", "status", digest), 256))), "+/=", "-_"), 1, 22)
    findings = details.join(F.broadcast(definitions(documents.sparkSession)), "code").select(
        "site", "position", "code", "status", "severity", "title", "detail", "evidence",
        F.size("evidence").cast("long").alias("shown"),
        F.when(long_list, total).otherwise(F.size("evidence")).cast("long").alias("evidence_total"),
        print_.alias("fingerprint"),
        "citation", "fix", "meta", "grp")

    def evidence() -> DataFrame:
        narrow = findings.select("site", "code", "grp", "evidence", "evidence_total", "shown")
        return full_evidence(stored(narrow, "narrow") if keep else narrow, rows)

    return Audit(findings.drop("grp", "shown"), claims.filter(F.col("grp") == "claim").drop("grp"), evidence)


def full_evidence(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Every quote behind the findings, one row each. Short lists come from the finding, long ones from their rows."""
    short = findings.filter(F.col("evidence_total") == F.col("shown")).select(
        "site", "code", F.posexplode("evidence").alias("o", "e")).select(
        "site", "code", F.lit(0).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"),
        F.col("o").cast("long").alias("o3"), "e.url", "e.quote")
    long_ones = findings.filter(F.col("evidence_total") > F.col("shown")).select("site", "code", "grp")
    return short.unionByName(rows.join(long_ones, ["site", "grp"]).select("site", "code", "o1", "o2", "o3", "url", "quote"))


def definitions(spark) -> DataFrame:
    """The nine checks: code, severity, title, citation."""
    rows = [(code, severity, copy.TITLES[code], (law, article, url)) for code, severity, law, article, url, _ in copy.DEFINITIONS]
    return spark.createDataFrame(rows, "code string, severity string, title string, "
                                       "citation struct<law:string,article:string,url:string>")
