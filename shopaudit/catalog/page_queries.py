"""Queries over the driver's pages and documents: URL and text functions, extraction, page-level checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import findings as checks
from ..checks import signals
from ..functions import scalars, text, urls
from ..operators import classify, extract
from ..session import derive, spread, stored
from ..sources import adapters as a
from ..sources.pages import document_rows, read_pages, with_order
from ..vocab import rules
from . import history_queries

NOW = "2026-12-01 00:00:00"


def _pages(spark, d):
    return a.table(spark, d, "pages")


def _documents(spark, d):
    """Extraction with page_id as the order, so nothing is ranked.

    A file of pages may be one group of rows, which one task reads; extraction costs far more than dealing the pages does.
    """
    return extract.documents(spread(with_order(_pages(spark, d)), "page_id"))


def _kept(spark, d, *columns):
    """The asked columns of the documents, written once as the document sink does and read back."""
    docs = _documents(spark, d)
    return stored(docs.select(*columns) if columns else docs, "documents")


def _texts(spark, d):
    return a.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


# ---- URLs -------------------------------------------------------------------------------------------------------

def url_normalise(spark, d):
    return derive(_pages(spark, d).select("page_id", "url"), p=urls.parse(F.col("url"))).select(
        "page_id", urls.normalised(F.col("p")).alias("normalised"), urls.site_key(F.col("p")).alias("site"))


def url_parts(spark, d):
    pages = derive(_pages(spark, d).select("page_id", "url"), path=urls.parse(F.col("url"))["path"])
    pages = derive(pages, reg=urls.registration(F.col("url")), safe=urls.safe_href(
        F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("javascript:")).otherwise(F.lit("")), F.col("url"))))
    pages = derive(pages, shown=urls.display_path(F.col("url"), F.lit("www.therti.example.org")),
                   start=urls.start_url(F.concat(F.lit("  "), F.regexp_replace("url", "^https?://", ""))))
    path = F.col("path")
    return pages.select(
        "page_id", F.col("reg.url").alias("stored_url"), F.col("reg.hostname").alias("hostname"), urls.path_words(F.col("url")).alias("words"),
        urls.is_home_path(F.regexp_replace(path, "[0-9]+.*$", "")).alias("home"), urls.is_product_path(F.concat(F.lit("/Shop"), path)).alias("product"),
        urls.is_asset(F.concat(path, F.lit(".PDF"))).alias("asset"), urls.is_document(F.concat("url", F.lit(".pdf"))).alias("document"),
        "shown", "safe", "start")


def url_screen(spark, d):
    """Addresses as people mistype them, made from the pages' own hosts."""
    host = urls.parse(F.col("url"))["host"]
    kind = F.col("page_id") % 14
    forms = [F.concat(F.lit(" "), host, F.lit("/a?b=1#c ")), F.concat(F.lit("ftp://"), host), F.concat(F.lit("http://u:p@"), host),
             F.concat(F.lit("http://10.1.2."), (F.col("page_id") % 256).cast("string")), F.concat(F.lit("https://"), host, F.lit(":22/")),
             F.lit("localhost"), F.lit("http://[::1]/x"), F.lit("intranet"), F.lit("  "), F.concat(F.lit("https://"), host, F.lit(".local")),
             F.lit("http://[::ffff:192.168.0.1]/"), F.concat(F.lit("http://"), host, F.repeat(F.lit("/x"), 1100)),
             F.concat(F.lit("http://"), (F.lit(2130706433) + F.col("page_id") * 0).cast("string")), F.concat(F.lit("https://"), host, F.lit(":8443/"))]
    typed = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    return derive(_pages(spark, d).select("page_id", typed.alias("typed")), s=urls.screen_target(F.col("typed"))).select(
        "page_id", "s.reason", "s.url", "s.hostname")


def address_ranges(spark, d):
    """Reserved IPv4 and IPv6 addresses, made from the order keys."""
    o = a.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = F.element_at(F.array(*[F.lit(x) for x in (10, 100, 127, 169, 172, 192, 198, 8, 224, 0)]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in (0, 64, 127, 128, 254, 16, 31, 32, 168, 18, 19, 20)]), (F.col("o_custkey") % 12 + 1).cast("int"))
    third, fourth = F.col("o_orderkey") % 3, F.col("o_custkey") % 256
    dot = F.lit(".")
    v4 = F.concat(first.cast("string"), dot, second.cast("string"), dot, third.cast("string"), dot, fourth.cast("string"))
    heads = F.array(*[F.lit(x) for x in ("fc00", "fdff", "fe80", "febf", "fec0", "ff02", "2001", "2a00", "64", "100")])
    head = F.element_at(heads, (F.col("o_custkey") % 10 + 1).cast("int"))
    v6 = F.when(F.col("o_orderkey") % 2 == 0, F.concat(head, F.lit("::"), F.lower(F.hex(fourth + 2)))).otherwise(F.concat(F.lit("::ffff:"), v4))
    return derive(o, v4=v4, v6=v6).select("o_orderkey", urls.is_reserved(F.col("v4")).alias("v4_reserved"),
                                          urls.is_reserved(F.col("v6")).alias("v6_reserved"))


# ---- text -------------------------------------------------------------------------------------------------------

def match_form(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(text.match_form(F.col("text"))).alias("form"),
                                   F.length(text.collapse(F.col("text"))).cast("long").alias("collapsed"))


def sentences(spark, d):
    return derive(_texts(spark, d).select("doc_id", "text"), s=text.sentences(F.col("text"))).select(
        "doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("digest"))


def excerpts(spark, d):
    return _texts(spark, d).select("doc_id", text.excerpt(F.col("text")).alias("quote"),
                                   F.md5(text.escape_html(F.col("text"))).alias("escaped"))


DEMO_TERMS = ["the", "les", "der", "license", "of the", "est*", "con"]


def term_match(spark, d):
    """Documents per language that hold each term of a demo vocabulary, and the first term found."""
    forms = derive(_texts(spark, d).select("lang", "text"), form=text.match_form(F.col("text")))
    first = derive(forms.select("lang", "form"), first=text.first_term(F.col("form"), DEMO_TERMS), hit=text.has_term(F.col("form"), DEMO_TERMS))
    return first.groupBy("lang", "first").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def first_email(spark, d):
    none = F.array().cast("array<struct<text:string,href:string,abs:string>>")
    return derive(_texts(spark, d).select("doc_id", "text"), email=text.excerpt(signals.email_line(
        none, text.sentence_forms(F.col("text")), F.col("text")))).filter("email is not null").select("doc_id", "email")


def stated_periods(spark, d):
    """Periods of sentences written from order keys."""
    o = a.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    words = F.element_at(F.array(*[F.lit(w) for w in ("fourteen", "vierzehn", "trente", "one", "2")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(w) for w in ("days", "Tagen", "jours", "months", "mois", "daybreaks")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    said = F.concat(F.lit("Within "), (F.col("o_orderkey") % 1500).cast("string"), F.lit(" days or "), words, F.lit(" "), unit, F.lit("."))
    return derive(o.select("o_orderkey", said.alias("said")), days=signals.periods_in_days(text.match_form(F.col("said")))).select(
        "o_orderkey", F.array_join("days", ",").alias("days"))


def registrations(spark, d):
    """VAT and register numbers in lines written from supplier keys."""
    k = F.col("s_suppkey")
    forms = F.array(F.concat(F.lit("USt-IdNr. DE "), F.lpad((k * 7919).cast("string"), 9, "1")), F.concat(F.lit("VAT ATU"), F.lpad(k.cast("string"), 8, "0")),
                    F.concat(F.lit("HRB "), (k + 100).cast("string")), F.concat(F.lit("Prices include VAT, "), k.cast("string")),
                    F.concat(F.lit("Tel. 030 1234567"), k.cast("string")), F.concat(F.lit("FR"), F.lpad(k.cast("string"), 11, "3")))
    line = F.element_at(forms, (k % 6 + 1).cast("int"))
    street = F.concat(F.lit("Lindenstraße "), k.cast("string"), F.when(k % 3 == 0, "\n10115 Berlin").when(k % 3 == 1, ", 1010 Wien").otherwise("\nBerlin"))
    return a.table(spark, d, "supplier").select("s_suppkey", signals.is_registration(line).alias("registered"),
                                                signals.address_line(street).alias("address"))


def labels(spark, d):
    p = a.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return p.select("p_partkey", text.slug(F.concat(F.lit("Été "), "p_name", F.lit(" -- "), F.repeat("p_name", 3))).alias("slug"),
                    text.plural(F.col("p_size") % 3, "page").alias("pages"), text.lower_first(F.upper("p_name")).alias("name"),
                    text.primary_language(F.element_at(F.array(*[F.lit(x) for x in ("de-AT", " EN_gb", "x", "fr", "1a")]), F.col("p_size") % 5 + 1)).alias("language"))


def references(spark, d):
    """Character references decoded."""
    p = a.table(spark, d, "part").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("&AMP;&REG &check;&NotEqual; &amp;lt; &copy 2 &euro;"), k, F.lit(" &#"), (F.col("p_partkey") % 26 + 65).cast("string"), F.lit("; &#x20AC; &bogus; &eacute;"), k)
    return p.select("p_partkey", text.decode_references(raw).alias("decoded"))


def json_ld(spark, d):
    """Types in lists, below the root at several depths, in strings, escaped, and in a block that does not parse."""
    k = F.col("p_partkey")
    named = lambda t: F.concat(F.lit('{"@context":"https://schema.org","name":"a","name":"b","@graph":[{"@type": ' + t + ', "name":"p'), k.cast("string"), F.lit('"}]}'))
    nested = lambda n: F.lit('{"item":' * n + '{"@type":"Product"}' + "}" * n)
    block = F.element_at(F.array(
        named('"Product"'), named('["Thing","ProductGroup"]'), named('"Organization"'), named('"https://schema.org/Product"'), named('"Product'),
        nested(5), nested(6), nested(7), F.lit('{"name":"\\"@type\\": \\"Product\\"","Product":"@type"}'), F.lit('[[{"@type":"\\u0050roduct"}]]')),
        (k % 10 + 1).cast("int"))
    return a.table(spark, d, "part").select("p_partkey", scalars.describes_product(block).alias("product"))


def fingerprints(spark, d):
    return a.findings(spark, d).select("scan_id", "code", "fingerprint").distinct()


def client_addresses(spark, d):
    u = F.col("user_id").cast("string")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 1.2.3."), u, F.lit(", 9.9.9.9"))).when(F.col("event_id") % 3 == 1, F.lit(" , 5.5.5.5"))
    real = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("4.4.4."), u))
    return a.table(spark, d, "events").select("event_id", "user_id").select("event_id", scalars.client_address(forwarded, real).alias("address"))


ZONES = ["UTC", "Etc/GMT-3", "Etc/GMT+5"]


def dates(spark, d):
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ("UTC", "Etc/GMT-3", "Etc/GMT+5", "Moon/Base")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    known = scalars.known_zone(zone, F.array(*[F.lit(z) for z in ZONES]))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = a.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select("o_orderkey", fmt(scalars.month_start(at)).alias("month"), fmt(scalars.next_month_start(at)).alias("next_month"),
                    fmt(scalars.next_midnight(at)).alias("midnight"), scalars.applies_phrase(at, F.lit("1998-06-19").cast("timestamp")).alias("phrase"),
                    scalars.local_date(at, known).alias("local_date"))


# ---- extraction -------------------------------------------------------------------------------------------------

def page_titles(spark, d):
    return _documents(spark, d).select("page_id", "title", "lang", "js_shell", "kind")


def page_headings(spark, d):
    return _documents(spark, d).select("page_id", F.posexplode("headings").alias("item", "h")).select(
        "page_id", F.col("item").cast("long").alias("item"), F.col("h.level").cast("long").alias("level"), "h.text")


def page_links(spark, d):
    return _kept(spark, d, "page_id", "links").select("page_id", F.posexplode("links").alias("item", "l")).select(
        "page_id", F.col("item").cast("long").alias("item"), "l.text", "l.href", "l.abs")


def page_text(spark, d):
    return _documents(spark, d).select("page_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("size"))


def page_rows(spark, d):
    """Documents as stored: place in the site and text excerpt."""
    docs = document_rows(extract.documents(read_pages(_pages(spark, d))))
    return docs.select("page_id", "site", "position", "status_code", F.md5("text_excerpt").alias("excerpt"))


def a11y_counts(spark, d):
    s = signals.page_signals(_kept(spark, d))
    return s.groupBy("site").agg(F.count("*").alias("pages"), *[F.sum(n).cast("long").alias(n) for n in (
        "missing_lang", "heading_issues", "missing_alt", "unlabelled_inputs", "empty_links")])


def site_locales(spark, d):
    return checks.guessed_locales(_kept(spark, d, "site", "position", "lang", "status_code")).select("site", F.array_join("ranked", ",").alias("ranked"))


def page_findings(spark, d):
    """All nine findings of every site."""
    f = checks.audit(_kept(spark, d), NOW).findings
    return f.select("site", "code", F.col("position").cast("long").alias("position"), "status", "severity", "evidence_total")


def _demo(spark, d):
    """Documents as pages of their source, with frequent words as a vocabulary that reaches every branch."""
    docs = _texts(spark, d)
    none = lambda kind: F.array().cast(kind)
    pages = docs.select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("site"), F.col("doc_id").alias("position"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("final_url"), F.lit(200).alias("status_code"),
        F.lit("other").alias("kind"), F.lit("").alias("title"), "lang", none("array<struct<level:int,text:string>>").alias("headings"),
        none("array<struct<text:string,href:string,abs:string>>").alias("links"), none("array<string>").alias("buttons"),
        none(extract.FORMS).alias("forms"), none("array<string>").alias("scripts"), none(extract.IMAGES).alias("images"),
        F.create_map().cast("map<string,string>").alias("meta"), "text", F.lit(False).alias("js_shell"))
    return signals.page_signals(pages, {"en": ["license"], "fr": ["ouement"], "de": ["verein*"], "es": ["mente"]}, ["the", "der"], ["copyright"], ["apache"])


def green_candidates(spark, d):
    """Distinct sentences by what they count as."""
    rows = checks.claim_rows(_demo(spark, d))
    return rows.select("site", "kind", F.col("position").alias("doc_id"), F.col("item").cast("long").alias("item"))


def green_reviewed(spark, d):
    """The first forty candidates of a source with verdicts, the first valid one per number."""
    numbers = spark.range(45).withColumnRenamed("id", "idx")
    sources = _texts(spark, d).select(F.col("source").alias("site")).distinct()
    base = sources.crossJoin(F.broadcast(numbers)).withColumn("seq", F.col("idx"))
    verdict = F.when(F.col("idx") % 4 == 0, "generic_unsubstantiated").when(F.col("idx") % 4 == 1, "nonsense").otherwise("not_environmental")
    first = base.withColumn("verdict", verdict)
    again = base.withColumns({"verdict": F.lit("specific_substantiated"), "seq": F.col("idx") + 100})
    verdicts = first.unionByName(again).withColumns({"rewording": F.lit(None).cast("string"), "reason": F.lit("r")})
    rows = checks.reviewed_claims(checks.claim_rows(_demo(spark, d)), verdicts)
    return rows.select("site", F.col("idx").cast("long").alias("idx"), F.col("position").alias("doc_id"), "verdict")


def page_link_targets(spark, d):
    """Kinds of the links on every page."""
    links = _kept(spark, d, "site", "links").select("site", F.explode("links").alias("l"))
    return derive(links.select("site", "l.text", "l.abs"), t=classify.target_of("text", "abs")).groupBy(
        "site", "t.kind").agg(F.count("*").alias("n"))


def typed_pages(spark, d):
    """Pages whose answers name content types: only markup is read, with or without a type."""
    kinds = ["text/html", "text/html; charset=utf-8", "application/xhtml+xml", "application/pdf", "TEXT/HTML", "", None, "text/plain"]
    kind = F.element_at(F.array(*[F.lit(k).cast("string") for k in kinds]), (F.col("page_id") % 8 + 1).cast("int"))
    raw = _pages(spark, d).withColumns({"content_type": kind, "status_code": F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)})
    return read_pages(raw).select("page_id", "site", "position", "status_code")


ENDINGS = [".pdf", ".JPG", ".html", ".docx", "", ".css", ".p", ".doc?x=1", ".tar.gz", ".rtf#a"]
PATHS = ["/", "/de", "/en-gb/", "/deu", "/Produkte/x", "/product/", "/x/items/1", "/shop", "/en_gb", "/articles/1", "/p/a/b"]


def url_kinds(spark, d):
    """Addresses of every kind made from the pages' hosts: assets, documents, home and product paths, and none of these."""
    root = F.regexp_extract("url", "^https?://[^/]+", 0)
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("page_id") % len(PATHS) + 1).cast("int"))
    made = derive(_pages(spark, d).select("page_id", F.concat(root, F.lit("/files/a"), ending).alias("file"), path.alias("path")), f=urls.parse(F.col("file")))
    return made.select("page_id", urls.is_asset(F.col("f.path")).alias("asset"), urls.is_document(F.col("file")).alias("document"),
                       urls.is_home_path(F.col("path")).alias("home"), urls.is_product_path(F.col("path")).alias("product"))


# A number of the form each country gives out, and one that is not.
VAT_EXAMPLES = {
    "ATU": ("ATU12345678", "ATU1234567"), "BE": ("BE0123456789", "BE2123456789"), "BG": ("BG123456789", "BG12345678"), "CY": ("CY12345678X", "CY123456789"),
    "CZ": ("CZ12345678", "CZ1234567"), "DE": ("DE123456789", "DE1234567890"), "DK": ("DK12345678", "DK123456789"), "EE": ("EE123456789", "EE12345678"),
    "EL": ("EL123456789", "EL1234567890"), "ES": ("ESX1234567X", "ESX123456X"), "FI": ("FI12345678", "FI123456789"), "FR": ("FRXX123456789", "FRIO123456789"),
    "HR": ("HR12345678901", "HR1234567890"), "HU": ("HU12345678", "HU123456789"), "IE": ("IE1234567WA", "IE12345678"), "IT": ("IT12345678901", "IT1234567890"),
    "LT": ("LT123456789", "LT1234567890"), "LU": ("LU12345678", "LU123456789"), "LV": ("LV12345678901", "LV1234567890"), "MT": ("MT12345678", "MT123456789"),
    "NL": ("NL123456789B01", "NL123456789C01"), "PL": ("PL1234567890", "PL123456789"), "PT": ("PT123456789", "PT1234567890"), "RO": ("RO1234567890", "RO12345678901"),
    "SE": ("SE123456789012", "SE12345678901"), "SI": ("SI12345678", "SI123456789"), "SK": ("SK1234567890", "SK123456789"), "XI": ("XI123456789", "XI12345678")}


def vat_numbers(spark, d):
    """VAT numbers of all countries as shops write them, plain or in groups, and numbers that are one sign off."""
    k = F.col("p_partkey")
    both = [x for pair in VAT_EXAMPLES.values() for x in pair]
    number = F.element_at(F.array(*[F.lit(x) for x in both]), (k % len(both) + 1).cast("int"))
    spaced = F.regexp_replace(number, "([0-9]{3})(?=[0-9]{3})", "$1 ")
    line = F.concat(F.lit("VAT no. "), F.when(k % 3 == 0, spaced).otherwise(number), F.lit(", part "), k.cast("string"), F.lit("."))
    return a.table(spark, d, "part").select("p_partkey", signals.has_vat_number(line).alias("found"))


def script_vendors(spark, d):
    """Script addresses of every chat and consent vendor, upper or lower case, and addresses of none."""
    k, tables = F.col("p_partkey"), (rules.CHAT_VENDORS, rules.CONSENT_VENDORS)
    signs = [sign for vendors in tables for patterns in vendors.values() for sign in patterns] + ["cdn.example.com", "cookie.example"]
    sign = F.element_at(F.array(*[F.lit(x) for x in signs]), (k % len(signs) + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.when(k % 2 == 0, F.upper(sign)).otherwise(sign), F.lit("/l.js?"), k.cast("string"))
    scripts = F.array(F.lit("https://cdn.example.com/a.js"), url)
    hit = lambda vendors: F.get(signals.vendor_scripts(scripts, vendors), 0)["name"]
    return a.table(spark, d, "part").select("p_partkey", hit(rules.CHAT_VENDORS).alias("chat"), hit(rules.CONSENT_VENDORS).alias("consent"))


def nested_buttons(spark, d):
    """Buttons of pages on which elements of one name lie in each other, in lists and in templates."""
    k = F.col("p_partkey")
    inner = (k % 4).cast("int")
    html = F.concat(
        F.lit('<html><body><div>before</div><div class="b" role="button">A'), F.repeat(F.lit("<div>n"), inner), F.lit("x"), F.repeat(F.lit("</div>"), inner),
        F.lit('<div role="button">in'), k.cast("string"), F.lit("<div></div></div> end</div><div>between</div><span role=button>S<span>t</span></span>"),
        F.lit('<ul><li role="button">L<ul><li>inner</li></ul> tail</li></ul><template><div role="button">no</div><template><i>x</i></template><button>no</button></template>'),
        F.lit('<button>B</button><img role="button" title="pic"><div>after</div></body></html>'))
    page = a.table(spark, d, "part").select(
        k.alias("page_id"), F.lit("shop.example").alias("site"), k.alias("position"), F.lit("https://shop.example/").alias("url"),
        F.lit("https://shop.example/").alias("final_url"), F.lit(200).alias("status_code"), html.alias("html"))
    # Spread the made pages over all tasks before the costly step: the rows they are made from are few bytes.
    return extract.documents(spread(page, "page_id")).select("page_id", F.array_join("buttons", "|").alias("buttons"))


QUERIES = {f.__name__: f for f in (
    url_normalise, url_parts, url_screen, address_ranges, match_form, sentences, excerpts, term_match, first_email,
    stated_periods, registrations, labels, references, json_ld, fingerprints, client_addresses, dates, page_titles,
    page_headings, page_links, page_text, page_rows, a11y_counts, site_locales, page_findings, green_candidates,
    green_reviewed, page_link_targets, nested_buttons, typed_pages, url_kinds, vat_numbers, script_vendors)}

_HOST = "lower(regexp_extract(url,'^https?://([^/]+)',1))"
_SITE = f"regexp_replace({_HOST},'^www\\.','')"
_NORM = "regexp_replace(regexp_replace(url,'#.*$',''),'/(\\?|$)','\\1')"
_PATH = "regexp_extract(url,'^https?://[^/]+([^?#]*)',1)"
_VISIBLE = "regexp_replace(html,'(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>','','g')"


def _decoded(x):
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x},'&{name};','{char}')"
    return x


def _plain(x):
    return f"trim(regexp_replace({_decoded(f'regexp_replace({x},$$<[^>]*>$$,$$$$,$$g$$)')},'\\s+',' ','g'))"


_TEXT = (f"trim(regexp_replace(regexp_replace({_decoded('''regexp_replace(regexp_replace(regexp_replace(v,'(?s)^.*?<body>',''),'</?(?:nav|ul|li|div|article|h1|p|footer|br)>',chr(10),'g'),'<[^>]*>','','g')''')}"
         ",'\\s*\\n\\s*',chr(10),'g'),'[ \\t]+',' ','g'),' '||chr(10))")
_MARK = "regexp_replace({0},'([.!?…])\\s+([^\\p{{Ll}}\\s])','\\1'||chr(10)||'\\2','g')"
_SENT = ("list_filter(list_transform(string_split(" + _MARK.format(_MARK.format("text")) +
         ",chr(10)), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))), lambda x: x<>'')")
_FORM = "trim(regexp_replace(replace(replace(lower(strip_accents(replace({0},'…','...'))),'ß','ss'),'’',''''),'[-\\s_‐-―]+',' ','g'))"
_SENTS = f"""s AS (SELECT doc_id, source site, lang, unnest(l) t, generate_subscripts(l,1)-1 AS item FROM (SELECT doc_id, source, lang, {_SENT} l FROM documents)),
 f AS (SELECT *, {_FORM.format('t')} k, {_FORM.format('t')} c FROM s),
 offs AS (SELECT doc_id, regexp_matches({_FORM.format('text')},'(^|[^\\p{{L}}\\p{{N}}])(the|der)($|[^\\p{{L}}\\p{{N}}])') o FROM documents),
 first AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY site, k ORDER BY doc_id, item)=1),
 kinds AS (SELECT site, doc_id, item, CASE WHEN regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])apache($|[^\\p{{L}}\\p{{N}}])') THEN 'self_made_label'
   WHEN o AND regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])copyright($|[^\\p{{L}}\\p{{N}}])') THEN 'offset_neutrality'
   WHEN CASE lang WHEN 'en' THEN regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])license($|[^\\p{{L}}\\p{{N}}])')
     WHEN 'fr' THEN regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])(license|ouement)($|[^\\p{{L}}\\p{{N}}])')
     WHEN 'de' THEN regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])(license($|[^\\p{{L}}\\p{{N}}])|verein)')
     ELSE regexp_matches(c,'(^|[^\\p{{L}}\\p{{N}}])(license|mente)($|[^\\p{{L}}\\p{{N}}])') END THEN 'candidate' END kind FROM first JOIN offs USING (doc_id))"""
_WORD = "regexp_matches(f,'(^|[^\\p{{L}}\\p{{N}}]){0}')"
_END = "($|[^\\p{L}\\p{N}])"

ORACLES = {
    "url_normalise": f"SELECT page_id, {_NORM} normalised, {_SITE} site FROM pages",
    "url_parts": f"""SELECT page_id, regexp_extract(url,'^[^?#]+',0) stored_url, {_SITE} hostname, trim(regexp_replace({_PATH},'[/.]+',' ','g')) words,
        true home, true product, true asset, strpos(url,'?')=0 AND strpos(url,'#')=0 AS "document",
        CASE WHEN {_SITE}='therti.example.org' THEN {_PATH}||regexp_extract(url,'\\?[^#]*',0) ELSE url END shown,
        CASE WHEN page_id%2=1 THEN url END safe, 'https://'||regexp_replace({_NORM},'^https?://','') AS "start" FROM pages""",
    "url_screen": f"""WITH p AS (SELECT page_id, page_id%14 k, {_HOST} h FROM pages)
        SELECT page_id, [NULL,'scheme','credentials','private_address','port','local_name','private_address','undotted_host','blank','local_name',
          'private_address','too_long','private_address',NULL][k+1] reason, CASE k WHEN 0 THEN 'https://'||h||'/a?b=1' WHEN 13 THEN 'https://'||h||':8443/' END url,
        CASE WHEN k IN (0,13) THEN h END hostname FROM p""",
    "address_ranges": """WITH p AS (SELECT o_orderkey, o_custkey, [10,100,127,169,172,192,198,8,224,0][o_orderkey%10+1] a,
          [0,64,127,128,254,16,31,32,168,18,19,20][o_custkey%12+1] b, o_orderkey%3 c FROM orders),
        q AS (SELECT *, a IN (0,10,127) OR (a=100 AND b BETWEEN 64 AND 127) OR (a=169 AND b=254) OR (a=172 AND b BETWEEN 16 AND 31)
          OR (a=192 AND ((b=0 AND c=0) OR b=168)) OR (a=198 AND b IN (18,19)) OR a>=224 r FROM p)
        SELECT o_orderkey, r v4_reserved, CASE WHEN o_orderkey%2=1 THEN r ELSE o_custkey%10 IN (0,1,2,3,4,5) END v6_reserved FROM q""",
    "match_form": f"SELECT doc_id, md5({_FORM.format('text')}) form, length(trim(regexp_replace(text,'\\s+',' ','g'))) collapsed FROM documents",
    "sentences": f"SELECT doc_id, len(l) n, md5(array_to_string(l,chr(10))) digest FROM (SELECT doc_id, {_SENT} l FROM documents)",
    "excerpts": """WITH c AS (SELECT doc_id, text, trim(regexp_replace(text,'\\s+',' ','g')) t FROM documents),
        e AS (SELECT *, substr(t,1,200) h, 200-strpos(reverse(substr(t,1,200)),' ') sp FROM c)
        SELECT doc_id, CASE WHEN length(t)<=200 THEN t WHEN strpos(h,' ')>0 AND sp>100 THEN rtrim(substr(h,1,sp))||'…' ELSE rtrim(h)||'…' END quote,
        md5(replace(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#39;')) escaped FROM e""",
    "term_match": f"""WITH d AS (SELECT lang, {_FORM.format('text')} f FROM documents),
        m AS (SELECT lang, CASE WHEN {_WORD.format('the'+_END)} THEN 'the' WHEN {_WORD.format('les'+_END)} THEN 'les' WHEN {_WORD.format('der'+_END)} THEN 'der'
          WHEN {_WORD.format('license'+_END)} THEN 'license' WHEN {_WORD.format('of the'+_END)} THEN 'of the' WHEN {_WORD.format('est')} THEN 'est*'
          WHEN {_WORD.format('con'+_END)} THEN 'con' END first FROM d) SELECT lang, first, count(*) n, count(first) hits FROM m GROUP BY 1,2""",
    "first_email": f"""WITH l AS (SELECT doc_id, list_filter({_SENT}, lambda x: regexp_matches(x,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')
          OR regexp_matches(x,'(?i)[A-Za-z0-9._%+-]+\\s*[\\[(]\\s*at\\s*[\\])]\\s*[A-Za-z0-9-]+(?:\\s*(?:\\.|[\\[(]\\s*dot\\s*[\\])])\\s*[A-Za-z0-9-]+)+')) m FROM documents),
        e AS (SELECT doc_id, m[1] t, substr(m[1],1,200) h, 200-strpos(reverse(substr(m[1],1,200)),' ') sp FROM l WHERE len(m)>0)
        SELECT doc_id, CASE WHEN length(t)<=200 THEN t WHEN strpos(h,' ')>0 AND sp>100 THEN rtrim(substr(h,1,sp))||'…' ELSE rtrim(h)||'…' END email FROM e""",
    "stated_periods": """WITH p AS (SELECT o_orderkey, o_orderkey%1500 a, [14,14,30,1,2][o_custkey%5+1] b, o_orderkey%6 u FROM orders),
        q AS (SELECT *, CASE WHEN a BETWEEN 1 AND 999 THEN a||'' END p1, CASE WHEN u<3 THEN b||'' WHEN u<5 THEN (b*30)||'' END p2 FROM p)
        SELECT o_orderkey, coalesce(p1||','||p2, p1, p2, '') "days" FROM q""",
    "registrations": """SELECT s_suppkey, CASE s_suppkey%6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN s_suppkey+100>=10000
        WHEN 3 THEN s_suppkey>=10000 WHEN 4 THEN false ELSE true END registered,
        CASE s_suppkey%3 WHEN 0 THEN 'Lindenstraße '||s_suppkey||' 10115 Berlin' WHEN 1 THEN 'Lindenstraße '||s_suppkey||', 1010 Wien' END address FROM supplier""",
    "labels": """WITH r AS (SELECT *, regexp_replace(lower('ete '||p_name||' -- '||repeat(p_name,3)),'[^a-z0-9]+','-','g') s FROM part)
        SELECT p_partkey, regexp_replace(substr(regexp_replace(s,'^-+|-+$','','g'),1,40),'-+$','') slug, (p_size%3)||CASE WHEN p_size%3=1 THEN ' page' ELSE ' pages' END pages,
        lower(substr(p_name,1,1))||substr(upper(p_name),2) AS name, ['de','en',NULL,'fr',NULL][p_size%5+1] "language" FROM r""",
    "references": "SELECT p_partkey, '&® ✓≠ &lt; © 2 €'||p_partkey||' '||chr(CAST(p_partkey%26+65 AS INTEGER))||' € &bogus; é'||p_partkey decoded FROM part",
    "typed_pages": f"""SELECT page_id, site, row_number() OVER (PARTITION BY site ORDER BY page_id)-1 AS "position", CASE WHEN page_id%3=0 THEN 404 ELSE 200 END status_code
        FROM (SELECT page_id, {_SITE} site FROM pages WHERE page_id%8 IN (0,1,2,4,5,6))""",
    "url_kinds": """SELECT page_id, page_id%10 IN (0,1,3,5,7,9) asset, page_id%10 IN (0,3,7,9) AS "document", page_id%11 IN (0,1,2) home, page_id%11 IN (4,6,10) product FROM pages""",
    "vat_numbers": f"SELECT p_partkey, p_partkey%{2 * len(VAT_EXAMPLES)}%2=0 found FROM part",
    "script_vendors": (lambda names: f"""WITH v AS (SELECT p_partkey, {names}[p_partkey%{len(names)}+1] n FROM part)
        SELECT p_partkey, CASE WHEN n LIKE 'chat %' THEN n[6:] END chat, CASE WHEN n LIKE 'site %' THEN n[6:] END consent FROM v""")(
        [f"{kind} {name}" for kind, vendors in (("chat", rules.CHAT_VENDORS), ("site", rules.CONSENT_VENDORS)) for name, signs in vendors.items() for _ in signs] + ["", ""]),
    "nested_buttons": """WITH h AS (SELECT p_partkey k, regexp_extract_all('<html><body><div>before</div><div class="b" role="button">A'||repeat('<div>n', p_partkey%4)||'x'||
          repeat('</div>', p_partkey%4)||'<div role="button">in'||p_partkey||'<div></div></div> end</div><div>between</div><span role=button>S<span>t</span></span><ul><li role="button">L'||
          '<ul><li>inner</li></ul> tail</li></ul><template><div role="button">no</div><template><i>x</i></template><button>no</button></template><button>B</button>'||
          '<img role="button" title="pic"><div>after</div></body></html>', '<[^>]*>|[^<]+') toks FROM part),
        t AS (SELECT k, unnest(range(1, len(toks)+1)) n, toks FROM h), u AS (SELECT k, n, toks[n] tok FROM t),
        e AS (SELECT *, sum(CASE WHEN tok LIKE '</%' THEN -1 WHEN tok LIKE '<%' AND tok NOT LIKE '<img%' THEN 1 ELSE 0 END) OVER w AS level,
          sum(CASE tok WHEN '<template>' THEN 1 WHEN '</template>' THEN -1 ELSE 0 END) OVER w inert FROM u WINDOW w AS (PARTITION BY k ORDER BY n)),
        s AS (SELECT *, (SELECT min(c.n) FROM e c WHERE c.k=e.k AND c.n>e.n AND c.tok LIKE '</%' AND c.level=e.level-1) upto FROM e
          WHERE inert=0 AND (tok LIKE '%role=%button%' OR tok='<button>')),
        b AS (SELECT s.k, s.n, CASE WHEN any_value(s.tok) LIKE '<img%' THEN 'pic' ELSE string_agg(x.tok, '' ORDER BY x.n) FILTER (x.tok NOT LIKE '<%' AND x.n<s.upto) END named
          FROM s JOIN e x ON x.k=s.k AND x.n>s.n GROUP BY s.k, s.n)
        SELECT k page_id, string_agg(named, '|' ORDER BY n) buttons FROM b GROUP BY k""",
    "json_ld": "SELECT p_partkey, p_partkey%10 IN (0,1,3,5,6,9) product FROM part",
    "client_addresses": """SELECT event_id, CASE WHEN event_id%3=0 THEN '1.2.3.'||user_id WHEN event_id%2=0 THEN '4.4.4.'||user_id ELSE 'unknown' END address FROM events""",
    "dates": """WITH o AS (SELECT *, o_orderdate + to_hours(CAST(o_orderkey%24 AS INTEGER)) t FROM orders)
        SELECT o_orderkey, strftime(date_trunc('month',t),'%Y-%m-%d') "month", strftime(date_trunc('month',t)+INTERVAL 1 MONTH,'%Y-%m-%d') next_month,
        strftime(date_trunc('day',t)+INTERVAL 1 DAY,'%Y-%m-%d') midnight, CASE WHEN t<TIMESTAMP '1998-06-19' THEN 'applies from 19 June 1998'
        ELSE 'has applied since 19 June 1998' END phrase, strftime(t + to_hours([0,3,-5,0][o_custkey%4+1]),'%-d %b %Y') local_date FROM o""",
    "page_titles": f"""SELECT page_id, {_plain("regexp_extract(html,'(?s)<title>(.*?)</title>',1)")} title, regexp_extract(html,'<html lang="([^"]*)"',1) lang,
        false js_shell, 'other' kind FROM pages""",
    "page_headings": f"""SELECT page_id, i-1 AS item, h[i][3]::BIGINT AS "level", {_plain("regexp_replace(h[i],'^<h.>','')")} AS "text"
        FROM (SELECT page_id, h, unnest(range(1,len(h)+1)) i FROM (SELECT page_id, regexp_extract_all({_VISIBLE},'(?s)<h[1-6]>.*?</h[1-6]>') h FROM pages))""",
    "page_links": f"""WITH l AS (SELECT page_id, url, regexp_extract_all({_VISIBLE},'(?s)<a href=.*?</a>') a FROM pages),
        e AS (SELECT page_id, url, unnest(range(1,len(a)+1)) i, a FROM l), h AS (SELECT *, {_decoded("regexp_extract(a[i],'href=\"([^\"]*)\"',1)")} href FROM e)
        SELECT page_id, i-1 AS item, {_plain("a[i]")} AS "text", href, regexp_extract(url,'^https?://[^/]+',0)||array_to_string(list_transform(string_split(href,''),
          lambda c: CASE WHEN c=' ' THEN '%20' WHEN ord(c)>126 OR c IN ('"','<','>','`','{{','}}') THEN url_encode(c) ELSE c END),'') "abs" FROM h""",
    "page_text": f"SELECT page_id, md5(t) digest, length(t) size FROM (SELECT page_id, {_TEXT} t FROM (SELECT page_id, {_VISIBLE} v FROM pages))",
    "page_rows": f"""SELECT page_id, site, row_number() OVER (PARTITION BY site ORDER BY page_id)-1 AS "position", 200 status_code, md5(substr(t,1,1000)) excerpt
        FROM (SELECT page_id, {_SITE} site, {_TEXT} t FROM (SELECT page_id, url, {_VISIBLE} v FROM pages))""",
    "a11y_counts": f"""WITH p AS (SELECT {_SITE} site, html, {_VISIBLE} v FROM pages)
        SELECT site, count(*) pages, CAST(sum((NOT regexp_matches(html,'<html lang="[^"]+'))::INT) AS BIGINT) missing_lang, CAST(sum((len(regexp_extract_all(v,'<h1>'))<>1)::INT) AS BIGINT) heading_issues,
        CAST(sum(len(list_filter(regexp_extract_all(v,'<img[^>]*>'), lambda x: NOT regexp_matches(x,'\\salt=')))) AS BIGINT) missing_alt,
        CAST(sum(len(regexp_extract_all(v,'<(?:input|select|textarea)'))) AS BIGINT) unlabelled_inputs,
        CAST(sum(len(list_filter(regexp_extract_all(v,'(?s)<a href=.*?</a>'), lambda x: trim(regexp_replace(x,'<[^>]*>','','g'))=''))) AS BIGINT) empty_links FROM p GROUP BY 1""",
    "site_locales": f"""WITH c AS (SELECT {_SITE} site, regexp_extract(html,'<html lang="([a-z]+)"',1) l, count(*) n, min(page_id) m FROM pages GROUP BY 1,2)
        SELECT site, string_agg(l, ',' ORDER BY n DESC, m) ranked FROM c GROUP BY 1""",
    "green_candidates": f"WITH {_SENTS} SELECT site, kind, doc_id, item FROM kinds WHERE kind IS NOT NULL",
    "green_reviewed": f"""WITH {_SENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY doc_id, item)-1 AS idx FROM kinds WHERE kind='candidate')
        SELECT site, idx, doc_id, CASE idx%4 WHEN 0 THEN 'generic_unsubstantiated' WHEN 1 THEN 'specific_substantiated' ELSE 'not_environmental' END verdict FROM n WHERE idx<40""",
    "fingerprints": history_queries.TABLES + "SELECT DISTINCT scan_id, code, fingerprint FROM findings",
    "page_link_targets": f"""WITH l AS (SELECT {_SITE} site, unnest(regexp_extract_all({_VISIBLE},'(?s)<a href=.*?</a>')) a FROM pages)
        SELECT site, NULL::VARCHAR kind, count(*) n FROM l GROUP BY 1""",
}
