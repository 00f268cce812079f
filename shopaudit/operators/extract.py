"""Web pages to structured documents: one narrow job of built-in expressions, no shuffle.

Markup is read by patterns with possessive quantifiers, so long tags neither overflow the stack nor backtrack. Parts
that never show (comments, script, style, noscript, svg, template) are cut out before anything else is read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text, urls
from ..functions.text import SPACE, collapse, decode_references, has_term, match_form, trim_all
from ..session import built_once, let
from ..vocab import crawl as vocab

# Limits of the extraction.
SHELL_TEXT = 200
SHELL_SCRIPTS = 5

ATTRIBUTES = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
HIDDEN = "script|style|noscript|svg|template"
OPAQUE = (rf"(?is)<!--.*?(?:-->|\z)|<({HIDDEN})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*+>|\z)")
# Elements that start and end a line of text.
BLOCKS = """address article aside blockquote button dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr label legend li main nav ol option p pre section summary table td th tr ul""".split()
# Script types that run; ids and the attribute of containers that scripts fill.
SCRIPT_TYPES = ["", "text/javascript", "application/javascript", "module", "text/ecmascript", "application/ecmascript"]
ROOT_IDS = ["root", "app", "__next", "__nuxt", "svelte"]
SKIPPED_INPUTS = ["hidden", "submit", "button", "reset", "image"]
INLINE_URL = r"""https?://[^\s"'`<>()\\]+"""

FORMS = "array<struct<action:string,inputs:array<struct<type:string,name:string,id:string,labelled:boolean>>>>"
IMAGES = "array<struct<alt:string,src:string>>"


def _open(names: str) -> str:
    return rf"<(?:{names})(?=[\s/>]){ATTRIBUTES}>"


def _element(name: str) -> str:
    """An element up to its closing tag, the next one of its kind, or the end."""
    return rf"{_open(name)}.*?(?:</{name}\s*+>|(?=<{name}[\s/>])|\z)"


def tag_of(element: Column) -> Column:
    return F.regexp_extract(element, rf"(?is)^<[a-z][^\s/>]*+{ATTRIBUTES}>", 0)


def inner_of(element: Column) -> Column:
    return F.regexp_replace(element, rf"(?is)^<[a-z][^\s/>]*+{ATTRIBUTES}>|</[a-z][a-z0-9]*\s*+>\z", "")


_ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""


def attributes(tag: Column) -> Column:
    """Names and decoded, trimmed values of a tag's attributes, in order: ``struct<names,values>``."""
    body = F.regexp_replace(tag, r"(?is)^<[a-z][^\s/>]*+|/?>\z", "")
    items = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))
    bare = lambda i: F.regexp_replace(i, r"""(?s)^[^=\s]*+\s*+=?\s*+(?:"(.*)"|'(.*)'|(.*))\z""", "$1$2$3")
    return let(items, lambda xs: F.struct(
        F.transform(xs, lambda i: F.lower(F.regexp_extract(i, r"^[^=\s]+", 0))).alias("names"),
        F.transform(xs, lambda i: trim_all(decode_references(bare(i), attribute=True))).alias("values")))


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name of a parsed tag; NULL when the attribute is missing."""
    return F.get(tag["values"], (F.array_position(tag["names"], name) - 1).cast("int"))


def value(tag: Column, name: str) -> Column:
    return F.coalesce(attribute(tag, name), F.lit(""))


def visible_text(html: Column) -> Column:
    bare = lambda h: F.when(F.contains(h, F.lit("<")), F.regexp_replace(
        h, rf"(?is){_open('/?[a-z][a-z0-9:-]*+')}|</[a-z][^>]*+>", "")).otherwise(h)
    return collapse(decode_references(let(html, bare)))


def accessible_name(e: Column) -> Column:
    """aria-label, else visible text, else the alt texts of images, else value, else title of ``struct<tag,inner>``."""
    tag, inner = e["tag"], e["inner"]
    alts = F.array_join(F.filter(F.transform(F.regexp_extract_all(inner, F.lit(f"(?is){_open('img')}"), F.lit(0)),
                                             lambda i: value(attributes(i), "alt")), lambda a: a != ""), " ")
    some = lambda c: let(c, lambda x: F.when(x != "", x))
    return F.coalesce(some(value(tag, "aria-label")), some(visible_text(inner)), some(alts),
                      some(value(tag, "value")), value(tag, "title"))


def elements(found: Column) -> Column:
    """Elements as ``struct<tag,inner,name>``: parsed attributes, content and the element's name."""
    return F.transform(found, lambda e: F.struct(
        attributes(tag_of(e)).alias("tag"), inner_of(e).alias("inner"),
        F.lower(F.regexp_extract(e, "^<([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name")))


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)" + pattern), F.lit(0))


_INNER_TEMPLATE = (rf"<template(?=[\s/>]){ATTRIBUTES}>[^<]*+(?:<(?!/?template[\s/>])[^<]*+)*+</template\s*+>")
_TEMPLATES = r"(?is)<template[\s/>].*<template[\s/>]"


def without_nested_templates(html: Column) -> Column:
    """Markup without templates, also those in other templates; comments, scripts and styles outside of them stay.

    Each pass takes out the templates that hold no other. Pages with one template at most are left to ``without_opaque``.
    """
    kept = r"(<!--.*?(?:-->|\z)|<(?:script|style|noscript|svg)(?=[\s/>])" + ATTRIBUTES + r">.*?(?:</(?:script|style|noscript|svg)\s*+>|\z))"
    passes = F.regexp_count(html, F.lit(r"(?i)<template[\s/>]"))
    cut = F.aggregate(F.sequence(F.lit(1), F.greatest(passes, F.lit(1))), html, lambda h, _: F.when(
        h.rlike(r"(?i)<template[\s/>]"), F.regexp_replace(h, f"(?is){kept}|{_INNER_TEMPLATE}", "$1")).otherwise(h))
    return F.when(html.rlike(_TEMPLATES), cut).otherwise(html)


def opaque_parts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(OPAQUE), F.lit(0))


def without_opaque(html: Column) -> Column:
    return F.regexp_replace(html, OPAQUE, "")


def title_of(markup: Column) -> Column:
    return collapse(decode_references(F.regexp_extract(markup, rf"(?is){_open('title')}(.*?)(?:</title\s*>|\z)", 1)))


def language_of(markup: Column) -> Column:
    return F.nullif(value(attributes(F.regexp_extract(markup, f"(?is){_open('html')}", 0)), "lang"), F.lit(""))


def headings_of(markup: Column) -> Column:
    found = _all(markup, rf"<h([1-6])(?=[\s/>]){ATTRIBUTES}>.*?(?:</h[1-6]\s*+>|(?=<h[1-6][\s/>])|\z)")
    return F.transform(found, lambda e: F.struct(
        F.substring(e, 3, 1).cast("int").alias("level"), visible_text(inner_of(e)).alias("text")))


def links_of(markup: Column, base: Column) -> Column:
    """``a[href]`` and ``area[href]`` in order: accessible name, href as written, absolute address."""
    found = F.filter(elements(_all(markup, rf"{_open('area')}|{_element('a')}")), lambda e: attribute(e["tag"], "href").isNotNull())
    named = F.transform(found, lambda e: F.struct(
        accessible_name(e).alias("text"), value(e["tag"], "href").alias("href")))
    return F.transform(named, lambda n: F.struct(n["text"], n["href"], urls.resolve(n["href"], base).alias("abs")))


# Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Signs of the private area stand for the height of an element, from the innermost one up.
_HEIGHTS = "".join(chr(0xE000 + i) for i in range(512))
_ROLE = r"""(?=(?:(?!\srole\s*=)(?:[^"'>]|"[^"]*+"|'[^']*+'))*+\srole\s*=\s*["']?button["'\s/>])"""


def by_height(markup: Column, name: Column) -> Column:
    """Markup in which every element ``name`` that is closed carries its height behind its name in both tags.

    The height is one more than that of the highest element of that name inside it, so an element ends at the next closing
    tag with its own sign. Tags are read as a row of brackets; each pass pairs off the brackets with nothing open between
    them, which takes as many passes as elements lie in each other.
    """
    head = F.concat(F.lit("(?i)</?"), name, F.lit(rf"(?=[\s/>]){ATTRIBUTES}>"))

    def build(parts: Column) -> Column:
        brackets = F.array_join(F.transform(parts["tags"], lambda t: F.when(t.startswith("</"), ")").otherwise("(")), "")
        pair = lambda seen, n: F.when(~seen.contains("("), seen).otherwise(F.regexp_replace(
            seen, F.lit(r"\(([^()]*+)\)"), F.concat(F.substring(F.lit(_HEIGHTS), n, F.lit(1)), F.lit("$1"), F.substring(F.lit(_HEIGHTS), n, F.lit(1)))))
        depth = F.least(F.greatest(F.size(parts["tags"]), F.lit(1)), F.lit(len(_HEIGHTS)))
        signs = F.split(F.aggregate(F.sequence(F.lit(1), depth), brackets, pair), "")

        def marked(sign: Column, tag: Column) -> Column:
            return F.when(sign.isin("(", ")"), tag).otherwise(F.concat(
                F.regexp_extract(tag, "^</?[a-zA-Z][a-zA-Z0-9-]*", 0), sign, F.regexp_replace(tag, "^</?[a-zA-Z][a-zA-Z0-9-]*", "")))
        tags = let(signs, lambda s: F.transform(parts["tags"], lambda t, i: marked(F.get(s, i), t)))
        return F.concat(F.get(parts["texts"], 0), F.array_join(
            F.zip_with(tags, F.slice(parts["texts"], F.lit(2), F.greatest(F.size(parts["texts"]) - 1, F.lit(0))), lambda t, x: F.concat(t, x)), ""))
    return let(F.struct(F.regexp_extract_all(markup, head, F.lit(0)).alias("tags"), F.split(markup, head).alias("texts")), build)


# Without either, only buttons and inputs can be found, and no element needs its height.
_ROLE_HINT = r"(?i)\srole\s*=|[\uE000-\uE1FF]"


def buttons_of(markup: Column) -> Column:
    """Names of buttons, in the order they start; elements with the role of a button may hold others of their own kind."""
    plain_names = "|".join(["button", *VOID])
    named = F.array_distinct(F.transform(
        F.regexp_extract_all(markup, F.lit(rf"(?i)<(?!(?:{plain_names})[\s/>])([a-z][a-z0-9-]*+)(?=[\s/]){_ROLE}"), F.lit(1)), F.lower))
    marked = F.aggregate(named, markup, by_height)
    role = rf"<(?!(?:{plain_names})[\s/>])([a-z][a-z0-9-]*+[\uE000-\uE1FF]?+)(?=[\s/]){_ROLE}"
    kinds = rf"{_element('button')}|{_open('input')}|<(?:{'|'.join(VOID)})(?=[\s/]){_ROLE}{ATTRIBUTES}>|{role}{ATTRIBUTES}>.*?(?:</\2\s*+>|\z)"
    # Every start is looked at, also inside an element found before.
    found = F.regexp_extract_all(marked, F.lit(rf"(?is)(?=({kinds}))<"), F.lit(1))
    bare = F.transform(found, lambda e: F.regexp_replace(e, r"(</?[a-zA-Z][a-zA-Z0-9-]*+)[\uE000-\uE1FF]", "$1"))
    native = F.regexp_extract_all(markup, F.lit(rf"(?is)(?=({_element('button')}|{_open('input')}))<"), F.lit(1))
    plain = F.filter(elements(F.when(markup.rlike(_ROLE_HINT), bare).otherwise(native)), lambda e: (e["name"] != "input")
                     | F.lower(value(e["tag"], "type")).isin("submit", "button", "reset")
                     | (value(e["tag"], "role") == "button"))
    return F.filter(F.transform(plain, accessible_name), lambda n: n != "")


FIELD = _open("input|select|textarea")
LABEL = _element("label")
FORM = rf"{_open('form')}.*?(?:</form\s*+>|\z)"


def _fields(html: Column, label_targets: Column) -> Column:
    """Form fields in order with the test whether a label, aria attribute or title names them."""
    groups = _all(html, rf"{LABEL}|{FIELD}")
    tags = F.flatten(F.transform(groups, lambda g: F.transform(
        _all(g, FIELD), lambda t: F.struct(t.alias("open"), attributes(t).alias("tag"), g.rlike(r"(?i)^<label").alias("inside")))))

    def describe(item: Column) -> Column:
        tag = item["tag"]
        kind = F.lower(F.regexp_extract(item["open"], "(?i)^<([a-z]+)", 1))
        fid = value(tag, "id")
        own = (value(tag, "aria-label") != "") | (value(tag, "aria-labelledby") != "") | (value(tag, "title") != "")
        return F.struct(
            F.when(kind == "input", F.coalesce(F.nullif(F.lower(value(tag, "type")), F.lit("")), F.lit("text")))
            .otherwise(kind).alias("type"),
            value(tag, "name").alias("name"), fid.alias("id"),
            (own | item["inside"] | ((fid != "") & F.array_contains(label_targets, fid))).alias("labelled"))
    return F.filter(F.transform(tags, describe), lambda f: ~f["type"].isin(*SKIPPED_INPUTS))


def forms_of(markup: Column, base: Column) -> Column:
    """Forms with their fields; fields outside any form follow as one more form without action."""
    def build(targets: Column) -> Column:
        forms = F.transform(_all(markup, FORM), lambda f: F.struct(
            let(value(attributes(tag_of(f)), "action"), lambda a: F.when(a == "", a).otherwise(urls.resolve(a, base))).alias("action"),
            _fields(f, targets).alias("inputs")))
        stray = _fields(F.regexp_replace(markup, f"(?is){FORM}", " "), targets)
        rest = let(stray, lambda s: F.filter(F.array(F.struct(F.lit("").alias("action"), s.alias("inputs"))),
                                             lambda f: F.size(f["inputs"]) > 0))
        return F.concat(forms, rest)
    forms = let(F.transform(_all(markup, _open("label")), lambda t: value(attributes(t), "for")), build)
    # Most pages have no fields at all.
    return F.when(markup.rlike("(?i)<(?:form|input|select|textarea)"), forms).otherwise(F.array().cast(FORMS))


def script_parts(opaque: Column) -> Column:
    """Script elements as ``struct<type,src,code>``."""
    scripts = F.filter(opaque, lambda p: p.rlike(r"(?i)^<script[\s/>]"))
    return F.transform(elements(scripts), lambda s: F.struct(
        F.lower(value(s["tag"], "type")).alias("type"), value(s["tag"], "src").alias("src"), s["inner"].alias("code")))


def script_urls(scripts: Column, base: Column) -> Column:
    """Addresses of running scripts, and addresses that inline scripts load from, distinct."""
    running = F.filter(scripts, lambda s: s["type"].isin(*SCRIPT_TYPES))
    found = F.flatten(F.transform(running, lambda s: F.when(s["src"] != "", F.array(urls.resolve(s["src"], base)))
                                  .otherwise(F.transform(F.regexp_extract_all(s["code"], F.lit(INLINE_URL), F.lit(0)),
                                                         lambda u: F.regexp_replace(u, "[;,.]+$", "")))))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def images_of(markup: Column, base: Column) -> Column:
    """Images: alt is NULL when the attribute is missing and "" when it is empty."""
    def describe(tag: Column) -> Column:
        source = F.coalesce(F.nullif(value(tag, "src"), F.lit("")), value(tag, "data-src"))
        absolute = lambda s: F.when(s == "", s).otherwise(
            F.coalesce(F.nullif(urls.resolve(s, base), F.lit("")), s))
        return F.struct(attribute(tag, "alt").alias("alt"), let(source, absolute).alias("src"))
    images = F.transform(F.transform(_all(markup, _open("img")), attributes), describe)
    return F.when(markup.rlike("(?i)<img"), images).otherwise(F.array().cast(IMAGES))


def meta_of(markup: Column) -> Column:
    """Meta names to contents, the first of each name."""
    def describe(tag: Column) -> Column:
        some = lambda n: F.nullif(value(tag, n), F.lit(""))
        key = F.lower(F.coalesce(some("name"), some("property"), some("http-equiv")))
        return F.struct(key.alias("key"), attribute(tag, "content").alias("value"))
    entries = F.filter(F.transform(F.transform(_all(markup, _open("meta")), attributes), describe),
                       lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return let(entries, lambda es: F.map_from_entries(F.filter(
        es, lambda e, i: F.array_position(es["key"], e["key"]) == i + 1)))


def text_of(markup: Column) -> Column:
    """Visible text: one line per block, single spaces, uncut."""
    body = F.regexp_replace(markup, rf"(?is)^.*?{_open('body')}|</body\s*>.*\z", "")
    body = F.when(markup.rlike(r"(?i)<body[\s>]"), body).otherwise(
        F.regexp_replace(markup, rf"(?is)<head(?=[\s>]){ATTRIBUTES}>.*?</head\s*>|{_open('title')}.*?</title\s*>|<!doctype[^>]*+>",
                         ""))
    blocks = "|".join(BLOCKS)
    lined = F.regexp_replace(body, rf"(?is)</?(?:{blocks}|br)(?=[\s/>]){ATTRIBUTES}>", "\n")
    plain = decode_references(F.regexp_replace(lined, rf"(?is)</?[a-z]{ATTRIBUTES}>|<![^>]*+>", ""))
    lines = F.regexp_replace(plain, rf"{text.SPACES}*\n{text.SPACES}*", "\n")
    return trim_all(F.regexp_replace(lines, f"{text.BLANKS}+", " "))


def is_shell(markup: Column, page_text: Column, scripts: Column) -> Column:
    """The page looks filled by scripts: an empty root container, or hardly any text but many scripts."""
    ids = "|".join(ROOT_IDS)
    empty = markup.rlike(rf"""(?is)<([a-z][a-z0-9]*+)(?=[\s/])(?=[^>]*\s(?:id\s*=\s*["']?(?:{ids})["'\s>]|data-reactroot"""
                         rf"""[\s=>])){ATTRIBUTES}>[{SPACE}]*</\1\s*+>""")
    running = F.size(F.filter(scripts, lambda s: s["type"].isin(*SCRIPT_TYPES)))
    return empty | ((F.length(page_text) < SHELL_TEXT) & (running > SHELL_SCRIPTS))


def page_kind(path: Column, url: Column, title: Column, headings: Column, buttons: Column, meta: Column,
              scripts: Column) -> Column:
    """Kind of a page; the first signal in this order decides."""
    titles = F.filter(F.concat(F.array(title), F.filter(headings, lambda h: h["level"] == 1)["text"]), lambda t: t != "")
    forms = match_form(F.array_join(titles, "\n"), keep_lines=True)
    path_form = match_form(urls.path_words(url))
    legal_slugs = [t for c in vocab.LEGAL_CATEGORIES for t in vocab.LEGAL_SLUGS[c]]
    legal_text = [t for c in vocab.LEGAL_CATEGORIES for t in vocab.LEGAL_TEXT[c]]
    product = (F.exists(scripts, lambda s: (s["type"] == "application/ld+json") & scalars.describes_product(s["code"]))
               | F.coalesce(F.lower(F.element_at(meta, "og:type")).startswith("product"), F.lit(False))
               | urls.is_product_path(path)
               | (F.size(F.filter(buttons, lambda b: has_term(match_form(b), vocab.ADD_TO_CART))) == 1))

    def decide(words: Column) -> Column:
        return (F.when(urls.is_home_path(path), "home")
                .when(has_term(words["p"], vocab.ACCOUNT_SLUGS), "account")
                .when(has_term(words["p"], vocab.CHECKOUT_SLUGS), "checkout")
                .when(has_term(words["p"], vocab.CART_SLUGS), "cart")
                .when(has_term(words["p"], legal_slugs), "legal")
                .when(product, "product")
                .when(has_term(words["t"], legal_text), "legal")
                .when(has_term(words["t"], vocab.CHECKOUT_HEADINGS), "checkout")
                .when(has_term(words["t"], vocab.CART_HEADINGS), "cart")
                .otherwise("other"))
    return let(F.struct(path_form.alias("p"), forms.alias("t")), decide)


@built_once
def _parse_columns() -> dict[str, Column]:
    return {"_where": urls.parse(F.col("final_url")), "_opaque": opaque_parts(F.col("_whole")), "_markup": without_opaque(F.col("_whole"))}


@built_once
def _whole_column() -> Column:
    return without_nested_templates(F.col("html"))


@built_once
def _base_column() -> Column:
    tag = F.regexp_extract("_markup", rf"(?is)<base(?=[\s])(?=[^>]*\shref\s*=){ATTRIBUTES}>", 0)
    resolved = urls.parse(urls.resolve(value(attributes(tag), "href"), F.col("_where")))
    return F.coalesce(F.when(tag != "", resolved), F.col("_where"))


@built_once
def _read_columns() -> dict[str, Column]:
    m, base = F.col("_markup"), F.col("_base")
    return {"title": title_of(m), "lang": language_of(m), "headings": headings_of(m), "links": links_of(m, base),
            "buttons": buttons_of(m), "forms": forms_of(m, base), "_scripts": script_parts(F.col("_opaque")),
            "images": images_of(m, base), "meta": meta_of(m), "text": text_of(m)}


@built_once
def _judged_columns() -> dict[str, Column]:
    c = F.col
    return {"scripts": script_urls(c("_scripts"), c("_base")), "js_shell": is_shell(c("_markup"), c("text"), c("_scripts")),
            "kind": page_kind(c("_where.path"), c("final_url"), c("title"), c("headings"), c("buttons"), c("meta"), c("_scripts"))}


def documents(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, site, position, url, final_url, status_code, html) to structured documents.

    Every step is a projection: the html column is read once per task and never shuffled, and columns nobody asks for
    are not computed.
    """
    parsed = pages.withColumn("_whole", _whole_column()).withColumns(_parse_columns())
    read = parsed.withColumn("_base", _base_column()).withColumns(_read_columns())
    return read.withColumns(_judged_columns()).select(
        "page_id", "site", "position", "url", "final_url", "status_code", "kind", "title", "lang", "headings", "links",
        "buttons", "forms", "scripts", "images", "meta", "text", "js_shell")
