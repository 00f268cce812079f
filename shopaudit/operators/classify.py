"""What a link or a page is: legal category, account, checkout, cart or product."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import has_term, match_form
from ..session import built_once, derive, let
from ..vocab import crawl as vocab


def _legal(form: Column, tables: dict[str, list[str]]) -> Column:
    """First legal category whose table matches, in the fixed order."""
    return F.coalesce(*[F.when(has_term(form, tables[c]), F.lit(c)) for c in vocab.LEGAL_CATEGORIES])


def link_target(text: Column, url: Column) -> Column:
    """``struct<kind,category>`` of a link. Its text decides before its path; NULL kind when nothing fits."""
    every = lambda legal, *others: [t for ts in [*legal.values(), *others] for t in ts]
    texts = every(vocab.LEGAL_TEXT, vocab.ACCOUNT_TEXT, vocab.CHECKOUT_TEXT, vocab.CART_TEXT)
    slugs = every(vocab.LEGAL_SLUGS, vocab.ACCOUNT_SLUGS, vocab.CHECKOUT_SLUGS, vocab.CART_SLUGS)

    def decide(x: Column) -> Column:
        # Most links hold no term of any kind, so one test for all of them comes first.
        by_text = F.when(has_term(x["t"], texts), let(_legal(x["t"], vocab.LEGAL_TEXT), lambda c: F.struct(
            F.when(c.isNotNull(), "legal")
            .when(has_term(x["t"], vocab.ACCOUNT_TEXT), "account")
            .when(has_term(x["t"], vocab.CHECKOUT_TEXT), "checkout")
            .when(has_term(x["t"], vocab.CART_TEXT), "cart").alias("kind"), c.alias("category"))))
        by_path = F.when(has_term(x["p"], slugs), let(_legal(x["p"], vocab.LEGAL_SLUGS), lambda c: F.struct(
            F.when(has_term(x["p"], vocab.ACCOUNT_SLUGS), "account")
            .when(has_term(x["p"], vocab.CHECKOUT_SLUGS), "checkout")
            .when(has_term(x["p"], vocab.CART_SLUGS), "cart")
            .when(c.isNotNull(), "legal").alias("kind"), c.alias("category"))))
        product = F.struct(F.when(urls.is_product_path(urls.path_of(url)), "product").alias("kind"), F.lit(None).cast("string").alias("category"))
        found = F.coalesce(by_text, F.when(x["p"] != "", F.coalesce(by_path, product)))
        return let(found, lambda f: F.struct(f["kind"].alias("kind"), F.when(f["kind"] == "legal", f["category"]).alias("category")))
    return let(F.struct(match_form(text).alias("t"), match_form(urls.path_words(url)).alias("p")), decide)


@built_once
def target_of(text: str, url: str) -> Column:
    return link_target(F.col(text), F.col(url))


def legal_categories(url: Column, title: Column, headings: Column) -> Column:
    """Legal categories of a page by its path, title or h1, in the fixed order."""
    titles = F.filter(F.concat(F.array(title), F.filter(headings, lambda h: h["level"] == 1)["text"]), lambda t: t != "")

    every = lambda tables: [t for c in vocab.LEGAL_CATEGORIES for t in tables[c]]

    def decide(x: Column) -> Column:
        # Most pages hold no term of any category, so one test for all of them comes first.
        return F.when(has_term(x["p"], every(vocab.LEGAL_SLUGS)) | has_term(x["t"], every(vocab.LEGAL_TEXT)), F.array_compact(F.array(*[
            F.when(has_term(x["p"], vocab.LEGAL_SLUGS[c]) | has_term(x["t"], vocab.LEGAL_TEXT[c]), F.lit(c))
            for c in vocab.LEGAL_CATEGORIES]))).otherwise(F.array().cast("array<string>"))
    return let(F.struct(match_form(urls.path_words(url)).alias("p"),
                        match_form(F.array_join(titles, "\n"), keep_lines=True).alias("t")), decide)


def linked_categories(documents: DataFrame) -> DataFrame:
    """(site, url, categories): what the links of a site call each page. At most six categories per address."""
    links = documents.select("site", F.explode("links").alias("link")).select("site", "link.text", "link.abs").distinct()
    legal = derive(links, target=target_of("text", "abs")).filter(F.col("target.kind") == "legal")
    target = (derive(legal, target_url=urls.normalise(F.col("abs")))
              .select("site", "target_url", "target.category").filter(F.col("target_url").isNotNull()))
    return target.groupBy("site", "target_url").agg(F.collect_set("category").alias("linked"))


# Most pages are found where they were asked for; then one address is read instead of two.
@built_once
def _own_categories() -> Column:
    of = lambda url: legal_categories(F.col(url), F.col("title"), F.col("headings"))
    return F.when(F.col("url") == F.col("final_url"), of("url")).otherwise(F.array_distinct(F.concat(of("url"), of("final_url"))))


@built_once
def _page_addresses() -> Column:
    of = lambda url: F.coalesce(urls.normalise(F.col(url)), F.col(url))
    return F.when(F.col("url") == F.col("final_url"), F.array(of("url"))).otherwise(F.array_distinct(F.array(of("url"), of("final_url"))))


def page_categories(documents: DataFrame) -> DataFrame:
    """(site, page_id, categories): a page's own legal signals and those of links that point at it.

    Only keys, titles and headings take part in the join; page text stays where it is.
    """
    # Two narrow reads: each side of the join computes its own column and not the other's.
    own = derive(documents.select("site", "page_id", "url", "final_url", "title", "headings"), own=_own_categories()).select("site", "page_id", "own")
    known = derive(documents.select("site", "page_id", "url", "final_url"), addresses=_page_addresses())
    named = (known.select("site", "page_id", F.explode("addresses").alias("target_url"))
             .join(linked_categories(documents), ["site", "target_url"])
             .groupBy("site", "page_id").agg(F.array_distinct(F.flatten(F.collect_list("linked"))).alias("linked")))
    order = F.array(*[F.lit(c) for c in vocab.LEGAL_CATEGORIES])
    both = F.concat("own", F.coalesce("linked", F.array().cast("array<string>")))
    return own.join(named, ["site", "page_id"], "left").select(
        "site", "page_id", F.filter(order, lambda c: F.array_contains(both, c)).alias("categories"))
