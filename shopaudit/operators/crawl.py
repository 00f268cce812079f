"""Which pages of a site to fetch: slots by kind of link, robots rules before the budget, two rounds."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..session import built_once, derive, first_by, let, positions, stored
from ..vocab.crawl import LEGAL_CATEGORIES
from .classify import target_of

# Pages per site, and how many links of each kind are followed.
MAX_PAGES = 12
SLOTS = [*LEGAL_CATEGORIES, "account", "product", "cart", "checkout"]
CAPACITY = {slot: 4 if slot == "product" else 1 for slot in SLOTS}
TOTAL = sum(CAPACITY.values())


def _by_slot(slot: Column, values: dict[str, int]) -> Column:
    return reduce(lambda acc, kv: acc.when(slot == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0))


@built_once
def _parsed(column: str) -> Column:
    return urls.parse(F.col(column))


@built_once
def _address(column: str) -> Column:
    return F.coalesce(urls.normalise(F.col(column)), F.col(column))


def offers(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Links a site could follow: (site, slot, url, o1, o2) with the first place of each.

    ``documents`` are the pages whose links count; ``seen`` (site, url) are addresses already known.
    """
    links = (documents.select("site", "position", F.posexplode("links").alias("item", "link"))
             .select("site", "position", "item", "link.text", "link.abs"))
    same = derive(links, p=_parsed("abs")).filter(
        F.col("p").isNotNull() & (urls.site_key(F.col("p")) == F.col("site"))
        & ~urls.is_asset(F.regexp_replace("p.path", "/+$", "")))
    target = derive(derive(same, url=urls.normalised(F.col("p"))), t=target_of("text", "url"))
    slotted = target.filter(F.col("t.kind").isNotNull()).select(
        "site", F.coalesce("t.category", "t.kind").alias("slot"), "url",
        F.col("position").cast("long").alias("o1"), F.col("item").cast("long").alias("o2"))
    fresh = slotted.join(seen.select("site", "url").distinct(), ["site", "url"], "left_anti")
    return first_by(fresh, ["site", "slot", "url"], [F.col("o1"), F.col("o2")])


def fill_slots(offered: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Greedy fill in document order: an address takes one slot, a full slot uses no address up.

    A slot turns down only addresses that another slot took, and all slots together take at most ``TOTAL``; so the
    first ``capacity + TOTAL`` addresses of a slot decide exactly, and no site is gathered beyond that.
    """
    rank = F.row_number().over(Window.partitionBy("site", "slot").orderBy("o1", "o2"))
    few = offered.withColumn("rn", rank).filter(F.col("rn") <= TOTAL + max(CAPACITY.values()))
    cap = _by_slot(F.col("slot"), CAPACITY)
    gathered = few.groupBy("site").agg(F.array_sort(F.collect_list(
        F.struct("o1", "o2", "slot", "url", cap.alias("cap")))).alias("offers"))
    start = F.array().cast("array<struct<slot:string,url:string>>")
    if taken is not None:
        earlier = taken.groupBy("site").agg(F.collect_list(F.struct("slot", "url")).alias("taken"))
        gathered = gathered.join(earlier, "site", "left").withColumn("taken", F.coalesce("taken", start))
        start = F.col("taken")

    def step(acc: Column, x: Column) -> Column:
        used = F.exists(acc, lambda a: a["url"] == x["url"])
        full = F.size(F.filter(acc, lambda a: a["slot"] == x["slot"])) >= x["cap"]
        return F.when(used | full, acc).otherwise(F.concat(acc, F.array(F.struct(x["slot"].alias("slot"), x["url"].alias("url")))))
    filled = gathered.select("site", F.size(start).alias("before"), F.aggregate("offers", start, step).alias("slots"))
    fresh = filled.select("site", F.posexplode(F.slice("slots", F.col("before") + 1, F.lit(TOTAL))).alias("o", "s"))
    order = Window.partitionBy("site").orderBy(_by_slot(F.col("s.slot"), {s: i for i, s in enumerate(SLOTS)}), "o")
    kind = F.when(F.col("s.slot").isin(*LEGAL_CATEGORIES), "legal").otherwise(F.col("s.slot"))
    return fresh.select("site", "s.slot", "s.url", kind.alias("kind"), (F.row_number().over(order) - 1).alias("rank"))


def robots_pattern(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: ``*`` is any run, a closing ``$`` ends the address."""
    escaped = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    wild = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.when(wild.endswith("$"), wild).otherwise(F.replace(wild, F.lit("$"), F.lit(r"\$"))))


# Parts a site's addresses are dealt to when they meet the site's rules.
RULE_PARTS = 16


def compiled_rules(robots: DataFrame) -> DataFrame:
    """Rules of each site as prefixes: (site, allow, pattern, prefix, wild).

    ``prefix`` is what an address must start with: the pattern up to its first ``*`` or closing ``$``. Only rules that go on
    behind it (``wild``) are read as expressions.
    """
    known = robots.select("site", "allow", "pattern").filter(F.coalesce("pattern", F.lit("")) != "").distinct()
    prefix = F.regexp_extract("pattern", r"(?s)^((?:[^*$]|\$(?!\z))*+)", 1)
    return known.withColumn("prefix", prefix).withColumn("wild", F.col("prefix") != F.col("pattern"))


def allowed(candidates: DataFrame, robots: DataFrame | None) -> DataFrame:
    """Add ``allowed``: the longest matching rule of the site decides, allow wins a tie, no rule allows.

    ``robots``: (site, allow, pattern). An address is cut at the lengths that prefixes of its site have, and each piece looks
    up the rules with exactly that prefix, so thousands of rules cost an address as much as a few. A site's addresses are
    dealt to ``RULE_PARTS`` parts, and its rules are there in each.
    """
    if robots is None:
        return candidates.withColumn("allowed", F.lit(True))
    rules = compiled_rules(robots)
    parts = F.explode(F.sequence(F.lit(0), F.lit(RULE_PARTS - 1)))
    lengths = rules.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths")).withColumn("part", parts)
    target = let(urls.parse(F.col("url")), lambda p: F.concat(p["path"], p["query"]))
    targets = derive(candidates.select("site", "url").distinct(), target=target).withColumn(
        "part", F.pmod(F.xxhash64("url"), F.lit(RULE_PARTS)).cast("int"))
    pieces = targets.join(lengths, ["site", "part"]).select(
        "site", "part", "url", "target", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))).alias("n")).withColumn(
        "prefix", F.substring(F.col("target"), F.lit(1), F.col("n")))
    hits = (pieces.join(rules.withColumn("part", parts), ["site", "part", "prefix"])
            .filter(~F.col("wild") | F.rlike(F.col("target"), robots_pattern(F.col("pattern"))))
            .groupBy("site", "url").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("rule")))
    return candidates.join(hits, ["site", "url"], "left").withColumn("allowed", F.coalesce("rule", F.lit(True))).drop("rule")


def _within(candidates: DataFrame, budget: Column) -> DataFrame:
    """Blocked addresses do not use the budget up."""
    order = Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.col("allowed").cast("int")).over(order)
    return candidates.withColumn("state", F.when(~F.col("allowed"), "blocked").when(used <= budget, "fetch").otherwise("over_budget"))


def crawl_plan(seeds: DataFrame, documents: DataFrame, robots: DataFrame | None = None,
               max_pages: int = MAX_PAGES) -> DataFrame:
    """(site, round, rank, url, slot, kind, state) for every address a scan would ask for.

    ``seeds``: (site, url) start addresses; ``documents``: all analysed pages, found by their normalised address.
    """
    known = derive(documents.select("site", "position", "url", "final_url", "status_code", "links"),
                   address=_address("url"))
    home_docs = known.join(seeds.select("site", F.col("url").alias("address")), ["site", "address"], "left_semi")
    seen = seeds.select("site", "url").unionByName(derive(
        home_docs.select("site", "final_url"), url=_address("final_url")).select("site", "url"))
    # Round one feeds round two in several places, so it is kept.
    first = stored(_within(allowed(fill_slots(offers(home_docs.withColumn("position", F.lit(0)), seen)), robots),
                    F.lit(max_pages - 1)), "round_one")
    fetched = first.filter(F.col("state") == "fetch").select("site", F.col("url").alias("address"), "rank")
    sources = (known.join(fetched, ["site", "address"]).filter(F.col("status_code").between(200, 299))
               .withColumn("position", F.col("rank")).drop("rank"))
    known_now = seen.unionByName(first.select("site", "url"))
    left = fetched.groupBy("site").agg(F.count("*").alias("used"))
    second = (allowed(fill_slots(offers(sources, known_now), first.select("site", "slot", "url")), robots)
              .join(left, "site", "left"))
    second = _within(second, F.lit(max_pages - 1) - F.coalesce("used", F.lit(0))).drop("used")
    # Once round one has used the whole budget there is no second round.
    second = second.join(left.filter(F.col("used") >= max_pages - 1), "site", "left_anti")
    columns = ["site", "round", "rank", "url", "slot", "kind", "state"]
    start = seeds.select("site", F.lit(0).alias("round"), F.lit(0).alias("rank"), "url", F.lit("home").alias("slot"),
                         F.lit("home").alias("kind"), F.lit("fetch").alias("state"))
    return (start.unionByName(first.withColumn("round", F.lit(1)).select(*columns))
            .unionByName(second.withColumn("round", F.lit(2)).select(*columns)))


def planned_documents(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of a plan in fetch order. The start page is home; a page of no other kind takes its slot's kind."""
    order = Window.partitionBy("site").orderBy("round", "rank")
    wanted = plan.filter(F.col("state") == "fetch").select(
        "site", F.col("url").alias("address"), "slot", F.col("kind").alias("slot_kind"),
        (F.row_number().over(order) - 1).cast("long").alias("order"))
    known = derive(documents, address=_address("url"))
    kind = F.when(F.col("slot") == "home", "home").when(F.col("kind") == "other", F.col("slot_kind")).otherwise(F.col("kind"))
    return (known.join(wanted, ["site", "address"]).withColumn("kind", kind).withColumn("position", F.col("order"))
            .select(*documents.columns))


def limitations(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """What a scan could not see: script shell, blocked addresses, pages that answered with an error."""
    shell = documents.groupBy("site").agg(
        F.min_by("js_shell", "position").alias("js_shell"),
        F.array_sort(F.collect_list(F.when(~F.col("status_code").between(200, 299), F.struct(
            "position", "url", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")).alias("message"))))).alias("e"))
    blocked = plan.filter(F.col("state") == "blocked").groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("round", "rank", "url")))["url"].alias("blocked"))
    return shell.join(blocked, "site", "left").select(
        "site", "js_shell", F.coalesce("blocked", F.array().cast("array<string>")).alias("robots_blocked"),
        F.transform("e", lambda x: F.struct(x["url"], x["message"])).alias("errors"))


def limitation_rows(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """What a scan could not see as a long table: (site, kind, place, url, message), for sites of any size.

    ``kind`` is shell (the home page is filled by scripts), robots (addresses the rules block, in the order of the plan) or
    http (pages that answered with an error, in page order).
    """
    shell = first_by(documents.select("site", "position", "url", "js_shell"), ["site"], [F.col("position")]).filter("js_shell").select(
        "site", F.lit("shell").alias("kind"), F.lit(0).cast("long").alias("order"), "url", F.lit(None).cast("string").alias("message"))
    # Rounds hold fewer addresses than this.
    blocked = plan.filter(F.col("state") == "blocked").select(
        "site", F.lit("robots").alias("kind"), (F.col("round").cast("long") * 1_000_000 + F.col("rank")).alias("order"), "url",
        F.lit(None).cast("string").alias("message"))
    errors = documents.filter(~F.col("status_code").between(200, 299)).select(
        "site", F.lit("http").alias("kind"), F.col("position").cast("long").alias("order"), "url",
        F.concat(F.lit("HTTP "), F.col("status_code").cast("string")).alias("message"))
    rows = positions(shell.unionByName(blocked).unionByName(errors), ["site", "kind"], "order", "place")
    return rows.select("site", "kind", "place", "url", "message")


def failure_reasons(seeds: DataFrame, documents: DataFrame, robots: DataFrame | None = None,
                    errors: DataFrame | None = None) -> DataFrame:
    """(site, reason): NULL when a page loaded, else robots, the home page's status, or the first error."""
    pages = documents.groupBy("site").agg(
        F.max(F.col("status_code").between(200, 299)).alias("loaded"), F.min_by("status_code", "position").alias("status"))
    start = allowed(seeds.select("site", "url"), robots).select("site", "url", "allowed")
    joined = start.join(pages, "site", "left")
    if errors is None:
        joined = joined.withColumn("message", F.lit(None).cast("string"))
    else:
        own = errors.join(seeds.select("site", F.col("url").alias("start")), "site").groupBy("site").agg(
            F.coalesce(F.min_by(F.when(F.col("url") == F.col("start"), F.col("message")), F.struct(
                F.col("url") != F.col("start"), F.col("seq"))), F.max_by("message", "seq")).alias("message"))
        joined = joined.join(own, "site", "left")
    reason = (F.when(F.coalesce("loaded", F.lit(False)), F.lit(None))
              .when(~F.col("allowed"), "The shop's robots rules do not allow the home page, so nothing was scanned.")
              .when(F.col("status").isNotNull(), F.format_string("The home page answered with HTTP %d.", F.col("status")))
              .when(F.col("message").isNotNull(), F.concat(F.lit("The home page did not load: "),
                                                           F.regexp_replace("message", r"\.+$", ""), F.lit(".")))
              .otherwise("The home page did not load."))
    return joined.select("site", reason.alias("reason"))
