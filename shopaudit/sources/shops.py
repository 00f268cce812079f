"""Shop sites derived from the driver's supplier and part tables.

The driver's own pages hold no shop wording, so these pages, one small site per supplier with products from ``part``,
carry every branch of the checks. All of it is a projection of the rows, so the work grows with the tables.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table

PRODUCTS = 20


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(cond: Column, yes: str | Column, no: str | Column = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(cond, lit(yes)).otherwise(lit(no))


def shop_sites(spark: SparkSession, folder: str) -> DataFrame:
    """(k, site, root, start): one shop per supplier."""
    k = F.col("s_suppkey")
    domain = F.element_at(F.array(*[F.lit(d) for d in ("de", "com", "fr", "example")]), (k % 4 + 1).cast("int"))
    host = F.concat(F.lit("shop"), k.cast("string"), F.lit("."), domain)
    return table(spark, folder, "supplier").select(k.alias("k"), host.alias("site"), F.concat(F.lit("https://"), host).alias("root"))


def shop_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, site, position, url, final_url, status_code, html) of all derived shops."""
    k = F.col("k")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    slots = F.floor(F.col("p_partkey") / PRODUCTS)
    goods = (part.groupBy(slots.alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice"))).alias("goods")))
    sites = shop_sites(spark, folder).join(goods, "k", "left").withColumn("goods", F.coalesce("goods", F.array().cast(
        "array<struct<p_partkey:bigint,p_name:string,p_retailprice:double>>")))
    lang = F.element_at(F.array(*[F.lit(x) for x in (' lang="en"', ' lang="de"', ' lang="fr"', "")] + [F.concat(
        F.lit(' lang="'), F.element_at(F.array(F.lit("it"), F.lit("es-ES"), F.lit("nl")), (k % 15 / 5).cast("int") + 1), F.lit('"'))]), (k % 5 + 1).cast("int"))
    head = lambda title, extra="": _text("<!DOCTYPE html><html", lang, "><head><title>", title, "</title>", extra, "</head><body>")
    foot = "<footer><p>Thank you for your visit.</p></footer></body></html>"
    links = F.array_join(F.transform("goods", lambda g: _text(
        '<li><a href="/products/p', g["p_partkey"].cast("string"), '">', g["p_name"], "</a></li>")), "")
    scripts = _text('<script src="/app.js"></script>',
                    _if(k % 3 == 0, '<script>(function(){var u="https://client.crisp.chat/l.js";})();</script>'),
                    _if(k % 4 == 1, '<script src="https://consent.cookiebot.com/uc.js"></script>'))
    home = _text(
        head(_text("Shop ", k.cast("string")), scripts), "<h1>Shop ", k.cast("string"), "</h1>", _if(k % 8 == 1, "<h1>Again</h1>"),
        "<nav><ul>", _if(k % 6 != 5, '<li><a href="/imprint">Legal notice</a></li>'), _if(k % 7 != 6, '<li><a href="returns">Returns</a></li>'),
        _if(k % 5 != 4, '<li><a href="/access#top">Accessibility</a></li>'), '<li><a href="/account">My account</a></li>',
        links, '<li><a href="/cart">Cart</a></li><li><a href="https://elsewhere.example/checkout">Checkout</a></li></ul></nav>',
        _if(k % 4 == 0, '<p><a href="/withdraw">Withdraw from contract here</a></p>'),
        _if(k % 4 == 1, '<p><a href="/docs/form.pdf">Withdrawal form</a></p>'),
        _if(k % 4 == 2, "<p>To withdraw please write an e-mail to the shop.</p>"),
        _if((k % 7 == 6) & (k % 2 == 0), '<p><a href="/docs/returns.pdf">Return policy</a></p>'),
        _if(k % 3 == 0, "<p>This shop is carbon-neutral. Everybody is welcome.</p>"), _if((k % 3 == 0) & (k % 2 == 0), "<p>We offset all emissions.</p>"),
        _if(k % 3 == 1, "<p>Ask for our eco label today.</p>"),
        _if((k % 3 == 0) & (k % 2 == 0), "<p>You chat with an AI assistant.</p>"),
        _if(k % 4 == 0, "<div><p>We use cookies.</p><button>Accept all</button><button>Reject all</button></div>"),
        _if(k % 4 == 2, "<div><p>We use cookies.</p><button>Accept all</button></div>"),
        _if(k % 5 == 0, '<img src="/hero.jpg">', '<img src="/hero.jpg" alt="Hero">'), _if(k % 7 == 0, '<input type="search" name="q">'),
        _if(k % 5 == 2, "<p>We ship to the EU every day.</p>"), foot)
    shell = _text("<html", lang, "><head><title>App</title>", *['<script src="/c%d.js"></script>' % i for i in range(6)],
                  '</head><body><div id="root"></div></body></html>')
    imprint = _text(
        head("Legal notice"), "<h1>Legal notice</h1>", _if(k % 6 < 3, _text("<p>Lindenstraße ", (k + 1).cast("string"), "<br>10115 Berlin</p>")),
        _if((k % 6).isin(0, 1, 3), _text("<p>Write to info", k.cast("string"), "@shop.example</p>")),
        _if((k % 6).isin(0, 2), _text("<p>HRB ", (k + 10000).cast("string"), "</p>")), '<p><a href="/terms">Terms</a></p>', foot)
    period = F.element_at(F.array(*[F.lit(x) for x in (
        "Send goods back within 14 days.", "Send goods back within fourteen days.", "Send goods back within 30 days.",
        "Send goods back within 7 days.", "Send goods back whenever you like.", "Send goods back within one month.", "")]), (k % 7 + 1).cast("int"))
    returns = _text(head("Returns"), "<h1>Returns</h1><p>", period, "</p>", foot)
    access = _text(head("Accessibility"), "<h1>Accessibility</h1>", _if(k % 5 < 2, "<p>We are partially compliant with WCAG.</p>"),
                   _if(k % 5 == 0, '<p><a href="mailto:a11y@shop.example">Tell us</a></p>'),
                   _if(k % 5 == 2, '<form action="/send"><label>Message <textarea name="m"></textarea></label></form>'), foot)
    cart = _text(head("Your cart"), "<h1>Your cart</h1><p>The cart is empty.</p>", foot)
    product = lambda g: _text(
        head(g["p_name"], '<meta property="og:type" content="product">'), "<h1>", g["p_name"], "</h1><p>",
        F.when(k % 3 != 2, F.lit("€ ")).otherwise(F.lit("$ ")), F.format_string("%.2f", g["p_retailprice"]),
        '</p><button>Add to cart</button><p><a href="/">Home</a></p>', foot)
    fixed = [("/", home, F.lit(True)), ("/imprint", imprint, k % 6 != 5), ("/returns", returns, k % 7 != 6),
             ("/access", access, k % 5 != 4), ("/cart", cart, F.lit(True))]
    pages = F.concat(
        F.filter(F.array(*[F.struct(F.lit(path).alias("path"), html.alias("html"), F.lit(200).alias("status"), cond.alias("there"))
                           for path, html, cond in fixed]), lambda p: p["there"]),
        F.transform("goods", lambda g: F.struct(F.concat(F.lit("/products/p"), g["p_partkey"].cast("string")).alias("path"),
                                                product(g).alias("html"), F.lit(200).alias("status"), F.lit(True).alias("there"))),
        F.array(F.struct(F.lit("/account").alias("path"), F.lit("<html lang=en><title>Gone</title></html>").alias("html"),
                         F.lit(404).alias("status"), F.lit(True).alias("there"))))
    only_shell = F.array(F.struct(F.lit("/").alias("path"), shell.alias("html"), F.lit(200).alias("status"), F.lit(True).alias("there")))
    rows = sites.select("k", "site", "root", F.posexplode(F.when(k % 20 == 19, only_shell).otherwise(pages)).alias("position", "p"))
    url = F.concat("root", "p.path")
    return rows.select((F.col("k") * 100 + F.col("position")).alias("page_id"), "site", F.col("position").cast("long").alias("position"),
                       url.alias("url"), url.alias("final_url"), F.col("p.status").alias("status_code"), F.col("p.html").alias("html"))


def shop_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return shop_sites(spark, folder).select("site", F.concat("root", F.lit("/")).alias("url"))


# The shop whose robots file has a rule for every part there is.
MANY_RULES = 8


def shop_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth shop keeps robots out of its cart, every fifteenth allows one part of a closed folder.

    One shop has a rule for each part: every third product is allowed, the others are not.
    """
    k = F.col("k")
    rules = F.array_compact(F.array(
        F.when(k % 10 == 0, F.struct(F.lit(False).alias("allow"), F.lit("/cart").alias("pattern"))),
        F.when(k % 15 == 0, F.struct(F.lit(False).alias("allow"), F.lit("/products/").alias("pattern"))),
        F.when(k % 15 == 0, F.struct(F.lit(True).alias("allow"), F.lit("/products/*0$").alias("pattern")))))
    sites = shop_sites(spark, folder)
    few = sites.select("site", F.explode(rules).alias("r")).select("site", "r.*")
    part = F.col("p_partkey")
    many = table(spark, folder, "part").select(F.lit(MANY_RULES).cast("long").alias("k"), (part % 3 == 1).alias("allow"),
                                               F.concat(F.lit("/products/p"), part.cast("string")).alias("pattern"))
    return few.unionByName(many.join(F.broadcast(sites.filter(k == MANY_RULES).select("k", "site")), "k").select("site", "allow", "pattern"))
