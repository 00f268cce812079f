"""Nested elements, JSON-LD depth, robots rules and planned pages."""
import re

import pytest
from pyspark.sql import functions as F

from shopaudit.functions import scalars
from shopaudit.operators import crawl, extract
from shopaudit.session import configure


def buttons(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, html string")
    cut = df.select("i", extract.without_opaque(extract.without_nested_templates(F.col("html"))).alias("m"))
    return [r["b"] for r in cut.select("i", extract.buttons_of(F.col("m")).alias("b")).orderBy("i").collect()]


def test_buttons_in_each_other(spark):
    deep = "<div>" * 60 + "x" + "</div>" * 60
    found = buttons(
        spark, '<div role="button">a<div>b</div>c</div><div>d</div>', f'<DIV class=x role=button>{deep}y</div>z',
        '<div role=button>o<div role="button">i</div>p</div>', '<div role=button><button>in</button></div>', '<div role=button>never closed <b>x</b>',
        '<div></div></div><span role="button"><span><span>s</span></span>t</span>u', '<img role="button" title="pic">text<img alt="no">',
        '<div role="button" aria-label="L"><div></div></div>', '<my-button role="button">m<my-button>n</my-button>o</my-button>p',
        '<div title="</div>" role="button">q</div>', '<input type="submit" value="Go"><div role=button><div>v</div></div>')
    assert found == [["abc"], ["xy"], ["oip", "i"], ["in", "in"], ["never closed x"], ["st"], ["pic"], ["L"], ["mno"], ["q"], ["Go", "v"]]


def test_templates_in_each_other(spark):
    inner = "<template><button>n</button><template><i>x</i></template><button>no</button></template>"
    found = buttons(spark, f"<button>a</button>{inner}<button>b</button>", "<template><button>n</button>", f"<!-- <template> --><button>c</button>{inner}{inner}<button>d</button>",
                    "<script>'<template>'</script><template><template></template></template><button>e</button>")
    assert found == [["a", "b"], [], ["c", "d"], ["e"]]


@pytest.mark.parametrize("depth", range(9))
def test_types_at_depth(spark, depth):
    configure(spark)
    lists = "[" * depth + '{"@type":["Thing",3,null,"http://schema.org/productGroup"]}' + "]" * depth
    objects = '{"a":' * depth + '{"@type":"Product"}' + "}" * depth
    rows = spark.createDataFrame([(lists,), (objects,)], "t string").select(scalars.describes_product(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [depth <= 6, depth <= 6]


def test_types_that_are_none(spark):
    configure(spark)
    blocks = ['{"name":"\\"@type\\":\\"Product\\""}', '{"@type":"ProductModel"}', '{"@type":{"a":"x"},"b":"Product"}', '{"type":"Product"}', "Product", "", None,
              '{"@type":"Product"', "[]", '{"@type":"Product\\n"}', '{"@type":null,"Product":{"@type":"PRODUCT"}}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i long, t string").select("i", scalars.describes_product(F.col("t")).alias("p"))
    assert [r["p"] for r in rows.orderBy("i").collect()] == [False] * (len(blocks) - 1) + [True]


def plain_allowed(address, rules):
    path = re.sub("^https?://[^/]+", "", address)
    hits = []
    for allow, pattern in rules:
        if pattern:
            body = re.escape(pattern[:-1] if pattern.endswith("$") else pattern).replace("\\*", ".*")
            if re.match(body + ("$" if pattern.endswith("$") else ""), path, re.S):
                hits.append((len(pattern), allow))
    return max(hits)[1] if hits else True


def test_robots_against_every_rule(spark):
    rules = {"a": [(False, "/p"), (True, "/p/*/x$"), (False, "/p/1/x$"), (True, "/p/1/x$"), (False, "*q="), (False, ""), (True, "/$"), (False, "/a$b"),
                   *[(i % 3 == 0, f"/s/{i}") for i in range(2000)]], "b": [(False, "/")], "c": []}
    paths = ["/", "/p", "/p/2/x", "/p/2/xy", "/p/1/x", "/z?q=1", "/a$b/c", "/a", "/s/12", "/s/999/", "/s/1999", "/s", "/p/*"]
    found = spark.createDataFrame([(s, f"https://{s}.example{p}") for s in rules for p in paths], "site string, url string")
    robots = spark.createDataFrame([(s, a, p) for s, rs in rules.items() for a, p in rs] + [("a", False, None), ("a", False, "/p")], "site string, allow boolean, pattern string")
    answer = {r["url"]: r["allowed"] for r in crawl.allowed(found, robots).collect()}
    assert answer == {f"https://{s}.example{p}": plain_allowed(f"https://{s}.example{p}", rs) for s, rs in rules.items() for p in paths}
    assert all(r["allowed"] for r in crawl.allowed(found, None).collect())


def test_planned_documents(spark):
    docs = spark.createDataFrame(
        [("s", 5, "https://s.example/x", "other", 200), ("s", 1, "https://s.example/", "product", 200), ("s", 2, "https://s.example/t", "product", 404),
         ("s", 3, "https://s.example/no", "other", 200)], "site string, position long, url string, kind string, status_code int")
    plan = spark.createDataFrame(
        [("s", 0, 0, "https://s.example/", "home", "home", "fetch"), ("s", 1, 1, "https://s.example/x", "imprint", "legal", "fetch"),
         ("s", 1, 0, "https://s.example/gone", "cart", "cart", "fetch"), ("s", 2, 0, "https://s.example/t", "cart", "cart", "fetch"),
         ("s", 2, 1, "https://s.example/no", "product", "product", "blocked")], "site string, round int, rank int, url string, slot string, kind string, state string")
    rows = crawl.planned_documents(plan, docs).orderBy("position").collect()
    assert [(r["position"], r["url"], r["kind"]) for r in rows] == [
        (0, "https://s.example/", "home"), (2, "https://s.example/x", "legal"), (3, "https://s.example/t", "product")]
