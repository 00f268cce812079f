"""Queries over shops derived from supplier and part. Their SQL states the outcome from the keys, not from the pages."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import findings as checks
from ..operators import crawl, extract, history
from ..session import spread, stored
from ..sources import shops
from ..vocab import copy

NOW = "2026-12-01 00:00:00"


def _documents(spark, d):
    # Spread the derived pages over all tasks before the costly step.
    pages = shops.shop_pages(spark, d)
    return stored(extract.documents(spread(pages, "page_id")), "shop_documents")


def shop_kinds(spark, d):
    return _documents(spark, d).select("page_id", "kind", "js_shell")


def shop_contents(spark, d):
    """Counts of what the pages of each shop hold."""
    docs = _documents(spark, d)
    return docs.groupBy("site").agg(
        F.sum(F.size("buttons")).alias("buttons"), F.sum(F.size("forms")).alias("forms"), F.sum(F.size("images")).alias("images"),
        F.sum(F.size("scripts")).alias("scripts"), F.count_if(F.element_at("meta", "og:type") == "product").alias("products"))


def shop_findings(spark, d):
    """Statuses of the nine checks on every shop."""
    return checks.audit(_documents(spark, d), NOW).findings.select("site", "code", "status")


def shop_evidence(spark, d):
    """Every quote behind every finding, also those that a report does not show, with its place."""
    order = Window.partitionBy("site", "code").orderBy("o1", "o2", "o3")
    return checks.audit(_documents(spark, d), NOW).evidence.select(
        "site", "code", (F.row_number().over(order) - 1).cast("long").alias("place"), "url", "quote")


def _review(spark, d):
    """Answers of a review: the first sentence of every fourth shop is an unspecific claim; half of these get a rewording."""
    k = F.col("k")
    generic = k % 4 == 1
    return shops.shop_sites(spark, d).select(
        "site", F.lit(0).alias("seq"), F.lit(0).cast("long").alias("idx"),
        F.when(generic, "generic_unsubstantiated").otherwise("not_environmental").alias("verdict"),
        F.when(generic & (k % 8 == 1), "We use 40 % less energy.").alias("rewording"), F.concat(F.lit("seen in shop "), k.cast("string")).alias("reason"))


def shop_claims(spark, d):
    """Environmental claims of reviewed shops as their findings state them, and who flagged each quote."""
    audited = checks.audit(_documents(spark, d), NOW, _review(spark, d)).findings.filter(F.col("code") == "green_claims")
    # Both sides of the join below read the findings, so the audit ends here once.
    found = stored(history.stated_claims(audited).select("site", "status", "code", "evidence", "claims"), "stated_claims")
    origins = history.claim_origins(found).filter(F.col("code") == "green_claims").select("site", "o", F.col("source").alias("origin"))
    said = found.select("site", "status", F.posexplode("claims").alias("o", "c"))
    return said.join(origins, ["site", "o"]).select(
        "site", "status", F.col("o").cast("long").alias("place"), "c.url", "c.quote", "c.source", "c.rule", "c.reason", "c.rewording", "origin")


def answered_findings(spark, d):
    """Statuses after reviews whose stored answers are read: every tenth answer is cut off, every other tenth is no list."""
    k = F.col("k")
    reviewed = _review(spark, d).join(shops.shop_sites(spark, d).select("site", "k"), "site")
    whole = F.to_json(F.array(F.struct(F.lit(0).alias("index"), "verdict", "rewording", "reason")))
    answer = F.when(k % 10 == 3, F.substring(whole, 1, 20)).when(k % 10 == 6, F.lit('{"index":0}')).otherwise(whole)
    verdicts, broken = checks.read_answers(reviewed.select("site", answer.alias("answer")))
    found = checks.audit(_documents(spark, d), NOW, verdicts, broken=broken).findings
    return found.select("site", "code", "status", F.get_json_object("meta", "$.v.error").alias("error"))


def shop_reports(spark, d):
    """What a report says about each finding besides its quotes: weight, law, and the markup it suggests."""
    found = checks.audit(_documents(spark, d), NOW).findings
    return found.select("site", "code", "severity", "title", F.col("citation.article").alias("article"), "evidence_total", F.col("fix.html").alias("html"))


def shop_plan(spark, d):
    plan = crawl.crawl_plan(shops.shop_seeds(spark, d), _documents(spark, d), shops.shop_robots(spark, d))
    return plan.groupBy("site", "slot", "state").agg(F.count("*").alias("n"))


def shop_limitations(spark, d):
    docs = _documents(spark, d)
    plan = crawl.crawl_plan(shops.shop_seeds(spark, d), docs, shops.shop_robots(spark, d))
    return crawl.limitations(docs, plan).select("site", "js_shell", F.size("robots_blocked").cast("long").alias("blocked"),
                                                F.size("errors").cast("long").alias("errors"))


def limitation_rows(spark, d):
    docs = _documents(spark, d)
    plan = crawl.crawl_plan(shops.shop_seeds(spark, d), docs, shops.shop_robots(spark, d))
    return crawl.limitation_rows(docs, plan).select("site", "kind", "place", F.regexp_extract("url", "^https?://[^/]+(.*)$", 1).alias("path"), "message")


def short_plan(spark, d):
    """The same plan with six pages a site: what is beyond them is planned, not fetched."""
    plan = crawl.crawl_plan(shops.shop_seeds(spark, d), _documents(spark, d), shops.shop_robots(spark, d), 6)
    return plan.groupBy("site", "state").agg(F.count("*").alias("n"))


def _planned(spark, d):
    docs = _documents(spark, d)
    plan = crawl.crawl_plan(shops.shop_seeds(spark, d), docs, shops.shop_robots(spark, d))
    return stored(crawl.planned_documents(plan, docs), "planned_documents")


def planned_pages(spark, d):
    """Pages a scan fetches, in the order of fetching, with the kind that their slot gives to pages of no other kind."""
    return _planned(spark, d).select("site", "position", "kind", "status_code", F.regexp_extract("url", "^https?://[^/]+(.*)$", 1).alias("path"))


def planned_findings(spark, d):
    """Statuses of the nine checks, and the size of their evidence, on the pages a scan fetches."""
    return checks.audit(_planned(spark, d), NOW).findings.select("site", "code", "status", "evidence_total")


def shop_failures(spark, d):
    docs = _documents(spark, d)
    # Every ninth shop answers with an error.
    broken = docs.withColumn("status_code", F.when(F.col("page_id") % 900 < 100, 503).otherwise(F.col("status_code")))
    return crawl.failure_reasons(shops.shop_seeds(spark, d), broken, None)


QUERIES = {f.__name__: f for f in (shop_kinds, shop_contents, shop_findings, shop_evidence, shop_claims, answered_findings, shop_reports, shop_plan, shop_limitations, limitation_rows, short_plan, planned_pages, planned_findings, shop_failures)}

_SHOPS = """WITH s AS (SELECT s_suppkey k, 'shop'||s_suppkey||'.'||['de','com','fr','example'][s_suppkey%4+1] site, s_suppkey%20=19 shell,
   (SELECT count(*) FROM part WHERE p_partkey//20=s_suppkey) goods FROM supplier)"""
_PAGES = _SHOPS + """, fixed AS (SELECT k, site, shell, goods, unnest([['home','1'],['legal',CASE WHEN k%6<>5 THEN '1' END],['legal',CASE WHEN k%7<>6 THEN '1' END],
     ['legal',CASE WHEN k%5<>4 THEN '1' END],['cart','1']]) x FROM s),
   pages AS (SELECT k, site, shell, x[1] kind, 0 o FROM fixed WHERE x[2]='1' AND (NOT shell OR x[1]='home')
     UNION ALL SELECT k, site, shell, 'product', 1 FROM s, range(20) g(i) WHERE NOT shell AND i<goods
     UNION ALL SELECT k, site, shell, 'account', 2 FROM s WHERE NOT shell)"""

# The quotes a reader finds on the pages of each shop; o is their order inside a finding.
_EVIDENCE = _SHOPS + """, r AS (SELECT *, 'https://'||site root, (SELECT min(p_partkey) FROM part WHERE p_partkey//20=k) good FROM s),
   h AS (SELECT *, root||'/' home, (SELECT p_retailprice FROM part WHERE p_partkey=good) price FROM r),
   opened AS (SELECT k, unnest([[0,1],[1,(k%6<>5)::INT],[2,(k%7<>6)::INT],[3,(k%5<>4)::INT],[4,1]]) x, root,
              ['/','/imprint','/returns','/access','/cart'] paths FROM h WHERE NOT shell),
   seen AS (SELECT k, x[1] pos, root||paths[x[1]+1] url FROM opened WHERE x[2]=1
            UNION ALL SELECT k, 5+p_partkey%20, root||'/products/p'||p_partkey FROM h JOIN part ON p_partkey//20=k WHERE NOT shell),
   sample AS (SELECT k, 10*pos o, url, 'The html element has no lang attribute' quote, 1 AS strong FROM seen WHERE k%5=3
     UNION ALL SELECT k, 1, home, '2 h1 headings: "Shop '||k||'", "Again"', 0 FROM h WHERE k%8=1 AND NOT shell
     UNION ALL SELECT k, 2, home, 'Image without alt attribute: '||root||'/hero.jpg', 1 FROM h WHERE k%5=0 AND NOT shell
     UNION ALL SELECT k, 4, home, 'Field without a label: "q" (search)', 1 FROM h WHERE k%7=0 AND NOT shell),
   e AS (
     SELECT k, 'withdrawal_function' code, 0 o, home url, 'Withdraw from contract here' quote FROM h WHERE NOT shell AND k%4=0
     UNION ALL SELECT k, 'withdrawal_function', 0, home, 'Withdrawal form' FROM h WHERE NOT shell AND k%4=1
     UNION ALL SELECT k, 'withdrawal_function', 1, home, 'Return policy' FROM h WHERE NOT shell AND k%4=2 AND k%7=6
     UNION ALL SELECT k, 'withdrawal_function', 2, home, 'To withdraw please write an e-mail to the shop.' FROM h WHERE NOT shell AND k%4=2
     UNION ALL SELECT k, 'withdrawal_policy', 0, root||'/returns', CASE k%7 WHEN 4 THEN 'Returns' ELSE 'Send goods back within '||
       ['14 days.','fourteen days.','30 days.','7 days.','','one month.'][k%7+1] END FROM h WHERE NOT shell AND k%7<>6
     UNION ALL SELECT k, 'withdrawal_policy', 0, home, CASE WHEN k%2=0 THEN 'Return policy' ELSE 'Withdrawal form' END FROM h WHERE NOT shell AND k%7=6 AND (k%2=0 OR k%4=1)
     UNION ALL SELECT k, 'green_claims', 0, home, CASE WHEN k%3=1 THEN 'Ask for our eco label today.' ELSE 'This shop is carbon-neutral.' END FROM h WHERE NOT shell AND k%3<>2
     UNION ALL SELECT k, 'accessibility_statement', 0, root||'/access', CASE WHEN k%5<2 THEN 'We are partially compliant with WCAG.' WHEN k%5=2 THEN 'Form on the statement page'
       ELSE 'Accessibility' END FROM h WHERE NOT shell AND k%5<>4
     UNION ALL SELECT k, 'accessibility_statement', 1, root||'/access', 'Tell us' FROM h WHERE NOT shell AND k%5=0
     UNION ALL SELECT k, 'a11y_sample', o, url, quote FROM sample
     UNION ALL SELECT k, 'ai_disclosure', 0, home, 'Crisp chat: https://client.crisp.chat/l.js' FROM h WHERE NOT shell AND k%3=0
     UNION ALL SELECT k, 'ai_disclosure', 1, home, 'You chat with an AI assistant.' FROM h WHERE NOT shell AND k%6=0
     UNION ALL SELECT k, 'cookie_parity', 0, home, 'Accept all' FROM h WHERE NOT shell AND k%2=0
     UNION ALL SELECT k, 'cookie_parity', 1, home, 'Reject all' FROM h WHERE NOT shell AND k%4=0
     UNION ALL SELECT k, 'cookie_parity', 0, home, 'Cookiebot script: https://consent.cookiebot.com/uc.js' FROM h WHERE NOT shell AND k%4=1
     UNION ALL SELECT k, 'legal_notice', 0, root||'/imprint', 'Lindenstraße '||(k+1)||' 10115 Berlin' FROM h WHERE NOT shell AND k%6<3
     UNION ALL SELECT k, 'legal_notice', 1, root||'/imprint', 'Write to info'||k||'@shop.example' FROM h WHERE NOT shell AND k%6 IN (0,1,3)
     UNION ALL SELECT k, 'legal_notice', 2, root||'/imprint', 'HRB '||(k+10000) FROM h WHERE NOT shell AND k%6 IN (0,2)
     UNION ALL SELECT k, 'legal_notice', 1, root||'/access', 'Tell us' FROM h WHERE NOT shell AND k%6=5 AND k%5=0
     UNION ALL SELECT k, 'eu_targeting', 0, root||'/products/p'||good, '€ '||format('{:.2f}', price) FROM h WHERE NOT shell AND good IS NOT NULL AND k%3<>2
     UNION ALL SELECT k, 'eu_targeting', 1, home, 'We ship to the EU every day.' FROM h WHERE NOT shell AND k%5=2
     UNION ALL SELECT k, 'eu_targeting', 2, home, 'lang="'||CASE k%5 WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE ['it','es-ES','nl'][k%15//5+1] END||'"' FROM h WHERE k%5 IN (1,2,4)
     UNION ALL SELECT k, 'eu_targeting', 3, home, 'Domain ends in .'||CASE k%4 WHEN 0 THEN 'de' ELSE 'fr' END FROM h WHERE k%4 IN (0,2))"""

_quoted = lambda x: "'" + x.replace("'", "&#39;") + "'"
_LABEL_ROWS = "[" + ",".join("[" + ",".join(map(_quoted, (lang, *labels))) + "]" for lang, labels in copy.LABELS.items()) + "]"
_TITLE_ROWS = "[" + ",".join(f"['{code}','{title}']" for code, title in copy.TITLES.items()) + "]"

ORACLES = {
    "shop_evidence": _EVIDENCE + """SELECT site, code, row_number() OVER (PARTITION BY k, code ORDER BY o)-1 AS place, url, quote FROM e JOIN s USING (k)""",
    "shop_claims": _SHOPS + """SELECT site, 'fail' status, 0::BIGINT place, 'https://'||site||'/' url,
          CASE WHEN k%3=1 THEN 'Ask for our eco label today.' ELSE 'This shop is carbon-neutral.' END quote,
          CASE WHEN k%3=0 AND k%2=1 THEN 'classifier' ELSE 'rule' END "source", CASE WHEN k%3=1 THEN 'self_made_label' WHEN k%2=0 THEN 'offset_neutrality' END "rule",
          CASE WHEN k%3=1 THEN 'A label without certification scheme or public authority.' WHEN k%2=0 THEN 'Neutral climate impact that rests on offsets.'
          ELSE 'seen in shop '||k END reason, CASE WHEN k%3=0 AND k%8=1 THEN 'We use 40 % less energy.' END rewording,
          CASE WHEN k%3=0 AND k%2=1 THEN 'model' ELSE 'rule' END origin
        FROM s WHERE NOT shell AND (k%3=1 OR (k%3=0 AND (k%2=0 OR k%4=1)))""",
    "shop_reports": _EVIDENCE + """, c AS (SELECT unnest([['withdrawal_function','high','Art. 11a'],['withdrawal_policy','medium','Art. 6(1)(h) and Art. 9'],
          ['green_claims','high','Annex I, points 2a, 4a and 4c'],['accessibility_statement','medium','Art. 13(2) and Annex V'],['a11y_sample','low','Annex I'],
          ['ai_disclosure','medium','Art. 50(1)'],['cookie_parity','medium','Art. 5(3)'],['legal_notice','high','Art. 5(1)'],['eu_targeting','low','Art. 17(1)(c)']]) x),
        n AS (SELECT k of_k, code of_code, count(*) total FROM e GROUP BY 1, 2),
        f AS (SELECT *, CASE WHEN k%5 IN (1,2) THEN ['de','fr'][k%5] WHEN k%5=4 THEN ['it','es','nl'][k%15//5+1]
          WHEN k%5=3 AND k%4 IN (0,2) THEN CASE k%4 WHEN 0 THEN 'de' ELSE 'fr' END ELSE 'en' END lang FROM h),
        l AS (SELECT unnest(""" + _LABEL_ROWS + """) x),
        t AS (SELECT unnest(""" + _TITLE_ROWS + """) t)
        SELECT site, x[1] code, x[2] severity, t.t[2] title, x[3] article, coalesce(total, 0)::BIGINT evidence_total, CASE x[1]
          WHEN 'withdrawal_function' THEN '<a class="button" href="/withdraw">'||w[2]||'</a>'||chr(10)||'<form method="post" action="/withdraw">'||chr(10)||
            '<p><label for="contract">'||w[6]||'</label> <input id="contract" name="contract" required></p>'||chr(10)||'<p><label for="receipt">'||w[7]||
            '</label> <input id="receipt" name="receipt" type="email" required></p>'||chr(10)||'<p><button type="submit" name="step" value="confirm">'||w[8]||'</button></p>'||chr(10)||'</form>'
          WHEN 'withdrawal_policy' THEN '<p>You may withdraw from this contract within 14 days without giving a reason.</p>'
          WHEN 'green_claims' THEN CASE WHEN k%6=0 AND NOT shell THEN '<p>We pay for climate projects; our products are not neutral for that.</p>'
            ELSE '<p>Our boxes are made from 100 % recycled board.</p>' END
          WHEN 'ai_disclosure' THEN '<p>'||w[3]||'</p>'
          WHEN 'cookie_parity' THEN '<button type="button">Reject all</button><button type="button">Accept all</button>'
          WHEN 'accessibility_statement' THEN '<h1>Accessibility statement</h1>'||chr(10)||'<p>Write to <a href="mailto:accessibility@'||site||'">accessibility@'||site||'</a>.</p>'
          WHEN 'legal_notice' THEN '<footer><a href="'||CASE WHEN NOT shell AND k%6<>5 THEN '/imprint' ELSE w[5] END||'">'||w[4]||'</a></footer>'
          WHEN 'a11y_sample' THEN nullif(concat_ws(chr(10), CASE WHEN k%5=3 AND NOT shell THEN '<html lang="'||lang||'">' END, CASE WHEN k%8=1 OR shell THEN '<h1>Linen shirt</h1>' END,
            CASE WHEN k%5=0 AND NOT shell THEN '<img src="/shirt.jpg" alt="Linen shirt">' END,
            CASE WHEN k%7=0 AND NOT shell THEN '<label for="mail">E-mail</label><input id="mail" name="mail" type="email">' END), '') END html
        FROM f CROSS JOIN c JOIN (SELECT x w FROM l) ON w[1]=lang JOIN t ON t.t[1]=x[1] LEFT JOIN n ON of_k=k AND of_code=x[1]""",
    "shop_contents": _SHOPS + """SELECT site, CASE WHEN shell THEN 0 ELSE goods + CASE k%4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END END buttons,
        CASE WHEN shell THEN 0 ELSE (k%7=0)::INT + (k%5=2)::INT END::BIGINT forms, CASE WHEN shell THEN 0 ELSE 1 END::BIGINT images,
        CASE WHEN shell THEN 6 ELSE 1 + (k%3=0)::INT + (k%4=1)::INT END::BIGINT scripts, CASE WHEN shell THEN 0 ELSE goods END products FROM s""",
    "shop_findings": _SHOPS + """, f AS (SELECT site, shell,
          CASE WHEN shell THEN 'unknown' WHEN k%4=0 THEN 'pass' WHEN k%4 IN (1,2) OR (k%7=6 AND k%2=0) THEN 'warn' ELSE 'fail' END withdrawal_function,
          CASE WHEN shell THEN 'unknown' WHEN k%7 IN (0,1,2,5) THEN 'pass' WHEN k%7=3 THEN 'fail' WHEN k%7=4 THEN 'warn'
               WHEN k%2=0 OR k%4=1 THEN 'warn' ELSE 'fail' END withdrawal_policy,
          CASE WHEN shell THEN 'unknown' WHEN k%3=1 OR (k%3=0 AND k%2=0) THEN 'fail' WHEN k%3=0 THEN 'unknown' ELSE 'pass' END green_claims,
          CASE WHEN shell THEN 'unknown' WHEN k%5=0 THEN 'pass' WHEN k%5=4 THEN 'fail' ELSE 'warn' END accessibility_statement,
          CASE WHEN shell THEN 'unknown' WHEN k%5 IN (0,3) OR k%7=0 THEN 'fail' WHEN k%8=1 THEN 'warn' ELSE 'pass' END a11y_sample,
          CASE WHEN shell THEN 'unknown' WHEN k%3<>0 OR k%2=0 THEN 'pass' ELSE 'warn' END ai_disclosure,
          CASE WHEN shell THEN 'unknown' WHEN k%4=0 THEN 'pass' WHEN k%4=2 THEN 'warn' ELSE 'unknown' END cookie_parity,
          CASE WHEN shell THEN 'unknown' WHEN k%6=0 THEN 'pass' WHEN k%6 IN (1,2,3) THEN 'warn' WHEN k%6=4 THEN 'fail'
               WHEN k%5=0 THEN 'warn' ELSE 'fail' END legal_notice,
          CASE WHEN k%5 IN (1,2,4) OR k%4 IN (0,2) OR (k%3<>2 AND goods>0 AND NOT shell) THEN 'pass' ELSE 'unknown' END eu_targeting FROM s)
        SELECT site, code, status FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (site, shell)) INTO NAME code VALUE status)""",
    "shop_kinds": None,
    "shop_plan": _SHOPS + """, p AS (
          SELECT site, 'home' slot, 'fetch' state, 1 n FROM s UNION ALL SELECT site, 'imprint', 'fetch', 1 FROM s WHERE NOT shell AND k%6<>5
          UNION ALL SELECT site, 'withdrawal', 'fetch', 1 FROM s WHERE NOT shell AND (k%7<>6 OR k%4=0)
          UNION ALL SELECT site, 'accessibility', 'fetch', 1 FROM s WHERE NOT shell AND k%5<>4
          UNION ALL SELECT site, 'account', 'fetch', 1 FROM s WHERE NOT shell
          UNION ALL SELECT site, 'terms', 'fetch', 1 FROM s WHERE NOT shell AND k%6<>5
          UNION ALL SELECT site, 'cart', CASE WHEN k%10=0 THEN 'blocked' ELSE 'fetch' END, 1 FROM s WHERE NOT shell
          UNION ALL SELECT site, 'product', CASE WHEN (k%15=0 AND (k*20+i)%10<>0) OR (k=8 AND (k*20+i)%3<>1) THEN 'blocked' ELSE 'fetch' END, 1 FROM s, range(4) g(i) WHERE NOT shell AND i<goods)
        SELECT site, slot, state, count(*) n FROM p GROUP BY ALL""",
    "shop_limitations": _SHOPS + """SELECT site, shell js_shell, CASE WHEN shell THEN 0 ELSE (k%10=0)::INT + CASE WHEN k%15=0 THEN
          (SELECT count(*) FROM range(4) g(i) WHERE i<goods AND (k*20+i)%10<>0)
          WHEN k=8 THEN (SELECT count(*) FROM range(4) g(i) WHERE i<goods AND (k*20+i)%3<>1) ELSE 0 END END blocked, CASE WHEN shell THEN 0 ELSE 1 END errors FROM s""",
    "shop_failures": _SHOPS + "SELECT site, CASE WHEN k%9=0 THEN 'The home page answered with HTTP 503.' END reason FROM s",
}
ORACLES["shop_kinds"] = _PAGES + """, fixed_pos AS (SELECT * FROM pages)
   SELECT k*100 + row_number() OVER (PARTITION BY k ORDER BY o, CASE kind WHEN 'home' THEN 0 WHEN 'legal' THEN 1 ELSE 2 END)-1 page_id,
   kind, shell js_shell FROM fixed_pos"""
# A scan fetches four products at most and no page that robots rules keep out.
_PLANNED = _EVIDENCE.replace("WHERE x[2]=1", "WHERE x[2]=1 AND NOT (x[1]=4 AND k%10=0)").replace(
    "p_partkey//20=k WHERE NOT shell)", "p_partkey//20=k AND p_partkey%20<4 AND NOT (k%15=0 AND p_partkey%10<>0) AND NOT (k=8 AND p_partkey%3<>1) WHERE NOT shell)")
_STATUSES = ORACLES["shop_findings"].removeprefix(_SHOPS).partition("SELECT site, code, status FROM (UNPIVOT")[0]
ORACLES["planned_findings"] = _PLANNED + ", n AS (SELECT k of_k, code of_code, count(*) total FROM e GROUP BY 1, 2)" + _STATUSES + """
   SELECT u.site, code, status, coalesce(total, 0)::BIGINT evidence_total FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (site, shell)) INTO NAME code VALUE status) u
   JOIN s USING (site) LEFT JOIN n ON of_k=k AND of_code=code"""
ORACLES["planned_pages"] = _SHOPS + """, p AS (
     SELECT k, site, shell, unnest([[0,1],[1,(k%6<>5)::INT],[2,(k%7<>6 OR k%4=0)::INT],[3,(k%5<>4)::INT],[4,1],[9,(k%10<>0)::INT]]) x FROM s
     UNION ALL SELECT k, site, shell, [5+i, (NOT (k%15=0 AND (k*20+i)%10<>0) AND NOT (k=8 AND (k*20+i)%3<>1))::INT] FROM s, range(4) g(i) WHERE i<goods),
   o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x[1])-1 AS "position" FROM p WHERE x[2]=1 AND (NOT shell OR x[1]=0))
   SELECT site, "position", CASE x[1] WHEN 0 THEN 'home' WHEN 4 THEN 'account' WHEN 9 THEN 'cart' ELSE CASE WHEN x[1]<4 THEN 'legal' ELSE 'product' END END kind,
     CASE WHEN x[1]=4 THEN 404 ELSE 200 END status_code, CASE WHEN x[1] BETWEEN 5 AND 8 THEN '/products/p'||(k*20+x[1]-5)
     ELSE ['/','/imprint','/returns','/access','/account','','','','','/cart'][x[1]+1] END path FROM o WHERE NOT (x[1]=2 AND k%7=6)"""
ORACLES["limitation_rows"] = _SHOPS + """, g AS (SELECT k, i FROM s, range(4) g(i) WHERE i<goods AND NOT shell AND ((k%15=0 AND (k*20+i)%10<>0) OR (k=8 AND (k*20+i)%3<>1))),
   r AS (SELECT k, 'shell' kind, 0 o, '/' path, NULL message FROM s WHERE shell
     UNION ALL SELECT k, 'robots', i, '/products/p'||(k*20+i), NULL FROM g UNION ALL SELECT k, 'robots', 9, '/cart', NULL FROM s WHERE k%10=0 AND NOT shell
     UNION ALL SELECT k, 'http', 0, '/account', 'HTTP 404' FROM s WHERE NOT shell)
   SELECT site, kind, row_number() OVER (PARTITION BY k, kind ORDER BY o)-1 place, path, message FROM r JOIN s USING (k)"""
# Six pages: the start and five of round one, in the order of the slots; a second round only where one of the five is free.
ORACLES["short_plan"] = _SHOPS + """, w AS (SELECT *, (k%6<>5)::INT + (k%7<>6 OR k%4=0)::INT + (k%5<>4)::INT + 2 - (k%10=0)::INT + least(goods, 4)
       - (SELECT count(*) FROM range(4) g(i) WHERE i<goods AND ((k%15=0 AND (k*20+i)%10<>0) OR (k=8 AND (k*20+i)%3<>1))) open_ones,
       (k%10=0)::INT + (SELECT count(*) FROM range(4) g(i) WHERE i<goods AND ((k%15=0 AND (k*20+i)%10<>0) OR (k=8 AND (k*20+i)%3<>1))) shut FROM s),
   n AS (SELECT site, CASE WHEN shell THEN 1 ELSE 1 + least(5, open_ones) + CASE WHEN open_ones<5 AND k%6<>5 THEN 1 ELSE 0 END END AS "fetch",
       CASE WHEN shell THEN 0 ELSE shut END blocked, CASE WHEN shell THEN 0 ELSE greatest(open_ones-5, 0) END over_budget FROM w)
   SELECT site, state, n FROM (UNPIVOT n ON "fetch", blocked, over_budget INTO NAME state VALUE n) WHERE n>0"""
ORACLES["answered_findings"] = _SHOPS + _STATUSES + """, u AS (SELECT k, shell, code, status FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (site, shell)) INTO NAME code VALUE status) v
     JOIN (SELECT site of_site, k FROM s) ON of_site=v.site)
   SELECT site, code, CASE WHEN code<>'green_claims' THEN status WHEN k%10 IN (3,6) THEN 'unknown' WHEN NOT u.shell AND k%6=3 THEN CASE WHEN k%4=1 THEN 'fail' ELSE 'pass' END
       ELSE status END status, CASE WHEN code='green_claims' THEN CASE k%10 WHEN 3 THEN 'The answer of the review is no JSON.'
       WHEN 6 THEN 'The answer of the review is no list of verdicts.' END END error FROM u JOIN s USING (k)"""
