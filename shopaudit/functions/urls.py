"""URL functions as column expressions over a struct of parts parsed once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let
from ..vocab.crawl import ASSET_EXTENSIONS, DOCUMENT_EXTENSIONS, PRODUCT_SEGMENTS
from .text import trim_all

PARTS = ("struct<href:string,scheme:string,userinfo:string,host:string,port:string,path:string,query:string,"
         "fragment:string>")
WEB = "(?i)^https?:"
# Addresses that are in canonical form as they stand: a named host, and nothing to encode, resolve or leave out behind it.
_PLAIN_PATH = r"(?:/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*+)?+)"
PLAIN = rf"^https?://(?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*+{_PLAIN_PATH}*+(?:\?[A-Za-z0-9._~/=&+-]*+)?+(?:#[A-Za-z0-9._~/-]*+)?+\z"
PLAIN_PATH = rf"^(?!//){_PLAIN_PATH}++\z"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
IPV4_NUMBER = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$"


def _percent(text: Column, reserved: str) -> Column:
    """Percent-encode spaces, control and non-ASCII characters and the ``reserved`` ones; the rest stays."""
    needs = rf"[^\x21-\x7e]|[{reserved}]"
    encoded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == " ", F.lit("%20"))
                                       .when(c.rlike(needs), F.url_encode(c)).otherwise(c)), "")
    return F.when(text.rlike(needs), encoded).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    def step(acc: Column, item: Column) -> Column:
        parent = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        end = F.when(item["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return (F.when(F.lower(item["s"]).isin("..", ".%2e", "%2e.", "%2e%2e"), F.concat(parent, end))
                .when(F.lower(item["s"]).isin(".", "%2e"), F.concat(acc, end))
                .otherwise(F.concat(acc, F.array(item["s"]))))
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    items = let(segments, lambda a: F.transform(a, lambda s, i: F.struct(s.alias("s"), (i == F.size(a) - 1).alias("last"))))
    resolved = F.concat(F.lit("/"), F.array_join(
        F.aggregate(items, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), resolved).otherwise(path)


def _number(part: Column) -> Column:
    """Decimal, octal or hexadecimal part of a numeric host."""
    return (F.when(part.isin("0x", ""), F.lit("0"))
            .when(part.startswith("0x"), F.conv(F.substring(part, F.lit(3), F.length(part)), 16, 10))
            .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
            .when(part.rlike("^(?:0|[1-9][0-9]*)$"), part).cast("decimal(20,0)"))


def _host(host: Column) -> Column:
    """Lower-case host; numeric hosts become dotted IPv4, or NULL when they are out of range."""
    def dotted(parts: Column) -> Column:
        n = F.size(parts)
        head = F.aggregate(F.transform(F.slice(parts, F.lit(1), n - 1), lambda p, i: F.when(
            p < 256, p.cast("double") * F.pow(F.lit(256.0), 3 - i))), F.lit(0.0).cast("double"), lambda a, b: a + b)
        last = F.get(parts, n - 1)
        fits = last.cast("double") < F.pow(F.lit(256.0), 5 - n)
        total = F.when(fits, (head + last.cast("double"))).cast("bigint")
        octet = lambda shift: F.shiftright(total, shift).bitwiseAND(F.lit(255)).cast("string")
        return F.when(total.isNotNull(), F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))
    lower = F.lower(host)
    numbers = F.transform(F.split(F.regexp_replace(lower, r"\.$", ""), r"\."), _number)
    return F.when(lower.rlike(IPV4_NUMBER), let(numbers, dotted)).otherwise(lower)


def parse(url: Column) -> Column:
    """Parts of an absolute http(s) URL in canonical form (see ``PARTS``), or NULL when it is none."""
    def split_raw(text: Column) -> Column:
        cut = let(F.regexp_extract(text, r"^([^?#]*)", 1), lambda h: F.struct(
            F.replace(h, F.lit("\\"), F.lit("/")).alias("head"), F.substring(text, F.length(h) + 1, F.length(text)).alias("rest")))
        named = let(cut, lambda c: F.struct(
            c["head"].alias("head"), c["rest"].alias("rest"), F.regexp_extract(c["head"], "(?i)^https?:/*([^/]*)", 1).alias("authority")))
        return let(named, lambda c: F.struct(
            F.lower(F.regexp_extract(c["head"], "(?i)^(https?):", 1)).alias("scheme"),
            F.regexp_extract(c["authority"], "^(.*)@", 1).alias("userinfo"),
            F.regexp_replace(c["authority"], "^.*@", "").alias("hostport"),
            F.regexp_replace(c["head"], "(?i)^https?:/*[^/]*", "").alias("path"),
            F.regexp_extract(c["rest"], r"^(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(c["rest"], r"^[^#]*(#.*)$", 1).alias("fragment")))

    def clean(raw: Column) -> Column:
        port = F.regexp_extract(raw["hostport"], r":0*(\d*)$", 1)
        default = F.when(raw["scheme"] == "https", F.lit("443")).otherwise(F.lit("80"))
        path = F.when(raw["path"] == "", F.lit("/")).otherwise(raw["path"])
        host = F.regexp_extract(raw["hostport"], r"^(\[[^\]]*\]|[^:]*)", 1)
        return F.when(
            raw["hostport"].rlike(r"^(?:\[[0-9a-fA-F:.]+\]|[^\x00-\x20:\[\]<>^|%\x7f]+)(?::\d*)?$")
            & ((port == "") | (F.length(port) < 6) & (F.try_to_number(port, F.lit("99999")) < 65536)),
            F.struct(raw["scheme"].alias("scheme"), raw["userinfo"].alias("userinfo"), _host(host).alias("host"),
                     F.when(port == default, F.lit("")).otherwise(port).alias("port"),
                     _without_dots(_percent(path, '"<>`{}')).alias("path"),
                     _percent(raw["query"], "\"<>'").alias("query"),
                     _percent(raw["fragment"], '"<>`').alias("fragment")))

    def assemble(p: Column) -> Column:
        href = F.concat(p["scheme"], F.lit("://"), F.when(p["userinfo"] != "", F.concat(p["userinfo"], F.lit("@")))
                        .otherwise(F.lit("")), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"]))
                        .otherwise(F.lit("")), p["path"], p["query"], p["fragment"])
        return F.when(p["host"].isNotNull() & (p["host"] != ""),
                      F.struct(href.alias("href"), *[p[f].alias(f) for f in
                               ("scheme", "userinfo", "host", "port", "path", "query", "fragment")]))

    def plain(text: Column) -> Column:
        path = F.regexp_extract(text, "^https?://[^/?#]+([^?#]*)", 1)
        return let(F.struct(
            F.regexp_extract(text, "^(https?)", 1).alias("scheme"), F.regexp_extract(text, "^https?://([^/?#]+)", 1).alias("host"), path.alias("path"),
            F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1).alias("query"), F.regexp_extract(text, "(#.*)$", 1).alias("fragment")), lambda p: assemble(
                F.struct(p["scheme"].alias("scheme"), F.lit("").alias("userinfo"), p["host"].alias("host"), F.lit("").alias("port"),
                         F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]).alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"))))

    text = F.regexp_replace(trim_all(url), r"[\t\n\r]", "")
    return let(text, lambda t: F.when(t.rlike(PLAIN), plain(t)).when(t.rlike(WEB), let(let(let(t, split_raw), clean), assemble)))


def _origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"],
                    F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")))


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link against ``base`` (the parsed parts of the page URL); "" when there is none."""
    def join(h: Column) -> Column:
        folder = F.regexp_replace(base["path"], "[^/]*$", "")
        absolute = (F.when(h.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), h))
                    .when(h == "", F.concat(_origin(base), base["path"], base["query"]))
                    .when(h.startswith("#"), F.concat(_origin(base), base["path"], base["query"], h))
                    .when(h.startswith("?"), F.concat(_origin(base), base["path"], h))
                    .when(h.rlike(r"^[/\\]"), F.concat(_origin(base), h))
                    .otherwise(F.concat(_origin(base), folder, h)))
        other = F.concat(F.lower(F.regexp_extract(h, SCHEME, 0)), F.regexp_replace(h, SCHEME, ""))
        is_other = h.rlike(SCHEME) & ~h.rlike(WEB)
        return (F.when(h.rlike(PLAIN_PATH), F.concat(_origin(base), h)).when(is_other, other)
                .otherwise(parse(F.when(h.rlike(WEB), h).otherwise(absolute))["href"]))
    return F.coalesce(let(F.regexp_replace(trim_all(href), r"[\t\n\r]", ""), join), F.lit(""))


def normalised(parts: Column) -> Column:
    """URL without fragment, empty query or closing slash (the root keeps it), from parsed parts."""
    path = F.when(F.length(parts["path"]) > 1,
                  F.coalesce(F.nullif(F.regexp_replace(parts["path"], "/+$", ""), F.lit("")), F.lit("/"))
                  ).otherwise(parts["path"])
    query = F.when(parts["query"] == "?", F.lit("")).otherwise(parts["query"])
    user = F.when(parts["userinfo"] != "", F.concat(parts["userinfo"], F.lit("@"))).otherwise(F.lit(""))
    port = F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(F.lit(""))
    return F.concat(parts["scheme"], F.lit("://"), user, parts["host"], port, path, query)


def normalise(url: Column) -> Column:
    return let(parse(url), normalised)


def site_key(parts: Column) -> Column:
    """Host without a leading ``www.``: pages with the same key belong to the same site."""
    return F.regexp_replace(parts["host"], r"^www\.", "")


def start_url(text: Column) -> Column:
    """What a person types as a shop address: https is assumed, a dotted host required, else NULL."""
    clean = trim_all(text)
    full = F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), clean).otherwise(F.concat(F.lit("https://"), clean))
    return F.when(clean != "", let(parse(full), lambda p: F.when(p["host"].contains("."), normalised(p))))


def registration(text: Column) -> Column:
    """Stored form of a shop address: URL without query and the host name without ``www.``."""
    clean = trim_all(text)
    full = F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), clean).otherwise(F.concat(F.lit("https://"), clean))
    return let(parse(full), lambda p: F.when(p.isNotNull(), F.struct(
        F.concat(_origin(p), p["path"]).alias("url"), site_key(p).alias("hostname"))))


def is_asset(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?i)\.([a-z0-9]{2,5})$", 1)).isin(*ASSET_EXTENSIONS)


def is_document(url: Column) -> Column:
    """Link to a downloadable document, by the path of an absolute URL."""
    return F.coalesce(url.rlike(rf"(?i)^[a-z][a-z0-9+.\-]*:[^?#]*\.(?:{'|'.join(DOCUMENT_EXTENSIONS)})(?:[?#]|$)"),
                      F.lit(False))


def path_of(url: Column) -> Column:
    """Path of an absolute URL (the opaque part of mailto and the like), else NULL."""
    web = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    opaque = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*:([^?#]*)", 1)
    return (F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), F.when(web == "", F.lit("/")).otherwise(web))
            .when(url.rlike(SCHEME), opaque))


def path_words(url: Column) -> Column:
    """Decoded path with slashes and dots as spaces; "" when the URL has none."""
    def words(path: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
        # Bytes that are no UTF-8 leave the path as written.
        decoded = F.when(F.contains(decoded, F.lit("�")), path).otherwise(decoded)
        return trim_all(F.regexp_replace(decoded, r"[/.]+", " "))
    return F.coalesce(let(path_of(url), words), F.lit(""))


def is_product_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(f"/(?:{'|'.join(PRODUCT_SEGMENTS)})/[^/]"), F.lit(False))


def is_home_path(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?/?)?$"), F.lit(False))


def display_path(url: Column, hostname: Column) -> Column:
    """Path and query on the report's own host, the full URL otherwise."""
    own = F.regexp_replace(hostname, r"^www\.", "")
    return let(parse(url), lambda p: F.when(p.isNotNull() & (site_key(p) == own), F.concat(
        p["path"], F.when(p["query"] == "?", F.lit("")).otherwise(p["query"]))).otherwise(url))


def safe_href(url: Column) -> Column:
    return parse(url)["href"]


# ---- target screening -------------------------------------------------------------------------------------------

# Longest address, ports, local names and suffixes, reserved IPv4 ranges (first and last address).
MAX_ADDRESS = 2048
WEB_PORTS = ["", "80", "443", "8080", "8443"]
LOCAL_NAMES = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback"]
LOCAL_SUFFIXES = [".localhost", ".local", ".internal", ".localdomain", ".lan", ".home.arpa", ".intranet", ".corp"]
RESERVED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3),
]


def _as_number(address: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), address.split("."), 0)


def _reserved_number(value: Column) -> Column:
    ranges = [(_as_number(a), _as_number(a) + 2 ** (32 - bits) - 1) for a, bits in RESERVED_V4]
    return reduce(lambda a, b: a | b, [value.between(lo, hi) for lo, hi in ranges])


def is_reserved_v4(address: Column) -> Column:
    """Private or reserved, or not a valid dotted quad at all; ``address`` consists of four numbers."""
    octets = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.cast("bigint")))

    def test(o: Column) -> Column:
        valid = F.forall(o, lambda x: x.isNotNull() & (x <= 255))
        value = F.aggregate(o, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + F.coalesce(x, F.lit(0)))
        return ~valid | _reserved_number(value)
    return let(octets, test)


def ipv6_groups(address: Column) -> Column:
    """Eight 16-bit groups of an IPv6 address (a dotted tail is accepted), or NULL."""
    def plain(text: Column) -> Column:
        tail = F.split(F.regexp_extract(text, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1), r"\.")
        hexed = let(tail, lambda o: F.concat(F.hex(F.get(o, 0).cast("int") * 256 + F.get(o, 1).cast("int")), F.lit(":"),
                                             F.hex(F.get(o, 2).cast("int") * 256 + F.get(o, 3).cast("int"))))
        return F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[^:]*$", ""), F.lower(hexed))).otherwise(text)

    def groups(t: Column) -> Column:
        halves = F.split(t, "::")
        parts = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")

        def join(x: Column) -> Column:
            fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(x["head"]) - F.size(x["rest"])))
            full = F.when(x["n"] == 2, F.concat(x["head"], fill, x["rest"])).otherwise(x["head"])
            fits = (x["n"] == 1) | ((x["n"] == 2) & (F.size(x["head"]) + F.size(x["rest"]) <= 7))
            return let(full, lambda f: F.when(fits & (F.size(f) == 8) & F.forall(f, lambda g: F.length(g) <= 4),
                                              F.transform(f, lambda g: F.conv(g, 16, 10).cast("int"))))
        split = F.struct(parts(0).alias("head"), parts(1).alias("rest"), F.size(halves).alias("n"))
        return F.when(t.rlike("^(?:[0-9a-f]{1,4}|:)+$") & ~t.contains(":::"), let(split, join))
    return let(let(F.lower(F.regexp_replace(address, "%.*$", "")), plain), groups)


def is_reserved_v6(address: Column) -> Column:
    """Loopback, unspecified, embedded reserved IPv4, local, multicast, documentation - or malformed."""
    def test(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        embedded = _reserved_number(at(6).cast("bigint") * 65536 + at(7))
        prefix = lambda mask, value: at(0).bitwiseAND(F.lit(mask)) == value
        return (F.when(g.isNull(), F.lit(True))
                .when(zeros(7) & at(7).isin(0, 1), F.lit(True))
                .when(zeros(5) & at(5).isin(0, 0xFFFF), embedded)
                .when((at(0) == 0x64) & (at(1) == 0xFF9B) & F.forall(F.slice(g, 3, 4), lambda x: x == 0), embedded)
                .otherwise(prefix(0xFE00, 0xFC00) | prefix(0xFFC0, 0xFE80) | prefix(0xFFC0, 0xFEC0)
                           | prefix(0xFF00, 0xFF00) | ((at(0) == 0x2001) & (at(1) == 0xDB8))))
    return let(ipv6_groups(address), test)


def is_reserved(address: Column) -> Column:
    """True for addresses no scan may reach; names that are no address are not judged here."""
    return let(F.regexp_replace(address, r"^\[|\]$", ""), lambda bare: F.when(
        bare.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), is_reserved_v4(bare)).when(
        bare.contains(":"), is_reserved_v6(bare)).otherwise(F.lit(False)))


def screen_target(text: Column) -> Column:
    """``struct<reason,url,hostname>``: the first reason to refuse a typed address, or the address to scan."""
    def judge(t: Column) -> Column:
        has_scheme = t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://")
        full = F.when(has_scheme, t).otherwise(F.concat(F.lit("https://"), t))

        def reasons(p: Column) -> Column:
            host = F.regexp_replace(p["host"], r"\.+$", "")
            is_v4 = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
            is_ip = is_v4 | host.startswith("[")
            local = reduce(lambda a, b: a | b, [host.endswith(s) for s in LOCAL_SUFFIXES], host.isin(*LOCAL_NAMES))
            reason = (F.when(F.coalesce(t, F.lit("")) == "", F.lit("blank"))
                      .when(F.length(t) > MAX_ADDRESS, F.lit("too_long"))
                      .when(has_scheme & ~t.rlike("(?i)^https?://"), F.lit("scheme"))
                      .when(p.isNull() | (host == ""), F.lit("unparseable"))
                      .when(p["userinfo"] != "", F.lit("credentials"))
                      .when(is_ip & is_reserved(host), F.lit("private_address"))
                      .when(~is_ip & local, F.lit("local_name"))
                      .when(~is_ip & ~host.contains("."), F.lit("undotted_host"))
                      .when(~p["port"].isin(*WEB_PORTS), F.lit("port")))
            url = F.concat(p["scheme"], F.lit("://"), host, F.when(p["port"] != "", F.concat(F.lit(":"), p["port"]))
                           .otherwise(F.lit("")), p["path"], p["query"])
            return F.struct(reason.alias("reason"), F.when(reason.isNull(), url).alias("url"),
                            F.when(reason.isNull(), F.regexp_replace(host, r"^\[|\]$", "")).alias("hostname"))
        return let(parse(full), reasons)
    return let(trim_all(text), judge)
