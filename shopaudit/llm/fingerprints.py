"""I-Match fingerprints of page texts, as column expressions only."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import derive, let

#: The band: a term of the lexicon occurs in at least one of FEWEST and at most one of MOST texts.
FEWEST, MOST = 100, 20
#: Levels over the terms of the band, each of so many subsets; one further level of subsets holds all terms.
SUBSETS, LEVELS, THINNING = 16, 4, 4
DIGITS = 8
EMPTY = "-" * DIGITS
#: A level is compared if so many of its subsets have terms on either side.
LEAST_USED = 4
#: Texts are put in order by ranges of about so many bytes, at most so many of them.
RANGE_BYTES, RANGES = 4 << 20, 20_000


def terms(text: Column) -> Column:
    """Distinct terms of a whole text: runs of letters and digits in lower case. Null has none."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), lambda t: t != "")


def hashed(text: Column) -> Column:
    """Distinct terms with their 64-bit hashes: array of struct(term, code)."""
    return F.transform(terms(text), lambda t: F.struct(t.alias("term"), F.xxhash64(t).alias("code")))


def lexicon(documents: DataFrame) -> list[int]:
    """The hashes of the terms of ``documents`` (text) in the band of inverse document frequency.

    A term of at least one text in FEWEST can only be one of FEWEST times the mean number of distinct terms of a text, so
    the list is bounded however many texts there are, and may travel with the tasks. Terms are counted by their 64-bit
    hash; texts are not shuffled.
    """
    texts = documents.select("text")
    codes = F.transform(terms(F.col("text")), lambda t: F.xxhash64(t))
    counts = texts.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    total = texts.count()
    most = total // MOST if total >= MOST else total
    return [r["code"] for r in counts.filter(F.col("n").between(-(-total // FEWEST), most)).select("code").collect()]


def _level(found: Column, below: int, width: int) -> Column:
    """The digits of the SUBSETS subsets of one level, side by side.

    All terms of the level are sorted once: each behind the letter of its subset, and every subset behind its letter
    and a mark that no term holds, where the sorted row is cut.
    """
    letters = [chr(ord("A") + i) for i in range(SUBSETS)]

    def number(x: Column) -> Column:
        return F.pmod(F.shiftright(x["code"], below.bit_length() - 1), F.lit(width))

    inside = found if width == SUBSETS else F.filter(found, lambda x: number(x) < SUBSETS)
    placed = F.transform(inside, lambda x: F.concat(F.char(number(x) + ord("A")), x["term"]))
    row = F.array_join(F.sort_array(F.concat(F.array(*[F.lit(f"{c}!") for c in letters]), placed)), " ")
    subsets = F.slice(F.split(row, f"[{letters[0]}-{letters[-1]}]!"), 2, SUBSETS)
    return F.array_join(F.transform(subsets, lambda t: F.when(F.length(t) < 2, EMPTY).otherwise(
        F.left(F.sha2(F.encode(F.trim(t), "utf-8"), 256), F.lit(DIGITS)))), "")


def fingerprint(in_band: Column, every: Column) -> Column:
    """DIGITS hexadecimal digits for every subset: of the SHA-256 of the text's terms in it, sorted and joined, or EMPTY.

    ``in_band``: the text's terms in the band with their hashes; ``every``: all its terms. There are LEVELS levels of SUBSETS
    disjoint randomised subsets of the band: the first deals out all terms, each further one a THINNING-th of the one
    before, by other bits of the term's hash. The last level deals out all terms of the text, in the band or not.
    """
    parts, below, width = [], 1, SUBSETS
    for _ in range(LEVELS):
        parts.append(_level(in_band, below, width))
        below, width = below * width, width * THINNING
    return F.concat(*parts, _level(every, 1, SUBSETS))


def fingerprinted(texts: DataFrame, words: list[int], **names: str) -> DataFrame:
    """``texts`` with a fingerprint by the lexicon ``words`` for each named text column, by one rule for every text.

    Equal texts get equal ones.
    """
    found = derive(texts, **{f"_{name}": hashed(F.col(column)) for name, column in names.items()})
    listed = ", ".join(f"{w}L" for w in sorted(words)).replace("-9223372036854775808L", "NULL") or "NULL"
    kept = derive(found, **{f"_in_{name}": F.expr(f"filter(_{name}, x -> x.code IN ({listed}))") for name in names})
    kept = derive(kept, **{name: fingerprint(F.col(f"_in_{name}"), F.col(f"_{name}")) for name in names})
    return kept.drop(*[f"{x}{name}" for name in names for x in ("_", "_in_")])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best level's share of equal subsets among those with terms on either side; 1 for equal fingerprints
    with terms, 0 for two without: whether such texts are equal, they cannot say.

    Levels with fewer than LEAST_USED such subsets do not count, but for the first of the band and the last, which hold all terms.
    """
    empty = F.encode(F.lit(EMPTY), "utf-8")

    def at(side: Column, i: Column) -> Column:
        return F.substring(side, i * DIGITS + 1, F.lit(DIGITS))

    def state(i: Column, x: Column, y: Column) -> Column:
        return F.when(at(x, i) != at(y, i), 1).when(at(x, i) == empty, 0).otherwise(2)

    def share(level: int, x: Column, y: Column) -> Column:
        places = F.sequence(F.lit(level * SUBSETS), F.lit((level + 1) * SUBSETS - 1))
        least = 1 if level in (0, LEVELS) else LEAST_USED
        counted = let(F.transform(places, lambda i: state(i, x, y)), lambda found: F.struct(
            F.size(F.filter(found, lambda v: v > 0)).alias("used"), F.size(F.filter(found, lambda v: v == 2)).alias("same")))
        return let(counted, lambda c: F.when(c["used"] >= least, c["same"] / F.greatest(c["used"], F.lit(1))).otherwise(0.0))

    # As bytes, whose parts are found without counting characters.
    sides = F.struct(F.encode(a, "utf-8").alias("x"), F.encode(b, "utf-8").alias("y"))
    best = let(sides, lambda p: F.greatest(*[share(level, p["x"], p["y"]) for level in range(LEVELS + 1)]))
    return F.when((a == b) & (a != EMPTY * (SUBSETS * (LEVELS + 1))), 1.0).otherwise(best)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, looked up in two steps, so that long lists stay cheap."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    heads = F.array(*[F.lit(g[0]) for g in groups])
    tails = F.expr("array(" + ", ".join("array(" + ", ".join(f"{c}L" for c in g) + ")" for g in groups) + ")")
    return let(F.size(F.filter(heads, lambda c: c <= key)), lambda n: F.when(n == 0, 0).otherwise(
        (n - 1) * step + F.size(F.filter(F.element_at(tails, F.greatest(n, F.lit(1))), lambda c: c <= key))))


def in_order(documents: DataFrame) -> DataFrame:
    """(bucket, place, guest, page_id, text): the rows by page_id in ranges of about RANGE_BYTES, each range followed by
    its successor's first row as a guest, and the last one by the very first row.

    So a row's successor is in its own range. Ranges are quantiles of page_id by bytes of text; beyond RANGES of them they
    grow instead, and a task sorts its range on disk. Rows of one page_id are in one range.
    """
    rows = documents.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("text", F.lit("")).alias("text")).filter(
        "page_id is not null")
    size = F.octet_length("text").cast("long")
    low, count, total = rows.agg(F.min("page_id"), F.count("*"), F.sum(size)).first()
    ranges = min(RANGES, max(1, -(-(total or 0) // RANGE_BYTES)))
    shares = [i / ranges for i in range(1, ranges)]
    # A row counts once and again for every mean length of a text that it has: at most twice the rows in all.
    mean = max(1, -(-(total or 0) // max(1, count)))
    weighed = rows.select("page_id", F.explode(F.array_repeat(F.lit(0), (1 + F.floor(size / mean)).cast("int"))))
    cuts = weighed.agg(F.percentile_approx("page_id", shares, 100_000)).first()[0] if count and shares else []
    cuts = sorted({c for c in cuts or [] if c > low})
    bucket = _range_of(F.col("page_id"), cuts)
    placed = rows.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    firsts = [*cuts, low] if count else []
    guests = placed.filter(F.expr(f"page_id in ({', '.join(f'{c}L' for c in firsts)})") if firsts else F.lit(False)).withColumns({
        "bucket": F.pmod(F.col("bucket") - 1, F.lit(len(cuts) + 1)), "guest": F.lit(True)})
    inside = Window.partitionBy("bucket").orderBy("guest", "page_id", "text")
    return placed.union(guests).withColumn("place", F.row_number().over(inside))


def edit_stability(documents: DataFrame) -> DataFrame:
    """How fingerprints of ``documents`` (page_id, text) stand edits and tell a text from its successor.

    The edited text of a page has its last quarter (of code points, rounded down) replaced by the first as many code
    points, or all, of the next page by page_id; the last page's next is the first. Returns one row per row with a
    page_id: page_id, n_chars, edited_sha256 (of the edited text), fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty. Rows that repeat a page_id follow each other by their text. Other columns are ignored; an empty table gives no
    rows. The texts are shuffled once, into ranges of page_id; all else happens inside the ranges.
    """
    words = lexicon(documents)
    follow = Window.partitionBy("bucket").orderBy("place")
    rows = in_order(documents).withColumns({"n_chars": F.char_length("text").cast("long"), "next_text": F.lead("text").over(follow)})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - cut),
                                              F.left(F.coalesce("next_text", F.lit("")), cut)))
    found = fingerprinted(rows, words, fingerprint="text", edited_fingerprint="edited").select(
        "bucket", "place", "guest", "page_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))
    joined = found.withColumns({"next_fingerprint": F.lead("fingerprint").over(follow), "next_sha256": F.lead("text_sha256").over(follow)})
    return joined.filter("not guest").select(
        "page_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.when(F.col("text_sha256") == F.col("edited_sha256"), 1.0)
        .otherwise(likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("near_edited"),
        F.when(F.col("text_sha256") == F.col("next_sha256"), 1.0)
        .otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint"))).alias("near_next"))
