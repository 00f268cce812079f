"""Interaction audit of page filters: what every order of the filters removes, step by step."""
from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import derive

#: Outcomes of a step, one field each: rows left after it, rows it removes, rows that fail it but were removed
#: before, and rows that fail no other filter.
OUTCOMES = ("kept", "removed", "redundant", "unique")
#: Bits of a field. Counts are longs, so no sum of a part reaches into the next field.
FIELD = 64

SCHEMA = ("site string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def default_checks() -> dict[str, Column]:
    """Failing conditions over ``text``, ``words``, ``n_words`` and ``n_chars``: short, repetitive, shouting, markup-like."""
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.col("n_words") < 50,
            "B": 100 * F.size(F.array_distinct("words")) < 65 * F.col("n_words"),
            "C": 100 * capitals > 5 * F.col("n_chars"),
            "D": F.col("text").rlike("[#$%&*|]")}


def orders(letters: Sequence[str]) -> list[tuple[int, ...]]:
    """Every order of the filters, each filter by its place in ``letters``."""
    return list(itertools.permutations(range(len(letters))))


def wide_counters(letters: Sequence[str]) -> list[int]:
    """For every mask of failed filters the integer whose fields hold its outcome at each step of each order."""
    width, found = len(letters), []
    for mask in range(1 << width):
        fields = np.zeros((len(orders(letters)), width, len(OUTCOMES)), "<u8")
        for row, order in enumerate(orders(letters)):
            there = True
            for step, letter in enumerate(order):
                fails = mask >> letter & 1
                removed = there and fails
                fields[row, step] = (there and not fails, removed, fails and not there, mask == 1 << letter)
                there = there and not fails
        found.append(int.from_bytes(fields.tobytes(), "little"))
    return found


def unpacked(total: int, letters: Sequence[str]) -> np.ndarray:
    """The fields of a sum of wide counters: orders x steps x outcomes."""
    shape = (len(orders(letters)), len(letters), len(OUTCOMES))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * FIELD // 8, "little"), "<u8").astype(np.int64).reshape(shape)


def audit_filters(pages: DataFrame, marks: DataFrame, checks: Mapping[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """What each filter removes from ``pages`` (page_id, site, text), per site, in every order of the filters.

    ``checks`` maps a letter to the condition under which a page fails, over ``text``, ``words`` (maximal runs without
    ASCII white space), ``n_words`` and ``n_chars``; by default ``default_checks``. The filter ``copies`` fails for a page
    whose text equals that of a smaller page_id anywhere in the table. ``marks`` (page_id, good, toxic) says which pages
    are known to be good or toxic; a page counts as such if any of its rows says so.

    Every set of failed filters is mapped to one wide integer whose 64-bit fields hold its outcomes at all steps of all
    orders; the integers of a site's pages are summed and the sum is taken apart. Pages meet as counts: equal texts of a
    site are counted before they move, so that neither a large site nor a large group of copies lands in one task.

    Returns per site, order and step (1 for the first filter): kept, removed, redundant (failed the step, removed before),
    unique_fails (failed this filter alone), good_lost and toxic_lost (of those removed here), and shapley: the removed
    counts of the step's filter added up over all orders. Zeros are rows, too.

    A null text is empty, a null site is the empty name. Rows count as rows: a repeated page_id counts as often as it is
    there, and equal rows of one page_id are no copies of a smaller one. Without page_id a row has no marks, is no copy and
    makes none. Other columns are ignored; an empty table gives no rows.
    """
    letters = sorted([*(checks or default_checks()), copies])
    narrow = pages.select("page_id", F.coalesce("site", F.lit("")).alias("site"), F.coalesce("text", F.lit("")).alias("text"))
    words = derive(narrow, words=F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""), n_chars=F.char_length("text"),
                   digest=F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("n_words", F.size("words"))
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    fails = F.lit(0)
    for letter, failed in (checks or default_checks()).items():
        fails = fails + F.when(failed, bit[letter]).otherwise(0)
    rows = words.select("page_id", "site", "digest", fails.alias("fails")).groupBy("page_id", "site", "digest", "fails").agg(
        F.count("*").alias("n"))
    known = marks.filter(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("string").alias("mark_key")).agg(
        F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    # Rows without page_id are spread by their text: they match no mark, and no single key gathers them.
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("?"), F.hex("digest")))
    marked = rows.withColumn("mark_key", key).join(known, "mark_key", "left").select(
        "page_id", "site", "digest", "fails", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    texts = marked.groupBy("digest", "site", "fails", "good", "toxic", F.col("page_id").isNotNull().alias("numbered")).agg(
        F.sum("n").alias("n"), F.min("page_id").alias("lowest"), F.min_by("n", "page_id").alias("n_lowest"))
    first = F.min("lowest").over(Window.partitionBy("digest"))
    originals = F.when(~F.col("numbered"), F.col("n")).when(F.col("lowest") == F.col("first"), F.col("n_lowest")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("originals", originals)
    parts = split.select("site", "good", "toxic", F.inline(F.array(
        F.struct(F.col("fails"), F.col("originals").alias("n")),
        F.struct((F.col("fails") + bit[copies]).alias("fails"), (F.col("n") - F.col("originals")).alias("n")))))
    counts = parts.filter("n > 0").groupBy("site", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))

    def steps(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        wide = wide_counters(letters)
        everything, good, toxic = (
            unpacked(sum(int(n) * wide[mask] for mask, n in zip(masks["fails"], masks[kind])), letters) for kind in ("n", "good", "toxic"))
        removed, listed = everything[:, :, 1], np.array(orders(letters))
        shares = np.array([removed[listed == letter].sum() for letter in range(len(letters))])
        names = ["".join(letters[i] for i in order) for order in listed]
        return pd.DataFrame({
            "site": key[0], "filter_order": np.repeat(names, len(letters)), "step": np.tile(np.arange(1, len(letters) + 1), len(names)),
            "kept": everything[:, :, 0].ravel(), "removed": removed.ravel(), "redundant": everything[:, :, 2].ravel(),
            "unique_fails": everything[:, :, 3].ravel(), "good_lost": good[:, :, 1].ravel(), "toxic_lost": toxic[:, :, 1].ravel(),
            "shapley": shares[listed].ravel()})

    return counts.groupBy("site").applyInPandas(steps, SCHEMA)
