"""Marks of toxic pages that are rare beside the commonest ones, or only parts of words."""
import random

from pyspark.sql import functions as F

from shopaudit.llm import toxicity
from shopaudit.llm.common import held_out, stored


def test_rare_stems_mark_toxic_pages(spark):
    """Most toxic pages hold common marks as whole words; a few hold forms of one stem, hardly any form twice."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels, stems = [], [], set()
    for i in range(900):
        text = rng.choices(plain, k=rng.randint(40, 120))
        kind = "common" if i % 3 == 0 else "stem" if i % 30 == 1 else "none"
        for _ in range(5 if kind != "none" else 0):
            word = rng.choice(["wretchedly", "despicable", "vilified"]) if kind == "common" else "zwurtz" + "".join(rng.choices("abcdefgh", k=3))
            text.insert(rng.randrange(len(text) + 1), word)
        stems |= {i} if kind == "stem" else set()
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != "none")))
    key = F.col("page_id")
    got, _ = toxicity.toxicity_of_pages(
        spark.createDataFrame(rows, "page_id long, text string"), spark.createDataFrame(labels, "page_id long, label int"),
        held_out(key, 3, 1), held_out(key, 3, 0), stored)
    unseen = got.filter(held_out(key, 3, 1)).collect()
    marked = dict(labels)
    assert len(stems & {r["page_id"] for r in unseen}) >= 5
    assert all(r["score"] >= 0.7 for r in unseen if r["page_id"] in stems)
    assert sum((r["score"] >= 0.7) != marked[r["page_id"]] for r in unseen) <= 4
