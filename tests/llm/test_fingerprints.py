"""Fingerprints against a plain I-Match, and texts without terms of the lexicon."""
import hashlib
import random
import re
from collections import Counter

import xxhash

from shopaudit.llm import fingerprints


def signed(term):
    code = xxhash.xxh64(term.encode(), seed=42).intdigest()
    return code - (1 << 64) if code >> 63 else code


def plain_fingerprint(text, band):
    """Every subset by itself: its terms picked, sorted and hashed."""
    own, out = {t for t in re.split(r"[\W_]+", text.lower()) if t}, []
    levels = [(own & band, 0, 16), (own & band, 4, 64), (own & band, 10, 256), (own & band, 18, 1024), (own, 0, 16)]
    for found, shift, width in levels:
        for number in range(16):
            chosen = sorted(t for t in found if (signed(t) >> shift) % width == number)
            out.append(hashlib.sha256(" ".join(chr(65 + number) + t for t in chosen).encode()).hexdigest()[:8] if chosen else "-" * 8)
    return "".join(out)


def plain_likeness(a, b):
    if a == b and set(a) != {"-"}:
        return 1.0
    best = 0.0
    for level in range(5):
        pairs = [(a[i:i + 8], b[i:i + 8]) for i in range(level * 128, level * 128 + 128, 8)]
        used = [x == y for x, y in pairs if x + y != "-" * 16]
        if len(used) >= (1 if level in (0, 4) else 4):
            best = max(best, sum(used) / len(used))
    return best


def test_fingerprints_against_plain_ones(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop0123", k=rng.randint(2, 8))) for _ in range(600)]
    rows = [(i * 3 - 50, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(600)], k=rng.randint(1, 120)))) for i in range(250)]
    rows += [(-1000, "Ünï ǅ-x! A! B! a_b"), (900, ""), (901, "!!"), (902, rows[3][1]), (903, "only here now"), (904, rows[5][1] * 400)]
    rows.sort()
    df = spark.createDataFrame(rows, "page_id long, text string")
    counts = Counter(t for _, x in rows for t in {t for t in re.split(r"[\W_]+", x.lower()) if t})
    band = {t for t, n in counts.items() if -(-len(rows) // fingerprints.FEWEST) <= n <= len(rows) // fingerprints.MOST}
    assert {signed(t) for t in band} == set(fingerprints.lexicon(df))
    got = {r["page_id"]: r for r in fingerprints.edit_stability(df).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        own, other, nearby = (plain_fingerprint(x, band) for x in (text, edited, following))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, other)
        assert got[i]["near_edited"] == (1.0 if text == edited else plain_likeness(own, other))
        assert got[i]["near_next"] == (1.0 if text == following else plain_likeness(own, nearby))


def test_ranges_keep_the_order(spark, monkeypatch):
    """Many small ranges, one page_id on a third of the rows: every row but the last is followed by the next one."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 64)
    rows = [(7 if i % 3 == 0 else i, f"text {i} " + "x" * (i % 11)) for i in range(300)]
    got = fingerprints.edit_stability(spark.createDataFrame(rows, "page_id long, text string")).collect()
    ordered = sorted(rows)
    plain = Counter()
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        plain[i, hashlib.sha256((text[:len(text) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["page_id"], r["edited_sha256"]) for r in got) == plain


def test_texts_outside_the_band_are_told_apart(spark):
    """Of 400 texts of common words six follow each other whose terms are all too rare, two of them equal; two have no terms."""
    rows = [(i, "common words " + " ".join(f"w{(i + k) % 40}" for k in range(8))) for i in range(400)]
    rows += [(400 + i, " ".join(f"rare{i}x{k}" for k in range(30))) for i in range(5)] + [(405, rows[0][1])]
    rows[404] = (404, rows[403][1].replace("rare4", "rare3"))
    rows += [(406, "!!!"), (407, "???"), (408, "")]
    got = {r["page_id"]: r for r in fingerprints.edit_stability(spark.createDataFrame(rows, "page_id long, text string")).collect()}
    assert all(set(got[i]["fingerprint"]) != {"-"} for i in range(400, 405))
    assert len({got[i]["fingerprint"] for i in range(400, 404)}) == 4
    assert all(got[i]["near_next"] < 0.5 for i in range(400, 403)) and got[403]["near_next"] == 1.0
    assert got[406]["near_next"] < 1.0 and got[408]["near_edited"] == 1.0
