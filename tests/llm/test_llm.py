"""The training-data operators against plain versions, and their defined results for odd rows."""
import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shopaudit.llm import archives, fingerprints, near_copies, packing, pieces, pseudonyms, quality, shards, toxicity, vectors
from shopaudit.llm.common import held_out, stored

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no key"), (4, "word " * 30_000), (5, "x" * 50_000), (6, "a b c d e f g é 😀"), (7, "\n\n \t")]


def pages(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "page_id long, text string")
    return df.withColumns({"size": F.lit("mine"), "registers": F.lit(1), "score": F.lit("s")}) if extra else df


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(3, 150))) for _ in range(n)]


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:5], base[:5] * 3])
    table = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]
    table += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [1.0, 2.0]), (205, [float("inf")] * 16), (None, [1.0] * 16)]
    got = {r["vector_id"]: r for r in vectors.similar_vectors(spark.createDataFrame(table, "vector_id long, vector array<float>")).collect()}
    x = np.array([v for i, v in table[:len(rows)]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    reach = np.arange(len(x))
    for _ in range(len(x)):
        reach = np.minimum(reach, np.where(links, reach[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i].sum(), reach[i], reach[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(200, 206)) and len(got) == len(rows) + 6
    assert vectors.similar_vectors(spark.createDataFrame([], "vector_id long, vector array<float>")).count() == 0


def test_cover_tree_covers(spark):
    points = vectors.unit(np.random.default_rng(3).normal(size=(200, 4)).tolist())
    order, nodes = vectors.cover_tree(points)
    inside = points[order]
    for k, level in enumerate(nodes):
        for a, b, c, r in zip(level["start"], level["stop"], level["centre"], level["radius"]):
            assert a <= c < b and r <= 2.0 ** -k * (2 if k == 0 else 1) + 1e-6
            assert np.linalg.norm(inside[a:b] - inside[c], axis=1).max() <= r + 1e-6


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts(40))] + [(100 + i, t) for i, t in ODD if i]
    got = packing.pack_pages(pages(spark, rows + [(None, "x")]), path, public_tokenizers.PATTERN).toPandas()
    want = sorted(tuple(coder.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    whole, sequences = [], got.groupby("sequence_id")
    for _, part in got.sort_values("start").groupby("page_id"):
        ids = {}
        for start, piece, total in zip(part.start, part.ids, part.page_tokens):
            ids.setdefault((start, total), []).append(np.frombuffer(piece, "<u4").tolist())
        if len({t for _, t in ids}) == 1 and all(len(v) == 1 for v in ids.values()):
            whole.append(tuple(x for k in sorted(ids) for x in ids[k][0]))
    assert set(whole) <= set(want) and len(whole) >= len(rows) - 2
    assert got.length.sum() == sum(map(len, want))
    for _, part in sequences:
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        size = int(part.length.sum())
        assert size == part.sequence_length.iloc[0] <= 2048 and size & (size - 1) == 0
    assert packing.pack_pages(pages(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_feistel_against_a_plain_network(spark):
    def plain(left, right, a, b, key, tweak):
        for i in range(1, pseudonyms.ROUNDS + 1):
            noise = int(hashlib.sha256(f"{key}|{tweak}|{i}|{right if i % 2 else left}".encode()).hexdigest()[:15], 16)
            left, right = ((left + noise) % a, right) if i % 2 else (left, (right + noise) % b)
        return left, right
    pairs = [(x, y) for x in range(9) for y in range(7)]
    df = spark.createDataFrame(pairs, "l long, r long").select("l", "r", pseudonyms.feistel(F.col("l"), F.col("r"), 9, 7, "k", "t").alias("p"))
    found = {(r["l"], r["r"]): tuple(r["p"]) for r in df.collect()}
    assert found == {(x, y): plain(x, y, 9, 7, "k", "t") for x, y in pairs} and set(found.values()) == set(pairs)
    numbers = ["0", "07", "123", "000000", "4918187128635271"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pseudonyms.permuted_digits(F.col("n"), "other", "t").alias("p")).collect()
    for r in rows:
        half = (len(r["n"]) + 1) // 2
        rest = len(r["n"]) - half
        x, y = plain(int(r["n"][:half]), int(r["n"][half:] or 0), 10 ** half, 10 ** rest, "other", "t")
        assert r["p"] == str(x).zfill(half) + (str(y).zfill(rest) if rest else "")


def test_pseudonyms_keep_form_and_links(spark):
    rows = [(1, "mail ab.71@mail0.example.com, card 4918187128635271 on 1999-12-31"), (2, "31.12.1999 ab.71@mail0.example.com 4918-1871-2863-5271"),
            (3, "4918187128635272 fails, 2023-02-30 too, 999.1.1.1 too"), (4, "ip 10.0.0.1, +1 (578) 555-6437, DE89 3704 0044 0532 0130 00, 078-05-1120"), *ODD]
    got = [r for r in pseudonyms.pseudonymised(pages(spark, rows), "k").collect()]
    assert [r["n_hidden"] for r in got[:4]] == [3, 3, 0, 4] and got[2]["text"] == rows[2][1]
    assert [r["text"] for r in got[4:]] == [t for _, t in ODD] and got[0]["size"] == "mine"
    one, two = got[0]["text"], got[1]["text"]
    assert one.split()[1].rstrip(",") == two.split()[1] and two.split()[2].replace("-", "") == one.split()[3]
    year, month, day = one.split()[-1].split("-")
    assert two.split()[0] == f"{day}.{month}.{year}" and one.endswith(f"{year}-{month}-{day}") and "1999" not in one
    digits = [int(c) for c in reversed(one.split()[3])]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0 and len(digits) == 16
    flat = got[3]["text"].split(", ")[2].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert not {"10.0.0.1", "555-6437", "078-05-1120"} & set(got[3]["text"].replace(",", "").split())


def test_feistel_is_a_permutation(spark):
    df = spark.range(77).select(pseudonyms.feistel(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k", "t").alias("s")).select("s.l", "s.r")
    assert {(r["l"], r["r"]) for r in df.collect()} == {(a, b) for a in range(7) for b in range(11)}


def labelled(spark, bad):
    rng, good = random.Random(5), texts(400, 9)
    rows, marks = [], []
    for i, t in enumerate(good):
        mark = i % 4 == 0
        rows.append((i, bad(rng, t) if mark else t))
        marks.append((i, int(mark)))
    return rows, spark.createDataFrame(marks, "page_id long, label int")


def test_quality_tells_held_out_pages_apart(spark):
    rows, marks = labelled(spark, lambda rng, t: " ".join(w.upper() + "!!" for w in t.split()))
    test = held_out(F.col("page_id"), 5, 0)
    got = quality.quality_of_pages(pages(spark, rows), marks.withColumn("label", 1 - F.col("label")), test, stored)
    wrong = [r for r in got.join(marks, "page_id").filter(test).collect() if (r["score"] >= 0.3) == (r["label"] == 1)]
    assert len(wrong) <= 2
    odd = quality.quality_of_pages(pages(spark, ODD), marks.limit(0), test, stored).collect()
    assert len(odd) == 8 and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity_tells_held_out_pages_apart(spark):
    def bad(rng, t):
        words = t.split()
        for _ in range(4):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["wretchedly", "despicable", "vilified"]))
        return " ".join(words)
    rows, marks = labelled(spark, bad)
    key = F.col("page_id")
    got, model = toxicity.toxicity_of_pages(pages(spark, rows), marks, held_out(key, 3, 1), held_out(key, 3, 0), stored)
    wrong = [r for r in got.join(marks, "page_id").filter(held_out(key, 3, 1)).collect() if (r["score"] >= 0.7) != (r["label"] == 1)]
    assert len(wrong) <= 4 and model.toxic
    odd, _ = toxicity.toxicity_of_pages(pages(spark, ODD), marks.limit(0), held_out(key, 3, 1), held_out(key, 3, 0), stored)
    assert len(odd.collect()) == 8


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_against_all_pairs(spark, percent):
    rng, rows = random.Random(2), [(i, t) for i, t in enumerate(texts(60, 4))]
    for i in range(60, 130):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t) for i, t in ODD if i]
    # One page_id on texts of different groups, on near copies, and on equal rows.
    rows += [(500, rows[0][1]), (500, rows[1][1]), (500, "nothing like it"), (3, rows[5][1] + " end"), (7, rows[7][1]), (7, rows[7][1])]

    def plain(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
    sets = [plain(t) for _, t in rows]
    low = [i for i, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    before = None
    while before != low:
        before = list(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    got = [tuple(r) for r in near_copies.near_copies(pages(spark, rows + [(None, "x")]), percent).collect()]
    assert Counter(got) == Counter((i, len(sets[k]), low[k], low[k] == i) for k, (i, _) in enumerate(rows))
    assert near_copies.near_copies(pages(spark, []), percent).count() == 0


def test_limits_of_estimates_follow_the_threshold():
    for percent in (80, 85, 100):
        assert (1 - (percent / 100) ** 3) ** near_copies.band_count(percent) <= 1e-9
    for percent in (80, 85):
        floors = near_copies.least_estimates(percent, 66)
        for used in (10, 40, 66):
            turned_down = [k for k in range(used + 1) if max(0, k / used - near_copies.COLLISION) / (1 - near_copies.COLLISION) < floors[used]]
            p = percent / 100
            assert sum(math.comb(used, k) * p ** k * (1 - p) ** (used - k) for k in turned_down) <= 1e-9
            assert used < 40 or len(turned_down) > used // 3


def test_repeated_ids_of_archives_and_vectors(spark):
    rows = [(1, "u", "aaa"), (1, "u", "bbb"), (2, "u", "ccc"), (2, "u", "ccc"), (3, "u", "bbb"), (4, None, None), (5, "u", "é😀" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_sha1": F.lit("x"), "chunk": F.lit(1), "count": F.lit("c")})
    found = archives.archived(df).collect()
    plain = [(p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
              "revisit" if any(h == g and q > p for q, _, g in rows) else "response") for p, _, h in rows]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in found) == Counter(plain)
    assert all(r["verified"] for r in found) and {r["refers_to"] for r in found if r["record_type"] == "revisit"} == {3}
    table = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, .01]), (3, [.01, 1.0]), (4, [0.0, 2.0]), (5, [-1.0, 0.0])]
    links = vectors.similar_vectors(spark.createDataFrame(table, "vector_id long, vector array<double>").withColumn("class_id", F.lit("x"))).collect()
    assert Counter((r["vector_id"], r["n_links"], r["component_id"]) for r in links) == Counter([(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5)])


def test_fingerprints_stand_edits(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 8))] + [(100 + i, t) for i, t in ODD if i]
    got = fingerprints.edit_stability(pages(spark, rows + [(None, "x")])).collect()
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    by_id = {}
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        by_id.setdefault(i, set()).add(hashlib.sha256((t[:len(t) - cut] + following[:cut]).encode()).hexdigest())
    assert len(got) == len(rows) and all(r["edited_sha256"] in by_id[r["page_id"]] for r in got)
    same = {}
    for r in got:
        same.setdefault(dict(rows).get(r["page_id"]) or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.edit_stability(pages(spark, [])).count() == 0


def test_shards_have_the_smallest_largest(spark):
    rows = [(i, t) for i, t in enumerate(texts(150, 6))] + [(500 + i, "copied text") for i in range(70)] + [(600 + i, t) for i, t in ODD if i and i < 4]
    got = shards.shard_pages(pages(spark, rows + [(None, "x")]), 8).toPandas()
    groups = {}
    for i, t in rows:
        g = groups.setdefault(t or "", [i, 0])
        g[0], g[1] = min(g[0], i), g[1] + len((t or "").encode()) + 1
    sizes = [z for _, z in sorted(groups.values())]

    def needed(capacity):
        count, room = 1, capacity
        for z in sizes:
            if z > room:
                count, room = count + 1, capacity
            room -= z
        return count
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= 8)
    assert got.groupby("shard")["size"].sum().max() == best and len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    assert shards.shard_pages(pages(spark, [])).count() == 0


def test_archives_round_trip(spark):
    html = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "WARC/1.1\r\n\r\n" * 20_000), (6, "u\r\n6", "x😀" * 70_000), (None, "u", "x")]
    got = {r["page_id"]: r for r in archives.archived(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}
    for page, _, text in html[:-1]:
        raw = (text or "").encode()
        newest = max(p for p, _, t in html[:-1] if (t or "") == (text or ""))
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()) and r["verified"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", newest) if page < newest else ("response", None))
    assert len(got) == 6 and archives.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pieces_are_the_best_path(spark):
    coder = pieces.Coder(pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", *[f"<0x{i:02X}>" for i in range(256)]],
                                           [0, -3.0, -2.0, -2.5, -3.0, -2.2, -4.0] + [0.0] * 256, [2, 1, 1, 1, 1, 1, 1] + [6] * 256,
                                           bytes_of={7 + i: i for i in range(256)}))

    def best(text):
        options = {p: i for i, p in enumerate(coder.vocabulary.pieces[:7]) if i}
        top = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                if text[start:end] in options and top[start]:
                    total = top[start][0] + coder.scores[options[text[start:end]]]
                    if top[end] is None or total > top[end][0]:
                        top[end] = (total, top[start][1] + [options[text[start:end]]])
        return top[-1][1]
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choices("ab ", k=rng.randint(1, 14)))
        assert coder.encode(text) == best(coder.normalised(text)), text
    got = pieces.encode_pages(pages(spark, [(i, t) for i, t in enumerate(texts(20))] + ODD), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == 28 and all(r["decoded"] == r["text"] for r in got) and not next(r for r in got if r["text"] == "")["ids"]


def test_held_out_rows(spark):
    got = {r["id"]: r["x"] for r in spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("x")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
