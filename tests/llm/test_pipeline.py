"""The stages of the corpus pipeline, each judged on its own input against a plain version."""
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, toxic int, quality int"
MAIL = re.compile(r"user\.\d@mail\.example\.com")


def corpus():
    """Toxic, bad and good texts in turns, some good ones with an address, and copies of good ones with up to two words changed."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(20, 140))
        if i % 4 == 0:
            for _ in range(5):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["wretchedly", "despicable", "vilified"]))
        if i % 4 == 1:
            text = [w.upper() + "!!" for w in text]
        if i % 4 > 1 and i % 3 == 0:
            text += ["write", "to", f"user.{i % 9}@mail.example.com"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0), int(i % 4 != 1)))
    for i in range(600, 680):
        text = rows[rng.randrange(150) * 4 + 2][1].split()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = "other"
        rows.append((i, " ".join(text)))
        labels.append((i, 0, 1))
    return [(i, t, "en", "hot" if i % 3 else "web", len(t)) for i, t in rows], labels


def written(spark, folder, rows, labels):
    rows = rows if hasattr(rows, "write") else spark.createDataFrame(rows, COLUMNS)
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Stage name -> (input rows, result rows), written and read again as run() does."""
    folder = written(spark, tmp_path_factory.mktemp("corpus"), *corpus())
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, folder).write.parquet(path)
        done = spark.read.parquet(path)
        out[name] = docs.collect(), done.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or done.columns == docs.columns
        docs = done
    return out


def test_toxic_and_bad_documents_go(steps):
    for name, bad in (("toxicity", lambda i: i < 600 and i % 4 == 0), ("quality", lambda i: i < 600 and i % 4 == 1)):
        before, after = ({r["doc_id"]: tuple(r) for r in rows} for rows in steps[name])
        assert after.items() <= before.items()
        clean = {i for i in before if not bad(i)}
        assert len(clean - set(after)) <= 0.02 * len(clean) and len(set(after) - clean) <= 0.05 * (len(before) - len(clean))


def test_one_of_each_group_of_copies_stays(steps):
    before, after = steps["near copies"]
    sets = {}
    for r in before:
        words = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    low = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in linked:
        old = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == old:
            break
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if low[r["doc_id"]] == r["doc_id"]) and len(after) < len(before)


def test_addresses_are_replaced_alike(steps):
    before, after = ({r["doc_id"]: r for r in rows} for rows in steps["personal data"])
    assert before.keys() == after.keys()
    names = {}
    for i, r in before.items():
        found = MAIL.search(r["text"])
        if found:
            start, rest = found.span()[0], len(r["text"]) - found.span()[1]
            now = after[i]["text"]
            assert now[:start] == r["text"][:start] and found.group() not in now
            names.setdefault(found.group(), set()).add(now[start:len(now) - rest])
        else:
            assert after[i] == r
        assert after[i]["n_chars"] == len(after[i]["text"])
    assert len(names) > 2 and all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_pieces_hold_every_id_once(steps):
    before, after = steps["packing"]
    coder, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in after:
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == {
        r["doc_id"]: coder.encode(r["text"], add_special_tokens=False).ids + [1] for r in before}


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    """Without labels nothing is rejected as toxic; null and empty texts, repeated rows and clashing columns do no harm."""
    (tmp_path / "odd").mkdir(), (tmp_path / "none").mkdir()
    odd = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 30_000), (5, "x" * 50_000), (6, "a b c d e f g é 😀"), (None, "no key")]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], COLUMNS).selectExpr(
        "*", "'mine' page_id", "1 score", "'s' size", "2 component_id", "3 n_hidden")
    folder = written(spark, tmp_path / "odd", rows, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.remove_toxic(spark, docs, folder).count() == len(odd)
    hidden = corpus_pipeline.hide_people(spark, docs, folder).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in hidden) == sorted((str(i), t or "") for i, t in odd)
    assert {r["page_id"] for r in hidden} == {"mine"} and {r["n_hidden"] for r in hidden} == {3}
    corpus_pipeline.run(spark, folder).count()
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [])).count() == 0


def test_a_row_goes_for_its_own_text_only(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "red green blue white black grey brown pink gold teal " * 3
    rows = [(1, a, "s"), (5, a + "end", "s"), (5, b, "s"), (6, b, "s"), (6, b, "t"), (6, b, "s"), (7, "", "s"), (8, None, "s"), (None, a, "s"), (None, a, "s"), (9, " ", "s")]
    docs = spark.createDataFrame([(*r, {"k": 1}, 3) for r in rows], "doc_id long, text string, source string, _row map<string,int>, _key int")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    # (6, b) is a copy of (5, b), which stays although its doc_id is also on a copy of 1.
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(1, a), (5, b), (7, ""), (8, ""), (0, a), (0, a), (9, " ")])
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), "").count() == 0
