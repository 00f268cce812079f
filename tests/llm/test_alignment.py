"""Token alignment against both libraries on whole texts and a quadratic search for overlaps."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopaudit.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        signs = {v: k for k, v in alignment.byte_letters().items()}
        assert len(signs) == 256
        self.letters = {v: k for k, v in signs.items()}

    def tokens(self, text):
        """(id, start, end) of both, or nothing where bytes are not given back."""
        if not text:
            return [], []
        whole, out = (" " + text).encode(), []
        for ids, sound in ((self.a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(self.letters[c] for c in self.a.id_to_token(i))),
                           (self.b.encode(text), lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                            else self.b.id_to_piece(i).replace("▁", " ").encode())):
            at, found = 0, []
            for i in ids:
                found.append((i, at, at + len(sound(i))))
                at = found[-1][2]
            if b"".join(sound(i) for i in ids) != whole:
                return [], []
            out.append(found)
        return out


def plain_rows(texts):
    plain, rows = Plain(), []
    for text in texts:
        a, b = plain.tokens(text)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [([i for i, s, e in a if low <= s < high], [i for i, s, e in b if low <= s < high]) for low, high in zip([0, *cuts], cuts)]
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        told = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(told.encode()).hexdigest() if a else ""))
    counts, best = Counter(x for r in rows for x in r[3]), {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), told)
            for n_a, n_b, n_groups, links, told in rows]


def aligned(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, text string, row_id long, pairs string")
    return alignment.align_pages(df, A, B, **options)


TEXTS = ["Return the goods within 14 days.", "", None, " two  blanks and\n\n lines \n", "trailing ", "trailing\n", "same text", "same text", "▁marker",
         "naïve café — 東京 \U0001f600\U0001f600 don't", "a" * 500 + " " * 40 + "b", "<|endoftext|> <s> <0x41> <unk>", "\t\ttabs\x1c \x85 odd  　x", " ",
         "\x00 nul", "x" + " y" * 3000, "▁", "é ﻿bom ﬁ"]


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_against_whole_texts(spark, head):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(7, "same text"), (7, "other")]
    found = aligned(spark, rows, head=head).collect()
    expected = plain_rows([t for _, t in rows])
    assert Counter((r.page_id, *(r[c] for c in COLUMNS)) for r in found) == Counter((p, *e) for (p, _), e in zip(rows, expected))


def test_documents_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = {r.page_id: tuple(r[c] for c in COLUMNS) for r in aligned(spark, rows, head=2000).collect()}
    assert found == {p: e for (p, _), e in zip(rows, plain_rows([t for _, t in rows]))}


def test_empty_table_and_long_text(spark):
    assert aligned(spark, []).collect() == []
    long = "lorem ipsum " * 100_000
    row = aligned(spark, [(1, long)]).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a >= 200_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab e\n\t  é東'1.!▁\x1c　Z"), max_size=30), min_size=1, max_size=4))
def test_words_apart_give_the_ids_of_whole_texts(texts):
    words, plain = test_words_apart_give_the_ids_of_whole_texts.__dict__.setdefault("kept", (alignment.Words(alignment.Pair(A, B)), Plain()))
    for text, found in zip(texts, words.aligned(texts)):
        a, b = plain.tokens(text)
        ok = len(found) and words.numbers[found, 4].all()
        assert bool(ok) == bool(a)
        if ok:
            assert words.numbers[found, :2].sum(0).tolist() == [len(a), len(b)]
            told = "".join(words.groups[i] for i in found)[:-1]
            assert [int(x) for g in told.split(";") for x in g.split("|")[0].split(",")] == [i for i, _, _ in a]
            assert [int(x) for g in told.split(";") for x in g.split("|")[1].split(",")] == [i for i, _, _ in b]


def test_coalescing():
    starts, ends = np.array([0, 0, 1, 3, 3, 4]), np.array([3, 1, 3, 4, 6, 6])
    assert alignment.coalesced(starts, ends).tolist() == [0, 0, 0, 1, 1, 1]


def test_head_keeps_to_its_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 3, 3, 3, 1, 2000, 900_000])], "pair long, n long")
    assert [alignment._head_from(counts, k) for k in (0, 1, 3, 4, 7, 8)] == [1 << 62, 900_000, 2000, 5, 3, 1]


def test_documents_of_a_shop(spark):
    from shopaudit.operators.extract import documents
    from shopaudit.sources.pages import read_pages

    raw = spark.createDataFrame([(5, "https://shop.example/", "<html><body><p>Return the goods</p></body></html>")], "page_id long, url string, html string")
    pages = documents(read_pages(raw))
    row = alignment.align_pages(pages, A, B).first()
    assert (row.page_id, *(row[c] for c in COLUMNS)) == (5, *plain_rows([pages.first().text])[0])
