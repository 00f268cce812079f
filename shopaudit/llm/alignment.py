"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, in every text and corpus-wide."""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, stored, worker_cache

#: Pairs whose corpus-wide counts are sent to every task; the others are joined. 17 bytes each, whatever the corpus.
HEAD = 1 << 20
#: Bytes of distinct words a worker remembers, and bytes of them coded in one call.
REMEMBERED = 8 << 20
STREAM = 1 << 16
#: Distinct pairs a task counts before it hands them on.
COUNTED = 1 << 21

_SPACE_IN_SPACE = re.compile(r"\s ")
_WORD_STARTS = re.compile(r"(?<=\S)(?= )")
_MARKER = "▁"

ALIGNED = ("row_id long, page_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, times binary")


def byte_letters() -> dict[str, int]:
    """The printable sign of every byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters.update((chr(256 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(printable))))
    return letters


class Pair:
    """The two tokenizers: ids of a text and the bytes of every id. Texts given here start with a blank."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        sounds = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in self.a.get_vocab().items()}
        self.bytes_a = [sounds.get(i, b"") for i in range(max(sounds) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names_a = [str(i) for i in range(len(self.bytes_a))]
        self.names_b = [str(i) for i in range(len(self.bytes_b))]
        self.bits_b = max(1, (len(self.bytes_b) - 1).bit_length())
        self.dtype = np.dtype("<u4" if (len(self.bytes_a) - 1).bit_length() + self.bits_b <= 32 else "<u8")
        # Words can be coded apart where no piece holds a blank behind another sign and nothing is rewritten.
        self.by_words = not any(_MARKER in self.b.id_to_piece(i).lstrip(_MARKER) for i in range(self.b.get_piece_size()))

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(_MARKER, " ").encode()

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        coded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        pieces = self.b.encode([t[1:] for t in texts], num_threads=1)
        # The model puts a blank before any text but the empty one.
        alone = self.b.piece_to_id(_MARKER)
        return [(np.array(x.ids, np.int64), np.array(y if len(t) > 1 else [alone], np.int64)) for t, x, y in zip(texts, coded, pieces)]

    def same_bytes(self, text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        whole = text.encode()
        return b"".join([self.bytes_a[i] for i in ids_a]) == whole and b"".join([self.bytes_b[i] for i in ids_b]) == whole


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group numbers of intervals sorted by start: a group breaks where a start reaches the maximum of the ends so far."""
    if not len(starts):
        return np.zeros(0, np.int64)
    reach = np.maximum.accumulate(ends)
    return np.concatenate([[0], np.cumsum(starts[1:] >= reach[:-1])])


def overlaps(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of an A and a B interval that overlap; both lists are sorted and without overlaps of their own."""
    low = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - low
    left = np.repeat(np.arange(len(starts_a)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Words:
    """Aligned words of a worker: every distinct word is coded and aligned once, together with others laid end to end."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.size = 0
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes are the word's
        self.links = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """The words of a text behind a blank; each starts with its blanks, and none ends where white space goes on."""
        if not self.pair.by_words:
            return [" " + text]
        if _SPACE_IN_SPACE.search(" " + text):
            return _WORD_STARTS.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def learn(self, words: list[str]) -> None:
        """Code and align new words in streams of them; words that end in white space or whose bytes change go alone."""
        streams, stream, size = [], [], 0
        for word in words:
            if word[-1].isspace() or _MARKER in word or not self.pair.by_words:
                streams.append([word])
                continue
            stream.append(word)
            size += len(word)
            if size >= STREAM:
                streams.append(stream)
                stream, size = [], 0
        if stream:
            streams.append(stream)
        coded = self.pair.ids(["".join(s) for s in streams])
        for s, (ids_a, ids_b) in zip(streams, coded):
            if self.pair.same_bytes("".join(s), ids_a, ids_b):
                self.align(s, ids_a, ids_b)
            elif len(s) == 1:
                self.add(s, [""], np.zeros((1, 5), np.int64), np.zeros(0, np.int64))
            else:
                for word, (a, b) in zip(s, self.pair.ids(s)):
                    if self.pair.same_bytes(word, a, b):
                        self.align([word], a, b)
                    else:
                        self.add([word], [""], np.zeros((1, 5), np.int64), np.zeros(0, np.int64))

    def align(self, words: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Interval coalescing over a stream of words: sort all tokens of both by start and break groups where ends meet."""
        ends_a, ends_b = np.cumsum(self.pair.lengths_a[ids_a]), np.cumsum(self.pair.lengths_b[ids_b])
        starts_a, starts_b = ends_a - self.pair.lengths_a[ids_a], ends_b - self.pair.lengths_b[ids_b]
        starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
        is_b = np.arange(len(starts)) >= len(ids_a)
        order = np.lexsort((is_b, starts))
        group = np.empty(len(starts), np.int64)
        group[order] = coalesced(starts[order], ends[order])
        group_a, group_b = group[:len(ids_a)], group[len(ids_a):]
        left, right = overlaps(starts_a, ends_a, starts_b, ends_b)
        pairs = ids_a[left] << self.pair.bits_b | ids_b[right]
        # Words end where both end a token, so each has whole groups.
        bounds = np.cumsum([0] + [len(w.encode()) for w in words])
        at_a, at_b, at_links = np.searchsorted(starts_a, bounds), np.searchsorted(starts_b, bounds), np.searchsorted(starts_a[left], bounds)
        first_of = np.concatenate([group_a[at_a[:-1]], [group_a[-1] + 1]])
        numbers = np.stack([np.diff(at_a), np.diff(at_b), np.diff(first_of), np.diff(at_links), np.ones(len(words), np.int64)], 1)
        # In the order of groups, A before B: a sign behind every id says what follows.
        told = np.lexsort((starts, is_b, group))
        same_group = np.diff(group[told], append=-1) == 0
        sign = np.where(~same_group, ";", np.where(np.diff(is_b[told].astype(int), append=0) != 0, "|", ","))
        names_a, names_b = self.pair.names_a, self.pair.names_b
        ids = np.concatenate([ids_a, ids_b])[told].tolist()
        text = [(names_b if b else names_a)[i] + s for i, b, s in zip(ids, is_b[told].tolist(), sign.tolist())]
        at = (at_a + at_b).tolist()
        self.add(words, ["".join(text[x:y]) for x, y in zip(at, at[1:])], numbers, pairs)

    def add(self, words: list[str], groups: list[str], numbers: np.ndarray, links: np.ndarray) -> None:
        for word in words:
            self.places[word] = len(self.places)
            self.size += len(word)
        self.groups += groups
        self.new.append((numbers, links))

    def aligned(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Word numbers of every text."""
        if self.size > REMEMBERED:
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        unknown = dict.fromkeys(w for words in split for w in words if w not in self.places)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        if unknown:
            self.learn(list(unknown))
            self.numbers = np.concatenate([self.numbers, *(n for n, _ in self.new)])
            self.links = np.concatenate([self.links, *(x for _, x in self.new)])
            self.ends = np.concatenate([[0], np.cumsum(self.numbers[:, 3])])
        place = self.places.__getitem__
        return [np.fromiter(map(place, words), np.int64, len(words)) for words in split]


def _words(path_a: str, path_b: str) -> Words:
    cache = worker_cache()
    if ("alignment", path_a, path_b) not in cache:
        cache["alignment", path_a, path_b] = Words(Pair(path_a, path_b))
    return cache["alignment", path_a, path_b]


def _rows(words: Words, rows: pa.Array, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """The aligned texts of one batch, with their distinct pairs and how often each is linked."""
    dtype, found = words.pair.dtype, words.aligned(texts)
    whole = np.array([bool(len(w)) and words.numbers[w, 4].all() for w in found], bool)
    totals = np.array([words.numbers[w, :4].sum(0) if ok else (0, 0, 0, 0) for w, ok in zip(found, whole)], np.int64).reshape(-1, 4)
    prints = []
    for w, ok in zip(found, whole):
        told = "".join([words.groups[i] for i in w.tolist()])[:-1] if ok else ""
        prints.append(hashlib.sha256(told.encode()).hexdigest() if ok else "")
    used = np.concatenate([w for w, ok in zip(found, whole) if ok] or [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(found)), [len(w) if ok else 0 for w, ok in zip(found, whole)])
    n = words.numbers[used, 3]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.ends[used], n)
    text_of, pair = np.repeat(of, n), words.links[at]
    bits = 63 - max(1, len(found)).bit_length()
    if int(pair.max(initial=0)) < 1 << bits:
        key, times = np.unique(text_of << bits | pair, return_counts=True)
        text_of, pair = key >> bits, key & ((1 << bits) - 1)
    else:
        order = np.lexsort((pair, text_of))
        text_of, pair = text_of[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text_of) != 0) | (np.diff(pair) != 0)]))
        times, text_of, pair = np.diff(np.append(new, len(pair))), text_of[new], pair[new]
    cuts = np.searchsorted(text_of, np.arange(len(found) + 1))
    pair, times = pair.astype(dtype), times.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [rows, keys.cast(pa.int64()), *(pa.array(totals[:, i]) for i in range(4)), pa.array(prints, pa.string()),
         pa.array([pair[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
         pa.array([times[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
        ["row_id", "page_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _combined(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, inverse, np.concatenate(times))
    return codes, sums


def pair_counts(aligned: DataFrame, dtype: np.dtype) -> DataFrame:
    """How often each pair of ids is linked in all texts: (pair, n). Every task adds up its pairs before they move."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1)):
                pairs.append(np.frombuffer(p.as_buffer(), dtype).astype(np.int64))
                times.append(np.frombuffer(t.as_buffer(), "<u4").astype(np.int64))
                held += len(pairs[-1])
                if held > 2 * COUNTED:
                    codes, sums = _combined(pairs, times)
                    pairs, times, held = [codes], [sums], len(codes)
                    if held > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["pair", "n"])
                        pairs, times, held = [], [], 0
        if held:
            codes, sums = _combined(pairs, times)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["pair", "n"])

    partial = aligned.select("pairs", "times").mapInArrow(task, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _head_from(counts: DataFrame, head: int) -> int:
    """The smallest count of pairs that are sent to every task, such that they are ``head`` at most."""
    # Exact counts up to 1,024, then steps of 2 %: some thousand rows at most.
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(F.log(F.col("n") / 1024.0) / F.log(F.lit(1.02))))
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, room = None, head
    for row in sorted(steps, key=lambda r: -r["step"]):
        room -= row["pairs"]
        if room < 0:
            break
        least = row["least"]
    return least if least is not None else 1 << 62


def align_pages(documents: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """Align the tokens of two tokenizers in every whole text of ``documents`` (page_id, text).

    ``path_a`` is a byte-level tokenizers file, which codes a blank and the text; ``path_b`` a sentencepiece model, which
    adds the blank itself. Tokens are byte ranges of the blank and the text. Sorted by start, they fall into groups where a
    start reaches the largest end so far, that is, where tokens of both end; inside a group every A token is linked with
    the B tokens that it overlaps. Both cut a text before a blank that follows another sign than white space, so every
    distinct word is coded and aligned once in a task, laid end to end with others, and texts are put together from them.

    Counts of id pairs are summed over all texts. The most frequent pairs, at most ``head`` (17 bytes each), are sent to
    every task; the rest, rare by definition, are joined with the texts that hold them, so the result is exact for any
    number of pairs. The aligned texts are written once; later passes read their pairs.

    Returns one row per row: page_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most
    frequent one of its B id, ties included), count_sum (the counts of all links added up), groups_sha256 (of
    ``a1,a2|b1;a3|b2,b3``: ids by group). A text that is null, empty, or not given back by the bytes of either
    tokenizer's tokens has no tokens: zeros and an empty digest. Repeated rows and rows without page_id are rows of their
    own. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark, 1000, "4m")
    pair = Pair(path_a, path_b)
    bits_b, dtype = pair.bits_b, pair.dtype

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path_a, path_b)
        for batch in batches:
            yield _rows(words, batch.column(0), batch.column(1), pc.fill_null(batch.column(2), "").to_pylist())

    numbered = documents.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "text")
    path = new_path(spark, "aligned")
    numbered.mapInArrow(align, ALIGNED).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(ALIGNED).parquet(path)
    counts = stored(pair_counts(aligned, dtype), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << bits_b) - 1)
    # One row per id of B: the vocabulary bounds it.
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    marked = counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    least = _head_from(counts, head)
    top = marked.filter(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((top.column("pair").to_numpy()[order], top.column("n").to_numpy()[order],
                                         top.column("best").to_numpy(zero_copy_only=False)[order]))

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of each row, their times, and their places in the head where they are in it."""
        codes = sent.value[0]
        for p, t in zip(batch.column("pairs"), batch.column("times")):
            pairs = np.frombuffer(p.as_buffer(), dtype).astype(np.int64)
            at = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
            yield pairs, np.frombuffer(t.as_buffer(), "<u4").astype(np.int64), at, codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for batch in batches:
            sums = [(int((t[there] * n[at[there]]).sum()), int(t[there][best[at[there]]].sum())) for _, t, at, there in read(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_id", "page_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                 pa.array([s for s, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64())],
                ["row_id", "page_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "head_sum", "head_best"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (pairs, times, _, there) in zip(batch.column("row_id").to_pylist(), read(batch)):
                if not there.all():
                    left = ~there
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(left.sum(), row, np.int64)), pa.array(pairs[left]), pa.array(times[left])], ["row_id", "pair", "times"])

    base = aligned.mapInArrow(frequent, "row_id long, page_id long, n_a long, n_b long, n_groups long, n_links long, "
                              "groups_sha256 string, head_sum long, head_best long")
    tail = aligned.select("row_id", "pairs", "times").mapInArrow(rare, "row_id long, pair long, times long")
    rest = tail.join(marked.filter(F.col("n") < least), "pair").groupBy("row_id").agg(
        F.sum(F.col("times") * F.col("n")).alias("tail_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tail_best"))
    return base.join(rest, "row_id", "left").select(
        "page_id", "n_a", "n_b", "n_groups", "n_links", (F.col("head_best") + F.coalesce("tail_best", F.lit(0))).alias("n_best"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
