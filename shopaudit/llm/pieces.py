"""Encoding and decoding of page texts with a SentencePiece vocabulary: unigram Viterbi over a double-array trie."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import keyed, small_batches, worker_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE_WORDS, CACHE_IDS = 300_000, 4_000_000
LONG_WORD = 64
SCHEMA = "page_id long, ids array<int>, text string, decoded string"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix_space: bool = True
    extra_spaces: bool = False
    escape_spaces: bool = True
    bytes_of: dict[int, int] = field(default_factory=dict)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message: numbers, 32-bit parts and byte strings."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = 4 if kind == 5 else 8 if kind == 1 else number()
            yield key >> 3, data[at:at + size]
            at += size


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces, scores, kinds and the normaliser's switches of a SentencePiece model file.

    A model that normalises by a table is refused: its texts would get other pieces than its own coder gives them.
    """
    out = Vocabulary([], [], [])
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(_fields(value))
            out.pieces.append(piece.get(1, b"").decode("utf-8"))
            out.scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            out.kinds.append(piece.get(3, NORMAL))
        elif number == 3:
            spec = dict(_fields(value))
            out.prefix_space, out.extra_spaces, out.escape_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
            if spec.get(2):
                raise ValueError(f"{path} has a table of normalisations, which this coder does not apply")
    out.bytes_of = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(out.pieces, out.kinds)) if k == BYTE}
    return out


class Trie:
    """A double-array trie over code points: from state s by sign c to base[s] + c if check says s."""

    def __init__(self, words: dict[str, int]):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for word, value in words.items():
            at = 0
            for c in word:
                code = self.codes[c]
                if code not in children[at]:
                    children[at][code] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][code]
            values[at] = value
        size = len(children) * 2 + len(self.codes) + 2
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        used = np.frombuffer(taken, bool)
        places, start, span = {0: 0}, 1, 4096
        for node in range(len(children)):
            here = places.pop(node)
            value[here] = values[node]
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                continue
            start = taken.index(0, start)
            offset = start - int(kids[0]) if len(kids) == 1 and start >= kids[0] else -1
            while offset < 0:
                # Free places from the first one on, tried by thousands.
                free = np.flatnonzero(~used[start:start + span]) + start - kids[0]
                free = free[(free >= 0) & (free + kids[-1] < size)]
                fits = free[~used[free[:, None] + kids].any(axis=1)] if len(free) else free
                if len(fits):
                    offset, span = int(fits[0]), 4096
                elif start + span < size:
                    span *= 4
                else:
                    base, check, value = (np.concatenate([x, np.full(size, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                    del used
                    taken.extend(bytes(size))
                    used = np.frombuffer(taken, bool)
                    size *= 2
            base[here] = offset
            for code, child in children[node].items():
                taken[offset + code] = 1
                check[offset + code] = here
                places[child] = offset + code
        self.base, self.check, self.value = base, check, value
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[[ord(c) for c in self.codes]] = list(self.codes.values())
        self.lists = base.tolist(), check.tolist(), value.tolist()

    def walk(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every word of the trie that starts at ``start``."""
        base, check, value = self.lists
        state, codes = 0, self.codes
        for at in range(start, len(text)):
            code = codes.get(text[at])
            if code is None:
                return
            following = base[state] + code
            if following >= len(check) or check[following] != state:
                return
            state = following
            if value[state] >= 0:
                yield at + 1, value[state]


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        kinds = vocabulary.kinds
        self.trie = Trie({p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, kinds)) if k in (NORMAL, DEFINED) and p})
        self.scores = list(vocabulary.scores)
        plain = [s for s, k in zip(vocabulary.scores, kinds) if k == NORMAL]
        top, self.worst = max(plain, default=0.0), min(plain, default=0.0) - UNKNOWN_PENALTY
        for i, (p, k) in enumerate(zip(vocabulary.pieces, kinds)):
            if k == DEFINED:
                self.scores[i] = len(p) * top - 0.1
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.byte_ids = {b: i for i, b in vocabulary.bytes_of.items()}
        # Words may be coded on their own unless a piece runs over the start of a word.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(vocabulary.pieces, kinds) if k in (NORMAL, DEFINED))
        # A line end that no piece holds parts words, too.
        end = "\n" if self.byte_ids and "\n" not in self.trie.codes else ""
        self.word = re.compile(f"{SPACE}*[^{SPACE}{end}]+|{SPACE}+" + ("|\n" if end else ""))
        self.forget()
        self.sounds = [p.replace(SPACE, " ") if k in (NORMAL, DEFINED) else "" for p, k in zip(vocabulary.pieces, kinds)]
        self.special = {i for i, k in enumerate(kinds) if k in (BYTE, UNKNOWN)}
        self.sound_bytes = pa.array([bytes([vocabulary.bytes_of[i]]) if i in vocabulary.bytes_of else
                                     " ⁇ ".encode() if i == self.unknown else x.encode() for i, x in enumerate(self.sounds)], pa.binary())

    def normalised(self, text: str) -> str:
        """Blanks as markers, with one in front, as the model's normaliser says."""
        v = self.vocabulary
        if v.extra_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if v.prefix_space and text:
            text = " " + text
        return text.replace(" ", SPACE) if v.escape_spaces else text

    def best(self, text: str) -> list[int]:
        """Viterbi: the pieces with the largest sum of log scores; signs without a piece are unknown."""
        n = len(text)
        score, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        scores, walk = self.scores, self.trie.walk
        for start in range(n):
            here, single = score[start], False
            for end, piece in walk(text, start):
                total = here + scores[piece]
                single = single or end == start + 1
                if total > score[end]:
                    score[end], back[end] = total, (start, piece)
            if not single:
                total = here + self.worst
                if total > score[start + 1]:
                    score[start + 1], back[start + 1] = total, (start, -1)
        out, at = [], n
        while at:
            start, piece = back[at]
            out.append((piece, start, at))
            at = start
        ids: list[int] = []
        for piece, start, end in reversed(out):
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in text[start:end].encode("utf-8", "surrogatepass"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def best_of_many(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """``best`` for many short words at once: all words take each step of the trie together.

        Returns the words, how many ids each has, the ids in one array, and the words with unknown signs, left to ``best``.
        """
        trie, scores = self.trie, np.array(self.scores)
        words = sorted(words, key=len, reverse=True)
        size = np.array([len(w) for w in words])
        longest = int(size[0])
        codes = trie.code_of[np.array(words).view(np.uint32).reshape(len(words), -1)[:, :longest]]
        rows, columns = len(words), longest + 1
        score = np.full((rows, columns), -np.inf)
        score[:, 0] = 0.0
        start_of, piece_of = np.zeros((rows, columns), np.int32), np.full((rows, columns), -1, np.int32)
        for start in range(longest):
            alive = np.arange(np.searchsorted(-size, -start, side="left"))
            state = np.zeros(len(alive), np.int64)
            single = np.zeros(len(alive), bool)
            for end in range(start + 1, longest + 1):
                code = codes[alive, end - 1]
                following = trie.base[state] + code
                good = (code > 0) & (following < len(trie.check)) & (size[alive] >= end)
                good[good] = trie.check[following[good]] == state[good]
                alive, state = alive[good], following[good]
                if not len(alive):
                    break
                piece = trie.value[state]
                hit = piece >= 0
                at, piece = alive[hit], piece[hit]
                if end == start + 1:
                    single[at] = True
                total = score[at, start] + scores[piece]
                better = total > score[at, end]
                at = at[better]
                score[at, end], start_of[at, end], piece_of[at, end] = total[better], start, piece[better]
            alone = np.flatnonzero(~single)
            total = score[alone, start] + self.worst
            alone, total = alone[total > score[alone, start + 1]], total[total > score[alone, start + 1]]
            score[alone, start + 1], start_of[alone, start + 1], piece_of[alone, start + 1] = total, start, -1
        steps, live, at = [], np.arange(rows), size.copy()
        while len(live):
            piece = np.full(rows, -2, np.int64)
            piece[live] = piece_of[live, at]
            steps.append(piece)
            at = start_of[live, at]
            live, at = live[at > 0], at[at > 0]
        table = np.stack(steps[::-1], axis=1)
        known = (table != -1).all(axis=1)
        held = (table >= 0) & known[:, None]
        return ([words[i] for i in np.flatnonzero(known)], held.sum(axis=1)[known], table[held],
                [words[i] for i in np.flatnonzero(~known)])

    def forget(self) -> None:
        """Empty the cache: the place of each known word, and at each place where its ids start and how many there are."""
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, missing: list[str]) -> list[str]:
        """Add words to the cache. Returns the long ones among them."""
        short = [w for w in missing if len(w) <= LONG_WORD and "\0" not in w]
        long = [w for w in missing if len(w) > LONG_WORD or "\0" in w]
        words, counts, parts, rest = [], [self.counts], [self.ids], list(long)
        for at in range(0, len(short), 20_000):
            known, n, ids, others = self.best_of_many(short[at:at + 20_000])
            words += known
            rest += others
            counts.append(n)
            parts.append(ids.astype(np.int32))
        lists = [self.best(w) for w in rest]
        counts.append(np.array([len(x) for x in lists], np.int64))
        parts.append(np.fromiter(chain.from_iterable(lists), np.int32))
        self.known.update(zip(words + rest, range(len(self.counts), len(self.counts) + len(missing))))
        self.counts, self.ids = np.concatenate(counts), np.concatenate(parts)
        self.starts = np.cumsum(self.counts) - self.counts
        return long

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin, with the end of the last."""
        texts = [self.normalised(t) for t in texts]
        if not self.by_word:
            lists = [self.best(t) for t in texts]
            return np.fromiter(chain.from_iterable(lists), np.int32), np.cumsum([0, *map(len, lists)])
        split = [self.word.findall(t) for t in texts]
        words = list(chain.from_iterable(split))
        every = set(words)
        missing = every.difference(self.known)
        if len(self.known) + len(missing) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.forget()
            missing = every
        long = self.learn(list(missing)) if missing else []
        places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for word in long:
            del self.known[word]
        counts = self.counts[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # An id's place in the cache: where its word starts there, and how far the id is inside the word.
        first = (self.starts[places] - ends[:-1]).astype(np.int32)
        ids = self.ids[np.repeat(first, counts) + np.arange(ends[-1], dtype=np.int32)]
        return ids, ends[np.cumsum([0, *map(len, split)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Markers become blanks, byte pieces the text of their bytes, and the blank in front goes."""
        if self.special.isdisjoint(ids):
            text = "".join([self.sounds[i] for i in ids])
        else:
            parts, pending = [], bytearray()
            for i in ids:
                if i in self.vocabulary.bytes_of:
                    pending.append(self.vocabulary.bytes_of[i])
                    continue
                if pending:
                    parts.append(pending.decode("utf-8", "replace"))
                    pending = bytearray()
                parts.append(" ⁇ " if i == self.unknown else self.sounds[i])
            text = "".join(parts) + pending.decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix_space and text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """``decode`` for many texts, as from ``encode_all``: the bytes of all pieces in a row, cut at the texts' bounds."""
        if not len(ids):
            return pa.array([""] * (len(bounds) - 1), pa.string())
        sounds = self.sound_bytes.take(pa.array(ids))
        ends = np.frombuffer(sounds.buffers()[1], np.int32, len(ids) + 1)
        out = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[bounds])), sounds.buffers()[2]])
        try:
            out = out.cast(pa.string())
        except pa.ArrowInvalid:  # Byte pieces that are no UTF-8 in some text.
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])], pa.string())
        return pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out) if self.vocabulary.prefix_space else out


def coder(path: str) -> Coder:
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = Coder(read_vocabulary(path))
    return cache["pieces", path]


def encode_pages(documents: DataFrame, model: str) -> DataFrame:
    """Encode every whole text of ``documents`` (page_id, text) with the vocabulary in the model file, and decode the ids.

    The segmentation is the one with the largest sum of the pieces' log scores (unigram Viterbi over a double-array trie);
    signs that no piece holds become the pieces of their UTF-8 bytes. Blanks are coded as markers. Where no piece runs over
    the start of a word, words are coded on their own, which gives the same result, and kept in a bounded cache. Ties go to
    the piece that starts first.

    Returns one row per row with a page_id: page_id, ids, text (as read, null as empty), decoded. An empty text has no ids.
    Texts need not fit one batch; rows that repeat are coded alike. Other columns are ignored; an empty table gives no rows.
    """
    # Every word of a batch is in memory at once, so its bytes are bounded; words are shared between batches by the cache.
    small_batches(documents.sparkSession, 2000, "8m")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = coder(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ids, bounds = work.encode_all(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                 texts, work.decode_all(ids, bounds)], ["page_id", "ids", "text", "decoded"])

    return keyed(documents, "page_id", "text").mapInArrow(task, SCHEMA)
