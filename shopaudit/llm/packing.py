"""Hierarchical multi-length packing of page texts into training sequences."""
from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keyed, small_batches, worker_cache

WINDOW = 2048
SMALLEST_TIER = 256
END_ID = 1
POOL = 1024
STEP_TOKENS = 16_384
STEP_GROUPS = 8

SCHEMA = ("page_id long, start long, length long, ids binary, page_tokens long, sequence_id long, offset long, "
          "sequence_length long, step_group long")


def tiers(window: int, smallest: int) -> list[int]:
    """Context sizes from the longest to the shortest, each half of the one before."""
    sizes = [window]
    while sizes[-1] // 2 >= smallest:
        sizes.append(sizes[-1] // 2)
    return sizes


def encoder(path: str, pattern: str):
    """Text to ids of the byte-level vocabulary in ``path`` (a tokenizers file whose ids follow its merge order).

    tiktoken runs the same merges over the same vocabulary about ten times as fast; a test holds its ids against the
    tokenizers library's.
    """
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters.update((chr(256 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(printable))))
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    coder = tiktoken.Encoding("pages", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(coder.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


class Packer:
    """Packs the documents of one task. Holds at most ``POOL`` remainders and ``STEP_GROUPS`` steps of each tier."""

    def __init__(self, window: int, smallest: int, task: int):
        self.tiers = tiers(window, smallest)
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.waiting: dict[int, list] = {}
        self.held, self.arrivals = 0, 0
        self.sequences = self.groups = task << 33
        self.out: list[tuple] = []

    def tier(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if length <= t)

    def put(self, page, ids: np.ndarray, start: int, total: int) -> None:
        """Route a remainder to the smallest context size that holds it."""
        bisect.insort(self.pools[self.tier(len(ids))], (len(ids), self.arrivals, page, ids, start, total))
        self.arrivals += 1
        self.held += 1

    def add(self, page, ids: np.ndarray) -> None:
        total, start, window = len(ids), 0, self.tiers[0]
        while total - start >= window:
            self.close([(page, ids[start:start + window], start, total)], window)
            start += window
        if start < total:
            self.put(page, ids[start:], start, total)
        if self.held > POOL:
            while self.held > POOL // 2:
                self.fill()

    def take(self, gap: int):
        """The longest remainder that fits the gap, or else the first part of the shortest one that does not."""
        for t in self.tiers:
            pool = self.pools[t]
            at = bisect.bisect_right(pool, gap, key=lambda x: x[0]) - 1
            if at >= 0:
                self.held -= 1
                return pool.pop(at)[2:]
        for t in reversed(self.tiers):
            if self.pools[t]:
                _, _, page, ids, start, total = self.pools[t].pop(0)
                self.held -= 1
                self.put(page, ids[gap:], start + gap, total)
                return page, ids[:gap], start, total
        return None

    def fill(self) -> None:
        """Open a window of the longest tier that waits and fill its gap from the same and shorter tiers."""
        size = next(t for t in self.tiers if self.pools[t])
        first = self.pools[size].pop()
        self.held -= 1
        pieces, gap = [first[2:]], size - first[0]
        while gap and (piece := self.take(gap)):
            pieces.append(piece)
            gap -= len(piece[1])
        if gap:
            self.split(pieces)
        else:
            self.close(pieces, size)

    def split(self, pieces: list) -> None:
        """The last tokens of a task, too few for their tier, become sequences of smaller powers of two."""
        rest = sum(len(p[1]) for p in pieces)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            part, room = [], size
            while room:
                page, ids, start, total = pieces.pop(0)
                part.append((page, ids[:room], start, total))
                if len(ids) > room:
                    pieces.insert(0, (page, ids[room:], start + room, total))
                room -= min(room, len(ids))
            self.close(part, size)
            rest -= size

    def close(self, pieces: list, size: int) -> None:
        cost = sum(len(p[1]) ** 2 for p in pieces)
        ready = self.waiting.setdefault(size, [])
        ready.append((cost, self.sequences, pieces, size))
        self.sequences += 1
        if len(ready) >= STEP_GROUPS * max(1, STEP_TOKENS // size):
            self.deal(size)

    def deal(self, size: int) -> None:
        """Deal sequences to step groups of equal tokens, to and fro by attention cost, so that the costs balance."""
        ready = sorted(self.waiting.pop(size, []), key=lambda x: (-x[0], x[1]))
        count = max(1, round(len(ready) * size / STEP_TOKENS))
        for i, (_, sequence, pieces, length) in enumerate(ready):
            turn, place = divmod(i, count)
            group = self.groups + (place if turn % 2 == 0 else count - 1 - place)
            offset = 0
            for page, ids, start, total in pieces:
                self.out.append((page, start, len(ids), ids.tobytes(), total, sequence, offset, length, group))
                offset += len(ids)
        self.groups += count

    def finish(self) -> None:
        while self.held:
            self.fill()
        for size in list(self.waiting):
            self.deal(size)

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 5
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def pack_pages(documents: DataFrame, tokenizer: str, pattern: str, window: int = WINDOW,
               smallest: int = SMALLEST_TIER, end_id: int = END_ID) -> DataFrame:
    """Pack the texts of ``documents`` (page_id, text) into sequences of at most ``window`` tokens.

    A text becomes the ids of the byte-level vocabulary in the file ``tokenizer`` (word pattern ``pattern``) and
    ``end_id``. Whole windows are cut off first; the remainder is routed to the smallest of the context sizes
    ``window``, ``window``/2, ... ``smallest`` that holds it. A window of a tier is opened by its longest remainder, and
    its gap is filled with the longest remainders of its own and shorter tiers that fit, at last with the first part of
    the shortest one. Only the end of a task can lack such a part; its tokens become sequences of smaller powers of two,
    so no sequence needs padding. Sequences of a tier are dealt to step groups of ``STEP_TOKENS`` tokens, to and fro by
    their attention cost (the sum of squared piece lengths).

    Returns one row per piece: page_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit
    numbers), page_tokens, sequence_id, offset (gapless from 0 in the sequence), sequence_length, step_group. Each task
    packs what it reads, holding a bounded number of remainders, so nothing is shuffled and a source or page that holds
    a third of the input does not meet in one place; the numbers of a task depend on its input split alone.

    A null text counts as empty (one id, ``end_id``). Rows without page_id are left out, rows that repeat a page_id are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if (tokenizer, pattern) not in cache:
            cache[tokenizer, pattern] = encoder(tokenizer, pattern)
        encode = cache[tokenizer, pattern]
        packer = Packer(window, smallest, TaskContext.get().partitionId())
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(page, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.out) >= 2000:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return keyed(documents, "page_id", "text").mapInArrow(task, SCHEMA)
