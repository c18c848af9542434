"""Evaluation passages in training text: winnowing, join of fingerprints, extension of hits.

Both sides are read alike, as words (what stands between spaces, evened out).  Of the
hashes of all K words in a row, the smallest in each window of W is a
fingerprint.  Any K + W - 1 words in a row that both sides share have a
fingerprint in common, wherever they stand: with K = 3 and W = 4 any six, and a
passage of 20 words or more with at most one word in eight altered holds six
unaltered words in a row.

1. *Stretches.*  The corpus is read once.  A filter of fixed size (FILTER_BITS,
   whatever the number of items) tells which K words in a row some item may
   have.  A stretch of SPAN words in which these cover too few words holds no
   passage of any item; only the others, with their surroundings, go on.  So a
   short quotation or a sentence that many items share is dropped here.
2. *Join.*  The fingerprints of stretches and items are joined by hash; hashes
   that very many stretches have are salted.
3. *Extension.*  Stretches and items that share a fingerprint, and enough other K
   words in a row, are aligned; a passage counts if it is long enough and alike
   enough.

No whole text is shuffled.  What is sent to all tasks is the filter and, if they
were counted to be SENT_WORDS words at most, the items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.normal import plain, unmarked
from ravelin.session import cut, salted_join

K, W = 3, 4
#: A passage: so many running words, of which at most one in TOLERANCE differs.
PASSAGE, TOLERANCE = 20, 8
#: Errors that 2 * PASSAGE - 1 words can have.
DRIFT = (2 * PASSAGE - 1) // TOLERANCE
#: Words of a text in which the shortest stretch of a passage that is a passage itself lies.
SPAN = 2 * PASSAGE - 1 + DRIFT
#: K words in a row that a passage shares with its item at least: each error spoils K of them.
LEAST_SHARED = PASSAGE - K + 1 - K * (PASSAGE // TOLERANCE)
#: Words kept on both sides of a stretch, so that longer passages come out longer.
AROUND = 64
#: Words of all items up to which they are broadcast (16 bytes each).
SENT_WORDS = 2_000_000
#: Bits of the filter (8 MB).
FILTER_BITS = 26

#: i, l and 1 print alike, and so do o and 0.
_FOLD = bytes.maketrans(b"i10", b"llo")
_LEADER = re.compile(r"(?m)^[ \t]*(?:\[\d+\]|\d+[.)]|>+|/{2,}!?|#+|[-*+|]|\d+\|)(?=[ \t])")
_BROKEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[ \t]*(?:(?:>+|/{2,}|#|\*)[ \t]+)?(?=\w)")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A passage of PASSAGE words has this many in unaltered runs of K or more: e errors leave e + 1 runs, all but one of them too short.
LEAST_COVERED = PASSAGE - PASSAGE // TOLERANCE - (K - 1) * (PASSAGE // TOLERANCE)


def words(text: str) -> list[bytes]:
    """The words of a text, evened out; what begins lines is dropped, words broken at line ends are joined."""
    text = _LEADER.sub(" ", _BROKEN.sub("", text))
    return plain(unmarked(text)).encode("utf-8", "replace").translate(_FOLD).split()


class Numbers(dict):
    """Words and their numbers, 64-bit hashes other than 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little") or 1
        return n

    def of(self, text: str) -> list[int]:
        get = self.__getitem__
        return [get(w) for w in words(text)]


def grams(ids: np.ndarray) -> np.ndarray:
    """The hash of K words at each position; _NONE if one of them is 0, the gap between texts."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(K):
        part = x[i : i + n]
        h = (h ^ (part + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        known &= part != 0
    h[~known] = _NONE
    return h


def fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the smallest hash of each window of W."""
    h = grams(ids)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), h
    if n < W:
        at = np.array([int(h.argmin())])
    else:
        low = h[: n - W + 1].copy()
        which = np.zeros(n - W + 1, np.int64)
        for i in range(1, W):
            other = h[i : n - W + 1 + i]
            less = other <= low
            low[less] = other[less]
            which[less] = i
        at = np.unique(which + np.arange(n - W + 1))
    at = at[h[at] != _NONE]
    return at, h[at]


def longest_passage(doc: list[int], item: list[int]) -> tuple[int, int]:
    """Length in words of the longest passage of ``item`` in ``doc`` within the tolerance, and its first position in ``doc``."""
    pairs = [(b.a + i, b.b + i) for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() for i in range(b.size)]
    if not pairs:
        return 0, -1
    a, b = np.array(pairs).T
    wrong = np.concatenate([[0], np.cumsum(np.maximum(np.diff(a), np.diff(b)) - 1)])
    k = np.arange(len(pairs))
    errors = wrong[None, :] - wrong[:, None]
    # of L = matches + errors words, at most one in TOLERANCE may differ; differing words at the ends count as well
    matches = k[None, :] - k[:, None] + 1
    ok = (errors * (TOLERANCE - 1) <= matches) & (matches > 0)
    spare = np.where(ok, matches // (TOLERANCE - 1) - errors, 0)
    outside = a[:, None] + (len(item) - 1 - a[None, :])
    length = np.where(ok, matches + errors + np.minimum(spare, outside), 0)
    i, j = np.unravel_index(int(length.argmax()), length.shape)
    return int(length[i, j]), int(b[i])


def may_hold(doc: np.ndarray, item: np.ndarray) -> bool:
    """False only if no passage is possible.

    Every passage has a stretch of PASSAGE to 2 * PASSAGE - 1 words within the
    tolerance, so with at most DRIFT errors: its matches lie on DRIFT + 1
    neighbouring diagonals, and PASSAGE item words in a row have DRIFT misses
    at most.
    """
    i, d = np.nonzero(item[:, None] == doc[None, :])
    near = np.zeros((len(item) + 1, len(item) + len(doc) + DRIFT), np.int16)
    for shift in range(DRIFT + 1):
        near[i + 1, d - i + len(item) - 1 + shift] = 1
    upto = near.cumsum(axis=0, dtype=np.int16)
    return bool((upto[PASSAGE:] - upto[:-PASSAGE]).max(initial=0) >= PASSAGE - DRIFT)


def _dense(starts: np.ndarray, n: int, span: int) -> bool:
    """Whether the K words in a row at ``starts`` cover enough of some ``span`` words for a passage."""
    covered = np.zeros(n, np.int64)
    for i in range(K):
        covered[starts + i] = 1
    upto = np.concatenate([[0], np.cumsum(covered)])
    return bool((upto[np.minimum(np.arange(n) + span, n)] - upto[:-1]).max(initial=0) >= LEAST_COVERED)


def extended(ids: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Length and first position in ``ids`` of the longest passage of ``item``, (0, -1) if there is none.

    All K words in a row that both share are hits; those whose runs cover too
    few of the item's words for a passage are not aligned.
    """
    h, own = grams(ids), grams(item)
    order = np.argsort(own, kind="stable")
    own = own[order]
    lo, hi = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
    n = hi - lo
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, position = np.repeat(np.arange(len(h)), n), order[rows]
    best = (0, -1)
    if not (_dense(position, len(item), 2 * PASSAGE - 1) and _dense(at, len(ids), SPAN)):
        return best
    slack = len(item) // TOLERANCE + 4
    spans: list[tuple[int, int, set[int]]] = []
    for d, p in sorted(zip(at.tolist(), position.tolist())):
        first, last = max(0, d - p - slack), min(len(ids), d + len(item) - p + slack)
        if spans and first <= spans[-1][1]:
            start, end, covered = spans[-1]
            spans[-1] = (start, max(end, last), covered)
        else:
            covered = set()
            spans.append((first, last, covered))
        covered.update(range(p, p + K))
    for first, last, covered in spans:
        near = ids[first:last]
        if len(covered) >= LEAST_COVERED and may_hold(near, item):
            n_words, start = longest_passage(near.tolist(), item.tolist())
            best = max(best, (n_words, first + start))
    return best if best[0] >= PASSAGE else (0, -1)


def stretches(h: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches that may hold a passage, with their surroundings, in order; ``known``: which K words in a row an item may have."""
    covered = np.zeros(len(h) + K - 1 + 1, np.int64)
    for i in range(K):
        covered[i : i + len(h)][known] = 1
    upto = np.concatenate([[0], np.cumsum(covered)])
    ends = np.minimum(np.arange(len(covered)) + SPAN, len(covered))
    starts = np.flatnonzero((upto[ends] - upto[:-1] >= LEAST_COVERED) & (covered == 1))
    out: list[tuple[int, int]] = []
    for s in starts.tolist():
        if out and s - AROUND <= out[-1][1]:
            out[-1] = (out[-1][0], s + SPAN + AROUND)
        else:
            out.append((max(0, s - AROUND), s + SPAN + AROUND))
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, ids, grams, marks) of the items of PASSAGE words or more; null texts and ids are no items."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for batch in batches:
            ids = [np.array(numbers.of(t), np.uint64) for t in batch.pop("text")]
            rows = [(i, k, _signed(x), _signed(grams(x)), _signed(fingerprints(x)[1])) for i, k, x in zip(batch["item_id"], batch["item_key"], ids) if len(x) >= PASSAGE]
            yield pd.DataFrame(rows, columns=["item_id", "item_key", "ids", "grams", "marks"]).astype({"item_id": "int64", "item_key": "int64"})

    rows = benchmark.select("item_id", "text").dropna().distinct().withColumn("item_key", F.xxhash64("item_id", "text"))
    return cut(rows.mapInPandas(read, "item_id bigint, item_key bigint, ids array<bigint>, grams array<bigint>, marks array<bigint>"))


def gram_filter(items: DataFrame) -> np.ndarray:
    """A filter of 2**FILTER_BITS bits (one per hash) that holds all grams of the items; its words, at most 2**(FILTER_BITS - 6), are all that the driver sees."""
    bit = F.col("g").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    filled = items.select(F.explode("grams").alias("g")).select(bit.alias("_b")).distinct().groupBy(F.shiftright("_b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("v"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in filled.toLocalIterator():
        out[r["w"]] = np.int64(r["v"]).view(np.uint64)
    return out


def document_stretches(documents: DataFrame, filled: np.ndarray) -> DataFrame:
    """(doc_id, at, ids, grams, marks): stretches of texts that may hold a passage, with what they may share with items; texts are read whole."""
    shared = documents.sparkSession.sparkContext.broadcast(filled)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of, numbers = shared.value, Numbers()
        low, six = np.uint64((1 << FILTER_BITS) - 1), np.uint64(6)

        def known(h: np.ndarray) -> np.ndarray:
            bit = h & low
            return ((words_of[bit >> six] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool) & (h != _NONE)

        gap = [0] * (SPAN + K)
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), 200):
                flat, starts = [], []
                for t in batch["text"].iloc[lo : lo + 200]:
                    starts.append(len(flat))
                    flat += numbers.of(t)
                    flat += gap
                ids, begin = np.array(flat, np.uint64), np.array(starts)
                h = grams(ids)
                for a, b in stretches(h, known(h)):
                    # surroundings end with the text; a stretch that joins two texts' is cut at the gap
                    for k in range(int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b, "left"))):
                        first, end = max(a, starts[k]), min(b, (starts[k + 1] if k + 1 < len(starts) else len(flat)) - len(gap))
                        own = ids[first:end]
                        every, marks = (np.unique(x[known(x)]) for x in (grams(own), fingerprints(own)[1]))
                        if len(marks):
                            rows.append((batch["doc_id"].iat[lo + k], first - starts[k], _signed(own), _signed(every), _signed(marks)))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "ids", "grams", "marks"]).astype({"doc_id": "int64", "at": "int32"})

    return documents.select("doc_id", "text").dropna().mapInPandas(find, "doc_id bigint, at int, ids array<bigint>, grams array<bigint>, marks array<bigint>")


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, item_id, at, ids, item in batch[["doc_id", "item_id", "at", "ids", "item"]].itertuples(index=False, name=None):
            n, first = extended(np.asarray(ids).view(np.uint64), np.asarray(item).view(np.uint64))
            if n:
                rows.append((doc_id, item_id, n, at + first))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "position"]).astype({"doc_id": "int64", "item_id": "int64", "n_words": "int32", "position": "int32"})


def passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, position): the longest passage of each item in each document that holds one (the first of equally long ones).

    Null and empty texts hold none; an item of fewer than PASSAGE words has
    none; no items or no documents, no rows.
    """
    items = item_words(benchmark)
    found = cut(document_stretches(documents, gram_filter(items)))
    marks = found.select("doc_id", "at", F.explode("marks").alias("mark"))
    item_marks = items.select("item_key", F.explode("marks").alias("mark")).distinct()
    pairs = salted_join(marks, item_marks, "mark", "inner", F.struct("doc_id", "at")).select("doc_id", "at", "item_key").distinct()
    # the items' words are sent to all tasks if they were counted to be few; else pairs are shuffled to them
    few = (items.agg(F.sum(F.size("ids"))).first()[0] or 0) <= SENT_WORDS
    sides = items.select("item_key", "item_id", F.col("ids").alias("item"), F.col("grams").alias("own"))
    met = pairs.join(found.drop("marks"), ["doc_id", "at"]).join(F.broadcast(sides) if few else sides, "item_key")
    met = met.where(F.size(F.array_intersect("own", "grams")) >= LEAST_SHARED)
    alike = met.select("doc_id", "item_id", "at", "ids", "item").mapInPandas(_extend, "doc_id bigint, item_id bigint, n_words int, position int")
    best = F.max(F.struct("n_words", (-F.col("position")).alias("p")))
    return alike.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", F.col("_b.n_words").alias("n_words"), (-F.col("_b.p")).alias("position"))
