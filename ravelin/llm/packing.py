"""Filling containers of fixed capacity with whole texts: bounded-space online packing.

Texts are measured where they lie (only ids and token counts are shuffled).
Those longer than a container fill whole containers and leave a remainder.
Items of a source are spread over blocks of some BLOCK_CONTAINERS containers'
worth of tokens, so that a source with a third of all rows is packed by many
tasks and nearly everything is packed online, whatever the size.  A block is
read as a stream with a fixed number of open windows: an item goes to the window
it fits best; if it fits into none, the fullest window is closed and emitted and
a new one opened.  At the end of a block its open windows are left over.  Those
of MERGED blocks of a source (a bounded number) are merged in one task: their
items are packed again, largest first, best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.session import cut, salted_join

CAPACITY, WINDOWS = 2048, 16
#: A block holds about so many containers' worth of tokens; the leftovers of so many blocks are merged together.
BLOCK_CONTAINERS, MERGED = 512, 64
#: A vocabulary of ranks of a byte-level BPE (any in that form will do); the same path on all executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict = {}
_ITEM = "source string, doc_id bigint, piece int, tokens int, container_id string, leftover boolean"


def encoding(path: str):
    """The encoder of a vocabulary file, once per worker."""
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ravelin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every text that isn't null or empty; the whole text is counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            batch["n_tokens"] = [len(encode(t)) for t in batch.pop("text")]
            yield batch

    rows = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return rows.mapInPandas(count, "doc_id bigint, source string, n_tokens int")


def _online(key: str, items: Iterator[tuple], capacity: int, windows: int) -> Iterator[tuple[str, bool, list]]:
    """(container, leftover, items) of one block, with at most ``windows`` windows open; an item is (doc_id, piece, tokens)."""
    free: list[tuple[int, int]] = []
    held: dict[int, list] = {}
    opened = 0
    for item in items:
        size = item[2]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, window = free.pop(at)
        else:
            if len(free) == windows:
                _, fullest = free.pop(0)
                yield f"{key}-{fullest}", False, held.pop(fullest)
            room, window = capacity, opened
            held[window], opened = [], opened + 1
        held[window].append(item)
        if room == size:
            yield f"{key}-{window}", False, held.pop(window)
        else:
            insort(free, (room - size, window))
    for _, window in free:
        yield f"{key}-{window}", True, held[window]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, largest sizes first, each to the fullest bin that it fits."""
    bins = [0] * len(sizes)
    free: list[tuple[int, int]] = []
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i] = b
        insort(free, (room - sizes[i], b))
    return bins


def _pack_blocks(capacity: int, windows: int) -> Callable:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from batch[["source", "block", "doc_id", "piece", "tokens"]].itertuples(index=False, name=None)

        rows: list[tuple] = []
        it = stream()
        ahead = next(it, None)
        while ahead is not None:
            source, block = ahead[0], ahead[1]

            def own() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == (source, block):
                    yield ahead[2:]
                    ahead = next(it, None)

            for container, leftover, items in _online(f"b{block}", own(), capacity, windows):
                rows += [(source, *item, container, leftover) for item in items]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ITEM.split(", ")])
                    rows = []
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ITEM.split(", ")])

    return pack


def pack(sized: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, block_containers: int = BLOCK_CONTAINERS) -> DataFrame:
    """(source, doc_id, piece, token_start, tokens, container_id): where each text, or each piece of a longer one, lies.

    ``sized`` is (doc_id, source, n_tokens).  Containers are named within a
    source; a null source is a source of its own.  Texts without tokens are
    left out.  Only a text longer than ``capacity`` has several pieces.
    """
    # a null source is told by the first letter, as pandas has no equal nulls
    named = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    sized = cut(sized.where(F.col("n_tokens") > 0).select("doc_id", named.alias("source"), "n_tokens"))
    totals = sized.groupBy("source").agg(F.ceil(F.sum("n_tokens") / (capacity * block_containers)).cast("int").alias("_blocks"))
    n = F.col("n_tokens")
    pieces = F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)
    spread = salted_join(sized, totals, "source", "inner", F.col("doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    cut_up = spread.select("source", "block", "doc_id", "n_tokens", F.explode(pieces).alias("piece"))
    cut_up = cut_up.select("source", "block", "doc_id", "piece", F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("tokens"))
    packed = cut(cut_up.repartition("source", "block").sortWithinPartitions("source", "block", "doc_id", "piece").mapInPandas(_pack_blocks(capacity, windows), _ITEM))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        group["container_id"] = [f"m{key[1]}-{b}" for b in best_fit_decreasing(group["tokens"].tolist(), capacity)]
        return group

    together = F.floor(F.regexp_extract("container_id", r"^b(\d+)-", 1).cast("int") / MERGED).cast("int")
    merged = packed.where("leftover").groupBy("source", together.alias("_g")).applyInPandas(merge, _ITEM)
    rows = packed.where(~F.col("leftover")).unionByName(merged)
    source = F.when(F.col("source").startswith("s"), F.substring("source", 2, 1 << 30))
    return rows.select(source.alias("source"), "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), "tokens", "container_id")


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(source, container_id, n_items, fill, free) of every container."""
    return placed.groupBy("source", "container_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("fill")).withColumn("free", F.lit(capacity) - F.col("fill"))
