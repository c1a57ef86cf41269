"""Filling fixed-capacity containers with documents, by hierarchical multi-length packing.

Documents are measured in tokens of a public tokenizer and cut only where longer than a container. Each piece is routed to
the tier of the shortest window that holds it. From the longest tier to the shortest, the pieces of a tier are packed into
windows of its size, by best fit, and the gaps left in these windows are filled with pieces of shorter tiers; so a short
document is in a long window only where that would else be empty. What would leave short windows half empty goes up into
long ones. Windows are then put together to containers, each of
one long window or of several shorter ones, and containers are dealt into step groups of one layout, balanced by attention
cost, so that the workers of a training step take about equally long.

All this happens within shards of about equal token counts, so that no task grows with the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import Shared, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with an id and a text. ``tokenizer`` is a file of ranks that the driver reads."""
    with open(tokenizer, "rb") as f:
        shared = Shared(documents.sparkSession, f.read())  # a vocabulary, about 1 MB

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in it:
            sizes = [len(coder.encode_ordinary(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    rows = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, tokens long")


class _Bag:
    """Items by number; the largest of at most, or the smallest of at least, a given number is found by one bit scan."""

    def __init__(self) -> None:
        self.items: dict[int, list[int]] = {}
        self.present = 0  # bit n: there is an item of number n

    def put(self, number: int, item: int) -> None:
        self.items.setdefault(number, []).append(item)
        self.present |= 1 << number

    def take(self, number: int) -> int:
        own = self.items[number]
        item = own.pop()
        if not own:
            self.present &= ~(1 << number)
        return item

    def at_most(self, number: int) -> int:
        return (self.present & ((1 << (number + 1)) - 1)).bit_length() - 1

    def at_least(self, number: int) -> int:
        above = self.present >> number
        return number + (above & -above).bit_length() - 1 if above else -1


def _best_fit(items: list[int], sizes: np.ndarray, window: int, where: np.ndarray, kinds: list[int], gaps: _Bag) -> None:
    """Put items, largest first, each into the fullest window of ``gaps`` that holds it, or into a new one."""
    for item in items:
        size = int(sizes[item])
        gap = gaps.at_least(size)
        if gap >= 0:
            w = gaps.take(gap)
        else:
            w, gap = len(kinds), window
            kinds.append(window)
        where[item] = w
        gaps.put(gap - size, w)


def windows(sizes: np.ndarray, tiers: list[int], least: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """(window number of every item, size of every window); ``tiers`` are window sizes in falling order, the first holds all.

    Shorter windows that stay emptier than ``least``, because nothing is left to fill them, are given up and their items
    share long ones.
    """
    where, kinds = np.full(len(sizes), -1, np.int64), []
    order = np.argsort(-sizes, kind="stable")
    bags = []
    for high, low in zip(tiers, [*tiers[1:], 0]):
        bag = _Bag()
        for i in order[(sizes[order] <= high) & (sizes[order] > low)][::-1]:  # of equal items the first is taken first
            bag.put(int(sizes[i]), int(i))
        bags.append(bag)
    for t, window in enumerate(tiers):
        own, gaps, first, items = bags[t], _Bag(), len(kinds), []
        while own.present:
            items.append(own.take(own.present.bit_length() - 1))
        _best_fit(items, sizes, window, where, kinds, gaps)  # the tier by itself
        left = {w: gap for gap, ws in gaps.items.items() for w in ws}
        for w in sorted(range(first, len(kinds)), key=lambda w: -left[w]):  # then its gaps, the widest first
            gap = left[w]
            for shorter in bags[t + 1 :]:
                while gap and (size := shorter.at_most(gap)) > 0:
                    where[shorter.take(size)] = w
                    gap -= size
    kind = np.array(kinds, np.int64)
    used = np.bincount(where, weights=sizes, minlength=len(kinds)) if len(kinds) else np.array([])
    weak = (kind < tiers[0]) & (used < least * kind)
    if weak.any():
        gaps = _Bag()
        for w in np.flatnonzero((kind == tiers[0]) & (used < kind)):
            gaps.put(int(kind[w] - used[w]), int(w))
        _best_fit([int(i) for i in order if weak[where[i]]], sizes, tiers[0], where, kinds, gaps)
        names, where = np.unique(where, return_inverse=True)
        kind = np.array(kinds, np.int64)[names]
    return where, kind


def containers(kinds: np.ndarray, used: np.ndarray, capacity: int) -> np.ndarray:
    """Container of every window: windows of one size together as far as they fill a container, rests of all sizes after."""
    out, opened, rest = np.empty(len(kinds), np.int64), 0, []
    for kind in sorted(set(kinds.tolist()), reverse=True):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(-used[own], kind="stable")]
        each = max(1, capacity // kind)
        whole = len(own) // each * each
        out[own[:whole]] = opened + np.arange(whole) // each
        opened += whole // each
        rest += own[whole:].tolist()
    free = 0
    for w in rest:  # fewer than a container of each size
        if kinds[w] > free:
            opened, free = opened + 1, capacity
        out[w] = opened - 1
        free -= kinds[w]
    return out


def balanced(cost: np.ndarray, layout: np.ndarray, group: int) -> np.ndarray:
    """Group number of every container: groups of one layout and about ``group`` containers, dealt in turns by falling cost."""
    out, opened = np.empty(len(cost), np.int64), 0
    for kind in np.unique(layout)[::-1]:
        own = np.flatnonzero(layout == kind)
        own = own[np.argsort(-cost[own], kind="stable")]
        n = -(-len(own) // group)
        turn, place = np.divmod(np.arange(len(own)), n)
        out[own] = opened + np.where(turn % 2, n - 1 - place, place)
        opened += n
    return out


def pack(
    documents: DataFrame, capacity: int = 2048, tiers: tuple[int, ...] = (1024, 512), group: int = 8, shard_tokens: int = 1 << 21, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(doc_id, part, first_token, tokens, container_id, window, window_size, place, step_group): every token once.

    Containers hold ``capacity`` tokens. ``tiers`` are the sizes of shorter windows; a container holds one window of the whole
    capacity or several shorter ones, ``window`` is its number within the container, and no document crosses windows. Only
    documents over ``capacity`` are split, into parts of that size and a rest. Null ids and texts, and texts without
    a token, are in no container. Documents with equal ids are packed as rows of their own. A shard holds about
    ``shard_tokens`` tokens; only its last windows of each tier and its last container are less than full.
    """
    sizes = [capacity, *sorted((t for t in set(tiers) if 0 < t < capacity), reverse=True)]
    counts = materialize(token_counts(documents, tokenizer), "tokens")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))
    parts = counts.filter("tokens > 0").select("doc_id", "tokens", F.posexplode(starts).alias("part", "first_token"))
    parts = parts.withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("first_token")))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "part"], ignore_index=True)
        size = shard["size"].to_numpy()
        own, kinds = windows(size, sizes)
        box = containers(kinds, np.bincount(own, weights=size, minlength=len(kinds)), capacity)
        cost = np.bincount(box[own], weights=size.astype(np.float64) ** 2)  # attention within documents
        layout = np.zeros(len(cost), np.int64)
        np.maximum.at(layout, box, kinds)
        base = int(shard["shard"].iloc[0]) << 32
        number = pd.Series(np.arange(len(kinds))).groupby(box).cumcount().to_numpy()  # of a window in its container
        out = shard.assign(container_id=base + box[own], window=number[own], window_size=kinds[own], step_group=base + balanced(cost, layout, group)[box[own]])
        out["place"] = out.groupby(["container_id", "window"]).cumcount()
        return out[["doc_id", "part", "first_token", "size", "container_id", "window", "window_size", "place", "step_group"]]

    schema = "doc_id long, part int, first_token long, tokens long, container_id long, window int, window_size int, place int, step_group long"
    packed = parts.select("shard", "doc_id", "part", "first_token", "size").groupBy("shard")
    return packed.applyInPandas(lambda x: one(x).rename(columns={"size": "tokens"}), schema)
