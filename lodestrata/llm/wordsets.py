"""Records as sets of words, and the signatures by which similar sets find each other.

The words of a record are the distinct runs of ASCII letters and digits in its lower-cased text; nulls count as
empty text. Records with the same words are one class, whose representative is its smallest id, so that copies
cost one row. Sets without any word are only the same if their texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.storage import joined, materialize

#: Words in at least this part of the classes have a weight of their own, if they are among the LEADING most frequent.
FREQUENT = 0.005
#: Bounds the table of words that occur together (LEADING squared counts a task) and the broadcast weights.
LEADING = 1024
#: Fewest classes with a word before its company says anything.
EVIDENCE = 30
#: Least and greatest weight. Their ratio bounds how far the weighted similarity can fall below the Jaccard similarity.
LEAST_WEIGHT, MOST_WEIGHT = 0.35, 2.0
#: One-bit minhashes of a set; the upper bits of its first signature batch. The lower 16 hold the number of its words.
MINHASHES = 48
#: Parity bits of a set, in two further batches: bit i is the parity of the number of words hashed to i.
PARITIES = 128
SIGNATURE = ["bits", "odd0", "odd1"]
#: Word counts of two sets together up to which parities are tested; beyond they are too full to tell.
WIDEST = 512


#: ASCII letters and digits in lower case, blanks for all other bytes; so a byte of a longer UTF-8 character is none of a word.
_WORD_BYTES = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Rows of one key up to which one task compares them (8 million pairs).
HOT = 4096


def keyed(records: DataFrame, texts: list[str], *others: Column | str) -> DataFrame:
    """(others..., ck, words) of records.

    ``words``: the sorted distinct words of the texts, joined by blanks. ``ck``: 16 bytes that are equal for equal word sets
    (for equal texts where there are no words).
    """
    whole = F.concat_ws(" ", *(F.coalesce(records[t], F.lit("")) for t in texts))
    rows = records.select(*others, whole.alias("whole"))

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, found = [], []
            for text in batch["whole"].cast(pa.binary()).to_pylist():
                low = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
                words = b" ".join(sorted(set(low.translate(_WORD_BYTES).split())))
                found.append(words)
                keys.append(md5(words or b"\n" + text, usedforsecurity=False).digest())
            at = batch.schema.get_field_index("whole")
            names = [n for n in batch.schema.names if n != "whole"]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(keys, pa.binary()), pa.array(found, pa.binary()).cast(pa.string())], [*names, "ck", "words"])

    kept = T.StructType([f for f in rows.schema.fields if f.name != "whole"])
    return rows.mapInArrow(split, kept.add("ck", "binary").add("words", "string"))


def classes(keys: DataFrame) -> DataFrame:
    """(ck, rep, words) of keyed records (id, ck, words), written to the shared folder."""
    # The key decides the words; grouping by both keeps strings out of the aggregates, so that Spark hashes and does not sort.
    return materialize(keys.groupBy("ck", "words").agg(F.min("id").alias("rep")), "classes", dictionary=False)


def word_weights(words: DataFrame) -> dict[str, float]:
    """Weights of the LEADING frequent words: the surprise -log P(word | w) at the word w that predicts it best.

    Phrases that many records share consist of words that predict each other and weigh little, however rare the phrase;
    a word chosen freely weighs more. Words that are not in the result weigh MOST_WEIGHT. Both passes count over all classes:
    the first counts words, the second, within each task, which frequent words occur together.
    """
    n = max(1, words.count())
    counted = words.select(F.explode(F.split("words", " ")).alias("w")).groupBy("w").count()
    leading = counted.filter((F.col("count") >= max(EVIDENCE, FREQUENT * n)) & (F.col("w") != "")).orderBy(F.desc("count"), "w").limit(LEADING).collect()
    if not leading:
        return {}
    names, sizes = [r["w"] for r in leading], np.array([r["count"] for r in leading], np.float64)

    def together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, k = pa.array(names), len(names)
        total = np.zeros(k * k, np.int64)
        for batch in it:
            lists = pc.split_pattern(batch["words"], " ")
            found = pc.fill_null(pc.index_in(lists.flatten(), column), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))[found >= 0]
            own = found[found >= 0].astype(np.int64)
            held = np.bincount(row, minlength=len(lists))  # leading words of each row; its pairs are the square
            first, pairs = np.cumsum(held) - held, np.cumsum(held**2)
            at = 0
            while at < len(lists):  # some four million pairs at once, or one row
                stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 22), "right")))
                words_at = slice(first[at], first[stop - 1] + held[stop - 1])
                each = held[row[words_at]]
                left = np.repeat(own[words_at], each)
                step = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
                total += np.bincount(left * k + own[np.repeat(first[row[words_at]], each) + step], minlength=k * k)
                at = stop
        counts = pa.FixedSizeListArray.from_arrays(pa.array(total.astype(np.int32)), k).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), counts], ["i", "counts"])

    def best(table: pa.Table) -> pa.Table:
        i = table["i"][0].as_py()
        both = np.sum([np.asarray(c) for c in table["counts"].to_pylist()], axis=0)
        share = both / sizes  # P(word i | word j)
        share[i] = 0
        return pa.table({"i": pa.array([i], pa.int32()), "share": pa.array([float(share.max())])})

    rows = words.select("words").mapInArrow(together, "i int, counts array<int>").groupBy("i").applyInArrow(best, "i int, share double")
    shares = {r["i"]: r["share"] for r in rows.collect()}  # LEADING rows at most
    weight = lambda share: float(np.clip(-np.log(max(share, 1e-9)), LEAST_WEIGHT, MOST_WEIGHT))
    return {w: weight(shares.get(i, 0.0)) for i, w in enumerate(names)}


def bit_threshold(similarity: float, miss: float, bits: int = MINHASHES) -> int:
    """Fewest agreeing one-bit minhashes at which P(similarity reached | agreement) is still >= miss.

    Bits of two sets agree with probability (1 + J) / 2. The prior of J is uniform; the posterior is integrated on a grid.
    """
    grid = np.linspace(0, 1, 2001)[1:-1]
    agree, m = (1 + grid) / 2, np.arange(bits + 1)[:, None]
    like = m * np.log(agree) + (bits - m) * np.log(1 - agree)
    like = np.exp(like - like.max(axis=1, keepdims=True))
    tail = like[:, grid >= similarity].sum(axis=1) / like.sum(axis=1)
    return int(np.argmax(tail >= miss))


def parity_thresholds(tenths: int, miss: float, bits: int) -> list[int]:
    """Most differing parities among the first ``bits`` of PARITIES at which P(similarity reached | difference) >= miss,
    for every total number of words from 0 to WIDEST.

    Sets of n words together that differ in d words have J = (n - d) / (n + d). Each differing word flips one of all
    parities, so the number of differing ones after d flips is a Markov chain; never is it above d. J has a uniform prior.
    """
    like = np.zeros((WIDEST + 1, bits + 1))  # row d: the distribution of differing parities
    like[0, 0] = 1
    h = np.arange(bits + 1)
    for d in range(1, WIDEST + 1):
        prev = like[d - 1]
        like[d] = prev * (1 - bits / PARITIES)
        like[d, 1:] += (prev * (bits - h) / PARITIES)[:-1]
        like[d, :-1] += (prev * h / PARITIES)[1:]
    out = []
    for n in range(WIDEST + 1):
        d = np.arange(n % 2, n + 1, 2)
        prior = 2 * n / (n + d + 1e-9) ** 2
        mass = like[d] * prior[:, None]
        near = (n - d) * 10 >= tenths * (n + d)
        total = mass.sum(axis=0)
        tail = np.where(total > 0, mass[near].sum(axis=0) / np.maximum(total, 1e-300), 0)
        fit = np.flatnonzero(tail >= miss)
        out.append(int(fit[-1]) if len(fit) else 0)
    return out


def _mixed(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each word (rows) and seed (columns)."""
    x = words[:, None] ^ seeds[None, :]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


class Signer:
    """Signatures of word sets: ``bands`` keys of ``rows`` weighted minhashes each, and the batches of SIGNATURE.

    The weighted minhashes draw a word with a probability in proportion to its weight, so that phrases which many
    records share bring few of them together; the one-bit minhashes and parities are unweighted.
    """

    def __init__(self, weights: dict[str, float], bands: int, rows: int, seed: int = 7):
        self.weights, self.bands, self.rows, self.seed = weights, bands, rows, seed
        rng = np.random.default_rng(seed)
        self.weighted = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
        self.plain = rng.integers(1, 2**63, MINHASHES, dtype=np.uint64)

    def sign(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(keys: records x bands, int64 >= 0; signatures: records x 3, int64) of non-empty word strings."""
        lists = pc.split_pattern(words, " ")
        starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
        weight = np.fromiter((self.weights.get(w, MOST_WEIGHT) for w in names), np.float32, len(names))[:, None]

        keys = np.empty((len(starts), self.bands), np.int64)
        for b in range(self.bands):
            u = _mixed(hashes, self.weighted[b * self.rows : (b + 1) * self.rows])
            cost = -np.log((u.astype(np.float32) + 1) / np.float32(2**32)) / weight
            low = np.minimum.reduceat(cost[at], starts, axis=0).view(np.uint32).astype(np.uint64)
            h = np.full(len(starts), b + 1, np.uint64)
            for r in range(self.rows):
                h = (h ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            keys[:, b] = (h >> np.uint64(1)).astype(np.int64)

        sizes = np.diff(np.append(starts, len(at))).astype(np.uint64)
        bits = np.minimum(sizes, np.uint64(0xFFFF))
        for j in range(0, MINHASHES, 16):
            low = np.minimum.reduceat(_mixed(hashes, self.plain[j : j + 16])[at], starts, axis=0) & np.uint32(1)
            for k in range(16):
                bits |= low[:, k].astype(np.uint64) << np.uint64(16 + j + k)
        place = (hashes >> np.uint64(20)) % np.uint64(PARITIES)
        flip = np.where(place[:, None] // np.uint64(64) == np.arange(2, dtype=np.uint64), np.uint64(1) << place[:, None] % np.uint64(64), np.uint64(0))
        odd = np.bitwise_xor.reduceat(flip[at], starts, axis=0)
        return keys, np.column_stack([bits, odd]).view(np.int64)


def signed(words: DataFrame, signer: Signer) -> DataFrame:
    """(key, rep, SIGNATURE...): one row per band of every class that has words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                keys, signs = signer.sign(batch["words"])
                n = keys.shape[1]
                cols = [keys.ravel(), np.repeat(np.asarray(batch["rep"]), n), *(np.repeat(b, n) for b in signs.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "rep", *SIGNATURE])

    rows = words.filter("words <> ''").select("rep", "words")
    return rows.mapInArrow(batches, "key long, rep long, " + ", ".join(f"{s} long" for s in SIGNATURE))


def agreeing(x: str, y: str, tenths: int, miss: float) -> Column:
    """Sequential test of the signature batches of rows ``x`` and ``y``; each is only looked at where those before pass."""
    differ = lambda c: F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
    size = lambda r: F.col(f"{r}.bits").bitwiseAND(F.lit(0xFFFF))
    words = (size(x) + size(y)).cast("int")
    most = lambda bits: F.coalesce(F.get(F.lit(parity_thresholds(tenths, miss, bits)), words), F.lit(PARITIES))
    minhashes = MINHASHES - F.bit_count(F.shiftrightunsigned(differ("bits"), 16)) >= bit_threshold(tenths / 10, miss)
    half = F.bit_count(differ("odd0"))
    return minhashes & (half <= most(PARITIES // 2)) & (half + F.bit_count(differ("odd1")) <= most(PARITIES))


def met(rows: DataFrame, tenths: int, miss: float) -> DataFrame:
    """(a, b, old), some several times: pairs of ``rows`` (key, rep, SIGNATURE..., old) of equal key that ``agreeing`` passes.

    a is never old; b is, or is greater than a. A task sorts the keys dealt to it and looks at those pairs only. The rows of a
    key that has more than HOT of them are handed on to a join, which Spark splits if it is skewed; so no task is left with
    all their pairs. What the tasks find is written once.
    """
    apart = MINHASHES - bit_threshold(tenths / 10, miss)
    half, whole = (np.array([*parity_thresholds(tenths, miss, bits), PARITIES]) for bits in (PARITIES // 2, PARITIES))
    hottest, names = HOT, ["a", "b", "old", "key", *SIGNATURE]

    def batch_of(n: int, **cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c]) if c in cols else pa.nulls(n, pa.int64()) for c in names], names)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = [b for b in it if b.num_rows]
        if not dealt:
            return
        table = pa.Table.from_batches(dealt)
        key = table["key"].to_numpy()
        at = np.argsort(key)
        same = key[at[1:]] == key[at[:-1]]
        at = at[np.append(same, False) | np.append(False, same)]  # most keys have one row, and are done
        if not len(at):
            return
        key, rep, bits, odd0, odd1, old = (table[c].to_numpy(zero_copy_only=False)[at] for c in ("key", "rep", *SIGNATURE, "old"))
        at = np.lexsort((rep, old, key))
        key, rep, bits, odd0, odd1, old = key[at], rep[at], bits[at].view(np.uint64), odd0[at].view(np.uint64), odd1[at].view(np.uint64), old[at]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        ends, hot = np.repeat(starts + sizes, sizes), np.repeat(sizes > hottest, sizes)
        for i in range(0, int(hot.sum()), 1 << 16):
            r = np.flatnonzero(hot)[i : i + (1 << 16)]
            yield batch_of(len(r), a=rep[r], old=old[r], key=key[r], bits=bits[r].view(np.int64), odd0=odd0[r].view(np.int64), odd1=odd1[r].view(np.int64))
        size, found, n = bits & np.uint64(0xFFFF), [], 0
        left, step = np.flatnonzero(~old & ~hot), 1
        while len(left := left[left + step < ends[left]]):  # pairs of a row and the one ``step`` rows on
            for i in range(0, len(left), 1 << 18):
                x = left[i : i + (1 << 18)]
                x = x[np.bitwise_count((bits[x] ^ bits[x + step]) >> np.uint64(16)) <= apart]
                words = np.minimum(size[x] + size[x + step], np.uint64(WIDEST + 1)).astype(np.int64)
                odd = np.bitwise_count(odd0[x] ^ odd0[x + step])
                fit = odd <= half[words]
                x, words, odd = x[fit], words[fit], odd[fit]
                x = x[odd.astype(np.int64) + np.bitwise_count(odd1[x] ^ odd1[x + step]) <= whole[words]]
                found.append((rep[x], rep[x + step], old[x + step]))
                n += len(x)
            step += 1
            if n > 1 << 16 or len(found) > 1 << 12:
                a, b, o = (np.concatenate(c) for c in zip(*found))
                yield batch_of(n, a=a, b=b, old=o)
                found, n = [], 0
        if n:
            a, b, o = (np.concatenate(c) for c in zip(*found))
            yield batch_of(n, a=a, b=b, old=o)

    schema = "a long, b long, old boolean, key long, " + ", ".join(f"{s} long" for s in SIGNATURE)
    rows = rows.select("key", "rep", *SIGNATURE, "old")
    found = materialize(rows.repartition("key").mapInArrow(compare, schema), "met", dictionary=False)
    pairs = found.filter("b is not null").select("a", "b", "old")
    hot = found.filter("b is null").select("key", F.col("a").alias("rep"), *SIGNATURE, "old")
    if hot.isEmpty():
        return pairs
    x, y = hot.filter("not old").alias("x"), hot.hint("merge").alias("y")
    like = (F.col("x.key") == F.col("y.key")) & (F.col("y.old") | (F.col("x.rep") < F.col("y.rep"))) & agreeing("x", "y", tenths, miss)
    return pairs.unionByName(x.join(y, like).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), "y.old"))


def verified(pairs: DataFrame, words_a: DataFrame, words_b: DataFrame, tenths: int) -> DataFrame:
    """Those pairs (a, b) whose word sets' Jaccard similarity is at least tenths / 10, computed exactly."""
    a = words_a.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    b = words_b.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    both = joined(joined(pairs, a, "a"), b, "b").withColumns({"wa": F.split("wa", " "), "wb": F.split("wb", " ")})
    both = both.withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    both = both.withColumn("either", F.size("wa") + F.size("wb") - F.col("shared"))
    return both.filter(F.col("shared") * 10 >= F.col("either") * tenths).select("a", "b", (F.col("shared") / F.col("either")).alias("similarity"))
