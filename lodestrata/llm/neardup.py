"""Near-duplicate records with small edits: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import wordsets


@dataclass(frozen=True)
class NearDuplicates:
    """``members`` (id, rep): the class of every record; ``links`` (a, b, similarity): similar classes, a < b."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every pair of similar records, copies expanded."""
        left = self.members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
        right = self.members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        linked = self.links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        same = left.join(right, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        return linked.unionByName(same)

    def per_record(self) -> DataFrame:
        """(id, rep, links): one row per record with its class and the number of other classes similar to it."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        return self.members.join(ends, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(
    records: DataFrame, id_col: str, texts: list[str], tenths: int = 8, bands: int = 32, rows: int = 4, miss: float = 0.0001
) -> NearDuplicates:
    """Classes of equal word sets, and all links of Jaccard similarity >= ``tenths`` / 10 between them.

    Band keys of weighted minhashes bring candidates together. On each candidate three signature batches are compared in
    turn: 48 one-bit minhashes, then 64 and 128 word parities. It is dropped as soon as the posterior probability of reaching
    the threshold falls below ``miss``. Survivors are verified on their whole word sets, so no link is wrong. A link of
    weighted similarity s, which may be below its Jaccard similarity where freely chosen words differ, has no common key with
    probability (1 - s ** rows) ** bands; more ``bands`` lose fewer links. ``miss`` is the posterior at which a test
    gives up, not a bound on the links that the tests lose together.
    Copies are one class and cost one row. There is no cap on a band's size: a large one is a skewed join, which Spark
    splits. Null texts count as empty; records without words link only to records of the same text; ids must be unique
    and not null (rows with a null id are left out); other columns are ignored; an empty table gives empty results.
    """
    keys = wordsets.keyed(records.filter(records[id_col].isNotNull()), texts, records[id_col].alias("id"))
    words = wordsets.classes(keys)
    members = keys.select("id", "ck").join(words.select("ck", "rep"), "ck").select("id", "rep")
    signer = wordsets.Signer(wordsets.word_weights(words), bands=bands, rows=rows)
    signed = wordsets.signed(words, signer)
    x, y = signed.alias("x"), signed.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & wordsets.agreeing("x", "y", tenths, miss))
    candidates = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    return NearDuplicates(members, wordsets.verified(candidates, words, words, tenths))
