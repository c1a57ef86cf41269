"""Subject areas of documents by class-association rules.

Labelled examples are cut into sentences; a sentence's items are its words. Spark's parallel frequent-pattern growth mines
the itemsets that occur with a subject; each gives a rule, and a rule is pruned if a more general one is at least as sure.
A rule's evidence is the log-odds of its subject, calibrated on sentences that had no part in mining: a fifth of the examples is
held out, and confidences are shrunk to what rules as sure as these achieve there. A sentence speaks for a subject by
the evidence of all rules that it meets; a paragraph or list is about a subject if at least two of its sentences and a share
of those that speak at all do, and a document has the subjects of its paragraphs. A second round mines again with the
sentences of confidently judged paragraphs of all documents, so that words which the few examples lack are learnt too.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import Shared, materialize

LABEL = "="
#: Label of sentences that belong to no subject.
NONE = ""
#: Distinct sentences that a task keeps the verdicts of before it forgets them.
REMEMBERED = 200_000
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_SKIPPED = re.compile(r"\s*(?:#{1,6}\s|[=-]{3,}\s*$|```)")
_BLOCK = re.compile(r"\n[ \t\r]*\n")
_END = re.compile(r"(?<=[.!?])\s+")
_BEYOND, _MIXED, _ITEM = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[_\d/]"), re.compile(r"[a-z]{2,}")


def paragraphs(text: str) -> list[list[str]]:
    """Paragraphs and lists as their sentences; headings are left out, line breaks within a sentence are undone."""
    out = []
    for block in _BLOCK.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        current: list[str] = []
        for line in block.split("\n"):
            if _SKIPPED.match(line):
                continue
            if not current or _LIST.match(line):
                current.append(_LIST.sub("", line))
            else:
                current[-1] += " " + line.strip()
        sentences = [s for item in current for s in _END.split(item.strip()) if s.strip()]
        if sentences:
            out.append(sentences)
    return out


def items(sentence: str) -> list[str]:
    """Distinct words of at least two letters, in plain ASCII.

    Letters beyond ASCII are dropped, not folded, so that wrongly decoded texts give the same items as right ones.
    Identifiers and words with digits are left out.
    """
    if not sentence.isascii():
        sentence = _BEYOND.sub("", unicodedata.normalize("NFC", sentence).replace("’", " "))
    out: dict[str, None] = {}
    for word in sentence.replace("'", " ").lower().split():
        if word.isalpha():
            if len(word) > 1:
                out[word] = None
        elif not _MIXED.search(word):
            out.update(dict.fromkeys(_ITEM.findall(word)))
    return list(out)


class Rules:
    """Class-association rules: antecedents of up to three items, each with a subject and its evidence."""

    def __init__(self, counted: list[tuple[tuple[str, ...], str, int]], totals: dict[str, int], subjects: list[str], smoothing: float = 0.1, margin: float = 2.0):
        self.subjects, self.margin = subjects, margin
        by: dict[tuple[str, ...], Counter] = {}
        for antecedent, subject, n in counted:
            by.setdefault(tuple(sorted(antecedent)), Counter())[subject] += n
        k = len(subjects)
        mean = sum(totals.values()) / k if totals else 1
        self.sure: dict[tuple[str, ...], tuple[str, float]] = {}
        for antecedent in sorted(by, key=lambda a: (len(a), a)):
            counts = {s: n * mean / totals[s] for s, n in by[antecedent].items() if totals.get(s)}
            total = sum(counts.values())
            if not total:
                continue
            best = max(counts, key=lambda s: (counts[s], s))
            sure = (counts[best] + smoothing) / (total + smoothing * k)
            general = [self.sure[a] for a in self._parts(antecedent) if a in self.sure]
            if sure < 0.5 or any(s == best and c >= sure for s, c in general):
                continue  # says nothing, or nothing that a part of it doesn't say
            self.sure[antecedent] = (best, sure)
        self.index(lambda sure: sure)

    def index(self, calibrated: Callable[[float], float]) -> None:
        """Rules with the log-odds of their calibrated confidence, by that item of theirs which the fewest rules have."""
        self.by_item: dict[str, list[tuple[tuple[str, ...], int, float]]] = {}
        place = {s: i for i, s in enumerate(self.subjects)}
        often = Counter(x for a in self.sure for x in a)
        for antecedent, (subject, sure) in self.sure.items():
            p = min(max(calibrated(sure), 0.5), 1 - 1e-6)
            if p > 0.5:
                item = min(antecedent, key=lambda x: (often[x], x))
                self.by_item.setdefault(item, []).append((tuple(x for x in antecedent if x != item), place[subject], math.log(p / (1 - p))))

    @staticmethod
    def _parts(a: tuple[str, ...]) -> list[tuple[str, ...]]:
        if len(a) == 1:
            return []
        return [a[:i] + a[i + 1 :] for i in range(len(a))] + ([(x,) for x in a] if len(a) == 3 else [])

    def evidence(self, own: list[str]) -> dict[int, float]:
        """Evidence of a set of items for each subject (by place): the sum over all rules that it meets."""
        have, score, by_item = set(own), {}, self.by_item
        for item in own:
            if item in by_item:
                for rest, subject, odds in by_item[item]:
                    if not rest or have.issuperset(rest):
                        score[subject] = score.get(subject, 0.0) + odds
        return score

    def kept(self, held: list[tuple[str, list[str]]], bins: int = 5, prior: float = 2.0) -> Callable[[float], float]:
        """The confidence that rules of a confidence achieve on ``held`` (subject, items) that had no part in mining them."""
        edges = np.quantile([c for _, c in self.sure.values()], np.linspace(0, 1, bins + 1)[1:-1]) if self.sure else np.array([])
        right, seen, said = np.zeros(bins), np.zeros(bins), np.zeros(bins)
        by = {}
        for antecedent, (subject, sure) in self.sure.items():
            by.setdefault(antecedent[0], []).append((antecedent, subject, sure))
        for subject, own in held:
            have = set(own)
            for first in own:
                for antecedent, says, sure in by.get(first, ()):
                    if have.issuperset(antecedent):
                        b = int(np.searchsorted(edges, sure))
                        right[b] += says == subject
                        said[b] += sure
                        seen[b] += 1
        ratio = (right + prior) / (said + prior)  # 1 where nothing was seen
        return lambda sure: min(0.9999, sure * min(1.0, float(ratio[int(np.searchsorted(edges, sure))])))

    def judge(self, own: list[str]) -> str | None:
        """The subject that a sentence with these items speaks for: summed evidence, by a margin over the next; or None."""
        score = self.evidence(own)
        if not score:
            return None
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
        ahead = ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)
        return self.subjects[ranked[0][0]] if ahead >= self.margin else None

    def says(self, sentence: str) -> str | None:
        """The subject that a sentence speaks for, or None."""
        return self.judge(items(sentence))


class Judge:
    """Verdicts of sentences, each distinct one being looked at once."""

    def __init__(self, rules: Rules):
        self.rules, self.known = rules, {}

    def votes(self, sentences: list[str]) -> list[str | None]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for s in sentences:
            if s not in self.known:
                self.known[s] = self.rules.says(s)
            out.append(self.known[s])
        return out

    def paragraph(self, sentences: list[str], share: float = 0.4) -> list[str]:
        """Subjects that a paragraph or list is about."""
        votes = Counter(v for v in self.votes(sentences) if v)  # neither None nor NONE
        speaking = sum(votes.values())
        return sorted(s for s, n in votes.items() if n >= 2 and n >= share * speaking)


SENTENCE = "subject string, sentence string, weight long"


def _baskets(labelled: DataFrame) -> DataFrame:
    """(subject, items, weight): one row for each different set of items of a subject, with its number of sentences."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = [sorted(items(s)) for s in batch["sentence"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["subject"], pa.array(lists, pa.list_(pa.string())), batch["weight"]], ["subject", "items", "weight"])

    rows = labelled.mapInArrow(cut, "subject string, items array<string>, weight long")
    return rows.groupBy("subject", "items").agg(F.sum("weight").alias("weight"))


def mine(labelled: DataFrame, subjects: list[str], support: float = 0.0, least: int = 2, longest: int = 3, margin: float = 2.0) -> Rules:
    """Rules from (subject, sentence, weight) rows by frequent-pattern growth over words that lean to some subject.

    Equal sentences come once, with their number as weight. Words spread evenly over subjects are left out before mining, as
    no rule needs them; of the words that are left, those that are in nearly the same sentences are one item, since no rule
    can tell them apart, which keeps itemsets few however long a repeated sentence is.
    """
    rows = materialize(_baskets(labelled), "baskets")
    totals = {r["subject"]: r["n"] for r in rows.groupBy("subject").agg(F.sum("weight").alias("n")).collect()}
    n = sum(totals.values())
    if not n:
        return Rules([], {}, subjects, margin=margin)
    least = max(least, math.ceil(support * n))
    flat = rows.select("subject", "weight", F.explode("items").alias("item"), F.xxhash64("subject", "items").alias("row"))
    by_subject = flat.groupBy("item", "subject").agg(F.sum("weight").alias("n"), F.bit_xor("row").alias("rows"))
    tops = by_subject.groupBy("item").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.bit_xor("rows").alias("rows"))
    leaning = tops.filter((F.col("all") >= least) & (F.col("top") >= 0.4 * F.col("all")))
    # Words of exactly the same sentences are one item, named by the first of them.
    twins = leaning.groupBy("rows", "all").agg(F.min("item").alias("name"), F.collect_list("item").alias("words"))
    twins = materialize(twins.select("name", "words"), "twins")
    names = twins.select(F.explode("words").alias("item"), "name")
    others = {r["name"]: r["words"] for r in twins.filter(F.size("words") > 1).collect()}  # each in a part of all sentences
    numbered = rows.select(F.xxhash64("subject", "items").alias("row"), "subject", "weight", F.explode("items").alias("item")).join(names, "item")
    kept = numbered.groupBy("row", "subject", "weight").agg(F.collect_set("name").alias("items"))
    # A basket stands for ``weight`` sentences; mining counts rows, so it comes as often, in powers that FP-growth merges.
    counted = _frequent(kept, least, n, longest)
    counted += [((w,), subject, n) for (name, *more), subject, n in counted if not more for w in others.get(name, ()) if w != name]
    return Rules(counted, totals, subjects, margin=margin)


def _frequent(kept: DataFrame, least: int, n: int, longest: int) -> list[tuple[tuple[str, ...], str, int]]:
    """(items, subject, number) of itemsets that occur with a subject at least ``least`` times."""
    baskets = kept.select(F.concat(F.array(F.concat(F.lit(LABEL), "subject")), F.sort_array("items")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("_")).select("items")
    frequent = FPGrowth(minSupport=least / n, itemsCol="items").fit(baskets).freqItemsets
    with_label = frequent.filter(F.exists("items", lambda x: x.startswith(LABEL)) & F.size("items").between(2, longest + 1))
    counted = []
    for r in with_label.toLocalIterator():  # each in a part ``support`` of all sentences at least
        subject = next(x for x in r["items"] if x.startswith(LABEL))
        counted.append((tuple(x for x in r["items"] if x != subject), subject[len(LABEL) :], r["freq"]))
    return counted


def _sentences(examples: DataFrame) -> DataFrame:
    """(subject, sentence, weight, held): ``held`` for the fifth of the examples that is kept from mining."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [(a, s, 1, h) for a, t, h in zip(*(batch[c].to_pylist() for c in ("subject", "text", "held"))) for p in paragraphs(t) for s in p]
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["subject", "sentence", "weight", "held"])

    rows = examples.filter("subject is not null and text is not null")
    return rows.select("subject", "text", (F.pmod(F.xxhash64("subject", "text"), F.lit(5)) == 0).alias("held")).mapInArrow(cut, f"{SENTENCE}, held boolean")


def _sure(documents: DataFrame, rules: Rules) -> DataFrame:
    """(subject, sentence, weight) of paragraphs of the documents on whose subject nearly all sentences agree, and of
    those in which at most one says anything, as NONE."""
    shared = Shared(documents.sparkSession, rules)

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(shared.value)
        for batch in it:
            out: Counter = Counter()
            for text in batch["text"].to_pylist():
                for p in paragraphs(text):
                    votes = Counter(v for v in own.votes(p) if v)
                    subject, top = votes.most_common(1)[0] if votes else (NONE, 0)
                    if top >= 2 and top >= 0.75 * sum(votes.values()):
                        out.update((subject, s) for s in p)
                    elif len(p) >= 2 and sum(votes.values()) <= 1:
                        out.update((NONE, s) for s in p)
            cols = [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["subject", "sentence", "weight"])

    return documents.filter("text is not null").select("text").mapInArrow(found, SENTENCE)


def learn(examples: DataFrame, documents: DataFrame, rounds: int = 1, support: float = 0.0002) -> Rules:
    """Rules from the examples, then again from examples and the sure paragraphs of all documents.

    ``support`` is the part of all sentences that an itemset of the later rounds must occur in; it bounds what comes to
    the driver to (itemsets of a sentence) / support, however many documents there are.
    """
    subjects = sorted(r["subject"] for r in examples.select("subject").distinct().collect() if r["subject"])
    own = materialize(_sentences(examples), "examples")
    held = [(r["subject"], items(r["sentence"])) for r in own.filter("held").select("subject", "sentence").collect()]  # labelled examples
    some = own.filter("not held").drop("held")
    rules = mine(own.drop("held"), subjects, margin=1.0)
    rules.index(mine(some, subjects).kept(held))  # as sure as rules of the other examples are on the held ones
    for _ in range(rounds if subjects else 0):
        more = materialize(some.unionByName(_sure(documents, rules)), "sentences")
        rules = mine(more, [*subjects, NONE], support=support)
        rules.index(rules.kept(held))
    return rules


def classify(documents: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, subject): every subject that a paragraph or list of a document is about. Null ids and texts give none."""
    shared = Shared(documents.sparkSession, rules)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(shared.value)
        for batch in it:
            out = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                out += [(i, s) for s in sorted({s for p in paragraphs(text) for s in own.paragraph(p)})]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["doc_id", "subject"])

    rows = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, subject string")


def subjects_of(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, subject) of documents (doc_id, text), learnt from examples (subject, text); both may have other columns."""
    return classify(documents, learn(examples, documents))
