"""Model-in-the-loop operators: prompts as columns, responses by a join or a client, parsing and application in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.findings import SEVERITIES

# Phrases by which a reported contradiction takes itself back, and hedging ones.
SELF_NEGATING = [
    "no contradiction", "no direct contradiction", "no clear contradiction", "not a contradiction", "does not contradict", "does not actually contradict",
    "does not directly contradict", "are compatible", "is compatible", "are consistent", "is consistent",
]
VAGUE = [
    "may not", "might not", "could be", "seems to", "appears to", "potentially", "possibly", "not entirely clear", "slightly different", "minor difference",
    "subtle difference", "arguably", "debatable",
]

JUDGEMENT = "struct<is_real:boolean,adjusted_severity:string,summary:string,reasoning:string>"


def json_object(response: Column) -> Column:
    """The JSON object of a response: within a fence if there is one, else from the first { to the last }; null if none."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def judge_prompt(title: Column, detector: Column, severity: Column, path: Column, description: Column, evidence: Column) -> Column:
    """One prompt a finding. ``evidence`` is an array of texts."""
    proof = F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) > 0, F.array_join(evidence, "\n---\n")).otherwise("(no evidence)")
    return F.concat(
        F.lit("Decide whether this finding is real. Answer with one JSON object holding is_real, adjusted_severity, summary and reasoning.\n\nItem: "), title,
        F.lit("\nDetector: "), detector, F.lit(" / "), severity, F.lit("\nFile: "), F.coalesce(path, F.lit("(none)")), F.lit("\nDetails: "), description, F.lit("\n\nEvidence:\n"), proof,
    )


def ask(prompts: DataFrame, client: Callable[[list[str]], list[str | None]], batch: int = 20) -> DataFrame:
    """(id, response) of prompts (id, prompt): ``client`` runs on executors on lists of at most ``batch`` prompts.

    A failing call leaves its responses null; no other row is lost.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    answers = list(client(part["prompt"].tolist()))
                except Exception:  # noqa: BLE001 - one failed call must not fail the job
                    answers = [None] * len(part)
                yield pd.DataFrame({"id": part["id"], "response": answers})

    return prompts.select("id", "prompt").mapInPandas(run, "id long, response string")


def judge(findings: DataFrame, responses: DataFrame, cap: float = 0.3) -> DataFrame:
    """Findings (id, severity, confidence) with the judgement of their response (id, response) applied.

    Verdict: confirmed unless is_real is false; inconclusive where the response has no JSON object; null without a
    response. A valid adjusted severity replaces the own; a rejected finding's confidence is at most ``cap``.
    """
    parsed = responses.select("id", F.col("response").isNotNull().alias("_asked"), F.from_json(json_object(F.col("response")), JUDGEMENT).alias("_j"))
    rows = findings.join(parsed, "id", "left")
    real = F.coalesce(F.col("_j.is_real"), F.lit(True))
    known = F.col("_j").isNotNull() & F.coalesce(F.col("_j.is_real").isNotNull() | F.col("_j.summary").isNotNull() | F.col("_j.adjusted_severity").isNotNull(), F.lit(False))
    verdict = F.when(F.col("_asked"), F.when(~known, "inconclusive").when(real, "confirmed").otherwise("likely_false_positive"))
    return rows.select(
        "id", verdict.alias("judge_verdict"),
        F.when(known & F.col("_j.adjusted_severity").isin(SEVERITIES), F.col("_j.adjusted_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(known & ~real, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")).alias("confidence"),
    )


def contradictions(responses: DataFrame, artifacts: list[str], least: int = 30) -> DataFrame:
    """(id, a, b, severity, quote_a, quote_b, reason): substantial contradictions out of triangulation responses.

    Kept are those between known artifacts whose reason neither takes itself back nor hedges, has ``least`` characters, and
    either quotes both sides or is twice as long.
    """
    item = "struct<between:array<string>,severity:string,quote_a:string,quote_b:string,reason:string>"
    parsed = responses.select("id", F.explode(F.from_json(json_object(F.col("response")), f"struct<contradictions:array<{item}>>")["contradictions"]).alias("c"))
    reason = F.coalesce("c.reason", F.lit(""))
    known = lambda p: F.exists(F.array(*map(F.lit, artifacts)), lambda n: p.startswith(n) | n.startswith(p))
    a, b = F.lower(F.get("c.between", F.lit(0))), F.lower(F.get("c.between", F.lit(1)))
    hedged = F.exists(F.array(*map(F.lit, SELF_NEGATING + VAGUE)), lambda p: F.contains(F.lower(reason), p))
    quoted = (F.length("c.quote_a") > 5) & (F.length("c.quote_b") > 5)
    kept = parsed.filter(a.isNotNull() & b.isNotNull() & known(a) & known(b) & ~hedged & (F.length(reason) >= least) & (F.coalesce(quoted, F.lit(False)) | (F.length(reason) >= 2 * least)))
    return kept.select("id", a.alias("a"), b.alias("b"), "c.severity", "c.quote_a", "c.quote_b", reason.alias("reason"))


def synthesis_prompts(clustered: DataFrame, keys: list[str], members: int = 20) -> DataFrame:
    """(keys..., prompt, size) of clusters with at least three findings; a prompt lists the first ``members`` by id.

    The list is built from a bounded top of each cluster, so a huge cluster is never gathered.
    """
    sizes = clustered.groupBy(*keys).agg(F.count("*").alias("size")).filter("size >= 3")
    top = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    first = clustered.withColumn("_n", top).filter(F.col("_n") <= members)
    lists = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("- "), "title").alias("t")))), lambda s: s["t"]), "\n").alias("_l"))
    prompt = F.concat(F.lit("These findings sit together. Name their common cause as one JSON object holding root_cause, redundant (list of numbers) and confidence.\n\n"), F.col("_l"))
    return sizes.join(lists, keys).select(*keys, "size", prompt.alias("prompt"))


def synthesis(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., root_cause, confidence): parsed causes; without one a fixed text, without a confidence 0.7."""
    j = F.from_json(json_object(F.col("response")), "struct<root_cause:string,redundant:array<int>,confidence:double>")
    cause = F.nullif(F.trim(j["root_cause"]), F.lit(""))
    return responses.select(*keys, F.coalesce(cause, F.lit("No common cause was found.")).alias("root_cause"), F.coalesce(j["confidence"], F.lit(0.7)).alias("confidence"))
