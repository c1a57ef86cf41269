"""Broken prompt and response pairs: empty, truncated, refusal, copied prompt, other language.

Responses are sorted by text in ranges, and each is compared with its successor: where it is the beginning of a longer
one, it is a shortened version of it. Token counts at which a model's responses pile up are length limits. Both decide
where the text alone leaves open whether it breaks off; rules for content, copies, refusals and language give the rest.
Stored verdicts are not used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import materialize

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by had not but what all were when we there can an your which their said if will each about how up out them then she many some so these would other into has her two like him see time could no make than been its who now my made over did down only way find use may any also after before because yet no without such however therefore",
    "de": "der die das und ist in zu den nicht von sie des mit sich auf für als auch es an werden aus er hat dass daß wird bei eine einer einem einen eines um am sind noch wie nur oder aber vor zur bis mehr durch man sein wurde sei ihr ihre ihrer diese dieser dieses dem im ein kein keine nie nach weil mehr bereits daher ob beide zum wenn dann hier so sehr über unter",
    "fr": "le la les de des du un une et est en que qui dans pour sur pas plus par avec ce cette ces il elle au aux se ne sont ont été mais ou où son sa ses leur leurs nous vous ils être fait comme tout tous donc déjà très aussi bien sans entre ici si deux trois lui y même ne non après avant car quand",
    "es": "el la los las de del un una y es en que por para con no se su sus lo al como más pero este esta estos estas son ha han fue ya o sin sobre entre cuando muy también hasta hay donde desde todo todos nos si dos tres porque aquí le les ser está están ni solo sólo otro otra tiene eso ese esa",
    "pt": "o a os as de do da dos das um uma e é em que por para com não se seu sua seus suas no na nos nas ao aos à às como mais mas este esta isso isto são foi já ou sem sobre entre quando muito também até há onde desde todo todos só pelo pela pelos pelas ser está estão nem outro outra tem esse essa portanto pouco mesmo deixou",
    "it": "il lo la i gli le di del della dei delle dello un uno una e è in che per con non si suo sua su al alla ai alle come più ma questo questa questi queste sono ha hanno era già o senza tra fra quando molto anche fino dove tutto tutti nel nella nei nelle dal dalla sul sulla ci se due tre perché qui essere stato né solo altro altra",
    "nl": "de het een en is in van dat die te op met voor niet zijn aan er als ook maar om uit door naar bij dan nog wel geen wordt worden werd was hebben heeft deze dit over onder tussen omdat wanneer hier daar zo meer al of hun hij zij we wij je kan zou moet alleen niet meer reeds",
    "pl": "i w na z do nie że się jest to o jak za od po ale przez dla tym ten ta te tego tej który która które są był była było już lub albo oraz tak czy może tylko bez przy nad pod ich jego jej więc ponieważ gdy kiedy też także",
    "sv": "och i att det som en på är av för med den till inte om har de ett var från men vid så kan ska när också efter eller under redan utan bara denna detta dessa där här han hon deras sin sitt sina blir blev mycket än eftersom",
    "da": "og i at det som en på er af for med den til ikke om har de et var fra men han hun kan skal når også efter eller under kun uden denne dette disse hvor der blev bliver meget end fordi hvis hvad være",
    "fi": "ja on ei se että oli hän mutta ovat kun niin kuin myös tai joka jotka tämä sen sekä jos vain ole olla mukaan vielä ne siitä koska mitä sitä voi kanssa ennen jälkeen",
    "cs": "a v se na je že s z do o k i to jako za by pro ale jsou od po jeho už jen když tak který která které aby také nebo než bylo byl byla může být není podle při proto",
    "ro": "și în de la a cu nu o pe că un este din care să mai ce pentru dar sunt fost după sau fi acest această prin are au era între când numai doar fără deja",
    "hu": "a az és hogy nem is egy ez meg csak de már van volt ha mint vagy még mert el azt kell lesz ki be így sem ezt azonban lehet amely pedig nincs ezért",
    "tr": "ve bir bu da de için ile çok daha olarak olan gibi ne ama kadar en ya var değil sonra ancak veya göre ise her mi o bunu hem çünkü zaten sadece yok değildir bulgu",
    "id": "yang dan di dari untuk pada dengan ini itu tidak adalah dalam akan ke oleh juga sudah atau karena bisa telah ada saja dapat bahwa sebagai hanya harus tersebut belum",
}
# Letters of writing systems; one letter of those without blanks between words says as much as a word.
SCRIPTS = {
    "latin": r"[A-Za-zÀ-ɏḀ-ỿ]", "cyrillic": r"[Ѐ-ԯ]", "greek": r"[Ͱ-Ͽ]", "arabic": r"[؀-ۿ]", "hebrew": r"[֐-׿]", "devanagari": r"[ऀ-ॿ]",
    "thai": r"[฀-๿]", "hangul": r"[가-힯]", "kana": r"[぀-ヿ]", "han": r"[㐀-鿿]",
}
_SCRIPTS = {k: re.compile(v) for k, v in SCRIPTS.items()}
_LISTS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

# What stands for an answer without being one.
BLANKS = frozenset(["", "null", "none", "nil", "undefined", "n/a", "na", "nan", "-", "--", "---", ".", "..", "...", "…", "[]", "{}", '""', "''", "``", "json", "empty", "no response", "<empty>", "(empty)", "tbd", "todo"])

_ACT = r"(?:help|assist|answer|comment|judge?|review|evaluat\w*|assess|respond|comply|provide|give|rate|discuss|analy[sz]e|inspect|continue|fulfil\w*|process|do (?:this|that|so)|share|offer)"
_DECLINES = re.compile(
    rf"\b(?:i|we) (?:can ?not|can't|could not|couldn't|am not able to|are not able to|am unable to|are unable to|will not|won't(?: be able to)?|must not|may not|do not have the (?:ability|means|access|permission)s? to) (?:\w+ ){{0,3}}{_ACT}\b"
    rf"|\b(?:i|we)(?:'m| am|'re| are) (?:not able|unable|not allowed|not permitted|forbidden|prevented)\b|\b(?:i|we) (?:must|have to|need to|will|'ll) (?:respectfully |politely )?(?:decline|refuse|abstain)\b|\b(?:i|we) (?:decline|refuse)\b"
    r"|\bi(?:'m| am) (?:very |so |terribly )?sorry,? but\b|\bi apologi[sz]e,? but\b|^\W*(?:sorry|apologies)\b,? (?:but )?(?:i|we|this|that)\b"
    r"|\bas an? (?:\w+ )?(?:language model|ai|assistant|model)\b"
    r"|\bmy (?:guidelines|instructions|rules|policy|policies|programming|training)\b.{0,40}\b(?:allow|permit|prohibit|forbid|prevent|let|don't|do not)\w*"
    r"|\b(?:request|prompt|question) (?:was |is |has been )?(?:refused|denied|blocked|declined|rejected|flagged)\b(?! by\b)|\bcontent policy\b|\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules)\b"
    r"|\b(?:would|is) not (?:be )?(?:appropriate|possible|right|proper) for me\b|\bfalls? outside (?:of )?what i\b|\boutside (?:of )?my (?:scope|remit|abilities|capabilities)\b|\bnot (?:something|able) i (?:can|may)\b"
    r"|\bich (?:kann|darf|möchte|werde) (?:\w+ ){0,4}nicht (?:\w+ ){0,3}(?:helfen|beantworten|beurteilen|bewerten|prüfen|antworten|kommentieren|weiterhelfen)|\bich (?:muss|lehne)\b.{0,40}\bab(?:lehnen)?\b|\btut mir (?:sehr )?leid, (?:aber|doch|ich|das)|\bals (?:ki|sprachmodell)\b"
    r"|\bje (?:ne )?(?:peux|puis|suis)(?: pas)?\b.{0,30}\b(?:aider|répondre|évaluer|juger|commenter|capable|mesure|assister)|\bje (?:dois|suis obligé de) (?:décliner|refuser)|\bdésolée?,? (?:mais|je)\b|\ben tant que modèle\b"
    r"|\bno (?:puedo|podemos|me es posible|tengo la capacidad)\b.{0,30}\b(?:ayudar|responder|evaluar|juzgar|comentar|asistir|opinar|revisar)|\blo siento,? (?:pero|no)\b|\bcomo modelo de lenguaje\b|\bdebo (?:declinar|rechazar)"
    r"|\bnão (?:posso|podemos|consigo)\b.{0,30}\b(?:ajudar|responder|avaliar|julgar|comentar)|\b(?:desculpe|lamento),? (?:mas|não)\b|\bcomo modelo de linguagem\b|\bnon posso\b.{0,30}\b(?:aiutare|rispondere|valutare)|\bmi dispiace,? ma\b",
    re.I | re.M,
)
_SENTENCE_END = re.compile(r"[.!?…。][\"'”’»)\]*_]*$")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[\w-]*[ \t]*$", re.M)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _bare(text: str) -> str:
    """A text without code spans, paths, names with underscores and calls."""
    return re.sub(r"`[^`]*`|\S*[_/\\]\S*|\S+\(\)", " ", text)


def _scores(text: str) -> dict[str, int]:
    """Number of a text's words among the function words of each language."""
    words = re.findall(r"[^\W\d_]+", _bare(text).lower())
    return {k: sum(w in own for w in words) for k, own in _LISTS.items()}


def language_of(text: str, least: int = 2) -> str | None:
    """The language whose function words are most frequent among a text's words; None where too few or even."""
    scores = sorted(((n, k) for k, n in _scores(text).items()), reverse=True)
    return scores[0][1] if scores[0][0] >= least and scores[0][0] > scores[1][0] else None


def script_of(text: str, least: int = 12) -> str | None:
    """The writing system of most of a text's letters; None for fewer than ``least`` of them (a third of it for Han and kana)."""
    bare = _bare(text)
    counts = sorted(((len(p.findall(bare)), k) for k, p in _SCRIPTS.items()), reverse=True)
    n, script = counts[0]
    if script in ("han", "kana", "hangul"):
        n, script = n * 3, "cjk" if script != "hangul" else "hangul"
    return script if n >= least and n > 1.5 * counts[1][0] else None


def in_other_language(asked: str, told: str, least: int = 2) -> bool:
    """Whether ``told`` is written in another system than ``asked``, or another language has more of its function words.

    Nothing is said where ``asked`` shows no language, or ``told`` is too short to show one.
    """
    system = script_of(asked), script_of(told)
    if all(system) and system[0] != system[1]:
        return True
    own = language_of(asked)
    if own is None:
        return False
    scores = _scores(told)
    return max(n for k, n in scores.items() if k != own) >= least and max(n for k, n in scores.items() if k != own) > scores[own]


def _json_of(text: str) -> tuple[object, str | None]:
    """(parsed value or None, the JSON text of a response that is meant as JSON or None)."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    before = text[:start].strip() if start >= 0 else ""
    if start < 0 or (len(before.split()) > 12 and not before.endswith((":", "```json", "```"))):
        return None, None
    try:
        value, _ = json.JSONDecoder(strict=False).raw_decode(text[start:])
        return value, text[start:]
    except ValueError:
        return None, text[start:] if re.match(r"[\[{]\s*(?:\"|\{|$)", text[start:]) else None


def _leaves(value: object) -> list[str]:
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    return [value] if isinstance(value, str) else []


def _unescaped(text: str) -> str:
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"\\[nrt]", " ", text).replace('\\"', '"')


def prose_of(response: str) -> tuple[str, list[str]]:
    """(all prose of a response, its string values if it is JSON): no fences, JSON keys, code or single-word values."""
    value, raw = _json_of(response)
    if value is not None:
        leaves = _leaves(value)
        return " ".join(x for x in leaves if len(x.split()) > 1), leaves
    if raw is not None:
        found = re.findall(r"\"((?:[^\"\\]|\\.)*)(?:\"|$)", raw)
        leaves = [_unescaped(x) for x in found]
        return " ".join(x for x in leaves if len(x.split()) > 1), leaves
    text = re.sub(r"(?s)```.*?(?:```|$)", " ", response)
    return text, []


def is_empty(response: str | None) -> bool:
    """Nothing with content in it."""
    text = _FENCE.sub("", response or "").strip().strip("`").strip()
    if text.lower() in BLANKS or not re.search(r"\w", text):
        return True
    value, raw = _json_of(text)
    if raw is None or value is None:
        return False
    if isinstance(value, (dict, list)):
        return not _content(value)
    return False


def _content(value: object) -> bool:
    if isinstance(value, dict):
        return any(_content(v) for v in value.values())
    if isinstance(value, list):
        return any(map(_content, value))
    return value is not None and str(value).strip().lower() not in BLANKS


def is_copy(prompt: str, response: str, most: int = 12) -> bool:
    """Whether the response holds the prompt, or all after its first paragraph, and at most ``most`` words besides."""
    asked, got = _words(prompt), _words(_unescaped(response))
    if not asked or len(got) > len(asked) + most:
        return False
    rest = _words(re.split(r"\n\s*\n", prompt.strip(), maxsplit=1)[-1])
    for body in (asked, rest):
        if len(body) >= 5 and len(got) >= len(body) and len(got) - len(body) <= most:
            own = " ".join(got)
            if f" {' '.join(body)} " in f" {own} ":
                return True
    return False


def ending(response: str) -> tuple[str, str]:
    """('complete', 'broken' or 'open', the text without closing marks): how a non-empty response ends."""
    text = response.rstrip()
    value, raw = _json_of(text)
    core = re.sub(r"[\s\"'}\]`]+$", "", text)
    fences = len(_FENCE.findall(text))
    if re.search(r"\w(?:\.\.\.|…)[\s\"'}\]`]*$", text):
        return "broken", core  # an ellipsis in place of the rest
    if raw is not None:
        if value is None:
            return "broken", core
        prose = [x.strip() for x in _leaves(value) if len(x.split()) > 2]
        if prose and not _SENTENCE_END.search(prose[-1]):
            return "broken", core
        if fences % 2:
            return "broken", core
        tail = text[text.rfind("}" if isinstance(value, dict) else "]") + 1 :].strip().strip("`").strip()
        if tail and not _SENTENCE_END.search(tail):
            return "broken", core
        return "complete", core
    if fences % 2 or text.count("```") % 2:
        return "broken", core
    if _SENTENCE_END.search(text) or text.endswith("```"):
        return "complete", core
    last = text.rpartition("\n")[2]
    if re.match(r"\s*(?:[-*•]|\d+[.)])\s", last) or re.search(r"[`:;)\]}]$", text) or len(_words(text)) <= 3:
        return "open", core
    return "broken", core


def declines(prose: str) -> bool:
    """Whether one of the first two sentences declines to answer and no later one answers in more than two sentences."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", prose.strip()) if s]
    return any(_DECLINES.search(s.replace("’", "'")) for s in sentences[:2]) and len(sentences) <= 4


def judged(prompt: str, response: str | None) -> tuple[str | None, str | None, str]:
    """(defect by rules or None, ending, core text); 'truncated' is left to the ending."""
    if is_empty(response):
        return "empty", "complete", ""
    if is_copy(prompt or "", response):
        return "copied_prompt", "complete", ""
    prose, _ = prose_of(response)
    how, core = ending(response)
    if declines(prose):
        return "refusal", how, core
    asked = re.split(r"\n\s*\n", (prompt or "").strip(), maxsplit=1)[0]
    return ("other_language" if in_other_language(asked, prose) else None), how, core


def defects(log: DataFrame) -> DataFrame:
    """(id, defect) of every defective pair, one row an id. ``log``: id, model, tokens_generated, prompt, response.

    Rows delivered twice count once. A null prompt is empty: nothing copies it and no language contradicts it. Null ids
    are left out. A response that breaks off is truncated whatever its language.
    """

    def rules(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [judged(p, r) for p, r in zip(batch["prompt"].to_pylist(), batch["response"].to_pylist())]
            cols = [batch["id"], batch["model"], batch["tokens"], *(pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 3))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "model", "tokens", "rule", "how", "core"])

    rows = log.select(log["id"].cast("long").alias("id"), F.coalesce("model", F.lit("")).alias("model"), F.col("tokens_generated").cast("long").alias("tokens"), "prompt", "response")
    ruled = rows.filter("id is not null").mapInArrow(rules, "id long, model string, tokens long, rule string, how string, core string")
    first = F.min(F.struct("rule", "how", "core", "model", "tokens")).alias("r")  # deliveries that differ: the same one every time
    ruled = materialize(ruled.groupBy("id").agg(first).select("id", "r.model", "r.tokens", "r.rule", "r.how", "r.core"), "ruled")

    limits = _spikes(ruled)
    shortened = _shortened(ruled.filter("how <> 'complete'").select("core"), ruled.select("core"))
    rows = ruled.join(limits, ["model", "tokens"], "left").join(shortened, "core", "left")
    breaks = (F.col("how") == "broken") | ((F.col("how") == "open") & (F.coalesce("limit", F.lit(False)) | F.coalesce("short", F.lit(False))))
    first = F.col("rule").isin("empty", "copied_prompt", "refusal")
    defect = F.when(first, F.col("rule")).when(breaks, F.lit("truncated")).otherwise(F.col("rule"))
    return rows.select("id", defect.alias("defect")).filter("defect is not null")


def _spikes(ruled: DataFrame, factor: int = 8) -> DataFrame:
    """(model, tokens, limit): token counts that a model reaches ``factor`` times as often as its counts do on average,
    and that hardly any response exceeds."""
    counts = ruled.filter("tokens > 0").groupBy("model", "tokens").count()
    by_model = counts.groupBy("model").agg(F.avg("count").alias("mean"), F.sum("count").alias("all"))
    above = F.coalesce(F.sum("count").over(Window.partitionBy("model").orderBy("tokens").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    joined = counts.withColumn("above", above).join(by_model, "model")
    return joined.filter((F.col("count") >= factor * F.col("mean")) & (F.col("above") <= 0.02 * F.col("all"))).select("model", "tokens", F.lit(True).alias("limit"))


def _shortened(some: DataFrame, texts: DataFrame) -> DataFrame:
    """(core, short): texts of ``some`` that another text continues. Texts are range-partitioned and sorted; each is held
    against its successor, for the last of a range the first of the next one. ``some`` must be part of ``texts``."""
    distinct = texts.filter("core <> ''").distinct()
    ranged = materialize(distinct.repartitionByRange("core").withColumn("pid", F.spark_partition_id()), "sorted")
    heads = ranged.groupBy("pid").agg(F.min("core").alias("core")).withColumn("at", F.row_number().over(Window.orderBy("core")))
    order = heads.select("pid", "at")  # one row a range
    placed = ranged.join(F.broadcast(order), "pid").select("core", "at")
    carried = heads.filter("at > 1").select("core", (F.col("at") - 1).alias("at"))
    after = F.lead("core").over(Window.partitionBy("at").orderBy("core"))
    next_to = placed.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False))).withColumn("next", after)
    return next_to.filter("own").filter(F.startswith(F.col("next"), F.col("core"))).select("core", F.lit(True).alias("short")).join(some.distinct(), "core", "left_semi")
