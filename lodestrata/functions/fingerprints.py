"""Identity of findings: strict and fuzzy fingerprints and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Context patterns whose identity is the path they refer to.
REFERENCE_PATTERNS = ["stale-inline-path", "stale-reference"]


def _field(context: Column, name: str) -> Column:
    """A top-level string of a JSON object; null where absent, empty or not JSON."""
    return F.nullif(F.get_json_object(context, f"$.{name}"), F.lit(""))


def _squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def normalized_content(title: Column, context: Column, path: Column | None = None) -> Column:
    """The text that identifies a finding: by its rule (with ``path``, if given), else its vulnerability, else its title."""
    title = F.coalesce(title, F.lit(""))
    vuln, rule = _field(context, "vuln_id"), _field(context, "rule")
    by_rule = F.concat_ws(":", rule, *([] if path is None else [F.coalesce(path, F.lit(""))]), title)
    by_vuln = F.concat_ws(":", vuln, F.coalesce(_field(context, "package"), F.lit("")))
    return _squeezed(F.when(rule.isNotNull(), by_rule).when(vuln.isNotNull(), by_vuln).otherwise(title))


def effective_path(file_path: Column, context: Column) -> Column:
    """The path that counts: what a stale reference points to, else the finding's own file, else nothing."""
    own = F.coalesce(file_path, F.lit(""))
    target = F.coalesce(_field(context, "referenced_path"), _field(context, "target"), own)
    return F.when(_field(context, "pattern").isin(REFERENCE_PATTERNS), target).otherwise(own)


def strict_fingerprint(detector: Column, category: Column, file_path: Column, title: Column, context: Column) -> Column:
    """First 16 hex digits of SHA-256 over detector, category, path and normalised content; nulls count as empty."""
    parts = [detector, category, effective_path(file_path, context), normalized_content(title, context, file_path)]
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def fuzzy_fingerprint(detector: Column, category: Column, title: Column, context: Column) -> Column:
    """Like ``strict_fingerprint`` without the path, so that it survives a rename."""
    parts = [detector, category, normalized_content(title, context)]
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def fingerprint_key(fingerprint: Column) -> Column:
    """Spelling-independent form: trimmed, lower case, without a prefix naming the hash, 16 digits; null where blank."""
    bare = F.regexp_replace(F.lower(F.trim(fingerprint)), r"^[a-z][a-z0-9_-]*\s*[:=]\s*", "")
    return F.nullif(F.substring(bare, 1, 16), F.lit(""))
