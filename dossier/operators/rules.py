"""Findings built from rules: wording from templates, guarded, with a policy for evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that no template may use, whatever it quotes.
NEVER = ("fraud", "fraudulent", "forged", "forgery", "fake")
POLICIES = ("required", "optional", "none")
_FIELD = re.compile(r"\{(\w+)(?::([^{}]+))?\}")


@dataclass(frozen=True)
class Rule:
    """A rule with its template.  ``{field}`` is a column's value, ``{field:word}`` a count with its noun: 1 page, 2 pages."""

    rule_id: str
    severity: str
    template: str
    evidence: str = "optional"

    def __post_init__(self):
        if self.evidence not in POLICIES:
            raise ValueError(f"{self.rule_id}: no such policy for evidence: {self.evidence}")
        wording = _FIELD.sub("", self.template).lower()
        if used := [word for word in NEVER if word in wording]:
            raise ValueError(f"{self.rule_id} must not say {', '.join(used)}")
        if set("{}") & set(_FIELD.sub("", self.template)):
            raise ValueError(f"{self.rule_id}: a brace that is no field")

    def fields(self) -> set[str]:
        return {name for name, _ in _FIELD.findall(self.template)}

    def wording(self) -> Column:
        """The template filled in by columns; nulls read as nothing, a null count as none of them."""
        parts, at = [], 0
        for match in _FIELD.finditer(self.template):
            name, noun = match.groups()
            parts.append(F.lit(self.template[at : match.start()]))
            if noun is None:
                parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
            else:
                n = F.coalesce(F.col(name).cast("long"), F.lit(0))
                parts.append(F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s")))
            at = match.end()
        return F.concat(*parts, F.lit(self.template[at:]))


def build(raised: DataFrame, rule: Rule, key: str) -> DataFrame:
    """key, rule, severity, subject, wording, evidence, fingerprint of what a rule raised, in one pass over the rows.

    raised: key, subject, evidence (an array, null is empty) and the template's fields.  A missing field is refused before
    anything runs; a row that breaks the rule's policy for evidence fails the job, because it is a fault of the check.
    """
    if lacking := rule.fields() - set(raised.columns):
        raise ValueError(f"{rule.rule_id} lacks {', '.join(sorted(lacking))}")
    n = F.coalesce(F.size("evidence"), F.lit(0))
    empty = F.col("evidence").isNull() | (n == 0)
    evidence = F.col("evidence")
    if rule.evidence == "required":
        evidence = F.when(empty, F.raise_error(F.concat(F.lit(f"{rule.rule_id} needs evidence: "), "subject")).cast(raised.schema["evidence"].dataType)).otherwise(evidence)
    elif rule.evidence == "none":
        evidence = F.when(~empty, F.raise_error(F.concat(F.lit(f"{rule.rule_id} carries evidence: "), "subject")).cast(raised.schema["evidence"].dataType)).otherwise(evidence)
    subject = F.coalesce("subject", F.lit(""))
    return raised.select(
        key, F.lit(rule.rule_id).alias("rule"), F.lit(rule.severity).alias("severity"), subject.alias("subject"), rule.wording().alias("wording"),
        evidence.alias("evidence"), F.sha2(F.concat(F.lit(f"{rule.rule_id}|"), subject), 256).alias("fingerprint"),
    )
