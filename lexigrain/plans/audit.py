"""An audit as one plan: scan, toggle, override, policy, threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.operators import report, scan, transform
from lexigrain.plans.settings import Settings, overrides_table


@dataclass(frozen=True)
class Audit:
    findings: DataFrame
    summary: DataFrame
    errors: DataFrame | None


def audit(docs: DataFrame, key: str, settings: Settings = Settings(), workspace: str | None = None, errors: DataFrame | None = None) -> Audit:
    """Findings of (key, text) documents and their one-row summary; any error makes the status 2."""
    found = scan.find_all(docs, least=settings.zalgo_max_combining) if settings.zalgo else scan.find_characters(docs)
    found = scan.toggled(found, settings.bidi, settings.tags, settings.variation_selectors)
    if settings.overrides:
        found = scan.overridden(found, overrides_table(docs.sparkSession, settings))
    if workspace:
        w = settings.workspaces[workspace]
        limit = lambda k: F.lit(w.get(k)).cast("long")
        policy = docs.select(*docs.columns, F.explode(transform.constraint_violations(F.col("text"), F.lit(workspace), limit("max_chars"), limit("max_words"), limit("max_lines"))).alias("v"))
        policy = policy.select(*docs.columns, "v.name", "v.severity", "v.safety", "v.fix", "v.description", F.lit(2).alias("severity_rank"), F.lit("policy").alias("category"))
        found = found.unionByName(policy, allowMissingColumns=True)
    return Audit(found, report.summary(docs, found, key, settings.threshold, errors), errors)
