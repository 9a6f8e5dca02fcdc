"""Domains and the schema of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed domains of the data model.
CRITERIA = ("actuality", "links", "technology_freshness", "facts", "correctness", "readability", "checklist_alignment", "image_quality", "market_fit", "workload", "exam", "language", "rights")
SEVERITIES = ("info", "minor", "major", "critical")
VERDICTS = ("pass", "warning", "fail", "unknown", "not_applicable")
ISSUE_KINDS = ("defect", "improvement", "question")
ENTITY_TYPES = ("link", "image", "version", "date", "technology", "fact_candidate")

EVIDENCE = "array<struct<title:string,detail:string,url:string>>"
FINDING_COLUMNS = {
    "finding_key": "string",
    "legacy_finding_id": "string",
    "unit_id": "string",
    "branch": "string",
    "criterion": "string",
    "issue_kind": "string",
    "severity": "string",
    "verdict": "string",
    "confidence": "double",
    "quote": "string",
    "file_path": "string",
    "line_start": "int",
    "line_end": "int",
    "evidence": EVIDENCE,
    "source": "string",
    "checked_at": "timestamp",
    "support_status": "string",
    "latest_version": "string",
    "recommended_version": "string",
    "prompt_version": "string",
    "recommendation": "string",
    "needs_human_review": "boolean",
    "checker_name": "string",
    "issue_type": "string",
    "extra": "map<string,string>",
}


def severity_rank(severity: Column) -> Column:
    """info 0 to critical 3; null for anything else."""
    out = None
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out
