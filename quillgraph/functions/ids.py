"""Deterministic identities as Column expressions: the same record always gets the same key, so writes can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def digest(length: int, *parts: Column) -> Column:
    """The first hex digits of sha256 over the parts joined by '|'; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def person_id(first_email: Column) -> Column:
    return digest(16, F.lower(F.trim(first_email)))


def project_id(name: Column) -> Column:
    return digest(16, F.lower(name))


def component_id(name: Column, project: Column | None = None) -> Column:
    return digest(16, F.lower(name), project if project is not None else F.lit(""))


def decision_id(summary: Column) -> Column:
    return digest(16, F.substring(summary, 1, 80))


def issue_id(external: Column) -> Column:
    return digest(16, external)


def concept_id(label: Column) -> Column:
    return digest(16, F.lower(label))


def claim_id(kind: Column, subject: Column, object_: Column, text: Column) -> Column:
    return digest(16, kind, subject, object_, F.substring(text, 1, 60))


def evidence_id(claim: Column, source: Column, start: Column) -> Column:
    return F.concat(F.lit("ev_"), digest(12, claim, source, start))


def merge_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("merge_"), digest(12, source, target))


def conflict_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("conf_"), digest(12, a, b))


def run_id(model: Column, schema: Column, prompt_hash: Column) -> Column:
    return F.concat(F.lit("run_"), digest(12, model, schema, prompt_hash))


def source_id(normalised_body: Column) -> Column:
    return F.sha2(normalised_body, 256)
