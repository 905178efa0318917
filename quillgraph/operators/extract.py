"""Extraction: rules over mails, and model output (JSON) to typed rows.

Mails have message_id, ord, from_addr, from_name, subject, body (clean), ts. Rules give entities (type, id, name, ...) and claims; each row
carries a verbatim span of its message.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids, text

# The component names looked for, the bug tracker's address, types and defaults of model output.
COMPONENTS = ("mod_ssl", "worker MPM", "httpd-worker", "mod_rewrite")
TRACKER = "https://bz.apache.org/bugzilla/show_bug.cgi?id="
CLAIM_TYPES = ("AUTHORED", "DECIDED", "REVERSED", "ASSIGNED", "DEPENDS_ON", "MENTIONS", "SUPPORTS", "OPPOSES", "IMPLEMENTED_BY", "QUOTES")
ENTITY_TYPES = ("Person", "Project", "Component", "Decision", "Issue")
VOTES = ("passed", "failed", "withdrawn", "pending")


def sender() -> Column:
    return F.coalesce(F.nullif(F.col("from_name"), F.lit("")), F.col("from_addr"))


def _who() -> Column:
    return ids.person_id(F.col("from_addr"))


def people(mails: DataFrame) -> DataFrame:
    """The sender of each mail as a Person."""
    return mails.select("message_id", "ord", _who().alias("id"), F.lit("Person").alias("type"), sender().alias("name"), F.lower(F.trim("from_addr")).alias("email"), F.lit(1.0).alias("confidence"))


def votes(mails: DataFrame) -> DataFrame:
    """Mails with 'vote' in the subject: the decision, its result, and the sender's stance as a claim."""
    summary = text.strip(F.replace(F.replace("subject", F.lit("[VOTE]"), F.lit("")), F.lit("[vote]"), F.lit("")))
    plus, minus = F.col("body").contains("+1"), F.col("body").contains("-1")
    own = mails.where(F.upper("subject").contains("VOTE")).withColumn("summary", summary)
    stance = F.when(plus, "SUPPORTS").when(minus, "OPPOSES").otherwise("DECIDED")
    verb = F.when(plus, "supports").when(minus, "opposes").otherwise("proposed")
    passed = F.upper("body").contains("RESOLVED") | F.col("body").contains("+2")
    out = own.select(
        "message_id", "ord", "subject", ids.decision_id(F.col("summary")).alias("decision_id"), "summary", F.when(passed, "passed").otherwise("pending").alias("vote_result"), F.lit(0.9).alias("decision_confidence"),
        stance.alias("type"), _who().alias("subject_id"), F.concat(sender(), F.lit(" "), verb, F.lit(": "), F.col("summary")).alias("text"), F.lit(0.85).alias("confidence"), F.col("ts").alias("valid_from"), F.substring("body", 1, 200).alias("excerpt"), F.lit(0).alias("char_start"),
    )
    return out.withColumn("valid", F.char_length("excerpt") > 0)  # an empty body gives an empty span: to be rejected


def issues(mails: DataFrame) -> DataFrame:
    """Every bug reference in a body, repeats kept, with its offset: a running sum over the pieces between references."""
    own = mails.withColumn("m", F.regexp_extract_all("body", F.lit(r"(BZ-\d+)"), F.lit(1))).where(F.size("m") > 0).withColumn("gap", F.split("body", r"BZ-\d+", -1))
    each = own.select("message_id", "ord", "ts", _who().alias("sender_id"), sender().alias("sender"), F.contains(F.lower("body"), F.lit("assigned")).alias("assigned"), F.posexplode(F.arrays_zip("m", F.slice("gap", F.lit(1), F.size("m")).alias("gap"))).alias("i", "x"))
    ref = F.col("x.m")
    end = F.sum(F.char_length("x.gap") + F.char_length("x.m")).over(Window.partitionBy("ord", "message_id").orderBy("i")).cast("int")
    return each.withColumn("char_end", end).select("message_id", "ord", "ts", "sender_id", "sender", "assigned", "i", ref.alias("external_id"), ids.issue_id(ref).alias("id"), F.concat(F.lit(TRACKER), F.substr(ref, F.lit(4))).alias("tracker_url"), F.lit("open").alias("status"), F.lit(0.95).alias("confidence"), (F.col("char_end") - F.char_length(ref)).alias("char_start"), "char_end")


def assignments(found: DataFrame) -> DataFrame:
    """Claims of mails that say 'assigned', one for each reference."""
    return found.where("assigned").select("message_id", "ord", "i", F.lit("ASSIGNED").alias("type"), F.col("sender_id").alias("subject_id"), F.col("id").alias("object_id"), F.concat(F.lit("Bug "), "external_id", F.lit(" mentioned by "), "sender").alias("text"), F.lit(0.8).alias("confidence"), F.col("ts").alias("valid_from"), "char_start", F.col("external_id").alias("excerpt"))


def mentions(mails: DataFrame, names: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Components named in a body or subject, in either case; the offset is the body's, 0 if only the subject has it."""
    name = F.explode(F.array(*[F.lit(n) for n in names]))
    own = mails.select("message_id", "ord", "ts", "body", "subject", _who().alias("subject_id"), sender().alias("sender"), name.alias("name"))
    place = F.expr("instr(lower(body), lower(name))")
    own = own.withColumn("at", place).where((F.col("at") > 0) | F.contains(F.lower("subject"), F.lower("name")))
    return own.select("message_id", "ord", F.lit("MENTIONS").alias("type"), "subject_id", ids.component_id(F.col("name")).alias("object_id"), "name", F.concat("sender", F.lit(" mentions "), "name").alias("text"), F.lit(0.75).alias("confidence"), F.col("ts").alias("valid_from"), F.greatest(F.col("at") - 1, F.lit(0)).alias("char_start"), F.col("name").alias("excerpt"))


def claims(mails: DataFrame) -> DataFrame:
    """All rules' claims in one shape; their ord is (ord of the mail, rule, number within the rule)."""
    cols = ["type", "subject_id", "object_id", "text", "confidence", "valid_from", "char_start", "excerpt"]
    place = lambda rule, i: F.struct("ord", F.lit(rule).alias("rule"), i.cast("int").alias("i")).alias("ord")
    v = votes(mails).where("valid").withColumnRenamed("decision_id", "object_id").select(place(0, F.lit(0)), "message_id", *cols)
    a = assignments(issues(mails)).select(place(1, F.col("i")), "message_id", *cols)
    m = mentions(mails).select(place(2, F.array_position(F.array(*[F.lit(n) for n in COMPONENTS]), F.col("name"))), "message_id", *cols)
    out = v.unionByName(a).unionByName(m)
    out = out.withColumn("char_end", F.col("char_start") + F.char_length("excerpt")).withColumn("extraction_version", extraction_version("rules"))
    return out.join(mails.select("message_id", "source_id"), "message_id")


# ----- model output ---------------------------------------------------------------------------------------------

ENTITY_SCHEMA = "type string, name string, email_addresses array<string>, org string, vote_result string, participants array<string>, external_id string, tracker_url string, status string, label string, definition string, confidence double, excerpt string, char_start int, char_end int"
CLAIM_SCHEMA = "type string, subject_name string, object_name string, text string, confidence double, valid_from string, valid_to string, excerpt string, char_start int, char_end int"
def _array_of(fields: str) -> str:
    return "array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in fields.split(", "))) + ">>"


CLAIMS_TYPE = _array_of(CLAIM_SCHEMA)
OUTPUT_SCHEMA = f"entities {_array_of(ENTITY_SCHEMA)}, claims {CLAIMS_TYPE}"


def parse_output(raw: Column) -> Column:
    """Model output to a struct of entities and claims; null if it is no JSON object."""
    return F.from_json(text.fenced_json(raw), OUTPUT_SCHEMA, {"mode": "PERMISSIVE"})


def _span(item: str, length: Column) -> Column:
    """The item's verbatim span: missing offsets follow from the excerpt, all are clamped to the text; see text.clamp."""
    excerpt = F.substring(F.coalesce(F.col(f"{item}.excerpt"), F.lit("")), 1, 600)
    start = F.coalesce(F.col(f"{item}.char_start"), F.lit(0))
    end = F.coalesce(F.col(f"{item}.char_end"), start + F.char_length(excerpt))
    return text.clamp(start, end, excerpt, length)


def _reasons(**checks: Column) -> Column:
    """The names of the checks that fail (a null fails none)."""
    return F.filter(F.array(*[F.when(bad, name) for name, bad in checks.items()]), lambda x: x.isNotNull())


def _length(parsed: DataFrame) -> Column:
    return F.col("text_length") if "text_length" in parsed.columns else F.lit(None).cast("int")


def entity_candidates(parsed: DataFrame) -> DataFrame:
    """One row for each entity of the output, fit or not: (message_id, i, type, id, name, key, confidence, emails, metadata_json, excerpt, char_start,
    char_end, reject_reasons). Unknown types become concepts, missing fields take their defaults. Reasons: vote_result (a decision's is unknown), confidence
    (not within 0 and 1), empty_span, no_address (of a person). parsed has message_id, from_addr, out, and, where there, subject and text_length."""
    e = parsed.select("message_id", "from_addr", (F.col("subject") if "subject" in parsed.columns else F.lit(None).cast("string")).alias("subject"), _length(parsed).alias("length"), F.posexplode("out.entities").alias("i", "e"))
    kind = F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("Concept")
    given = F.filter(text.emails(F.col("e.email_addresses")), lambda x: F.coalesce(x, F.lit("")) != "")
    mails = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.array(F.lower(F.trim("from_addr"))))
    name = (
        F.when(kind == "Person", F.coalesce("e.name", F.lit("Unknown")))
        .when(kind == "Decision", F.coalesce("e.name", F.lit("Unnamed decision")))
        .when(kind == "Issue", F.coalesce("e.external_id", F.lit("BZ-unknown")))
        .when(kind == "Concept", F.coalesce("e.label", "e.name", F.lit("unknown")))
        .otherwise(F.coalesce("e.name", F.lit("unknown")))
    )
    first = F.get("emails", F.lit(0))
    own = F.when(kind == "Person", ids.person_id(first)).when(kind == "Decision", ids.decision_id(name)).when(kind == "Issue", ids.issue_id(name)).when(kind == "Component", ids.component_id(name)).when(kind == "Project", ids.project_id(name)).otherwise(ids.concept_id(name))
    vote = F.coalesce("e.vote_result", F.lit("pending"))
    confidence = F.coalesce("e.confidence", F.lit(0.8))
    reasons = _reasons(vote_result=(kind == "Decision") & ~vote.isin(*VOTES), confidence=~confidence.between(0.0, 1.0), empty_span=~F.col("span.valid"), no_address=(kind == "Person") & (F.coalesce(first, F.lit("")) == ""))
    meta = F.when(kind == "Person", person_metadata(F.col("emails"), F.col("e.org"))).when(kind == "Decision", decision_metadata(vote, F.coalesce("e.participants", F.array().cast("array<string>")), F.col("subject"))).when(kind == "Issue", issue_metadata(name, F.col("e.tracker_url"), F.col("e.status")))
    e = e.withColumn("emails", mails).withColumn("span", _span("e", F.col("length")))
    return e.select("message_id", "i", kind.alias("type"), own.alias("id"), name.alias("name"), F.lower(F.coalesce("e.name", "e.label", F.lit(""))).alias("key"), confidence.alias("confidence"), F.when(kind == "Person", F.col("emails")).alias("emails"), meta.alias("metadata_json"), "span.excerpt", "span.char_start", "span.char_end", reasons.alias("reject_reasons"))


def typed_entities(parsed: DataFrame) -> DataFrame:
    """The entities without a reason to reject them; the others are skipped, their message's other rows stay."""
    return entity_candidates(parsed).where(F.size("reject_reasons") == 0).drop("reject_reasons")


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def person_metadata(emails: Column, org: Column) -> Column:
    return _json(emails.alias("emails"), org.alias("org"), F.lit(None).cast("string").alias("display_name"))


def decision_metadata(vote: Column, participants: Column, subject: Column) -> Column:
    return _json(vote.alias("vote_result"), participants.alias("participants"), subject.alias("thread_subject"), F.lit(None).cast("string").alias("supersedes_id"))


def issue_metadata(external: Column, tracker: Column, status: Column) -> Column:
    return _json(external.alias("external_id"), tracker.alias("tracker_url"), status.alias("status"))


def claim_candidates(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each claim of the output, fit or not: (message_id, i, type, subject_id, object_id, text, confidence, excerpt, char_start, char_end,
    reject_reasons). Names become the ids of the message's entities, the last of a name; an unknown name gives 'unresolved:<name>', an unknown type
    MENTIONS. Reasons: confidence, empty_span."""
    known = entities.groupBy("message_id", "key").agg(F.max_by("id", "i").alias("id"))
    c = parsed.select("message_id", _length(parsed).alias("length"), F.posexplode("out.claims").alias("i", "c"))
    confidence = F.coalesce("c.confidence", F.lit(0.7))
    out = c.withColumn("span", _span("c", F.col("length")))
    reasons = _reasons(confidence=~confidence.between(0.0, 1.0), empty_span=~F.col("span.valid"))
    out = out.select("message_id", "i", F.when(F.col("c.type").isin(*CLAIM_TYPES), F.col("c.type")).otherwise("MENTIONS").alias("type"), F.lower(F.coalesce("c.subject_name", F.lit(""))).alias("s"), F.lower(F.coalesce("c.object_name", F.lit(""))).alias("o"), F.coalesce("c.text", F.lit("")).alias("text"), confidence.alias("confidence"), "span.excerpt", "span.char_start", "span.char_end", reasons.alias("reject_reasons"))
    for side, name in (("s", "subject_id"), ("o", "object_id")):
        look = known.select("message_id", F.col("key").alias(side), F.col("id").alias("found"))
        out = out.join(look, ["message_id", side], "left").withColumn(name, F.coalesce("found", F.concat(F.lit("unresolved:"), side))).drop("found")
    return out.select("message_id", "i", "type", "subject_id", "object_id", "text", "confidence", "excerpt", "char_start", "char_end", "reject_reasons")


def resolved_claims(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """The claims without a reason to reject them."""
    return claim_candidates(parsed, entities).where(F.size("reject_reasons") == 0).drop("reject_reasons")


def flags(outputs: DataFrame) -> DataFrame:
    """outputs of ask() with `is_clean` (no attempt failed) and `grounding_complete` (every claim that is taken has a span)."""
    parsed = F.col("out") if "out" in outputs.columns else parse_output(F.col("output"))
    empty = lambda c: F.coalesce(c["excerpt"], F.lit("")) == ""
    return outputs.withColumn("is_clean", F.size("errors") == 0).withColumn("grounding_complete", ~F.exists(F.coalesce(parsed["claims"], F.array().cast(CLAIMS_TYPE)), empty))


Backend = Callable[[str], str]
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
_BACKENDS: dict[str, Callable[[str], Backend]] = {}


def register_backend(prefix: str, make: Callable[[str], Backend]) -> None:
    """Models whose name starts with the prefix are served by make(model): a function from prompt to output. None is bundled."""
    _BACKENDS[prefix] = make


def backend(model: str) -> Backend:
    for prefix in sorted(_BACKENDS, key=len, reverse=True):
        if model.startswith(prefix):
            return _BACKENDS[prefix](model)
    raise LookupError(f"no backend is registered for {model!r}")


PROMPT = (
    "Extract entities and claims from the message. Return only a JSON object with arrays 'entities' and 'claims'; each item has a type, names, a confidence from 0 to 1, "
    "a verbatim excerpt and its offsets char_start and char_end in the text below."
)


def prompt_hash(system: str, prefix: str = "v1") -> Column:
    return F.substring(F.md5(F.lit(system + prefix[:200])), 1, 8)


def extraction_version(model: str) -> Column:
    """model:schema:prompt hash, which tells extractions of one message apart."""
    return F.concat_ws(":", F.lit(model), F.lit(ids.SCHEMA_VERSION), prompt_hash(PROMPT))


def problems(found: dict, length: int) -> list[str]:
    """What is wrong with a parsed output: items that are no objects, spans and numbers that can't be used. An entity's own faults (an unknown vote
    result, a confidence out of range) only cost that entity, so they are none here."""
    out = []
    for kind in ("entities", "claims"):
        items = found.get(kind) or []
        if not isinstance(items, list):
            out.append(f"{kind} is no array")
            continue
        for i, item in enumerate(items):
            where = f"{kind}[{i}]"
            if not isinstance(item, dict):
                out.append(f"{where} is no object")
                continue
            try:
                excerpt = (item.get("excerpt") or "")[:600]
                start = max(int(item.get("char_start") or 0), 0)
                end = min(int(item["char_end"]) if item.get("char_end") is not None else start + len(excerpt), length)
                confidence = float(item["confidence"]) if item.get("confidence") is not None else 0.7
            except (TypeError, ValueError) as e:
                out.append(f"{where}: {e}")
                continue
            if end <= start and min(start + len(excerpt), length) <= start:
                out.append(f"{where} has an empty span")
            if kind == "claims" and not 0 <= confidence <= 1:
                out.append(f"{where} has a confidence outside 0 and 1")
    return out


def ask(mails: DataFrame, call: Backend, *, attempts: int = 3) -> DataFrame:
    """(message_id, from_addr, subject, text_length, output, errors, retries): the model's output for each mail. Output that is no JSON object, or whose spans
    or numbers can't be used, is sent back with its error and its first 800 characters, up to `attempts` times; any other error ends the attempts. Exhausted:
    null output, with all errors."""

    def one(body: str) -> tuple[str | None, list[str], int]:
        errors: list[str] = []
        prompt = first = f"{PROMPT}\n\n{body}"
        for k in range(attempts):
            try:
                raw = call(prompt)
            except Exception as e:  # the backend's own failure
                return None, [*errors, f"Unexpected error: {e}"], k
            m = _FENCE.search(raw)
            inner = (m[1] if m else raw).strip()
            try:
                found = json.loads(inner)
                wrong = problems(found, len(body)) if isinstance(found, dict) else ["no object"]
                if not wrong:
                    return inner, errors, k
                errors.append(f"ValidationError: {len(wrong)} errors: {'; '.join(wrong)[:300]}")
            except ValueError as e:
                errors.append(f"JSONDecodeError: {e}")
            prompt = f"{first}\n\nThe last output was not valid:\n{errors[-1]}\n\nIt began:\n{raw[:800]}\n\nReturn corrected JSON only."
        return None, errors, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [one(t) for t in rows["text"]]
            yield pd.DataFrame({"message_id": rows["message_id"], "from_addr": rows["from_addr"], "subject": rows["subject"], "text_length": [len(t) for t in rows["text"]], "output": [x[0] for x in out], "errors": [x[1] for x in out], "retries": [x[2] for x in out]})

    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = mails.select("message_id", "from_addr", "subject", text.combined(blank("subject"), blank("body")).alias("text"))
    return rows.mapInPandas(run, "message_id string, from_addr string, subject string, text_length int, output string, errors array<string>, retries int")


def unseen(mails: DataFrame, done: DataFrame, version: str | Column) -> DataFrame:
    """Mails whose (source_id, version) was not extracted yet; done has source_id and extraction_version."""
    own = done.where(F.col("extraction_version") == (F.lit(version) if isinstance(version, str) else version)).select("source_id").distinct()
    return mails.join(own, "source_id", "left_anti")
