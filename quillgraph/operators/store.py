"""The graph store: keyed upserts, soft deletes, reads. Tables are DataFrames; a write gives a new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids


def _both(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """All rows with `__new`: 0 for those that exist, 1 for those that come. Existing rows keep their ord and sort first."""
    new = incoming.withColumn("__new", F.lit(1))
    return new if existing is None else existing.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)


def _first(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key: existing before new, then by ord, then by value."""
    others = [c for c in rows.columns if c not in (key, "ord", "__new")]
    return rows.groupBy(key).agg(F.min(F.struct("__new", "ord", *others)).alias("k")).select(key, "k.ord", *[f"k.{c}" for c in others])


def _upsert(existing: DataFrame | None, incoming: DataFrame, key: str, kept: list[str], replaced: list[str]) -> DataFrame:
    """Per key: kept columns and ord from the first row, replaced ones from the last (existing rows come first, then by ord, then by value). Nulls of the
    deciding row survive, as whole structs are compared."""
    rows = _both(existing, incoming)
    out = rows.groupBy(key).agg(F.min(F.struct("__new", "ord", *kept)).alias("k"), F.max(F.struct("__new", "ord", *replaced)).alias("r"))
    return out.select(key, *[F.col(f"k.{c}").alias(c) for c in kept], *[F.col(f"r.{c}").alias(c) for c in replaced], F.col("k.ord").alias("ord"))


def upsert_messages(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """First write wins, by message_id."""
    return _first(_both(existing, incoming), "message_id")


def upsert_entities(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """A second write replaces canonical_id, metadata and confidence; name, type and deleted_at stay. canonical_id is the id by default."""
    fill = incoming.withColumn("canonical_id", F.coalesce("canonical_id", "id"))
    return _upsert(existing, fill, "id", ["type", "name", "deleted_at"], ["canonical_id", "metadata_json", "confidence"])


def upsert_claims(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """A second write replaces support_count, valid_to and confidence; text, type and valid_from stay."""
    return _upsert(existing, incoming, "id", ["type", "subject_id", "object_id", "text", "valid_from"], ["support_count", "valid_to", "confidence"])


def insert_evidence(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Insert or ignore by the evidence's id."""
    return _first(_both(existing, incoming.withColumn("id", ids.evidence_id(F.col("claim_id"), F.col("source_id"), F.col("char_start")))), "id")


def append_new(existing: DataFrame | None, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Append rows whose key is not there yet (merge log, conflicts, runs)."""
    new = incoming.dropDuplicates([key])
    return new if existing is None else existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def write_graph(existing: dict[str, DataFrame | None], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A graph's tables after another run's rows were written to them: what is known keeps its place, logs grow by rows with new ids."""
    upserts = {"messages": upsert_messages, "entities": upsert_entities, "claims": upsert_claims, "evidence": insert_evidence}
    return {name: upserts.get(name, append_new)(existing.get(name), rows) for name, rows in new.items()}


def run_row(runs: DataFrame) -> DataFrame:
    """Extraction runs with their ids: (model, schema_version, prompt_hash, message_count, error_count)."""
    return runs.withColumn("id", ids.run_id(F.col("model"), F.col("schema_version"), F.col("prompt_hash")))


def soft_delete(entities: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Mark the entities whose ids are in `gone`; those marked before keep their time."""
    marks = gone.select("id", F.lit(True).alias("__gone")).distinct()
    return entities.join(marks, "id", "left").withColumn("deleted_at", F.when(F.col("__gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("__gone")


def entity(entities: DataFrame, id_: str) -> DataFrame:
    return entities.where(F.col("id") == id_)


def entities_by_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where((F.col("type") == kind) & F.col("deleted_at").isNull())


def search_entities(entities: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Live entities whose name holds the query in either case; % and _ are wildcards. At most `limit`, by id."""
    return entities.where(F.col("name").ilike(f"%{query}%") & F.col("deleted_at").isNull()).orderBy("id").limit(limit)


def as_of(claims: DataFrame, at: Column) -> DataFrame:
    """Claims that held at a time."""
    return claims.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def claims_for_entity(claims: DataFrame, evidence: DataFrame, id_: str, current_only: bool = False) -> DataFrame:
    """Claims with the entity as subject or object, their excerpts joined by ' || ' in order of time and id."""
    own = claims.where((F.col("subject_id") == id_) | (F.col("object_id") == id_))
    own = own.where(F.col("valid_to").isNull()) if current_only else own
    ev = evidence.select(F.col("claim_id").alias("id"), "ts", F.col("id").alias("ev"), "excerpt")
    joined = own.join(ev, "id", "left").groupBy(*[c for c in own.columns]).agg(F.sort_array(F.collect_list(F.when(F.col("ev").isNotNull(), F.struct("ts", "ev", "excerpt")))).alias("x"))
    return joined.withColumn("excerpts", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda e: e["excerpt"]), " || "))).drop("x")


def evidence_for_claim(evidence: DataFrame, claim: str) -> DataFrame:
    return evidence.where(F.col("claim_id") == claim).orderBy("ts", "id")


def current_claims(claims: DataFrame, *, kind: str | None = None, least: float = 0.0, limit: int = 500) -> DataFrame:
    """The best supported claims that hold now, at most `limit`."""
    own = claims.where(F.col("valid_to").isNull() & (F.col("confidence") >= least))
    own = own.where(F.col("type") == kind) if kind else own
    return own.orderBy(F.desc("support_count"), F.desc("confidence"), "id").limit(limit)


def merge_log_for(log: DataFrame, id_: str) -> DataFrame:
    return log.where((F.col("source_id") == id_) | (F.col("target_id") == id_))


def open_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.where(F.col("resolution").isNull())


def stats(entities: DataFrame, claims: DataFrame, evidence: DataFrame, messages: DataFrame, merges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda df, name, when=None: df.agg((F.count("*") if when is None else F.count_if(F.expr(when))).alias(name))
    parts = [
        n(entities, "entities", "deleted_at is null"),
        claims.agg(F.count_if(F.col("valid_to").isNull()).alias("claims_current"), F.count_if(F.col("valid_to").isNotNull()).alias("claims_historical")),
        n(evidence, "evidence"),
        n(messages, "messages"),
        n(merges, "merges"),
        n(conflicts, "conflicts_open", "resolution is null"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def scoped(claims: DataFrame, evidence: DataFrame, scopes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence) that a user with these scopes sees: evidence by its scope, claims only with some evidence left."""
    seen = evidence.where(F.col("scope").isin(scopes))
    return claims.join(seen.select(F.col("claim_id").alias("id")).distinct(), "id", "left_semi"), seen


def redact(claims: DataFrame, evidence: DataFrame, deleted: DataFrame, at: Column, *, factor: float = 0.5) -> DataFrame:
    """Claims after sources (source_id) were deleted: those grounded only in them end at `at` and are flagged; those that lost part lose
    confidence."""
    gone = deleted.select("source_id", F.lit(True).alias("gone")).distinct()
    facts = evidence.join(gone, "source_id", "left").groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("gone")).alias("lost"))
    out = claims.join(facts, "id", "left").withColumn("redacted", F.coalesce((F.col("lost") == F.col("n")) & (F.col("lost") > 0), F.lit(False)))
    part = ~F.col("redacted") & (F.coalesce("lost", F.lit(0)) > 0)
    out = out.withColumn("valid_to", F.when(F.col("redacted") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to")))
    return out.withColumn("confidence", F.when(part, F.col("confidence") * factor).otherwise(F.col("confidence"))).drop("n", "lost")


def durability(claims: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """(id, durability, decayed): decisions, votes and assignments are durable; so is what three or more messages over a week or more support; a
    single mention of low confidence expires after 30 days; other claims are normal. Confidence halves every 180 days after the first 180 days without support."""
    facts = evidence.groupBy(F.col("claim_id").alias("id")).agg(F.count_distinct("message_id").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    days = lambda a, b: F.date_diff(a, b)
    out = claims.join(facts, "id", "left")
    n = F.coalesce("messages", F.lit(0))
    kind = F.when(F.col("type").isin("DECIDED", "REVERSED", "ASSIGNED", "SUPPORTS", "OPPOSES"), "durable").when((n >= 3) & (days(F.col("last"), F.col("first")) >= 7), "durable").when((n <= 1) & (F.col("confidence") < 0.5), "ttl_30_days").otherwise("normal")
    idle = days(now, F.coalesce("last", "valid_from"))
    decayed = F.when(idle > 180, F.col("confidence") * F.pow(F.lit(0.5), (idle - 180) / 180.0)).otherwise(F.col("confidence"))
    return out.select("id", kind.alias("durability"), F.round(decayed, 6).alias("decayed"))
