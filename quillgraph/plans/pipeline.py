"""From an archive to a graph, and the command line.

python -m quillgraph.plans.pipeline --db FOLDER [--corpus ARCHIVE | --sample] [--overrides FILE] [--model NAME [--plugin MODULE]] [--dry-run]
    [--export FOLDER] [--question TEXT ...]

A run into a folder that holds a graph adds to it. --model names a model whose backend a plugin module registers
(quillgraph.operators.extract.register_backend); without it, or with --dry-run, the rules extract.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.operators import claims as C
from quillgraph.operators import dedup, entities, extract, retrieve, store
from quillgraph.plans.scratch import release, scratch, stored
from quillgraph.sources import config


def prepare(raw: DataFrame) -> DataFrame:
    """Messages as extraction takes them, with duplicates marked: exact ones by the normalised body, then near ones by their
    SimHash; a copy of a near duplicate points to that one's leader."""
    m = raw.withColumn("normalised", text.strip_signature(F.col("body_raw"))).withColumn("body", text.strip_quotes(F.col("normalised")))
    m = m.withColumn("source_id", ids.source_id(F.col("normalised"))).withColumn("quoted_ids", text.quoted_ids(F.col("body_raw")))
    m = m.withColumn("thread_id", text.thread_root(F.col("references"), F.col("in_reply_to"), F.col("message_id")))
    m = stored(dedup.exact(store.upsert_messages(None, m), F.col("normalised")), "messages")
    first = m.where("duplicate_of is null")
    hashes = stored(dedup.simhash(first.select("message_id", F.col("body").alias("text")), id_col="message_id", text_col="text").join(first.select("message_id", "ord"), "message_id"), "hashes")
    near = dedup.leaders(hashes, stored(dedup.near_pairs(hashes, id_col="message_id"), "near-pairs"), id_col="message_id")
    out = m.join(hashes.select("message_id", "simhash"), "message_id", "left").join(near, "message_id", "left")
    lead = near.where("leader is not null").select(F.col("message_id").alias("duplicate_of"), F.col("leader").alias("lead2"))
    out = out.withColumn("direct_dup", F.coalesce("duplicate_of", "leader")).join(lead, "duplicate_of", "left")
    return out.withColumn("duplicate_of", F.coalesce("lead2", "duplicate_of", "leader")).drop("leader", "lead2")


#: What a candidate entity is, whichever way it was found.
_COLUMNS = ("id", "ord", "type", "name", "emails", "metadata_json", "confidence")


def by_rules(mails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity candidates, claims) of the rules."""
    at = lambda rule: F.struct("ord", F.lit(rule).alias("rule"), F.lit(0).alias("i")).alias("ord")
    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    p = extract.people(mails).select("id", at(0), "type", "name", F.array("email").alias("emails"), extract.person_metadata(F.array("email"), none).alias("metadata_json"), "confidence")
    d = extract.votes(mails).where("valid").select(F.col("decision_id").alias("id"), at(1), F.lit("Decision").alias("type"), F.col("summary").alias("name"), nobody.alias("emails"), extract.decision_metadata(F.col("vote_result"), F.array().cast("array<string>"), F.col("subject")).alias("metadata_json"), F.col("decision_confidence").alias("confidence"))
    i = extract.issues(mails).select("id", F.struct("ord", F.lit(2).alias("rule"), "i").alias("ord"), F.lit("Issue").alias("type"), F.col("external_id").alias("name"), nobody.alias("emails"), extract.issue_metadata(F.col("external_id"), F.col("tracker_url"), F.col("status")).alias("metadata_json"), "confidence")
    c = extract.mentions(mails).select(F.col("object_id").alias("id"), at(3), F.lit("Component").alias("type"), "name", nobody.alias("emails"), none.alias("metadata_json"), F.lit(0.9).alias("confidence"))
    return p.unionByName(d).unionByName(i).unionByName(c), extract.claims(mails)


def by_model(mails: DataFrame, outputs: DataFrame, version: Column) -> tuple[DataFrame, DataFrame]:
    """(entity candidates, claims) of a model's outputs; every claim carries its span and the version that found it."""
    out = outputs.withColumn("out", extract.parse_output(F.col("output")))
    typed = extract.typed_entities(out)
    at = mails.select("message_id", F.col("ord").alias("mail_ord"), "ts", "source_id")
    place = F.struct(F.col("mail_ord").alias("ord"), F.lit(0).alias("rule"), F.col("i").cast("int").alias("i")).alias("ord")
    rows = typed.join(at, "message_id").withColumn("ord", place).select(*_COLUMNS)
    found = extract.resolved_claims(out, typed).join(at, "message_id")
    return rows, found.select(place, "message_id", "type", "subject_id", "object_id", "text", "confidence", F.col("ts").alias("valid_from"), "char_start", "char_end", "excerpt", version.alias("extraction_version"), "source_id")


def canonical_ids(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """Candidates with their canonical ids: persons by resolution, projects and components by the first id seen with their name, others by none."""
    named = entities.canonical_names(rows.where(F.col("type").isin("Project", "Component"))).select(F.col("type").alias("nt"), "norm", F.col("id").alias("by_name"))
    same = persons.select(F.col("id").alias("pid"), "canonical_id")
    out = rows.join(same, (F.col("type") == "Person") & (F.col("id") == F.col("pid")), "left").join(named, (F.col("type") == F.col("nt")) & (text.name_normalize(F.col("name")) == F.col("norm")), "left")
    return out.select("id", "ord", "type", "name", F.coalesce("canonical_id", "by_name").alias("canonical_id"), "metadata_json", "confidence", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def build(spark: SparkSession, raw: DataFrame, overrides: DataFrame | None = None, backend: Callable[[str], str] | None = None, *, model: str = "rules", done: DataFrame | None = None, threshold: float = 0.92, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph's tables: messages, entities, claims, evidence, merge_log, conflicts, runs. With a backend, its extraction takes the place of the
    rules. Messages that `done` (source_id, extraction_version) says were extracted by this model's version are not extracted again. vectors (text, vector), of
    unit length, let claims of alike texts be merged."""
    messages = stored(prepare(raw), "prepared")
    mails = messages.where("duplicate_of is null")
    version = extract.extraction_version(model)
    mails = mails if done is None else extract.unseen(mails, done, version)
    if backend is None:
        rows, found = by_rules(mails)
        errors = F.lit(0).cast("long")
        counted = mails
    else:
        counted = stored(extract.ask(mails, backend), "outputs")
        rows, found = by_model(mails, counted, version)
        errors = F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long")
    rows = stored(rows, "candidates")
    people = stored(entities.persons(rows.where("type = 'Person'")), "people")
    links = stored(entities.edges(people, overrides), "links")
    resolved = stored(entities.canonical(people, links), "persons")
    found = stored(found, "raw-claims")
    if vectors is not None:
        found = stored(C.aligned(found.join(vectors.dropDuplicates(["text"]), "text", "left"), threshold=threshold).drop("vector"), "aligned-claims")
    merged, conflicts = C.deduplicate(found)
    merged = stored(merged, "claims")
    run = store.run_row(counted.agg(F.lit(model).alias("model"), F.lit(ids.SCHEMA_VERSION).alias("schema_version"), F.max(extract.prompt_hash(extract.PROMPT)).alias("prompt_hash"), F.count("*").alias("message_count"), errors.alias("error_count")))
    return {"messages": messages, "entities": stored(store.upsert_entities(None, canonical_ids(rows, resolved)), "entities"), "claims": merged, "evidence": stored(C.evidence(found, merged), "evidence"), "merge_log": stored(entities.merge_log(resolved, links), "merge-log"), "conflicts": stored(conflicts, "conflicts"), "runs": run}


def answer(graph: dict[str, DataFrame], questions: DataFrame, vectors: DataFrame | None = None, *, index: retrieve.Index | None = None, top_k: int = 10, min_confidence: float = 0.3, current_only: bool = True) -> DataFrame:
    """Context packs for a table of questions (question_id, question). An index that was built before saves building one."""
    index = index or retrieve.build_index(retrieve.documents(graph["claims"], graph["evidence"]))
    top = stored(retrieve.select_top(retrieve.hybrid(index, questions, vectors, least=min_confidence, current_only=current_only), index.docs, k=top_k), "top")
    return retrieve.context_packs(questions, top, graph["entities"], graph["conflicts"], graph["claims"], graph["messages"])


def main(argv: list[str] | None = None) -> None:
    from quillgraph.sources import mbox, sample

    p = argparse.ArgumentParser(description="Build the graph of a mail archive and answer questions.")
    p.add_argument("--corpus")
    p.add_argument("--db", required=True)
    p.add_argument("--sample", action="store_true", help="use the sample archive")
    p.add_argument("--overrides", help="JSON file with person_aliases")
    p.add_argument("--model", help="a model that a plugin's backend serves; without it the rules extract")
    p.add_argument("--plugin", action="append", default=[], help="module to import, which registers backends")
    p.add_argument("--dry-run", action="store_true", help="extract by rules even if a model is named")
    p.add_argument("--export", help="folder for graph.json and the context packs")
    p.add_argument("--question", action="append", default=[])
    args = p.parse_args(argv)
    for name in args.plugin:
        importlib.import_module(name)
    backend = extract.backend(args.model) if args.model and not args.dry_run else None
    spark = SparkSession.builder.getOrCreate()
    if args.sample:
        args.corpus = scratch(spark, "sample-archive")
        mbox.write_mbox(sample.messages(spark), args.corpus)
    if not args.corpus:
        p.error("name an archive by --corpus, or use --sample")
    db = config.Versions(spark, args.db)
    known = {name: db.read(name) for name in db.current()}
    new = build(spark, mbox.read_mbox(spark, args.corpus), config.overrides(spark, args.overrides), backend, model=args.model if backend else "rules", done=known.get("evidence"))
    db.commit(**store.write_graph(known, new))
    graph = {name: db.read(name) for name in db.current()}
    store.stats(*[graph[k] for k in ("entities", "claims", "evidence", "messages", "merge_log", "conflicts")]).show(truncate=False)
    if args.export:
        config.export_json(spark, f"{args.export.rstrip('/')}/graph.json", **{k: graph[k] for k in ("entities", "claims", "evidence", "merge_log", "conflicts")})
    if args.question:
        packs = stored(answer(graph, spark.createDataFrame(list(enumerate(args.question)), "question_id int, question string")), "packs")
        if args.export:
            config.export_packs(packs, args.export)
        for row in retrieve.render(packs).orderBy("question_id").toLocalIterator():
            print(row.text, end="\n\n")
    release(spark)


if __name__ == "__main__":
    main()
