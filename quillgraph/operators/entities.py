"""Entity resolution: persons by address, user name and name; projects and components by name; merges with a log that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.operators.components import connected_components
from quillgraph.plans.scratch import stored


def persons(rows: DataFrame, *, emails_col: str = "emails") -> DataFrame:
    """First sighting of each person id: (id, ord, name, emails); the id is that of the first address. Addresses that are null or blank don't count;
    rows without any are left out (see rejected())."""
    own = _addressed(rows, emails_col).where(F.size("emails") > 0).select("ord", "name", "emails").withColumn("id", ids.person_id(F.get("emails", F.lit(0))))
    return own.groupBy("id").agg(F.min(F.struct("ord", "name", "emails")).alias("x")).select("id", "x.ord", "x.name", "x.emails")


def _addressed(rows: DataFrame, emails_col: str) -> DataFrame:
    usable = F.filter(text.emails(F.col(emails_col)), lambda e: F.coalesce(e, F.lit("")) != "")
    return rows.withColumn("emails", F.coalesce(usable, F.array().cast("array<string>")))


def rejected(rows: DataFrame, *, emails_col: str = "emails") -> DataFrame:
    """The rows that persons() leaves out, with the reason."""
    return _addressed(rows, emails_col).where(F.size("emails") == 0).withColumn("reject_reasons", F.array(F.lit("no_address")))


def _at() -> Column:
    return F.struct("ord", "id").alias("at")


def _stars(groups: DataFrame, *keys: str) -> DataFrame:
    """(a, b, keys): the first person (at) of each group, and every other one. A group of n gives n - 1 rows."""
    first = groups.groupBy(*keys).agg(F.min("at").alias("first"))
    return groups.join(first, [*keys]).where("at <> first").select(F.col("first.id").alias("a"), F.col("at.id").alias("b"), *keys)


def username_stars(people: DataFrame) -> DataFrame:
    """(a, b, user): persons that share a user name, each tied to the first of them by (ord, id)."""
    return _stars(people.select(_at(), F.explode(F.array_distinct(F.transform("emails", text.username))).alias("user")), "user")


def similar_names(people: DataFrame, *, least: float = 0.4) -> DataFrame:
    """(a, b): links between persons that share a user name and whose names' tokens have a Jaccard similarity of at least `least`.

    Persons with the same user name and tokens are tied to the first of them. Different token sets of a user name are compared when they share one of
    the rarest tokens that the threshold allows none of to be missed (a prefix filter for each two sizes of sets, which fix how many tokens two sets must
    share), so a user name like `info`, or a word that is in all names, costs far less than all pairs.
    """
    own = people.select(_at(), F.explode(F.array_distinct(F.transform("emails", text.username))).alias("user"), F.sort_array(text.name_tokens(F.col("name"))).alias("tokens")).where(F.size("tokens") > 0)
    classes = stored(own.groupBy("user", "tokens").agg(F.min("at").alias("at"), F.count("*").alias("n")), "name-classes")
    same = own.join(classes.where("n > 1").select("user", "tokens", F.col("at").alias("first")), ["user", "tokens"]).where("at <> first").select(F.col("first.id").alias("a"), F.col("at.id").alias("b"))
    several = classes.groupBy("user").agg(F.count("*").alias("m"), F.collect_set(F.size("tokens")).alias("sizes")).where("m > 1").drop("m")
    each = classes.join(several.select("user"), "user", "left_semi").select("user", "at", "tokens", F.explode("tokens").alias("token"))
    rare = each.groupBy("user", "token").agg(F.count("*").alias("seen"))
    ranked = each.join(rare, ["user", "token"]).groupBy("user", "at", "tokens").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("by"))  # a name's tokens
    m, s = F.size("tokens"), F.col("size")
    sized = ranked.join(several, "user").select("user", "at", "tokens", "by", F.explode("sizes").alias("size")).where((s >= m * least - 1e-9) & (m >= s * least - 1e-9))
    keep = m - F.greatest(F.ceil((m + s) * F.lit(least / (1 + least)) - 1e-9).cast("int"), F.lit(1)) + 1
    probes = sized.select("user", "at", "tokens", F.least(m, s).alias("less"), F.greatest(m, s).alias("more"), F.explode(F.transform(F.slice("by", F.lit(1), F.least(keep, m)), lambda x: x["token"])).alias("token"))
    meet = ["user", "token", "less", "more"]
    a, b = (probes.select(*meet, F.col("at").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    near = a.join(b, meet).where((F.col("a") < F.col("b")) & (text.jaccard(F.col("ta"), F.col("tb")) >= least))
    return same.unionByName(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()


REASONS = ("manual_override", "email_exact_match", "username_name_cluster")


def edges(people: DataFrame, overrides: DataFrame | None = None, *, least: float = 0.4) -> DataFrame:
    """(a, b, reason, priority): links between persons, a before b by (ord, id). Reasons by priority: manual_override, email_exact_match,
    username_name_cluster (same user name, Jaccard of the names' tokens at least `least`); a pair has its best reason. Groups of persons that an address
    or a user name with equal names ties together are stars around the first of them, not all pairs."""
    by_mail = people.select(_at(), F.explode(F.array_distinct("emails")).alias("email"))
    out = _stars(by_mail, "email").select("a", "b", F.lit(1).alias("priority")).unionByName(similar_names(people, least=least).select("a", "b", F.lit(2).alias("priority")))
    if overrides is not None:  # (alias, target) addresses
        manual = overrides.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("target")).alias("target"))
        first = by_mail.groupBy("email").agg(F.min("at").alias("at"))  # the others with that address are tied to it
        pair = manual.join(first.select(F.col("email").alias("alias"), F.col("at").alias("x")), "alias").join(first.select(F.col("email").alias("target"), F.col("at").alias("y")), "target").where("x <> y")
        out = out.unionByName(pair.select(F.least("x", "y")["id"].alias("a"), F.greatest("x", "y")["id"].alias("b"), F.lit(0).alias("priority")))
    best = out.groupBy("a", "b").agg(F.min("priority").alias("priority"))
    return best.select("a", "b", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("priority") + 1).alias("reason"), "priority")


def canonical(people: DataFrame, links: DataFrame) -> DataFrame:
    """(id, ord, name, emails, canonical_id): the canonical person is the first one of the component by (ord, id)."""
    found = stored(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "person-components")
    first = found.join(people.select("id", _at()), "id").groupBy("component").agg(F.min("at").alias("first"))
    root = found.join(first, "component").select("id", F.col("first.id").alias("canonical_id"))
    return people.join(root, "id", "left").select("id", "ord", "name", "emails", F.coalesce("canonical_id", "id").alias("canonical_id"))


def merge_log(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each person merged into another: (id, source_id, target_id, entity_type, reason, merged_by), the reason the best of its
    links."""
    ends = links.select(F.col("a").alias("id"), "priority", "reason").unionByName(links.select(F.col("b").alias("id"), "priority", "reason"))
    best = ends.groupBy("id").agg(F.min(F.struct("priority", "reason")).alias("x")).select("id", F.col("x.reason").alias("reason"))
    merged = resolved.where("id <> canonical_id").join(best, "id")
    return merged.select(ids.merge_id(F.col("id"), F.col("canonical_id")).alias("id"), F.col("id").alias("source_id"), F.col("canonical_id").alias("target_id"), F.lit("Person").alias("entity_type"), "reason", F.lit("canonicalizer").alias("merged_by"))


def merged_emails(resolved: DataFrame) -> DataFrame:
    """(canonical_id, emails): all addresses of a component in order of sighting, each once."""
    each = resolved.select("canonical_id", "ord", "id", F.posexplode("emails").alias("i", "email"))
    first = each.groupBy("canonical_id", "email").agg(F.min(F.struct("ord", "id", "i")).alias("at"))
    return first.groupBy("canonical_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "email"))), lambda x: x["email"]).alias("emails"))


def undo(people: DataFrame, sources: DataFrame, overrides: DataFrame | None = None, *, least: float = 0.4) -> DataFrame:
    """canonical() after the merges of the persons in `sources` (id) are taken back: they stand alone, the others are linked without them."""
    return canonical(people, stored(edges(people.join(sources.select("id").distinct(), "id", "left_anti"), overrides, least=least), "links"))


def canonical_names(rows: DataFrame) -> DataFrame:
    """(type, norm, id): for projects and components the first id seen with a normalised name."""
    return rows.withColumn("norm", text.name_normalize(F.col("name"))).groupBy("type", "norm").agg(F.min(F.struct("ord", "id")).alias("x")).select("type", "norm", "x.id")


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (type, name) with the canonical id, null if unknown."""
    return names.withColumn("norm", text.name_normalize(F.col("name"))).join(known, ["type", "norm"], "left")


def directory(people: DataFrame, table: DataFrame) -> DataFrame:
    """Identity by an authoritative (email, employee) table where it has one of the person's addresses (the first that does)."""
    hit = people.select("id", F.posexplode("emails").alias("i", "email")).join(table, "email").groupBy("id").agg(F.min_by("employee", "i").alias("employee"))
    return people.join(hit, "id", "left")
