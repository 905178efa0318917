"""Claims: duplicates, conflicts, supersession. Everything is keyed by (type, subject), so it scales out on that key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions.text import dot
from quillgraph.plans.scratch import stored

# What makes a text a reversal, and which types have one answer.
REVERSAL = ("reversed", "reverted", "withdrawn", "superseded", "overturned", "changed", "amended", "updated decision", "no longer", "instead")
EXCLUSIVE = ("ASSIGNED", "DECIDED", "REVERSED")
#: What evidence takes from its claim's row, where the row has it.
SPAN = ("source_id", "message_id", "excerpt", "char_start", "char_end", "extraction_version")


def is_reversal(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(REVERSAL)), F.lit(False))


def merge(claims: DataFrame) -> DataFrame:
    """Equal (type, subject, object) become one claim with the first's (by ord) id, text, confidence and time, and the number of merged
    rows as support_count. The rows' evidence stays a table (see evidence()), so no claim gathers an unbounded list."""
    return _merged(claims, F.count("*"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """merge() of claims from the rows that merge() made of each part of them."""
    return _merged(parts, F.sum("support_count"))


def _merged(rows: DataFrame, support: Column) -> DataFrame:
    first = F.min(F.struct("ord", "text", "confidence", "valid_from")).alias("x")
    out = rows.groupBy("type", "subject_id", "object_id").agg(first, support.alias("support_count"))
    out = out.select("type", "subject_id", "object_id", "x.*", "support_count")
    return out.withColumn("id", ids.claim_id(F.col("type"), F.col("subject_id"), F.col("object_id"), F.col("text")))


def _identified(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """claims with claim_id, that of their merged claim, and the evidence's id."""
    rows = claims.join(merged.select("type", "subject_id", "object_id", F.col("id").alias("claim_id")), ["type", "subject_id", "object_id"])
    return rows.withColumn("id", ids.evidence_id(F.col("claim_id"), F.col("source_id"), F.col("char_start")))


def evidence_rows(claims: DataFrame, merged: DataFrame, *, parts: int) -> DataFrame:
    """What evidence() reads of claims, with `part`, 0 to parts - 1 by the evidence's id: the evidence of a part's rows is in no other part."""
    rows = _identified(claims, merged).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return rows.select("ord", "type", "subject_id", "object_id", *[c for c in SPAN if c in claims.columns], "valid_from", "part")


def evidence(claims: DataFrame, merged: DataFrame, *, part: tuple[int, int] | None = None) -> DataFrame:
    """Evidence rows of merged claims with their spans, insert-or-ignore by (claim, source, start): the first by ord stays. part: (i, n), only the i-th of n
    parts by id, chosen before rows are shuffled; the n parts are the whole."""
    rows = _identified(claims, merged).withColumnRenamed("valid_from", "ts")
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(part[1])) == part[0]) if part else rows
    cols = ["claim_id", *[c for c in SPAN if c in claims.columns], "ts"]
    return rows.groupBy("id").agg(F.min(F.struct("ord", *cols)).alias("x")).select("id", "x.*")


def conflicts(merged: DataFrame) -> DataFrame:
    """(id, claim_a_id, claim_b_id, reversal, b_from, b_ord, resolution): of exclusive types, each later claim with the subject of an
    earlier one stands against the first."""
    own = merged.where(F.col("type").isin(*EXCLUSIVE))
    first = own.groupBy("type", "subject_id").agg(F.min(F.struct("ord", "id")).alias("a"))
    pairs = own.join(first, ["type", "subject_id"]).where(F.col("ord") != F.col("a.ord"))
    reversal = is_reversal(F.col("text"))
    return pairs.select(ids.conflict_id(F.col("a.id"), F.col("id")).alias("id"), F.col("a.id").alias("claim_a_id"), F.col("id").alias("claim_b_id"), reversal.alias("reversal"), F.col("valid_from").alias("b_from"), F.col("ord").alias("b_ord"), F.when(reversal, "b_wins").alias("resolution"))


def supersede(merged: DataFrame, found: DataFrame, *, chain: bool = False) -> DataFrame:
    """merged with valid_to: of a first claim, the time of its last reversal. chain: instead every claim of an exclusive type ends
    where the subject's next one begins."""
    if chain:
        nxt = F.lead("valid_from").over(Window.partitionBy("type", "subject_id").orderBy("valid_from", "ord"))
        return merged.withColumn("valid_to", F.when(F.col("type").isin(*EXCLUSIVE), nxt))
    last = found.where("reversal and b_from is not null").groupBy(F.col("claim_a_id").alias("id")).agg(F.max_by("b_from", "b_ord").alias("valid_to"))
    return merged.join(last, "id", "left")


def deduplicate(claims: DataFrame, *, threshold: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(claims, conflicts) in one call. Where claims have a column `vector`, claims of alike texts are merged as well."""
    merged = merge(aligned(claims, threshold=threshold) if "vector" in claims.columns else claims)
    found = conflicts(merged)
    return supersede(merged, found), found


def aligned(claims: DataFrame, *, threshold: float = 0.92) -> DataFrame:
    """claims with object_id replaced by that of their group's first claim (see semantic_groups). A group is then what agrees in (type, subject,
    object), since no two groups of a subject begin with the same object; merge() and evidence() take it from there."""
    groups = semantic_groups(claims, threshold=threshold)
    lead = groups.join(claims.select(F.col("ord").alias("leader_ord"), F.col("object_id").alias("lead_object")), "leader_ord").select("ord", "lead_object")
    return claims.join(lead, "ord").withColumn("object_id", F.col("lead_object")).select(claims.columns)


def _decide(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        objects: list = []
        orders: list = []
        leads = np.zeros((0, 0))
        out = []
        for o, obj, text, vec in zip(rows["ord"], rows["object_id"], rows["text"], rows["vector"], strict=True):
            hit = np.array([x == obj for x in objects], bool)
            usable = vec is not None and bool(text)
            if usable and len(orders):
                hit |= leads @ np.asarray(vec, float) >= threshold
            at = int(np.argmax(hit)) if hit.any() else -1
            if at < 0:
                at = len(orders)
                orders.append(o)
                objects.append(obj)
                width = len(vec) if vec is not None else leads.shape[1]
                row = np.asarray(vec, float) if usable else np.full(width, np.nan)
                if leads.shape[1] != width:
                    leads = np.full((len(orders) - 1, width), np.nan)
                leads = np.vstack([leads, row[None]])
            out.append((o, orders[at]))
        return pd.DataFrame(out, columns=["ord", "leader_ord"])

    return run


def semantic_groups(claims: DataFrame, *, threshold: float = 0.92, head: int = 2048) -> DataFrame:
    """(ord, leader_ord): the sequential rule with vectors: a claim joins the first earlier group of its (type, subject) that has its object, or whose
    first claim has a cosine of at least `threshold`. claims has ord (unique), type, subject_id, object_id, text, vector (unit length or null).

    The first `head` undecided claims of each (type, subject) are decided in sequence by one task; the later ones are compared with the
    groups that begin there by a join, which adaptive execution can split; what finds none goes on. So a subject with a third of all claims takes more rounds,
    not a larger task, and the result is the sequential one.
    """
    key = ["type", "subject_id"]
    left = stored(claims.select("ord", *key, "object_id", "text", "vector"), "semantic")
    order = claims.schema["ord"].dataType.simpleString()
    done = None
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
        first = stored(left.withColumn("place", place).where(F.col("place") <= head).drop("place"), "semantic-head")
        found = stored(first.groupBy(*key).applyInPandas(_decide(threshold), f"ord {order}, leader_ord {order}"), "semantic-groups")
        rest = left.join(first.select("ord"), "ord", "left_anti")
        leads = first.join(found.where("ord = leader_ord").select("ord"), "ord", "left_semi").select(*key, F.col("ord").alias("leader_ord"), F.col("object_id").alias("lo"), F.when(F.col("text") != "", F.col("vector")).alias("lv"))
        alike = F.col("object_id").eqNullSafe(F.col("lo")) | ((F.col("text") != "") & (dot(F.col("vector"), F.col("lv")) >= threshold))
        joined = stored(rest.join(leads, key).where(alike).groupBy("ord").agg(F.min("leader_ord").alias("leader_ord")), "semantic-joined")
        done = found.unionByName(joined) if done is None else done.unionByName(found).unionByName(joined)
        left = stored(rest.join(joined.select("ord"), "ord", "left_anti"), "semantic")
    return done if done is not None else claims.select("ord", F.col("ord").alias("leader_ord"))


#: Vectors of a key in a tile; two tiles are one product of matrices.
TILE = 2048


def _tiles(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k, i, j = (rows[c].iloc[0] for c in ("k", "i", "j"))
        left = (rows["tile"] == i).to_numpy()
        right = (rows["tile"] == j).to_numpy()
        ids, v = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
        at_a, at_b, b = np.flatnonzero(left), np.flatnonzero(right), v[right].T
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(all="ignore"):
            slack = 1e-9 * (1 + np.sqrt((v * v).sum(axis=1).max()) ** 2)  # the product adds in another order
            for n in range(0, len(at_a), 256):
                some = at_a[n : n + 256]
                x, y = np.nonzero(~(v[some] @ b < threshold - slack))
                x, y = some[x], at_b[y]
                ordered = ids[x] < ids[y]
                swap = ids[y] < ids[x] if i != j else np.zeros(len(x), bool)  # a tile with itself has each pair both ways
                x, y = np.r_[x[ordered], y[swap]], np.r_[y[ordered], x[swap]]
                cosine = np.zeros(len(x))
                for d in range(v.shape[1]):
                    cosine += v[x, d] * v[y, d]
                close = ~(cosine < threshold)
                found.append((ids[x[close]], ids[y[close]], cosine[close]))
        a, b, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ((), (), ())
        return pd.DataFrame({"k": [k] * len(a), "a": a, "b": b, "cosine": cosine})

    return run


def semantic_pairs(vectors: DataFrame, *, key: str, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    """(k, a, b, cosine) within a key whose cosine reaches the threshold: candidates for a judge. A key's vectors are dealt to tiles and every two tiles of it are
    compared by products of matrices, so that a large key is many tasks; each pair that comes near is added up again in the vectors' order."""
    own = vectors.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(F.col("k").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("width", F.size("v"))
    tiles = own.groupBy("k", "width").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = own.join(tiles, ["k", "width"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    each = dealt.select("k", "width", "id", "v", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    each = each.select("k", "width", "id", "v", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    kind = own.schema
    out = f"k {kind['k'].dataType.simpleString()}, a {kind['id'].dataType.simpleString()}, b {kind['id'].dataType.simpleString()}, cosine double"
    return each.groupBy("k", "width", "i", "j").applyInPandas(_tiles(threshold), out)


def judged(pairs: DataFrame, judge: Column | None = None) -> DataFrame:
    """Candidate duplicates that a judge accepts; without one, all."""
    return pairs if judge is None else pairs.where(judge)


def quarantine(claims: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(accepted, to be reviewed) by confidence."""
    return claims.where(F.col("confidence") >= least), claims.where((F.col("confidence") < least) | F.col("confidence").isNull())


def conflict_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("claim_a_id").alias("src"), F.col("claim_b_id").alias("dst"), F.lit("CONFLICTS_WITH").alias("type"))
