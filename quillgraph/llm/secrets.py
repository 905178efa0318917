"""Secret scans with multipart credential linking, in DataFrame operations only.

Base findings, leftmost and without overlap per kind, spans in code points with the end exclusive:
  assign  a password-like name, a separator, a value of 12 or more characters (the span is the whole match)
  access  an access key identifier of 18 or more characters
  hex     16 or more lower-case hexadecimal digits
A match that fails its length is dropped after matching, so it still takes up its text.

Besides these, weaker parts are looked for: identifiers (user and client names, short access keys), secrets (short assigned values,
40-character keys), endpoints (addresses, host settings). Weak parts are reported only when complementary parts co-occur within `scope`
characters: an identifier with a secret, a secret with an identifier or an endpoint, an endpoint with an identifier and with a
secret. Strong findings are identifiers (access) and secrets (assign, hex) of that join too. The join is an interval join: parts are
dealt to bins of `scope` characters, one side to the neighbouring bins as well, and joined on (text, bin).

How it runs: one scan marks and keeps texts that hold any candidate; only those, each distinct text once, are cut into matches. A match's
place is a running sum over the lengths of the pieces between matches, so a text with very many matches costs in proportion.
Results go back to the documents by the text's hash; documents without candidates have unmatched keys of their own, so no
key gathers them.

Null and empty texts find nothing. Equal texts share their findings; repeated rows give repeated rows. Findings of one start are ordered by kind. An empty
table gives an empty result; of the other columns none is read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


def _either(words: str) -> str:
    """The pattern with each letter in either case (an explicit class is the same in all regular expression dialects)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = rf"({_either('password|passwd|secret|token|api_?key')}){_VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
_IDENTIFIER = rf"({_either('user_?name|user_?id|login|client_?id|account_?id|access_?key_?id')}){_VALUE}([A-Za-z0-9._@+-]{{3,}})"
_KEY40 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
_ADDRESS = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
_HOST = rf"({_either('host|hostname|endpoint|server|database_?url|base_?url')}){_VALUE}([A-Za-z0-9._:/-]{{4,}})"
#: kind -> (pattern, part it can be, needs the value's group)
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "identifier": (_IDENTIFIER, 2), "key40": (_KEY40, 0), "address": (_ADDRESS, 0), "host": (_HOST, 2)}
KINDS = list(PATTERNS)
BASE = ("assign", "access", "hex")


def _matches(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end, value): all matches of all patterns in distinct texts (key, text)."""
    one = [
        F.struct(F.lit(i).alias("order"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"), F.split("text", p, -1).alias("gap"), (F.regexp_extract_all("text", F.lit(p), F.lit(g)) if g else F.array().cast("array<string>")).alias("v"))
        for i, (p, g) in enumerate(PATTERNS.values())
    ]
    kinds = texts.select("key", F.explode(F.array(*one)).alias("k")).where(F.size("k.m") > 0)
    each = kinds.select("key", F.col("k.order").alias("order"), F.posexplode(F.arrays_zip(F.col("k.m").alias("m"), F.slice(F.col("k.gap"), F.lit(1), F.size("k.m")).alias("gap"), F.col("k.v").alias("v"))).alias("i", "x"))
    each = each.select("key", "order", "i", F.char_length("x.m").alias("len"), F.char_length("x.gap").alias("gap"), F.coalesce(F.col("x.v"), F.col("x.m")).alias("value"))
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("key", "order").orderBy("i"))
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).drop("i", "gap")


def _part(kind: str) -> Column:
    return F.col("order") == KINDS.index(kind)


def parts(texts: DataFrame) -> DataFrame:
    """Matches as parts: (key, order, kind, part, strong, start, end); part is identifier, secret or endpoint."""
    n, value = F.col("len"), F.col("value")
    long_value = F.char_length(value) >= 12
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    kind = (
        F.when(_part("assign") & long_value, "assign")
        .when(_part("assign") & (F.char_length(value) >= 6), "weak_secret")
        .when(_part("access") & (n >= 18), "access")
        .when(_part("access") & (n >= 8), "weak_identifier")
        .when(_part("hex"), "hex")
        .when(_part("identifier"), "weak_identifier")
        .when(_part("key40") & mixed, "weak_secret")
        .when(_part("address") | _part("host"), "endpoint")
    )
    part = F.when(F.col("kind").isin("assign", "hex", "weak_secret"), "secret").when(F.col("kind") == "endpoint", "endpoint").otherwise("identifier")
    out = _matches(texts).withColumn("kind", kind).where("kind is not null")
    return out.select("key", "order", "kind", part.alias("part"), F.col("kind").isin(*BASE).alias("strong"), "start", "end")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak parts of `found` that complementary parts support within `scope` characters."""
    bin_of = lambda c: F.floor(F.col(c) / scope)
    weak = found.where("not strong").select("key", "kind", "part", "start", "end").distinct()
    near = weak.withColumn("bin", F.explode(F.sequence(bin_of("start") - 1, bin_of("end") + 1)))
    others = found.select("key", F.col("part").alias("other"), F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    others = others.withColumn("bin", F.explode(F.sequence(bin_of("s"), bin_of("e"))))
    gap = F.greatest(F.col("start") - F.col("e"), F.col("s") - F.col("end"))
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end"))
    pairs = near.join(others, ["key", "bin"]).where((F.col("part") != F.col("other")) & apart & (gap <= scope))
    support = pairs.groupBy("key", "kind", "part", "start", "end").agg(*[F.max(F.col("other") == p).alias(p) for p in ("identifier", "secret", "endpoint")])
    good = F.when(F.col("part") == "identifier", F.col("secret")).when(F.col("part") == "secret", F.col("identifier") | F.col("endpoint")).otherwise(F.col("identifier") & F.col("secret"))
    return support.where(good).select("key", "kind", "start", "end")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per document: (id, findings), findings an array of (start, end, kind) in order of start, then kind as listed above,
    weak kinds after the base kinds. null without findings."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    any_of = "|".join([ASSIGN, r"AKIA[A-Z0-9]{4}", HEX, _KEY40])
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text", F.when(F.col("text").rlike(any_of), F.col("text")))
    key = F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string")))
    rows = stored(rows.select("id", key.alias("key"), "text"), "secret-marks")  # the candidate pattern runs once over each text
    hits = rows.where("text is not null").select("key", "text")
    texts = stored(hits.groupBy("key").agg(F.first("text").alias("text")), "secret-texts")
    found = stored(parts(texts), "secret-parts")
    strong = found.where("strong").select("key", "kind", "start", "end")
    order = F.array_position(F.array(*[F.lit(k) for k in (*BASE, "weak_identifier", "weak_secret", "endpoint")]), F.col("kind")).cast("int")
    spans = strong.unionByName(linked(found, scope)).distinct().select("key", F.struct(F.col("start").cast("int").alias("start"), order.alias("order"), F.col("end").cast("int").alias("end"), "kind").alias("f"))
    by_text = spans.groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("findings"))  # the findings of one text
    out = rows.select("id", "key").join(by_text, "key", "left")
    return out.select(F.col("id").alias(id_col), F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"))).alias("findings"))


def listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def _equals(value: str):
    return lambda x: x == value


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of scan()'s result."""
    all_ = F.coalesce("findings", F.expr("cast(array() as array<struct<start: int, end: int, kind: string>>)"))
    base = F.filter(all_, lambda f: f["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.transform(all_, lambda f: f["kind"]), _equals(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(all_).alias("spans"))
