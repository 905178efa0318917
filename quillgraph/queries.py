"""The engine's queries over the driver's tables and, beside each, SQL for another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.operators import claims as C
from quillgraph.operators import dedup, entities, extract, retrieve, store
from quillgraph.plans.scratch import appended, drop, scratch, sent, stored
from quillgraph.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AT = "timestamp '1998-06-01 00:00:00'"
QUESTIONS = [(1, "decision changed customer 12 takes part 3"), (2, "urgent part 5 of customer 77 urgent"), (3, "noted high priority order line")]

# ----- SQL that several queries share -----------------------------------------------------------------------------

_MAIL = f"""mail_v as ({views.plain(views.MAIL)}),
msg as (select *, regexp_replace(regexp_replace(body_raw, '(?s)\\n-- ?\\n.*$', ''), '^\\s+|\\s+$', '', 'g') normalised from mail_v),
mail as (select *, regexp_replace(array_to_string([l for l in string_split(normalised, chr(10)) if not starts_with(l, '>')], chr(10)), '^\\s+|\\s+$', '', 'g') body,
  sha256(normalised) source_id, coalesce(nullif(from_name, ''), from_addr) sender, substr(sha256(lower(trim(from_addr))), 1, 16) pid from msg)"""
_CLAIMS = f"""claims_v as ({views.plain(views.CLAIMS)}),
merged0 as (select type, subject_id, object_id, min(ord) ord, arg_min(text, ord) text, arg_min(confidence, ord) confidence, arg_min(valid_from, ord) valid_from, count(*) support_count from claims_v group by 1, 2, 3),
merged as (select *, substr(sha256(concat_ws('|', type, subject_id, object_id, substr(text, 1, 60))), 1, 16) id from merged0),
own as (select *, first_value(id) over w a, first_value(ord) over w aord from merged where type in ('ASSIGNED', 'DECIDED', 'REVERSED') window w as (partition by type, subject_id order by ord)),
conf as (select concat('conf_', substr(sha256(concat_ws('|', a, id)), 1, 12)) id, a claim_a_id, id claim_b_id, regexp_matches(lower(text), 'reversed|reverted|withdrawn|superseded|overturned|changed|amended|updated decision|no longer|instead') reversal, valid_from b_from, ord b_ord from own where ord <> aord),
conflicts as (select *, case when reversal then 'b_wins' end resolution from conf),
last as (select claim_a_id id, arg_max(b_from, b_ord) valid_to from conf where reversal and b_from is not null group by 1),
claims as (select m.*, valid_to from merged m left join last using (id)),
ev0 as (select c.*, m.id claim_id, concat('ev_', substr(sha256(concat_ws('|', m.id, c.source_id, c.char_start)), 1, 12)) id from claims_v c join merged m using (type, subject_id, object_id)),
evidence as (select id, arg_min(claim_id, ord) claim_id, arg_min(source_id, ord) source_id, arg_min(message_id, ord) message_id, arg_min(excerpt, ord) excerpt, arg_min(char_start, ord) char_start, arg_min(valid_from, ord) ts, min(ord) ord from ev0 group by id)"""


def _persons_sql(linked: str = "true") -> str:
    """Persons and their components; only those that `linked` holds for are linked."""
    return f"""persons_v as ({views.plain(views.PERSONS)}),
p0 as (select substr(sha256(lower(trim(email))), 1, 16) id, ord, name, lower(trim(email)) email from persons_v),
people as (select id, min(ord) ord, arg_min(name, ord) name, arg_min(email, ord) email from p0 group by id),
u as (select *, replace(replace(replace(split_part(email, '@', 1), '.', ''), '_', ''), '-', '') usr, list_sort(list_distinct([t for t in string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if t <> ''])) toks from people),
cls as (select usr, toks, arg_min(id, ord) a, min(ord) oa from u where len(toks) > 0 and {linked} group by 1, 2),
edges as (select a, id b, 'username_name_cluster' reason from u join cls using (usr, toks) where id <> a and {linked}
  union select x.a, y.a, 'username_name_cluster' from cls x join cls y on x.usr = y.usr and x.oa < y.oa where len(list_intersect(x.toks, y.toks)) >= 0.4 * len(list_distinct(list_concat(x.toks, y.toks)))),
ends as (select p.ord oa, q.ord ob from edges join people p on p.id = a join people q on q.id = b),
sym as (select oa s, ob t from ends union all select ob, oa from ends),
reach(n, r) as (select ord, ord from people union select reach.n, sym.t from reach join sym on sym.s = reach.r),
roots as (select n ord, min(r) root from reach group by n),
resolved as (select p.id, p.ord, p.name, p.email, q.id canonical_id from people p join roots using (ord) join people q on q.ord = roots.root)"""


_PERSONS = _persons_sql()
_SIMHASH = (
    """w as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+') if x <> ''] w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] end) g from w),
h as (select doc_id, ('0x' || substr(md5(g), 17, 16))::ubigint h from g),
b as (select doc_id, """
    + " + ".join(f"(case when sum((h >> {i}) & 1) * 2 > count(*) then {1 << i}::hugeint else 0::hugeint end)" for i in range(64))
    + """ s from h group by doc_id),
sim as (select d.doc_id, (case when s >= 9223372036854775808::hugeint then s - 18446744073709551616::hugeint else s end)::bigint simhash from documents d left join b using (doc_id))"""
)
_QUESTIONS = "questions(question_id, question) as (values " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"
_BM25 = f"""{_QUESTIONS},
docs as (select c.id, c.type, subject_id, object_id, text, confidence, support_count, valid_to, e.id evidence_id, source_id, message_id, excerpt, e.ts, concat_ws('/', c.id, e.id) doc_id from claims c join evidence e on e.claim_id = c.id where text <> ''),
posts as (select doc_id, token, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', text, coalesce(excerpt, ''))), '[a-z0-9]+')) token from docs) group by 1, 2),
sizes as (select doc_id, sum(tf) dl from posts group by 1),
stats as (select (select sum(dl) from sizes) / n avgdl, n from (select count(*) n from docs)),
raw as (select token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from posts, stats group by token, n),
idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw),
qt as (select question_id, token, count(*) qtf from (select question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) token from questions) group by 1, 2),
bm as (select question_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) bm25 from posts join qt using (token) join idf using (token) join sizes using (doc_id), stats group by 1, 2),
norm as (select question_id, doc_id, bm25, bm25 / case when max(bm25) over (partition by question_id) > 0 then max(bm25) over (partition by question_id) else 1 end bm25_norm from bm),
scored as (select q.question_id, docs.*, bm25_norm, 0.5 * coalesce(bm25_norm, 0) + 0.1 * support_count / (select max(support_count) from docs) + 0.1 * (valid_to is null)::int score
  from docs cross join questions q left join norm on norm.question_id = q.question_id and norm.doc_id = docs.doc_id),
kept as (select * from scored where confidence >= 0.3 and valid_to is null),
capped as (select *, row_number() over (partition by question_id, source_id order by round(score, 9) desc, support_count desc, confidence desc, id, evidence_id) rs from kept),
top as (select *, row_number() over (partition by question_id order by round(score, 9) desc, support_count desc, confidence desc, id, evidence_id) rank from capped where rs <= 3 qualify rank <= 10)"""
_ENTITIES = """ents as (select concat('part:', cast(p_partkey % 7 as varchar)) id, p_partkey ord, 'Component' type, p_name name, p_brand canonical_id, p_type metadata_json, round(p_size / 50.0, 2) confidence from part),
entities as (select id, arg_min(type, ord) type, arg_min(name, ord) as name, arg_max(canonical_id, ord) canonical_id, arg_max(metadata_json, ord) metadata_json, arg_max(confidence, ord) confidence, min(ord) ord from ents group by id)"""


# ----- inputs in the engine's shapes --------------------------------------------------------------------------------


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.mail(spark, sf_dir).withColumn("normalised", text.strip_signature(F.col("body_raw")))
    return raw.withColumn("body", text.strip_quotes(F.col("normalised"))).withColumn("source_id", ids.source_id(F.col("normalised")))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.persons(views.persons(spark, sf_dir).withColumn("emails", F.array("email")))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, conflicts, evidence)."""
    raw = views.claims(spark, sf_dir)
    claims, found = C.deduplicate(raw)
    return claims, found, C.evidence(raw, claims)


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    own = part.select(F.concat(F.lit("part:"), (F.col("p_partkey") % 7).cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.lit("Component").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("canonical_id"), F.col("p_type").alias("metadata_json"), F.round(F.col("p_size") / 50.0, 2).alias("confidence"))
    return own.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


def add(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ----- text -----------------------------------------------------------------------------------------------------------


@add(f"with {_MAIL} select message_id, normalised, body, source_id from mail")
def text_normalize(spark, sf_dir):
    return mails(spark, sf_dir).select("message_id", "normalised", "body", "source_id")


@add(f"with {_MAIL} select message_id, array_to_string([concat('<', x, '>') for x in list_distinct([y for y in regexp_extract_all(body_raw, '<([^>]+@[^>]+)>', 1) if contains(y, '.')])], ',') quoted from mail")
def quoted_ids(spark, sf_dir):
    return mails(spark, sf_dir).select("message_id", F.array_join(text.quoted_ids(F.col("body_raw")), ",").alias("quoted"))


@add(f"with {_MAIL} select message_id, case when ord % 4 = 0 then concat('<r', ord % 9, '@mail.example>') else coalesce(in_reply_to, message_id) end root from mail")
def thread_root(spark, sf_dir):
    header = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("  <r"), F.col("ord") % 9, F.lit("@mail.example>\t<other@mail.example>"))).otherwise("")
    m = mails(spark, sf_dir).withColumn("references", F.filter(F.split(header, r"\s+"), lambda x: x != ""))
    return m.select("message_id", text.thread_root(F.col("references"), F.col("in_reply_to"), F.col("message_id")).alias("root"))


@add(f"with {_MAIL} select message_id, coalesce(in_reply_to, '') in_reply_to, from_addr, from_name, subject, body_raw, ts from mail")
def mbox_roundtrip(spark, sf_dir):
    from quillgraph.plans.scratch import scratch
    from quillgraph.sources import mbox

    path = scratch(spark, "archive")
    mbox.write_mbox(views.mail(spark, sf_dir), path)
    back = mbox.read_mbox(spark, path)
    return back.select("message_id", "in_reply_to", "from_addr", "from_name", "subject", "body_raw", "ts")


@add("select concat(conv_id, '.', turn) message_id, concat(conv_id, '.', min(turn) over (partition by conv_id)) root from conversations")
def thread_root_transitive(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws(".", "conv_id", "turn").alias("message_id"), F.concat_ws(".", "conv_id", F.col("turn") - 1).alias("in_reply_to"))
    return dedup.thread_roots(rows)


@add(f"""with {_MAIL}, c as (select message_id, concat('Subject: ', subject, chr(10), chr(10), 'Body:', chr(10), body) t, (ord % 90)::int - 5 s, (ord % 70)::int + 10 e from mail),
d as (select message_id, substr(t, 3, 30) x, greatest(s, 0) s, least(e, length(t)) e, length(t) n from c), f as (select *, case when e <= s then least(s + length(x), n) else e end e2 from d)
select message_id, x excerpt, s char_start, e2::int char_end, e2 > s valid from f""")
def offset_clamp(spark, sf_dir):
    m = mails(spark, sf_dir).withColumn("t", text.combined(F.col("subject"), F.col("body")))
    span = text.clamp((F.col("ord") % 90).cast("int") - 5, (F.col("ord") % 70).cast("int") + 10, F.substring("t", 3, 30), F.char_length("t"))
    return m.select("message_id", span.alias("x")).select("message_id", "x.*")


@add(f"with {_PERSONS} select id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) norm, usr username, array_to_string(list_sort(toks), ',') tokens from u")
def name_normalize(spark, sf_dir):
    p = people(spark, sf_dir)
    return p.select("id", text.name_normalize(F.col("name")).alias("norm"), text.username(F.col("emails")[0]).alias("username"), F.array_join(F.sort_array(text.name_tokens(F.col("name"))), ",").alias("tokens"))


@add("select doc_id, len(t) n, md5(array_to_string(t, ' ')) tokens from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents)")
def tokenize(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").withColumn("t", text.tokenize(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@add("""with w as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+') if x <> ''] w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] end s from w)
select doc_id, len(s) n, md5(array_to_string(s, '|')) grams from s""")
def shingles(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").withColumn("s", text.shingles(F.col("text")))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("grams"))


# ----- dedup ------------------------------------------------------------------------------------------------------------


@add(f"with {_MAIL} select message_id, source_id sha, case when ord <> min(ord) over (partition by source_id) then first_value(message_id) over (partition by source_id order by ord) end duplicate_of from mail")
def exact_dedup(spark, sf_dir):
    return dedup.exact(mails(spark, sf_dir), F.col("normalised")).select("message_id", "sha", "duplicate_of")


@add(f"with {_MAIL}, f as (select *, row_number() over (partition by source_id order by ord) rn from mail) select message_id, ord from f where rn = 1")
def unique_messages(spark, sf_dir):
    return dedup.exact(mails(spark, sf_dir), F.col("normalised")).where("duplicate_of is null").select("message_id", "ord")


def _document_hashes(spark, sf_dir):
    return dedup.simhash(views.table(spark, sf_dir, "documents").select("doc_id", "text"), id_col="doc_id", text_col="text").withColumn("ord", F.col("doc_id"))


@add(f"with {_SIMHASH} select doc_id, simhash from sim")
def simhash(spark, sf_dir):
    return _document_hashes(spark, sf_dir).select("doc_id", "simhash")


@add(f"""with {_SIMHASH}, lead as (select simhash, min(doc_id) id from sim where simhash is not null group by 1)
select x.id a, y.id b, bit_count(xor(x.simhash, y.simhash))::int distance from lead x join lead y on x.id < y.id and bit_count(xor(x.simhash, y.simhash)) <= 3
union all select id, doc_id, 0 from sim join lead using (simhash) where doc_id <> id""")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(stored(_document_hashes(spark, sf_dir), "simhash"), id_col="doc_id")


@add(f"""with recursive {_SIMHASH}, near as materialized (select x.doc_id a, y.doc_id b from sim x join sim y on x.doc_id < y.doc_id and bit_count(xor(x.simhash, y.simhash)) <= 3),
seq as materialized (select b, list(a order by a) before, row_number() over (order by b) k from near group by b),
walk(k, dup) as (select 0::bigint, [-1::bigint] union all select walk.k + 1, case when len([x for x in seq.before if not list_contains(walk.dup, x)]) > 0 then list_append(walk.dup, seq.b) else walk.dup end from walk join seq on seq.k = walk.k + 1),
dups as (select unnest(dup) d from walk where k = (select max(k) from walk)),
led as (select b, min(a) leader from near where b in (select d from dups) and a not in (select d from dups) group by b)
select doc_id, leader from documents left join led on led.b = doc_id""")
def near_dup_leaders(spark, sf_dir):
    h = stored(_document_hashes(spark, sf_dir), "simhash")
    return dedup.leaders(h, stored(dedup.near_pairs(h, id_col="doc_id"), "near-pairs"), id_col="doc_id")


@add(f"with {_MAIL}, q as (select message_id src, unnest(list_distinct([concat('<', y, '>') for y in regexp_extract_all(body_raw, '<([^>]+@[^>]+)>', 1) if contains(y, '.')])) dst from mail) select src, dst from q where src <> dst and dst in (select message_id from mail)")
def quotes_edges(spark, sf_dir):
    return dedup.quotes_edges(mails(spark, sf_dir))


# ----- entities --------------------------------------------------------------------------------------------------------


@add(f"with recursive {_PERSONS} select first_value(id) over w a, id b, usr \"user\" from u window w as (partition by usr order by ord) qualify id <> first_value(id) over w")
def username_stars(spark, sf_dir):
    return entities.username_stars(people(spark, sf_dir)).select("a", "b", "user")


_TWO_MAILS = """two as (select c_custkey ord, concat('Customer ', c_custkey) as name, concat('c', c_custkey, '@x.example') e1, concat('team', c_custkey % 40, '@y.example') e2, substr(sha256(concat('c', c_custkey, '@x.example')), 1, 16) id from customer),
stars as (select min_by(id, ord) over (partition by e2) a, id b from two)"""


def _two_mails(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("ord"), F.concat(F.lit("Customer "), k).alias("name"), F.array(F.lit(None).cast("string"), F.concat(F.lit(" C"), k, F.lit("@x.example")), F.concat(F.lit("team"), k % 40, F.lit("@Y.example"))).alias("emails"))
    none = rows.limit(1).select(F.lit(-1).cast("long").alias("ord"), F.lit("nobody").alias("name"), F.array(F.lit(" "), F.lit(None).cast("string")).alias("emails"))
    return entities.persons(rows.unionByName(none))


@add(f"with {_TWO_MAILS} select a, b, 'email_exact_match' reason from stars where a <> b")
def email_edges(spark, sf_dir):
    return entities.edges(_two_mails(spark, sf_dir)).select("a", "b", "reason")


@add("""with p as (select c_custkey k, substr(sha256(concat('c', c_custkey, '@x.example')), 1, 16) id from customer)
select least(x.k, y.k) ka, greatest(x.k, y.k) kb, 'manual_override' reason from p x join p y on y.k = x.k - x.k % 10 where x.k % 10 in (3, 7)""")
def override_edges(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    mail = lambda x: F.concat(F.lit("c"), x, F.lit("@x.example"))
    p = entities.persons(c.select(k.alias("ord"), F.concat(F.lit("n"), k).alias("name"), F.array(mail(k)).alias("emails")))
    manual = c.where("c_custkey % 10 in (3, 7)").select(F.upper(mail(k)).alias("alias"), mail(k - k % 10).alias("target"))
    named = p.select("id", "ord")
    found = entities.edges(p, manual).join(named.select(F.col("id").alias("a"), F.col("ord").alias("ka")), "a").join(named.select(F.col("id").alias("b"), F.col("ord").alias("kb")), "b")
    return found.select("ka", "kb", "reason")


@add(f"with recursive {_PERSONS} select a, b, reason from edges")
def person_edges(spark, sf_dir):
    return entities.edges(people(spark, sf_dir)).select("a", "b", "reason")


def _resolved(spark, sf_dir):
    p = people(spark, sf_dir)
    links = stored(entities.edges(p), "person-links")
    return p, links, entities.canonical(p, links)


@add(f"with recursive {_PERSONS} select id, canonical_id from resolved")
def person_components(spark, sf_dir):
    return _resolved(spark, sf_dir)[2].select("id", "canonical_id")


@add(f"with recursive {_PERSONS} select concat('merge_', substr(sha256(concat_ws('|', id, canonical_id)), 1, 12)) id, id source_id, canonical_id target_id, 'Person' entity_type, 'username_name_cluster' reason from resolved where id <> canonical_id")
def merge_log(spark, sf_dir):
    _, links, found = _resolved(spark, sf_dir)
    return entities.merge_log(found, links).drop("merged_by")


@add(f"with recursive {_PERSONS} select canonical_id, string_agg(email, ',' order by ord) emails from resolved group by 1")
def merged_emails(spark, sf_dir):
    return entities.merged_emails(_resolved(spark, sf_dir)[2]).select("canonical_id", F.array_join("emails", ",").alias("emails"))


@add(f"with recursive {_persons_sql('ord % 5 <> 0')} select id, canonical_id from resolved")
def merge_undo(spark, sf_dir):
    p = people(spark, sf_dir)
    return entities.undo(p, p.where("ord % 5 = 0").select("id")).select("id", "canonical_id")


@add("select p_type as type, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) norm, min(p_partkey) id from part group by 1, 2")
def name_canonical(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    return entities.canonical_names(p)


@add("select p_partkey, min(p_partkey) over (partition by p_type, lower(p_name)) canonical from part")
def name_resolve(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    known = entities.canonical_names(p.select(F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord")))
    asked = p.select("p_partkey", F.col("p_type").alias("type"), F.concat(F.lit("  "), F.upper("p_name"), F.lit("!")).alias("name"))
    return entities.resolve_names(asked, known).select("p_partkey", F.col("id").alias("canonical"))


# ----- claims -----------------------------------------------------------------------------------------------------------


@add(f"with {_CLAIMS} select id, type, subject_id, object_id, text, confidence, valid_from, support_count from merged")
def claims_merge(spark, sf_dir):
    return C.merge(views.claims(spark, sf_dir)).drop("ord")


@add(f"with {_CLAIMS} select id, claim_a_id, claim_b_id, resolution from conflicts")
def claim_conflicts(spark, sf_dir):
    return graph(spark, sf_dir)[1].select("id", "claim_a_id", "claim_b_id", "resolution")


@add(f"with {_CLAIMS} select id, valid_from, valid_to, support_count from claims")
def claim_supersession(spark, sf_dir):
    return graph(spark, sf_dir)[0].select("id", "valid_from", "valid_to", "support_count")


@add(f"with {_CLAIMS} select id, case when type in ('ASSIGNED', 'DECIDED', 'REVERSED') then lead(valid_from) over (partition by type, subject_id order by valid_from, ord) end valid_to from merged")
def claim_chain(spark, sf_dir):
    merged = C.merge(views.claims(spark, sf_dir))
    return C.supersede(merged, None, chain=True).select("id", "valid_to")


@add("select x.label k, x.vec_id a, y.vec_id b, round(list_inner_product(x.embedding::double[], y.embedding::double[]), 6) cosine from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_inner_product(x.embedding::double[], y.embedding::double[]) >= 0.3")
def claims_semantic_pairs(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return C.semantic_pairs(e, key="label", id_col="vec_id", vector_col="embedding", threshold=0.3).withColumn("cosine", F.round("cosine", 6))


_SEMANTIC = """near as materialized (select x.vec_id a, y.vec_id b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id and (x.vec_id % 97 = y.vec_id % 97 or list_inner_product(x.embedding::double[], y.embedding::double[]) >= 0.3)),
seq as materialized (select b, list(a order by a) before, row_number() over (order by b) k from near group by b),
walk(k, dup) as (select 0::bigint, [-1::bigint] union all select walk.k + 1, case when len([x for x in seq.before if not list_contains(walk.dup, x)]) > 0 then list_append(walk.dup, seq.b) else walk.dup end from walk join seq on seq.k = walk.k + 1),
dups as (select unnest(dup) d from walk where k = (select max(k) from walk)),
led as (select b, min(a) leader from near where b in (select d from dups) and a not in (select d from dups) group by b),
grouped as (select vec_id ord, label, coalesce(leader, vec_id) leader_ord from embeddings left join led on b = vec_id)"""


def _with_vectors(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.lit("MENTIONS").alias("type"), F.col("label").cast("string").alias("subject_id"), (F.col("vec_id") % 97).cast("string").alias("object_id"), F.lit("text").alias("text"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.col("embedding").alias("vector"))


@add(f"with recursive {_SEMANTIC} select ord, leader_ord from grouped")
def claims_semantic_groups(spark, sf_dir):
    return C.semantic_groups(_with_vectors(spark, sf_dir), threshold=0.3, head=16)


@add(f"with recursive {_SEMANTIC} select label::varchar subject_id, (leader_ord % 97)::varchar object_id, count(*) support_count from grouped group by 1, 2")
def claims_semantic_merge(spark, sf_dir):
    return C.deduplicate(_with_vectors(spark, sf_dir), threshold=0.3)[0].select("subject_id", "object_id", "support_count")


@add(f"with {_CLAIMS} select id, confidence, confidence < 0.5 review from merged")
def quarantine(spark, sf_dir):
    ok, review = C.quarantine(C.merge(views.claims(spark, sf_dir)))
    return ok.select("id", "confidence", F.lit(False).alias("review")).unionByName(review.select("id", "confidence", F.lit(True).alias("review")))


# ----- extraction -------------------------------------------------------------------------------------------------------

_VOTES = """votes as (select *, regexp_replace(replace(replace(subject, '[VOTE]', ''), '[vote]', ''), '^\\s+|\\s+$', '', 'g') summary from mail where contains(upper(subject), 'VOTE'))"""
_ISSUES = """iss as (select *, unnest(regexp_extract_all(body, 'BZ-\\d+')) ref, unnest(range(len(regexp_extract_all(body, 'BZ-\\d+')))) i, regexp_extract_all(body, 'BZ-\\d+') refs, regexp_split_to_array(body, 'BZ-\\d+') gaps from mail),
issues as (select *, (coalesce(list_sum([length(x) for x in gaps[1:i+1]]), 0) + coalesce(list_sum([length(x) for x in refs[1:i]]), 0))::int pos from iss)"""


@add(f"with {_MAIL} select message_id, pid id, sender as name, from_addr email from mail")
def sender_entities(spark, sf_dir):
    return extract.people(mails(spark, sf_dir)).select("message_id", "id", "name", "email")


@add(f"""with {_MAIL}, {_VOTES} select message_id, substr(sha256(substr(summary, 1, 80)), 1, 16) decision_id, summary, case when contains(upper(body), 'RESOLVED') or contains(body, '+2') then 'passed' else 'pending' end vote_result,
case when contains(body, '+1') then 'SUPPORTS' when contains(body, '-1') then 'OPPOSES' else 'DECIDED' end as type, pid subject_id,
concat(sender, ' ', case when contains(body, '+1') then 'supports' when contains(body, '-1') then 'opposes' else 'proposed' end, ': ', summary) as text, substr(body, 1, 200) excerpt, length(body) > 0 valid from votes""")
def vote_decisions(spark, sf_dir):
    return extract.votes(mails(spark, sf_dir)).select("message_id", "decision_id", "summary", "vote_result", "type", "subject_id", "text", "excerpt", "valid")


@add(f"with {_MAIL}, {_ISSUES} select message_id, i::int i, ref external_id, substr(sha256(ref), 1, 16) id, concat('https://bz.apache.org/bugzilla/show_bug.cgi?id=', substr(ref, 4)) tracker_url, pos char_start, (pos + length(ref))::int char_end from issues")
def issue_refs(spark, sf_dir):
    return extract.issues(mails(spark, sf_dir)).select("message_id", "i", "external_id", "id", "tracker_url", "char_start", "char_end")


@add(f"with {_MAIL}, {_ISSUES} select message_id, pid subject_id, substr(sha256(ref), 1, 16) object_id, concat('Bug ', ref, ' mentioned by ', sender) as text, pos char_start from issues where contains(lower(body), 'assigned')")
def assignments(spark, sf_dir):
    return extract.assignments(extract.issues(mails(spark, sf_dir))).select("message_id", "subject_id", "object_id", "text", "char_start")


@add(f"""with {_MAIL}, names(n) as (values ('mod_ssl'), ('worker MPM'), ('httpd-worker'), ('mod_rewrite'))
select message_id, n as name, substr(sha256(concat(lower(n), '|')), 1, 16) object_id, greatest(instr(lower(body), lower(n)) - 1, 0)::int char_start from mail, names where contains(lower(body), lower(n)) or contains(lower(subject), lower(n))""")
def component_mentions(spark, sf_dir):
    return extract.mentions(mails(spark, sf_dir)).select("message_id", "name", "object_id", "char_start")


@add(f"""with {_MAIL}, {_VOTES}, {_ISSUES}, names(n) as (values ('mod_ssl'), ('worker MPM'), ('httpd-worker'), ('mod_rewrite')),
c as (select case when contains(body, '+1') then 'SUPPORTS' when contains(body, '-1') then 'OPPOSES' else 'DECIDED' end t, pid s, substr(sha256(substr(summary, 1, 80)), 1, 16) o from votes where length(body) > 0
union all select 'ASSIGNED', pid, substr(sha256(ref), 1, 16) from issues where contains(lower(body), 'assigned')
union all select 'MENTIONS', pid, substr(sha256(concat(lower(n), '|')), 1, 16) from mail, names where contains(lower(body), lower(n)) or contains(lower(subject), lower(n)))
select t as type, s subject_id, o object_id, count(*) support_count from c group by 1, 2, 3""")
def extracted_claims(spark, sf_dir):
    return C.merge(extract.claims(mails(spark, sf_dir))).select("type", "subject_id", "object_id", "support_count")


def _outputs(spark, sf_dir):
    """Model output for every order: fenced or not, some broken, some with spans and numbers that can't be used."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ents = F.concat(F.lit('{"entities": [{"type": "Person", "name": "P'), k % 50, F.lit('", "excerpt": "from P", "email_addresses": ["p'), k % 50, F.lit('@x.example"], "confidence": 0.9}, {"type": "'), F.element_at(F.array(*[F.lit(x) for x in ("Issue", "Decision", "Component", "Project", "Gadget")]), (k % 5 + 1).cast("int")), F.lit('", "excerpt": "a thing", "char_start": '), k % 40 - 3, F.lit(', "name": "Thing '), k % 30, F.lit('"}], "claims": [{"type": "'))
    span = F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(', "excerpt": "said so", "char_start": '), k % 60 - 5, F.lit(', "char_end": '), k % 80))
    body = F.concat(ents, F.when(k % 3 == 0, "SUPPORTS").otherwise("LIKES"), F.lit('", "subject_name": "p'), k % 50, F.lit('", "object_name": "'), F.when(k % 4 == 0, "Nobody").otherwise(F.concat(F.lit("THING "), k % 30)), F.lit('", "text": "t"'), span, F.when(k % 17 == 0, F.lit(', "confidence": 1.5')).otherwise(""), F.lit("}]}"))
    raw = F.when(k % 7 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(k % 11 == 0, F.lit("no json")).otherwise(body)
    return o.select(k.cast("string").alias("message_id"), F.lit("me@x.example").alias("from_addr"), F.lit(64).alias("text_length"), raw.alias("raw"))


@add("""select o_orderkey::varchar message_id, o_orderkey % 7 = 0 or o_orderkey % 11 <> 0 parsed, case when o_orderkey % 7 = 0 or o_orderkey % 11 <> 0 then 2 end n_entities from orders""")
def json_repair(spark, sf_dir):
    out = _outputs(spark, sf_dir).withColumn("out", extract.parse_output(F.col("raw")))
    return out.select("message_id", F.col("out.entities").isNotNull().alias("parsed"), F.when(F.col("out.entities").isNotNull(), F.size("out.entities")).alias("n_entities"))


_TYPED = """k as (select o_orderkey k, ['Issue', 'Decision', 'Component', 'Project', 'Concept'][(o_orderkey % 5 + 1)::int] t, concat('Thing ', o_orderkey % 30) n from orders where o_orderkey % 7 = 0 or o_orderkey % 11 <> 0),
typed as (select k::varchar message_id, 0 i, 'Person' as type, substr(sha256(concat('p', k % 50, '@x.example')), 1, 16) id, concat('P', k % 50) as name, 0.9 confidence from k
union all select k::varchar, 1, t, substr(sha256(case t when 'Issue' then 'BZ-unknown' when 'Decision' then n when 'Component' then concat(lower(n), '|') when 'Project' then lower(n) else lower(n) end), 1, 16), case t when 'Issue' then 'BZ-unknown' else n end, 0.8 from k)"""


@add(f"with {_TYPED} select message_id, i, type, id, name, confidence::double confidence from typed")
def typed_entities(spark, sf_dir):
    out = _outputs(spark, sf_dir).withColumn("out", extract.parse_output(F.col("raw")))
    return extract.typed_entities(out).select("message_id", "i", "type", "id", "name", "confidence")


@add(f"""with {_TYPED} select k::varchar message_id, case when k % 3 = 0 then 'SUPPORTS' else 'MENTIONS' end as type, p.id subject_id, case when k % 4 = 0 then 'unresolved:nobody' else e.id end object_id
from k join typed p on p.message_id = k::varchar and p.i = 0 join typed e on e.message_id = k::varchar and e.i = 1
where k % 17 <> 0 and k % 13 <> 0 and (least(k % 80, 64) > greatest(k % 60 - 5, 0) or greatest(k % 60 - 5, 0) < 64)""")
def claim_resolution(spark, sf_dir):
    out = _outputs(spark, sf_dir).withColumn("out", extract.parse_output(F.col("raw")))
    return extract.resolved_claims(out, extract.typed_entities(out)).select("message_id", "type", "subject_id", "object_id")


@add(f"""with {_TYPED}, c as (select k, greatest(k % 60 - 5, 0) s, least(k % 80, 64) e from k), d as (select k, s, case when k % 13 = 0 then '' else 'said so' end x, case when k % 13 = 0 then 0 else s end s2, case when k % 13 = 0 then 0 when e <= s then least(s + 7, 64) else e end e2 from c)
select k::varchar message_id, x excerpt, s2::int char_start, e2::int char_end, concat_ws(',', case when k % 17 = 0 then 'confidence' end, case when e2 <= s2 then 'empty_span' end) reasons from d""")
def evidence_spans(spark, sf_dir):
    out = _outputs(spark, sf_dir).withColumn("out", extract.parse_output(F.col("raw")))
    found = extract.claim_candidates(out, extract.typed_entities(out))
    return found.select("message_id", "excerpt", "char_start", "char_end", F.array_join("reject_reasons", ",").alias("reasons"))


def _answer(prompt: str) -> str:
    """A stand-in for a model: quotes the subject, wrongly at first for bugs, never rightly for week 13."""
    import json
    import re

    subject = re.search("Subject: (.*)", prompt)[1]
    if "week 13" in subject or (subject.startswith("[BUG]") and "not valid" not in prompt):
        return "sorry" if "week" in subject else json.dumps({"claims": [{"text": "x", "excerpt": "y", "confidence": 7}]})
    return json.dumps({"entities": [{"type": "Concept", "label": "it", "excerpt": subject, "char_start": 9}], "claims": [{"type": "MENTIONS", "object_name": "it", "text": subject, "excerpt": subject, "char_start": 9, "char_end": 9 + len(subject)}]})


@add(f"""with {_MAIL}, k as (select *, contains(subject, 'week 13') lost, starts_with(subject, '[BUG]') bug from mail)
select message_id, case when lost then 3 when bug then 1 else 0 end retries, case when lost then 3 when bug then 1 else 0 end::int n_errors, not (lost or bug) is_clean, case when not lost then subject end excerpt, case when not lost then 9 end char_start, case when not lost then (9 + length(subject))::int end char_end,
case when not lost then substr(sha256('it'), 1, 16) end object_id, case when not lost then concat('test:1.0:', substr(md5('{extract.PROMPT}v1'), 1, 8)) end extraction_version from k""".replace("'entities'", "''entities''").replace("'claims'", "''claims''"))
def model_extraction(spark, sf_dir):
    m = mails(spark, sf_dir)
    out = stored(extract.flags(extract.ask(m, _answer)), "outputs")
    from quillgraph.plans.pipeline import by_model

    found = by_model(m, out, extract.extraction_version("test"))[1].select("message_id", "excerpt", "char_start", "char_end", "object_id", "extraction_version")
    return out.select("message_id", "retries", F.size("errors").alias("n_errors"), "is_clean").join(found, "message_id", "left")


@add(f"with {_MAIL}, done as (select distinct source_id from mail where ord % 5 = 0) select message_id from mail where source_id not in (select source_id from done)")
def unseen_messages(spark, sf_dir):
    m = mails(spark, sf_dir)
    done = m.where("ord % 5 = 0").select("source_id", extract.extraction_version("a").alias("extraction_version")).unionByName(m.select("source_id", F.lit("an older one").alias("extraction_version")))
    return extract.unseen(m, done, extract.extraction_version("a")).select("message_id")


# ----- store ---------------------------------------------------------------------------------------------------------------


@add(f"with {_ENTITIES} select id, type, name, canonical_id, metadata_json, confidence, ord from entities")
def entity_upsert(spark, sf_dir):
    rows = entity_rows(spark, sf_dir)
    return store.upsert_entities(None, rows).drop("deleted_at")


@add(f"with {_MAIL} select concat('<', ord % 500, '>') message_id, arg_min(subject, ord) subject, min(ord) ord from mail group by 1")
def message_upsert(spark, sf_dir):
    m = mails(spark, sf_dir).select(F.concat(F.lit("<"), F.col("ord") % 500, F.lit(">")).alias("message_id"), "ord", "subject")
    return store.upsert_messages(None, m)


@add(f"""with {_MAIL}, w as (select concat('<', ord % 500, '>') message_id, subject, ord, case when ord % 3 = 0 then 0 else 1 end nw from mail)
select message_id, arg_min(subject, nw * 1000000000000 + ord) subject, arg_min(ord, nw * 1000000000000 + ord) ord from w group by 1""")
def message_upsert_twice(spark, sf_dir):
    m = mails(spark, sf_dir).select(F.concat(F.lit("<"), F.col("ord") % 500, F.lit(">")).alias("message_id"), "ord", "subject")
    old = store.upsert_messages(None, m.where("ord % 3 = 0"))
    return store.upsert_messages(store.upsert_messages(old, m.where("ord % 3 <> 0")), m)


@add(f"""with {_ENTITIES}, w as (select *, case when ord % 3 = 0 then 0 else 1 end * 1000000000 + ord pos from ents)
select id, arg_min(type, pos) type, arg_min(name, pos) as name, arg_max(canonical_id, pos) canonical_id, arg_max(metadata_json, pos) metadata_json, arg_max(confidence, pos) confidence, arg_min(ord, pos) ord from w group by id""")
def entity_upsert_twice(spark, sf_dir):
    rows = entity_rows(spark, sf_dir)
    return store.upsert_entities(store.upsert_entities(None, rows.where("ord % 3 = 0")), rows.where("ord % 3 <> 0")).drop("deleted_at")


@add(f"""with {_CLAIMS}, c as (select concat(type, '/', subject_id) id, ord, case when ord % 3 = 0 then 0 else 1 end * 1000000000000 + ord pos, text, valid_from, support_count, valid_to, confidence from claims)
select id, arg_min(text, pos) as text, arg_min(ord, pos) ord, arg_max(support_count, pos) support_count, arg_max_null(valid_to, pos) valid_to, arg_max(confidence, pos) confidence from c group by id""")
def claim_upsert_twice(spark, sf_dir):
    c = stored(graph(spark, sf_dir)[0].withColumn("id", F.concat_ws("/", "type", "subject_id")), "claims")
    return store.upsert_claims(store.upsert_claims(None, c.where("ord % 3 = 0")), c.where("ord % 3 <> 0")).select("id", "text", "ord", "support_count", "valid_to", "confidence")


@add(f"with {_CLAIMS} select id, case when ts < {AT} then excerpt else upper(excerpt) end excerpt, ord from evidence")
def evidence_insert_twice(spark, sf_dir):
    e = stored(graph(spark, sf_dir)[2], "evidence")
    return store.insert_evidence(e.where(F.col("ts") < F.expr(AT.replace("timestamp", "timestamp_ntz"))), e.withColumn("excerpt", F.upper("excerpt"))).select("id", "excerpt", "ord")


@add(f"with {_CLAIMS} select id, case when resolution is null then 'old' else 'new' end batch from conflicts")
def append_twice(spark, sf_dir):
    c = stored(graph(spark, sf_dir)[1], "conflicts")
    return store.append_new(c.where("resolution is null").withColumn("batch", F.lit("old")), c.withColumn("batch", F.lit("new"))).select("id", "batch")


@add("select concat('run_', substr(sha256(concat_ws('|', o_orderpriority, '1.0', 'abcd')), 1, 12)) id, o_orderpriority model, count(*) message_count from orders group by o_orderpriority")
def extraction_runs(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.lit("1.0").alias("schema_version"), F.lit("abcd").alias("prompt_hash"), F.count("*").alias("message_count"))
    return store.run_row(o).select("id", "model", "message_count")


@add(f"with {_CLAIMS} select claim_a_id src, claim_b_id dst, 'CONFLICTS_WITH' as type from conflicts")
def conflict_edges(spark, sf_dir):
    return C.conflict_edges(graph(spark, sf_dir)[1])


@add(f"with {_ENTITIES} select id, name, case when id in ('part:1', 'part:4') then {AT} end deleted_at from entities")
def soft_delete(spark, sf_dir):
    e = store.upsert_entities(None, entity_rows(spark, sf_dir))
    gone = spark.createDataFrame([("part:1",), ("part:4",), ("part:99",)], "id string")
    return store.soft_delete(e, gone, F.expr(AT.replace("timestamp", "timestamp_ntz"))).select("id", "name", "deleted_at")


@add(f"with {_ENTITIES} select id, name from entities where type = 'Component' and id <> 'part:1'")
def entities_by_type(spark, sf_dir):
    e = store.upsert_entities(None, entity_rows(spark, sf_dir))
    e = store.soft_delete(e, spark.createDataFrame([("part:1",)], "id string"), F.expr(AT.replace("timestamp", "timestamp_ntz")))
    return store.entities_by_type(e, "Component").select("id", "name")


@add("select p_partkey::varchar id, p_name as name from part where p_name ilike '%ED%T%' order by p_partkey::varchar limit 50")
def entity_search(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return store.search_entities(p, "ED%T").select("id", "name")


@add(f"with {_ENTITIES} select id, name, confidence from entities where id = 'part:3'")
def entity_lookup(spark, sf_dir):
    return store.entity(store.upsert_entities(None, entity_rows(spark, sf_dir)), "part:3").select("id", "name", "confidence")


@add(f"""with {_CLAIMS}, c as (select concat(type, '/', subject_id) id, ord, type, text, valid_from, support_count, valid_to, confidence from claims)
select id, arg_min(text, ord) as text, arg_min(valid_from, ord) valid_from, arg_max(support_count, ord) support_count, arg_max_null(valid_to, ord) valid_to, arg_max(confidence, ord) confidence from c group by id""")
def claim_upsert(spark, sf_dir):
    c = graph(spark, sf_dir)[0].withColumn("id", F.concat_ws("/", "type", "subject_id"))
    return store.upsert_claims(None, c).select("id", "text", "valid_from", "support_count", "valid_to", "confidence")


@add(f"with {_CLAIMS} select id, claim_id, source_id, char_start, excerpt, ts from evidence")
def evidence_upsert(spark, sf_dir):
    return graph(spark, sf_dir)[2].select("id", "claim_id", "source_id", "char_start", "excerpt", "ts")


@add(f"with {_CLAIMS} select id, type, valid_from, valid_to from claims where valid_from <= {AT} and (valid_to is null or valid_to > {AT})")
def claims_asof(spark, sf_dir):
    return store.as_of(graph(spark, sf_dir)[0], F.expr(AT.replace("timestamp", "timestamp_ntz"))).select("id", "type", "valid_from", "valid_to")


@add(f"""with {_CLAIMS} select c.id, c.confidence, string_agg(e.excerpt, ' || ' order by e.ts, e.id) excerpts from claims c left join evidence e on e.claim_id = c.id where (subject_id = 'cust:12' or object_id = 'cust:12') and valid_to is null group by c.id, c.confidence""")
def entity_claims(spark, sf_dir):
    claims, _, evidence = graph(spark, sf_dir)
    return store.claims_for_entity(claims, evidence, "cust:12", current_only=True).select("id", "confidence", "excerpts")


@add(f"with {_CLAIMS} select id, excerpt, ts from evidence where claim_id = (select min(id) from merged where type = 'DECIDED')")
def claim_evidence(spark, sf_dir):
    claims, _, evidence = graph(spark, sf_dir)
    one = claims.where("type = 'DECIDED'").agg(F.min("id")).first()[0]
    return store.evidence_for_claim(evidence, one).select("id", "excerpt", "ts")


@add(f"with {_CLAIMS} select id, type, support_count, confidence from claims where valid_to is null and confidence >= 0.3 and type = 'ASSIGNED' order by support_count desc, confidence desc, id limit 500")
def current_claims(spark, sf_dir):
    return store.current_claims(graph(spark, sf_dir)[0], kind="ASSIGNED", least=0.3).select("id", "type", "support_count", "confidence")


@add(f"with recursive {_PERSONS}, one as (select min(canonical_id) c from resolved where id <> canonical_id) select id source_id, canonical_id target_id from resolved, one where id <> canonical_id and (id = c or canonical_id = c)")
def merge_log_for(spark, sf_dir):
    _, links, found = _resolved(spark, sf_dir)
    log = stored(entities.merge_log(found, links), "merge-log")
    return store.merge_log_for(log, log.agg(F.min("target_id")).first()[0] or "").select("source_id", "target_id")


@add(f"with {_CLAIMS} select id, claim_a_id, claim_b_id from conflicts where resolution is null")
def open_conflicts(spark, sf_dir):
    return store.open_conflicts(graph(spark, sf_dir)[1]).select("id", "claim_a_id", "claim_b_id")


@add(f"""with recursive {_CLAIMS}, {_ENTITIES}, {_PERSONS} select (select count(*) from entities) entities, (select count(*) from claims where valid_to is null) claims_current, (select count(*) from claims where valid_to is not null) claims_historical,
(select count(*) from evidence) evidence, (select count(*) from orders) messages, (select count(*) from resolved where id <> canonical_id) merges, (select count(*) from conflicts where resolution is null) conflicts_open""")
def graph_stats(spark, sf_dir):
    claims, found, evidence = graph(spark, sf_dir)
    _, links, people_ = _resolved(spark, sf_dir)
    return store.stats(store.upsert_entities(None, entity_rows(spark, sf_dir)), claims, evidence, views.mail(spark, sf_dir), entities.merge_log(people_, links), found)


@add(f"with {_CLAIMS}, s as (select claim_id, count(*) seen from evidence where char_start in (0, 2) group by 1) select id, seen from claims join s on s.claim_id = id")
def scoped_claims(spark, sf_dir):
    claims, _, evidence = graph(spark, sf_dir)
    scoped, seen = store.scoped(claims, evidence.withColumn("scope", F.concat(F.lit("team"), F.col("char_start"))), ["team0", "team2"])
    return scoped.join(seen.groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("seen")), "id").select("id", "seen")


@add(f"""with {_CLAIMS}, f as (select claim_id id, count(*) n, count(*) filter (substr(source_id, 7)::bigint % 3 = 0) lost from evidence group by 1)
select id, lost = n and lost > 0 redacted, case when lost = n and lost > 0 and valid_to is null then {AT} else valid_to end valid_to, round(case when lost > 0 and lost < n then confidence * 0.5 else confidence end, 6) confidence from claims join f using (id)""")
def redaction(spark, sf_dir):
    claims, _, evidence = graph(spark, sf_dir)
    gone = evidence.where("cast(substr(source_id, 7) as bigint) % 3 = 0").select("source_id")
    return store.redact(claims, evidence, gone, F.expr(AT.replace("timestamp", "timestamp_ntz"))).select("id", "redacted", "valid_to", F.round("confidence", 6).alias("confidence"))


@add(f"""with {_CLAIMS}, f as (select claim_id id, count(distinct message_id) n, min(ts) a, max(ts) b from evidence group by 1), d as (select c.*, n, a, b, date_diff('day', coalesce(b, valid_from), timestamp '1999-01-01 00:00:00') idle from claims c left join f using (id))
select id, case when type in ('DECIDED', 'REVERSED', 'ASSIGNED', 'SUPPORTS', 'OPPOSES') then 'durable' when n >= 3 and date_diff('day', a, b) >= 7 then 'durable' when coalesce(n, 0) <= 1 and confidence < 0.5 then 'ttl_30_days' else 'normal' end durability,
round(case when idle > 180 then confidence * pow(0.5, (idle - 180) / 180.0) else confidence end, 6) decayed from d""")
def durability(spark, sf_dir):
    claims, _, evidence = graph(spark, sf_dir)
    return store.durability(claims, evidence, F.expr("timestamp_ntz '1999-01-01 00:00:00'"))


# ----- retrieval ------------------------------------------------------------------------------------------------------------


#: Parts in which documents are made, one after another, so that shuffles hold a part of them: at least so many, and of about so many rows of claims.
PARTS, ROWS = 8, 1 << 20


def _index(spark, sf_dir):
    """(claims, conflicts, index). Rows of claims are never kept: ranges of orders are merged one after another, and the documents of smaller ranges are made from
    the tables again. Claims and conflicts are stored."""
    n = max(PARTS, -(-views.table(spark, sf_dir, "lineitem").count() // ROWS))
    path = scratch(spark, "merged-parts")
    merged = stored(C.merge_parts(appended(map(C.merge, views.claims_ranges(spark, sf_dir, -(-n // 4))), path)), "merged")
    drop(spark, path)
    found = stored(C.conflicts(merged), "conflicts")
    claims = sent(stored(C.supersede(merged, found), "claims"))
    # a part's rows are few: in two files, evidence of one source lies together and takes less
    return claims, found, retrieve.build_index(retrieve.Parts(claims, [C.evidence(x, claims).coalesce(2) for x in views.claims_ranges(spark, sf_dir, n)]))


@add(f"with {_CLAIMS}, {_BM25} select question_id, doc_id, round(bm25, 6) bm25 from bm")
def bm25(spark, sf_dir):
    return retrieve.bm25(_index(spark, sf_dir)[2], questions(spark)).withColumn("bm25", F.round("bm25", 6))


@add(f"with {_CLAIMS}, {_BM25} select question_id, doc_id, round(bm25_norm, 6) bm25_norm from norm")
def bm25_norm(spark, sf_dir):
    return retrieve.normalised(retrieve.bm25(_index(spark, sf_dir)[2], questions(spark))).select("question_id", "doc_id", F.round("bm25_norm", 6).alias("bm25_norm"))


@add("select q.vec_id::int question_id, e.vec_id doc_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) cosine from embeddings e, embeddings q where q.vec_id in (3, 17, 40)")
def dense_scores(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id in (3, 17, 40)").select(F.col("vec_id").cast("int").alias("question_id"), F.col("embedding").alias("vector"))
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("id"))
    return retrieve.dense(docs, q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).withColumn("cosine", F.round("cosine", 6))


@add(f"with {_CLAIMS}, {_BM25} select question_id, doc_id, round(score, 6) score from kept")
def hybrid_scores(spark, sf_dir):
    return retrieve.hybrid(_index(spark, sf_dir)[2], questions(spark)).select("question_id", "doc_id", F.round("score", 6).alias("score"))


def _top(spark, sf_dir):
    claims, found, index = _index(spark, sf_dir)
    return claims, found, stored(retrieve.select_top(retrieve.hybrid(index, questions(spark)), index.docs), "top")


@add(f"with {_CLAIMS}, {_BM25} select question_id, rank::int rank, id, evidence_id, source_id, round(score, 4) score from top")
def topk_diverse(spark, sf_dir):
    return _top(spark, sf_dir)[2].select("question_id", "rank", "id", "evidence_id", "source_id", F.round("score", 4).alias("score"))


@add(f"with {_CLAIMS}, {_BM25}, {_ENTITIES}, x as (select question_id, subject_id id from top union select question_id, object_id from top) select question_id, id, type, name from x join entities using (id)")
def linked_entities(spark, sf_dir):
    return retrieve.linked_entities(_top(spark, sf_dir)[2], store.upsert_entities(None, entity_rows(spark, sf_dir)))


@add(f"""with {_CLAIMS}, {_BM25} select distinct question_id, k.id conflict_id, a.text text_a, b.text text_b from top join conflicts k on k.resolution is null and (k.claim_a_id = top.id or k.claim_b_id = top.id) join claims a on a.id = k.claim_a_id join claims b on b.id = k.claim_b_id""")
def ambiguities(spark, sf_dir):
    claims, found, top = _top(spark, sf_dir)
    return retrieve.ambiguities(top, found, claims)


@add(f"""with {_CLAIMS}, {_BM25}, f as (select question_id, message_id, min(rank) r, arg_min(ts, rank) ts, arg_min(substr(excerpt, 1, 200), rank) excerpt from top group by 1, 2)
select question_id, (row_number() over (partition by question_id order by r))::int number, message_id, ts, excerpt from f""")
def citations(spark, sf_dir):
    return retrieve.citations(_top(spark, sf_dir)[2]).select("question_id", "number", "message_id", "ts", "excerpt")


def packs(spark, sf_dir):
    claims, found, top = _top(spark, sf_dir)
    return retrieve.context_packs(questions(spark), top, store.upsert_entities(None, entity_rows(spark, sf_dir)), found, claims)


@add(f"""with {_CLAIMS}, {_BM25}, {_ENTITIES},
s as (select question_id, string_agg(concat_ws('|', rank, id, type, text, excerpt, source_id, message_id, strftime(ts, '%Y-%m-%d'), format('{{:.4f}}', round(score, 4))), ';' order by rank) snippets from top group by 1),
f as (select question_id, message_id, min(rank) r, arg_min(substr(excerpt, 1, 200), rank) excerpt from top group by 1, 2),
ci as (select question_id, message_id, excerpt, row_number() over (partition by question_id order by r) number from f),
c as (select question_id, string_agg(concat_ws('|', number, message_id, excerpt, ifnull(o_orderpriority, '-')), ';' order by number) citations from ci left join orders on concat('<', o_orderkey, '@orders.example>') = message_id group by 1),
x as (select question_id, subject_id id from top union select question_id, object_id from top),
e as (select question_id, string_agg(concat_ws('|', id, type, name), ';' order by id) entities from x join entities using (id) group by 1)
select q.question_id, question, snippets, citations, entities from questions q left join s using (question_id) left join c using (question_id) left join e using (question_id)""")
def context_pack(spark, sf_dir):
    claims, found, top = _top(spark, sf_dir)
    o = views.table(spark, sf_dir, "orders")
    messages = o.select(F.concat(F.lit("<"), "o_orderkey", F.lit("@orders.example>")).alias("message_id"), F.col("o_orderpriority").alias("subject"), F.lit("x").alias("from_addr"))
    p = retrieve.context_packs(questions(spark), top, store.upsert_entities(None, entity_rows(spark, sf_dir)), found, claims, messages)
    row = lambda *fields: lambda s: F.concat_ws("|", *[f(s) if callable(f) else s[f].cast("string") for f in fields])
    shown = row("rank", "claim_id", "claim_type", "claim_text", "excerpt", "source_id", "message_id", lambda s: F.date_format(s["ts"], "yyyy-MM-dd"), lambda s: F.format_string("%.4f", s["score"]))
    cited = row("number", "message_id", "excerpt", lambda c: F.coalesce(c["subject"], F.lit("-")))
    return p.select("question_id", "question", *[F.array_join(F.transform(c, f), ";").alias(c) for c, f in (("snippets", shown), ("citations", cited), ("entities", row("id", "type", "name")))])


@add(f"""with {_CLAIMS}, {_BM25}, want as (select distinct 1 question_id, id from claims where subject_id = 'cust:12' and object_id = 'part:3' union all select distinct 2, id from claims where subject_id = 'cust:77')
select question_id, round(count(*) filter (id in (select id from top t where t.question_id = want.question_id and rank <= 5)) / count(*), 6) recall from want group by 1""")
def recall_at_k(spark, sf_dir):
    claims, _, top = _top(spark, sf_dir)
    want = claims.where("subject_id = 'cust:12' and object_id = 'part:3'").select(F.lit(1).alias("question_id"), "id").unionByName(claims.where("subject_id = 'cust:77'").select(F.lit(2).alias("question_id"), "id"))
    return retrieve.recall_at_k(top, want, 5).withColumn("recall", F.round("recall", 6))


@add("select date_trunc('hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def activity_windows(spark, sf_dir):
    from quillgraph.streaming.activity import tumbling

    e = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ----- queries over what stands beside the main path ----------------------------------------------------------------


@add(f"""with {_CLAIMS}, {_BM25}, near as (select q.vec_id question_id, c.id, list_inner_product(e.embedding::double[], q.embedding::double[]) cosine
  from claims c join embeddings e on e.vec_id = c.ord % 100 join embeddings q on q.vec_id in (select question_id from questions))
select question_id, doc_id, round(score + 0.3 * coalesce(cosine, 0), 6) score from kept left join near using (question_id, id)""")
def hybrid_with_vectors(spark, sf_dir):
    claims, _, index = _index(spark, sf_dir)
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = questions(spark).join(e, F.col("question_id") == F.col("vec_id")).drop("vec_id")
    vectors = claims.select("id", (F.col("ord") % 100).alias("vec_id")).join(e, "vec_id").drop("vec_id")
    return retrieve.hybrid(index, asked, vectors).select("question_id", "doc_id", F.round("score", 6).alias("score"))


def _empty_packs(spark, sf_dir):
    claims, found, top = _top(spark, sf_dir)
    nothing = F.lit(False)
    return retrieve.context_packs(questions(spark), top.where(nothing), store.upsert_entities(None, entity_rows(spark, sf_dir)), found, claims)


@add(f"with {_QUESTIONS} select question_id, question, 0 snippets, 0 entities, 0 citations, 'No indexed evidence.' notice, concat('QUESTION  ', question, chr(10), chr(10), 'OPEN QUESTIONS', chr(10), '* No indexed evidence.') text from questions")
def empty_index_answer(spark, sf_dir):
    found = stored(_empty_packs(spark, sf_dir), "empty-packs")
    sizes = [F.coalesce(F.array_size(c), F.lit(0)).alias(c) for c in ("snippets", "entities", "citations")]
    return found.select("question_id", "question", *sizes, F.array_join("ambiguities.text", ";").alias("notice")).join(retrieve.render(found), "question_id")


@add(f"with {_QUESTIONS} select question_id, question, concat(replace(replace(replace(substr(question, 1, 40), ' ', '_'), '?', ''), '/', '_'), '.json') file from questions")
def pack_files(spark, sf_dir):
    from quillgraph.plans.scratch import scratch
    from quillgraph.sources import config

    path = scratch(spark, "pack-files")
    config.export_packs(_empty_packs(spark, sf_dir), path)
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "question_id int, question string").alias("x"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    return files.select("x.*", "file")


@add(f"with recursive {_PERSONS}, known as (select email, concat('employee ', split_part(email, '@', 1)) employee from people where ends_with(email, '@d0.example') group by email) select id, email, employee from people left join known using (email)")
def directory_identity(spark, sf_dir):
    found = people(spark, sf_dir).withColumn("email", F.element_at("emails", 1))
    known = found.where("email like '%@d0.example'").select("email", F.concat(F.lit("employee "), F.split_part("email", F.lit("@"), F.lit(1))).alias("employee")).distinct()
    return entities.directory(found, known).select("id", "email", "employee")


@add("select x.label k, x.vec_id a, y.vec_id b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_inner_product(x.embedding::double[], y.embedding::double[]) >= 0.3 and (x.vec_id + y.vec_id) % 3 > 0")
def judged_pairs(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    found = C.semantic_pairs(e, key="label", id_col="vec_id", vector_col="embedding", threshold=0.3)
    return C.judged(found, (F.col("a") + F.col("b")) % 3 > 0).select("k", "a", "b")


@add("select concat(lower(replace(n_name, ' ', '.')), '@nation.example') as alias, concat('region', cast(n_regionkey as varchar), '@region.example') target from nation")
def alias_overrides(spark, sf_dir):
    from quillgraph.plans.scratch import scratch
    from quillgraph.sources import config

    path = scratch(spark, "overrides")
    n = views.table(spark, sf_dir, "nation")  # a settings file, made of a table that does not grow
    pair = F.struct(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("."))), F.lit("@nation.example")), F.concat(F.lit("region"), "n_regionkey", F.lit("@region.example")))
    n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(pair)).alias("person_aliases")))).coalesce(1).write.text(path)
    return config.overrides(spark, path)


@add(f"with {_MAIL} select message_id, concat('rules:', '{ids.SCHEMA_VERSION}', ':', substr(md5('{extract.PROMPT.replace("'", "''")}' || 'v1'), 1, 8)) as version from mail")
def extraction_versions(spark, sf_dir):
    return mails(spark, sf_dir).select("message_id", extract.extraction_version("rules").alias("version"))
