"""Small cases of the operators, and random ones against sequential models."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import claims as C
from quillgraph.operators import dedup, entities, extract, retrieve, store
from quillgraph.operators.components import connected_components


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("body", "wanted"),
    [("a\n-- \nsig", "a"), ("a\n--\nx\n-- \ny", "a"), ("a -- b", "a -- b"), ("a\n---\nb", "a\n---\nb"), ("  a  ", "a"), ("", "")],
)
def test_strip_signature(spark, body, wanted):
    assert one(spark, text.strip_signature(F.col("b")), b=body) == wanted


def test_text_functions(spark):
    assert one(spark, text.strip_quotes(F.col("b")), b="> x\n>> y") == ""
    assert one(spark, text.strip_quotes(F.col("b")), b="a\n> x\nb") == "a\nb"
    assert one(spark, text.quoted_ids(F.col("b")), b="<b@x.y> <a@x> <c@d.e> <b@x.y>") == ["<b@x.y>", "<c@d.e>"]
    assert one(spark, text.name_normalize(F.col("b")), b=" A.B  c-d ") == "a b c d"
    assert one(spark, text.username(F.col("b")), b="J.Doe_x-y@Z.org") == "jdoexy"
    for t, n in (("", 0), ("a", 1), ("a b c", 1), ("a b c d", 1), ("a b c d e", 2), (" \n ", 0)):
        assert len(one(spark, text.shingles(F.col("b")), b=t)) == n
    assert one(spark, text.fenced_json(F.col("b")), b='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, text.fenced_json(F.col("b")), b=" {} ") == "{}"


def test_clamp(spark):
    got = [one(spark, text.clamp(F.lit(s), F.lit(e), F.lit(x), F.lit(10))) for s, e, x in ((-3, 4, "abcd"), (2, 99, "ab"), (5, 5, "abc"), (10, 10, "abc"), (3, 3, ""))]
    assert [(r.char_start, r.char_end, r.valid) for r in got] == [(0, 4, True), (2, 10, True), (5, 8, True), (10, 10, False), (3, 3, False)]


def test_components_on_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (30, 12), (60, 80), (40, 39)):
        edges = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        wanted = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == wanted


def test_leaders_follow_the_sequential_rule(spark):
    rng = random.Random(9)
    for case in range(3):
        hashes = [rng.getrandbits(8) * 3 for _ in range(40)] if case else [0, 7, 63]
        leads, wanted = [], {}
        for i, h in enumerate(hashes):
            hit = next((j for j in leads if bin(h ^ hashes[j]).count("1") <= 3), None)
            wanted[i] = hit
            if hit is None:
                leads.append(i)
        df = spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], "id long, ord long, simhash long")
        got = dedup.leaders(df, dedup.near_pairs(df, id_col="id"), id_col="id")
        assert {r.id: r.leader for r in got.collect()} == wanted


def test_exact_dedup_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None), (5, "e", None)], "ord long, message_id string, body string")
    got = {r.message_id: r.duplicate_of for r in dedup.exact(df, F.coalesce("body", F.lit(""))).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None, "e": "d"}
    assert dedup.exact(df.limit(0), F.col("body")).count() == 0


def people(spark, rows):
    return entities.persons(spark.createDataFrame(rows, "ord long, name string, emails array<string>"))


def test_persons_merge_and_undo(spark):
    rows = [(1, "Ann Lee", ["alee@a.x"]), (2, "Ann Q Lee", ["a.lee@b.x", "second@b.x"]), (3, "Bob", ["alee@c.x"]), (4, "Zed", ["zed@z.x", "second@b.x"]), (5, "Other", ["o@o.x"])]
    p = people(spark, rows)
    manual = spark.createDataFrame([("o@o.x", "zed@z.x"), ("nobody@x", "zed@z.x")], "alias string, target string")
    links = entities.edges(p, manual)
    reasons = {r.reason for r in links.collect()}
    assert reasons == {"manual_override", "email_exact_match", "username_name_cluster"}
    found = entities.canonical(p, links)
    by = {r.ord: r.canonical_id for r in found.collect()}
    ids = {r.ord: r.id for r in p.collect()}
    assert by[1] == by[2] == by[4] == by[5] == ids[1] and by[3] == ids[3]
    log = {r.source_id: r.reason for r in entities.merge_log(found, links).collect()}
    assert log == {ids[2]: "email_exact_match", ids[4]: "manual_override", ids[5]: "manual_override"}
    mails = {r.canonical_id: r.emails for r in entities.merged_emails(found).collect()}
    assert mails[ids[1]] == ["alee@a.x", "a.lee@b.x", "second@b.x", "zed@z.x", "o@o.x"]
    back = {r.ord: r.canonical_id for r in entities.undo(p, p.where("ord = 2").select("id"), manual).collect()}
    assert back[2] == ids[2] and back[4] == back[5] == ids[4]


def test_ties_in_ord_keep_their_links(spark):
    same = [(1, "Ann Lee", ["alee@a.x"]), (1, "Ann Q Lee", ["a.lee@b.x"]), (1, "Bo", ["bo@x.y", "team@x.y"]), (1, "Cy", ["cy@x.y", "team@x.y"]), (1, "no address", []), (1, "null", None), (1, "blank", [None, " "])]
    p = people(spark, same)
    assert p.count() == 4
    links = entities.edges(p)
    assert sorted(r.reason for r in links.collect()) == ["email_exact_match", "username_name_cluster"]
    found = entities.canonical(p, links).collect()
    assert len(found) == 4 and len({r.canonical_id for r in found}) == 2 and all(r.canonical_id <= r.id for r in found)
    lost = entities.rejected(spark.createDataFrame(same, "ord long, name string, emails array<string>")).collect()
    assert {r.name for r in lost} == {"no address", "null", "blank"} and all(r.reject_reasons == ["no_address"] for r in lost)
    h = spark.createDataFrame([(k, 7, v) for k, v in (("a", 5), ("b", 5), ("c", 4), ("d", 1 << 40))], "id string, ord long, simhash long")
    pairs = dedup.near_pairs(h, id_col="id")
    assert sorted((r.a, r.b, r.distance) for r in pairs.collect()) == [("a", "b", 0), ("a", "c", 1), ("a", "d", 3), ("c", "d", 2)]
    assert {r.id: r.leader for r in dedup.leaders(h, pairs, id_col="id").collect()} == {"a": None, "b": "a", "c": "a", "d": "a"}
    m = spark.createDataFrame([(1, "x", "t"), (1, "y", "t"), (1, "z", "u")], "ord long, message_id string, body string")
    assert {r.message_id: r.duplicate_of for r in dedup.exact(m, F.col("body")).collect()} == {"x": None, "y": "x", "z": None}


def test_a_common_user_name_makes_no_all_pairs(spark):
    rows = [(i, f"Desk {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", [f"info@d{i}.x"]) for i in range(300)]
    rows += [(1000 + i, "Front Office", [f"info@e{i}.x"]) for i in range(300)]
    p = people(spark, rows)
    links = entities.edges(p).collect()
    assert len(links) == 299  # a star; "desk xy" and "desk zw" share one word of three
    assert entities.username_stars(p).count() == 599
    rng = random.Random(3)
    words = [f"n{i}" for i in range(9)]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 5))), [f"u{i % 2}@d{i}.x"]) for i in range(60)]
    p = people(spark, rows)
    got = {r.ord: r.canonical_id for r in entities.canonical(p, entities.edges(p)).collect()}
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            a, b = set(rows[i][1].split()), set(rows[j][1].split())
            if i % 2 == j % 2 and len(a & b) >= 0.4 * len(a | b) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    ids = {r.ord: r.id for r in p.collect()}
    assert got == {i: ids[root[i]] for i in range(60)}


def test_thread_roots_of_chains_and_circles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "s"), ("b", "zz"), (None, "a")]
    rows += [(f"k{i}", f"k{i - 1}" if i else None) for i in range(40)]
    got = {r.message_id: r.root for r in dedup.thread_roots(spark.createDataFrame(rows, "message_id string, in_reply_to string")).collect()}
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x", "z": "x", "p": "p", "q": "p", "r": "p", "s": "s"} | {f"k{i}": "k0" for i in range(40)}
    assert got == want
    assert dedup.thread_roots(spark.createDataFrame([], "message_id string, in_reply_to string")).count() == 0


def test_directory_identity(spark):
    p = people(spark, [(1, "A", ["a@x", "b@x"]), (2, "B", ["c@x"])])
    table = spark.createDataFrame([("b@x", "E7"), ("a@x", "E1")], "email string, employee string")
    assert {r.ord: r.employee for r in entities.directory(p, table).collect()} == {1: "E1", 2: None}


def claims(spark, rows):
    return spark.createDataFrame([(i, *r, 0.8, "src", "msg", "x", 0) for i, r in enumerate(rows)], "ord long, type string, subject_id string, object_id string, text string, valid_from timestamp_ntz, confidence double, source_id string, message_id string, excerpt string, char_start int")


def test_claims_conflicts_and_supersession(spark):
    import datetime as d

    t = [d.datetime(2003, 1, k) for k in range(1, 9)]
    rows = [("ASSIGNED", "i", "a", "to a", t[0]), ("ASSIGNED", "i", "a", "again", t[1]), ("ASSIGNED", "i", "b", "changed to b", t[2]), ("ASSIGNED", "i", "c", "unchanged? reverted", t[3]), ("ASSIGNED", "j", "a", "x", t[0]), ("ASSIGNED", "j", "b", "reversed", None), ("MENTIONS", "i", "a", "x", t[0]), ("MENTIONS", "i", "b", "changed", t[1])]
    raw = claims(spark, rows)
    merged, found = C.deduplicate(raw)
    by = {(r.type, r.subject_id, r.object_id): r for r in merged.collect()}
    assert by["ASSIGNED", "i", "a"].support_count == 2 and by["ASSIGNED", "i", "a"].text == "to a"
    assert by["ASSIGNED", "i", "a"].valid_to == t[3] and by["ASSIGNED", "i", "b"].valid_to is None
    assert by["ASSIGNED", "j", "a"].valid_to is None
    assert sorted(str(r.resolution) for r in found.collect()) == ["b_wins", "b_wins", "b_wins"]
    assert C.conflict_edges(found).count() == 3
    assert C.evidence(raw, merged).count() == 7  # two rows of one source and start fall together


def test_semantic_groups_follow_the_sequential_rule(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows, wanted = [], {}
    vec = rng.normal(size=(40, 4))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    groups: list[tuple[int, str]] = []
    for i in range(40):
        obj, words = f"o{rng.integers(25)}", "" if i % 9 == 0 else "t"
        rows.append((i, "T", "s", obj, words, [float(x) for x in vec[i]]))
        hit = next((g for g, o in groups if o == obj or (words and rows[g][4] and vec[i] @ vec[g] >= 0.8)), None)
        wanted[i] = i if hit is None else hit
        if hit is None:
            groups.append((i, obj))
    df = spark.createDataFrame(rows, "ord long, type string, subject_id string, object_id string, text string, vector array<double>")
    for head in (2048, 3):
        assert {r.ord: r.leader_ord for r in C.semantic_groups(df, threshold=0.8, head=head).collect()} == wanted
    full = df.withColumns({"confidence": F.lit(0.5), "valid_from": F.lit(None).cast("timestamp_ntz")})
    merged, _ = C.deduplicate(full, threshold=0.8)
    sizes = sorted(list(wanted.values()).count(g) for g in set(wanted.values()))
    assert sorted(r.support_count for r in merged.collect()) == sizes
    pairs = C.semantic_pairs(df.withColumn("k", F.lit("s")), key="k", id_col="ord", vector_col="vector", threshold=0.8)
    assert C.judged(pairs).count() == pairs.count() and C.judged(pairs, F.col("cosine") > 2).count() == 0
    assert C.semantic_groups(df.limit(0)).count() == 0


def test_store(spark):
    e = spark.createDataFrame([(1, "e", "T", "first", None, "m1", 0.1, None), (2, "e", "U", "second", "c", None, 0.9, None)], "ord long, id string, type string, name string, canonical_id string, metadata_json string, confidence double, deleted_at timestamp_ntz")
    got = store.upsert_entities(None, e).first()
    assert (got["type"], got["name"], got.canonical_id, got.metadata_json, got.confidence) == ("T", "first", "c", None, 0.9)
    again = store.upsert_entities(store.upsert_entities(None, e).drop("ord"), e).first()
    assert (again["name"], again.confidence) == ("first", 0.9)
    gone = store.soft_delete(store.upsert_entities(None, e), spark.createDataFrame([("e",)], "id string"), F.lit("2003-01-01").cast("timestamp_ntz"))
    assert store.entities_by_type(gone, "T").count() == 0 and store.entity(gone, "e").count() == 1
    assert store.search_entities(store.upsert_entities(None, e), "F_rS%").count() == 1
    three = store.upsert_messages(None, spark.createDataFrame([(5, "m1", "one"), (9, "m2", "two")], "ord long, message_id string, subject string"))
    for ord_ in (0, 7):
        three = store.upsert_messages(three, spark.createDataFrame([(ord_, "m1", "late"), (ord_, "m3", "three")], "ord long, message_id string, subject string"))
    assert {r.message_id: (r.ord, r.subject) for r in three.collect()} == {"m1": (5, "one"), "m2": (9, "two"), "m3": (0, "three")}
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, x int")
    assert store.append_new(store.append_new(None, new), new).count() == 2


def test_extraction_edges(spark):
    m = spark.createDataFrame([(1, "m1", "s1", "a@x", "", "vote", "", None), (2, "m2", "s2", "b@x", "B", "mod_ssl [VOTE] z", "BZ-1 BZ-1 ASSIGNED BZ-22", None)], "ord long, message_id string, source_id string, from_addr string, from_name string, subject string, body string, ts timestamp_ntz")
    v = {r.message_id: r for r in extract.votes(m).collect()}
    assert not v["m1"].valid and v["m2"].summary == "mod_ssl  z"
    assert [(r.external_id, r.char_start, r.char_end) for r in extract.issues(m).orderBy("i").collect()] == [("BZ-1", 0, 4), ("BZ-1", 5, 9), ("BZ-22", 19, 24)]
    assert [(r.name, r.char_start) for r in extract.mentions(m).collect()] == [("mod_ssl", 0)]
    assert extract.claims(m).count() == 1 + 3 + 1


def test_model_backend_repairs_and_gives_up(spark):
    m = spark.createDataFrame([("a", "x@x", "s", "good"), ("b", "x@x", "s", "once"), ("c", "x@x", "s", "never"), ("d", "x@x", "s", "boom")], "message_id string, from_addr string, subject string, body string")

    def call(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        if "once" in prompt and "not valid" not in prompt:
            return '{"claims": [{"excerpt": "x", "confidence": 7}, {"excerpt": ""}]}'
        if "never" in prompt:
            return "no json"
        return '```json\n{"entities": [], "claims": []}\n```'

    got = {r.message_id: r for r in extract.ask(m, call).collect()}
    assert [got[k].retries for k in "abcd"] == [0, 1, 3, 0]
    assert "ValidationError: 2 errors" in got["b"].errors[0] and "empty span" in got["b"].errors[0]
    flagged = {r.message_id: (r.is_clean, r.grounding_complete) for r in extract.flags(extract.ask(m, call)).collect()}
    assert flagged == {"a": (True, True), "b": (False, True), "c": (False, True), "d": (False, True)}
    assert got["c"].output is None and len(got["c"].errors) == 3 and "down" in got["d"].errors[0]
    with pytest.raises(LookupError):
        extract.backend("nothing")
    extract.register_backend("tiny", lambda model: lambda prompt: model)
    assert extract.backend("tiny-2")("x") == "tiny-2"
    assert one(spark, extract.extraction_version("m")).startswith("m:1.0:") and len(one(spark, extract.prompt_hash("a"))) == 8


def test_candidates_are_rejected_with_reasons(spark):
    out = """{"entities": [{"type": "Decision", "name": "D", "vote_result": "maybe", "excerpt": "x"}, {"type": "Person", "name": "P", "email_addresses": [null, " "], "excerpt": "yy"},
      {"type": "Issue", "external_id": "BZ-1", "confidence": -1}, {"type": "Thing", "label": "L", "excerpt": "long", "char_start": 8, "char_end": 90}],
      "claims": [{"subject_name": "p", "object_name": "L", "text": "t", "excerpt": "zzz", "char_start": -4, "char_end": -9}, {"excerpt": "a", "char_start": 30}]}"""
    rows = spark.createDataFrame([("m", "p@x.y", "S", 10, out), ("n", "", None, 10, '{"entities": [{"type": "Person", "excerpt": "x"}]}')], "message_id string, from_addr string, subject string, text_length int, output string")
    parsed = rows.withColumn("out", extract.parse_output(F.col("output")))
    e = extract.entity_candidates(parsed).where("message_id = 'm'").orderBy("i").collect()
    assert [r.reject_reasons for r in e] == [["vote_result"], [], ["confidence", "empty_span"], []]
    assert e[1].emails == ["p@x.y"] and '"emails":["p@x.y"]' in e[1].metadata_json and (e[3].type, e[3].char_start, e[3].char_end) == ("Concept", 8, 10)
    assert extract.entity_candidates(parsed).where("message_id = 'n'").first().reject_reasons == ["no_address"]
    c = extract.claim_candidates(parsed, extract.typed_entities(parsed)).orderBy("i").collect()
    assert [(r.char_start, r.char_end, r.reject_reasons) for r in c] == [(0, 3, []), (30, 10, ["empty_span"])]
    assert c[0].object_id == e[3].id and c[1].subject_id == "unresolved:"


def test_retrieval_edges(spark):
    import datetime as d

    ts = d.datetime(2003, 1, 1)
    docs = spark.createDataFrame([(f"c{i}/e", f"c{i}", "T", "s", "o", t, 0.9, 1, None, "e", src, f"m{i}", "x", ts) for i, (t, src) in enumerate([("red fox", "A"), ("red dog", "A"), ("red cat", "A"), ("red hen", "A"), ("red owl", "B"), ("blue", "C")])], "doc_id string, id string, type string, subject_id string, object_id string, text string, confidence double, support_count long, valid_to timestamp_ntz, evidence_id string, source_id string, message_id string, excerpt string, ts timestamp_ntz")
    q = spark.createDataFrame([(1, "red red"), (2, "nothing here")], "question_id int, question string")
    top = retrieve.select_top(retrieve.hybrid(retrieve.build_index(docs), q), k=4).orderBy("question_id", "rank").collect()
    assert [r.id for r in top if r.question_id == 1] == ["c0", "c1", "c2", "c4"]  # three of source A at most
    assert [r.id for r in top if r.question_id == 2] == ["c0", "c1", "c2", "c4"]
    empty = retrieve.hybrid(retrieve.build_index(docs.limit(0)), q)
    pack = retrieve.context_packs(q, retrieve.select_top(empty), spark.createDataFrame([], "id string, type string, name string, deleted_at timestamp_ntz"), spark.createDataFrame([], "id string, claim_a_id string, claim_b_id string, resolution string"), spark.createDataFrame([], "id string, text string"))
    assert [r.snippets for r in pack.collect()] == [None, None] and pack.first().ambiguities[0].text == "No indexed evidence."
    assert retrieve.render(pack).where("question_id = 1").first().text.startswith("QUESTION  red red\n\nOPEN QUESTIONS\n* ")
    same = docs.withColumn("text", F.lit("to be or not to be")).limit(1)
    got = {r.token: (r.tf, r.dl) for r in retrieve.build_index(same).postings.collect()}
    assert got == {"to": (2, 7), "be": (2, 7), "or": (1, 7), "not": (1, 7), "x": (1, 7)}
    vectors = spark.createDataFrame([("c5", [1.0, 0.0])], "id string, vector array<double>")
    asked = q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    best = retrieve.select_top(retrieve.hybrid(retrieve.build_index(docs), asked, vectors), k=1)
    assert {r.question_id: r.id for r in best.collect()}[2] == "c5"


def test_cited_messages_are_found_before_a_shuffle(spark):
    top = spark.createDataFrame([(1, 1, "m1", "x"), (1, 2, "m9", "y"), (2, 1, "m1", "z")], "question_id int, rank int, message_id string, excerpt string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    messages = spark.createDataFrame([(f"m{i}", f"s{i}", "f") for i in range(5)], "message_id string, subject string, from_addr string")
    found = retrieve.citations(top, messages)
    assert {(r.question_id, r.number, r.message_id, r.subject) for r in found.collect()} == {(1, 1, "m1", "s1"), (1, 2, "m9", None), (2, 1, "m1", "s1")}
    assert "LeftSemi" in _plan(found)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _documents(spark, rows):
    """(claim, text, source, support) as documents of an index."""
    kind = "doc_id string, id string, type string, subject_id string, object_id string, text string, confidence double, support_count long, valid_to timestamp_ntz, evidence_id string, source_id string, message_id string, excerpt string, ts timestamp_ntz"
    return spark.createDataFrame([(f"{c}/e", c, "T", "s", "o", t, 0.9, n, None, "e", src, f"m{c}", "x", None) for c, t, src, n in rows], kind)


def test_documents_in_parts_shuffle_their_rows_once(spark, monkeypatch):
    from quillgraph import queries
    from quillgraph.plans import scratch
    from quillgraph.sources import views

    sf = "/root/testdata/sf0.001"
    rows = views.claims(spark, sf)
    parts = [views.claims_part(spark, sf, i, 3) for i in range(3)]
    assert sorted(r for p in parts for r in p.collect()) == sorted(rows.collect()) and all(p.count() for p in parts)
    raw = scratch.stored(rows, "rows")
    claims = scratch.sent(scratch.stored(C.deduplicate(raw)[0], "claims"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [retrieve.documents(claims, C.evidence(raw, claims, part=(i, 3))) for i in range(3)]
        assert [_plan(p).count("Exchange hashpartitioning") for p in parts] == [1, 1, 1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    whole = retrieve.documents(claims, C.evidence(raw, claims))
    assert sorted(r.doc_id for p in parts for r in p.collect()) == sorted(r.doc_id for r in whole.collect())
    made = []
    monkeypatch.setattr(queries.retrieve, "build_index", lambda docs: made.extend(docs) or made)
    before = set(scratch._MADE)
    queries._index(spark, sf)
    assert len(made) == queries.PARTS and not [p for p in set(scratch._MADE) - before if "claim-rows" in p]


def test_index_of_parts(spark):
    docs = _documents(spark, [("a", "red red fox", "A", 1), ("b", "red", "B", 1), ("c", "blue", "C", 1)])
    index = retrieve.build_index([docs.where("id = 'a'"), docs.where("id = 'x'"), docs.where("id > 'a'")])
    assert {r.doc_id for r in index.docs.collect()} == {"a/e", "b/e", "c/e"} and index.facts.first().n == 3


def test_rows_are_read_once_for_all_parts(spark):
    from quillgraph.plans import scratch
    from quillgraph.sources import views

    rows = scratch.stored(views.claims(spark, "/root/testdata/sf0.001"), "rows")
    claims = scratch.sent(scratch.stored(C.deduplicate(rows)[0], "claims"))
    dealt = C.evidence_rows(rows, claims, parts=3)
    assert "hashpartitioning" not in _plan(dealt) and "text" not in dealt.columns
    parts = scratch.folders(dealt, "parts", "part", range(4))
    got = [sorted(r.id for r in C.evidence(x, claims).collect()) for _, x in parts]
    assert got[:3] == [sorted(r.id for r in C.evidence(rows, claims, part=(i, 3)).collect()) for i in range(3)] and all(got[:3]) and not got[3]
    assert sorted(C.evidence(rows, claims).collect()) == sorted(r for _, x in parts for r in C.evidence(x, claims).collect())
    scratch.drop(spark, parts[0][0])
    assert parts[1][1].count() and not glob.glob(parts[0][0].removeprefix("file://"))


def test_stored_documents_hold_each_id_once(spark, tmp_path):
    built = retrieve.build_index(_documents(spark, [("a", "red", "A", 1)]), f"file://{tmp_path}/index")
    assert "doc_id" not in spark.read.parquet(f"file://{tmp_path}/index/docs").columns
    for index in (built, retrieve.open_index(spark, f"file://{tmp_path}/index")):
        assert [r.doc_id for r in index.docs.collect()] == ["a/e"]


def test_index_and_scores_shuffle_no_documents(spark):
    index = retrieve.build_index(_documents(spark, [("a", "red red fox", "A", 1), ("b", "red", "B", 1), ("c", "blue", "C", 1)]))
    q = spark.createDataFrame([(1, "red hen"), (2, "nothing")], "question_id int, question string")
    scores = retrieve.bm25(index, q)
    for df in (scores, retrieve.normalised(scores), retrieve.hybrid(index, q)):
        assert "hashpartitioning" not in _plan(df)
    got = {(r.question_id, r.doc_id): r.bm25_norm for r in retrieve.normalised(scores).collect()}
    assert set(got) == {(1, "a/e"), (1, "b/e")} and max(got.values()) <= 1


def test_vectors_meet_documents_before_questions(spark):
    index = retrieve.build_index(_documents(spark, [("a", "red", "A", 1), ("b", "red", "B", 1)]))
    q = spark.createDataFrame([(1, "red", [1.0, 0.0]), (2, "red", None)], "question_id int, question string, vector array<double>")
    found = retrieve.hybrid(index, q, spark.createDataFrame([("b", [0.5, 0.5])], "id string, vector array<double>"))
    assert {(r.question_id, r.id): r.cosine for r in found.collect()} == {(1, "a"): None, (1, "b"): 0.5, (2, "a"): None, (2, "b"): None}
    assert "hashpartitioning(question_id" not in _plan(found)


def test_few_vectors_are_sent_to_documents(spark):
    from quillgraph.plans import scratch

    index = retrieve.build_index(_documents(spark, [("a", "red", "A", 1), ("b", "red", "B", 1)]))
    q = spark.createDataFrame([(1, "red", [1.0, 0.0])], "question_id int, question string, vector array<double>")
    vectors = spark.createDataFrame([("b", [0.5, 0.5]), ("c", None)], "id string, vector array<double>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(id" not in _plan(retrieve.hybrid(index, q, vectors))
        for most, shuffled in ((1000, False), (10, True)):
            assert ("hashpartitioning(id" in _plan(index.docs.join(scratch.sent(vectors, most), "id"))) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("head", [2, 5, 50])
def test_top_when_one_source_fills_the_head(spark, monkeypatch, head):
    monkeypatch.setattr(retrieve, "HEAD", head)
    rows = [(f"c{i:02}", "red", "A" if i < 12 else f"S{i % 3}", 40 - i) for i in range(20)]
    index = retrieve.build_index(_documents(spark, rows))
    q = spark.createDataFrame([(1, "red"), (2, "blue")], "question_id int, question string")
    top = retrieve.select_top(retrieve.hybrid(index, q), index.docs, k=6).orderBy("question_id", "rank").collect()
    assert [r.id for r in top] == ["c00", "c01", "c02", "c12", "c13", "c14"] * 2 and [r.rank for r in top] == [*range(1, 7)] * 2


def test_near_pairs_send_no_exploded_rows(spark):
    h = spark.createDataFrame([("a", 1, 0), ("b", 2, 7), ("c", 3, -1)], "id string, ord long, simhash long")
    pairs = dedup.near_pairs(h, id_col="id")
    assert "SortMergeJoin [choice" in _plan(pairs)
    assert [(r.a, r.b, r.distance) for r in pairs.collect()] == [("a", "b", 3)]


def test_word_in_all_names_compares_nobody(spark, monkeypatch):
    rows = [(i, f"Customer {i}", [f"c{i}@x", "team@x"]) for i in range(300)]
    p = entities.persons(spark.createDataFrame(rows, "ord int, name string, emails array<string>"))
    monkeypatch.setattr(entities.text, "jaccard", lambda a, b: F.when(a != b, F.raise_error(F.lit("compared")).cast("double")).otherwise(1.0))
    assert entities.similar_names(p).count() == 0 and entities.edges(p).count() == 299


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(4)
    names = [" ".join(rng.sample(["ann", "bo", "cy", "di", "ed", "flo", "gus"], rng.randint(1, 6))) for _ in range(60)]
    p = entities.persons(spark.createDataFrame([(i, n, [f"info@h{i}"]) for i, n in enumerate(names)], "ord int, name string, emails array<string>"))
    ids = {r.ord: r.id for r in p.collect()}
    sets = [frozenset(n.split()) for n in names]
    first = {s: sets.index(s) for s in sets}
    for least in (0.3, 0.4, 0.5, 0.9):
        wanted = {(i, j) for i in first.values() for j in first.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
        wanted |= {(first[s], i) for i, s in enumerate(sets) if first[s] != i}
        assert {(r.a, r.b) for r in entities.similar_names(p, least=least).collect()} == {(ids[i], ids[j]) for i, j in wanted}


def test_semantic_pairs_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 3)
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.uniform(-1, 1) for _ in range(4)] if i % 9 else None) for i in range(40)] + [(50, 0, [1.0, 1.0]), (51, 0, [1.0, 1.0]), (52, 0, [1.0, None]), (53, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, k int, v array<float>")
    kept = [(r.id, r.k, [None if x is None else float(x) for x in r.v]) for r in df.where("v is not null and k is not null").collect()]
    wanted = {}
    for i, k, v in kept:
        for j, m, w in kept:
            if k == m and i < j and len(v) == len(w) and None not in v + w and (c := sum((x * y for x, y in zip(v, w)), 0.0)) >= 0.2:
                wanted[i, j] = round(c, 12)
    got = C.semantic_pairs(df, key="k", id_col="id", vector_col="v", threshold=0.2).collect()
    assert len(got) == len(wanted) and {(r.a, r.b): round(r.cosine, 12) for r in got} == wanted
    assert C.semantic_pairs(df.limit(0), key="k", id_col="id", vector_col="v", threshold=0.2).count() == 0


def test_parts_of_evidence_make_the_index_of_all(spark, tmp_path, monkeypatch):
    from quillgraph.plans import scratch
    from quillgraph.sources import views

    sf = "/root/testdata/sf0.001"
    raw = scratch.stored(views.claims(spark, sf), "rows")
    ranges = views.claims_ranges(spark, sf, 3)
    assert sorted(r for p in ranges for r in p.collect()) == sorted(raw.collect()) and all(p.count() for p in ranges)
    merged = C.merge(raw)
    assert sorted(C.merge_parts(C.merge(ranges[0]).union(C.merge(ranges[1])).union(C.merge(ranges[2]))).collect()) == sorted(merged.collect())
    claims = scratch.stored(C.supersede(merged, C.conflicts(merged)), "claims")
    # ids of few letters, so that many come in several parts; and some claims without a text
    monkeypatch.setattr(C.ids, "evidence_id", lambda *x: F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", *x), 256), 1, 3)))
    claims = claims.withColumn("text", F.when(F.col("ord") % 5 > 0, F.col("text")).otherwise(""))
    want = retrieve.build_index(retrieve.documents(claims, C.evidence(raw, claims)))
    for at, (most, beside) in enumerate(((8 << 20, True), (10, False))):
        monkeypatch.setattr(retrieve, "small", lambda df, most=most: scratch.small(df, most))
        monkeypatch.setattr(retrieve, "AT_ONCE", 1000)
        path = f"{tmp_path}/{at}"
        got = retrieve.build_index(retrieve.Parts(claims, [C.evidence(p, claims) for p in ranges]), f"file://{path}")
        assert bool(glob.glob(f"{path}/claims")) == beside == ("text" not in spark.read.parquet(f"file://{path}/docs").columns)
        assert spark.read.parquet(f"file://{path}/docs").count() > want.docs.count() > 0
        for index in (got, retrieve.open_index(spark, f"file://{path}")):
            assert sorted(map(str, index.docs.select(want.docs.columns).collect())) == sorted(map(str, want.docs.collect()))
            assert {(r.n, r.most, round(r.avgdl, 9)) for r in index.facts.collect()} == {(r.n, r.most, round(r.avgdl, 9)) for r in want.facts.collect()}
            assert {r.token: round(r.idf, 9) for r in index.idf.collect()} == {r.token: round(r.idf, 9) for r in want.idf.collect()}


def test_rows_of_claims_are_never_kept(spark, monkeypatch):
    from quillgraph import queries
    from quillgraph.plans import scratch

    before = set(scratch._MADE)
    index = queries._index(spark, "/root/testdata/sf0.001")[2]
    assert not [p for p in set(scratch._MADE) - before if "rows" in p or "merged-parts" in p]
    plan = _plan(retrieve.hybrid(index, queries.questions(spark)))
    assert "hashpartitioning" not in plan


def test_tokens_are_counted_in_parts(spark, monkeypatch):
    docs = _documents(spark, [(f"c{i}", f"red number {i} and {i // 2}", "A", 1) for i in range(12)])
    want = {r.token: round(r.idf, 9) for r in retrieve.build_index(docs).idf.collect()}
    made, appended = {}, retrieve.appended

    def recorded(parts, path):
        each = list(parts)
        made[path.split("/")[-1]] = len(each)
        return appended(each, path)

    monkeypatch.setattr(retrieve, "appended", recorded)
    monkeypatch.setattr(retrieve, "AT_ONCE", 5)
    index = retrieve.build_index([docs.where(F.col("id") == f"c{i}") for i in range(12)])
    assert made["counts"] == 3 and made["raw"] > 1
    assert {r.token: round(r.idf, 9) for r in index.idf.collect()} == want and len(want) > 12


def test_stored_sources_lie_together(spark):
    from quillgraph import queries
    from quillgraph.plans import scratch

    before = set(scratch._MADE)
    queries._index(spark, "/root/testdata/sf0.01")
    (path,) = [p for p in set(scratch._MADE) - before if "retrieval-index" in p]
    parts = glob.glob(f"{path.removeprefix('file://')}/docs/*")
    assert len(parts) == queries.PARTS and all(1 <= len(glob.glob(f"{p}/*.parquet")) <= 2 for p in parts)
