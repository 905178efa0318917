"""The sample archive through the whole engine, versions of tables, and streams."""

import json
import re

from pyspark.sql import functions as F

from quillgraph.operators import store
from quillgraph.plans import pipeline, scratch
from quillgraph.sources import config, mbox, sample
from quillgraph.streaming import activity, ingest


def graph(spark, tmp_path):
    mbox.write_mbox(sample.messages(spark), f"file://{tmp_path}/in")
    (tmp_path / "o.json").write_text(json.dumps(sample.OVERRIDES))
    return pipeline.build(spark, mbox.read_mbox(spark, f"file://{tmp_path}/in"), config.overrides(spark, f"file://{tmp_path}/o.json"))


TABLES = ("entities", "claims", "evidence", "messages", "merge_log", "conflicts")


def test_sample_archive(spark, tmp_path):
    g = graph(spark, tmp_path)
    m = {r.message_id[6:8]: r for r in g["messages"].collect()}
    assert len(m) == 11
    copies = {k: r.duplicate_of[6:8] for k, r in m.items() if r.duplicate_of}
    assert copies == {"c2": "a1", "c3": "a1"}  # sent twice, lightly edited
    assert m["b4"].thread_id == "<ride-b3@cycle.example>" and str(m["a2"].ts) == "2011-05-02 18:40:00" and m["a1"].from_name == ""
    assert m["c3"].ts is None and not m["c3"].date_ok and m["a2"].quoted_ids == ["<ride-a1@cycle.example>"] and m["d2"].body.endswith("From noon on I can help.")
    kinds = {r["type"]: r["count"] for r in g["entities"].groupBy("type").count().collect()}
    assert kinds == {"Person": 7, "Decision": 3, "Issue": 3, "Component": 3}
    assert g["entities"].where("type = 'Person'").select("canonical_id").distinct().count() == 5
    assert sorted(r.reason for r in g["merge_log"].collect()) == ["manual_override", "username_name_cluster"]
    by = {r["type"]: r["count"] for r in g["claims"].groupBy("type").count().collect()}
    assert by == {"DECIDED": 2, "SUPPORTS": 2, "OPPOSES": 1, "ASSIGNED": 3, "MENTIONS": 3}
    assert g["claims"].where("support_count = 2").first().type == "ASSIGNED"  # BZ-77 twice in one mail
    assert g["evidence"].count() == 12 and g["conflicts"].count() == 1 and g["evidence"].where("char_end <= char_start or extraction_version not like 'rules:%'").count() == 0
    assert json.loads(g["entities"].where("type = 'Decision'").orderBy("id").first().metadata_json).keys() == {"vote_result", "participants", "thread_subject", "supersedes_id"}
    row = store.stats(*[g[k] for k in TABLES]).first()
    assert tuple(row) == (16, 11, 0, 12, 11, 2, 1)
    q = spark.createDataFrame([(1, "Who supports short tile addresses?"), (2, "a/b? " + "x" * 50)], "question_id int, question string")
    packs = pipeline.answer(g, q)
    pack = packs.where("question_id = 1").first()
    assert 0 < len(pack.snippets) <= 10 and [c.number for c in pack.citations] == list(range(1, len(pack.citations) + 1))
    names = config.export_packs(packs, f"file://{tmp_path}/out")
    assert names[0] == "Who_supports_short_tile_addresses.json" and json.loads((tmp_path / "out" / names[0]).read_text())["snippets"][0]["claim_text"]
    config.export_graph(f"file://{tmp_path}/tables", **{k: g[k] for k in TABLES})
    assert spark.read.json(f"file://{tmp_path}/tables/claims").count() == 11


def test_a_model_in_place_of_the_rules(spark, tmp_path):
    def call(prompt):
        subject = re.search("Subject: (.*)", prompt)[1]
        if "Picnic" in subject:
            return "no idea"
        both = [{"type": "Person", "name": "Ida B", "email_addresses": ["ida.brandt@cycle.example"], "excerpt": "Subject"}, {"type": "Component", "name": "Tile  Server" if "vote" in subject else "tile server", "excerpt": "Subject"}]
        return json.dumps({"entities": both, "claims": [{"type": "MENTIONS", "subject_name": "ida b", "object_name": both[1]["name"], "text": subject, "excerpt": subject, "char_start": 9, "char_end": 9 + len(subject)}]})

    mbox.write_mbox(sample.messages(spark), f"file://{tmp_path}/in")
    g = pipeline.build(spark, mbox.read_mbox(spark, f"file://{tmp_path}/in"), None, call, model="tiny")
    run = g["runs"].first()
    assert (run.model, run.message_count, run.error_count) == ("tiny", 9, 6)
    ev = g["evidence"].join(g["messages"].select("message_id", "subject"), "message_id").collect()
    assert len(ev) == 7 and all(r.excerpt == r.subject and r.char_start == 9 and r.char_end == 9 + len(r.subject) and r.extraction_version.startswith("tiny:") for r in ev)
    parts = g["entities"].where("type = 'Component'").collect()
    assert len(parts) == 2 and len({r.canonical_id for r in parts}) == 1
    assert g["entities"].where("type = 'Person'").first().metadata_json.startswith('{"emails":["ida.brandt@cycle.example"]')
    again = pipeline.build(spark, mbox.read_mbox(spark, f"file://{tmp_path}/in"), None, call, model="tiny", done=g["evidence"])
    assert again["runs"].first().message_count == 2 and again["claims"].count() == 0  # those that gave nothing are asked again


def test_command_line(spark, tmp_path, capsys):
    def run(*more):
        pipeline.main(["--sample", "--db", f"file://{tmp_path}/db", *more])

    run("--question", "Who supports short tile addresses?", "--export", f"file://{tmp_path}/out")
    assert "QUESTION  Who supports" in capsys.readouterr().out
    whole = json.loads((tmp_path / "out" / "graph.json").read_text())
    assert sorted(whole) == ["claims", "conflicts", "entities", "evidence", "merge_log"] and len(whole["claims"]) == 11
    assert (tmp_path / "out" / "Who_supports_short_tile_addresses.json").exists()
    run("--dry-run", "--model", "none")  # a second run adds nothing new
    v = config.Versions(spark, f"file://{tmp_path}/db")
    assert [v.read(t).count() for t in ("messages", "claims", "evidence", "entities", "conflicts", "runs")] == [11, 11, 12, 16, 1, 1]
    assert not any(r.ord is None for r in v.read("claims").collect())


def test_readers_agree_however_files_are_split(spark, tmp_path):
    mbox.register(spark)
    rows = [(f"<m{i}@x.y>", "Zoë" if i % 3 else "", f"u{i % 4}@X.y", f"s {i}", f"line {i}\nFrom here\n>From there {'é' * (i * 7 % 90)}\n\nend") for i in range(200)]
    df = spark.createDataFrame(rows, "message_id string, from_name string, from_addr string, subject string, body_raw string")
    mbox.write_mbox(df.repartition(2), f"file://{tmp_path}/in")
    (tmp_path / "in" / "zz").write_bytes(b"prelude\nFrom a\r\nSubject: =?utf-8?q?dos=20caf=C3=A9?=\r\nDate: never\r\n\r\nbody\r\nFrom b\r\n\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        b = mbox.read_mbox(spark, f"file://{tmp_path}/in/*")
        assert b.rdd.getNumPartitions() > 20
        many = b.orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    local = spark.read.format("mbox").option("splitBytes", "700").load(f"{tmp_path}/in/[pz]*").orderBy("ord").collect()
    strip = lambda found: [tuple(r)[1:] for r in found]
    assert strip(many) == strip(local) and len({r.ord for r in many}) == len({r.ord for r in local}) == 202
    assert {(r.message_id, r.from_name, r.from_addr, r.subject, r.body_raw) for r in many[:200]} == {(i, n, a.lower(), s, t) for i, n, a, s, t in rows}
    assert many[200].subject == "dos café" and many[200].body_raw == "body" and many[200].ts is None and not many[200].date_ok
    assert many[201].message_id.startswith("<unknown-") and many[201].body_raw == ""


def test_splitting_is_linear():
    import io
    import time

    one = b"From x\nSubject: s\n\n" + b"text " * 200 + b"\n\n"

    def seconds(n):
        began = time.time()
        assert sum(1 for _ in mbox.messages_in(io.BytesIO(one * n), 0, 1 << 60)) == n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4000), 0.01)


def test_versions_are_atomic(spark, tmp_path):
    v = config.Versions(spark, f"file://{tmp_path}/db")
    assert v.read("t") is None
    v.commit(t=spark.range(3))
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    try:
        v.commit(t=bad)
    except Exception as e:
        assert "no" in str(e)
    assert v.read("t").count() == 3
    assert config.pack_file_name("What? a/b " + "x" * 50) == ("What_a_b_" + "x" * 30) + ".json"
    config.export_json(spark, f"file://{tmp_path}/g.json", entities=spark.createDataFrame([("a", None), ("b", "2003")], "id string, deleted_at string"), claims=spark.createDataFrame([("d",), ("c",)], "id string"))
    out = json.loads((tmp_path / "g.json").read_text())
    assert [e["id"] for e in out["entities"]] == ["a"] and out["claims"] == [{"id": "c"}, {"id": "d"}]
    v.commit(u=spark.range(2))
    v.commit(t=spark.range(5))
    (tmp_path / "db" / "new-pointer").write_text("half a poin")  # what a crash leaves
    assert config.Versions(spark, f"file://{tmp_path}/db").read("t").count() == 5 and v.read("u").count() == 2
    v.prune(keep=1)
    assert v.read("t").count() == 5 and v.read("u").count() == 2 and len([x for x in (tmp_path / "db").iterdir() if x.is_dir()]) == 2


def test_scratch_tables_are_released(spark, tmp_path):
    df = scratch.stored(spark.range(3), "some")
    at = df.inputFiles()[0].removeprefix("file:").split("/some-")[0]
    assert df.count() == 3 and scratch.release(spark) > 0
    import os

    assert not [x for x in os.listdir(at.replace("//", "/")) if x.startswith("some-")]


def test_stream_flags_copies_like_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"m{i}", f"body {i % 3}") for i in range(9)], "ord long, message_id string, body_raw string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.keyed_by_content(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = ingest.flag_copies(stream).writeStream.format("memory").queryName("flags").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.message_id: r.duplicate_of for r in spark.table("flags").collect()} == {f"m{i}": None if i < 3 else f"m{i % 3}" for i in range(9)}
    within = ingest.distinct_within(stream.withColumn("ts", F.timestamp_seconds("ord")), "1 hour").writeStream.format("memory").queryName("within").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    within.awaitTermination()
    assert spark.table("within").count() == 3
    v = config.Versions(spark, f"file://{tmp_path}/db")
    ingest.upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), v, "messages", store.upsert_messages, f"{tmp_path}/c2").awaitTermination()
    assert v.read("messages").count() == 9


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    q = activity.tumbling(stream, "1 hour", "2 hours").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r.start), r.event_type, r.n) for r in spark.table("hours").collect())
    assert got == sorted((str(r.start), r.event_type, r.n) for r in activity.tumbling(events, "1 hour").collect())
    assert activity.sliding(events, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert activity.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()
