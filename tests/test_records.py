import pytest
from pyspark.sql import functions as F

from stratalens.model import as_of
from stratalens.operators import governance, history, identity, integrity, jobs
from stratalens.sources.store import VersionedStore, corrupt_blobs, put_blobs
from stratalens.sources.tables import table
from stratalens.streaming import feedback

from .conftest import SF

STATES = "memory_id long, space_id string, document_key string, revision_id string, lifecycle string, valid_from long, valid_to long"


@pytest.fixture
def states(spark):
    return spark.createDataFrame([(1, "a", "k1", "r1", "active", 1, None), (2, "a", "k2", "r2", "active", 2, None)], STATES)


def test_changes_close_and_open_intervals(states):
    h = history.apply_batch(states, [("move", 1, "b"), ("retire", 2)], 5)
    now = {r.memory_id: r for r in h.where("valid_to is null").collect()}
    assert now[1].space_id == "b" and now[2].lifecycle == "retired" and now[1].valid_from == 5
    assert {r.memory_id: r.space_id for r in as_of(h, 4).collect()} == {1: "a", 2: "a"} and h.count() == 4


def test_heads_are_compared(states):
    with pytest.raises(history.Conflict):
        history.revise(states, 1, "other", "r9", 6)
    h = history.revise(states, 1, "r1", "r9", 6)
    assert as_of(h, 6).where("memory_id = 1").first().revision_id == "r9"
    with pytest.raises(history.Conflict):
        history.revise(history.retire(states, 1, 5), 1, "r1", "r9", 6)


def test_creation_is_idempotent_and_keys_unique(states):
    row = {"memory_id": 3, "space_id": "a", "document_key": "k3", "revision_id": "r3", "lifecycle": "active"}
    h = history.create(states, row, 7)
    assert h.count() == 3 and history.create(h, row, 8).count() == 3
    with pytest.raises(history.Conflict):
        history.create(h, row | {"memory_id": 4}, 8)
    assert history.merge_parents(["y", "x"], None, {"x": 1, "y": 1}) == ["x", "y"]
    for bad in (["x"], ["x", "x"], ["x", "z"]):
        with pytest.raises(history.Conflict):
            history.merge_parents(bad, None, {"x": 1, "y": 1, "z": 2})


def test_integrity_finds_cycles_of_any_length_and_clean_is_clean(spark, states):
    for n in (1, 2, 3, 5):
        ring = [(f"c{i}", f"c{(i + 1) % n}") for i in range(n)] + [("d", "e")]
        assert {r[0] for r in integrity.in_cycles(spark.createDataFrame(ring, "revision_id string, parent_id string")).collect()} == {f"c{i}" for i in range(n)}
    spaces = spark.createDataFrame([("a", 1)], "space_id string, created long")
    space_states = spark.createDataFrame([("a", "key", "active", 1, None)], "space_id string, space_key string, lifecycle string, valid_from long, valid_to long")
    memories = spark.createDataFrame([(1, 1), (2, 2)], "memory_id long, created long")
    revisions = spark.createDataFrame([("r1", 1, "b1", 1), ("r2", 2, "b2", 2)], "revision_id string, memory_id long, blob string, generation long")
    none = spark.createDataFrame([], "revision_id string, parent_id string")
    blobs = spark.createDataFrame([("b1",), ("b2",)], "blob string")
    check = lambda **x: {r.code for r in integrity.check(**({"spaces": spaces, "space_states": space_states, "memories": memories, "memory_states": states, "revisions": revisions, "parents": none, "blobs": blobs, "generation": 9} | x)).collect()}
    assert check() == set()
    assert check(blobs=blobs.limit(1)) == {"SOURCE_BLOB_MISSING"}
    assert "DOCUMENT_KEY_DUPLICATE" in check(memory_states=states.withColumn("document_key", F.lit("k")))
    assert "STATE_GENERATION" in check(generation=1)


def test_store_pins_verifies_and_backs_up(spark, states, tmp_path):
    st = VersionedStore(spark, f"file://{tmp_path}/store")
    assert st.newest() == 0
    st.publish({"states": states}, expected=0)
    st.publish({"other": states.limit(1)})
    assert st.newest() == 2 and st.read("states").count() == 2 and st.read("states", 1).count() == 2
    with pytest.raises(ValueError):
        st.publish({"states": states}, expected=1)
    assert st.replace_space("states", states.withColumn("space_id", F.lit("b")), "b") == 3 and st.read("states").count() == 4 and st.read("states", 2).count() == 2
    assert st.verify() == []
    st.backup(f"file://{tmp_path}/copy")
    assert VersionedStore(spark, f"file://{tmp_path}/copy").read("states").count() == 4
    st.export_json("states", f"file://{tmp_path}/json", ["a"])
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_blobs(spark):
    docs = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    first = put_blobs(spark.createDataFrame([], "blob string"), docs)
    assert first.count() == 2 and put_blobs(first, docs).count() == 0 and corrupt_blobs(first).count() == 0
    assert corrupt_blobs(first.withColumn("content", F.lit("z"))).count() == 2


def test_stream_restarts_where_it_ended(spark, tmp_path):
    events = table(spark, SF, "events")
    source = f"{tmp_path}/in"
    events.where("event_id % 2 = 0").write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).parquet(source)
    paths = [f"{tmp_path}/{x}" for x in ("log", "state", "cp")]
    feedback.append_to_log(stream(), *paths)
    half = spark.read.parquet(paths[0]).count()
    feedback.append_to_log(stream(), *paths)
    assert spark.read.parquet(paths[0]).count() == half
    events.where("event_id % 2 = 1 or event_id < 20").write.mode("append").parquet(source)
    feedback.append_to_log(stream(), *paths)
    from stratalens.operators.adaptive import familiarity
    from stratalens.sources.tables import feedback_of

    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if "=" in p.name)
    got = spark.read.parquet(f"{paths[1]}/batch={last}").orderBy("space_id", "memory_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in familiarity(feedback_of(events)).orderBy("space_id", "memory_id").collect()]


def test_policies_tools_and_jobs(spark):
    assert not governance.allows("deny", False) and governance.allows("local-only", False) and not governance.allows("local-only", True)
    assert identity.permitted("query", {"read"}) and not identity.permitted("query", {"write"}) and not identity.permitted("unknown", {"read", "write"})
    rows = spark.createDataFrame([(1, "h1", "running"), (2, "h2", "running")], "memory_id long, input_hash string, state string")
    heads = spark.createDataFrame([(1, "h1"), (2, "other")], "memory_id long, input_hash string")
    assert {r.memory_id: r.state for r in jobs.superseded(rows, heads).collect()} == {1: "running", 2: "superseded"}
    assert jobs.reopened(rows).where("state = 'queued'").count() == 2
    found = governance.discover_entities(spark.createDataFrame([("a", "Ann", "person:1"), ("b", "Ann", "person:2")], "space_id string, surface string, entity_ref string"), "Ann", ["a"])
    assert [r[0] for r in found.collect()] == ["person:1"]


def test_merges_need_the_head_among_their_parents(spark, states):
    revisions = spark.createDataFrame([("r0", 1), ("r1", 1), ("r2", 2)], "revision_id string, memory_id long")
    none = spark.createDataFrame([], "revision_id string, parent_id string")
    h, edges = history.merge(states, none, revisions, 1, ["r1", "r0"], "r9", 7)
    assert as_of(h, 7).where("memory_id = 1").first().revision_id == "r9" and as_of(h, 6).where("memory_id = 1").first().revision_id == "r1"
    assert sorted(map(tuple, edges.collect())) == [("r9", "r0"), ("r9", "r1")]
    for memory, merged in ((2, ["r1", "r0"]), (1, ["r0", "r2"]), (1, ["r0", "r0"])):
        with pytest.raises(history.Conflict):
            history.merge(states, none, revisions, memory, merged, "r9", 7)


def test_packages_are_found_whole_or_refused(spark, tmp_path):
    from stratalens.sources import package
    from stratalens.sources.tables import serving_records

    path, records = f"file://{tmp_path}/p", serving_records(spark, SF)
    package.write_package(records, path, ["de"])
    assert package.read_package(spark, path).count() == records.where("space_id = 'de'").count()
    records.where("space_id = 'fr'").limit(1).write.mode("append").json(f"{path}/records")
    with pytest.raises(package.PackageError):
        package.read_package(spark, path)
