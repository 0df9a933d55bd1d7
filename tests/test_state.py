"""Stateful streams against their batch folds over split and restarted input, replay-safe delivery, and the committed index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.schemas import SCHEMAS
from quarry.sources import snapshots
from quarry.streaming import events, folds, replay

LINE = "stream string, seq long, at string, line string"


def lines(n=400):
    rng, out = random.Random(5), []
    for k in range(n):
        kind = rng.choice(["tool_use", "tool_use", "assistant", "result", "bad"])
        record = {"type": kind}
        if kind == "tool_use":
            record["tool"] = {"name": rng.choice(["Read", "Edit", "Bash"]), "input": "{}"}
        if kind == "result":
            record |= {"session_id": f"s{k}", "total_cost_usd": k / 8, "model": rng.choice(["m1", "m2"]), "usage": {"input_tokens": k, "output_tokens": 2 * k, "cache_read_input_tokens": 3}}
        out.append((rng.choice("abcdef"), k, f"2026-01-01 00:{k // 60:02d}:{k % 60:02d}", "{oops" if kind == "bad" else json.dumps(record)))
    return out


def put(spark, rows, path, name, schema=LINE):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def with_rocksdb(spark):
    return spark.conf.get(folds._PROVIDER_KEY), spark.conf.set(folds._PROVIDER_KEY, folds.PROVIDER)


def plain(rows, key):
    return {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k not in (key, "final")} for r in rows}


def parsed(df):
    return folds.fold_rows(events.parse_lines(df), "stream", "seq", "at")


@pytest.mark.parametrize("seed", [1, 2])
def test_live_fold_is_the_batch_fold(spark, tmp_path, seed):
    """Lines dealt to micro-batches at random, out of order; the query stops in between and goes on from its checkpoint."""
    rng, rows = random.Random(seed), lines()
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    shuffled = rng.sample(rows, len(rows))
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    files = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    before, _ = with_rocksdb(spark)
    try:
        for part in (files[:3], files[3:]):
            for f in part:
                put(spark, f, source, f"f{id(f)}")
            stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
            folds.to_tables(folds.live_fold(parsed(stream), "1 day", 86_400_000), check, out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(folds._PROVIDER_KEY, before)
    got = folds.latest(spark, out, "stream_id", folds.FOLD)
    want = folds.batch_fold(parsed(spark.createDataFrame(rows, LINE)))
    assert plain(got.collect(), "stream_id") == plain(want.collect(), "stream_id")
    assert spark.read.option("basePath", out).parquet(out).select("batch").distinct().count() >= 5  # as many batches with rows
    one = next(r for r in want.collect() if r["stream_id"] == "a")
    used = [json.loads(x)["tool"]["name"] for s, _, _, x in rows if s == "a" and '"tool_use"' in x]
    last = json.loads([x for s, _, _, x in rows if s == "a" and '"result"' in x][-1])
    assert one["tools"] == {t: used.count(t) for t in set(used)}
    assert (one["tokens_in"], one["tokens_out"], one["session_id"], one["cost_usd"]) == (last["usage"]["input_tokens"] + 3, last["usage"]["output_tokens"], last["session_id"], last["total_cost_usd"])


def test_idle_streams_are_emitted_and_cleared(spark, tmp_path):
    """Once the watermark has passed a stream's last line by the idle time, its fold comes once more as final; then it begins anew."""
    tool = json.dumps({"type": "tool_use", "tool": {"name": "Read"}})
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [[("a", 1, "2026-01-01 00:00:00", tool), ("b", 1, "2026-01-01 00:00:00", tool)], [("b", 2, "2026-01-01 05:00:00", tool)], [("b", 3, "2026-01-01 05:00:01", tool)], [("a", 9, "2026-01-01 06:00:00", tool)]]
    before, _ = with_rocksdb(spark)
    try:
        for k, rows in enumerate(batches):
            put(spark, rows, source, f"f{k}")
            stream = spark.readStream.schema(LINE).parquet(f"{source}/*")
            folds.to_tables(folds.live_fold(parsed(stream), "1 minute", 3_600_000), check, out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(folds._PROVIDER_KEY, before)
    rows = [(r["stream_id"], r["tools"]["Read"], r["final"]) for r in spark.read.option("basePath", out).parquet(out).orderBy("batch").collect()]
    a = [r[1:] for r in rows if r[0] == "a"]
    assert a == [(1, False), (1, True), (1, False)]  # counted from one again
    b = [r[1:] for r in rows if r[0] == "b"]
    assert b[-1] == (2, False) and (1, True) in b or b[-1] == (3, False)


def test_states_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), k, rng.choice(["running", "paused", "failed", "completed", "pending"]), f"2026-01-01 00:{k // 60:02d}:{k % 60:02d}") for k in range(150)]
    schema = "entity_id string, seq long, state string, at string"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    shuffled = rng.sample(rows, len(rows))
    before, _ = with_rocksdb(spark)
    try:
        for k in range(0, 150, 50):
            put(spark, shuffled[k : k + 50], source, f"f{k}", schema)
            stream = spark.readStream.schema(schema).parquet(f"{source}/*")
            folds.to_tables(folds.live_states(stream, delay="1 day", idle_ms=10**9), check, out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(folds._PROVIDER_KEY, before)
    got = {r["entity_id"]: (r["state"], r["started_at"], r["completed_at"]) for r in folds.latest(spark, out, "entity_id", folds.STATES).collect()}
    for e in "xyz":
        own = [r for r in rows if r[0] == e]
        assert got[e] == (own[-1][2], own[0][3], next(r[3] for r in own if r[2] in ("completed", "failed")))


# --- delivery ---

EVENT = "id long, workflow_id string, at timestamp, payload string"


def log(spark, rows, path, mode="append"):
    df = spark.createDataFrame(rows, "id long, workflow_id string, at string, payload string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.mode(mode).parquet(path)


def event(k):
    return (k, f"w{k % 3}", f"2026-01-01 00:{k // 60:02d}:{k % 60:02d}", f"p{k}")


def test_cursor_pages_and_restart(spark, tmp_path):
    """Events behind the cursor, of one workflow, once each and in order, over restarts; a page is a task."""
    path, check, seen = str(tmp_path / "log"), str(tmp_path / "check"), []

    def run():
        stream = replay.event_log(spark, path, EVENT, cursor=10, key="workflow_id", value="w1", page=7, pages=2)
        took = []
        q = stream.writeStream.option("checkpointLocation", check).foreachBatch(lambda df, n: took.append([r["id"] for r in df.collect()])).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append([b for b in took if b])

    log(spark, [event(k) for k in range(1, 121)], path)
    run()
    log(spark, [event(k) for k in range(121, 200)], path)
    while seen[-1]:  # a run takes what its first look at the log bounds
        run()
    ids = [i for batches in seen for b in batches for i in b]
    assert ids == [k for k in range(11, 200) if k % 3 == 1] and len(seen) > 3
    assert seen[0][0] == [k for k in range(11, 121) if k % 3 == 1][: len(seen[0][0])]
    reader = replay._Pages(SCHEMAS["events"], {"path": path, "page": "7", "pages": "2"})
    reader.initialOffset()
    assert reader.latestOffset() == {"id": 14}  # two pages
    pages = reader.partitions({"id": 0}, {"id": 16})
    assert [(p.after, p.upto) for p in pages] == [(0, 7), (7, 14), (14, 16)] and reader.partitions({"id": 199}, {"id": 199}) == []


def test_delivered_twice_kept_once(spark, tmp_path):
    """Two sources that overlap, and a file that repeats events, over a restart: every id comes once."""
    path, again, out, check = (str(tmp_path / n) for n in ("log", "again", "out", "check"))

    def run():
        both = [replay.event_log(spark, p, EVENT, cursor=c, page=9).withWatermark("at", "1 hour") for p, c in ((path, 0), (path, 30), (again, 0))]
        stream = both[0].unionByName(both[1]).unionByName(both[2]).dropDuplicatesWithinWatermark(["id"])
        stream.writeStream.option("checkpointLocation", check).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()

    log(spark, [event(k) for k in range(1, 80)], path)
    log(spark, [event(k) for k in range(20, 40)], again)
    run()
    log(spark, [event(k) for k in range(80, 130)], path)
    log(spark, [event(k) for k in (*range(60, 70), *range(41, 50))], again)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(1, 130))
    once = replay.once(spark.createDataFrame([(1, "2026-01-01 00:00:00")] * 3, "id long, at string").withColumn("at", F.col("at").cast("timestamp")), "id", "at")
    assert once.schema.names == ["id", "at"]
    assert replay.envelopes(spark.createDataFrame([(7, "{}")], "id long, payload string")).first()["message"] == "id: 7\ndata: {}\n\n"


# --- the committed index ---


def chunk(spark, rows):
    """``id, file_path, body, embedding`` as chunks."""
    df = spark.createDataFrame(rows, "id string, file_path string, body string, embedding array<float>")
    have = {"id", "file_path", "body", "embedding"}
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["chunks"].fields])


def hashes(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string")


def state(ix, number=None):
    return {(r["id"], r["body"]) for r in ix.chunks(number).collect()}, {(r["path"], r["hash"]) for r in ix.hashes(number).collect()}


def test_versions_of_the_index(spark, tmp_path):
    ix = snapshots.Index(spark, str(tmp_path), 2, buckets=4)
    assert state(ix) == (set(), set()) and ix.versions() == []
    first = [(f"c{k}", f"f{k % 7}.go", "old", [1.0, 2.0]) for k in range(21)]
    ix.upsert(chunk(spark, first), hashes(spark, [(f"f{k}.go", "h1") for k in range(7)]))
    old = state(ix)
    assert old == ({(r[0], "old") for r in first}, {(f"f{k}.go", "h1") for k in range(7)})
    v = ix.upsert(chunk(spark, [("c0", "f0.go", "new", [0.0, 0.0]), ("n1", "f9.go", "new", [0.0, 0.0]), ("n1", "f9.go", "new", [0.0, 0.0])]), hashes(spark, [("f0.go", "h2"), ("f9.go", "h2")]))
    want = ({(r[0], "old") for r in first if r[0] != "c0"} | {("c0", "new"), ("n1", "new")}, {(f"f{k}.go", "h1") for k in range(1, 7)} | {("f0.go", "h2"), ("f9.go", "h2")})
    assert v.number == 2 and state(ix) == want and state(ix, 1) == old
    shared_folders = set(ix.version(1).chunks.values()) & set(v.chunks.values())
    assert shared_folders  # buckets without a change are not written again
    ix.purge(spark.createDataFrame([("f1.go",), ("nowhere",)], "path string"))
    assert state(ix) == ({c for c in want[0] if c[0] not in ("c1", "c8", "c15")}, {h for h in want[1] if h[0] != "f1.go"})
    now = state(ix)
    assert ix.vacuum(keep=1) == [1, 2] and ix.versions() == [3] and state(ix) == now
    with pytest.raises(ValueError, match="no version 1"):
        ix.chunks(1)
    assert ix.hashes(force=True).count() == 0
    other = snapshots.Index(spark, str(tmp_path), 3, "2", buckets=4)  # another layout: no hash holds, and the next upsert begins anew
    assert other.hashes().count() == 0
    other.upsert(chunk(spark, [("z", "z.go", "x", [1.0, 2.0, 3.0])]), hashes(spark, [("z.go", "h")]))
    assert state(other) == ({("z", "x")}, {("z.go", "h")})
    other.drop_and_recreate()
    assert state(other) == (set(), set())


def test_faults_leave_the_old_version(spark, tmp_path, monkeypatch):
    """A wrong vector, a fault between chunks and hashes, one before the manifest: chunks and hashes stay as they were."""
    ix = snapshots.Index(spark, str(tmp_path), 2, buckets=4)
    ix.upsert(chunk(spark, [("a", "f.go", "old", [1.0, 2.0])]), hashes(spark, [("f.go", "h1")]))
    old = state(ix)
    for bad in ([1.0], [1.0, 2.0, 3.0], None):
        with pytest.raises(Exception, match="numbers in its vector, not 2"):
            ix.upsert(chunk(spark, [("b", "g.go", "x", bad)]), hashes(spark, [("g.go", "h")]))
    new = chunk(spark, [("a", "f.go", "new", [1.0, 2.0])]), hashes(spark, [("f.go", "h2")])

    def fail(*_):
        raise OSError("lost")

    for step in ("write_hashes", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(ix, step, fail)
            with pytest.raises(OSError):
                ix.upsert(*new)
        assert state(ix) == old and ix.versions() == [1]
    known = ix.hashes()
    assert known.join(new[1], ["path", "hash"]).count() == 0  # the file counts as changed, and is taken up again
    with monkeypatch.context() as m:  # another writer commits while this one works
        m.setattr(ix, "write_hashes", lambda h, p: (snapshots.Index(spark, str(tmp_path), 2, buckets=4).upsert(*new), snapshots.Index.write_hashes(ix, h, p))[1])
        with pytest.raises(snapshots.Conflict):
            ix.upsert(chunk(spark, [("q", "q.go", "x", [0.0, 0.0])]), hashes(spark, [("q.go", "h")]))
    assert state(ix) == ({("a", "new")}, {("f.go", "h2")}) and ix.versions() == [1, 2]


def test_listing_of_yaml_files(spark, tmp_path):
    from quarry.sources import io

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text("title: Do it\ntype: docs\n")
    (tmp_path / "b.YML").write_text("title: [broken")
    (tmp_path / "c.txt").write_text("title: no")
    (tmp_path / "sub" / "d.yaml").write_text("title: below")
    got = {r["filename"]: r for r in io.yaml_listing(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.yaml", "b.YML"} and got["a.yaml"]["size_bytes"] == 24 and got["a.yaml"]["title"] == "Do it" and got["a.yaml"]["target_module"] is None
    assert got["b.YML"]["title"] is None and got["a.yaml"]["mod_time"].endswith("Z") and len(got["a.yaml"]["mod_time"]) == 20
    assert io.yaml_listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_key_takes_three_calls_to_the_state():
    """Counts, last result and timer are one value: read, written, and one timer set; the later result stays."""
    import pandas as pd

    calls = []

    class Fake:
        value = None

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name == "update":
                    Fake.value = a[0]
                return Fake.value if name == "get" else Fake.value is not None

            return call

    class Handle(Fake):
        def getValueState(self, *a):
            return Fake()

    fold = folds.StreamFold(1000)
    fold.init(Handle())
    rows = [(5, 1, "tool_use", "a", 0), (6, 2, "result", "", 7), (7, 3, "tool_use", "a", 0), (8, 4, "result", "", 9)]
    names = ["at_ms", "seq", "type", "tool", "tokens_in"]
    frame = pd.DataFrame(rows, columns=names).assign(tokens_out=1, model="m", cost_usd=0.5, session_id="s")
    (out,) = fold.handleInputRows(("k",), iter([frame]), None)
    assert calls == ["get", "registerTimer", "update"]
    (out,) = fold.handleInputRows(("k",), iter([frame.head(3)]), None)
    assert out.iloc[0].tolist() == ["k", {"a": 4}, 9, 1, "m", 0.5, "s", False] and calls[3:] == ["get", "update"]
