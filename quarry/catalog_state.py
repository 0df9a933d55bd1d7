"""Registered queries of streams, the committed index, many roots, whole searches and first errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import _ALL_HITS, _asked, query
from .operators import documents, graph, index, retrieval, validation
from .schemas import SCHEMAS
from .sources import snapshots
from .sources.scratch import scratch
from .streaming import events, folds, replay

# --- streams: run over all that is there, from files as they lie ---


def _event_stream(w):
    """The events as a stream of files."""
    return w.spark.readStream.schema(w.events.schema).parquet(f"{w.sf_dir}/events.parquet*")


_LAST = "max_by({}, event_id) FILTER (event_id % 4 = 3)"


@query(f"""SELECT u AS stream_id, (SELECT string_agg(concat(event_type, '=', n), ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events e WHERE e.user_id::VARCHAR = u AND event_id % 4 <> 3 GROUP BY event_type)) AS tools,
 tokens_in, tokens_out, cost_usd, session_id FROM (SELECT user_id::VARCHAR AS u, {_LAST.format('event_id % 1000 + 1')} AS tokens_in, {_LAST.format('event_id % 77')} AS tokens_out, {_LAST.format('(event_id % 9)::DOUBLE')} AS cost_usd, {_LAST.format("concat('s', event_id)")} AS session_id FROM events GROUP BY 1)""")
def str4_live_fold(w):
    """Tool counts and last result of each user's lines, by the stateful stream."""
    def rows():
        k, i = F.col("event_id"), "event_id"
        result = F.format_string('{"type":"result","total_cost_usd":%d.0,"session_id":"s%d","model":"m","usage":{"input_tokens":%d,"output_tokens":%d,"cache_read_input_tokens":1}}', k % 9, i, k % 1000, k % 77)
        line = F.when(k % 4 == 3, result).otherwise(F.format_string('{"type":"tool_use","tool":{"name":"%s"}}', "event_type"))
        lines = _event_stream(w).select(F.col("user_id").alias("stream"), F.col(i).alias("seq"), F.col("ts").alias("at"), line.alias("line"))
        return folds.live_fold(folds.fold_rows(events.parse_lines(lines), "stream", "seq", "at"), "60 days", 86_400_000)

    out = folds.replayed(w.spark, rows, "stream_id", folds.FOLD, "live-fold")
    tools = F.array_join(F.transform(F.array_sort(F.map_entries("tools")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("stream_id", F.nullif(tools, F.lit("")).alias("tools"), "tokens_in", "tokens_out", "cost_usd", "session_id")


@query("SELECT user_id::VARCHAR AS entity_id, max_by(event_type, id) AS state, min(created_at) AS started_at, min(created_at) FILTER (event_type IN ('purchase', 'logout')) AS completed_at FROM log GROUP BY 1")
def str11_live_states(w):
    """Last state, first start and first end of each user, by the stateful stream."""
    def rows():
        at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        changes = _event_stream(w).select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), at.alias("at"))
        return folds.live_states(changes, (), ("purchase", "logout"), "60 days", 86_400_000)

    return folds.replayed(w.spark, rows, "entity_id", folds.STATES, "live-states").drop("final")


@query("SELECT event_id AS id, user_id FROM events WHERE event_id > 50")
def str14_once(w):
    """Two readers behind cursors whose pages overlap; every event is kept once."""
    def reader(cursor: int):
        log = replay.event_log(w.spark, f"{w.sf_dir}/events.parquet", "event_id long, user_id long, ts timestamp", cursor, id="event_id", page=20_000)
        return log.withWatermark("ts", "60 days")

    out, check = scratch(w.spark, "once"), scratch(w.spark, "once-checkpoint")
    kept = reader(50).unionByName(reader(400)).dropDuplicatesWithinWatermark(["event_id"])
    kept.writeStream.option("checkpointLocation", check).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return w.spark.read.parquet(out).select(F.col("event_id").alias("id"), "user_id")


# --- the committed index ---

_SOURCE = "concat(source, '/', lang, doc_id % 7, '.md')"


@query(f"""SELECT concat('c', doc_id) AS id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS body, concat(CASE WHEN bool_or(doc_id % 5 = 0) OVER (PARTITION BY {_SOURCE}) THEN 'h2-' ELSE 'h1-' END, {_SOURCE}) AS hash FROM documents
 WHERE NOT ({_SOURCE} LIKE '%3.md' AND doc_id % 5 <> 0)""")
def ix14_committed(w):
    """All chunks committed; then a fifth of them again, with the hashes of their files, and the chunks of some files gone."""
    ix = snapshots.Index(w.spark, scratch(w.spark, "index"), 2, buckets=16)

    def chunks(rows, body: str):
        given = {"id": F.concat(F.lit("c"), "doc_id"), "file_path": F.expr(_SOURCE), "body": F.lit(body), "embedding": F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float"))}
        return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["chunks"].fields])

    def hashes(rows, tag: str):
        return rows.select(F.expr(_SOURCE).alias("path")).distinct().withColumn("hash", F.concat(F.lit(tag), "path"))

    fifth = w.documents.where("doc_id % 5 = 0")
    ix.upsert(chunks(w.documents, "old"), hashes(w.documents, "h1-"))
    gone = w.documents.select(F.expr(_SOURCE).alias("path")).where("path like '%3.md'").distinct()
    ix.upsert(chunks(fifth, "new"), hashes(fifth, "h2-"), stale=gone)
    return ix.chunks().join(ix.hashes(), F.col("file_path") == F.col("path")).select("id", "body", "hash")


_CALLED = "list_transform(CASE WHEN next_name IS NULL THEN [] ELSE [next_name] END, lambda n: concat(n, CASE WHEN coalesce(next_package, '') <> '' THEN concat(' (', next_package, ')') ELSE '' END))"


@query(f"""SELECT file_path, sha256(concat('=== RELATIONSHIP CONTEXT ===', chr(10), string_agg(concat('Function: ', name, chr(10), '  Calls: ', array_to_string({_CALLED}, ', '), chr(10), chr(10)), '' ORDER BY line_start, id))) AS block FROM chunks WHERE next_name IS NOT NULL GROUP BY file_path""")
def ix12_relations(w):
    return index.relations(w.refs).select("file_path", F.sha2("block", 256).alias("block"))


# --- graph: all functions and methods as roots ---


@query("""WITH RECURSIVE hop AS (SELECT target_id AS a, source_id AS b, max(confidence) AS confidence FROM edges WHERE confidence >= 0.7 AND edge_type = 'CALLS' GROUP BY 1, 2),
 asked AS (SELECT DISTINCT first AS root_id FROM (SELECT min(id) OVER (PARTITION BY name) AS first, kind FROM symbols) WHERE kind IN ('function', 'method')),
 walk AS (SELECT a AS root_id, b AS id, 1 AS depth, confidence, b AS path FROM hop JOIN asked ON root_id = a
 UNION ALL SELECT root_id, b, depth + 1, hop.confidence, concat(path, '>', b) FROM walk JOIN hop ON hop.a = walk.id WHERE depth < 2 AND NOT contains(path, b) AND b <> root_id AND b NOT IN (SELECT id FROM boundaries)),
 best AS (SELECT root_id, id, min(depth) AS depth, arg_min(confidence, (depth, -confidence)) AS confidence FROM walk WHERE id IN (SELECT id FROM symbols) GROUP BY 1, 2)
 SELECT root_id, id, depth::BIGINT AS depth, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth, confidence DESC, id) k FROM best) WHERE k <= 10""")
def gr6_all_roots(w):
    """What calls each function and method, asked by name as structural context does."""
    files = w.symbols.select(F.col("file_path").alias("path")).distinct()
    roots = graph.known_file_roots(w.symbols, files, by="name").select("root_id")
    return graph.blast(w.symbols, w.edges, w.boundaries, roots, True, graph.BlastOptions(2, 10, 0.7, ("CALLS",))).select("root_id", "id", "depth", "confidence")


# --- searches ---


@query(f"""{_ALL_HITS}, t AS (SELECT query // 200 AS request, concat('c', id) AS id, query, d, rank FROM h WHERE rank <= 10),
 m AS (SELECT request, id, count(*) AS n, max(1 - d) AS best FROM t WHERE request % 3 <> 1 GROUP BY 1, 2),
 direct AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY n DESC, best DESC, id) AS rank FROM m QUALIFY rank <= 12),
 r AS (SELECT direct.request, direct.rank, c.next_name AS name FROM direct JOIN chunks c USING (id)),
 s AS (SELECT r.request, c.id, min(r.rank) AS seen FROM r JOIN chunks c ON c.name = r.name WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.request = r.request AND x.id = c.id) GROUP BY 1, 2),
 k AS (SELECT request, count(*) AS k FROM direct GROUP BY 1),
 hop AS (SELECT s.*, row_number() OVER (PARTITION BY request ORDER BY seen, id) AS hop_rank FROM s)
 SELECT request, id, rank AS ord, false AS is_dependency_hop, n AS query_hit_count, round(best, 4) AS score FROM direct
 UNION ALL SELECT request, id, hop_rank + k, true, 0, 0.0 FROM hop JOIN k USING (request) WHERE hop_rank <= 20 - k
 UNION ALL SELECT request, id, rank, false, 0, round(1 - d, 4) FROM t WHERE request % 3 = 1 AND query % 200 = 0""")
def vs5_search(w):
    """Two vectors make a request, of which every third has failed and gets the hits of its first vector."""
    hits = retrieval.joined_top_k(w.embeddings, _asked(w), 10, "vec_id")
    hits = hits.select(F.floor(F.col("query") / 200).alias("request"), "query", F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "distance", "rank")
    requests = _asked(w).select(F.floor(F.col("query") / 200).alias("request")).distinct().withColumn("failed", F.col("request") % 3 == 1)
    return retrieval.search(hits, hits.where("query % 200 = 0"), requests, w.refs.select("id", "name", "calls", "called_by"), most=20)


@query("SELECT id, printf('[Score: %.2f] %s — %s (lines %d-%d)%s  %s%s  %s', (line_start % 100) / 100.0, file_path, name, line_start, line_start + 5, chr(10), language, chr(10), chunk_type) AS block FROM chunks")
def vs8_rendered(w):
    """Results as text."""
    at = F.col("line_start")
    return retrieval.rendered(w.chunks.select("id", "file_path", "name", "line_start", (at + 5).alias("line_end"), ((at % 100) / 100).alias("score"), F.col("language").alias("description"), F.col("chunk_type").alias("signature")))


# --- first errors ---


def _unless(n: int, broken, fine) -> Column:
    k = F.col("p_partkey")
    return F.when(k % n == 0, broken).otherwise(fine)


@query("""SELECT order_id, rule FROM (SELECT p_partkey AS order_id, CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 4 WHEN p_partkey % 17 = 0 THEN 5 WHEN p_partkey % 23 = 0 THEN 12 WHEN p_partkey % 29 = 0 THEN 17 WHEN p_partkey % 5 = 0 THEN 10
 WHEN p_partkey % 3 = 0 THEN 13 WHEN p_partkey % 2 = 0 THEN 18 ELSE 0 END AS rule FROM part) WHERE rule > 0""")
def val1_first_errors(w):
    """Orders of two criteria: what breaks in the first one comes before what breaks in the second, whatever its rule."""
    one = F.struct(F.lit("c1").alias("id"), _unless(23, "", "d").alias("description"), F.lit(True).alias("required"), F.lit("manual").alias("kind"), F.lit("").alias("check"), _unless(29, F.array(F.lit("zz")), F.array(F.lit("r1"))).alias("requirement_ids"))
    two = F.struct(_unless(5, " ", "c2").alias("id"), F.lit("d").alias("description"), _unless(3, F.lit(None).cast("boolean"), F.lit(True)).alias("required"), F.lit("manual").alias("kind"), F.lit("").alias("check"), _unless(2, F.array(F.lit("r1")), F.array(F.lit("r2"))).alias("requirement_ids"))
    orders = w.part.select(
        F.col("p_partkey").alias("order_id"), _unless(11, "", "t").alias("title"), F.lit("m").alias("target_module"), F.lit("docs").alias("type"), _unless(17, 1, 2).alias("schema_version"), _unless(7, F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("a"))).alias("known_files"),
        F.array(*[F.struct(F.lit(r).alias("id")) for r in ("r1", "r2")]).alias("requirements"), F.array(one, two).alias("criteria"),
    )
    return validation.first_order_errors(orders).select("order_id", "rule")


@query("""SELECT plan_id, rule FROM (SELECT p_partkey AS plan_id, CASE WHEN p_partkey % 31 = 0 THEN 1 WHEN p_partkey % 13 = 0 THEN 4 WHEN p_partkey % 19 = 0 THEN 7 WHEN p_partkey % 17 = 0 THEN 10 WHEN p_partkey % 23 = 0 THEN 14 WHEN p_partkey % 11 = 0 THEN 18 WHEN p_partkey % 7 = 0 THEN 19
 WHEN p_partkey % 29 = 0 THEN 21 WHEN p_partkey % 5 = 0 THEN 20 WHEN p_partkey % 3 = 0 THEN 23 WHEN p_partkey % 2 = 0 THEN 25 ELSE 0 END AS rule FROM part) WHERE rule > 0""")
def val3_first_errors(w):
    """Documents of two epics with a task each, made to break one rule or several by the remainders of their number."""
    s = F.lit

    def task(ref: Column, id_: str, epic: Column, title, req: Column, deps: Column) -> Column:
        criterion = F.struct(s("c").alias("id"), s("d").alias("description"), s(True).alias("required"), s("manual").alias("kind"), s("").alias("check"), F.array(req["id"]).alias("requirement_ids"))
        return F.struct(s(id_).alias("id"), ref.alias("task_ref"), epic.alias("epic_id"), deps.alias("depends_on"), title.alias("title"), s("m").alias("target_module"), s("docs").alias("type"), s(2).alias("schema_version"), F.array(s("a")).alias("known_files"), F.array(req).alias("requirements"), F.array(criterion).alias("criteria"))

    req = lambda id_, text: F.struct((s(id_) if isinstance(id_, str) else id_).alias("id"), (s(text) if isinstance(text, str) else text).alias("text"))
    first = task(s("t"), "t1", _unless(11, "e9", "e1"), _unless(7, "", "x"), req("r1", _unless(29, "other", "one")), F.array().cast("array<string>"))
    second = task(_unless(17, " t ", "u"), "t2", s("e2"), s("y"), req(_unless(5, "r9", "r2"), ""), _unless(2, F.array(s("t2")), F.array(s("t1"))))

    def epic(id_: str, ref, covers, deps, held) -> Column:
        return F.struct(s(id_).alias("id"), ref.alias("epic_ref"), s("x").alias("title"), s("y").alias("description"), F.array(covers).alias("covers"), deps.alias("depends_on_epics"), F.array(held).alias("tasks"))

    epics = F.array(epic("e1", s("a"), _unless(23, "q", "r1"), F.array().cast("array<string>"), first), epic("e2", _unless(19, "a ", "b"), s("r2"), _unless(3, F.array(s("e2")), F.array(s("e1"))), second))
    plans = w.part.select(F.col("p_partkey").alias("plan_id"), _unless(31, 2, 1).alias("version"), F.array(req("r1", "one"), req(_unless(13, "r1", "r2"), "two")).alias("requirements"), epics.alias("epics"))
    return validation.first_document_errors(plans).select("plan_id", "rule")


@query("""WITH RECURSIVE t AS (SELECT p_partkey % 97 AS plan_id, concat('t', p_partkey) AS task_id, p_partkey AS ord, lower(trim(concat(' T', p_partkey % 1500))) AS title, p_partkey % 10 AS n, p_size % 14 AS c, concat('f', p_partkey % 700) AS f, concat('t', CASE WHEN p_partkey % 61 = 0 THEN p_partkey ELSE greatest(p_partkey - 97, 0) END) AS dep, p_partkey <= 97 AS head FROM part),
 e AS (SELECT plan_id, task_id, ord, CASE WHEN ord > min(ord) OVER (PARTITION BY plan_id, title) THEN 3 WHEN n > 8 AND ord % 3 = 0 THEN 4 WHEN c > 12 AND ord % 4 = 0 THEN 5 WHEN ord % 61 = 0 AND NOT head THEN 6 WHEN ord > min(ord) OVER (PARTITION BY plan_id, f) THEN 7 ELSE 0 END AS rule FROM t)
 SELECT plan_id, arg_min(task_id, ord) AS task_id, arg_min(rule, ord) AS rule FROM e WHERE rule > 0 GROUP BY plan_id
 UNION ALL SELECT p.plan_id, 'r2', 8 FROM (SELECT DISTINCT plan_id FROM t) p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.plan_id = p.plan_id AND rule > 0) AND p.plan_id % 2 = 0""")
def val4_first_errors(w):
    """The first task of each plan that breaks a rule of business; else, of every second plan, a requirement without task."""
    k = F.col("p_partkey")
    many = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("f"), (k % 700).cast("string"), F.lit("/"), i.cast("string")))
    files = F.when((k % 10 > 8) & (k % 3 == 0), many(F.lit(9))).otherwise(many(F.lit(2)))
    crits = F.when((F.col("p_size") % 14 > 12) & (k % 4 == 0), F.array_repeat(F.lit("c"), 13)).otherwise(F.array(F.lit("c")))
    dep = F.concat(F.lit("t"), F.when(k % 61 == 0, k).otherwise(k - 97).cast("string"))
    tasks = w.part.select((k % 97).alias("plan_id"), F.concat(F.lit("t"), k).alias("task_id"), F.concat(F.lit(" T"), k % 1500).alias("title"), files.alias("known_files"), crits.alias("criteria"), F.array(F.lit("r1")).alias("requirements"), F.when(k <= 97, F.array().cast("array<string>")).otherwise(F.array(dep)).alias("depends_on"), k.alias("ord"))
    plans = w.part.select((k % 97).alias("plan_id")).distinct()
    needs = plans.select("plan_id", F.lit("r1").alias("requirement"), F.lit(1).alias("ord")).unionByName(plans.where("plan_id % 2 = 0").select("plan_id", F.lit("r2").alias("requirement"), F.lit(2).alias("ord")))
    return documents.first_plan_errors(needs, tasks).select("plan_id", "task_id", "rule")
