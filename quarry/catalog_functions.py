"""Registered queries of functions, nested documents, lookups, sources and answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import query
from .functions import scalar as fn
from .operators import documents, graph, index, responses, retrieval, validation, warehouse
from .schemas import SCHEMAS
from .sources import io
from .sources.scratch import scratch
from .streaming import events

def number() -> Column:
    return F.col("p_partkey")


def by(n: int, *values) -> Column:
    """One of ``values`` by the part's number modulo ``n``; the last one for all further remainders."""
    out = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        out = F.when(number() % n == k, v).otherwise(out)
    return out


# --- functions of text ---


@query("SELECT id, epoch(created_at::TIMESTAMP)::BIGINT AS at, epoch((replace(created_at, ' ', 'T') || '+02:00')::TIMESTAMPTZ)::BIGINT AS east FROM runs")
def fn5_times(w):
    east = F.concat(F.regexp_replace("created_at", " ", "T"), F.lit("+02:00"))
    return w.runs.select("id", F.unix_timestamp(fn.timestamp(F.col("created_at"))).alias("at"), F.unix_timestamp(fn.timestamp(east)).alias("east"))


@query("SELECT id FROM runs WHERE created_at >= '1998-05-03T00:00:00Z'")
def fil5_range(w):
    """The last 90 days of a fixed day."""
    return warehouse.optional(w.runs, warehouse.parse_range("90d", datetime(1998, 8, 1))).select("id")


@query("SELECT doc_id, CASE WHEN strlen(text) > 50 THEN concat(left(text, list_max(list_filter(range(0, 51), lambda k: strlen(left(text, k)) <= 50))), '...') ELSE text END AS cut FROM documents")
def fn8_truncated(w):
    return w.documents.select("doc_id", fn.truncate_bytes(F.col("text"), 50, "...").alias("cut"))


@query("SELECT p_partkey, CASE WHEN length(s) <= 14 THEN s ELSE rtrim(CASE WHEN contains(left(s, 14), '-') THEN regexp_replace(left(s, 14), '-[^-]*$', '') ELSE left(s, 14) END, '-') END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_name, ': ', p_partkey, '!')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def fn9_slugs(w):
    return w.part.select("p_partkey", fn.slug(F.concat(F.lit(" "), "p_name", F.lit(": "), number(), F.lit("!")), 14).alias("slug"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE p_brand END AS title FROM part")
def fn10_titles(w):
    """Quoted, plain after an empty one, empty and missing titles."""
    text = by(4, F.concat(F.lit('a: 1\ntitle: "'), "p_name", F.lit('"\n')), F.concat(F.lit("title:\n  title: "), "p_name"), F.lit("title: ''"), F.lit(None).cast("string"))
    return w.part.select("p_partkey", fn.title_of(text, F.col("p_brand")).alias("title"))


@query("SELECT p_partkey, p_name AS text FROM part")
def fn11_unfenced(w):
    """With a fence and a language, with a fence, without one."""
    text = by(3, F.concat(F.lit("```json\n"), "p_name", F.lit("\n```")), F.concat(F.lit(" ```\n"), "p_name", F.lit("\n``` ")), F.col("p_name"))
    return w.part.select("p_partkey", fn.strip_code_fence(text).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('{', p_name, '} and {', p_brand, '}') WHEN 1 THEN NULL ELSE concat('{', p_name, '}') END AS span FROM part")
def fn12_outermost(w):
    text = by(3, F.concat(F.lit("so: {"), "p_name", F.lit("} and {"), "p_brand", F.lit("} end")), F.concat(F.lit("} "), "p_name", F.lit(" {")), F.concat(F.lit("{"), "p_name", F.lit("}")))
    return w.part.select("p_partkey", fn.outermost(text).alias("span"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '|', p_brand) WHEN 1 THEN p_name WHEN 2 THEN NULL ELSE concat('[', p_name) END AS list FROM part")
def fn14_lists(w):
    """A JSON list, a text, none, and a list that is broken, which is a text."""
    text = by(4, F.to_json(F.array("p_name", "p_brand")), F.col("p_name"), F.lit(" "), F.concat(F.lit("["), "p_name"))
    return w.part.select("p_partkey", F.array_join(fn.list_or_single(text), "|").alias("list"))


@query("SELECT p_partkey, CASE WHEN strlen(s) > 12 THEN concat(left(s, 12), '...') ELSE s END AS summary FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END AS s FROM part)")
def fn16_tool_summaries(w):
    held = by(3, F.to_json(F.struct(F.col("p_brand").alias("url"), F.col("p_name").alias("command"))), F.to_json(F.struct(F.col("p_brand").alias("pattern"))), F.lit('{"other":"x"}'))
    return w.part.select("p_partkey", fn.tool_summary(held, 12).alias("summary"))


@query("SELECT id, (post_audit_work_order_count - pre_audit_work_order_count)::BIGINT AS delta, (coalesce(pre_audit_work_order_count, 0) + coalesce(post_audit_work_order_count, 0) + coalesce(work_orders_generated, 0))::BIGINT AS tokens FROM plans")
def fn18_deltas(w):
    """Also the sum of input and cached tokens, where any may be missing."""
    a, b, c = (F.col(x) for x in ("pre_audit_work_order_count", "post_audit_work_order_count", "work_orders_generated"))
    return w.plans.select("id", fn.delta(b, a).alias("delta"), fn.effective_input(a, b, c).alias("tokens"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'unmet' ELSE 'unassessable' END AS kind FROM part")
def fn22_result_kinds(w):
    return w.part.select("p_partkey", fn.result_kind(by(4, " MET", "Unmet ", "unassessable", F.col("p_name"))).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('src/', p_brand, ' b/', p_partkey, '.go') ELSE concat('src/', p_partkey, '.go') END AS path FROM part")
def fn25_diff_paths(w):
    name = by(3, F.concat(F.lit("src/"), "p_brand", F.lit(" b/"), number(), F.lit(".go")), F.concat(F.lit("src/"), number(), F.lit(".go")))
    return w.part.select("p_partkey", fn.diff_path(F.concat(F.lit("diff --git a/old/"), number(), F.lit(".go b/"), name)).alias("path"))


@query("SELECT id, concat('go:', coalesce(package, ''), ':', kind, ':', name) AS symbol_id, CASE WHEN ends_with(file_path, '.go') THEN 'go' ELSE '' END AS language FROM symbols")
def fn27_symbol_ids(w):
    """Also the language of each symbol's file."""
    return w.symbols.select("id", fn.symbol_id(F.lit("go"), F.col("package"), F.col("kind"), F.col("name")).alias("symbol_id"), fn.language_of(F.col("file_path")).alias("language"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'markdown' WHEN 2 THEN 'tsx' WHEN 3 THEN 'python' ELSE '' END AS language FROM part")
def fn28_languages(w):
    ext = by(6, ".go", ".md", ".tsx", ".py", ".GO", "")
    return w.part.select("p_partkey", fn.language_of(F.concat(F.lit("src.ts/f"), number(), ext)).alias("language"))


# --- nested documents ---

_TASKS = "(SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber) - 1 AS task_ord, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2) - 1 AS epic_ord, concat('e', l_linenumber % 2) AS epic, concat('t', l_linenumber) AS task, l_partkey FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey))"


def _items(w):
    return w.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


def _plans(w):
    """Orders as plans of two epics at most, line items as their tasks."""
    task = F.struct(F.concat(F.lit("t"), "l_linenumber").alias("id"), F.concat(F.lit("Title "), "l_partkey").alias("title"), F.array(F.concat(F.lit("f"), "l_partkey")).alias("known_files"), F.array(F.lit("r1")).alias("requirements"), F.lit("a").alias("change"))
    rows = _items(w).groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("e")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", task.alias("task")))).alias("tasks"))
    epic = F.struct(F.concat(F.lit("e"), "e").alias("id"), F.transform("tasks", lambda t: t["task"]).alias("tasks"))
    return rows.groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.array_sort(F.collect_list(epic)).alias("epics"))


@query(f"SELECT plan_id, epic_ord, task_ord, epic, task FROM {_TASKS}")
def ns1_flat_tasks(w):
    return documents.flat_tasks(_plans(w)).select("plan_id", "epic_ord", "task_ord", "epic", F.col("task.id").alias("task"))


@query(f"SELECT plan_id, epic, concat('Title ', l_partkey) AS title FROM {_TASKS} WHERE task = 't3'")
def ns2_one_task(w):
    return documents.one_task(documents.flat_tasks(_plans(w)), "t3").select("plan_id", "epic", F.col("task.title").alias("title"))


@query(f"SELECT plan_id * 10 + epic_ord AS epic_ord, any_value(epic) AS epic, CASE WHEN plan_id % 3 = 0 THEN '' ELSE string_agg(task, ',' ORDER BY task_ord) END AS tasks FROM {_TASKS} GROUP BY plan_id, epic_ord")
def ns3_assembled(w):
    """Epics of every third plan have no answer."""
    flat = documents.flat_tasks(_plans(w)).withColumn("epic_ord", F.col("plan_id") * 10 + F.col("epic_ord"))
    out = documents.assembled(flat.select("epic_ord", "epic").distinct(), flat.where("plan_id % 3 <> 0").select("epic_ord", "task_ord", F.col("task.id").alias("task")))
    return out.select("epic_ord", "epic", F.array_join("tasks", ",").alias("tasks"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE NULL END AS audit_source FROM part")
def ns4_audited(w):
    return documents.tagged_by_audit(w.part.select("p_partkey", by(4, "added", "modified", "unchanged", F.lit(None).cast("string")).alias("change"))).select("p_partkey", "audit_source")


@query("SELECT p_partkey, 1 AS version, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'before' END AS audit_source FROM part")
def ns4_audited_plans(w):
    """Whole responses of an audit; what it left as it was keeps its source."""
    task = F.struct(F.lit("t").alias("id"), F.lit("before").alias("audit_source"), by(4, "added", "modified", "unchanged", F.lit(None).cast("string")).alias("audit_action"))
    plans = w.part.select("p_partkey", by(3, 0, 1, F.lit(None).cast("int")).alias("version"), F.array(F.struct(F.lit("e").alias("id"), F.array(task).alias("tasks"))).alias("epics"))
    return documents.audited_plans(plans).select("p_partkey", "version", F.col("epics")[0]["tasks"][0]["audit_source"].alias("audit_source"))


@query("SELECT p_partkey, concat(p_name, '|', p_brand) AS texts, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_name, '|', p_brand) END AS firsts FROM part")
def ns5_descriptions(w):
    """Descriptions of typed criteria, and the first targets of a list."""
    crits = F.array(*[F.struct(F.lit("c").alias("id"), F.col(c).alias("description")) for c in ("p_name", "p_brand")])
    return w.part.select("p_partkey", F.array_join(documents.descriptions(crits), "|").alias("texts"), F.array_join(documents.first_targets(F.array("p_name", "p_brand"), by(2, 1, 5)), "|").alias("firsts"))


@query("SELECT id, next_name AS function, file_path AS file FROM chunks WHERE next_name IS NOT NULL")
def ns6_code_refs(w):
    refs = F.transform("calls", lambda c: F.struct(c["name"].alias("name"), F.col("file_path").alias("file")))
    return w.refs.select("id", F.inline(retrieval.code_refs(refs))).where("function is not null")


@query("SELECT p_partkey, 3 AS n, concat('P', p_partkey) AS last FROM part")
def ns7_path_nodes(w):
    nodes = graph.path_nodes(F.concat(F.lit("go:A>go:B>P"), number()))
    return w.part.select("p_partkey", F.size(nodes).alias("n"), F.element_at(nodes, -1).alias("last"))


@query(f"SELECT plan_id, task AS id, epic AS epic_id, concat('Title ', l_partkey) AS title, concat('f', l_partkey) AS files FROM {_TASKS}")
def prj5_work_orders(w):
    o = documents.work_orders(documents.flat_tasks(_plans(w)))
    return o.select("plan_id", "work_order.id", "work_order.epic_id", "work_order.title", F.array_join("work_order.known_files", ",").alias("files"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'w' WHEN p_partkey % 3 = 0 THEN 's' ELSE p_brand END AS value FROM part")
def val8_overrides(w):
    config = w.part.select("p_partkey", by(2, "w", "").alias("workflow_value"), by(3, "s", F.lit(None).cast("string")).alias("session_value"), F.col("p_brand").alias("project_value"))
    return documents.overridden(config).select("p_partkey", "value")


@query("""SELECT p_partkey AS response_id, rule FROM part, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS rule) WHERE CASE rule WHEN 1 THEN p_partkey % 7 = 0 WHEN 3 THEN p_partkey % 5 = 0 WHEN 4 THEN p_partkey % 7 > 0 AND p_partkey % 3 = 0 WHEN 6 THEN p_partkey % 7 > 0 AND p_partkey % 4 = 0 WHEN 8 THEN p_partkey % 7 > 0 AND p_partkey % 6 = 1 ELSE false END""")
def val2_epic_responses(w):
    epic = F.struct(by(3, " ", "e").alias("epic_ref"), by(4, "", "t").alias("title"), F.lit("d").alias("description"), F.array(F.when(number() % 6 == 1, "zz").otherwise("r1")).alias("covers"))
    reqs = F.array(F.struct(F.lit("r1").alias("id")), F.struct(by(5, "r1", "r2").alias("id")))
    rows = w.part.select(number().alias("response_id"), reqs.alias("requirements"), F.when(number() % 7 > 0, F.array(epic)).alias("epics"))
    return validation.epic_responses(rows).select("response_id", "rule")


@query("SELECT p_partkey AS response_id, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rule FROM part WHERE p_partkey % 4 < 3")
def val2_task_responses(w):
    refs = lambda *names: F.array(*[F.struct(F.lit(n).alias("task_ref")) for n in names])
    tasks = F.when(number() % 4 == 1, refs("a", " ")).when(number() % 4 == 2, refs("a", "a")).when(number() % 4 == 3, refs("a", "b"))
    return validation.task_responses(w.part.select(number().alias("response_id"), tasks.alias("tasks"))).select("response_id", "rule")


@query("""WITH RECURSIVE f AS (SELECT DISTINCT concat('src/', p_partkey % 60, CASE WHEN p_partkey % 2 = 0 THEN '_test.go' ELSE '.go' END) AS path FROM part),
 g AS (SELECT path, replace(path, '_test.go', '.go') AS base FROM f) SELECT s.subject, coalesce(g.base, s.subject) AS base, g.base IS NULL AS synthetic FROM (SELECT DISTINCT concat('src/', p_partkey % 90, '.go') AS subject FROM part) s LEFT JOIN g ON g.path = s.subject""")
def jn26_subject_segments(w):
    """Subjects that a segment of the diff holds, and synthetic segments for the others."""
    files = w.part.select(F.concat(F.lit("src/"), number() % 60, by(2, "_test.go", ".go")).alias("path")).distinct()
    return documents.subject_segments(w.part.select(F.concat(F.lit("src/"), number() % 90, F.lit(".go")).alias("subject")), documents.segments(files))


# --- lookups ---


@query("SELECT id, created_at FROM workflows WHERE current_state = 'running' ORDER BY created_at DESC, id DESC LIMIT 15")
def tk4_newest_of_state(w):
    return warehouse.newest(w.workflows, "running", 15, "current_state").select("id", "created_at")


@query("SELECT id FROM (SELECT id, event_type AS artifact_type, workflow_id, created_at FROM log) WHERE artifact_type = 'click' AND workflow_id = 'wf-7' ORDER BY created_at DESC, id DESC LIMIT 1")
def tk10_latest_artifact(w):
    rows = w.log.withColumnRenamed("event_type", "artifact_type").withColumn("session_id", F.lit("s"))
    return warehouse.latest_artifact(rows, "click", workflow_id="wf-7").select("id")


@query("SELECT id FROM runs WHERE workflow_id = 'wf-7' ORDER BY created_at DESC, id LIMIT 1")
def fil18_run_of_workflow(w):
    return warehouse.run_of_workflow(w.runs, "wf-7").select("id")


@query("SELECT 'session' AS part, id FROM sessions WHERE id = 's-7' UNION ALL SELECT 'run', id FROM runs WHERE session_id = 's-7' UNION ALL SELECT 'plan', id FROM plans WHERE session_id = 's-7'")
def prj9_session_detail(w):
    found = warehouse.session_detail("s-7", sessions=w.sessions, run=w.runs, plan=w.plans)
    rows = [df.select(F.lit(name).alias("part"), "id") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT id FROM chunks WHERE file_path = 'src3/en1.md' OR name = 'n17'")
def fil7_by_path_or_name(w):
    return w.chunks.where((F.col("file_path") == "src3/en1.md") | (F.col("name") == "n17")).select("id")


@query("SELECT id FROM (SELECT id, file_path FROM chunks ORDER BY id LIMIT 50) WHERE starts_with(file_path, 'src1')")
def fil17_after_the_limit(w):
    """The path is asked after the limit, so that fewer rows may be left."""
    return retrieval.under_prefix(w.chunks.orderBy("id").limit(50), "src1").select("id")


@query("SELECT id, CASE WHEN o % 3 = 0 THEN concat('new-', workflow_id) ELSE verify_result END AS verify_result FROM (SELECT id, workflow_id, verify_result, replace(workflow_id, 'wf-', '')::BIGINT AS o FROM runs)")
def str13_phase_updates(w):
    """Updates of every third workflow reach all of its runs; a null leaves what is there."""
    wf = w.workflows.select(F.col("id").alias("workflow_id")).withColumn("o", F.regexp_replace("workflow_id", "wf-", "").cast("long"))
    updates = wf.select("workflow_id", F.when(F.col("o") % 3 == 0, F.concat(F.lit("new-"), "workflow_id")).alias("verify_result"))
    return warehouse.apply_phase_updates(w.runs, updates, ["verify_result"]).select("id", "verify_result")


# --- index ---


@query("SELECT path, hash FROM (SELECT concat('f', p_partkey) AS path, p_brand AS hash FROM part) WHERE false UNION ALL SELECT concat('f', p_partkey), p_brand FROM part")
def ix2_known_hashes(w):
    """By force or after a change of version none holds; else all."""
    known = w.part.select(F.concat(F.lit("f"), number()).alias("path"), F.col("p_brand").alias("hash"))
    forced, changed = index.known_hashes(known, "2", "2", force=True), index.known_hashes(known, "1", "2")
    return forced.unionByName(changed).unionByName(index.known_hashes(known, "2", "2"))


_MARKDOWN = "concat('intro', chr(10), '## ', p_name, ' ', chr(10), 'x', chr(10), '### sub', chr(10), '## ', p_brand)"


@query("SELECT p_partkey, 1 AS section, trim(p_name) AS name, 2 AS line_start, 4 AS line_end FROM part UNION ALL SELECT p_partkey, 2, trim(p_brand), 5, 5 FROM part")
def ix3_markdown(w):
    texts = w.part.select("p_partkey", F.expr(_MARKDOWN).alias("text"))
    return index.markdown_sections(texts, "p_partkey").select("p_partkey", "section", "name", "line_start", "line_end")


@query("SELECT p_partkey, 1 AS pos, concat('func ', p_partkey, '() {') AS line FROM part UNION ALL SELECT p_partkey, 4, concat('type T', p_partkey, ' struct') FROM part")
def ix9_signatures(w):
    text = F.concat(F.lit("package x\n  func "), number(), F.lit("() {\n\treturn\n// func no\ntype T"), number(), F.lit(" struct"))
    return index.signatures(w.part.select("p_partkey", text.alias("text")), "p_partkey")


@query("SELECT id, sha256(concat('sig', chr(10), coalesce(d.description, ''))) AS embed_text FROM chunks LEFT JOIN (SELECT file_path, name, concat(min(language), '!') AS description FROM chunks WHERE name LIKE '%7' GROUP BY 1, 2) d USING (file_path, name)")
def ix13_described(w):
    rows = w.chunks.withColumns({"signature": F.lit("sig"), "description": F.lit("old")})
    said = w.chunks.where("name like '%7'").groupBy("file_path", "name").agg(F.concat(F.min("language"), F.lit("!")).alias("description"))
    return index.described(rows, said).select("id", F.sha2("embed_text", 256).alias("embed_text"))


@query("SELECT edge_type, 2 * count(*) AS n FROM edges GROUP BY 1")
def set2_merged(w):
    """Results of two analyzers, repeated rows and all."""
    both = graph.merged_results([{"edges": w.edges}, {"edges": w.edges, "symbols": w.symbols}])
    return both["edges"].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, target_id, edge_type, source_line FROM (SELECT source_id, target_id, 'CALLS' AS edge_type, min(id % 50) AS source_line FROM edges WHERE edge_type = 'CALLS' GROUP BY 1, 2) UNION ALL SELECT s.id, concat('pkg', s.p % 3), 'IMPORTS', s.p % 7 FROM (SELECT id, 1 AS p FROM symbols WHERE file_path = 'src/f7.go') s")
def set5_function_edges(w):
    """The first call of each target stays; a file's imports are repeated for each of its functions."""
    calls = w.edges.where("edge_type = 'CALLS'").select("source_id", "target_id", (F.col("id") % 50).alias("source_line"))
    imports = w.symbols.where("file_path = 'src/f7.go'").select("file_path").distinct().select("file_path", F.lit("pkg1").alias("target_id"), F.lit(1).cast("long").alias("source_line"))
    return graph.function_edges(calls, imports, w.symbols)


@query("""SELECT response_id, rule FROM (SELECT p_partkey AS response_id, CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 7 WHEN p_partkey % 4 = 0 THEN 4 WHEN p_partkey % 6 = 1 THEN 8 ELSE 0 END AS rule FROM part) WHERE rule > 0""")
def val2_first_epic_errors(w):
    """What breaks in the first epic comes before what breaks in the second."""
    one = F.struct(F.lit("a").alias("epic_ref"), F.lit("t").alias("title"), by(3, "", "d").alias("description"), F.array(F.lit("r1")).alias("covers"))
    two = F.struct(by(4, " ", "b").alias("epic_ref"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.array(F.when(number() % 6 == 1, "zz").otherwise("r2")).alias("covers"))
    reqs = F.array(F.struct(F.lit("r1").alias("id")), F.struct(by(5, "r1", "r2").alias("id")))
    rows = w.part.select(number().alias("response_id"), reqs.alias("requirements"), F.when(number() % 7 > 0, F.array(one, two)).alias("epics"))
    return validation.first_epic_response_errors(rows).select("response_id", "rule")


# --- sources and sinks ---


def _log_rows(w):
    given = {"id": F.col("id").cast("long"), "workflow_id": F.col("workflow_id"), "event_type": F.col("event_type"), "event_data": F.col("event_data"), "created_at": F.col("created_at")}
    return w.log.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["events"].fields])


@query("SELECT event_type, 2 * count(*) AS n, max(id) AS last FROM log GROUP BY 1")
def src13_appended(w):
    """Appended twice to a table that was dropped and made anew, and read by its schema."""
    root = scratch(w.spark, "tables")
    io.append(_log_rows(w), root, "events")
    io.drop_and_recreate(w.spark, root, "events")
    for _ in range(2):
        io.append(_log_rows(w), root, "events")
    return io.table(w.spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


@query("SELECT 0 AS n")
def src3_missing_table(w):
    """A table that nobody has written is empty, as is one that was made anew."""
    root = scratch(w.spark, "tables")
    rows = io.table(w.spark, root, "symbols").select("id")
    io.append(_log_rows(w), root, "events")
    io.drop_and_recreate(w.spark, root, "events")
    return rows.unionByName(io.table(w.spark, root, "events").select(F.col("id").cast("string"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, name FROM (SELECT id, CASE WHEN p % 3 = 0 THEN concat('new', p) ELSE name END AS name FROM (SELECT id, name, replace(id, 'go:pkg:function:P', '')::BIGINT AS p FROM symbols))")
def src14_stored_symbols(w):
    """Of symbols stored again the last one counts."""
    p = F.regexp_replace("id", "go:pkg:function:P", "").cast("long")
    third = w.symbols.select("id", "name").where(p % 3 == 0)
    new = third.withColumn("ord", F.lit(1)).unionByName(third.withColumns({"name": F.concat(F.lit("new"), p), "ord": F.lit(2)}))
    return graph.store_symbols(w.symbols.select("id", "name"), new)


@query("SELECT concat('s', p_partkey % 500) AS symbol_id, concat('c', p_partkey % 70) AS chunk_id FROM part GROUP BY 1, 2")
def src15_mappings(w):
    """Mappings that are there stay; new ones come once."""
    rows = w.part.select(F.concat(F.lit("s"), number() % 500).alias("symbol_id"), F.concat(F.lit("c"), number() % 70).alias("chunk_id"))
    return io.new_mappings(rows.where(number() % 2 == 0).distinct(), rows)


@query("SELECT user_id::VARCHAR AS key, max_by(event_type, id) AS value FROM log GROUP BY 1")
def src16_last_values(w):
    return io.last_by_key(w.log.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "id"), "key", "id")


@query("SELECT concat('f', p_partkey) AS path, p_brand AS hash FROM part")
def src20_saved_hashes(w):
    at = scratch(w.spark, "hashes")
    io.save_file_hashes(w.part.select(F.concat(F.lit("f"), number()).alias("path"), F.col("p_brand").alias("hash")), at)
    return io.file_hashes(w.spark, at)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name FROM part WHERE p_partkey % 5 > 0")
def src21_json(w):
    """Written as JSON without nulls and read as lines of JSON, of which every fifth is bad."""
    at, bad = scratch(w.spark, "json"), scratch(w.spark, "lines")
    io.write_json(w.part.where(number() % 5 > 0).select(number().alias("id"), by(2, F.col("p_name"), F.lit(None).cast("string")).alias("name")), at)
    lines = w.spark.read.text(at).unionByName(w.part.where(number() % 5 == 0).select(F.lit("{bad").alias("value")))
    lines.write.text(bad)
    return io.ndjson(w.spark, bad, "id long, name string").where("id is not null")


@query("SELECT p_partkey AS seq, concat('{\"n\":', p_partkey, '}') AS payload FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 1001")
def src9_data_lines(w):
    """Payloads of data lines before the line that ends them."""
    line = F.when(number() == 1001, "data: [DONE]").when(number() % 3 == 0, F.concat(F.lit(" data: {\"n\":"), number(), F.lit("} "))).otherwise(F.lit(": comment"))
    return events.data_lines(w.part.select(number().alias("seq"), line.alias("line"))).select("seq", "payload")


# --- answers ---


@query("""SELECT s.id, s.state, (SELECT count(*) FROM plans p WHERE p.session_id = s.id)::BIGINT AS plan_runs_count, (SELECT count(*) FROM runs r WHERE r.session_id = s.id)::BIGINT AS pipeline_runs_count,
 (SELECT f.current_state FROM runs r JOIN workflows f ON f.id = r.workflow_id WHERE r.session_id = s.id ORDER BY r.created_at DESC, r.id DESC LIMIT 1) AS latest_workflow_state FROM sessions s""")
def prj6_session_summaries(w):
    found = responses.session_summaries(warehouse.session_list(w.sessions, w.runs, w.plans, w.workflows))
    return found.select("id", "state", "plan_runs_count", "pipeline_runs_count", "latest_workflow_state")


@query("SELECT id, (post_audit_work_order_count - pre_audit_work_order_count)::BIGINT AS work_order_delta, CASE WHEN coalesce(audit_change_text, '') <> '' THEN audit_change_text END AS audit_changes FROM plans")
def prj6_session_plan_runs(w):
    return responses.session_plan_runs(w.plans).select("id", "work_order_delta", F.array_join("audit_changes", "|").alias("audit_changes"))


@query("SELECT id, workflow_id, event_type, json_extract_string(event_data, '$.k') AS k FROM log")
def prj6_event_rows(w):
    return responses.event_rows(w.log).select("id", "workflow_id", "event_type", F.get_json_object("event_data", "$.k").alias("k"))


@query("SELECT concat('{\"id\":\"', id, '\"', CASE WHEN workflow_id IS NULL THEN '' ELSE concat(',\"workflow_id\":\"', workflow_id, '\"') END, CASE WHEN project IS NULL THEN '' ELSE concat(',\"project\":\"', project, '\"') END, CASE WHEN work_order_type IS NULL THEN '' ELSE concat(',\"work_order_type\":\"', work_order_type, '\"') END, CASE WHEN verify_result IS NULL THEN '' ELSE concat(',\"verify_result\":\"', verify_result, '\"') END, CASE WHEN human_result IS NULL THEN '' ELSE concat(',\"human_result\":\"', human_result, '\"') END, ',\"created_at\":\"', created_at, '\"}') AS response FROM runs")
def prj6_pipeline_runs_json(w):
    """Fields that are null are left out."""
    return responses.as_json(responses.session_pipeline_runs(w.runs))


@query("SELECT id, session_id, state, work_orders_generated, generation_cost_usd, CASE WHEN coalesce(audit_change_text, '') = '' THEN 0 ELSE 1 END AS changes FROM plans")
def prj10_plan_run_detail(w):
    detail = responses.plan_run_detail(w.plans).select("id", "session_id", "state", "work_orders_generated", "generation_cost_usd")
    return detail.join(responses.shown_changes(w.plans).select("id", F.size("changes").alias("changes")), "id")
