"""Chunk index: hashes, incremental filters, windows, markdown and Python chunks, reverse calls, upserts."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import chunk_id, path_suffixes, sha256_text, truncate_bytes
from ..sources.scratch import written
from .skew import salted_join


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (``path, hash``) whose hash is new or differs from the one recorded."""
    old = known.select("path", F.col("hash").alias("_old"))
    return files.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def line_windows(texts: DataFrame, key: str, size: int = 40, step: int = 20) -> DataFrame:
    """``key, line_start, line_end, body``: overlapping windows of lines (from 1); the last may be short."""
    rows = texts.select(key, F.split("text", "\n").alias("lines")).where("lines is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - 1), F.lit(step))
    rows = rows.select(key, "lines", F.explode(starts).alias("at"))
    return rows.select(key, (F.col("at") + 1).alias("line_start"), F.least(F.col("at") + size, F.size("lines")).alias("line_end"), F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n").alias("body"))


def markdown_sections(texts: DataFrame, key: str) -> DataFrame:
    """``key, section, name, line_start, line_end, body`` by ``## `` headers; text before the first goes, ``### `` is body."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    near = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("section", F.sum(F.col("line").startswith("## ").cast("int")).over(near)).where("section > 0")
    cell = F.array_sort(F.collect_list(F.struct("pos", "line")))  # lines of one section
    out = rows.groupBy(key, "section").agg(cell.alias("c"))
    return out.select(key, "section", F.trim(F.substring(F.col("c")[0]["line"], 4, 1 << 30)).alias("name"), (F.col("c")[0]["pos"] + 1).alias("line_start"), (F.element_at("c", -1)["pos"] + 1).alias("line_end"), F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("body"))


def python_chunks(files: DataFrame) -> DataFrame:
    """``path, chunk_type, name, line_start, line_end`` of functions, classes and methods (``path, text``), decorators included.

    Python has no parser among Spark's functions; files that don't parse give no chunk.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                todo = [("", n) for n in tree.body]
                for owner, n in todo:
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                        start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                        rows.append((path, kind, owner + n.name, start, n.end_lineno))
                        if kind == "class":
                            todo.extend((f"{n.name}.", m) for m in n.body)
            yield pd.DataFrame(rows, columns=["path", "chunk_type", "name", "line_start", "line_end"])

    return files.select("path", "text").mapInPandas(run, "path string, chunk_type string, name string, line_start int, line_end int")


def signatures(texts: DataFrame, key: str) -> DataFrame:
    """Trimmed lines that start a Go function or type."""
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(key, "pos", F.trim("line").alias("line")).where(F.col("line").rlike("^(func|type) "))


def enriched(chunks: DataFrame, body_bytes: int = 2000) -> DataFrame:
    """Add id and content hash; cut the body."""
    rows = chunks.withColumns({"id": chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("name"), F.col("line_start")), "content_hash": sha256_text(F.col("body"))})
    return rows.withColumn("body", truncate_bytes(F.col("body"), body_bytes))


def _calls(chunks: DataFrame) -> DataFrame:
    """Calls with their caller; ``wide``: the call means any directory."""
    calls = chunks.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"), F.posexplode("calls").alias("pos", "c"))
    calls = calls.select("caller_id", "pos", "caller", "caller_file", F.col("c.name").alias("name"), F.coalesce("c.package", F.lit("")).alias("package"))
    return calls.withColumn("wide", (F.col("package") == "") | F.contains("caller_file", F.col("package")))


def _targets(chunks: DataFrame) -> DataFrame:
    """Named Go chunks with their directory."""
    cut = F.regexp_replace("file_path", "/?[^/]*$", "")
    go = chunks.where((F.col("language") == "go") & (F.coalesce("name", F.lit("")) != ""))
    return go.select("id", "name", F.when(cut == "", F.lit(".")).otherwise(cut).alias("directory"))


def reverse_call_edges(chunks: DataFrame) -> DataFrame:
    """``id, caller_id, pos, by``: a row for each call and each chunk that it may mean (``id, name, file_path, calls``).

    Targets are named Go chunks. A call's package matches a chunk whose directory ends in it; an empty package, or
    one that the caller's own path contains, matches any directory too. Chunks don't call themselves. The caller
    carries the call's package and its own file, once for each call. A name that very many chunks bear and call is
    dealt to many tasks.
    """
    calls, go = _calls(chunks), _targets(chunks)
    places = go.select("id", "name", F.explode(path_suffixes(F.col("directory"))).alias("package"))
    deal = ["caller_id", "pos"]
    # what means any directory would meet its own again among the near ones
    near = salted_join(calls.where("not wide"), places.distinct(), ["name", "package"], deal)
    anywhere = salted_join(calls.where("wide"), go.select("id", "name"), ["name"], deal)
    hit = near.unionByName(anywhere).where("id <> caller_id")
    return hit.select("id", "caller_id", "pos", F.struct(F.col("caller").alias("name"), "package", F.col("caller_file").alias("file")).alias("by"))


def reverse_calls(chunks: DataFrame, parts: int = 64) -> DataFrame:
    """``id, called_by``: who calls each chunk, by ``reverse_call_edges``. Callers of a chunk are put together in two
    levels; its list, as long as it is called, is one value of the result."""
    some = reverse_call_edges(chunks).groupBy("id", F.pmod(F.xxhash64("caller_id"), F.lit(parts)).alias("_part")).agg(F.collect_list("by").alias("by"))
    return some.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("by"))).alias("called_by"))


def reverse_callers(chunks: DataFrame, entry: Callable[[Column], Column], parts: int = 64) -> DataFrame:
    """``id, callers``: the distinct entries of each chunk's callers, in order. ``entry`` makes one of the caller as
    ``reverse_calls`` lists it (``name, package, file``).

    Callers that make the same entry meet the chunks of one name and directory once, so pairs of callers and chunks
    are never made: the work follows distinct entries and the result. An entry that one caller alone makes bears the
    caller's id, and is left out for that chunk itself.
    """
    by = F.struct(F.col("caller").alias("name"), "package", F.col("caller_file").alias("file"))
    calls = _calls(chunks).where("caller_id is not null").select("name", "wide", F.when(~F.col("wide"), F.col("package")).alias("package"), entry(by).alias("entry"), "caller_id")
    calls = calls.groupBy("name", "wide", "package", "entry").agg(F.min("caller_id").alias("low"), F.max("caller_id").alias("high"))
    go = _targets(chunks).where("id is not null").withColumn("directory", F.coalesce("directory", F.lit("")))  # no directory is empty otherwise
    places = go.select("name", "directory").distinct()
    near = salted_join(calls.where("not wide"), places.where("directory <> ''").select("*", F.explode(path_suffixes(F.col("directory"))).alias("package")).distinct(), ["name", "package"], ["entry"])
    anywhere = salted_join(calls.where("wide").drop("package"), places, ["name"], ["entry"])
    at = ["name", "directory"]
    hit = near.drop("package").unionByName(anywhere).groupBy(*at, "entry").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hit = hit.select(*at, F.struct("entry", F.when(F.col("low") == F.col("high"), F.col("low")).alias("sole")).alias("e"))
    some = hit.groupBy(*at, F.pmod(F.xxhash64("e.entry"), F.lit(parts)).alias("_part")).agg(F.collect_list("e").alias("e"))
    held = some.groupBy(*at).agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    lists = written(held.select(*at, F.col("e.entry").alias("callers"), F.filter("e", lambda e: e["sole"].isNotNull()).alias("soles")), "callers")
    # an id that several chunks bear gets the callers of all
    ids = written(go.groupBy("id").agg(F.collect_set(F.struct(*at)).alias("at")), "called")
    own = F.transform(F.filter("soles", lambda e: e["sole"] == F.col("id")), lambda e: e["entry"])
    callers = F.when(F.exists("soles", lambda e: e["sole"] == F.col("id")), F.array_except("callers", own)).otherwise(F.col("callers"))
    asked = lambda rows: salted_join(rows, lists, at, ["id"]).select("id", callers.alias("callers")).where(F.size("callers") > 0)
    one = asked(ids.where("size(at) = 1").select("id", F.col("at")[0]["name"].alias("name"), F.col("at")[0]["directory"].alias("directory")))
    several = asked(ids.where("size(at) > 1").select("id", F.inline("at")))
    return one.unionByName(several.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("callers")))).alias("callers")))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def purge_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(~F.col("file_path").eqNullSafe(F.lit(path)))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts by language and by type, and in all, as ``kind, value, n``; ``latest``: when a chunk was last indexed, if that is known."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("all", F.lit("")), ("language", F.col("language")), ("chunk_type", F.col("chunk_type")))])
    at = [F.col("indexed_at")] if "indexed_at" in chunks.columns else []
    latest = [F.max("indexed_at").alias("latest")] if at else []
    return chunks.select(*at, F.inline(cells)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), *latest)


def top_files(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(n)


def described(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Attach descriptions by file and name; the text to embed is signature, line break, description."""
    rows = chunks.drop("description").join(descriptions.select("file_path", "name", "description"), ["file_path", "name"], "left")
    return rows.withColumn("embed_text", F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))


#: Layout of relationships (fixed values).
RELATIONS = "=== RELATIONSHIP CONTEXT ===\n"
RELATION_LINES = {"calls": "  Calls: ", "called_by": "  Called by: ", "types_used": "  Types used: ", "implements_ifaces": "  Implements: "}


def relations(chunks: DataFrame, order: str = "line_start") -> DataFrame:
    """``file_path, block``: the relationships of each file's named chunks, in order; a file without any has no row.

    References are named with their package in parentheses. A list column may be missing.
    """
    def named(c: str) -> Column:
        if c in ("types_used", "implements_ifaces"):
            return F.array_join(c, ", ")
        return F.array_join(F.transform(c, lambda r: F.when(F.coalesce(r["package"], F.lit("")) != "", F.concat(r["name"], F.lit(" ("), r["package"], F.lit(")"))).otherwise(r["name"])), ", ")

    lines = [F.when(F.size(c) > 0, F.concat(F.lit(head), named(c), F.lit("\n"))) for c, head in RELATION_LINES.items() if c in chunks.columns]
    said = F.concat_ws("", *lines)
    rows = chunks.where(F.coalesce("name", F.lit("")) != "").withColumn("_said", said).where("_said <> ''")
    cell = F.struct(F.col(order).alias("ord"), F.col("id"), F.concat(F.lit("Function: "), "name", F.lit("\n"), "_said", F.lit("\n")).alias("text"))
    out = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # chunks of one file
    return out.select("file_path", F.concat(F.lit(RELATIONS), F.array_join(F.transform("cells", lambda c: c["text"]), "")).alias("block"))


def known_hashes(hashes: DataFrame, version: str, current: str, force: bool = False) -> DataFrame:
    """Recorded hashes that still hold: none after a change of the schema's version, or by force."""
    return hashes.limit(0) if force or version != current else hashes


def after_upsert(known: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashes (``path, hash``) once the chunks of ``stored`` files are written: theirs replace older ones."""
    return known.join(stored.select("path"), "path", "left_anti").unionByName(stored.select("path", "hash"))


def in_file_order(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("line_start", "id")
