"""Symbol graphs: bounded blast radius, targets, interfaces, and resolution of Python calls.

The frontier is widened one depth at a time and written, so that each depth is one
join with the edges; paths are kept, as the cycle guard is part of the semantics: an id
counts as visited once it is a substring of the path (``strict`` compares whole ids).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


@dataclass(frozen=True)
class BlastOptions:
    depth: int = 3
    budget: int = 30
    min_confidence: float = 0.5
    edge_types: tuple[str, ...] = ()
    include_tests: bool = True
    strict: bool = False


def resolve(symbols: DataFrame, name_or_id: str) -> DataFrame:
    """The symbol of that id, else the first by id of that name."""
    exact = F.col("id") == name_or_id
    return symbols.where(exact | (F.col("name") == name_or_id)).orderBy(F.desc(exact), "id").limit(1)


def _test_file(path: Column) -> Column:
    """``_`` of the patterns stands for any character, and case doesn't count, as in the tool whose answers these are."""
    return path.ilike("%_test.go") | path.ilike("%test_%") | path.ilike("%.test.ts")


def inner_ids(ids: DataFrame) -> DataFrame:
    """``id, holds``: of each ``id`` that has another one of them as a proper part, those parts, sorted.

    Ids are cut only at places where the first three characters of some id stand, and to lengths that ids have.
    """
    names = ids.select("id").distinct()
    heads = names.select(F.substring("id", 1, 3).alias("head")).distinct()
    lengths = names.select(F.length("id").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))  # as many as an id has characters
    places = names.select("id", F.explode(F.sequence(F.lit(1), F.length("id"))).alias("p")).withColumn("head", F.expr("substring(id, p, 3)"))
    places = places.join(heads, "head").join(F.broadcast(lengths))
    fits = F.filter("lengths", lambda n: (n < F.length("id")) & (F.col("p") + n - 1 <= F.length("id")))
    parts = places.select("id", "p", F.explode(fits).alias("n")).select("id", F.expr("substring(id, p, n)").alias("part"))
    return parts.join(names.select(F.col("id").alias("part")), "part").groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("holds"))  # parts of one id


#: Edges of a symbol beyond which they are dealt to several tasks.
HUB = 10_000


def _dealt(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hops`` (``at, to``) with ``part``: edges of a hub in parts of about ``HUB``; and ``at, parts`` of the hubs."""
    hubs = hops.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1")
    hubs = written(hubs, "hubs")  # few: one for each ``HUB`` edges at most
    return hops.join(hubs, "at", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")), F.lit(0)).cast("int")).drop("parts"), hubs


def _met(frontier: DataFrame, hops: DataFrame, hubs: DataFrame) -> DataFrame:
    """The frontier (``at``) beside its edges; at a hub each row goes to all of its parts."""
    rows = frontier.join(hubs, "at", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return rows.join(hops, ["at", "part"]).drop("part")


def blast(symbols: DataFrame, edges: DataFrame, boundaries: DataFrame, roots: DataFrame, upstream: bool, options: BlastOptions = BlastOptions()) -> DataFrame:
    """``root_id, id, name, file_path, depth, confidence, path, edge_type`` of what each root (``root_id``, any number of
    them) is called by (upstream) or calls. Of the ways to a symbol the shortest counts, then the most confident, then
    the first path, which begins behind the root.

    Boundary symbols never appear: downstream they are cut everywhere, upstream beyond the first hop.
    A symbol that calls itself is at depth 1. Confidence and type are those of the last hop.

    Each depth is one join of the frontier, as written, with the edges. What a root's way to a symbol rules out
    later is what stands on it: the symbols, which were reached sooner, and (but for ``strict``) ids that are part of
    theirs. Of ways that rule out the same only the first goes on, so that a symbol is in a root's frontier about once.
    """
    use = edges.where(F.col("confidence") >= options.min_confidence)
    if options.edge_types:
        use = use.where(F.col("edge_type").isin(*options.edge_types))
    if not upstream:
        use = use.where("edge_type <> 'IMPLEMENTS'")
    here, there = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    hops = use.groupBy(F.col(here).alias("at"), F.col(there).alias("to"), "edge_type").agg(F.max("confidence").alias("confidence"))
    hops = hops.join(boundaries.select(F.col("id").alias("to")).distinct().withColumn("outer", F.lit(True)), "to", "left")
    hops, hubs = _dealt(written(hops, "hops"))
    inner = hops.where("outer is null")
    holds = None if options.strict else written(inner_ids(written(hops.select(F.col("to").alias("id")).distinct(), "ids")), "parts")
    level = roots.select("root_id", F.col("root_id").alias("at"), F.lit(None).cast("string").alias("path"), F.array().cast("array<string>").alias("ruled")).where("root_id is not null").distinct()
    levels: list[DataFrame] = []
    ways = [F.min("path").alias("path"), F.min("way").alias("way")]
    for depth in range(1, options.depth + 1):
        rows = _met(level, hops if upstream and depth == 1 else inner, hubs)
        if depth > 1:
            seen = F.array_contains(F.split("path", ">"), F.col("to")) if options.strict else F.contains("path", F.col("to"))
            rows = rows.where(~seen & (F.col("to") != F.col("root_id")))
        path = F.concat_ws(">", "path", "to")
        rows = rows.select("root_id", F.col("to").alias("id"), "ruled", path.alias("path"), F.struct((-F.col("confidence")).alias("less"), path.alias("path"), "edge_type").alias("way"))
        rows = rows.groupBy("root_id", "id", "ruled").agg(*ways)
        if holds is not None:  # what the way's last symbol rules out
            rows = rows.join(holds, "id", "left").withColumn("ruled", F.when(F.col("holds").isNull(), F.col("ruled")).otherwise(F.array_sort(F.array_union("ruled", "holds"))))
            rows = rows.groupBy("root_id", "id", "ruled").agg(*ways)
        if levels:
            before = reduce(DataFrame.unionByName, [f.select("root_id", "id", "ruled") for f in levels])
            rows = rows.join(before.where(F.size("ruled") == 0), ["root_id", "id"], "left_anti")
            rows = rows if options.strict else rows.join(before, ["root_id", "id", "ruled"], "left_anti")
        levels.append(written(rows.withColumn("depth", F.lit(depth)), "frontier"))
        if depth > 2 and levels[-1].isEmpty():
            break
        level = levels[-1].select("root_id", F.col("id").alias("at"), "path", "ruled")
    found = reduce(DataFrame.unionByName, [f.select("root_id", "id", F.struct("depth", "way").alias("best")) for f in levels])
    found = found.groupBy("root_id", "id").agg(F.min("best").alias("best")).join(symbols.select("id", "name", "file_path"), "id")
    found = found.select("root_id", "id", "name", "file_path", "best.depth", (-F.col("best.way.less")).alias("confidence"), F.col("best.way.path").alias("path"), F.col("best.way.edge_type").alias("edge_type"))
    if not options.include_tests:
        found = found.where(~_test_file(F.col("file_path")))
    within = Window.partitionBy("root_id").orderBy("depth", F.desc("confidence"), "id")
    return found.withColumn("rn", F.row_number().over(within)).where(F.col("rn") <= options.budget).drop("rn")


def interfaces(symbols: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    rows = edges.where("edge_type = 'IMPLEMENTS'").select(F.col("source_id").alias("root_id"), F.col("target_id").alias("id")).join(roots.select("root_id"), "root_id", "left_semi")
    return rows.join(symbols.select("id", "name", "file_path"), "id").distinct()


def known_file_roots(symbols: DataFrame, files: DataFrame, by: str = "id") -> DataFrame:
    """``asked_id, root_id``: the functions and methods of known files (``path``), each with the root it is asked by.

    By ``id`` that is the symbol itself. By ``name``, the symbol that its name stands for: the one whose id is that
    name, else the first by id that bears it; so symbols of one name share a root.
    """
    asked = symbols.where(F.col("kind").isin("function", "method")).join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    if by == "id":
        return asked.select(F.col("id").alias("asked_id"), F.col("id").alias("root_id"))
    first = symbols.groupBy("name").agg(F.min("id").alias("first_id"))
    exact = symbols.select(F.col("id").alias("name"), F.col("id").alias("exact_id"))
    rows = asked.select(F.col("id").alias("asked_id"), "name").join(first, "name").join(exact, "name", "left")
    return rows.select("asked_id", F.coalesce("exact_id", "first_id").alias("root_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """Callers and callees of each symbol."""
    both = edges.where("edge_type = 'CALLS'").select(F.inline(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("callers"), F.lit(1).alias("callees")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("callers"), F.lit(0).alias("callees")))))
    return both.groupBy("id").agg(F.sum("callers").alias("callers"), F.sum("callees").alias("callees"))


def store_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id; of equal ids in ``new`` the greatest ``ord`` counts."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("id", "ord")]), "ord").alias("s")).select("id", "s.*")
    return old.join(last, "id", "left_anti").unionByName(last)


def store_boundaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Boundary symbols, inserted or replaced by id, as ``store_symbols``."""
    return store_symbols(old, new)


def cross_file_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target and type, but IMPORTS stay as they are."""
    return edges.where("edge_type = 'IMPORTS'").unionByName(edges.where("edge_type <> 'IMPORTS'").dropDuplicates(["source_id", "target_id", "edge_type"]))


def function_edges(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """``source_id, target_id, edge_type, source_line`` of functions as their extraction gives them.

    Of a function's ``calls`` (``source_id, target_id, source_line``) of one target the first stays. What its file
    ``imports`` (``file_path, target_id, source_line``) is repeated for each of its ``functions`` (``id, file_path``).
    """
    first = calls.groupBy("source_id", "target_id").agg(F.min("source_line").alias("source_line")).withColumn("edge_type", F.lit("CALLS"))
    held = imports.join(functions.select("file_path", F.col("id").alias("source_id")), "file_path").withColumn("edge_type", F.lit("IMPORTS"))
    names = ["source_id", "target_id", "edge_type", "source_line"]
    return first.select(*names).unionByName(held.select(*names))


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File of a dotted import: the module, else the package's ``__init__``."""
    stem = F.regexp_replace("module", r"\.", "/")
    rows = imports.withColumns({"_m": F.concat(stem, F.lit(".py")), "_i": F.concat(stem, F.lit("/__init__.py"))})
    rows = rows.join(files.select(F.col("path").alias("_m"), F.col("path").alias("_file_m")), "_m", "left").join(files.select(F.col("path").alias("_i"), F.col("path").alias("_file_i")), "_i", "left")
    return rows.withColumn("file", F.coalesce("_file_m", "_file_i")).drop("_m", "_i", "_file_m", "_file_i")


def unique_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (``name``) whose name belongs to exactly one symbol, at confidence 0.85."""
    one = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id")).where("n = 1").drop("n")
    return calls.join(one, "name").withColumn("confidence", F.lit(0.85))


def qualified_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (``call_id, module, name``): the first symbol of the name whose package starts with the module, at 0.7.

    First by ``ord``, the order of extraction, where symbols have one; else by id. Of a name and a package's head one
    symbol is left before calls meet it, so a call makes one row at most.
    """
    order = F.col("ord") if "ord" in symbols.columns else F.col("id")
    first = symbols.groupBy("name", "package").agg(F.min(F.struct(order.alias("ord"), F.col("id").alias("target_id"))).alias("_hit"))
    heads = F.transform(F.sequence(F.lit(0), F.length("package")), lambda n: F.col("package").substr(F.lit(1), n))
    heads = first.select("name", F.explode(heads).alias("module"), "_hit").groupBy("name", "module").agg(F.min("_hit").alias("_hit"))
    rows = calls.join(heads, ["name", "module"])
    held = [c for c in calls.columns if c not in ("call_id", "name")]
    out = rows.groupBy("call_id", "name").agg(*[F.first(c).alias(c) for c in held], F.min("_hit").alias("_hit"))
    return out.withColumns({"target_id": F.col("_hit.target_id"), "confidence": F.lit(0.7)}).drop("_hit")


def symbols_in(symbols: DataFrame, file_path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == file_path).orderBy("line_start", "id")


def edges_of(edges: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges from a symbol, to one, or between two."""
    for column, value in (("source_id", source), ("target_id", target)):
        edges = edges.where(F.col(column) == value) if value else edges
    return edges


def enclosing(lines: DataFrame, symbols: DataFrame, innermost: bool = True, step: int = 64) -> DataFrame:
    """The symbol whose span holds each line (``file_path, line``): the innermost, or the first in order.

    Spans and lines meet on the blocks of ``step`` lines they touch, so the join is an equi-join.
    """
    spans = symbols.withColumn("block", F.explode(F.sequence(F.floor(F.col("line_start") / step), F.floor(F.col("line_end") / step))))
    rows = lines.withColumn("block", F.floor(F.col("line") / step)).join(spans.select("file_path", "block", "line_start", "line_end", F.col("id").alias("symbol_id")), ["file_path", "block"])
    rows = rows.where("line between line_start and line_end")
    pick = Window.partitionBy("file_path", "line").orderBy(F.desc("line_start") if innermost else F.asc("line_start"), "symbol_id")
    return rows.withColumn("rn", F.row_number().over(pick)).where("rn = 1").drop("rn", "block")


def python_calls(files: DataFrame) -> DataFrame:
    """``path, caller, line, kind, module, name`` of the calls in Python files (``path, text``).

    ``kind``: ``name`` for a bare name, ``self`` for a method of the own class (its name in ``module``),
    ``qualified`` for ``module.name``. Resolution is left to joins. Files that don't parse give none.
    """
    import ast

    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                todo = [(tree, "", "")]
                for node, owner, cls in todo:
                    for n in ast.iter_child_nodes(node):
                        own, within = owner, cls
                        if isinstance(n, ast.ClassDef):
                            within = n.name
                        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                            own = f"{cls}.{n.name}" if cls else n.name
                        elif isinstance(n, ast.Call):
                            g = n.func
                            if isinstance(g, ast.Name):
                                rows.append((path, owner, n.lineno, "name", "", g.id))
                            elif isinstance(g, ast.Attribute) and isinstance(g.value, ast.Name):
                                mine = g.value.id == "self" and cls
                                rows.append((path, owner, n.lineno, "self" if mine else "qualified", cls if mine else g.value.id, g.attr))
                        todo.append((n, own, within))
            yield pd.DataFrame(rows, columns=["path", "caller", "line", "kind", "module", "name"])

    return files.select("path", "text").mapInPandas(run, "path string, caller string, line int, kind string, module string, name string")


def self_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of a class's own methods (``module`` is the class), at confidence 0.95."""
    own = symbols.select(F.col("file_path").alias("path"), F.col("receiver").alias("module"), "name", F.col("id").alias("target_id"))
    return calls.where("kind = 'self'").join(own, ["path", "module", "name"]).withColumn("confidence", F.lit(0.95))


def path_nodes(path: Column) -> Column:
    """Ids along a path, in order."""
    return F.split(path, ">")


def merged_results(results: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """All rows of several analyzers, by table (symbols, edges, boundaries); repeated ones stay."""
    names = sorted({n for r in results for n in r})
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r[n] for r in results if n in r]) for n in names}


def analyzed(analyzers: dict[str, Callable[[], dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of all analyzers that work, and the errors of those that don't."""
    done, errors = [], {}
    for name, run in analyzers.items():
        try:
            done.append(run())
        except Exception as e:
            errors[name] = str(e)
    return merged_results(done), errors


def formatted(targets: DataFrame, nodes: DataFrame, interfaces_: DataFrame) -> str:
    """The blast radius of few targets as text for a prompt.

    ``targets``: a row of ``symbols`` each; ``nodes``: ``root_id, direction`` (up or down), ``depth, confidence, edge_type``
    and the node's ``name, file_path, line_start, signature``; ``interfaces_``: ``root_id, name, kind, file_path, line_start``.
    """
    rows = targets.orderBy("id").collect()  # those that a prompt holds
    if not rows:
        return ""
    by: dict[tuple[str, str], list] = {}
    for r in nodes.orderBy("depth", F.desc("confidence"), "name").collect():
        by.setdefault((r["root_id"], r["direction"]), []).append(r)
    for r in interfaces_.orderBy("name").collect():
        by.setdefault((r["root_id"], "is"), []).append(r)
    out = ["=== STRUCTURAL CONTEXT (call graph) ===", ""]
    for t in rows:
        out += [f"Target: {t['name']} ({t['kind']})", f"  File: {t['file_path']}:{t['line_start']}-{t['line_end']}"]
        out += [f"  Signature: {t['signature']}"] * bool(t["signature"]) + [""]
        for way, title in (("up", "UPSTREAM (callers — changes here may require updates to these):"), ("down", "DOWNSTREAM (callees — this function depends on these):"), ("is", "IMPLEMENTS:")):
            held = by.get((t["id"], way), [])
            if not held:
                continue
            out.append(f"  {title}")
            for n in held:
                head = f"{n['name']} ({n['kind']})" if way == "is" else f"[depth {n['depth']}, confidence {n['confidence']:.1f}, {n['edge_type']}] {n['name']}"
                out += [f"    {head}", f"      File: {n['file_path']}:{n['line_start']}"]
                if way != "is" and n["signature"]:
                    out.append(f"      Signature: {n['signature']}")
            out.append("")
        out.append("")
    return "\n".join(out) + "\n"
