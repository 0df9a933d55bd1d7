"""Vector retrieval: exact top-k by distance, merging of several queries, budgets and one-hop expansion."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..sources.scratch import written
from . import blocks
from .scans import row_numbers
from .skew import salted_join

#: Criteria about running builds and tests (fixed value).
BOILERPLATE = r"(?i)\bgo\s+(build|test|vet)\b|\bpasses\b|\bcompiles\b"


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def chunk_filter(chunks: DataFrame, language: str | None = None, chunk_type: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Filters that apply before any distance; ``_`` and ``%`` of the prefix stay wildcards."""
    for column, value in (("language", language), ("chunk_type", chunk_type)):
        chunks = chunks.where(F.col(column) == value) if value else chunks
    return chunks.where(F.col("file_path").like(path_prefix + "%")) if path_prefix else chunks


def top_k(chunks: DataFrame, query: list[float], k: int, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows with ``distance`` and ``score = 1 - distance``."""
    rows = chunks.withColumn("distance", l2(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return rows.withColumn("score", 1 - F.col("distance")).orderBy("distance", id_).limit(k)


def multi_top_k(chunks: DataFrame, queries: list[list[float]], k: int = 10, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """``query, id, distance, rank``: the ``k`` nearest rows of each query, by one scan.

    Each partition keeps its own ``k`` of a query, so that the window sees few rows of each.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("query"), F.array(*[F.lit(float(x)) for x in q]).alias("q")) for i, q in enumerate(queries)])
    rows = chunks.select(F.col(id_).alias("id"), F.explode(F.transform(asked, lambda x: F.struct(x["query"].alias("query"), l2(F.col(vector), x["q"]).alias("distance")))).alias("hit"))
    rows = rows.select("hit.query", "id", "hit.distance").withColumn("part", F.spark_partition_id())
    for keys in (["query", "part"], ["query"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "id"))).where(F.col("rank") <= k)
    return rows.drop("part")


def joined_top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """As ``multi_top_k``, for queries that are a table (``query, q``) of any size.

    Blocks of queries meet blocks of rows; of each pair of blocks one matrix product is taken, and ``k`` rows a query
    leave it. Vectors with nulls or without finite numbers, and those of another length, are no query's hits.
    """
    rows = blocks.top_k(blocks.packed(chunks, id_, vector), blocks.packed(queries, "query", "q"), k)
    nearest = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def merged(hits: DataFrame, of: list[str] | None = None) -> DataFrame:
    """Hits of several queries by id, and by request where columns name one (``of``): how many, and the best score; most hits first."""
    by = of or []
    out = hits.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("hits"), F.max(1 - F.col("distance")).alias("best_score"))
    return row_numbers(out, by, [-F.col("hits"), -F.col("best_score"), "id"], "rank")


def budgeted(ranked: DataFrame, most: int = 30, direct_share: int = 60) -> DataFrame:
    """The direct hits that the budget takes: ``direct_share`` per cent of ``most``, rounded down."""
    return ranked.where(F.col("rank") <= most * direct_share // 100)


def hops(direct: DataFrame, chunks: DataFrame, most: int = 30, of: list[str] | None = None) -> DataFrame:
    """Chunks named by the direct hits' ``calls``, then ``called_by``, first seen first, within what the budget has left.

    References go by bare name. ``direct`` has ``id, rank`` (and ``of``, the columns of its request); ``chunks`` has
    ``id, name, calls, called_by``. What direct hits leave of ``most`` is the hops' room.
    """
    by = of or []
    own = direct.select(*by, "id", "rank").join(chunks, "id")
    refs = [own.select(*by, "rank", F.lit(kind).alias("kind"), F.posexplode(F.transform(column, lambda r: r["name"])).alias("pos", "name")) for kind, column in enumerate(("calls", "called_by"))]
    named = refs[0].unionByName(refs[1]).groupBy(*by, "name").agg(F.min(F.struct("rank", "kind", "pos")).alias("at"))  # a name is looked up once
    rows = salted_join(named, chunks.select("name", F.col("id").alias("hop_id")), ["name"], [*by, "name"])
    rows = rows.join(direct.select(*by, F.col("id").alias("hop_id")), [*by, "hop_id"], "left_anti")
    first = rows.groupBy(*by, "hop_id").agg(F.min(F.struct("at.rank", "at.kind", "at.pos", "hop_id")).alias("seen"))
    within = Window.partitionBy(*by).orderBy("seen")
    first = first.withColumn("hop_rank", F.row_number().over(within)).where(F.col("hop_rank") <= most)  # each task keeps ``most``
    room = direct.groupBy(*by).agg((F.lit(most) - F.count(F.lit(1))).alias("room"))
    first = first.join(room, by) if by else first.join(F.broadcast(room))  # one row
    return first.where("hop_rank <= room").select(*by, F.col("hop_id").alias("id"), "hop_rank")


def search(hits: DataFrame, basic: DataFrame, requests: DataFrame, chunks: DataFrame, most: int = 30, basic_k: int = 10) -> DataFrame:
    """``request, id, ord, is_dependency_hop, query_hit_count, score`` of every request, as one plan.

    ``hits`` (``request, query, id, distance``): what the queries of a request found. Of a request that worked
    (``requests``: ``request, failed``; null is false), merged hits come first, 60 per cent of ``most`` or as many as
    there are, then hops for what they leave. Of one that failed, the first ``basic_k`` of ``basic``
    (``request, id, distance, rank``) come, without hops and counts.
    """
    state = requests.select("request", F.coalesce("failed", F.lit(False)).alias("failed"))
    works, fails = (state.where(c).select("request") for c in (~F.col("failed"), F.col("failed")))
    direct = written(budgeted(merged(hits.join(works, "request", "left_semi"), ["request"]), most), "direct")
    count = lambda c: F.col(c).cast("long").alias("query_hit_count")
    found = direct.select("request", "id", F.col("rank").cast("long").alias("ord"), F.lit(False).alias("is_dependency_hop"), count("hits"), F.col("best_score").alias("score"))
    more = hops(direct, chunks, most, ["request"]).join(direct.groupBy("request").agg(F.count(F.lit(1)).alias("n")), "request")
    more = more.select("request", "id", (F.col("hop_rank") + F.col("n")).cast("long").alias("ord"), F.lit(True).alias("is_dependency_hop"), F.lit(0).cast("long").alias("query_hit_count"), F.lit(0.0).alias("score"))
    plain = basic.join(fails, "request", "left_semi").where(F.col("rank") <= basic_k)
    plain = plain.select("request", "id", F.col("rank").cast("long").alias("ord"), F.lit(False).alias("is_dependency_hop"), F.lit(0).cast("long").alias("query_hit_count"), (1 - F.col("distance")).alias("score"))
    return found.unionByName(more).unionByName(plain)


def under_prefix(limited: DataFrame, prefix: str) -> DataFrame:
    """Path filter above a limit: it may leave fewer rows than the limit."""
    return limited.where(F.col("file_path").startswith(prefix))


def expansion(title: str, module: str, criteria: list[str], files: list[str]) -> list[str]:
    """Queries of a work order: title, module if there is one, criteria that say something, files as ``directory base``.

    Criteria about builds and tests say nothing, and none of four words or fewer does; names of files go without
    their extension.
    """
    said = [c for c in criteria if not re.search(BOILERPLATE, c) and len(c.split()) > 4]
    named = []
    for f in files:
        directory, base = os.path.split(os.path.normpath(f))
        base = base[: base.rindex(".")] if "." in base else base
        named.append(f"{directory} {base}" if directory else base)
    return [title, *([module] if module else []), *said, *named]


def telling(criteria: DataFrame) -> DataFrame:
    """Rows whose ``criterion`` says something, by the same two rules."""
    words = F.size(F.filter(F.split(F.trim("criterion"), r"\s+"), lambda w: w != ""))
    return criteria.where(~F.col("criterion").rlike(BOILERPLATE) & (words > 4))


#: Layout of a result and of a block of results (fixed values).
RESULT = "[Score: %.2f] %s — %s (lines %d-%d)\n  %s\n  %s"
RESULTS = "=== SEMANTICALLY RELEVANT CODE (via RAG) ===\n"


def rendered(rows: DataFrame) -> DataFrame:
    """``id, block``: results (chunks with ``score``) as text."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("id", F.format_string(RESULT, F.coalesce("score", F.lit(0.0)), text("file_path"), text("name"), F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0)), text("description"), text("signature")).alias("block"))


def results_block(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The blocks of each request's results (``by``; few rows each) in order, as one text; a request without results has none."""
    blocks_ = rendered(rows.withColumn("id", F.struct(*by, F.col(order).alias("_ord"))))
    cells = F.array_sort(F.collect_list(F.struct(F.col("id._ord").alias("ord"), "block")))
    return blocks_.groupBy(*[F.col(f"id.{c}").alias(c) for c in by]).agg(F.concat(F.lit(RESULTS), F.array_join(F.transform(cells, lambda c: F.concat(c["block"], F.lit("\n\n"))), "")).alias("block"))


def metadata(chunks: DataFrame) -> DataFrame:
    """What lists and statistics need; bodies and vectors are not read."""
    return chunks.select(*[c for c in chunks.columns if c not in ("body", "embedding")])


def code_refs(refs: Column) -> Column:
    """References of chunks as those of answers: ``function, file``."""
    return F.transform(refs, lambda r: F.struct(r["name"].alias("function"), r["file"].alias("file")))


def hit_counts(results: DataFrame) -> DataFrame:
    """How many results are direct hits and how many come by a hop (``is_dependency_hop``)."""
    hop = F.coalesce(F.col("is_dependency_hop"), F.lit(False))
    return results.agg(F.count_if(~hop).alias("direct"), F.count_if(hop).alias("hops"))


#: Put before the text of a query, not of a document (fixed value).
QUERY_PREFIX = "Represent this query for searching relevant code: "


def embedded(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], query: bool = False, batch: int = 32) -> DataFrame:
    """Add ``embedding`` of the column ``text``, asked for in batches; an answer of another length is an error."""

    def run(frames):
        for f in frames:
            texts = [(QUERY_PREFIX if query else "") + (t or "") for t in f[text]]
            found: list[list[float]] = []
            for at in range(0, len(texts), batch):
                got = embedder(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError(f"{len(texts[at : at + batch])} texts, {len(got)} vectors")
                found += got
            yield f.assign(embedding=found)

    schema = StructType([f for f in rows.schema.fields if f.name != "embedding"] + [StructField("embedding", ArrayType(FloatType()))])
    return rows.drop("embedding").mapInPandas(run, schema)


def searched(enriched: Callable[[], DataFrame], basic: Callable[[], DataFrame], k: int = 10) -> DataFrame:
    """The enriched search; if it can't be done, ``k`` results of the basic one, without hops and counts."""
    try:
        found = enriched()
        found.schema  # a plan that can't be analysed fails here
        return found
    except Exception:
        return basic().limit(k)
