"""Every registered query against its DuckDB SQL on the small tables."""

import datetime

import duckdb
import pytest

from quarry import catalog
from quarry.operators import graph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return str(v)
    return str(v) if isinstance(v, datetime.date) else f"{float(v):.3f}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = duck.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_merged_results_of_every_run(spark, sf):
    """Brute force: counters of repeated steps add up, and no run is left out."""
    table = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect():
        steps = table.setdefault(f"run-{r['l_orderkey']}", {})
        step = f"step{r['l_linenumber']}"
        steps[step] = steps.get(step, 0) + 1
    want = {g: ",".join(f"{k}={n}" for k, n in sorted(steps.items())) for g, steps in table.items()}
    assert any(n > 1 for steps in table.values() for n in steps.values())
    assert {r["grp"]: r["tools"] for r in catalog.queries()["ag22_all_results"](spark, sf).collect()} == want


def test_whole_tables_are_read(spark, sf):
    """No id subsets: a row for each document and event, and k hits for each hundredth vector."""
    run = {n: catalog.queries()[n](spark, sf) for n in ("jn16_all_refs", "fn15_all_events", "tk6_all_top_k", "vs4_all_queries")}
    ids = {t: sorted(r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()) for t, c in (("documents", "doc_id"), ("events", "event_id"), ("embeddings", "vec_id"))}
    assert sorted(r["ref"] for r in run["jn16_all_refs"].collect()) == ids["documents"] and max(ids["documents"]) >= 100
    assert sorted(r["id"] for r in run["fn15_all_events"].collect()) == ids["events"]
    asked = [k for k in ids["embeddings"] if k % 100 == 0]
    hits = run["tk6_all_top_k"].collect()
    assert sorted(r["query"] for r in hits) == sorted(asked * 10)
    assert {r["id"] for r in hits if r["rank"] == 1} == set(asked)  # each is its own nearest
    assert sum(r["hits"] for r in run["vs4_all_queries"].collect()) == 10 * len(asked)


def test_unique_names_among_all_symbols(spark):
    """A name that is unique in one package only is no hit; one of another package is."""
    symbols = spark.createDataFrame([("a", "P1"), ("b", "P1"), ("c", "P2"), ("d", "P3")], "id string, name string")
    calls = spark.createDataFrame([(1, "P1"), (2, "P2"), (3, "P3"), (4, "P4")], "call_id int, name string")
    got = {(r["call_id"], r["target_id"], r["confidence"]) for r in graph.unique_names(calls, symbols).collect()}
    assert got == {(2, "c", 0.85), (3, "d", 0.85)}
