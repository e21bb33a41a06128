"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from eventide.plans import TABLES, Tables, load_all
from tools.check_oracle import KINDS, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_oracle(spark, duck, name):
    q = QUERIES[name]
    df = q.build(Tables(spark, FOLDER))
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(q.sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert compare(df.columns, rows, names, cur.fetchall()) == "ok"
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name].build(Tables(spark, FOLDER)).count() > 0


# Window functions over a constant partition run on class or hour counts only.
def test_no_plan_pairs_rows(spark):
    for name in ("flagship", "event_study", "append_unseen", "tag_resolution", "next_bar_anchor", "session_resolve", "upsert_merge"):
        plan = QUERIES[name].build(Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_article_rows_keeps_prose_that_looks_like_lines_of_a_site(spark, tmp_path):
    """Pages of every site whose paragraphs begin as the sites' own lines do; only the advert line of the SQL goes."""
    prose = "A long paragraph of the page that says the same again and again, at more than eighty characters in all. "
    odd = ("4129 units of the company.", "+1 (247) 555-6576 was called.", "Disclaimer is a word of it.", "By John Smith", "Top ten funds of it", "Read more of it")
    html = "<article><h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in (*odd, *[prose * 2] * 5)) + "</article>"
    rows = [(i, f"https://a.example/en/{100000 + i}", html) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = load_all()["article_rows"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.execute(q.sql)
    names = [d[0] for d in wanted.description]
    wanted = sorted(wanted.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in q.build(Tables(spark, str(tmp_path))).collect())
    assert len({r[-1] for r in got}) == 6 and got == wanted
