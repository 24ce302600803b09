import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from readloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_gives_bundles_in_order(spark):
    out = e.entry(spark).orderBy("bundle_id", "spine").collect()
    assert out and [r.spine for r in out if r.bundle_id == out[0].bundle_id] == list(range(sum(r.bundle_id == out[0].bundle_id for r in out)))


def test_every_core_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_imports_without_the_training_data_part():
    code = "import sys; sys.modules['readloom.llm'] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", ["u2_canonical_url", "p2_match_site_profile", "x1_extract_articles", "a1_dedupe_assets", "a6_match_assets", "c3_comment_navigation", "l3_plan_translation", "j1_job_summary"])
def test_results_equal_the_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(want)


def test_titles_keep_double_quotes_where_apostrophes_alone_go(spark, tmp_path):
    spark.createDataFrame([(1, 'it\'s a  token = "Ab12" of “some” length.\nmore'), (2, "It's")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.title, r.same) for r in catalog.QUERIES["u13_titles"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {i: (t, s) for i, t, s in con.execute(catalog.ORACLES["u13_titles"]).fetchall()} == {1: ('its a token = "ab12" of “some” length', True), 2: ("its", False)}
