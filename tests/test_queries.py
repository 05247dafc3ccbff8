"""A few registered queries against their SQL on the smallest tables, and the driver's contract."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.queries import REGISTRY
from verify import normal

D = Path("/root/testdata/sf0.001")
NAMES = ["p2_found", "p3_found", "p5_found", "panel_target_join", "genome_bins", "map_interpolate", "hmm_posterior", "sfs_m_step_eb", "f3", "bool_rle_smooth", "interval_overlap_genes", "md5_downsample"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in D.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


@pytest.mark.skipif(not D.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    f, sql = REGISTRY[name]
    assert normal(f(spark, str(D)).toPandas()) == normal(con.execute(sql).df())


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(REGISTRY) > 100


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).parent
    for p in (root / "strandline").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"strandline\.llm|from \.+llm", p.read_text()), p
