"""Some queries of each kind at the smallest scale against their SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from shredloom.plans import roster, roster_io  # noqa: F401

FOLDER = Path("/root/testdata/sf0.001")
NAMES = ("shred_mixed_shapes", "events_props", "except_bare_name", "hybrid_extra", "profile_customer", "branch_vote", "union_view", "quarantine_summary", "report_diff", "review_diff_columns", "id_fallback_index", "source_json_lines", "source_gzip_lines", "source_numbering", "source_delimited", "sink_tsv", "sink_parquet_batches", "stream_micro_batches", "json_run")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = roster.QUERIES[name](spark, str(FOLDER))
    found = con.execute(roster.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == want
