"""The SQL of the scores weighs columns by the roles that `infer_roles` finds."""

import duckdb
import pytest

from entry_queries.oracle import ROLE_WEIGHT, oracle
from entry_queries.record_queries import RECORD_ORACLE
from entry_queries.views import TABLES


def found_roles():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    rows = con.execute(f"SELECT asset, \"column\", role FROM ({oracle()['infer_roles']}) WHERE asset LIKE 'dirty_%'").fetchall()
    return {(t, c): role for t, c, role in rows}


@pytest.mark.parametrize("name", ["score_records", "score_tables"])
def test_scores_weigh_columns_by_their_inferred_roles(name):
    sql = (oracle() | RECORD_ORACLE)[name]
    for (t, c), role in found_roles().items():
        assert f"WHEN asset = '{t}' AND col = '{c}' THEN {ROLE_WEIGHT[role]}" in sql, (t, c, role)
