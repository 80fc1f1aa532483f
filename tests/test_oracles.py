"""Every query of the library against its SQL, on the smallest tables; queries without SQL must give rows."""

from __future__ import annotations

import pytest
from oracle import spark_rows, sql_rows

from bitloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Row counts that may be zero on the smallest tables.
MAY_BE_EMPTY = {"j15_repair_report", "p2_search_keeps_ancestors", "g4_flood_fill"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name: str) -> None:
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == sql_rows(ORACLE_SQL[name], SF)
    assert got[1] or name in MAY_BE_EMPTY
