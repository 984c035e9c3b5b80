"""Every registered query of the library against its SQL."""

import pytest

from tests.oracle import SF, spark_rows, sql_rows
from tidewire import catalogue

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, str(SF)))
    assert rows
    if name in catalogue.ORACLE_SQL:
        assert (columns, rows) == sql_rows(catalogue.ORACLE_SQL[name])
