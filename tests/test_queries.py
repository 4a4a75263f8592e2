import pytest
from compare import check

from weft import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.SQL[name])
