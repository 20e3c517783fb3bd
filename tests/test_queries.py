"""Every query against its SQL on the smallest tables."""

import pytest

from tests.helpers import connection

FOLDER = "/root/testdata/sf0.001"


def _cases():
    from sigweave import catalog

    sql = catalog.oracle_sql()
    return [(n, f, sql.get(n)) for n, f in catalog.queries().items()]


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name,query,sql", _cases(), ids=lambda x: x if isinstance(x, str) and " " not in x else "")
def test_query(spark, con, name, query, sql):
    from tests.helpers import compare

    if sql:
        compare(spark, con, query, sql, FOLDER)
    else:
        assert query(spark, FOLDER).count() > 0
