import pytest

import __spark_entry__ as e
from oracle import difference


@pytest.mark.parametrize("name", sorted(n for m in e._modules() if ".llm" not in m.__name__ for n in m.oracle_sql()))
def test_query_equals_sql(spark, name):
    more, less, n = difference(spark, name)
    assert not more and not less, (n, list(more.items())[:3], list(less.items())[:3])
