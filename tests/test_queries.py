import pytest
from oracle import compare

from tidemark.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE[name])
