"""The ten operators' queries against their SQL."""

import pytest

from quillmere.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
