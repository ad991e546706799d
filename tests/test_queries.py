"""Every registered query against its SQL; those without SQL give rows."""

import pytest

import __spark_entry__ as entry
from quillmere.plans import registry


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_ranked_chunks(spark, sf_dir):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "id", "score", "rank"} <= set(rows[0].asDict())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_without_the_training_data_folders(tmp_path):
    """The rest imports and lists its queries where those folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/quillmere", tmp_path / "quillmere", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL))], out.stderr
