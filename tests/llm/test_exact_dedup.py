import random

from pyspark.sql import functions as F

from quillmere.llm import exact_dedup as E


def brute(rows):
    """rows of (doc_id, text, ...); smallest id of each text, nulls last; all null texts."""
    best = {}
    for r in rows:
        if r[1] is not None:
            k = (r[0] is None, r[0] if r[0] is not None else 0, r[2:])
            if r[1] not in best or k < best[r[1]][0]:
                best[r[1]] = (k, r)
    return sorted([r for _, r in best.values()] + [r for r in rows if r[1] is None], key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", "a", "A", "a ", "long " * 40_000, "é", "é", None, "x\ny"]
    rows = [(rnd.choice([None, *range(20)]), rnd.choice(texts), rnd.randrange(3)) for _ in range(300)]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)


def test_collisions_are_split_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(E, "content_hash", lambda text: F.lit(b"0" * 16))
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in E.exact_dedup(df, copies_col="k").collect()) == [(1, "a", 2), (3, "b", 1)]


def test_clashing_columns_and_maps_stay(spark):
    rows = [(1, "a", {"k": 1}, "x", "h"), (2, "a", {"k": 2}, "y", "i"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `__qm_row` string, `a.b c` string")
    out = E.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted([tuple(r) for r in out.collect()], key=repr) == sorted([rows[0], rows[2]], key=repr)


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string, a int"), copies_col="n").collect() == []


def test_number_of_copies_beside_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), ("4", "", "w")][:3], "doc_id long, text string, N_copies string")
    out = E.exact_dedup(df, copies_col="n_copies")
    assert out.columns == ["doc_id", "text", "N_copies", "n_copies_1"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == [(1, "a", "x", 2), (3, None, "z", 1)]
