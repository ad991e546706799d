import random

import numpy as np
import pytest

from quillmere.llm import line_dedup as L


def brute(rows):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            if any(ord(c) > 32 for c in line):
                seen.setdefault(line, (i, k))
    for i, t in rows:
        if i is None or t is None:
            out.setdefault((i, t), (t, 0))
            continue
        keep = [line for k, line in enumerate(t.split("\n")) if not any(ord(c) > 32 for c in line) or seen[line] == (i, k)]
        out[i, t] = "\n".join(keep), len(t.split("\n")) - len(keep)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    lines = ["", " ", "\t", "menu | home", "copyright", "Copyright", "ünï", "menu | home ", *(f"line {i}" for i in range(40))]
    return [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(9)))) for i in range(80)] + [(None, "copyright"), (500, None), (501, ""), (502, "\n\n"), (503, "a " * 200_000 + "\ncopyright\nmenu | home")]


WAYS = {"sent": {}, "shards": {"SHARD_BITS": 1 << 8, "HELD_LINES": 50}, "lines go to the filter": {"FILTER_BYTES": 0, "SHARD_BITS": 1 << 8}}


@pytest.fixture(params=WAYS)
def way(request, monkeypatch):
    for name, value in WAYS[request.param].items():
        monkeypatch.setattr(L, name, value)


def test_against_brute_force(spark, way):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")
    out = L.line_dedup(df)
    assert out.columns == ["doc_id", "text", "n_removed", "n_removed_1"]
    got, want = out.collect(), brute(rows)
    assert sorted(((r["doc_id"], r["text"], r["n_removed_1"]) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t in rows), key=repr)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that holds everything makes every line a suspect; the exact check decides."""
    full = lambda texts, n: (spark.createDataFrame([(0, b"\xff" * (L.SHARD_BITS // 8))], "shard int, twice binary"), 1)
    monkeypatch.setattr(L, "twice_filter", full)
    rows = corpus(3)
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t in rows), key=repr)


def test_parts_of_the_filters_meet():
    """Lines of two tasks, or twice in one, are in the twice-filter; few others are."""
    rng = np.random.default_rng(1)
    shared, mine, other, double = (rng.integers(0, 2**63, 2000).astype(np.uint64) for _ in range(4))
    once, twice = (np.zeros(L.SHARD_BITS // 8, np.uint8) for _ in range(2))
    L.note(once, twice, np.r_[shared, mine, double, double])
    L.note(once, twice, np.r_[shared, other])
    assert L.holds(twice, L.places(np.r_[shared, double])).all()
    assert L.holds(twice, L.places(np.r_[mine, other])).mean() < 0.05
    assert L.holds(once, L.places(np.r_[shared, mine, other, double])).all()


def test_filter_at_its_load():
    """At so many bits a line, few lines that don't repeat are suspects."""
    h = np.random.default_rng(2).integers(0, 2**63, 2 * L.SHARD_BITS // L.BITS_A_LINE).astype(np.uint64) * np.uint64(2)
    assert np.bincount(L.shard_of(h, 2)).min() > 0.4 * len(h)
    h = h[L.shard_of(h, 2) == 0]
    once, twice = (np.zeros(L.SHARD_BITS // 8, np.uint8) for _ in range(2))
    for part in np.array_split(h, 7):
        L.note(once, twice, part)
    assert L.holds(twice, L.places(h)).mean() < 0.02


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "b\nc")], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.line_dedup(df).collect()) == [(1, "a\nb", 0), (1, "a\nb", 0), (2, "c", 1)]


def test_repeated_ids_with_other_texts(spark, way):
    df = spark.createDataFrame([(0, "a"), (1, "a\nq"), (1, "z\nq")], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.line_dedup(df).collect()) == [(0, "a", 0), (1, "q", 1), (1, "z\nq", 0)]


def test_ids_that_are_not_numbers(spark, way):
    df = spark.createDataFrame([("b", "x\n1:y"), ("a", "1:y"), ("c", "x")], "doc_id string, text string")
    assert sorted(tuple(r) for r in L.line_dedup(df).collect()) == [("a", "1:y", 0), ("b", "x", 1), ("c", "", 1)]


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
