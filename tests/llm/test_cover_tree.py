import numpy as np
import pytest

from quillmere.llm import cover_tree as C


def brute(rows, k, asked=None):
    """Top k of every query by cosine rounded to 6 digits, then id; rows of (id, vector)."""
    data = {}
    for i, v in rows:
        if i is not None and v is not None and (i not in data or list(v) < list(data[i])):
            data[i] = v
    ask = data if asked is None else dict(asked)
    names = sorted(data)
    unit = lambda vs: (m := np.array([np.float32(v) for v in vs], float)) / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit(list(ask.values())) @ unit([data[j] for j in names]).T, 6) + 0.0
    out = []
    for row, i in zip(score, ask):
        best = [n for n in np.argsort(-row, kind="stable") if asked is not None or names[n] != i][:k]
        out += [(i, names[n], r + 1, row[n]) for r, n in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "CELL_ROWS", 64)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 8)) if kind == "spread" else rng.normal(size=(9, 8))[rng.integers(0, 9, 900)] + rng.normal(size=(900, 8)) * 0.05
    rows = list(enumerate(v))
    close(sorted(tuple(r) for r in C.top_k(frame(spark, rows), 7).collect()), brute(rows, 7))


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_many_groups_and_tasks(spark, monkeypatch, kind):
    """Queries in several groups, and a group's data in several tasks."""
    monkeypatch.setattr(C, "CELL_ROWS", 32)
    monkeypatch.setattr(C, "GROUP_BYTES", 8 * 4 * 40)
    monkeypatch.setattr(C, "PART_BYTES", 8 * 4 * 150)
    monkeypatch.setattr(C, "SEED_ROWS", 16)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 8)) if kind == "spread" else rng.normal(size=(9, 8))[rng.integers(0, 9, 600)] + rng.normal(size=(600, 8)) * 0.05
    rows = list(enumerate(v))
    asked = [r for r in rows if r[0] % 5 == 0]
    got = sorted(tuple(r) for r in C.top_k(frame(spark, rows), 6, queries=frame(spark, asked), skip_self=True).collect())
    close(got, [r for r in brute(rows, 6) if r[0] % 5 == 0])


@pytest.mark.parametrize("names", ["doc-{:04}", "{:04}x"])
def test_ids_that_are_not_numbers(spark, names):
    rng = np.random.default_rng(9)
    rows = list(enumerate(np.round(rng.normal(size=(60, 3)), 1)))
    df = spark.createDataFrame([(names.format(i), [float(x) for x in v]) for i, v in rows] + [(None, [1.0, 2.0, 3.0])], "vec_id string, embedding array<float>")
    got = sorted(tuple(r) for r in C.top_k(df, 3).collect())
    close(got, [(names.format(a), names.format(b), r, s) for a, b, r, s in brute(rows, 3)])
    some = C.top_k(df, 3, queries=df.filter("vec_id < 'doc-0005'"), skip_self=True)
    assert some.schema["id"].dataType.simpleString() == some.schema["neighbor_id"].dataType.simpleString() == "string"


def test_the_query_on_the_given_embeddings(spark, sf_dir):
    """Brute force in numpy, and how many pairs the search compares."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in C.op1_cover_tree_top_k(spark, sf_dir).collect())
    close(got, [r for r in brute(rows, 10) if r[0] % C.ASK_EVERY == 0])
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = C.Search(np.arange(len(v)), v, 10, True)
    s.add(np.arange(len(v)), v)
    assert s.compared <= len(v) ** 2  # most of these vectors have no neighbourhood: nearly all pairs are needed


def test_other_queries(spark):
    rng = np.random.default_rng(5)
    rows, ask = list(enumerate(rng.normal(size=(300, 5)))), [(i + 1000, v) for i, v in enumerate(rng.normal(size=(40, 5)))]
    close(sorted(tuple(r) for r in C.top_k(frame(spark, rows), 4, queries=frame(spark, ask)).collect()), brute(rows, 4, ask))


def test_nulls_ties_repeats_and_other_lengths(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(5, one), (3, [2.0, 0.0, 0.0]), (9, one), (9, one), (7, [0.0, 1.0, 0.0]), (None, one), (1, None), (2, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (8, [1.0, 0.0])]
    got = sorted(tuple(r) for r in C.top_k(frame(spark, rows), 10).collect())
    valid = [(i, v) for i, v in rows if i in (3, 5, 7, 9)]
    close(got, brute(valid, 10))
    assert [r[1] for r in got if r[0] == 9] == [3, 5, 7]


def test_null_elements_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, None], 3), (2, [1.0, 1.0], 4), (3, [1.0, 2.0], 5)], "vec_id long, embedding array<float>, cell int")
    assert [(r["id"], r["neighbor_id"]) for r in sorted(C.top_k(df, 3).collect())] == [(2, 3), (3, 2)]
    assert C.top_k(df.limit(0), 3).collect() == []
    assert C.top_k(df, 3, queries=df.limit(0)).collect() == []


def test_nodes_are_pruned():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 6))[np.repeat(np.arange(40), 500)] + rng.normal(size=(20_000, 6)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = C.Search(np.arange(20_000), v, 5, True)
    s.add(np.arange(20_000), v)
    assert s.compared < 0.1 * 20_000**2
    some = rng.integers(0, 20_000, 50)
    place = {int(i): n for n, i in enumerate(s.ids)}
    for i in some:
        c = np.round(v @ v[i], C.DIGITS)
        c[i] = -9
        assert s.found[place[int(i)]].tolist() == np.lexsort((np.arange(20_000), -c))[:5].tolist()


def test_bounds_known_before_save_comparisons():
    rng = np.random.default_rng(10)
    v = rng.normal(size=(3000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    plain = C.Search(np.arange(3000), v, 5, True)
    plain.add(np.arange(3000), v)
    kth = np.empty(3000)
    kth[plain.ids] = plain.score[:, -1]
    seeded = C.Search(np.arange(3000), v, 5, True, kth)
    seeded.add(np.arange(3000), v)
    assert seeded.compared <= plain.compared and np.array_equal(seeded.found, plain.found)


def test_what_radii_cannot_prune_is_compared_in_large_blocks(monkeypatch):
    """Vectors spread over a sphere of many dimensions: whole blocks, not thousands of pairs of small leaves."""
    v = np.random.default_rng(12).normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    calls, leaf = [], C.Search.leaf
    monkeypatch.setattr(C.Search, "leaf", lambda self, *args: (calls.append(1), leaf(self, *args)))
    s = C.Search(np.arange(1500), v[:1500], 5, True)
    s.add(np.arange(6000), v)
    assert len(calls) <= 30 and s.compared == 1500 * 6000
    score = np.round(v[:1500] @ v.T, C.DIGITS)
    score[np.arange(1500), np.arange(1500)] = -9
    assert s.found[np.argsort(s.ids)].tolist() == [np.lexsort((np.arange(6000), -row))[:5].tolist() for row in score]


def test_first_bounds_are_found_by_cell_in_several_tasks(spark, monkeypatch):
    """Queries meet the sample of their own cell, not every sample of their group in one task."""
    monkeypatch.setattr(C, "CELL_ROWS", 64)
    seen, compared = [], C._compared

    def spy(ask, data, tasks, *args):
        pairs = ask.groupBy("task").count().join(data.groupBy("task").agg({"id": "count"}), "task").collect()
        seen.append((tasks, sum(r[1] * r[2] for r in pairs)))
        return compared(ask, data, tasks, *args)

    monkeypatch.setattr(C, "_compared", spy)
    rows = list(enumerate(np.random.default_rng(13).normal(size=(900, 8))))
    asked = [r for r in rows if r[0] % 5 == 0]
    got = sorted(tuple(r) for r in C.top_k(frame(spark, rows), 6, queries=frame(spark, asked), skip_self=True).collect())
    close(got, [r for r in brute(rows, 6) if r[0] % 5 == 0])
    (tasks, pairs), _ = seen
    assert tasks > 1 and pairs < 900 * 180 / 4


def test_places():
    rng = np.random.default_rng(14)
    for shape in ((7, 16), (5, 3), (1, 8), (3, 8), (0, 8)):
        m = rng.random(shape) < 0.3
        assert all(np.array_equal(a, b) for a, b in zip(C.places(m), np.nonzero(m)))


def test_covers_are_halved():
    """Children are apart and cover; a node at its target has descendants that cover it at half its radius."""
    v = np.random.default_rng(11).normal(size=(6000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = C.CoverTree(v)
    for n, below in enumerate(t.children):
        if below:
            aim = t.radius[n] / 2 if t.radius[n] <= t.target[n] else t.target[n]
            assert all(t.target[c] == aim for c in below) and len(below) <= C.FAN
            assert sorted((t.start[c], t.stop[c]) for c in below)[0][0] == t.start[n] and sum(t.stop[c] - t.start[c] for c in below) == t.stop[n] - t.start[n]
        else:
            assert t.stop[n] - t.start[n] <= C.LEAF or t.radius[n] <= 1e-3
    assert any(t.radius[n] > t.target[n] for n in range(len(t.start))) or max(t.radius) <= 2


def test_covering_radii():
    v = np.random.default_rng(7).normal(size=(3000, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = C.CoverTree(v)
    for n in range(len(t.start)):
        d = np.linalg.norm(t.sorted[t.start[n] : t.stop[n]] - t.centre[n], axis=1)
        assert d.max() <= t.radius[n] + 1e-6
