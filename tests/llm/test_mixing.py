import hashlib
import random

import pytest

from quillmere.llm import mixing as M

SCHEDULES = {"a": ((0.0, 0.7), (0.5, 0.1), (1.0, 0.4)), "z": ((0.0, 0.0), (1.0, 0.0))}
DEFAULT = ((0.0, 0.1), (1.0, 0.5))


def brute(rows, schedules, default, budget=None, steps=20_000):
    """Positions by numeric integration of the shares; rows of (id, source, tokens)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    budget = budget or sum(max(r[2] or 1, 1) for r in rows)
    knots = M.knots_of(schedules, default)

    def weight(s, t):
        return M._at(schedules.get(s, default), t)

    def share(s, t):
        k = max(i for i in range(len(knots) - 1) if knots[i] <= t)
        at = [weight(s, x) / (sum(weight(o, x) for o in sources) or 1) for x in knots[k : k + 2]]
        return at[0] + (at[1] - at[0]) * (t - knots[k]) / (knots[k + 1] - knots[k])

    out = []
    for s, docs in sources.items():
        # ties of the hash (equal ids) by id, then tokens
        docs = sorted(docs, key=lambda r: (hashlib.md5(f"{M.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), max(r[2] or 1, 1)))
        area, curve = 0.0, [0.0]
        for i in range(steps):
            area += share(s, (i + 0.5) / steps) / steps
            curve.append(area)
        supply = sum(max(r[2] or 1, 1) for r in docs)
        at, epoch = 0, 0
        while supply and at < budget * area - 1e-6:
            for r in docs:
                if at >= budget * area - 1e-6:
                    break
                j = next(j for j in range(steps + 1) if j == steps or budget * curve[j + 1] > at)
                out.append((r[0], s, epoch, at, j / steps))
                at += max(r[2] or 1, 1)
            epoch += 1
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    return M.mix_sources(df, SCHEDULES, DEFAULT, "tokens", **how)


@pytest.mark.parametrize("budget", [None, 150, 4000])
def test_against_numeric_integration(spark, budget):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "z", None]), rnd.choice([None, 0, 1, 5, 40])) for i in range(60)]
    got = run(spark, rows, budget_tokens=budget).collect()
    want = sorted(brute(rows, SCHEDULES, DEFAULT, budget, 2000), key=lambda r: (str(r[1]), r[2], r[3]))
    mine = sorted(((r["doc_id"], r["source"], r["epoch"], r["offset_tokens"], r["position"]) for r in got), key=lambda r: (str(r[1]), r[2], r[3]))
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert max(abs(a[4] - b[4]) for a, b in zip(mine, want)) < 2e-3
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert not any(r["source"] == "z" for r in got)


def test_shares_follow_the_schedule(spark):
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(4000)]
    got = run(spark, rows).collect()
    for lo, hi in ((0.0, 0.1), (0.45, 0.55), (0.9, 1.0)):
        part = [r for r in got if lo <= r["position"] < hi]
        mid = (lo + hi) / 2
        w = M._at(SCHEDULES["a"], mid) / (M._at(SCHEDULES["a"], mid) + M._at(DEFAULT, mid))
        assert abs(sum(r["source"] == "a" for r in part) / len(part) - w) < 0.05


def test_repeats_clashes_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "b", 2, "x", 7), (1, "b", 2, "y", 8), (1, "b", 2, "y", 8)], "doc_id long, source string, tokens int, position string, `__qm_t` int")
    out = M.mix_sources(df, {}, DEFAULT, "tokens")
    rows = out.collect()
    assert out.columns == ["doc_id", "source", "tokens", "position", "__qm_t", "epoch", "offset_tokens", "position_1"]
    assert sorted((r["doc_id"] or 0, r["position"]) for r in rows) == [(0, "x"), (1, "y"), (1, "y")]
    assert sorted(r["offset_tokens"] for r in rows) == [0, 2, 4] and {r["epoch"] for r in rows} == {0}
    assert M.mix_sources(df.limit(0), SCHEDULES, DEFAULT, "tokens").collect() == []
