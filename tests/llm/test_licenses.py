import random
import re

import pytest

from quillmere.llm import licenses as L

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean plain quarry ridge slope trail".split()


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def brute(rows, templates=L.TEMPLATES):
    """Every k-gram of every text against every k-gram of every template."""
    out = set()
    for i, t in rows:
        if i is None or t is None:
            continue
        have = words(t)
        for name, tt in templates.items():
            want = words(tt)
            k = 2 if len(want) < 12 else 3 if len(want) < 40 else 4
            where = {}
            for q in range(len(want) - k + 1):
                where.setdefault(tuple(want[q : q + k]), []).append(q)
            hits = sorted((p - q, p, q) for p in range(len(have) - k + 1) for q in where.get(tuple(have[p : p + k]), ()))
            groups, near = [], max(1, len(want) * 2 // 5)
            for h in hits:
                if groups and h[0] - groups[-1][-1][0] <= near:
                    groups[-1].append(h)
                else:
                    groups.append([h])
            for g in groups:
                by = {}
                for d, p, q in g:
                    by.setdefault(d, []).append((p, q))
                starts = {max(min(x)[0] - min(x)[1], 0) for x in by.values()}
                ends = {min(max(x)[0] + len(want) - max(x)[1], len(have)) for x in by.values()}
                spans = [(lcs(want, have[lo:hi]) / max(len(want), hi - lo), -lo, -hi) for lo in starts for hi in ends if hi > lo]
                if spans and max(spans)[0] >= L.MIN_SIMILARITY:
                    same, lo, hi = max(spans)
                    out.add((i, name, -lo, -hi, len({(p, p - q) for _, p, q in g}), round(same, 6)))
    return out


def every_span(have, want):
    """All (similarity, start, end) that reach the least similarity, over all spans of the text."""
    out = []
    for a in range(len(have)):
        best = [0] * (len(want) + 1)
        for b in range(a, min(len(have), a + 2 * len(want))):
            row = [0]
            for j, y in enumerate(want):
                row.append(best[j] + 1 if have[b] == y else max(best[j + 1], row[j]))
            best = row
            if (same := best[-1] / max(len(want), b + 1 - a)) >= L.MIN_SIMILARITY:
                out.append((same, a, b + 1))
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, template string")
    return {(*tuple(r)[:5], round(r["similarity"], 6)) for r in L.license_spans(df, **how).collect()}


def corpus():
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(80))]
        if i % 2:
            p = list(rnd.choice(list(L.TEMPLATES.values())).split())
            for _ in range(len(p) // 12):  # words changed, put in or left out
                at = rnd.randrange(len(p))
                p[at : at + rnd.randrange(2)] = [rnd.choice(WORDS)] * rnd.randrange(2)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rnd.random() < 0.2 else x for x in p]
        rows.append((i, " ".join(w)))
    notice = L.TEMPLATES["mit-notice"]
    return rows + [(None, notice), (100, None), (101, ""), (102, "Released under"), (103, f"{notice} {notice}. {notice}"), (104, "amber " * 50_000 + notice), (105, notice), (105, notice)]


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert found(spark, rows) == want
    assert sum(i == 103 for i, *_ in want) == 3 and sum(i == 104 for i, *_ in want) == 1


def test_changed_passages_against_all_spans(spark):
    """Whatever span of a text is like enough to a template, a passage is found there."""
    rnd = random.Random(6)
    rows = [(0, "Released under MIT License"), (1, "Released under an MIT License"), (2, "licensed under dd BY-NC 4.0"), (3, "x Licensed under the Apache License, 2.0 y"), (4, "Released zz under the MIT License released")]
    for i in range(5, 120):
        p = rnd.choice([t for t in L.TEMPLATES.values() if len(words(t)) < 40]).split()
        for _ in range(rnd.randrange(1 + len(p) // 4)):
            at = rnd.randrange(len(p))
            p[at : at + rnd.randrange(2)] = [rnd.choice(WORDS)] * rnd.randrange(2)
        rows.append((i, " ".join([rnd.choice(WORDS) for _ in range(rnd.randrange(4))] + p + [rnd.choice(WORDS) for _ in range(rnd.randrange(4))])))
    got = found(spark, rows)
    checked = 0
    for i, t in rows:
        for name, tt in L.TEMPLATES.items():
            if len(words(tt)) < 40 and (spans := every_span(words(t), words(tt))):
                _, lo, hi = max(spans)
                checked += 1
                assert any(g[0] == i and g[1] == name and g[2] < hi and lo < g[3] for g in got), (t, name)
    assert checked > 60 and {0, 1, 2, 3, 4} <= {g[0] for g in got}


def test_full_texts_and_ids_that_are_not_numbers(spark):
    rnd = random.Random(7)
    rows, want = [], set()
    for name, t in L.FULL_TEXTS.items():
        w = t.split()
        for _ in range(len(w) // 25):
            w[rnd.randrange(len(w))] = "other"
        rows.append((f"d-{name}", "some words before " + " ".join(w) + " and after"))
        want.add((f"d-{name}", name))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert want <= {(r["doc_id"], r["template"]) for r in L.license_spans(df).collect()}


def test_texts_that_share_an_id(spark):
    notice = L.TEMPLATES["mit-notice"]
    assert {g[:4] for g in found(spark, [(1, notice), (1, "amber " + notice)])} == {(1, "mit-notice", 0, 5), (1, "mit-notice", 1, 6)}


def test_counts_of_the_corpus(spark):
    want = brute(corpus())
    assert len({i for i, *_ in want if i < 60}) >= 24 and all(i % 2 for i, *_ in want if i < 60)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert found(spark, rows) == brute(rows)


def test_empty_and_short_templates(spark):
    assert found(spark, [(1, None)]) == set()
    assert L.license_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert found(spark, [(1, "x")], templates={}) == set()
    with pytest.raises(ValueError):
        found(spark, [(1, "x")], templates={"a": "one"})


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    licensed = [(i, t) for i, t in rows if re.search("licen[sc]|permission|redistribut", t or "", re.I)]
    got = {tuple(r) for r in L.op10_license_scan(spark, sf_dir).collect()}
    assert got == brute(licensed)
