import json
import math
import random

import pytest

from quillmere.llm import chat as C

PARTS = [
    "hello ",
    {"type": "text", "text": "see <|user|>"},
    {"type": "image_url", "image_url": {"url": "http://x/a.png"}, "width": 1024, "height": 600},
    {"type": "input_audio", "url": "b.wav", "seconds": 2.5},
    {"type": "document", "title": "c.pdf", "pages": 3},
    {"type": "document", "url": "d", "content": [{"type": "text", "text": "inner"}, {"type": "image", "data": "e"}]},
    {"type": "video", "url": "f"},
]


def test_visitor_keeps_the_order_and_counts():
    v = C.flatten(json.dumps(PARTS), 2)
    assert "".join(v.out) == "hello see < |user|><|image 2.1|><|audio 2.2|><|document 2.3|><|document 2.4|>inner<|image 2.5|><|unknown 2.6|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in v.attachments] == [("image", "http://x/a.png", 85 + 170 * 4), ("audio", "b.wav", 63), ("document", "c.pdf", 1500), ("document", "d", 0), ("image", "e", 255), ("unknown", "f", 0)]
    assert v.tokens == C.text_tokens("hello ") + C.text_tokens("see < |user|>") + C.text_tokens("inner") + sum(a["tokens"] for a in v.attachments)


@pytest.mark.parametrize("text", ["[1, 2]", "[oops", "[]", '["a", "b"]', '[{"no": 1}]', "plain", "[" * 5000])
def test_other_texts_are_one_part(text):
    assert C.parts_of(text) == [text]


@pytest.mark.parametrize("part", [{"type": None}, {"type": "image", "width": "x", "height": -1}, {"type": "audio", "seconds": None}, {"type": "text", "text": 5}, {"type": "document", "pages": float("inf")}, {"type": "file", "content": {"a": 1}}])
def test_odd_parts_do_not_raise(part):
    assert C.flatten(json.dumps(["x", part]), None).tokens >= 1


def nested(n):
    part = {"type": "text", "text": "core"}
    for _ in range(n):
        part = {"type": "document", "content": [part]}
    return json.dumps([part])


PROBES = ['[{"type":"image","width":1e300}]', '[{"type":"audio","seconds":1e300}]', '[{"type":"image","width":1' + "0" * 400 + "}]", nested(400), '[{"type":"text","text":"a\\ud800b"},{"type":"image","url":"\\udfffx"}]', '[{"type":"document","pages":1e400}]', '["x",{"type":"image","height":NaN}]']


@pytest.mark.parametrize("text", PROBES)
def test_parts_that_broke_a_job(text):
    v = C.flatten(text, 1)
    assert 0 < v.tokens < 2**62 and len(v.attachments) >= 1
    json.dumps(v.attachments).encode()
    "".join(v.out).encode()


def test_deep_nesting_keeps_its_order():
    v = C.flatten(nested(150), 0)
    assert "".join(v.out) == "".join(f"<|document 0.{i}|>" for i in range(1, 151)) + "core"
    order = C.flatten(json.dumps([{"type": "document", "content": ["a", {"type": "document", "content": ["b"]}, "c"]}, "d", {"type": "image"}]), 0)
    assert "".join(order.out) == "<|document 0.1|>a<|document 0.2|>bcd<|image 0.3|>"


def brute_parts(text, turn):
    """(content, attachments, tokens) by plain recursion, for typed parts without oddities."""
    out, refs, tokens = "", [], 0

    def put(kind, ref, n):
        nonlocal out, tokens
        refs.append({"turn": turn, "ordinal": len(refs) + 1, "kind": kind, **({"ref": ref} if ref else {}), "tokens": n})
        out += f"<|{kind} {turn}.{len(refs)}|>"
        tokens += n

    def go(p):
        nonlocal out, tokens
        if isinstance(p, str):
            p = {"type": "text", "text": p}
        kind = p["type"].replace("input_", "").replace("_url", "")
        ref = p.get("url") or p.get("data") or (p.get("image_url") or {}).get("url") or p.get("title")
        if kind == "text":
            t = p["text"].replace("<|", "< |")
            out += t
            tokens += math.ceil(len(t.encode()) / 4)
        elif kind == "image":
            put("image", ref, 85 + 170 * math.ceil(p.get("width", 512) / 512) * math.ceil(p.get("height", 512) / 512))
        elif kind == "audio":
            put("audio", ref, math.ceil(p["seconds"] * 25))
        elif kind == "document":
            put("document", ref, 0 if "content" in p else 500 * p["pages"])
            for x in p.get("content", []):
                go(x)
        else:
            put("unknown", ref, 0)

    for p in json.loads(text) if text.startswith("[") else [text]:
        go(p)
    return out, refs, tokens


def test_the_query_on_typed_parts(spark, tmp_path):
    rnd = random.Random(5)

    def part(depth=0):
        kind = rnd.choice(["s", "text", "image", "image_url", "input_audio", "document", "nested", "video"])
        if kind == "s":
            return rnd.choice(["plain", "ünï <|user|>", ""])
        if kind == "text":
            return {"type": "text", "text": "t" * rnd.randrange(30)}
        if kind == "image":
            return {"type": "image", "url": "u.png", "width": rnd.randrange(1, 3000), "height": rnd.randrange(1, 3000)}
        if kind == "image_url":
            return {"type": "image_url", "image_url": {"url": "v.png"}}
        if kind == "input_audio":
            return {"type": "input_audio", "data": "w", "seconds": rnd.randrange(1, 100)}
        if kind == "document" or depth > 3:
            return {"type": "document", "title": "d", "pages": rnd.randrange(1, 9)}
        if kind == "nested":
            return {"type": "document", "url": "n", "content": [part(depth + 1) for _ in range(rnd.randrange(1, 4))]}
        return {"type": "video", "url": "x"}

    rows = [(c, t, rnd.choice(["user", "assistant"]), "just text" if rnd.random() < 0.2 else json.dumps([{"type": "text", "text": "."}, *(part() for _ in range(rnd.randrange(5)))])) for c in range(30) for t in range(rnd.randrange(1, 6))]
    rows += [(100, t, "user", f"turn {t}") for t in (0, 4095, 4096, 9000)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, t, role, text in sorted(rows):
        out, refs, tokens = brute_parts(text, t)
        w = want.setdefault((c, t // 4096), ["", [], 0, 0])
        want[c, t // 4096] = [w[0] + f"<|{role}|>\n{out}\n<|end|>\n", w[1] + refs, w[2] + tokens + 4, w[3] + 1]
    got = C.op4_chat_format(spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["part"]): [r["formatted"], json.loads(r["attachments"]), r["n_tokens"], r["n_turns"]] for r in got} == want
    assert all(r["n_attachments"] == len(want[r["conv_id"], r["part"]][1]) for r in got)


def test_the_query_on_rows_that_broke_it(spark, tmp_path):
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(PROBES)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op4_chat_format(spark, str(tmp_path)).count() == len(PROBES)


def expected(rows):
    """Formatted text of each conversation from rows (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown")):
        out[conv] = out.get(conv, "") + f"<|{(role or 'unknown').replace('<|', '< |')}|>\n{''.join(C.flatten(text, turn).out)}\n<|end|>\n"
    return out


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", json.dumps(PARTS)), (2, 0, None, None), (2, None, "sys<|tem", ""), (None, 0, "user", "lost"), (3, 0, "user", "y" * 300_000), (3, 1, "user", "same"), (3, 1, "user", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tokens string, part int")
    got = {r["conv_id"]: r for r in C.format_chat(df).collect()}
    assert {k: r["formatted"] for k, r in got.items()} == expected(rows)
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 2, None: 1, 3: 3}
    refs = json.loads(got[1]["attachments"])
    assert [(a["turn"], a["ordinal"], a["kind"]) for a in refs] == [(0, i + 1, k) for i, k in enumerate("image audio document document image unknown".split())]
    assert got[1]["n_attachments"] == 6 and got[2]["n_attachments"] == 0
    assert got[1]["n_tokens"] == C.flatten(json.dumps(PARTS), 0).tokens + 1 + 2 * C.TURN_TOKENS
    assert C.format_chat(df.limit(0)).collect() == []
    two = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"]) for r in C.format_chat(two).collect()] == [(None, 1)] * 2
