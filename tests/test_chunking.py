import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import chunking as C

SMALL = C.Options(least=50, most=200)


def run(text, options=SMALL, name="doc"):
    return C.chunk_text(name, text, options)


def test_headings_make_paths_and_crumbs():
    body = "x" * 60
    got = run(f"# A\n\n{body}\n\n## B\n\n{body}\n\n# C\n\n{body}")
    assert [p.section for p in got] == [["A"], ["A", "B"], ["C"]]
    assert got[1].breadcrumb == "[doc > A > B]" or "A > B" in got[1].breadcrumb
    assert [p.chunk_index for p in got] == [0, 1, 2]


def test_a_tail_of_headings_alone_is_dropped():
    assert len(run("# A\n\n" + "x" * 60 + "\n\n## B\n\n### C")) == 1


def test_long_table_is_split_with_its_header():
    rows = [f"| r{i} | v{i} | w{i} | z{i} |" for i in range(40)]
    got = run("| Col | Val | W | Z |\n|---|---|---|---|\n" + "\n".join(rows))
    assert got[0].content.startswith("[TABLE:start]") and got[-1].content.endswith("[TABLE:end]")
    assert all("| Col | Val | W | Z |" in p.content for p in got)
    assert "col: r0 | val: v0" in got[0].embedding_content
    assert all(sum(r in p.content for p in got) == 1 for r in rows)


def test_long_list_is_split():
    got = run("\n".join(f"- Item number {i}" for i in range(50)))
    assert got[0].content.startswith("[LIST:start]") and got[-1].content.endswith("[LIST:end]") and len(got) > 3


def test_long_prose_is_marked_as_continued():
    got = run(" ".join(f"This is sentence number {i}." for i in range(40)))
    assert [p.paragraph_continuation for p in got][:3] == [False, True, True]
    assert all(len(p.content) <= 200 for p in got)


def test_offsets_are_bytes_of_the_first_place():
    text = "é" * 60 + "\n\n" + "b" * 190 + "\n\n" + "c" * 190
    got = run(text)
    raw = text.encode()
    assert [raw[p.source_offset :][:1] for p in got] == ["é".encode()[:1], b"b", b"c"]
    assert got[0].source_length == len(got[0].content.encode())


def test_sheet_resets_the_path():
    got = run("# A\n\n" + "x" * 60 + "\n\n[Sheet: Sales]\n\n" + "y" * 60)
    assert got[-1].section == ["Sales"]


def test_overlap_repeats_the_end_of_the_one_before():
    o = C.Options(least=50, most=200, overlap=30)
    got = run("\n\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)), o)
    assert all(b.content.startswith(C.tail_of(a.content, 30)) for a, b in zip(got, got[1:]))


def test_crumbs_are_compressed_in_the_middle():
    assert "..." in C.compress(["document", "first chapter", "second section", "last part"], 40)
    assert C.compress(["a", "b"], None) == C.compress(["a", "b"], 1000)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["# H", "## Sub head", "| a | b |", "- item", "word " * 30, "Short one.", "x" * 300, "", "[Sheet: s]", "é ü. " * 20]), max_size=14), st.sampled_from(["\n", "\n\n"]))
def test_pieces_are_numbered_bounded_and_keep_the_prose(blocks, joiner):
    text = joiner.join(blocks)
    got = run(text)
    assert [p.chunk_index for p in got] == list(range(len(got)))
    for p in got:
        assert len(p.content) <= 230 + 60 or any(len(w) > 200 for w in p.content.split()) or p.content.startswith("[")
    whole = " ".join(p.content for p in got)
    assert all(w in whole for b in blocks if not b.startswith(("#", "[")) for w in b.split() if w.isalpha())


def test_promoted_headers():
    text = "It ended there. Why did it end? Nobody knew the reason. Home of the brave The travellers went on for days."
    got = C.promote_headers(text, C.Options(promote=True))
    assert "## Why did it end?" in got and "## Home of the brave" in got
    book = "x. CHAPTER I THE START It began. " + "a b c. " * 80 + "CHAPTER II THE END It stopped."
    assert "## CHAPTER I: THE START" in C.promote_levels(book, C.PROSE_LEVELS)
    toc = "CHAPTER I ONE CHAPTER II TWO " + "text. " * 100
    assert "#" not in C.promote_levels(toc, C.PROSE_LEVELS)


def test_table_operator_keeps_columns_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", "text " * 500, 7), (None, "short", 8), ("c", None, 9), ("d", "", 1)], "name string, text string, n int")
    got = C.with_ids(C.enrich(C.chunk_documents(df, "name", "text", keep=["n"]))).collect()
    assert {r["n"] for r in got} == {7, 8}
    assert all(len(r["content"]) <= 1725 for r in got) and len({r["chunk_id"] for r in got}) == len(got)
    assert C.chunk_documents(df.limit(0), "name", "text").count() == 0


def test_table_function_in_sql(spark):
    spark.udtf.register("chunk_document", C.chunk_udtf())
    spark.createDataFrame([("a", "one\n\n" + "x " * 150 + "\n\n" + "y " * 150)], "n string, t string").createOrReplaceTempView("chunk_in")
    got = spark.sql("SELECT n, c.chunk_index FROM chunk_in, LATERAL chunk_document(n, t, 50, 200) c").collect()
    assert [r["chunk_index"] for r in sorted(got, key=lambda r: r["chunk_index"])] == list(range(len(got))) and len(got) > 1


@pytest.mark.parametrize("size, overlap", [(5, 0), (5, 2), (3, 9)])
def test_token_windows(spark, size, overlap):
    words = [f"w{i}" for i in range(17)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "k int, t string")
    got = sorted((r["window"], r["content"]) for r in C.token_windows(df, "k", "t", size, overlap).collect())
    assert got == [(i, " ".join(words[a : a + size])) for i, a in enumerate(range(0, 17, max(1, size - overlap)))]


def test_format_and_common_path(spark):
    df = spark.createDataFrame([(["a", "b"],)], "p array<string>")
    r = df.select(X.format_breadcrumb(F.col("p"), "symbol").alias("s"), X.lca_path(F.array(F.col("p"), F.array(F.lit("a"), F.lit("c")))).alias("l")).first()
    assert "→" in r["s"] and r["l"] == ["a"]


def test_large_batches_are_objects_in_small_slices_only(spark, monkeypatch):
    """A worker's memory doesn't grow with the rows of a batch: results come by slice, and the next slice isn't made before."""
    import pyarrow as pa

    from quillmere.operators import entities, tables
    from quillmere.sources import extract

    df, seen = spark.createDataFrame([("n", "<p>ann</p>")], "name string, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    C.chunk_documents(df, "name", "text")
    entities.match_entities(df, entities.Matcher.vocabulary([entities.Entity("ann", "ann", "Ann")]), "name", "text")
    entities.model_entities(df, lambda t: [("ann", "x", 0, 3)], None, "name", "text")
    assert len(seen) == 3
    for f in seen:
        for text, least in (("ann is here", 256), ("ann " + "x " * 500_000, 4)):
            n, given = 600 if least == 256 else 12, []
            batch = pa.RecordBatch.from_arrays([pa.array(str(i) for i in range(n)), pa.array([text] * n)], names=["a", "__text"])
            got = f(given.append(1) or batch for _ in range(2))
            one = next(got)
            assert len(given) == 1 and len(set(one.column(0).to_pylist())) <= least
            rest = list(got)
            assert {x for b in (one, *rest) for x in b.column(0).to_pylist()} == set(map(str, range(n)))
    monkeypatch.undo()
    big = pa.array(["x" * 1_000_000] * 9 + [None])
    assert [len(t) for t in tables.parts(big)] == [4, 4, 2] and not list(tables.parts(pa.array([], pa.string())))
    pages = spark.createDataFrame([(i, None if i % 7 == 0 else f"<p>{i}</p>") for i in range(700)], "id int, html string").coalesce(1)
    assert {r["id"]: r["markdown"] for r in extract.html_documents(pages, "id", "html").collect()} == {i: None if i % 7 == 0 else extract.html_to_markdown(f"<p>{i}</p>") for i in range(700)}
