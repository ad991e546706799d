import io
import json
import zipfile

import pytest

from quillmere.sources import extract as E, loaders, renderers


def test_html_to_markdown_strips_chrome():
    html = "<html><nav>menu</nav><h1>Title</h1><p>One <b>two</b> <a href='x'>three</a></p><ul><li>a<ul><li>b</li></ul></li></ul><pre>code</pre><table><thead><tr><th>h</th></tr></thead><tr><td>c</td></tr></table><footer>end</footer></html>"
    md = E.html(html.encode())
    assert "# Title" in md and "**two**" in md and "[three](x)" in md and "menu" not in md and "end" not in md
    assert "- a" in md and "- b" in md and "```" in md and "| h |" in md


def test_csv_and_lookup():
    data = b"name;note\nx;a|b\n;\ny;c\n"
    assert E.csv_table(data) == "| name | note |\n| --- | --- |\n| x | a\\|b |\n| y | c |"
    assert E.lookup_table(data) == "## x\nnote: a|b\n\n## y\nnote: c"
    assert E.annotate_csv(["| y | c |", "nothing"], data) == [{"row_start": 2, "row_end": 2}, None]
    assert E.csv_table("naïve,x\n1,2".encode("latin-1")).startswith("| naïve |")


def test_json_yaml_xml():
    got = E.json_text(b'{"a": {"b": [1, {"c": 2}]}, "d": null}')
    assert [x for x in got.split("\n") if x] == ["# a", "## a > b", "1", "### a > b[1]", "#### a > b[1] > c", "2", "# d"]
    jsonl = b'{"k": "one", "v": 1}\nbroken\n{"k": "two", "v": [1, 2]}\n'
    got = E.json_text(jsonl, "x.jsonl")
    assert "broken" in got and "one" in got
    assert "## two\nv: 1, 2" in E.json_text(jsonl, "x.jsonl", by_row=True, row_key="k")
    assert "# a" in E.yaml_text(b"a: 1\n---\nb: 2") and "---" in E.yaml_text(b"a: 1\n---\nb: 2")
    x = E.xml_text(b"<r xmlns='u'><a>one</a>tail<b><c>two</c></b></r>")
    assert "one" in x and "two" in x and "tail" in x and "{u}" not in x


def office(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


def test_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    got = E.docx(office({"word/document.xml": doc}))
    assert "## Head" in got and "Body" in got and "c1" in got


def test_mail_prefers_plain_text():
    raw = b"From: a@x\r\nTo: b@x\r\nSubject: =?utf-8?b?w7xi?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain\r\n--B--\r\n"
    got = E.mail(raw)
    assert "plain" in got and "html" not in got and "üb" in got


def test_python_and_java_and_typescript():
    py = E.python_code(b"import os\n\nclass A:\n    '''Doc.'''\n    def f(self):\n        return 1\n\ndef g():\n    pass\n")
    assert "## Imports" in py and "# A" in py and "## f" in py and "# g" in py
    with pytest.raises(ValueError):
        E.python_code(b"def (:")
    java = E.find_extractor("java")(b"import a.b;\n/** Doc. */\npublic class A {\n    public int f(int x) {\n        return x;\n    }\n}\n")
    ts = E.find_extractor("typescript")(b"import {a} from 'b';\nexport class A {\n  run(x: number) {\n    return x;\n  }\n}\nexport function g() {\n}\n")
    assert "A" in java and "f" in java and "run" in ts and "g" in ts


def test_extraction_keeps_errors_with_their_document(spark):
    df = spark.createDataFrame([("a.py", b"def (:"), ("b.txt", b"fine"), ("c.csv", b"h\n1"), ("d.html", None)], "path string, content binary")
    got = {r["path"]: r for r in E.extract_documents(df).collect()}
    assert got["a.py"]["error"].startswith("ValueError") and got["b.txt"]["text"] == "fine" and got["c.csv"]["text"].startswith("| h |")
    assert got["d.html"]["text"] is None and got["d.html"]["error"] is None


def test_registered_extractor_comes_first():
    mine = (lambda k: k == "odd", lambda data, path=None: "mine")
    E.register_extractor(*mine)
    try:
        assert E.find_extractor("odd")(b"") == "mine"
    finally:
        E.EXTRA.remove(mine)


def test_renderers():
    one = {"id": "CVE-2024-0001", "published": "2024-01-01", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "A flaw."}], "metrics": dict(cvssMetricV31=[dict(cvssData=dict(baseSeverity="HIGH", baseScore=8.1))]), "references": [{"url": "http://r"}]}
    cve = dict(vulnerabilities=[dict(cve=one)])
    got = E.json_text(json.dumps(cve).encode(), "cve.json", renderers=renderers.ALL)
    assert "# CVE-2024-0001" in got and "A flaw." in got and "8.1" in got and "http://r" in got
    trial = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "Study"}}}
    assert "NCT00000001" in E.json_text(json.dumps(trial).encode(), None, renderers=renderers.ALL)
    fhir = {"resourceType": "Patient", "id": "p1", "name": [{"family": "Doe", "given": ["J"]}]}
    assert "# Patient/p1" in E.json_text(json.dumps(fhir).encode(), None, renderers=renderers.ALL)


def test_filing_items():
    html = '<a href="#i1">Item 1. Business</a><a href="#i7">Item 7. Discussion</a><div id="i1"><p>We sell.</p></div><div id="i7"><p>We grew.</p></div>'
    got = E.find_extractor("edgar")(html.encode())
    assert "# Item 1." in got and "We sell." in got and "# Item 7." in got
    assert E.find_extractor("edgar")(b"<p>plain</p>") == "plain"


def test_structured_files(spark, tmp_path):
    (tmp_path / "cities.csv").write_text("city,population,area\nA,1,2.5\nB,2,3.5\n")
    (tmp_path / "u.jsonl").write_text('{"user": "x", "age": 1, "active": true}\n{"user": "y", "age": 2, "active": false}\n')
    for name, n in (("cities.csv", 4), ("u.jsonl", 4)):
        got = loaders.load_structured_file(spark, str(tmp_path / name)).collect()
        assert len(got) == n and {r["chunk_type"] for r in got} == {"db_table", "db_column"}


def test_folder_crawl_and_load(spark, tmp_path):
    for p in ("a.md", "sub/b.txt", ".git/c.txt", "node/d.txt", "e.bin"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("# T\n\nbody text of the file")
    found = loaders.crawl_folder(spark, str(tmp_path), ["md", ".txt"], ["node"])
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.md", "b.txt"]
    chunks, errors = loaders.load_folder(spark, str(tmp_path), extensions=["md"])
    assert chunks.count() == 1 and errors.count() == 0


def test_crawl_stays_in_the_domain_and_depth(spark):
    link = lambda *us: "".join(f'<a href="{u}">x</a>' for u in us)
    rows = [("http://a.com/", link("/1", "http://b.com/x", "/pic.png")), ("http://a.com/1", link("/2")), ("http://a.com/2", link("/3", "/")), ("http://a.com/3", ""), ("http://b.com/x", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: r["depth"] for r in loaders.crawl(pages, pages.limit(1).select("url"), 2).collect()}
    assert got == {"http://a.com/": 0, "http://a.com/1": 1, "http://a.com/2": 2}


def test_query_results_become_chunks(spark):
    spark.createDataFrame([(1, "n|m"), (2, None)], "id int, name string").createOrReplaceTempView("q_in")
    got = loaders.load_query(spark, "SELECT * FROM q_in", "customers", "postgresql://u:secret@h:5432/db").collect()
    assert "n\\|m" in got[0]["content"] and "secret" not in str(got[0]["source_detail"]) and got[0]["source_detail"]["query"]
    assert loaders.load_query(spark, "SELECT * FROM q_in WHERE id > 9", "none").count() == 0


def test_uris_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    spark.dataSource.register(loaders.UriDataSource)
    got = spark.read.format("uris").option("uris", f"{tmp_path}/a.txt\n{tmp_path}/missing").load().collect()
    assert sorted((bytes(r["content"]) if r["content"] else None, r["error"] is None) for r in got if r["content"])[0] == (b"hello", True)
    assert any(r["error"] for r in got)


def test_import_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "path string, target string")
    got = {r["path"]: r["depth"] for r in loaders.import_closure(edges, spark.createDataFrame([("a",)], "path string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert loaders.module_imports("import a.b\nfrom .c import d", "x.py") == ["a.b", ".c"]
