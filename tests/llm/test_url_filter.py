import random

import numpy as np
import pytest

from quillmere.llm import url_filter as U


@pytest.mark.parametrize(
    "url, host, path",
    [("HTTP://User@Sub.Ex.com:80/a/b/?q#f", "sub.ex.com", "/a/b"), ("ex.com./", "ex.com", ""), ("//ex.com/x", "ex.com", "/x"), ("http://[::1]:8/x", "[::1]", "/x"), (None, "", ""), ("", "", ""), ("  https://é.com/ü ", "é.com", "/ü")],
)
def test_split(url, host, path):
    assert U.split_url(url) == (host, path)


def brute(url, entries):
    """The most specific entry that lists a URL, by comparing it with every entry."""
    host, path = U.split_url(url)
    listed = []
    for e in {U.entry_key(x) for x in entries if x} - {""}:
        d, _, p = e.partition("/")
        if host and (host == d or host.endswith("." + d) and ("." in d or "." not in host)):
            if not p or path == "/" + p or path.startswith("/" + p + "/"):
                listed.append((bool(p), len(d), len(p), e))
    return max(listed)[3] if listed else None


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARD", 7)
    rnd = random.Random(1)
    names = [f"{a}.{b}" for a in ("ads", "x.ads", "shop", "news") for b in ("com", "co.uk", "org")]
    entries = [rnd.choice(names) + rnd.choice(["", "", "/p", "/p/q"]) for _ in range(25)] + [None, "", "HTTP://Ads.ORG/"]
    urls = ["http://" + rnd.choice(["", "www.", "a.b."]) + rnd.choice(names) + rnd.choice(["", "/", "/p", "/p/q/r?z", "/pq", ":8080/p"]) for _ in range(300)] + [None, "", "/only/path", "x" * 100_000]
    digest = U.blocklist(spark, entries)
    assert len(digest.shards) > 1
    df = spark.createDataFrame([(u, "keep") for u in urls], "url string, rule string")
    got = U.match_urls(df, digest).collect()
    assert [r["rule"] for r in got] == ["keep"] * len(urls)
    assert {r["url"]: r["rule_1"] for r in got} == {u: brute(u, entries) for u in urls}


def test_equal_keys_of_other_strings_do_not_match(spark):
    digest = U.blocklist(spark, ["ads.com", "bad.org"])
    key = U.hashes(["ads.com"])
    assert U.Prober(digest)(["ads.com"], key).tolist() == [True]
    assert U.Prober(digest)(["other.com"], key).tolist() == [False]
    assert U.Prober(digest)(["ads.com"], np.array([5], np.uint64)).tolist() == [False]


def test_extreme_keys_keep_their_order():
    keys = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (np.diff(U._signed(keys).astype(object)) > 0).all()


def test_empty_list_and_table(spark):
    df = spark.createDataFrame([("http://a.com",)], "url string")
    nothing = U.blocklist(spark, [])
    assert nothing.shards == () and U.match_urls(df, nothing).first()["rule"] is None
    assert U.match_urls(df.limit(0), U.blocklist(spark, ["a.com"])).collect() == []


def test_lists_from_a_file_and_a_table(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\nads.com   # a comment\n\n bad.org/p#x\nbad.org/q\n")
    text = U.read_list(spark, f"file://{tmp_path}/list.txt")
    assert sorted(r["entry"] for r in text.collect()) == ["ads.com", "bad.org/p#x", "bad.org/q"]
    text.write.parquet(f"{tmp_path}/list.parquet")
    assert U.read_list(spark, f"{tmp_path}/list.parquet").count() == 3
    assert sorted(r["entry"] for r in U.read_list(spark).collect()) == sorted(U._listed()) and len(U._listed()) >= 18


def test_the_query_with_another_list(spark, sf_dir, tmp_path):
    """All pages against brute force, with path rules drawn from the pages."""
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    entries = ["example.net", "ads-track.example.com"]
    for u in urls[::4]:
        host, path = U.split_url(u)
        entries += [host + path, host + "/" + path.split("/")[1] if path else host]
    (tmp_path / "list.txt").write_text("\n".join(entries))
    got = U.op6_url_filter(spark, sf_dir, f"file://{tmp_path}/list.txt").collect()
    assert len(got) == len(urls) and len({r["rule"] for r in got}) > 5
    assert all(r["rule"] == brute(r["url"], entries) and r["blocked"] == (r["rule"] is not None) for r in got)


def test_column_names_resolve_as_in_spark(spark):
    df = spark.createDataFrame([("http://a.com/x", 1), (None, 2)], "URL string, `__qm` int")
    out = U.match_urls(df, U.blocklist(spark, ["a.com"]), "url")
    assert out.columns == ["URL", "__qm", "rule"] and [r["rule"] for r in out.orderBy("__qm").collect()] == ["a.com", None]


def test_shared_folders_of_any_scheme(tmp_path):
    from pyarrow import fs

    assert isinstance(U._file_system(f"file://{tmp_path}/x")[0], fs.LocalFileSystem)
    assert U._file_system("dbfs:/a/b")[1] == "/dbfs/a/b"
    assert U.python_uri("s3a://bucket/a") == U.python_uri("s3n://bucket/a") == "s3://bucket/a"
    with pytest.raises(ValueError, match="shared folder"):
        U._file_system("wasbs://c@account/x")
