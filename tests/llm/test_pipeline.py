import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmere.llm import bpe, mixing, quality, simhash

from ..conftest import table


def stages(spark, docs, sf_dir, tmp_path):
    """Each stage's output, written and read again."""
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing to target weights", "byte-level BPE"]
    assert P.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    import duckdb
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stages(spark, docs, sf_dir, tmp_path)
    assert all(d.columns == docs.columns for d in out[1:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in out[:4]]

    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, x in p.items() if x is None or x >= quality.THRESHOLD}
    assert 0.7 * len(rows[0]) < len(rows[1]) < len(rows[0])

    first = {}
    for i in sorted(rows[1]):
        first.setdefault(rows[1][i]["text"], i)
    assert set(rows[2]) == set(first.values())

    sig = {r["id"]: bytes(r["sig"]) for r in simhash.signatures(out[2]).collect() if r["sig"] is not None}
    order = sorted(sig)
    bits = np.unpackbits(np.frombuffer(b"".join(sig[i] for i in order), np.uint8).reshape(-1, 32), axis=1).astype(int)
    near = bits @ (1 - bits.T) + (1 - bits) @ bits.T <= simhash.RADIUS
    seen, want = set(), set(rows[2]) - set(order)
    for a in range(len(order)):
        if a not in seen:
            want.add(order[a])
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += np.flatnonzero(near[b]).tolist()
    assert set(rows[3]) == want

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    got = con.execute(mixing.OP3_SQL)
    assert ids(out[4]) == sorted(r[0] for r in got.fetchall())

    t = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    encoded = out[5].collect()
    assert ids(out[5]) == ids(out[4])
    assert all(r["token_ids"] == t.encode_ordinary(rows[3][r["doc_id"]]["text"]) and r["round_trip"] for r in encoded)


def test_run_gives_what_the_stages_give(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = stages(spark, docs, sf_dir, tmp_path)[-1]
    got = P.run(spark, sf_dir)
    assert got.columns == want.columns
    assert table([tuple(r) for r in got.collect()], got.columns) == table([tuple(r) for r in want.collect()], want.columns)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "some text", "en", None, 9), (3, "word " * 20_000, "de", "src1", 5), (3, "word " * 20_000, "de", "src1", 5)]])
def test_nulls_empty_and_long_texts(spark, sf_dir, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stages(spark, docs, sf_dir, tmp_path)
    assert out[1].columns == docs.columns and "token_ids" in out[-1].columns
    assert (out[-1].count() > 0) == bool(rows)


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_training_order_is_in_the_last_rows(spark, sf_dir, tmp_path, monkeypatch, most):
    monkeypatch.setattr(P, "EPOCHS_BYTES", most)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    P.mixing_stage(spark, docs, sf_dir).repartitionByRange(5, "doc_id").limit(0).write.parquet(f"{tmp_path}/none")
    assert P.bpe_stage(spark, spark.read.parquet(f"{tmp_path}/none"), sf_dir).collect() == []
    P.mixing_stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mixed")
    rows = P.bpe_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir).select("doc_id", "train_order", "epoch").collect()
    want = sorted(mixing.mix_sources(docs.withColumn("tokens", mixing.text_tokens()), mixing.PRODUCTION_SCHEDULES, mixing.PRODUCTION_DEFAULT, "tokens").collect(), key=lambda r: (r["position"], r["source"], r["doc_id"], r["epoch"]))
    assert [(r["doc_id"], r["train_order"], r["epoch"]) for r in sorted(rows, key=lambda r: r["train_order"])] == [(r["doc_id"], i, r["epoch"]) for i, r in enumerate(want)]
    assert max(r["epoch"] for r in rows) > 0


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "position", "epoch", "train_order", "tokens", "quality_score", "sig", "token_ids", "__file", "key", "id", "name"]


def test_columns_whose_names_clash_go_through(spark, sf_dir, tmp_path):
    """Every stage leaves the columns of its caller as they are, in any name that it uses itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in NAMES[5:]])
    out = stages(spark, extra, sf_dir, tmp_path)
    assert all(d.columns == NAMES for d in out[:5])
    last = out[5]
    assert last.columns[: len(NAMES) - 1] == [c for c in NAMES if c != "text"]
    assert last.columns[len(NAMES) - 1 :] == ["train_order_1", "epoch_1", "token_ids_1", "n_tokens", "round_trip"]
    for r in last.collect():
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in NAMES[5:]) and r["round_trip"] in (True, None)
