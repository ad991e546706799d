"""License scans by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .kernels import WORD_CLASS, buffers, by_bytes, grams, hash_spans, spans, strings
from .license_texts import FULL_TEXTS
from .shared import quoted, written, written_bytes

#: (most words, k): a template up to so many words is searched by k-grams of that length, a longer one by LONG_K.
SHORT_K, LONG_K = ((11, 2), (39, 3)), 4
MIN_SIMILARITY = 0.8
#: A table (template k-grams, spans to verify) up to so many bytes is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a template k-gram when broadcast, at most about so many.
GRAM_BYTES = 128

TEMPLATES: Mapping[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    **FULL_TEXTS,
}


def k_of(words: int) -> int:
    """Length of the k-grams by which a template of so many words is searched.

    A passage of similarity 0.8 has at most a fifth of the template's words out and as many others in; in a template of up to
    11 words that leaves two neighbouring words somewhere, so no such passage is missed.
    """
    return next((k for most, k in SHORT_K if words <= most), LONG_K)


def drift_of(words: int) -> int:
    """Diagonals at most so far apart belong to one passage with words put in or left out, and not to one that repeats at once."""
    return max(1, words * 2 // 5)


def words_of(text: str, held: dict | None = None) -> np.ndarray:
    """Word hashes of one text."""
    data, off = buffers(strings(pa.array([text]), lower=True))
    begin, end, _ = spans(data, off, WORD_CLASS)
    return hash_spans(data, begin, end, {} if held is None else held)


def _hashes(lengths: list[int], names: list[str]):
    """Rows (key..., text) to (key..., positions, grams): the k-grams of the text, for all lengths k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, off = buffers(strings(batch.column(batch.num_columns - 1), lower=True))
            for i, j in by_bytes(off):
                begin, end, first = spans(data, off[i : j + 1], WORD_CLASS)
                words = hash_spans(data, begin, end, held)
                for k in lengths:
                    g = grams(words, k).view(np.int64)
                    size = np.maximum(np.diff(first) - k + 1, 0)
                    stop = np.r_[0, np.cumsum(size)]
                    place = np.arange(stop[-1]) - np.repeat(stop[:-1], size)
                    ends = pa.array(stop.astype(np.int32))
                    at = place + np.repeat(first[:-1], size)
                    yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:-1]] + [pa.ListArray.from_arrays(ends, pa.array(g[at]))], [*names, "grams"])

    return run


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the longest common subsequence of words, over the longer length."""
    if not len(a) or not len(b):
        return 0.0
    best = np.zeros(len(b) + 1, np.int32)
    for x in a:
        take = np.r_[0, best[:-1] + (b == x)]
        best = np.maximum.accumulate(np.maximum(best, take))
    return float(best[-1]) / max(len(a), len(b))


def best_span(want: np.ndarray, have: np.ndarray, starts: list[int], ends: list[int], least: float) -> tuple[float, int, int] | None:
    """(similarity, start, end) of the best of the spans from a start to an end, the first one at a tie; None below ``least``."""
    best = None
    for a in sorted({max(s, 0) for s in starts}):
        for b in sorted({min(e, len(have)) for e in ends}):
            n = b - a
            # the similarity is at most the shorter length over the longer
            if n > 0 and min(n, len(want)) >= max(least, best[0] if best else 0) * max(n, len(want)) - 1e-9:
                same = likeness(want, have[a:b])
                if same >= least and (best is None or same > best[0]):
                    best = (same, a, b)
    return best


def _verify(words: dict[str, np.ndarray], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, off = buffers(strings(batch.column(1), lower=True))
            rows, at = [], []
            for i, j in by_bytes(off):
                begin, end, first = spans(data, off[i : j + 1], WORD_CLASS)
                have = hash_spans(data, begin, end, held)
                for r in range(i, j):
                    mine = have[first[r - i] : first[r - i + 1]]
                    for f in batch.column(2)[r].as_py():
                        if found := best_span(words[f["template"]], mine, f["starts"], f["ends"], least):
                            rows.append((f["template"], found[1], found[2], f["votes"], found[0]))
                            at.append(r)
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "template", "start_word", "end_word", "votes", "similarity"])

    return run


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, least: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, template, start_word, end_word, votes, similarity) of the license passages.

    All rolling k-grams of all texts join the k-grams of the templates, k by the template's length; a match votes for the
    diagonal, that is the document's position less the template's.  Neighbouring diagonals,
    at most two fifths of the template's length apart, merge to a passage, of which each diagonal proposes a first and a last word, at each end
    lengthened by the template's words that didn't vote.  The spans so proposed are verified against
    the text: the longest common subsequence of words over the longer length must reach
    ``least``; the best one is the passage's.  Template k-grams and spans are broadcast up to 32 MB, beyond it both joins shuffle.

    Defined results: rows with a null id or text, and texts that are empty or have fewer than k words, have no
    spans; long texts are searched whole; a template of fewer than k words raises ValueError; a passage that matches two templates gives
    a row for each; of spans that tie the first counts; rows that repeat an id and text give their spans once, with the votes of one, and texts that share an id
    are searched apart; an empty table or no templates give no rows; extra columns are ignored, whatever their names; ids keep their type.
    """
    spark = df.sparkSession
    words = {n: words_of(t) for n, t in templates.items()}
    ks = {n: k_of(len(w)) for n, w in words.items()}
    if any(len(w) < ks[n] for n, w in words.items()):
        raise ValueError(f"a template has fewer than {SHORT_K[0][1]} words")
    docs = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    known_rows = [(int(g), n, p, len(w), drift_of(len(w))) for n, w in words.items() for p, g in enumerate(grams(w, ks[n]).view(np.int64))]
    known = spark.createDataFrame(known_rows, "gram long, template string, tpos int, twords int, drift int")
    if len(known_rows) * GRAM_BYTES <= BROADCAST_BYTES:
        known = F.broadcast(known)
    lists = docs.select("id", "hash", "text").mapInArrow(_hashes(sorted(set(ks.values())), ["id", "hash"]), f"id {kind}, hash long, grams array<long>")
    rolling = lists.select("id", "hash", F.posexplode("grams").alias("pos", "gram"))
    votes = rolling.join(known, "gram").groupBy("id", "hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.size(F.collect_set("pos")).cast("long").alias("votes"), F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.min("tpos").alias("t0"), F.max("tpos").alias("t1"), F.max("twords").alias("twords"), F.max("drift").alias("drift"))
    line = Window.partitionBy("id", "hash", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= F.col("drift"), 0).otherwise(1)
    merged = (
        votes.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(line))
        .withColumns({"lo": (F.col("p0") - F.col("t0")).cast("int"), "hi": (F.col("p1") + F.col("twords") - F.col("t1")).cast("int")})
        .groupBy("id", "hash", "template", "passage")
        .agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_set("lo")).alias("starts"), F.sort_array(F.collect_set("hi")).alias("ends"))
    )
    found = written(merged.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("starts", "ends", "template", "votes"))).alias("found")), "spans").select(F.col("id").alias("found_id"), F.col("hash").alias("found_hash"), "found")
    small = written_bytes(found) <= BROADCAST_BYTES
    checked = docs.join(F.broadcast(found) if small else found, (F.col("id") == F.col("found_id")) & (F.col("hash") == F.col("found_hash"))).select("id", "text", "found")
    return checked.mapInArrow(_verify(words, least), f"doc_id {kind}, template string, start_word int, end_word int, votes long, similarity double").distinct()


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_spans(docs).withColumn("similarity", F.round("similarity", 6))
