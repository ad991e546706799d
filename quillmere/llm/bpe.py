"""Byte-level BPE through a sentencepiece model that is serialised straight from a vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .kernels import buffers, by_bytes, strings
from .shared import free_name, quoted

#: Place of the public vocabulary (lines of base64 token and rank) on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker keeps; beyond it the store is emptied, which costs time only.
STORE = 400_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        out.append((n & 127) | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: int | float | bool | bytes | str) -> bytes:
    """One protobuf field: varint, float or length-delimited, by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, (bool, int)):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece i is the byte-mapped token of rank i with score -i; an unknown piece follows.

    The normaliser is the identity: no prefix, no collapsing or escaping of white space.
    """
    letters = byte_alphabet()
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, "".join(letters[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in order]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, False) + _field(35, False) + _field(40, len(order)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder:
    """Encoder and decoder of one process."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str = PATTERN, store: int = STORE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.letters = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.limit, self.number, self.ids = store, {}, []
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64)
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): texts are cut into pre-tokens, and each new pre-token is encoded once."""
        number, find = self.number, self.find
        if len(number) > self.limit:
            self.clear()
        words, sizes, new = [], [], []
        for t in texts:
            found = find(t)
            sizes.append(len(found))
            words += found
        at = list(map(number.get, words))
        if None in at:
            for w in words:
                if w not in number:
                    number[w] = len(number)
                    new.append(w)
            letters = self.table
            coded = self.sp.encode([w.encode().decode("latin-1").translate(letters) for w in new])
            self.flat = np.concatenate([self.flat, np.fromiter((i for c in coded for i in c), np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(c) for c in coded])])
            at = list(map(number.__getitem__, words))
        w = np.array(at, np.int64)
        size = self.at[w + 1] - self.at[w]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.at[w], size)]
        stops = np.r_[0, ends][np.r_[0, np.cumsum(sizes)].astype(np.int64)]
        return ids, stops

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes behind ids."""
        size = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.start[ids], size)]


def encode(df: DataFrame, text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, ids_col: str = "token_ids", count_col: str = "n_tokens", check_col: str = "round_trip", keep: list[str] | None = None, also: tuple | None = None) -> DataFrame:
    """``keep`` columns (default all but the text) with token ids, their number, and whether decoding gives the text back.

    Ids are ranks of the vocabulary, as merges by best rank give them.  The driver reads the
    vocabulary (its size doesn't depend on the data) and ships it with the tasks.  Defined
    results: a null text has null ids, count and check; the empty text has no ids; a long text is encoded whole; rows that repeat get equal
    ids, and of merges that tie in rank the left one comes first; a clash of names gives the new column a number; an empty table gives an empty table.

    ``also`` (name, type, function from a record batch of the ``keep`` columns to an array) adds a column before the ids in the same pass,
    which saves the caller a second Python worker for each task.
    """
    ranks = read_ranks(path)
    shipped = df.sparkSession.sparkContext.broadcast((serialise(ranks), ranks))
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    width = len(keep)
    names = list(keep)
    for c in (*([also[0]] if also else []), ids_col, count_col, check_col):
        names.append(free_name(names, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(*shipped.value, pattern)
            text = strings(batch.column(width))
            data, off = buffers(text)
            more = [also[2](pa.RecordBatch.from_arrays(batch.columns[:width], names[:width]))] if also else []
            for i, j in by_bytes(off):
                part = text.slice(i, j - i)
                null = part.is_null().to_numpy(zero_copy_only=False)
                ids, stop = coder.encode([t or "" for t in part.to_pylist()])
                back = coder.decode(ids)
                length = np.diff(off[i : j + 1])
                # bytes that the ids of each row stand for
                size = np.r_[0, np.cumsum(coder.start[ids + 1] - coder.start[ids])][stop]
                lo = int(off[i])
                if np.array_equal(np.diff(size), length):
                    wrong = np.flatnonzero(back != data[lo : lo + len(back)])
                    same = np.ones(j - i, bool)
                    same[np.searchsorted(size, wrong, "right") - 1] = False
                else:
                    same = np.array([np.array_equal(back[size[r] : size[r + 1]], data[off[i + r] : off[i + r + 1]]) for r in range(j - i)])
                lists = pa.ListArray.from_arrays(pa.array(stop.astype(np.int32), mask=np.r_[null, False]), pa.array(ids))
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in (*batch.columns[:width], *more)] + [lists, pa.array(np.diff(stop).astype(np.int32), mask=null), pa.array(same, mask=null)], names)

    slim = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).alias("__qm_text"))
    added = [*([also[1]] if also else []), T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in slim.schema.fields[:width]] + [T.StructField(n, t) for n, t in zip(names[width:], added)])
    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "token_ids", path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """All columns with the text of the ids.

    Defined results: null ids, and a null or unknown id among them, give a null text; no ids give the empty text, and any number of ids a text
    as long; bytes that aren't UTF-8 are replaced; rows that repeat get equal texts; a clash of names gives the text's column a number; an empty
    table gives an empty table.
    """
    ranks = read_ranks(path)
    shipped = df.sparkSession.sparkContext.broadcast((serialise(ranks), ranks))
    names = [*df.columns, free_name(df.columns, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(*shipped.value)
            known, out = len(coder.start) - 1, []
            for ids in batch.column(batch.num_columns - 1).to_pylist():
                ok = ids is not None and all(i is not None and 0 <= i < known for i in ids)
                out.append(coder.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names)

    asked = df.select(*[F.col(quoted(c)) for c in df.columns], F.col(quoted(ids_col)).alias("__qm_ids"))
    return asked.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(names[-1], T.StringType())]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the check that they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, keep=["doc_id"])
