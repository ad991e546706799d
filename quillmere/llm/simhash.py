"""SimHash near-dedup with bit-sliced comparison.

A document's signature has 256 bits: for each bit, the majority over its distinct words.  The
signatures that share a bucket are laid out vertically: word w of plane j holds bit j of
signatures 64w .. 64w+63, so that one XOR compares one signature with 64.  Differences are
summed by carry-save adders into bitwise counters, and after every 32 planes the blocks in
which every lane has exceeded the radius are abandoned.

Signatures know neither order nor counts of words, so they only propose: a pair within the radius
is a pair of near copies if the texts also have half of their word 3-grams in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .kernels import STEP, WORD_CLASS, buffers, by_bytes, grams, hash_spans, mix, row_of, spans, strings
from .shared import id_numbers, quoted, written, written_bytes

BITS = 256
BANDS, BAND_BITS = 12, 21
#: Largest number of differing bits of a near copy.
RADIUS = 48
#: Words of a shingle, and the least share of shingles (Jaccard) that near copies have in common.
SHINGLE, OVERLAP = 3, 0.5
#: The rows whose texts are compared are named by a table that is sent to all tasks up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20
U = np.uint64
SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0), U(0x082EFA98EC4E6C89))
ROWS = 1 << 16
BIG = 1024
#: Rows of a bucket, and texts of a candidate group, up to which one task compares them all; larger ones are cut into
#: blocks of that size, and each pair of blocks is a task's.
HOT_BUCKET, HOT_GROUP = 1 << 16, 1 << 12
#: Bits of a band's value by which rows are counted first, to find the bands' parts that may have a hot bucket.
COARSE_BITS = 12


def words_of(data: np.ndarray, off: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the word hashes of all rows; those of row r are ``first[r] : first[r + 1]``."""
    begin, end, first = spans(data, off, WORD_CLASS)
    return hash_spans(data, begin, end, held), first


def shapes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's sequence of words."""
    at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    total = np.r_[U(0), np.cumsum(mix(h + STEP * (at + 1).astype(U)))]
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct word 3-grams of one row, ascending; a shorter row is one shingle."""
    return np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else h


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bit_counts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ones, words): for each row how many of its distinct words set each of the 256 bits, and how many there are."""
    row, n = row_of(first), len(first) - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    ones = np.zeros((n, BITS), np.int32)
    for a in range(0, len(h), ROWS // 2):
        part, r = h[a : a + ROWS // 2], row[a : a + ROWS // 2]
        bits = np.unpackbits(np.stack([mix(part ^ s) for s in SEEDS], axis=1).view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        ones[r[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return ones, np.bincount(row, minlength=n)


def sign(ones: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as 32 bytes, and in each band the two bits of least majority as 24 bytes)."""
    lean = 2 * ones - words[:, None]
    sig = np.packbits(lean > 0, axis=1)
    margin = np.abs(lean[:, : BANDS * BAND_BITS]).reshape(-1, BANDS, BAND_BITS)
    low = np.argsort(margin, axis=2, kind="stable")[:, :, :2].astype(np.uint8).reshape(-1, BANDS * 2)
    return sig, low


def fixed(rows: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as a binary column, null where not present."""
    n, width = rows.shape
    off = np.arange(n + 1, dtype=np.int32) * width
    mask = None if present is None else pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [mask, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def unfixed(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    start = np.frombuffer(off, np.int64, 1, column.offset * 8)[0] if len(column) else 0
    return np.frombuffer(data, np.uint8, len(column) * width, start).reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        text = strings(batch.column(1), lower=True)
        data, off = buffers(text)
        for i, j in by_bytes(off):
            h, first = words_of(data, off[i : j + 1], held)
            ones, words = bit_counts(h, first)
            sig, low = sign(ones, words)
            has = words > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), fixed(sig, has), fixed(low, has), pa.array(shapes(h, first))], ["id", "sig", "low", "shape"])


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, low, shape) of every row with a whole number as its id; sig is null for a null id and for a text without words."""
    narrow = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(_signatures, "id long, sig binary, low binary, shape long").withColumn("sig", F.when(F.col("id").isNotNull(), F.col("sig")))


def band_keys(sig: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bucket keys, 4 for each band: the band's bits, and those with its least certain bits flipped."""
    bits = np.unpackbits(sig, axis=1)[:, : BANDS * BAND_BITS].reshape(-1, BANDS, BAND_BITS).astype(np.int64)
    value = bits @ (1 << np.arange(BAND_BITS, dtype=np.int64))
    low = low.reshape(-1, BANDS, 2).astype(np.int64)
    a, b = 1 << low[:, :, 0], 1 << low[:, :, 1]
    keys = np.stack([value, value ^ a, value ^ b, value ^ a ^ b], axis=2) | (np.arange(BANDS, dtype=np.int64) << 32)[None, :, None]
    return keys.reshape(len(sig), -1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            sig, low = unfixed(part.column(1), BITS // 8), unfixed(part.column(2), BANDS * 2)
            keys = band_keys(sig, low)
            k = keys.shape[1]
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, k)), fixed(np.repeat(sig, k, axis=0))], ["key", "id", "sig"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(coarse, n): how many keys of a task's rows fall into each coarse part of each band."""
    total = np.zeros(BANDS << COARSE_BITS, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            keys = band_keys(unfixed(part.column(1), BITS // 8), unfixed(part.column(2), BANDS * 2)).ravel()
            total += np.bincount(coarse(keys), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["coarse", "n"])


def coarse(keys: np.ndarray) -> np.ndarray:
    return (keys >> 32) << COARSE_BITS | (keys & ((1 << BAND_BITS) - 1)) >> (BAND_BITS - COARSE_BITS)


def in_blocks(rows: DataFrame, key: str, member: str, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` with groups of ``key`` of more than ``most`` rows cut: a row of block r goes to the groups of blocks (r, t) for all t.

    counts (key, n) has the large groups; no other is changed.  Any two rows of a group still meet.
    """
    large = written(counts.filter(F.col("n") > most).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / most).cast("int").alias("__blocks")), "hot")
    if large.isEmpty():
        return rows
    small = written_bytes(large) <= BROADCAST_BYTES
    both = rows.join(F.broadcast(large) if small else large, F.col(key) == F.col("__hot"), "left")
    mine = F.pmod(F.xxhash64(member, F.lit("block")), F.col("__blocks")).cast("int")
    both = both.withColumn("__mine", mine).withColumn("__other", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__blocks") - 1))))
    cut = F.xxhash64(key, F.least("__mine", "__other"), F.greatest("__mine", "__other"))
    return both.withColumn(key, F.when(F.col("__hot").isNull(), F.col(key)).otherwise(cut)).select(*rows.columns)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (sum, carry) of three bit planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, rowbits: np.ndarray, row: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of ``word`` within ``radius`` of ``row``, for each block (row, word).

    planes: (bits, words) vertical signatures; rowbits: (bits, rows) of 0 or 1; valid: the lanes
    that count.  Returns (block numbers, lane masks) of the blocks with such a lane.
    """
    height = max(4, radius.bit_length())  # counter bits; a carry beyond them is sticky
    zero = np.zeros(len(row), U)
    count = [zero.copy() for _ in range(height)]
    over, block = zero.copy(), np.arange(len(row))
    for j0 in range(0, len(planes), 8):
        x = [planes[j][word] ^ (zero[: len(row)] - rowbits[j][row]) for j in range(j0, min(j0 + 8, len(planes)))]
        x += [zero[: len(row)]] * (8 - len(x))
        count[0], ta = _add(count[0], x[0], x[1])
        count[0], tb = _add(count[0], x[2], x[3])
        count[1], fa = _add(count[1], ta, tb)
        count[0], ta = _add(count[0], x[4], x[5])
        count[0], tb = _add(count[0], x[6], x[7])
        count[1], fb = _add(count[1], ta, tb)
        count[2], carry = _add(count[2], fa, fb)
        for t in range(3, height):
            count[t], carry = count[t] ^ carry, count[t] & carry
        over |= carry
        if (j0 + 8) % 32 == 0 or j0 + 8 >= len(planes):
            more, same = over.copy(), ~over
            for t in reversed(range(height)):
                if radius >> t & 1:
                    same &= count[t]
                else:
                    more |= same & count[t]
                    same &= ~count[t]
            near = ~more & valid
            live = near != 0
            if not live.all():
                row, word, valid, over, block, near = row[live], word[live], valid[live], over[live], block[live], near[live]
                count = [c[live] for c in count]
                if not len(row):
                    break
    return (block, near) if len(row) else (np.zeros(0, np.int64), np.zeros(0, U))


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the least member) after joining a[i] with b[i]."""
    while len(a):
        la, lb = label[a], label[b]
        m = np.minimum(la, lb)
        np.minimum.at(label, la, m)
        np.minimum.at(label, lb, m)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def near_labels(sig: np.ndarray, stop: np.ndarray, radius: int, label: np.ndarray | None = None) -> np.ndarray:
    """For rows in consecutive buckets (stop: the end of each row's bucket) the least row of its component.

    Blocks of one known component are skipped, since comparing them can't join anything more.
    """
    n = len(sig)
    label = np.arange(n) if label is None else label
    words = (n + 63) // 64
    bits = np.zeros((words * 64, sig.shape[1] * 8), np.uint8)
    bits[:n] = np.unpackbits(sig, axis=1)
    vertical = np.ascontiguousarray(bits.T)
    planes = np.packbits(vertical, axis=1, bitorder="little").view(U)
    rowbits = vertical.astype(np.uint8)
    r = np.arange(n)
    w0, w1 = r // 64, (stop - 1) // 64
    blocks = np.where(stop - r > 1, w1 - w0 + 1, 0)
    ends = np.cumsum(blocks)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROWS, "right")))
        row = np.repeat(r[i:j], blocks[i:j])
        word = np.arange(len(row)) - np.repeat(ends[i:j] - blocks[i:j] - (ends[i - 1] if i else 0), blocks[i:j]) + w0[row]
        pad = np.r_[label, np.full(words * 64 - n, -1)].reshape(words, 64)
        known = (pad.min(1) == pad.max(1))[word] & (pad[word, 0] == label[row])
        row, word = row[~known], word[~known]
        from_, to = np.clip(row + 1 - word * 64, 0, 64), np.clip(stop[row] - word * 64, 0, 64)
        full = ~U(0)
        valid = np.where(to > 0, full >> (64 - np.maximum(to, 1)).astype(U), U(0)) & np.where(from_ < 64, full << np.minimum(from_, 63).astype(U), U(0))
        use = valid != 0
        row, word, valid = row[use], word[use], valid[use]
        if len(row):
            block, near = within(planes, rowbits, row, word, valid, radius)
            if len(block):
                lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, lane = np.nonzero(lanes)
                label = join(label, row[block[k]], word[block[k]] * 64 + lane)
        i = j
    return label


def bucket_pairs(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id) links that connect, within each bucket, all near rows; rows are sorted by (key, id)."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    out_a, out_b = [], []
    small = np.repeat((size > 1) & (size <= BIG), size)
    rows = np.flatnonzero(small)
    if len(rows):
        sizes = size[(size > 1) & (size <= BIG)]
        stop = np.repeat(np.cumsum(sizes), sizes)
        label = near_labels(sig[rows], stop, radius)
        moved = np.flatnonzero(label != np.arange(len(rows)))
        out_a.append(ids[rows[moved]])
        out_b.append(ids[rows[label[moved]]])
    for g in np.flatnonzero(size > BIG):
        part = slice(cut[g], cut[g + 1])
        n = int(size[g])
        # first a few rows against all, so that the bulk of a large group is known to be one component
        label = np.arange(n)
        for p in range(0, n, max(1, n // 8)):
            far = np.bitwise_count(sig[part].view(U) ^ sig[part][p].view(U)).sum(1)
            close = np.flatnonzero(far <= radius)
            label = join(label, np.full(len(close), p), close)
        order = np.argsort(label, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        label = near_labels(sig[part][order], np.full(n, n), radius, label=back[label[order]])
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids[part][order])
        a, b = ids[part][order], least[label]
        out_a.append(a[a != b])
        out_b.append(b[a != b])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(upto: int, rows: pa.Table) -> pa.RecordBatch:
            t = rows.slice(0, upto).combine_chunks()
            if not t.num_rows:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            key, ids = t.column(0).chunk(0).to_numpy(), t.column(1).chunk(0).to_numpy()
            sig = unfixed(t.column(2).chunk(0), BITS // 8)
            a, b = bucket_pairs(key, ids, np.ascontiguousarray(sig), radius)
            pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held)
                key = rows.column(0).to_numpy()
                upto = int(np.searchsorted(key, key[-1], "left"))
                if upto:
                    yield emit(upto, rows)
                    held = rows.slice(upto).combine_chunks().to_batches()
                    n = rows.num_rows - upto
        if held:
            rows = pa.Table.from_batches(held)
            yield emit(rows.num_rows, rows)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the least of its component.

    Alternates the large-star and small-star steps until no link changes; each round is a
    table in the shared folder.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.select("a", "b", F.least("a", F.min("b").over(Window.partitionBy("a"))).alias("m"))
        large = least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = written(small, "links")


def confirmed(ids: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], radius: int) -> np.ndarray:
    """For the rows of one candidate group, ids ascending, the least row of each one's component of near copies.

    Rows are joined that are within ``radius`` and have ``OVERLAP`` of their shingles in common, or that share an id.
    """
    label, sig = np.arange(len(ids)), np.ascontiguousarray(sig).view(U)
    for i in range(1, len(ids)):
        near = np.bitwise_count(sig[:i] ^ sig[i]).sum(1) <= radius
        todo = np.flatnonzero(near | (ids[:i] == ids[i]))
        while len(todo):
            j, todo = todo[0], todo[1:]
            if ids[i] == ids[j] or overlap(sets[i], sets[j]) >= OVERLAP:
                a, b = sorted((label[i], label[j]))
                label[: i + 1][label[: i + 1] == b] = a
                todo = todo[label[todo] != a]
    return label


def _confirm(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        root, ids, sigs, sets, known = None, [], [], [], set()

        def emit() -> pa.RecordBatch:
            i = np.array(ids, np.int64)
            label = confirmed(i, np.stack(sigs), sets, radius) if ids else np.zeros(0, np.int64)
            pair = np.stack([i, i[label]], axis=1)
            pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["node", "root"])

        for batch in batches:
            group, ident, shape = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            sig = unfixed(batch.column(3), BITS // 8)
            data, off = buffers(strings(batch.column(4), lower=True))
            for i, j in by_bytes(off):
                h, first = words_of(data, off[i : j + 1], held)
                # an id that is repeated meets all of its texts
                for r in np.flatnonzero(shapes(h, first) == shape[i:j]):
                    if group[i + r] != root:
                        yield emit()
                        root, ids, sigs, sets, known = group[i + r], [], [], [], set()
                    if (one := (ident[i + r], shape[i + r])) not in known:
                        known.add(one)
                        ids.append(ident[i + r])
                        sigs.append(sig[i + r].copy())
                        sets.append(shingles(h[first[r] : first[r + 1]]))
        yield emit()

    return run


def confirmed_roots(df: DataFrame, reps: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """(node, root) as of ``components``, for the components of the pairs that the texts (id, text) in ``df`` confirm.

    Only the texts of candidate groups are shuffled, by group; a group of more than ``HOT_GROUP`` texts is cut into
    blocks, each pair of which is a task's.
    """
    grouped = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    whole = written(reps.join(grouped, reps.id == grouped.node).select("node", "root", "shape", "sig"), "members")
    sizes = whole.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = in_blocks(whole, "root", "node", sizes, HOT_GROUP)
    small = written_bytes(whole) <= BROADCAST_BYTES
    texts = df.join(F.broadcast(members) if small else members, F.col("id") == F.col("node")).select("root", "id", "shape", "sig", "text")
    found = texts.repartition("root").sortWithinPartitions("root", "id").mapInArrow(_confirm(radius), "node long, root long")
    if members is whole:
        return written(found, "roots")
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def links(reps: DataFrame, radius: int) -> DataFrame:
    """(a, b) that connect the rows (id, sig, low) within ``radius`` that meet in a bucket.

    Rows are counted by coarse parts of the bands first; only where a part has more than ``HOT_BUCKET`` rows are its buckets counted.
    """
    slim = reps.select("id", "sig", "low")
    parts = slim.mapInArrow(_counts, "coarse long, n long").groupBy("coarse").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_BUCKET).collect()  # at most 12 x 4096 rows
    keyed = slim.mapInArrow(_spread, "key long, id long, sig binary")
    if parts:
        shift = F.shiftright("key", 32) * (1 << COARSE_BITS) + F.shiftright(F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)), BAND_BITS - COARSE_BITS)
        named = reps.sparkSession.createDataFrame([(r["coarse"],) for r in parts], "coarse long")
        counts = keyed.select("key", shift.alias("coarse")).join(F.broadcast(named), "coarse").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        keyed = in_blocks(keyed, "key", "id", counts, HOT_BUCKET)
    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_compare(radius), "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): kept has (id, group_size), removed has (id).

    Rows with the same words in the same order form one candidate; candidates meet in buckets of 21
    signature bits, 12 bands by 4 keys (the band's bits and those with its two least certain bits
    flipped), and all pairs within a bucket are compared.  Components of pairs within ``radius``
    are then compared on the texts: a group is a connected component of pairs within ``radius``
    that have at least half of their word 3-grams in common; its least id stays.
    """
    slim = df.select(F.col(quoted(id_col)).alias("key"), F.col(quoted(text_col)).alias("text"))
    kind = slim.schema["key"].dataType
    (narrow,), names = id_numbers([slim], "key")

    def named(rows: DataFrame) -> DataFrame:
        if names is not None:
            rows = rows.join(names, "id", "left").withColumn("id", F.col("name"))
        return rows.select(F.col("id").cast(kind).alias("id"), *[c for c in rows.columns if c not in ("id", "name")])

    texts = narrow.select("id", "text")
    sigs = written(signatures(texts, "id", "text"), "signatures")
    reps = sigs.filter("sig IS NOT NULL").groupBy("sig", "shape").agg(F.min(F.struct("id", "low")).alias("m"), F.count(F.lit(1)).alias("n")).select("sig", "shape", F.col("m.id").alias("id"), F.col("m.low").alias("low"), "n")
    reps = written(reps, "representatives")
    roots = confirmed_roots(texts, reps, components(links(reps, radius)), radius)
    grouped = reps.join(roots, reps.id == roots.node, "left").select(F.coalesce("root", "id").alias("id"), "n")
    unsigned = sigs.filter("sig IS NULL").select("id", F.lit(1).cast("long").alias("group_size"))
    kept = written(grouped.groupBy("id").agg(F.sum("n").alias("group_size")), "kept")
    removed = sigs.filter("sig IS NOT NULL").select("id").join(kept, "id", "left_anti").distinct()
    return named(kept.unionAll(unsigned)), named(removed)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` without the near copies: of each group only the document with the least id.

    Defined results: a row with a null id, or whose text is null or has no words, is never a
    copy and stays; texts of any length are signed and compared whole; rows that repeat an id are one document and stay or go together; ties can't
    occur, as ids are distinct within a group; an empty table gives an empty table; all
    columns, of whatever name, are kept; ids may have any type that sorts, and keep it.
    """
    _, removed = near_groups(df, id_col, text_col, radius)
    gone = removed.select(F.col("id").alias("__qm_gone"))
    return df.join(gone, F.col(quoted(id_col)) == F.col("__qm_gone"), "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, and how many documents each stands for."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, _ = near_groups(docs)
    return kept.select(F.col("id").alias("doc_id"), "group_size")
