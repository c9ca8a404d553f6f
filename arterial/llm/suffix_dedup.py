"""Suffix-array dedup: remove every byte under a string of ``length`` bytes that starts in an earlier document too.

1. Documents travel packed, by blocks. A block is chosen by the smallest hash of a document's word starts, so
   copies and most near copies meet in one block; a key with more bytes than half a block is spread over several.
   In a block equal texts are one: copies with a larger id lose all their windows there and go no further.
2. Each document's windows of ``length`` bytes are cut into runs with the same minimizer (the smallest
   hash of the ``GRAM``-byte strings inside the window). Equal windows have equal minimizers, so equal
   windows always meet. A block sends its distinct minimizers as sorted hashes, about two bytes and a half each, and
   gets a byte back for each: met in one document alone (its runs are dropped), shared, or frequent.
3. The bytes of the remaining runs go to the shard of their minimizer, those of frequent ones window by window
   to the shard of the window's own hash, so no minimizer makes a shard of its own. Equal strings of a block go
   once. A shard's suffix array is built by induced sorting, and permuted common prefixes of ``length`` or more
   tie equal windows together; all but those of the smallest document are marked.
4. Marked windows are united for each document and their bytes removed.

Steps 2 to 4 read one shuffle of the documents. The hashes have ten bits more than their number needs, so
one in a thousand passes for shared by chance, which costs a string and changes no result. Small shards of a task
are sorted together.

Defined cases: a null text is empty; shorter texts lose nothing; a null doc_id stands after all
others, and a doc_id of 2^63 - 1 is taken for a null one; rows with equal doc_id never remove bytes of each
other; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import NOISE, ODD, SPACES, U, buffers, by_bucket, grouped, mix, pack, pieces, span_hashes, trimmed, trimmed_group, unpack
from .common import text_key
from .suffix_array import common_prefixes, suffix_array

#: Short grams are met by chance in many documents, long ones leave short windows of grams and more runs.
GRAM = 26
SLICE = 1 << 20
#: Bytes of entries in a bucket, of strings in a shard, of texts in a block.
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 4 << 20
#: Runs of a minimizer from which on they are dealt window by window.
HOT_RUNS = 1 << 15
#: At most this many keys are dealt over several blocks (16 bytes each); further ones have less than its part of all bytes.
HOT_KEYS = 100_000

SPAN = np.dtype([("pos", "<u4"), ("n", "<u4")])
SCHEMA = "bucket long, kind int, blob binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes (16 to 32) from each place on: two overlapping halves of 16."""
    h = NOISE[data]
    k = 1
    while k < 16:
        h = h[:-k] * ODD[k] + h[k:]
        k *= 2
    return mix(h[: len(h) - (GRAM - 16)] * ODD[50] + h[GRAM - 16 :])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def minimizer_runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and minimizer of each run of windows."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U)
    low = sliding_min(gram_hashes(data), length - GRAM + 1)
    size = np.diff(off)
    some = np.flatnonzero(size >= length)
    step = np.zeros(len(data) + 1, np.int8)
    step[off[some]] += 1
    step[off[some + 1] - length + 1] -= 1
    valid = np.cumsum(step[:n], dtype=np.int8).astype(bool)
    cut = np.ones(n, bool)
    cut[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    cut[off[some]] = True
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, n))
    keep = valid[at]
    at, count = at[keep], count[keep]
    row = np.searchsorted(off, at, "right") - 1
    return row, at - off[row], count, low[at]


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"bucket": pa.array(bucket, pa.int64()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _to_blocks(ids: np.ndarray, hashes: np.ndarray, block: np.ndarray, which: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Entries (``columns``, of documents ``which``) packed for the blocks of their documents."""
    rows = []
    for k, at in grouped(block[which]):
        docs, local = np.unique(which[at], return_inverse=True)
        own = (ids[docs].view("<u8"), hashes[docs].view("<u8"), local.astype("<u4"), *(c[at] for c in columns))
        rows.append((k, 1, pack(*own)))
    return _out(rows)


def _from_blobs(blobs: list[bytes], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids and hashes of all documents of some blobs, the document of each entry and the entries' columns."""
    docs, which, rest, base = [], [], [], 0
    for blob in blobs:
        ids, hashes, local, *own = unpack(blob)
        docs.append((ids.view(np.int64), hashes.view(np.int64)))
        which.append(local.astype(np.int64) + base)
        rest.append(own[:columns])
        base += len(ids)
    ids, hashes = (np.concatenate(x) for x in zip(*docs, strict=True))
    return ids, hashes, np.concatenate(which), [np.concatenate(x) for x in zip(*rest, strict=True)]


def document_keys(data: np.ndarray, off: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The least hash of the 16 bytes at a row's word starts; without any, a hash of the row."""
    out = mix(hashes.view(U))
    n = len(data)
    if n < 17:
        return out
    space = SPACES[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    row = np.searchsorted(off, start, "right") - 1
    inside = start + 16 <= off[row + 1]
    start, row = start[inside], row[inside]
    if not len(start):
        return out
    data = np.ascontiguousarray(data)
    eight = np.lib.stride_tricks.as_strided(data, (n - 7, 8), (1, 1))
    low, high = (eight[start + k].view("<u8").ravel() for k in (0, 8))
    h = mix(low * ODD[3] + (high ^ (high >> U(31))) * ODD[5])
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out[row[first]] = np.minimum.reduceat(h, first)
    return out


def _key_sizes(batches):
    """The bytes under each key of a slice."""
    for batch in pieces(batches, "text", 4 << 20):
        data, off = buffers(batch.column("text"))
        keys, where = np.unique(document_keys(data, off, batch.column("th").to_numpy()), return_inverse=True)
        n = np.bincount(where, weights=np.diff(off), minlength=len(keys)).astype(np.int64)
        yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "n": pa.array(n)})


class _Block:
    """A block's documents; ``first`` names for each the row of the smallest id with an equal text."""

    def __init__(self, table: pa.Table):
        self.number = table.column("bucket")[0].as_py()
        self.ids, self.hashes, self.off, self.raw = _documents(table)
        known: dict[int, list[int]] = {}  # by hash: the first rows of different texts
        self.first = np.arange(len(self.ids))
        text = memoryview(self.raw)
        off, hashes = self.off.tolist(), self.hashes.tolist()
        for r in np.argsort(self.ids, kind="stable").tolist():
            same = known.setdefault(hashes[r], [])
            own = text[off[r] : off[r + 1]]
            at = next((k for k in same if text[off[k] : off[k + 1]] == own), None)
            if at is None:
                same.append(r)
            else:
                self.first[r] = at

    def runs(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first window, number of windows and minimizer (``bits`` of it) of the runs of distinct texts."""
        own = np.unique(self.first)
        size = (self.off[1:] - self.off[:-1])[own]
        parts = []
        at = 0
        upto = np.cumsum(size)
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            rows = own[at:to]
            data = np.frombuffer(b"".join([self.raw[self.off[r] : self.off[r + 1]] for r in rows.tolist()]), np.uint8)
            row, pos, n, h = minimizer_runs(data, np.concatenate(([0], np.cumsum(size[at:to]))), length)
            parts.append((rows[row], pos, n, mix(h) >> U(64 - bits)))  # least hashes are small: mixed, they fill their range
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _list_minimizers(length: int, bits: int, depth: int):
    """Kernel 1: a block's distinct minimizers in order, by bucket (their top ``depth`` bits)."""
    wide = "<u4" if bits - depth <= 32 else "<u8"

    def work(table: pa.Table) -> pa.Table:
        block = _Block(table)
        row, _, _, h = block.runs(length, bits)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        rows = []
        if len(first):
            here = block.ids[row[order]]
            several = np.minimum.reduceat(here, first) != np.maximum.reduceat(here, first)
            tag = (np.minimum(count, HOT_RUNS - 1) * 2 + several).astype("<u2")
            values = h[first]
            for k, at in grouped((values >> U(bits - depth)).astype(np.int64)):
                local = values[at] & U((1 << (bits - depth)) - 1)
                rows.append((k, 0, pack(np.array([block.number, k], "<u8"), np.diff(local, prepend=U(0)).astype(wide), tag[at])))
        return pa.Table.from_batches([_out(rows)])

    return work


def _answer(hot_runs: int):
    """Kernel 2: for each minimizer of a block's list 0 (met in one document), 1 (in several) or 2 (in ``hot_runs`` runs)."""

    def handle(blobs):
        lists = [unpack(blob) for blob in blobs]
        value = np.concatenate([np.cumsum(step, dtype=U) for _, step, _ in lists])
        tag = np.concatenate([t for _, _, t in lists]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        v = value[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        size = np.diff(np.append(first, len(v)))
        shared = (size > 1) | (np.maximum.reduceat(tag[order] & 1, first) > 0)
        often = np.add.reduceat(tag[order] >> 1, first) >= hot_runs
        answer = np.empty(len(v), np.uint8)
        answer[order] = np.repeat((shared * (1 + often)).astype(np.uint8), size)
        upto = np.cumsum([len(t) for _, _, t in lists])
        yield _out([(int(head[0]), 1, pack(head[1:], own)) for (head, _, _), own in zip(lists, np.split(answer, upto[:-1]), strict=True)])

    def work(batches):
        yield from by_bucket(batches, handle)

    return work


def _pack_documents(blocks: int, hot):
    """Documents packed by block; those of a ``hot`` key (sorted keys, and blocks for each) are spread by id and hash."""

    def work(batches):
        keys, parts = hot.value
        for batch in pieces(batches, "text", 4 << 20):
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            data, off = buffers(batch.column("text"))
            raw = data.tobytes()
            key = document_keys(data, off, hashes)
            if len(keys):
                near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                own = mix(ids.view(U) * ODD[9] + hashes.view(U)) % parts[near]
                key = np.where(keys[near] == key, key + own * ODD[11], key)
            rows = []
            for k, at in grouped((mix(key) % U(blocks)).astype(np.int64)):
                texts = [raw[off[r] : off[r + 1]] for r in at.tolist()]
                sizes = (off[at + 1] - off[at]).astype("<u8")
                rows.append((k, 2, pack(ids[at].view("<u8"), hashes[at].view("<u8"), sizes, np.frombuffer(b"".join(texts), np.uint8))))
            yield _out(rows)

    return work


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Ids, hashes, offsets and all bytes of a block's documents."""
    ids, hashes, sizes, texts = [], [], [np.zeros(1, np.int64)], []
    for blob in table.column("blob").to_pylist():
        i, h, n, t = unpack(blob)
        ids.append(i.view(np.int64))
        hashes.append(h.view(np.int64))
        sizes.append(n.astype(np.int64))
        texts.append(t.tobytes())
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *ids]), np.concatenate([z, *hashes]), np.cumsum(np.concatenate(sizes)), b"".join(texts)


def _send_strings(length: int, bits: int, shards: int):
    """Kernel 3: the bytes of shared runs of a block to their shards; equal strings of a block go once."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.Table.from_batches([_out([])])
        block = _Block(left)
        ids, hashes, off, raw = block.ids, block.hashes, block.off, block.raw
        number = np.full(len(ids), block.number)
        out = []
        size = np.diff(off)
        copies = np.flatnonzero((ids > ids[block.first]) & (size >= length))
        if len(copies):
            out.append(_to_blocks(ids, hashes, number, copies, np.zeros(len(copies), "<u4"), (size[copies] - length + 1).astype("<u4")))
        row, pos, n, h = block.runs(length, bits)
        answers = sorted((unpack(blob) for blob in right.column("blob").to_pylist()), key=lambda x: int(x[0][0]))
        _, which = np.unique(h, return_inverse=True)
        answer = np.concatenate([x[1] for x in answers])[which]
        keep = np.flatnonzero(answer)
        row, pos, n, h, answer = row[keep], pos[keep], n[keep], h[keep], answer[keep]
        hot = np.flatnonzero(answer == 2)
        if len(hot):
            many = n[hot]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rest = np.flatnonzero(answer == 1)
            hot_row, hot_pos = np.repeat(row[hot], many), np.repeat(pos[hot], many) + step
            row, pos = np.concatenate((row[rest], hot_row)), np.concatenate((pos[rest], hot_pos))
            n = np.concatenate((n[rest], np.ones(len(step), np.int64)))
            h = np.concatenate((h[rest], _window_hashes(raw, off[hot_row] + hot_pos, length)))
        start = off[row] + pos
        end = start + n + (length - 1)
        strings = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        own = ids[row]
        least: dict[bytes, int] = {}
        for s, d in zip(strings, own.tolist(), strict=True):
            if d < least.setdefault(s, d):
                least[s] = d
        low = np.fromiter((least[s] for s in strings), np.int64, len(strings))
        pos, n = pos.astype("<u4"), n.astype("<u4")
        late = np.flatnonzero(own > low)
        if len(late):
            out.append(_to_blocks(ids, hashes, number, row[late], pos[late], n[late]))
        # of the smallest document's equal strings one goes to the shard for all of them
        once: dict[bytes, int] = {}
        w = np.flatnonzero(own == low)
        rows = []
        for k, at in grouped((h[w] % U(shards)).astype(np.int64)):
            at = w[at]
            docs, local = np.unique(row[at], return_inverse=True)
            text = np.frombuffer(b"".join([strings[i] for i in at.tolist() if once.setdefault(strings[i], i) == i]), np.uint8)
            again = np.fromiter((once[strings[i]] for i in at.tolist()), np.int64, len(at))
            _, string = np.unique(again, return_inverse=True)
            head = (ids[docs].view("<u8"), hashes[docs].view("<u8"), local.astype("<u4"), pos[at], n[at])
            rows.append((k, 0, pack(*head, string.astype("<u4"), number[:1].astype("<u8"), text)))
        return pa.Table.from_batches([*out, _out(rows)])

    return work


def _window_hashes(raw: bytes, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each start on."""
    out = np.empty(len(start), U)
    data = np.frombuffer(raw, np.uint8)
    order = np.argsort(start, kind="stable")
    at = 0
    while at < len(order):  # slices of the text that lie near each other
        low = start[order[at]]
        to = int(np.searchsorted(start[order], low + SLICE, "left"))
        own = order[at:to]
        piece = data[low : start[own[-1]] + length]
        out[own] = span_hashes(piece, start[own] - low, start[own] - low + length)
        at = to
    return out


def marked_windows(strings: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of windows that occur in a string of a smaller document, and where those of each string begin.

    ``least``: the smallest document of each string. One induced suffix array over all strings, one
    value 1 after each of them, ties windows whose permuted common prefixes reach ``length``.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
    start = np.concatenate(([0], np.cumsum(sizes + 1)))
    t = data.astype(np.int16) + 2
    t[start[1:] - 1] = 1
    t = np.append(t, np.int16(0))
    sa = suffix_array(t, length)
    number = np.repeat(np.arange(len(strings)), sizes + 1)
    left = np.repeat(start[1:] - 1, sizes + 1) - np.arange(len(data))
    valid = np.append(left >= length, False)
    prefix = common_prefixes(np.append(data, np.uint8(0)), sa, length)
    chosen = valid[sa]
    place = sa[chosen]
    # what stands between two windows that agree agrees with both, so it is a window too
    follows = np.append(False, valid[sa[:-1]])[chosen]
    apart = (prefix[place] < length) | ~follows
    first = np.flatnonzero(apart)
    own = least[number[place]]
    low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(place)))) if len(place) else own
    hit = np.sort(place[own > low])
    cut = np.searchsorted(hit, start)
    return hit - np.repeat(start[:-1], np.diff(cut)), cut


def _mark(length: int):
    """Kernel 4: the marked windows of each shard, as spans of window starts, to the blocks."""

    def handle(blobs):
        parts, blocks = [], []
        number: dict[bytes, int] = {}
        which: list[np.ndarray] = []
        for blob in blobs:
            ids, _, _, _, n, own, block, text = unpack(blob)
            blocks.append(np.full(len(ids), block[0].astype(np.int64)))
            raw = text.tobytes()
            _, first = np.unique(own, return_index=True)  # strings stand in the order of their first entries
            upto = np.cumsum(n[first].astype(np.int64) + (length - 1))
            names = [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]
            which.append(np.array(names, np.int64)[own])
        ids, hashes, doc, (pos, n) = _from_blobs(blobs, 2)
        block = np.concatenate(blocks)
        string = np.concatenate(which)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, string, ids[doc])
        hit, cut = marked_windows(list(number), least, length)
        late = np.flatnonzero(ids[doc] > least[string])
        parts.append((doc[late], pos[late], n[late]))
        # spans of successive marked windows in each string, for the entries of its smallest document
        head = np.concatenate(([True], np.diff(hit) != 1)) if len(hit) else np.zeros(0, bool)
        head[cut[:-1][cut[:-1] < len(hit)]] = True
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(hit)))
        spans = np.searchsorted(first, cut)  # of each string
        early = np.flatnonzero(ids[doc] == least[string])
        many = np.diff(spans)[string[early]]
        entry = np.repeat(early, many)
        span = np.repeat(spans[string[early]] - np.cumsum(many) + many, many) + np.arange(len(entry))
        parts.append((doc[entry], pos[entry] + hit[first[span]], count[span]))
        row, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield _to_blocks(ids, hashes, block, row, start.astype("<u4"), size.astype("<u4"))

    def work(batches):
        yield from by_bucket(batches, handle, SHARD_BYTES)

    return work


def removed_ranges(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal removed runs under spans of window starts."""
    order = np.argsort(spans["pos"], kind="stable")
    start = spans["pos"][order].astype(np.int64)
    end = np.maximum.accumulate(start + spans["n"][order] + (length - 1))
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _cut(length: int):
    """Kernel 5: a block's documents without the bytes under their marked windows."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, hashes, off, raw = _documents(left)
        spans: dict[tuple[int, int], np.ndarray] = {}
        if right.num_rows:
            own_ids, own_hashes, doc, (pos, n) = _from_blobs(right.column("blob").to_pylist(), 2)
            both = np.rec.fromarrays([pos, n], dtype=SPAN)
            number: dict[tuple[int, int], int] = {}
            keys = zip(own_ids.tolist(), own_hashes.tolist(), strict=True)
            doc = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(own_ids))[doc]
            names = list(number)
            spans = {names[k]: both[at] for k, at in grouped(doc)}
        none = np.zeros(0, np.int64)
        kept, removed, runs = [], [], []
        for r, key in enumerate(zip(ids.tolist(), hashes.tolist(), strict=True)):
            start, end = removed_ranges(spans[key], length) if key in spans else (none, none)
            out, at = [], off[r]
            for a, b in zip((start + off[r]).tolist(), (end + off[r]).tolist(), strict=True):
                out.append(raw[at:a])
                at = b
            kept.append(b"".join([*out, raw[at : off[r + 1]]]))
            removed.append(int((end - start).sum()))
            runs.append(len(start))
        return pa.table(
            {
                "doc_id": pa.array(ids),
                "n_bytes": pa.array(np.diff(off)),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return work


def suffix_dedup(docs: DataFrame, length: int = 50, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for each row of ``docs(doc_id, text)``."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    keyed = text_key(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(BLOCK_BYTES // 2, total // HOT_KEYS)
    sizes = keyed.mapInArrow(trimmed(_key_sizes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    large = sorted((r[0] & ((1 << 64) - 1), 1 + r[1] // (BLOCK_BYTES // 2)) for r in sizes.where(F.col("n") > least).collect())
    hot = spark.sparkContext.broadcast(tuple(np.array([x[k] for x in large], U) for k in (0, 1)))

    runs = 1 + total * 2 // (length - GRAM + 2)
    bits = min(runs.bit_length() + 10, 60)
    depth = (runs * 16 // BUCKET_BYTES).bit_length()
    shards = 1 + 2 * total // SHARD_BYTES
    blocks = keyed.mapInArrow(trimmed(_pack_documents(1 + total // BLOCK_BYTES, hot)), SCHEMA)
    blocks = blocks.repartition(max(total // (16 * BLOCK_BYTES), partitions), "bucket")  # all uses below read this one shuffle
    lists = blocks.groupBy("bucket").applyInArrow(trimmed_group(_list_minimizers(length, bits, depth)), SCHEMA)
    lists = lists.repartition(max(1 << depth, partitions), "bucket").sortWithinPartitions("bucket")
    answers = lists.mapInArrow(trimmed(_answer(hot_runs)), SCHEMA)
    strings = blocks.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(trimmed_group(_send_strings(length, bits, shards)), SCHEMA)
    strings = strings.repartition(max(shards // 8, partitions), "bucket").sortWithinPartitions("bucket")
    spans = strings.mapInArrow(trimmed(_mark(length)), SCHEMA)
    out = blocks.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        trimmed_group(_cut(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit((1 << 63) - 1)))


def kept_digest(cut: DataFrame) -> DataFrame:
    """The operator's result with the digest of the remaining bytes in place of them."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
