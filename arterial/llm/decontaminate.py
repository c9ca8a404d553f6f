"""Benchmark decontamination by spaced seeds.

A seed is a mask over successive tokens; the tokens under its gaps are ignored, so an item and a text
agree on a seed even when tokens between were replaced. Every text position is hashed under every
mask and joined with the hashes of the benchmark's positions. Both sides bring the tokens around the
seed along, and the joined rows are verified one token by the other: an item counts as leaked
when some ``window`` successive tokens of it (all of them, if it is shorter) agree in ``percent`` of
their places, no token inserted or removed. The masks are lossless for the defaults: the replaced tokens
that 80 percent allow leave at least one seed intact, in any 16 tokens as in a whole item of 8 to 15.

Items of fewer than ``LEAST`` tokens have no room for these masks. They are seeded as a whole, under every
mask that leaves out just as many tokens as ``percent`` allows (one of 5 to 7 at 80 percent, none of 1 to 4),
so none of their placings is missed either.

Two bit tables of 2 ** ``bits`` bits each tell the texts which hashes the benchmark has at all; they are all that is
broadcast, whatever its size, and what they let through by chance ends in the join. A seed that many texts have is a
large key of the join, which adaptive execution splits on the side of the texts. A text that one task meets again
sends its hits once. Neither side is collected.

Tokens are runs of ASCII letters, digits and bytes above 127, with A-Z lower-cased: punctuation does
not matter. Defined cases: an item of few tokens counts wherever they stand, also by chance; an item without
tokens is never leaked; a null text is clean; repeated items count each; a null item_id is reported as
null; each row of documents is judged by itself, so null and repeated doc_ids are kept as they are.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, ODD, U, buffers, mix, pieces, span_hashes, trimmed, word_spans
from .common import stored

#: Masks of weight 5. Together they meet every placing of the tokens that 80 percent allow to differ, for each size
#: from ``LEAST`` to 16 (3 of 15 and 16, 2 of 10 to 14, 1 of 8 and 9); the last one is for 2 of 10.
MASKS = ("11111", "1101011", "111001001", "110111")
LEAST = 8
#: The logarithm of the bits of a table (8 MB for both), and of the bits that one row of it holds on its way to the driver.
BITS, ROW_BITS = 25, 16
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows and the first token's place for each row."""
    data = LOWER[data]
    start, end, row = word_spans(data, off, _INSIDE)
    first = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(row, minlength=len(off) - 1), out=first[1:])
    return span_hashes(data, start, end), first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each place that has room for the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(int.from_bytes(hashlib.md5(mask.encode()).digest()[:8], "little")))
    for j, bit in enumerate(mask):
        if bit == "1":
            h += words[j : j + n] * ODD[j + 8]
    return mix(h)


def whole_masks(size: int, percent: int) -> list[str]:
    """Masks over ``size`` tokens that leave out as many of them as may differ: together they meet every placing."""
    gone = size + -size * percent // 100
    return ["".join("01"[j not in out] for j in range(size)) for out in combinations(range(size), gone)]


def _seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and row of a mask's seeds that lie within a row."""
    h = seed_hashes(words, mask)
    place = np.arange(len(h))
    row = np.searchsorted(first, place, "right") - 1
    inside = place + len(mask) <= first[row + 1]
    return h[inside], place[inside], row[inside]


def _frames(words: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, window: int) -> pa.Array:
    """The tokens from ``window`` - 1 before each place to ``window`` after it as binary; zero outside of ``low`` to ``high``."""
    at = place[:, None] + np.arange(-(window - 1), window + 1)[None, :]
    inside = (at >= low[:, None]) & (at < high[:, None])
    frame = np.where(inside, words[np.clip(at, 0, max(len(words) - 1, 0))], U(0)) if len(words) else np.zeros(at.shape, U)
    return pa.array([x.tobytes() for x in frame], pa.binary())


SEED = "h long, item long, at int, size int, frame binary"


def _item_seeds(masks: tuple[str, ...], window: int, percent: int):
    """Kernel 1: the seeds of the items (``item``, ``text``), each with the tokens around it."""

    def work(batches):
        for batch in pieces(batches, "text"):
            words, first = tokens(*buffers(batch.column("text")))
            count = np.diff(first)
            item = batch.column("item").to_numpy()
            use: dict[str, list[int]] = {}
            for n in np.unique(np.minimum(count, window)).tolist():
                rows = np.flatnonzero(np.minimum(count, window) == n).tolist()
                for mask in masks if n >= LEAST else whole_masks(n, percent) if n else ():
                    use.setdefault(mask, []).extend(rows)
            for mask, rows in use.items():
                h, place, row = _seeds(words, first, mask)
                own = np.isin(row, rows)
                h, place, row = h[own], place[own], row[own]
                yield pa.record_batch(
                    {
                        "h": pa.array(h.view(np.int64)),
                        "item": pa.array(item[row]),
                        "at": pa.array((place - first[row]).astype(np.int32)),
                        "size": pa.array(count[row].astype(np.int32)),
                        "frame": _frames(words, first[row], first[row + 1], place, window),
                    }
                )

    return work


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the hashes in both tables."""
    return h >> U(64 - bits), (h >> U(8)) & U((1 << bits) - 1)


def _bit_row(table: pa.Table) -> pa.Table:
    """Kernel 2: a row of one of the tables from the bits that are set in it."""
    row = np.zeros(1 << ROW_BITS, bool)
    row[table.column("bit").to_numpy()] = True
    return pa.table({"row": table.column("row").slice(0, 1), "bits": pa.array([np.packbits(row, bitorder="little").tobytes()], pa.binary())})


def _bit_tables(seeds: DataFrame, bits: int) -> np.ndarray:
    """Both tables, packed: ``2 ** (bits - 2)`` bytes in all."""
    one, two = F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit((1 << bits) - 1))
    slots = seeds.select(F.explode(F.array(one, two + F.lit(1 << bits))).alias("slot")).distinct()
    slots = slots.select(F.shiftright("slot", ROW_BITS).cast("int").alias("row"), F.col("slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int").alias("bit"))
    if bits < ROW_BITS:
        raise ValueError(f"bits must be {ROW_BITS} or more")
    out = np.zeros((2 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row, own in slots.groupBy("row").applyInArrow(_bit_row, "row int, bits binary").collect():
        out[row] = np.frombuffer(own, np.uint8)
    return out.reshape(2, -1)


HIT = "h long, k1 long, k2 long, place int, n int, frame binary"


def _text_hits(masks: list[str], window: int, tables):
    """Kernel 3: of all seeds of the texts those that the benchmark may have, each with the tokens around it."""

    def work(batches):
        own_tables = tables.value
        bits = own_tables.shape[1].bit_length() + 2
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches, "text"):
            words, first = tokens(*buffers(batch.column("text")))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            new: dict[int, bool] = {}
            for mask in masks:
                h = seed_hashes(words, mask)
                a, b = _slots(h, bits)
                maybe = np.flatnonzero((own_tables[0][a >> U(3)] >> (a & U(7)).astype(np.uint8)) & 1)
                b = b[maybe]
                maybe = maybe[((own_tables[1][b >> U(3)] >> (b & U(7)).astype(np.uint8)) & 1).astype(bool)]
                row = np.searchsorted(first, maybe, "right") - 1
                inside = maybe + len(mask) <= first[row + 1]
                place, row = maybe[inside], row[inside]
                for r in np.unique(row).tolist():
                    if r not in new:
                        key = (int(k1[r]), int(k2[r]))
                        new[r] = key not in seen
                        if len(seen) < 1 << 20:
                            seen.add(key)
                own = np.array([new[r] for r in row.tolist()], bool)
                place, row = place[own], row[own]
                if len(place):
                    yield pa.record_batch(
                        {
                            "h": pa.array(h[place].view(np.int64)),
                            "k1": pa.array(k1[row]),
                            "k2": pa.array(k2[row]),
                            "place": pa.array((place - first[row]).astype(np.int32)),
                            "n": pa.array((first[row + 1] - first[row]).astype(np.int32)),
                            "frame": _frames(words, first[row], first[row + 1], place, window),
                        }
                    )

    return work


def best_windows(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most agreements of two rows of frames in ``size`` successive places between ``low`` and ``high``, and where they start first."""
    wide = a.shape[1]
    total = np.concatenate((np.zeros((len(a), 1), np.int16), np.cumsum(a == b, axis=1, dtype=np.int16)), axis=1)
    at = np.arange(wide)[None, :]
    end = at + size[:, None]
    got = np.take_along_axis(total, np.minimum(end, wide), axis=1) - total[:, :wide]
    got[(at < low[:, None]) | (end > high[:, None])] = -1
    first = got.argmax(axis=1)
    return got[np.arange(len(a)), first].astype(np.int64), first


def _verified(window: int, percent: int):
    """Kernel 4: of each joined pair the share of its best window, if that is large enough, its diagonal and place."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            place, n, at, count = (batch.column(c).to_numpy().astype(np.int64) for c in ("place", "n", "at", "size"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(batch.num_rows, -1) for c in ("frame", "frame2"))
            zero = window - 1  # where the seed starts in a frame
            low = zero - np.minimum(np.minimum(place, at), zero)
            high = zero + np.minimum(np.minimum(n - place, count - at), window + 1)
            size = np.minimum(window, count)
            most, first = best_windows(a, b, low, high, size)
            good = np.flatnonzero((most * 100 >= percent * size) & (most > 0))
            yield pa.record_batch(
                {
                    "k1": batch.column("k1").take(pa.array(good)),
                    "k2": batch.column("k2").take(pa.array(good)),
                    "item": batch.column("item").take(pa.array(good)),
                    "per_mille": pa.array((most * 1000 // size)[good]),
                    "diagonal": pa.array((at - place)[good]),  # the smallest one of equals is the largest of these
                    "token": pa.array((zero - first - place)[good]),
                }
            )

    return work


LEAKS = "array<struct<item_id: long, first_token: long, per_mille: long>>"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 16, percent: int = 80, bits: int = BITS
) -> DataFrame:
    """``docs`` with a column ``leaks``: for each leaked item its id, the place of its best window and the share agreed.

    A column of ``docs`` with that name is replaced. Rows and other columns stay as they are.
    """
    spark = docs.sparkSession
    known = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # equal items are one, with all their ids
    known = known.groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids")).withColumn("item", F.xxhash64("text"))
    seeds = known.select("item", "text").mapInArrow(trimmed(_item_seeds(masks, window, percent)), SEED)
    sizes = known.select("item", "text").mapInArrow(_short_sizes(window), "size int").distinct().collect()  # fewer than LEAST numbers
    short = [m for r in sorted(r[0] for r in sizes) for m in whole_masks(r, percent)]
    tables = spark.sparkContext.broadcast(_bit_tables(seeds, bits))
    texts = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    hits = texts.mapInArrow(trimmed(_text_hits([*masks, *short], window, tables)), HIT)
    met = hits.join(seeds.withColumnRenamed("frame", "frame2"), "h")
    columns = "k1 long, k2 long, item long, per_mille long, diagonal long, token long"
    good = met.mapInArrow(trimmed(_verified(window, percent)), columns)
    best = good.groupBy("k1", "k2", "item").agg(F.max(F.struct("per_mille", "diagonal", "token")).alias("best"))
    told = best.join(known.select("item", F.explode("ids").alias("id")), "item").groupBy("k1", "k2")
    told = told.agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("id.item_id").alias("item_id"), (-F.col("best.token")).alias("first_token"), F.col("best.per_mille").alias("per_mille"))
            )
        ).alias("leaks")
    ).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "leaks")
    told = stored(told, "leaks")  # of known size now: while it is small, no document is shuffled to meet it
    own = docs.drop("leaks", "__k1", "__k2")
    out = own.withColumn("__k1", F.xxhash64("text")).withColumn("__k2", F.xxhash64("text", F.lit(1))).join(told, ["__k1", "__k2"], "left")
    leaks = F.when(F.col("text").isNotNull(), F.col("leaks"))
    return out.select(*(F.col(f"`{c}`") for c in own.columns), F.coalesce(leaks, F.expr(f"CAST(array() AS {LEAKS})")).alias("leaks"))


def _short_sizes(window: int):
    """The sizes below ``LEAST`` of the items' windows."""

    def work(batches):
        for batch in pieces(batches, "text"):
            _, first = tokens(*buffers(batch.column("text")))
            n = np.unique(np.minimum(np.diff(first), window))
            yield pa.record_batch({"size": pa.array(n[(n > 0) & (n < LEAST)].astype(np.int32))})

    return work
