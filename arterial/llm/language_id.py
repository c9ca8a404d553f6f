"""Language ID by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit one binary classifier over hashed byte
trigrams tells the languages with +1 from those with -1; its margin is the mean log odds of a text's
trigrams (a naive Bayes classifier). Decoding weighs every bit by how much better than chance it tells the
training texts apart, adds the logistic losses of the margins against each codeword, and takes the codeword of
least loss. When the runner-up is nearly as near, the row is flagged as ambiguous.

Fitting uses at most ``per_language`` distinct labelled texts of each language (those of the smallest hashes),
whole texts; that bound keeps the model's cost constant. Equal texts count once, however many rows have them.
At most ``MOST_LANGUAGES`` languages; one whose chosen texts have no trigram is not learned. The prediction reads
only the text.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not ambiguous; with no
labelled text at all everything is ``und``; with one language every text with a letter gets it, with
score 1; null doc_ids and repeated rows are predicted like any other row; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import LOWER, buffers, pieces, trimmed
from .common import discard, stored

BITS = 16
MOST_LANGUAGES = 512
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that start at each place but the last two (A-Z lower-cased)."""
    x = LOWER[data].astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A code of n rows. Up to 7 languages get all splits in two; more get random columns of which rows stay far apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    size = int(np.ceil(10 * np.log2(n)))
    draw = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(64):
        code = draw.choice((-1.0, 1.0), (n, size))
        code[0, (code == code[0]).all(axis=0)] *= -1
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: trigram buckets of the training texts of each language."""
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 0))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        weights = []
        for bit in self.code.T:
            if (bit == bit[0]).all():
                weights.append(np.zeros(counts.shape[1]))
                continue
            weights.append(np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)))
        self.weights = np.array(weights, np.float32)
        #: The unit of each bit's margins: the least mean margin of a training language on its right side.
        means = share @ self.weights.T if languages else np.zeros((0, 0))
        self.scale = np.maximum((means * self.code).min(axis=0), 0.05) if languages else np.zeros(0)
        #: The weight of each bit's loss; see :meth:`weigh`.
        self.trust = np.ones(self.code.shape[1])

    def right(self, data: np.ndarray, off: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many rows (of languages ``number``) have each bit's margin on the right side."""
        return (self.margins(data, off) * self.code[number] > 0).sum(axis=0)

    def weigh(self, right: np.ndarray, rows: int) -> None:
        """Weigh the bits by their accuracy above chance on ``rows`` training texts."""
        self.trust = np.maximum(2 * right / max(rows, 1) - 1, 0.05)

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean log odds of each row under each bit; 0 for rows of fewer than 3 bytes."""
        rows = len(off) - 1
        out = np.zeros((rows, len(self.weights)))
        if len(data) < 3:
            return out
        h = trigrams(data)
        start, end = off[:-1], np.maximum(off[1:] - 2, off[:-1])
        some = np.flatnonzero(end > start)
        # trigrams over the border of two rows lie between a row's end and the next one's start
        cut = np.stack([start[some], np.minimum(end[some], len(h))], axis=1).ravel()
        for k, w in enumerate(self.weights):
            total = np.concatenate(([0.0], np.cumsum(w[h], dtype=np.float64)))[cut]
            out[some, k] = (total[1::2] - total[::2]) / (end[some] - start[some])
        return out

    def decode(self, margins: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and the lead over the runner-up for each row."""
        scaled = margins / self.scale * sharpness
        loss = np.stack([(self.trust * np.logaddexp(0, -scaled * c)).sum(axis=1) for c in self.code], axis=1) / self.trust.sum()
        if loss.shape[1] == 1:
            return np.zeros(len(loss), int), np.ones(len(loss)), np.ones(len(loss))
        p = np.exp(-sharpness * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        ordered = np.sort(p, axis=1)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best], ordered[:, -1] - ordered[:, -2]


def _chosen(labelled: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """``lang, text``: the distinct texts of the ``most`` smallest hashes of each language.

    ``sizes``: about how many distinct texts a language has; only hashes below twice what that needs are
    ordered, and beyond ``most`` texts a language loses none of them but by that order.
    """
    part = F.lit(1.0)
    for x, n in sizes.items():
        if n > most:
            part = F.when(F.col("lang") == x, F.lit(min(1.0, 2.5 * most / n))).otherwise(part)
    h = F.xxhash64("text")
    near = labelled.where(F.pmod(h, F.lit(1 << 30)) <= part * (1 << 30)).select("lang", F.pmod(h, F.lit(1 << 30)).alias("place"), h.alias("h"), "text")
    once = near.dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "text")


def fit(train: DataFrame, per_language: int = 2000) -> Model:
    """A model of the labelled rows of ``train(text, lang)``."""
    labelled = train.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.05))
    sizes = {r[0]: r[1] for r in sizes.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((0, 1 << BITS)))
    chosen = stored(_chosen(labelled, sizes, per_language), "training")
    names = sorted(sizes)
    number = {x: i for i, x in enumerate(names)}

    def count(batches):
        total = np.zeros((len(number), 1 << BITS), np.int64)
        for batch in pieces(batches, "text"):
            data, off = buffers(batch.column("text"))
            for r, lang in enumerate(batch.column("lang").to_pylist()):
                if off[r + 1] - off[r] >= 3:
                    total[number[lang]] += np.bincount(trigrams(data[off[r] : off[r + 1]]), minlength=1 << BITS)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array(lang), "bucket": pa.array(bucket), "n": pa.array(total[lang, bucket])})

    counts = np.zeros((len(names), 1 << BITS))
    # languages times buckets rows at most reach the driver
    for lang, bucket, n in chosen.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect():
        counts[lang, bucket] = n
    some = counts.sum(axis=1) > 0
    model = Model([x for x, good in zip(names, some, strict=True) if good], counts[some])
    if len(model.languages) > 1:
        shared = chosen.sparkSession.sparkContext.broadcast(model)

        def judge(batches):
            own = shared.value
            place = {x: i for i, x in enumerate(own.languages)}
            for batch in pieces(batches, "text"):
                batch = batch.filter(pa.array([x in place for x in batch.column("lang").to_pylist()]))
                data, off = buffers(batch.column("text"))
                right = own.right(data, off, np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64))
                bits = np.append(right, batch.num_rows)
                yield pa.record_batch({"bit": pa.array(np.arange(len(bits))), "n": pa.array(bits.astype(np.int64))})

        right = np.zeros(model.code.shape[1] + 1)
        for bit, n in chosen.mapInArrow(trimmed(judge), "bit long, n long").groupBy("bit").agg(F.sum("n")).collect():
            right[bit] = n
        model.weigh(right[:-1], int(right[-1]))
    discard(chosen)
    return model


def identify(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), sharpness: float = 8.0, lead: float = 0.1
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for each row's ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    columns = [*kept, "text"] if "text" not in kept else kept

    def work(batches):
        own = shared.value
        for batch in pieces(batches, "text"):
            text = batch.column("text")
            data, off = buffers(text)
            rows = batch.num_rows
            ascii_letter = np.zeros(len(data) + 1, np.int64)
            np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122), out=ascii_letter[1:])
            letter = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
            for r in np.flatnonzero(~letter & (off[1:] > off[:-1])).tolist():
                letter[r] = bool(_LETTER.search(text[r].as_py()))
            pred = np.full(rows, "und", object)
            score, ambiguous = np.zeros(rows), np.zeros(rows, bool)
            if own.languages and letter.any():
                best, p, first = own.decode(own.margins(data, off), sharpness)
                pred[letter] = np.array(own.languages, object)[best[letter]]
                score[letter] = p[letter]
                ambiguous[letter] = first[letter] < lead
            made = {c: batch.column(c) for c in kept}
            yield pa.record_batch(
                made | {"lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(score), "ambiguous": pa.array(ambiguous)}
            )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*columns).mapInArrow(trimmed(work), schema)


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
