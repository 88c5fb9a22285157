"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of WINDOW bytes, the last one padded with zero bytes. Filters of several widths run
over the bytes; each filter's maximum over a window, rectified, feeds a softmax layer. The scores of a text's windows
are averaged by their bytes. All windows count, so the whole text does.

For speed in prediction, a filter's weights for two neighbouring bytes are added up beforehand in a table of all byte pairs:
a window position then costs two look-ups at most for each width.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import slices, spare

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Training: windows at most (those of least hash), windows of one text, passes over them, windows in a step.
TRAIN_WINDOWS, TEXT_WINDOWS, EPOCHS, BATCH = 6_000, 2, 4, 64
#: Windows of each language at least, if it has them.
LANGUAGE_WINDOWS = 100
#: Predicting: windows at once, so that a step's numbers stay in the processor's cache.
AT_ONCE = 64
#: Windows that Usual scores at once.
SCORED = 4_096
UNKNOWN = "und"
#: Lengths in bytes at which the level of Usual is set, its distance in standard deviations, and the least number of windows it takes.
SIZES, SPREADS, LEAST_LEFT = (16, 32, 64, 128, 240), 8.0, 20
DIGITS = b"0123456789"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, at least one."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def pair_codes(text: bytes) -> np.ndarray:
    """A text's neighbouring bytes as first * 256 + second."""
    x = np.frombuffer(text, np.uint8).astype(np.int32)
    return (x[:-1] << 8) | x[1:]


class Usual:
    """How usual a text's byte pairs are for the languages learned, and the level below which a text is in none of those learned.

    The score of a text is the mean log probability of its bytes, each after the one before, in the language that suits each WINDOW of it
    best, so a text in several languages is usual; digits have no part. Three quarters of the windows are counted; at
    beginnings of the others, of several lengths, the level is set: SPREADS standard deviations below their mean. It doesn't depend on how
    many languages there are. Of under LEAST_LEFT such windows there is no level.
    """

    def __init__(self, wins: list[bytes], y: np.ndarray, n_langs: int):
        texts = [w.rstrip(b"\0").translate(None, DIGITS) for w in wins]
        counts = np.zeros((n_langs, 65536))
        for i, t in enumerate(texts):
            if i % 4 != 3:
                np.add.at(counts[y[i]], pair_codes(t), 1)
        c = counts.reshape(n_langs, 256, 256)
        one = (c.sum(1) + 0.1) / (c.sum((1, 2)) + 25.6)[:, None]
        self.log = np.log((c + 5 * one[:, None, :]) / (c.sum(2, keepdims=True) + 5)).astype(np.float32).reshape(n_langs, 65536)
        self.sizes, self.levels = [], []
        for size in SIZES:
            got = np.array([self.score(t[:size]) for i, t in enumerate(texts) if i % 4 == 3 and len(t) >= size])
            if len(got) >= LEAST_LEFT:
                self.sizes.append(np.log(size))
                self.levels.append(float(got.mean() - SPREADS * got.std()))

    def score(self, text: bytes) -> float:
        total, step = 0.0, SCORED * WINDOW
        for at in range(0, len(text) - 1, step):  # long texts by runs of windows
            codes = pair_codes(text[at : at + step + 1])
            starts = np.arange(0, len(codes), WINDOW)
            total += float(np.max([np.add.reduceat(log.take(codes), starts) for log in self.log], axis=0).sum())
        return total / max(len(text) - 1, 1)

    def odd(self, text: bytes) -> bool:
        """Whether a text's score is below the level for its length; texts shorter than the lengths with a level are not."""
        text = text.translate(None, DIGITS)
        if not self.sizes or np.log(max(len(text), 1)) < self.sizes[0]:
            return False
        return self.score(text) < np.interp(np.log(len(text)), self.sizes, self.levels)


class Network:
    usual: Usual | None = None

    def __init__(self, names: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.names = names
        self.conv = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32)
        self.out_bias = np.zeros(len(names), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        best, where = [], {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            s = self.conv[w][0][x[:, :n]]
            for o in range(1, w):
                s += self.conv[w][o][x[:, o : o + n]]
            where[w] = s.argmax(axis=1)
            best.append(np.take_along_axis(s, where[w][:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), where

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01) -> None:
        """Adam on the cross-entropy, rarer languages weighing more."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.names)) / max(len(y), 1)
        weight = 1 / np.sqrt(np.maximum(share, 1e-6))
        weight /= (weight * share).sum()
        parts = [*(self.conv[w] for w in WIDTHS), self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                b = order[at : at + BATCH]
                xb, rows = x[b], np.arange(len(b))
                pooled, where = self._pooled(xb)
                h = np.maximum(pooled + self.bias, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, y[b]] -= 1
                d = (p * weight[y[b]][:, None] / len(b)).astype(np.float32)
                dh = (d @ self.out.T) * (h > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g, dw = np.zeros_like(self.conv[w]), dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(g[o], (xb[rows[:, None], where[w] + o], np.arange(FILTERS)[None, :]), dw)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ d, d.sum(0)]
                step += 1
                for q, g, mq, vq in zip(parts, grads, m, v, strict=True):
                    mq += 0.1 * (g - mq)
                    vq += 0.01 * (g * g - vq)
                    q -= rate * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.99**step)) + 1e-7)

    def tables(self) -> None:
        """Sums for byte pairs, for scores(); a pair's index is first + 256 * second."""
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, FILTERS)
        self.pairs = {2: [pair(*self.conv[2])], 3: [pair(*self.conv[3][:2]), self.conv[3][2]], 4: [pair(*self.conv[4][:2]), pair(*self.conv[4][2:])]}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised scores of each window's languages."""
        out = np.empty((len(x), len(self.names)), np.float32)
        for at in range(0, len(x), AT_ONCE):
            xb = x[at : at + AT_ONCE]
            two = xb[:, :-1].astype(np.uint16) | (xb[:, 1:].astype(np.uint16) << 8)
            best = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                s = self.pairs[w][0].take(two[:, :n], axis=0)
                if w == 3:
                    s += self.pairs[3][1].take(xb[:, 2:], axis=0)
                elif w == 4:
                    s += self.pairs[4][1].take(two[:, 2:], axis=0)
                best.append(s.max(axis=1))
            h = np.maximum(np.concatenate(best, 1) + self.bias, 0)
            out[at : at + AT_ONCE] = h @ self.out + self.out_bias
        return out


def held_out(doc_id):
    """Whether the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_windows: int = TRAIN_WINDOWS) -> Network | None:
    """A network learned from the rows that aren't held out and have an id, a language and a letter; None without such rows.

    The sample is bounded: at most TEXT_WINDOWS windows at hash-random places are drawn from a text, and of these those of least hash: for
    each language its share of train_windows, and LANGUAGE_WINDOWS at least, so that rare languages are learned too. Places and hashes come from id and
    text together, so rows of one id are as many rows as they have texts, and rows equal in both are one. Only rows of a low hash for their language are
    opened, some four times as many as are needed by an estimate of its different rows; each task gives a language's least ones, and of
    these the least are kept before the driver gets them: the sample, and two numbers for each language.
    """
    import xxhash

    x = docs.filter(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).cast("string").rlike(r"\p{L}"))
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("binary"))
    x = x.select(key.alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    sizes = x.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("different")).collect()
    total = sum(r.n for r in sizes)
    take = {r.lang: max(LANGUAGE_WINDOWS, train_windows * r.n // total) for r in sizes}
    if not take:
        return None
    bounds = [(r.lang, take[r.lang], int(min(1.0, 4 * take[r.lang] / max(r.different, 1)) * (1 << 30))) for r in sizes]
    told = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, take long, bound long"))
    x = x.join(told, "lang").filter(F.pmod("key", F.lit(1 << 30)) < F.col("bound")).select("key", "lang", "take", "text")

    def draw(batches):
        held: dict[str, dict] = {}
        for batch in slices(batches):
            for k, name, most, t in zip(*(batch.column(c) for c in range(4)), strict=True):
                own = held.setdefault(name.as_py(), {})
                seeds = [xxhash.xxh3_64_intdigest(k.as_py().to_bytes(8, "big", signed=True), n) >> 1 for n in range(TEXT_WINDOWS)]
                if seeds[0] in own or not has_letter(t := t.as_py()):
                    continue
                w = windows(t)
                for seed in {s % len(w): s for s in reversed(seeds)}.values():
                    own[seed] = w[seed % len(w)].tobytes()
                if len(own) > 2 * most.as_py() + TEXT_WINDOWS:
                    held[name.as_py()] = dict(sorted(own.items())[: most.as_py()])
        for name, own in held.items():
            cols = [pa.array(list(own), pa.int64()), pa.array([name] * len(own), pa.string()), pa.array(list(own.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "lang", "win"])

    drawn = x.mapInArrow(draw, "at long, lang string, win binary").distinct().join(told, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "win"))
    drawn = drawn.withColumn("place", place).filter(F.col("place") <= F.col("take")).select("at", "lang", "win").toArrow()
    drawn = drawn.sort_by([("at", "ascending"), ("lang", "ascending"), ("win", "ascending")])
    if not len(drawn):
        return None
    names, y = np.unique(drawn["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    net = Network(names.tolist())
    net.train(np.frombuffer(b"".join(drawn["win"].to_pylist()), np.uint8).reshape(-1, WINDOW), y)
    net.usual = Usual(drawn["win"].to_pylist(), y, len(names))
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score", odd: str | None = None) -> DataFrame:
    """Columns `keep` (None: all) with the predicted language and its score, 0 to 1. Of languages with equal scores the first by name is taken.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every text without a network. A column of `keep` with a new name is
    replaced. odd: name of a column that says whether the text is unlike those learned from. One row out for each row in. The network (some 10 MB at most with its tables, which workers build) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (lang, score, odd)]
    last = spare(docs, "text_of")
    there = text in keep and docs.schema[text].dataType in (T.StringType(), T.BinaryType())  # it moves once
    x = docs.select(*keep) if there else docs.select(*keep, F.col(text).cast("binary").alias(last))
    at = keep.index(text) if there else len(keep)
    schema = T.StructType([*x.drop(last).schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(odd, T.BooleanType())] if odd else [])])

    def run(batches):
        net = held.value
        if net is not None:
            net.tables()
        for batch in slices(batches):
            names, sure, strange = [], [], []
            for t in batch.column(at).cast(pa.binary()):
                t = t.as_py()
                if net is None or not t or not has_letter(t):
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    strange.append(False)
                    continue
                w = windows(t)
                z = net.scores(w).astype(np.float64)
                sizes = np.full(len(w), WINDOW)
                sizes[-1] = len(t) - WINDOW * (len(w) - 1)
                z = sizes @ z / len(t)
                p = np.exp(z - z.max())
                names.append(net.names[int(z.argmax())])
                sure.append(float(p.max() / p.sum()))
                strange.append(bool(odd and net.usual and net.usual.odd(t)))
            made = [pa.array(names, pa.string()), pa.array(sure, pa.float64()), *([pa.array(strange, pa.bool_())] if odd else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, lang, score, *([odd] if odd else [])])

    return x.mapInArrow(run, schema)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a network learned from those not held out.

    A null id isn't held out, and such a row isn't learned from; without a row to learn from all are UNKNOWN. Null texts, empty ones and those without a
    letter are UNKNOWN with score 0. Of languages that tie the first by name is taken. Repeated rows are judged alike, and learned from once; all
    windows of a long text count. One row out for each row in.
    """
    return identify(docs.withColumn("held_out", held_out("doc_id")), fit(docs), keep=["doc_id", "held_out"])


#: Least score with which a document passes the filter.
LEAST_SCORE = 0.3


def keep_known(docs: DataFrame, least: float = LEAST_SCORE, languages: list[str] | None = None) -> DataFrame:
    """docs whose language is known with a score of at least `least` (and among `languages`) and whose text is like those learned from; the
    columns stay.

    Rows without a letter go, null and empty texts among them; without rows to learn from all go. Repeated rows are judged alike, long texts whole; a
    tie of two languages is the first one's by name; an empty table stays empty.
    """
    lang, score, odd = spare(docs, "lang_pred"), spare(docs, "lang_score"), spare(docs, "lang_odd")
    x = identify(docs, fit(docs), lang=lang, score=score, odd=odd).filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least) & ~F.col(odd))
    return (x.filter(F.col(lang).isin(languages)) if languages else x).select(*docs.columns)
