"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of fixed length.  Filters of several widths slide over
the bytes of a window (a filter of width w has one weight for each byte value at
each of its w places), max pooling keeps each filter's best response, and a
softmax layer turns the responses into language probabilities.  A text's score
for a language is the mean over all of its windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bound on the labelled documents of each language that training reads, and on the languages learnt.
SAMPLE = 400
MOST_LANGS = 300
CHUNK = 64
#: Training steps at least, however few the labelled documents are.
LEAST_STEPS = 300


@dataclass
class Model:
    langs: list[str]
    #: For each width an array (width, 256, filters), and the filters' biases.
    tables: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    @cached_property
    def pairs(self) -> list[list[tuple[int, np.ndarray]]]:
        """The filters' tables by pairs of bytes, made once in each process."""
        return pair_tables(self.tables)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of `size` bytes; the last one is filled up with zeros."""
    n = -(-len(text) // size)
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, size)


def responses(tables: list[np.ndarray], x: np.ndarray, places: bool = False):
    """Max-pooled filter responses (rows, all filters), and with places where each is found."""
    pooled, found = [], []
    for table in tables:
        width = len(table)
        span = x.shape[1] - width + 1
        total = table[0][x[:, :span]]
        for j in range(1, width):
            total += table[j][x[:, j : j + span]]
        if places:
            found.append(total.argmax(axis=1))
        pooled.append(total.max(axis=1))
    return np.concatenate(pooled, axis=1), found


def pair_tables(tables: list[np.ndarray]) -> list[list[tuple[int, np.ndarray]]]:
    """The same filters by pairs of bytes: fewer look-ups for each place."""
    out = []
    for table in tables:
        own = [
            (j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(table) - 1, 2)
        ]
        if len(table) % 2:
            own.append((-(len(table) - 1), table[-1]))
        out.append(own)
    return out


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities of each window, in chunks that stay in the cache."""
    out = np.empty((len(x), len(model.langs)), dtype=np.float64)
    for s in range(0, len(x), CHUNK):
        part = x[s : s + CHUNK]
        both = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        pooled = []
        for table, own in zip(model.tables, model.pairs):
            span = part.shape[1] - len(table) + 1
            total = None
            for j, values in own:
                add = values.take(both[:, j : j + span], axis=0) if j >= 0 else values.take(part[:, -j : span - j], axis=0)
                total = add if total is None else np.add(total, add, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0)
        logits = (hidden @ model.weight + model.offset).astype(np.float64)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[s : s + CHUNK] = e / e.sum(axis=1, keepdims=True)
    return out


def pieces_of(text: bytes, seed: int) -> list[bytes]:
    """What training takes of a text: two whole windows and a short piece, as short texts have; chosen by the seed."""
    x = windows_of(text)
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    out = [x[k].tobytes() for k in rng.choice(len(x), size=min(2, len(x)), replace=False)]
    words = text.split()
    at, n = int(rng.integers(len(words))) if words else 0, int(rng.integers(1, 9))
    return [*out, b" ".join(words[at : at + n])[:WINDOW].ljust(WINDOW, b"\0")]


def fit(windows: list[bytes], langs: list[str], epochs: int = 6, seed: int = 3, filters: int = FILTERS) -> Model:
    """Trains the network on windows by Adam on cross-entropy; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y_of = {lang: i for i, lang in enumerate(names)}
    f32 = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    tables = [f32(w, 256, filters) for w in WIDTHS]
    n_hidden = filters * len(WIDTHS)
    params = [*tables, np.zeros(n_hidden, np.float32), f32(n_hidden, len(names)), np.zeros(len(names), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    x = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([y_of[lang] for lang in langs])
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS // max(1, -(-len(y) // 64))))):
        order = rng.permutation(len(y))
        for s in range(0, len(y), 64):
            at = order[s : s + 64]
            part = x[at]
            pooled, places = responses(params[: len(WIDTHS)], part, places=True)
            pre = pooled + params[-3]
            hidden = np.maximum(pre, 0)
            logits = hidden @ params[-2] + params[-1]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = (p @ params[-2].T) * (pre > 0)
            grads = []
            for i, (w, place) in enumerate(zip(WIDTHS, places)):
                g = np.zeros_like(params[i])
                own = back[:, i * filters : (i + 1) * filters]
                for j in range(w):
                    byte = np.take_along_axis(part, place + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(filters)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def training_rows(docs: DataFrame, held_out, sample: int) -> list[tuple[str, bytes]]:
    """(lang, window) of about `sample` labelled documents of each language, at most twice as many.

    Documents are chosen by a hash of doc_id, so the choice does not depend on how rows are
    dealt out.  The windows are cut where the texts lie: the driver gets three windows of a
    document, and of languages the MOST_LANGS commonest.
    """
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    counts = {r.lang: r.n for r in common.collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30).cast("long"))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1, sample / n))))])
    chosen = labelled.where(place < F.try_element_at(share, F.col("lang")))
    chosen = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string"), place.alias("place"), F.xxhash64("text").alias("own"))

    def cut_up(batch: pa.RecordBatch):
        rows = list(zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
        made = [(lang, place, own, i, w) for lang, text, place, own in rows for i, w in enumerate(pieces_of(text, own % (1 << 32)))]
        kinds = {"lang": pa.string(), "place": pa.int64(), "own": pa.int64(), "i": pa.int32(), "window": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    windows = map_batches(chosen, cut_up, "lang string, place long, own long, i int, window binary")
    rows = windows.orderBy("place", "own", "i", "lang").limit(6 * sample * len(counts)).collect()
    return [(r.lang, bytes(r.window)) for r in rows]


def train_on(docs: DataFrame, sample: int = SAMPLE, folds: int = 4, held_fold: int = 2) -> Model | None:
    """A model from a bounded sample (about `sample` documents of each language) of the rows
    that have a lang and whose crc32 of doc_id as text is not held_fold modulo folds."""
    rows = training_rows(docs, held_out(folds, held_fold), sample)
    return fit([w for _, w in rows], [lang for lang, _ in rows]) if rows else None


def held_out(folds: int = 4, held_fold: int = 2):
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return F.coalesce(crc % folds == held_fold, F.lit(False))


def predictor(docs: DataFrame, model: Model | None):
    """A function of a text column that gives struct(lang_pred, score)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: pa.Array, letters: pa.Array) -> pa.Array:
        net = shared.value
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        at, parts, sizes = [], [], []
        if net is not None:
            for i, (t, letter) in enumerate(zip(utf8(texts), letters.to_pylist())):
                if letter:
                    at.append(i)
                    parts.append(windows_of(t))
                    sizes.append(len(t))
        if at:
            p = predict(net, np.concatenate(parts))
            fill = [np.r_[np.full(len(w) - 1, WINDOW), n - WINDOW * (len(w) - 1)] for w, n in zip(parts, sizes)]
            starts = np.r_[0, np.cumsum([len(w) for w in parts])[:-1]]
            mean = np.add.reduceat(p * np.concatenate(fill)[:, None], starts, axis=0) / np.array(sizes)[:, None]
            for i, row in zip(at, mean):
                langs[i] = net.langs[int(row.argmax())]
                scores[i] = min(1.0, float(row.max()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return lambda text: judge(text.cast("string"), F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Model | None = None, **training) -> DataFrame:
    """Predicts the language of each whole text; the input rows plus held_out, lang_pred and score.

    score is the mean probability of lang_pred over the text's windows, 0 to 1.  Without
    a model one is trained (train_on).

    Texts are read whole, however long.  Of languages with equal mean probability the
    first by name is taken.  A null text, and one without a letter, gets und and score 0;
    so does every text where nothing is labelled.  A null doc_id is not held out.  Repeated rows are
    judged each; columns named like the new ones are replaced.  An empty table gives
    an empty result.
    """
    model = model or train_on(docs, **training)
    judged = docs.select(F.struct("*").alias("row"), predictor(docs, model)(F.col("text")).alias("judged"), held_out().alias("held"))
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("held").alias("held_out"), "judged.lang_pred", "judged.score"
    )
