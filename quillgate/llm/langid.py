"""Language identification: a byte convolutional network, trained in numpy, over windows of whole texts.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum in a window, and a softmax layer names the language.  The windows tile the whole text; a text's
probabilities are the means of its windows, weighted by their letters.

Defined results: a text that is null or has no letter is ``und`` with score 0; with nothing to learn from
every other text is ``und`` with score 0, too; with one language learnt it has score 1; languages of equal
probability give the one that comes first by name; a very long text is read window by window; repeated rows
get equal results; only the text column is read, so other columns cannot clash.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.store import held_out, one_text, saved
from quillgate.llm.words import column_passes

WINDOW = 200
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 8
#: Most documents of a language that are learnt from, and most of all languages together (one of each at least).
PER_LANGUAGE = 1000
MOST_DOCUMENTS = 256_000
#: Windows cut from each document of the sample.
CUTS = 4
_REACH = max(WIDTHS)


class Model(NamedTuple):
    """Byte embeddings, filters over the longest width (shorter ones end in zeros), their biases, and the last layer."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    names: list


def windows_of(data, offsets):
    """(windows, number of windows of each text): texts cut into WINDOW bytes, the last one filled with zeros."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    first = (np.cumsum(count) - count) * WINDOW
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first - offsets[:-1], size)] = data
    return out.reshape(-1, WINDOW), count


def pooled(model, windows, block=256):
    """Maximum of every filter in every window; one matrix product for each of _REACH alignments, nothing copied."""
    cells = WINDOW // _REACH
    out = np.empty((len(windows), model.filters.shape[1]), np.float32)
    for lo in range(0, len(windows), block):
        part = windows[lo:lo + block]
        n = len(part)
        flat = np.zeros((n * WINDOW + _REACH, EMBEDDING), np.float32)
        flat[:n * WINDOW] = model.embedding[part.reshape(-1)]
        best = None
        for shift in range(_REACH):
            rows = flat[shift:shift + n * WINDOW].reshape(n * cells, _REACH * EMBEDDING)
            got = (rows @ model.filters).reshape(n, cells, -1)
            # shifted by one or more, the last place reaches into the next window
            top = got[:, :cells - (shift > 0)].max(axis=1)
            best = top if best is None else np.maximum(best, top)
        out[lo:lo + n] = best
    return np.maximum(out + model.bias, 0)


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows, labels, names, steps=600, batch=128, rate=0.01, seed=7):
    """Adam on the cross entropy; only the places of the maxima send gradients back."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    alive = np.zeros((_REACH, EMBEDDING, n_filters), np.float32)
    for i, width in enumerate(WIDTHS):
        alive[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
    alive = alive.reshape(_REACH * EMBEDDING, n_filters)
    weights = [
        rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.3, alive.shape) * alive, np.zeros(n_filters),
        rng.normal(0, 0.3, (n_filters, len(names))), np.zeros(len(names))]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = 1.0 / np.bincount(labels, minlength=len(names))[labels]
    share = share / share.sum()
    for step in range(1, steps + 1):
        mine = rng.choice(len(windows), batch, p=share)
        x, y = windows[mine], labels[mine]
        embedding, filters, bias, out, out_bias = weights
        places = WINDOW - _REACH + 1
        seen = np.lib.stride_tricks.sliding_window_view(embedding[x], _REACH, axis=1)  # batch, place, embedding, reach
        seen = seen.transpose(0, 1, 3, 2).reshape(batch * places, _REACH * EMBEDDING)
        score = (seen @ filters).reshape(batch, places, n_filters)
        top = score.argmax(axis=1)
        best = np.take_along_axis(score, top[:, None, :], axis=1)[:, 0] + bias
        hidden = np.maximum(best, 0)
        error = softmax(hidden @ out + out_bias)
        error[np.arange(batch), y] -= 1
        error /= batch
        back = (error @ out.T) * (best > 0)
        rows = (np.arange(batch)[:, None] * places + top).reshape(-1)
        patch = seen[rows].reshape(batch, n_filters, -1)
        g_filters = np.einsum("bfk,bf->kf", patch, back) * alive
        g_patch = (filters.T[None] * back[:, :, None]).reshape(-1, _REACH, EMBEDDING)
        at = (top.reshape(-1)[:, None] + np.arange(_REACH)) + (np.repeat(np.arange(batch), n_filters) * WINDOW)[:, None]
        g_embedding = np.zeros_like(embedding)
        np.add.at(g_embedding, x.reshape(-1)[at.reshape(-1)], g_patch.reshape(-1, EMBEDDING))
        grads = [g_embedding, g_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - (rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Model(*[w.astype(np.float32) for w in weights], list(names))


def _cut(batches):
    """Up to CUTS evenly spaced windows of each text of the sample."""
    for batch in batches:
        langs, cuts = [], []
        for lo, hi, data, offsets in column_passes(batch.column("text")):
            tiles, count = windows_of(data, offsets)
            ends = np.cumsum(count)
            for i in range(hi - lo):
                for j in sorted({int(c * count[i] // CUTS) for c in range(CUTS)}) if count[i] else ():
                    langs.append(batch.column("lang")[lo + i].as_py())
                    cuts.append(tiles[ends[i] - count[i] + j].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cuts, pa.binary())], ["lang", "cut"])


def _picked(docs, id_column, lang_column):
    """(id, lang) of a bounded number of documents of every language, those with the smallest hashes.

    Languages are counted first; where there are many documents, only hashes below a threshold that leaves about
    twice the wanted number are ranked, so a language with most of all rows is no large group.
    """
    known = docs.where(F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & ~held_out(id_column))
    known = saved(known.groupBy(F.col(id_column).alias("id")).agg(F.min(lang_column).alias("lang")), "known-languages")
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    quota = max(1, min(PER_LANGUAGE, MOST_DOCUMENTS // max(counts.count(), 1)))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    low = known.join(F.broadcast(counts) if counts.count() <= MOST_DOCUMENTS else counts, "lang").where(
        (F.col("n") <= 4 * quota + 200) | (place * F.col("n") < 2 * quota + 100))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 53)), "id"))
    return saved(low.withColumn("nth", nth).where(F.col("nth") <= quota).select("id", "lang"), "languages")


def fit(docs, id_column="doc_id", text_column="text", lang_column="lang"):
    """Learn from a bounded sample of documents whose id is not held out and whose language is known.

    An id counts once, with the smallest of its languages and of its texts.
    """
    picked = _picked(docs, id_column, lang_column)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    got = one_text(rows, picked, "id").select("text", "lang").mapInArrow(_cut, "lang string, cut binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "cut"])
    names, labels = np.unique(got["lang"].to_numpy(str), return_inverse=True)
    windows = np.stack([np.frombuffer(c, np.uint8) for c in got["cut"]])
    return train(windows, labels, [str(x) for x in names])


_LETTER = np.zeros(256, np.float32)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = 1


def language(model, text_column):
    """struct<lang_pred string, score double> of every whole text."""
    @F.arrow_udf("lang_pred string, score double")
    def of(text: pa.Array, letters: pa.Array) -> pa.Array:
        names, scores = [], []
        has = letters.to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in column_passes(text, 1 << 20):
            windows, count = windows_of(data, offsets)
            each = softmax(pooled(model, windows) @ model.out + model.out_bias) if len(windows) else np.zeros((0, len(model.names)))
            weight = _LETTER[windows].sum(axis=1) + 1e-3
            owner = np.repeat(np.arange(hi - lo), count)
            total = np.maximum(np.bincount(owner, weights=weight, minlength=hi - lo), 1e-9)
            mean = np.stack([np.bincount(owner, weights=weight * each[:, k], minlength=hi - lo) / total for k in range(each.shape[1])], axis=1)
            best = mean.argmax(axis=1)
            for i in range(hi - lo):
                names.append(model.names[best[i]] if has[lo + i] else "und")
                scores.append(min(float(mean[i, best[i]]), 1.0) if has[lo + i] else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return of(text_column, F.coalesce(text_column.rlike(r"\p{L}"), F.lit(False)))
