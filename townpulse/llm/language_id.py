"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``width``. Two layers read each window from both ends; at
every byte their states give probabilities of the languages. A document's probabilities are the mean
over all its bytes that are letters (ASCII letters and all bytes of other characters).

The network is trained on the driver, in numpy, by backpropagation through time, on a bounded sample:
of each language the ``docs_per_lang`` labelled documents with the smallest hashes, and of each of
these ``windows_per_doc`` windows spread over the whole text. Prediction sees nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows without a label, or
with a null id, are not learned from. Equal rows get equal results. Without any labelled row every text
is ``und``. An empty table gives no rows. Other columns than id, text and label are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townpulse.llm.common import give_back
from townpulse.llm.recurrent import Adam, blank_input, layer_gradients, parts, run_layer
from townpulse.llm.words import buffers, row_slices

UNKNOWN = "und"
BLANK = 256
LETTER = np.zeros(257, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
# Bytes of text that a task looks at together.
SLICE_BYTES = 1 << 18


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def training_windows(
    docs: DataFrame, key: str, text: str, lang: str, width: int, docs_per_lang: int, windows_per_doc: int
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows (bytes, blanks after a short text) and the windows' languages."""
    rank = F.xxhash64(key, text)
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & has_letter(F.col(text)))
    first = Window.partitionBy(lang).orderBy("rank")
    limits = (
        known.select(lang, rank.alias("rank"))
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= docs_per_lang)
        .groupBy(lang)
        .agg(F.max("rank").alias("limit"))
        .collect()
    )
    if not limits:
        return [], np.zeros((0, width), np.int16), np.zeros(0, np.int64)
    chosen = F.lit(False)
    for row in limits:
        chosen |= (F.col(lang) == row[lang]) & (rank <= row.limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = body.encode()
                spread = np.random.default_rng(zlib.crc32(data))
                last = max(0, len(data) - width)
                for at in {int(spread.integers(0, last + 1)) for _ in range(windows_per_doc)}:
                    langs.append(name)
                    windows.append(data[at : at + width])
            yield pa.record_batch(
                [pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"]
            )

    rows = known.where(chosen).select(lang, text).mapInArrow(cut, "lang string, window binary").collect()
    rows = sorted((r.lang, bytes(r.window)) for r in rows)
    names = sorted({name for name, _ in rows})
    data = np.full((len(rows), width), BLANK, np.intp)
    for i, (_, window) in enumerate(rows):
        # Every third window is shortened, so that short texts are learned too.
        size = len(window) if i % 3 else min(len(window), 4 + zlib.crc32(window) % (width // 2))
        data[i, :size] = np.frombuffer(window[:size], np.uint8)
    return names, data, np.array([names.index(name) for name, _ in rows])


def both_ways(model: dict, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of both layers; ``windows`` is (rows, steps) of byte values."""
    columns = np.ascontiguousarray(windows.T)
    steps, rows = columns.shape
    found = []
    for d in ("ahead", "back"):
        tables = parts(model[f"in_{d}"])
        found.append(
            run_layer(
                steps,
                rows,
                lambda t, tables=tables: [table.take(columns[t], axis=0) for table in tables],
                model[f"weights_{d}"],
                d == "back",
            )
        )
    return tuple(found)


def probabilities(model: dict, windows: np.ndarray) -> np.ndarray:
    """(steps, rows, languages)"""
    ahead, back = both_ways(model, windows)
    hidden = ahead.shape[2]
    out = ahead.reshape(-1, hidden) @ model["out"][:hidden]
    out += back.reshape(-1, hidden) @ model["out"][hidden:]
    out += model["bias"]
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out.reshape(*ahead.shape[:2], -1)


def train(
    windows: np.ndarray,
    labels: np.ndarray,
    classes: int,
    *,
    hidden: int = 8,
    epochs: int = 6,
    batch: int = 128,
    rate: float = 0.02,
    seed: int = 7,
) -> dict[str, np.ndarray]:
    """The network's arrays after training on windows and their languages."""
    rng = np.random.default_rng(seed)
    model = {}
    for d in ("ahead", "back"):
        model[f"in_{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        model[f"in_{d}"][BLANK] = blank_input(hidden)
        model[f"weights_{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
    model["out"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
    model["bias"] = np.zeros(classes, np.float32)
    adam = Adam(model, rate)
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            adam.step(gradients(model, windows[part], labels[part]), rate * 0.6**epoch)
    return model


def gradients(model: dict, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over all places with content."""
    columns = np.ascontiguousarray(windows.T)
    states = dict(zip(("ahead", "back"), both_ways(model, windows), strict=True))
    hidden = model["weights_ahead"].shape[0]
    both = np.concatenate([states["ahead"], states["back"]], axis=2)
    scores = both @ model["out"] + model["bias"]
    scores -= scores.max(axis=2, keepdims=True)
    d = np.exp(scores)
    d /= d.sum(axis=2, keepdims=True)
    d[:, np.arange(len(labels)), labels] -= 1
    real = columns != BLANK
    d *= real[:, :, None] / np.float32(max(1, real.sum()))
    grads = {
        "out": both.reshape(-1, 2 * hidden).T @ d.reshape(-1, d.shape[2]),
        "bias": d.sum(axis=(0, 1)),
    }
    d_both = d @ model["out"].T
    for i, name in enumerate(("ahead", "back")):
        table = model[f"in_{name}"]
        d_in, grads[f"weights_{name}"] = layer_gradients(
            table[columns],
            states[name],
            d_both[:, :, i * hidden : (i + 1) * hidden],
            model[f"weights_{name}"],
            name == "back",
        )
        total = np.zeros_like(table)
        np.add.at(total, columns.ravel(), d_in.reshape(-1, 3 * hidden))
        total[BLANK] = 0
        grads[f"in_{name}"] = total
    return grads


def document_means(model: dict, texts: pa.Array, width: int) -> np.ndarray:
    """Mean probabilities over the letters of each text (zeros where there are none)."""
    data, offsets = buffers(texts)
    sizes = np.diff(offsets)
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(counts))[:-1], counts)
    starts = offsets[:-1][owner] + nth * width
    total = np.zeros((len(sizes), len(model["bias"])))
    letters = np.zeros(len(sizes))
    most = max(1, SLICE_BYTES // width)
    for at in range(0, len(owner), most):
        place = starts[at : at + most, None] + np.arange(width)
        inside = place < offsets[1:][owner[at : at + most], None]
        windows = np.where(inside, data[np.minimum(place, len(data) - 1)], BLANK).astype(np.intp)
        found = probabilities(model, windows)
        use = LETTER[windows.T]
        np.add.at(total, owner[at : at + most], (found * use[:, :, None]).sum(axis=0))
        np.add.at(letters, owner[at : at + most], use.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


def identify(
    docs: DataFrame,
    learn: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    width: int = 64,
    docs_per_lang: int = 250,
    windows_per_doc: int = 4,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns to ``carry``, lang_pred and score of every row.

    Labels of rows that satisfy ``learn`` are learned.
    """
    names, windows, labels = training_windows(
        docs.where(learn), key, text, lang, width, docs_per_lang, windows_per_doc
    )
    model = train(windows, labels, len(names)) if names else {"bias": np.zeros(0, np.float32)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    carried = [key, *[c for c in carry if c not in (key, "lang_pred", "score")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 0, SLICE_BYTES):
                lettered = part.column(1).to_numpy(zero_copy_only=False)
                if names:
                    means = document_means(shared.value, part.column(0), width)
                    best = means.argmax(axis=1)
                    score = np.where(lettered, means[np.arange(len(best)), best], 0.0)
                    found = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                else:
                    found, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.record_batch(
                    [
                        *part.columns[2:],
                        pa.array(found, pa.string()),
                        pa.array(np.clip(score, 0, 1), pa.float64()),
                    ],
                    names=[*carried, "lang_pred", "score"],
                )
        give_back()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    body = F.col(text).alias("_body")
    return docs.select(body, has_letter(F.col(text)).alias("_lettered"), *carried).mapInArrow(
        run, f"{schema}, lang_pred string, score double"
    )
