"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into its leaf blocks (``html_blocks``). Each block is a vector: the sum over the hashed
names of the elements above it (tags and the words of class, id and role), the mean over its hashed
words, and a few figures such as its length and share of links. Two layers of long short-term memory
read the page's whole sequence of blocks from both ends, and their states at a block give the
probability that it belongs to the article. Blocks of at least one half are joined in page order.

The network is trained on the driver, in numpy, by backpropagation through time, on a bounded sample:
the ``sample_pages`` different pages with the smallest hashes among those of at most ``SAMPLE_CHARS``
characters. The sample is read twice: as it is, if its markup names the article (``article`` or
``main``) and the surroundings, and as texts for ``layouts`` random pages that place the same texts in
other markup, where the labels are known. Prediction sees the html alone.

Defined cases: a null or empty page, and one without text, give an empty text. Every block of a page is
read, whatever their number; pages of many blocks are run alone. Equal pages get equal texts. Null and
repeated keys are rows like any other. An empty table gives no rows. Other columns than the html, the
key and those to carry are not read; a carried column with the name of a result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.html_blocks import PATH_FEATURES, Block, blocks_of
from townpulse.llm.lstm import lstm_gradients, run_lstm
from townpulse.llm.page_layouts import Layouts
from townpulse.llm.recurrent import Adam
from townpulse.llm.words import row_slices, split_words

WORD_FEATURES = 1024
# Pages with more characters are not learned from.
SAMPLE_CHARS = 1 << 16
# Characters of html that a task looks at together, and blocks that the network reads at once.
SLICE_BYTES = 1 << 20
BLOCKS_AT_ONCE = 1 << 14
SURROUNDINGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))


class Encoded:
    """Features of the blocks of consecutive pages; ``first`` are the pages' first blocks."""

    def __init__(self, pages: list[list[Block]]):
        blocks = [b for page in pages for b in page]
        self.first = np.append(0, np.cumsum([len(page) for page in pages])).astype(np.int64)
        self.path = np.array([f for b in blocks for f in b.features], np.int64)
        self.path_first = np.append(0, np.cumsum([len(b.features) for b in blocks]))[:-1].astype(np.int64)
        words = split_words(pa.array([b.text for b in blocks], pa.string()))
        self.word = (words.hashes % np.uint64(WORD_FEATURES)).astype(np.int64)
        self.word_first = words.first[:-1]
        counts = np.diff(words.first).astype(np.float32)
        marks = np.array([sum(b.text.count(c) for c in ".,;!?") for b in blocks], np.float32)
        links = np.array([b.link_share for b in blocks], np.float32)
        self.figures = np.stack(
            [np.log1p(counts) / 5, links, np.minimum(1, marks / np.maximum(counts, 1)), np.ones(len(blocks), np.float32)],
            axis=1,
        ).astype(np.float32)

    def vectors(self, model: dict) -> np.ndarray:
        out = self.figures @ model["figures"]
        if len(out):
            out += np.add.reduceat(model["path"][self.path], self.path_first)
            means = np.add.reduceat(model["words"][self.word], self.word_first)
            out += means / np.diff(np.append(self.word_first, len(self.word)))[:, None].astype(np.float32)
        return out


def side_by_side(first: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each step and page (steps, pages), and whether the page has that step."""
    sizes = first[pages + 1] - first[pages]
    step = np.arange(int(sizes.max(initial=0)))[:, None]
    real = step < sizes
    return np.where(real, first[pages] + step, 0), real


def both_ways(model: dict, vectors: np.ndarray, real: np.ndarray) -> dict[str, tuple]:
    """Inputs, states and cells of both layers."""
    out = {}
    for d in ("ahead", "back"):
        inputs = vectors @ model[f"in_{d}"] + model[f"bias_{d}"]
        out[d] = (inputs, *run_lstm(inputs, model[f"weights_{d}"], real, d == "back"))
    return out


def scores_of(model: dict, layers: dict) -> np.ndarray:
    both = np.concatenate([layers["ahead"][1], layers["back"][1]], axis=2)
    return 1 / (1 + np.exp(-(both @ model["out"] + model["bias"])))


def probabilities(model: dict, pages: Encoded) -> np.ndarray:
    """For each block, that it belongs to the article."""
    vectors = pages.vectors(model)
    out = np.zeros(len(vectors), np.float32)
    sizes = np.diff(pages.first)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        # pages of about the same size, short ones together
        upto = at + 1
        while upto < len(order) and sizes[order[upto]] * (upto + 1 - at) <= BLOCKS_AT_ONCE:
            upto += 1
        place, real = side_by_side(pages.first, order[at:upto])
        found = scores_of(model, both_ways(model, vectors[place], real))
        out[place[real]] = found[real]
        at = upto
    return out


def gradients(model: dict, pages: Encoded, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over all blocks of the pages."""
    vectors = pages.vectors(model)
    place, real = side_by_side(pages.first, np.arange(len(pages.first) - 1))
    read = vectors[place]
    layers = both_ways(model, read, real)
    d = (scores_of(model, layers) - labels[place]) * real / np.float32(max(1, real.sum()))
    d = d.astype(np.float32)
    both = np.concatenate([layers["ahead"][1], layers["back"][1]], axis=2)
    grads = {"out": np.einsum("tbh,tb->h", both, d), "bias": d.sum()}
    d_read = np.zeros_like(read)
    hidden = len(model["out"]) // 2
    for n, name in enumerate(("ahead", "back")):
        inputs, states, cells = layers[name]
        d_states = d[:, :, None] * model["out"][n * hidden : (n + 1) * hidden]
        d_in, grads[f"weights_{name}"] = lstm_gradients(
            inputs, model[f"weights_{name}"], real, name == "back", states, cells, d_states
        )
        grads[f"bias_{name}"] = d_in.sum(axis=(0, 1))
        grads[f"in_{name}"] = read.reshape(-1, read.shape[2]).T @ d_in.reshape(-1, 4 * hidden)
        d_read += d_in @ model[f"in_{name}"].T
    d_vectors = np.zeros_like(vectors)
    d_vectors[place[real]] = d_read[real]
    grads["figures"] = pages.figures.T @ d_vectors
    for name, items, first in (("path", pages.path, pages.path_first), ("words", pages.word, pages.word_first)):
        counts = np.diff(np.append(first, len(items)))
        share = d_vectors if name == "path" else d_vectors / counts[:, None].astype(np.float32)
        grads[name] = np.zeros_like(model[name])
        np.add.at(grads[name], items, np.repeat(share, counts, axis=0))
    return grads


def new_model(size: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    model = {
        "path": rng.normal(0, 0.1, (PATH_FEATURES, size)),
        "words": rng.normal(0, 0.1, (WORD_FEATURES, size)),
        "figures": rng.normal(0, 0.3, (4, size)),
        "out": rng.normal(0, 0.3, 2 * hidden),
        "bias": np.zeros(()),
    }
    for d in ("ahead", "back"):
        model[f"in_{d}"] = rng.normal(0, 0.3, (size, 4 * hidden))
        model[f"weights_{d}"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
        model[f"bias_{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
    return {k: np.asarray(v, np.float32) for k, v in model.items()}


def train(
    pages: list[list[Block]],
    labels: list[list[int]],
    *,
    size: int = 16,
    hidden: int = 16,
    epochs: int = 4,
    batch: int = 32,
    rate: float = 0.01,
    seed: int = 11,
) -> dict[str, np.ndarray]:
    """The network's arrays after training on pages and their blocks' labels."""
    rng = np.random.default_rng(seed)
    model = new_model(size, hidden, rng)
    adam = Adam(model, rate)
    by_size = np.array(sorted(range(len(pages)), key=lambda i: len(pages[i])))
    batches = []
    for at in range(0, len(by_size), batch):
        part = by_size[at : at + batch].tolist()
        wanted = np.array([x for i in part for x in labels[i]], np.float32)
        if len(wanted):
            batches.append((Encoded([pages[i] for i in part]), wanted))
    for epoch in range(epochs):
        for n in rng.permutation(len(batches)).tolist():
            adam.step(gradients(model, *batches[n]), rate * 0.5**epoch)
    return model


def sample(pages: DataFrame, html: str, most: int) -> list[str]:
    """``most`` different pages, those with the smallest hashes."""
    known = pages.select(F.col(html).alias("html")).where(
        F.col("html").isNotNull() & (F.char_length("html").between(1, SAMPLE_CHARS))
    )
    hashed = known.withColumn("rank", F.xxhash64("html"))
    ranks = hashed.select("rank").distinct().orderBy("rank").limit(most)
    last = ranks.agg(F.max("rank").alias("last")).first().last
    if last is None:
        return []
    rows = hashed.where(F.col("rank") <= last).groupBy("rank").agg(F.first("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: r.rank)]


def marked(block: Block) -> int:
    """What the markup itself says: the article, or what surrounds it."""
    inside = {"article", "main"} & set(block.tags) and not SURROUNDINGS & set(block.tags)
    return int(bool(inside))


def learned(sampled: list[str], layouts: int, seed: int) -> dict[str, np.ndarray]:
    pages = [p for p in map(blocks_of, sampled) if p]
    whole = [p for p in pages if any(map(marked, p))]
    texts = {1: [], 0: []}
    for page in whole:
        for block in page:
            texts[marked(block)].append(block.text)
    if not whole:
        texts[1] = [b.text for page in pages for b in page]
    made = Layouts(texts[1], texts[0], seed)
    drawn = [made.page() for _ in range(layouts)]
    drawn += [(page, [marked(b) for b in page]) for page in whole]
    return train([blocks for blocks, _ in drawn], [wanted for _, wanted in drawn])


def extract(
    pages: DataFrame,
    *,
    key: str = "page_id",
    html: str = "html",
    carry: tuple[str, ...] = (),
    sample_pages: int = 300,
    layouts: int = 2500,
    seed: int = 5,
) -> DataFrame:
    """``key``, the columns to ``carry``, text, n_blocks and n_kept (blocks) of every page."""
    model = learned(sample(pages, html, sample_pages), layouts, seed)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    carried = [key, *[c for c in carry if c not in (key, "text", "n_blocks", "n_kept")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 0, SLICE_BYTES):
                found = [blocks_of(p) for p in part.column(0).to_pylist()]
                encoded = Encoded(found)
                keep = (probabilities(shared.value, encoded) >= 0.5).tolist()
                first = encoded.first.tolist()
                kept = [
                    [b.text for b, k in zip(page, keep[at : at + len(page)], strict=True) if k]
                    for page, at in zip(found, first[:-1], strict=True)
                ]
                yield pa.record_batch(
                    [
                        *part.columns[1:],
                        pa.array([" ".join(k) for k in kept], pa.string()),
                        pa.array([len(page) for page in found], pa.int64()),
                        pa.array([len(k) for k in kept], pa.int64()),
                    ],
                    names=[*carried, "text", "n_blocks", "n_kept"],
                )

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried)
    return pages.select(F.col(html).alias("_html"), *carried).mapInArrow(
        run, f"{schema}, text string, n_blocks bigint, n_kept bigint"
    )
