"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks.  Each is described by its ancestors' tags and
names, by its own text and by what stands beside it; the field scores labels of blocks and of
neighbours, is trained on labelled pages by stochastic gradient steps on the log-likelihood
(forward-backward), and labels a page by Viterbi.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.html_pages import Above, Block, Pages, blocks
from gleaner.llm.memory import returning
from gleaner.session import small_batches

BITS = 16
TRAIN_PAGES = 2500  # labelled pages made for training; a bound that no input changes
OFTEN = 8  # a feature of fewer training pages is left out
NEAR = 3  # names this many levels up count apart from all above


@lru_cache(1 << 17)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def path_features(path: tuple) -> list[str]:
    tags = [tag for tag, _ in path[-2:]]
    out = ["all", "<".join(["pair", *tags])]
    for depth, (tag, names) in enumerate(reversed(path)):
        out.append(f"in {tag}")
        out += [f"name {n}" for n in names]
        if depth < NEAR:
            out.append(f"{depth} {tag}")
            out += [f"near {n}" for n in names]
    return sorted(set(out))


def above_features(entry: tuple) -> list[str]:
    """What an ancestor adds that is too far up for the path."""
    tag, names = entry
    return [f"in {tag}", *(f"name {n}" for n in names)]


def text_features(block: Block, place: float) -> list[str]:
    text = block.text
    words = text.split()
    linked = min(3, 4 * block.linked // max(len(text), 1))
    out = [f"words {min(len(words), 64).bit_length()}", f"chars {min(len(text), 2048).bit_length()}",
           f"linked {linked}", f"linked {linked} words {min(len(words), 16).bit_length()}", f"place {int(4 * place)}",
           f"end {text[-1] if not text[-1].isalnum() else 'a'}", f"first {'A' if text[0].isupper() else '1' if text[0].isdigit() else 'a'}"]
    if "©" in text:
        out.append("copyright")
    if len(words) <= 12:
        out += [f"says {w.strip('.,:;!?()').lower()}" for w in words]
    return out


def beside(found: list[Block], i: int, alike: Counter) -> list[str]:
    place = found[i].place
    return [f"alike {min(alike[place], 3)}", f"before same {i > 0 and found[i - 1].place == place}", f"after same {i + 1 < len(found) and found[i + 1].place == place}"]


class Field:
    """Weights of features and of neighbouring labels; label 1 is content."""

    def __init__(self):
        self.weights = np.zeros((1 << BITS, 2))
        self.steps = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # first and last block
        self.known: dict[tuple, np.ndarray] = {}

    @staticmethod
    def features(found: list[Block], drop: np.random.Generator) -> list[np.ndarray]:
        """For training: now and then without a block's own text or its ancestors' names, so that neither is all that counts."""
        out, alike = [], Counter(b.place for b in found)
        for i, b in enumerate(found):
            path = tuple((tag, () if drop.random() < 0.15 else names) for tag, names in b.path)
            names, above = path_features(path), b.above
            while above:
                names += above_features(above.entry)
                above = above.parent
            if drop.random() < 0.8:
                names += text_features(b, i / len(found))
            names += beside(found, i, alike)
            out.append(np.unique([_bucket(n) for n in names]))
        return out

    def scores(self, found: list[Block]) -> np.ndarray:
        """Label scores of each block, as features() and the weights give them; paths are remembered."""
        out, alike = np.zeros((len(found), 2)), Counter(b.place for b in found)
        for i, b in enumerate(found):
            names = text_features(b, i / len(found)) + beside(found, i, alike)
            part = self.known.get(b.path)
            if part is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                part = self.known[b.path] = np.unique([_bucket(n) for n in path_features(b.path)])
            if b.above:
                part = np.union1d(part, self.far(b.above))
            out[i] = self.weights[np.union1d(part, [_bucket(n) for n in names])].sum(0)
        return out

    def far(self, above: Above) -> np.ndarray:
        """Features with a weight that the ancestors of a chain have; those that add none share one array."""
        todo, node = [], above
        while node and node.buckets is None:
            todo.append(node)
            node = node.parent
        have = node.buckets if node else np.zeros(0, np.int64)
        for node in reversed(todo):
            own = np.unique([k for k in map(_bucket, above_features(node.entry)) if self.weights[k].any()]).astype(np.int64)
            node.buckets = have = have if np.isin(own, have).all() else np.union1d(have, own)
        return have

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and of neighbouring labels, by forward and backward sums."""
        n = len(scores)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0], back[-1] = scores[0] + self.ends[0], self.ends[1]
        for i in range(1, n):
            ahead[i] = scores[i] + np.logaddexp(ahead[i - 1, 0] + self.steps[0], ahead[i - 1, 1] + self.steps[1])
        for i in range(n - 2, -1, -1):
            after = scores[i + 1] + back[i + 1]
            back[i] = np.logaddexp(self.steps[:, 0] + after[0], self.steps[:, 1] + after[1])
        total = np.logaddexp(*(ahead[-1] + back[-1]))
        pairs = ahead[:-1, :, None] + self.steps + (scores[1:] + back[1:])[:, None, :] - total
        return np.exp(ahead + back - total), np.exp(pairs)

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.2, decay: float = 1e-5) -> None:
        order = np.random.default_rng(3)
        seen = [(self.features(b, order), np.array(y)) for b, y in pages if b]
        often = np.bincount(np.concatenate([np.unique(np.concatenate(f)) for f, _ in seen]), minlength=1 << BITS) >= OFTEN
        seen = [([at[often[at]] for at in f], y) for f, y in seen]
        for epoch in range(epochs):
            now = rate / (1 + 0.5 * epoch)
            for k in order.permutation(len(seen)):
                found, y = seen[k]
                at, sizes = np.concatenate(found), [len(f) for f in found]
                scores = np.add.reduceat(self.weights[at], np.r_[0, np.cumsum(sizes)[:-1]])
                one, two = self.marginals(scores)
                truth = np.eye(2)[y]
                np.add.at(self.weights, at, now * np.repeat(truth - one, sizes, axis=0))
                self.weights[at] *= 1 - decay
                self.steps += now * (np.einsum("ia,ib->ab", truth[:-1], truth[1:]) - two.sum(0))
                self.ends += now * (truth[[0, -1]] - one[[0, -1]])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels."""
        n = len(scores)
        best = scores[0] + self.ends[0]
        came = np.zeros((n, 2), int)
        for i in range(1, n):
            ways = best[:, None] + self.steps
            came[i] = ways.argmax(0)
            best = ways.max(0) + scores[i]
        label = int((best + self.ends[1]).argmax())
        out = [label]
        for i in range(n - 1, 0, -1):
            label = int(came[i, label])
            out.append(label)
        return out[::-1]

    def text(self, html: str) -> str:
        """Content blocks in page order, a blank line between them."""
        found = blocks(html)
        if not found:
            return ""
        return "\n\n".join(b.text for b, y in zip(found, self.viterbi(self.scores(found)), strict=True) if y)


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, seed: int = 1) -> Field:
    field = Field()
    field.train(list(Pages(seed).labelled(pages)))
    return field


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        at, values, field.steps, field.ends = model.value
        field.weights[at] = values
        for batch in batches:
            texts = [field.text(html or "") for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    text is what the whole html says as an article: no menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles or reader comments; references decoded, white
    space inside a block made one blank, blocks joined by a blank line.  A null or empty html,
    and a page without content blocks, has an empty text.  Repeated rows and null ids or urls
    pass like others.  Needs the columns page_id, url and html.
    """
    small_batches(pages.sparkSession)
    field = field or trained()
    at = np.flatnonzero(field.weights.any(1))
    model = pages.sparkSession.sparkContext.broadcast((at, field.weights[at], field.steps, field.ends))
    return pages.select("page_id", "url", "html").mapInArrow(returning(_extract(model)), "page_id long, url string, text string, n_chars long")
