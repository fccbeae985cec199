"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks. Features of a block are its ancestors' tags and names and properties of its text;
the field scores each block's label (main text or not) and each step from label to label. It is trained on labelled
pages by the gradient of the conditional likelihood (forward and backward sums), and pages are decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shoplens.llm.html_blocks import Block, leaf_blocks
from shoplens.llm.labelled_pages import labelled_pages

#: Elements that say what a part of a page is for.
#: What stands between blocks of the extracted text.
GAP = "\n\n"


def features(block: Block, place: float) -> list[str]:
    """place: from 0 (first block of the page) to 1 (last)."""
    words = block.text.split(" ")
    share = block.link_chars / len(block.text)
    out = ["always", f"parent={block.parent}"]
    out += [f"tag={t}" for t in block.inner_tags]
    out += [f"name={n}" for n in block.names]
    near = block.near
    out += [f"near={near}", f"near={near}/{bool(block.names)}"]
    out.append(f"links={0 if share == 0 else 1 if share < 0.5 else 2}")
    out.append(f"words={min(len(words).bit_length(), 6)}")
    out.append(f"end={block.text[-1] if block.text[-1] in '.!?:;,' else 'other'}")
    if block.text[0] in "©®":
        out.append("copyright")
    if not block.names and not near:
        out.append(f"bare={int(share > 0)}{min(len(words).bit_length(), 6)}")
    out.append(f"place={int(place * 4.999)}")
    return out


@dataclass
class ChainField:
    """weights: per feature the score of the labels other and main; steps[a, b]: of label b after label a."""

    weights: dict[str, tuple[float, float]]
    steps: np.ndarray

    def labels(self, blocks: Sequence[Block]) -> list[bool]:
        """The most likely labels of a page's blocks; of equal ones, 'other'."""
        (aa, ab), (ba, bb) = self.steps.tolist()
        other, main, back = 0.0, 0.0, []
        last = max(len(blocks) - 1, 1)
        for k, block in enumerate(blocks):
            x = y = 0.0
            for f in features(block, k / last):
                if (w := self.weights.get(f)) is not None:
                    x += w[0]
                    y += w[1]
            if k:
                to_other, to_main = (other + aa >= main + ba), (other + ab >= main + bb)
                other, main = max(other + aa, main + ba) + x, max(other + ab, main + bb) + y
                back.append((to_other, to_main))
            else:
                other, main = x, y
        if not blocks:
            return []
        label = main > other
        out = [label]
        for to_other, to_main in reversed(back):
            label = not (to_main if label else to_other)
            out.append(label)
        return out[::-1]


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def fit(pages: Sequence[tuple[list[Block], list[bool]]], steps: int = 200, rate: float = 0.1, decay: float = 2e-3,
        least: int = 3) -> ChainField:
    """Adam on the conditional log likelihood of all pages at once. Features of fewer than `least` blocks are left out."""
    listed = [[features(b, k / max(len(blocks) - 1, 1)) for k, b in enumerate(blocks)] for blocks, _ in pages]
    counts: dict[str, int] = {}
    for f in (f for page in listed for block in page for f in block):
        counts[f] = counts.get(f, 0) + 1
    number = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    count, most = len(pages), max(len(p) for p in listed)
    sizes = np.array([len(p) for p in listed])
    rows = [(i, t, number[f]) for i, page in enumerate(listed) for t, block in enumerate(page) for f in block if f in number]
    page_of, time_of, feature_of = np.array(rows).T
    cell = page_of * most + time_of
    truth = np.zeros((count, most), int)
    for i, (_, labels) in enumerate(pages):
        truth[i, :len(labels)] = labels
    real = np.arange(most) < sizes[:, None]
    hot = np.eye(2)[truth] * real[..., None]
    pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    params = {"w": np.zeros((len(number), 2)), "s": np.zeros((2, 2))}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step in range(1, steps + 1):
        w, s = params["w"], params["s"]
        emit = np.stack([np.bincount(cell, w[feature_of, k], minlength=count * most) for k in range(2)], -1).reshape(count, most, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(real[:, t, None], _log_sum(ahead[:, t - 1, :, None] + s, 1) + emit[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], _log_sum(s + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
        total = _log_sum(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        double = np.exp(ahead[:, :-1, :, None] + s + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
        gap = (single - hot).reshape(-1, 2)
        slopes = {"w": np.stack([np.bincount(feature_of, gap[cell, k], minlength=len(number)) for k in range(2)], -1) / count,
                  "s": ((double * real[:, 1:, None, None]).sum(axis=(0, 1)) - pairs) / count}
        for k, slope in slopes.items():
            slope = slope + decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope ** 2
            params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return ChainField({f: tuple(params["w"][k].tolist()) for f, k in number.items()}, params["s"])


def trained(pages: Sequence[tuple[str, list[tuple[str, bool]]]] | None = None, **settings) -> ChainField:
    """A field fitted on labelled pages (html, [(text of block, main), ...]); by default on the built-in layouts."""
    sequences = []
    for html, labels in pages or labelled_pages():
        blocks = leaf_blocks(html)
        if [b.text for b in blocks] != [" ".join(t.split()) for t, _ in labels]:
            raise ValueError("the labels do not fit the blocks of their page")
        sequences.append((blocks, [m for _, m in labels]))
    return fit(sequences, **settings)


def main_text(html: str | None, field: ChainField) -> str:
    blocks = leaf_blocks(html)
    return GAP.join(b.text for b, main in zip(blocks, field.labels(blocks)) if main)


def extracted(pages: DataFrame, html_col: str = "html", field: ChainField | None = None) -> DataFrame:
    """The pages with text and n_chars; columns of these names are replaced.

    Blocks keep the page's order; a page without main text, an empty or a null page has the empty text. Every row is
    extracted for itself; an empty table stays empty.
    """
    field = field or trained()

    @arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(html, field) for html in batch.to_pylist()], pa.string())
    plain = pages.drop("text", "n_chars")
    return plain.withColumn("text", extract(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))


def labelled_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", field: ChainField | None = None) -> DataFrame:
    """One row per leaf block: id_col, nth (from 0), text, tags (path of open elements), main."""
    field = field or trained()

    @arrow_udf("array<struct<text:string,tags:string,main:boolean>>")
    def blocks_of(htmls: pa.Array) -> pa.Array:
        out = []
        for html in htmls.to_pylist():
            blocks = leaf_blocks(html)
            out.append([{"text": b.text, "tags": "/".join(b.tags), "main": m} for b, m in zip(blocks, field.labels(blocks))])
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("tags", pa.string()), ("main", pa.bool_())])))
    found = pages.select(F.col(id_col), blocks_of(F.col(html_col)).alias("blocks"))
    return found.select(id_col, F.posexplode("blocks").alias("nth", "block")).select(id_col, "nth", "block.*")
