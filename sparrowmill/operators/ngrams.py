"""Clipped matches of character n-grams, counted by sorting integers.

An n-gram is a pair of ranks: of its beginning, an n-gram one shorter, and of its last character. So
n-grams of any length are 64-bit integers, many texts are counted in one sort, and memory follows the
characters of a few texts whatever n is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of texts that are counted together; a longer text is counted alone.
CHARACTERS = 1 << 18


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the text that each belongs to, and the sizes of the texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    return points, np.repeat(np.arange(len(texts)), sizes), sizes


def precisions(predictions: list[str], references: list[str], most: int) -> np.ndarray:
    """[text, n - 1]: the share of a prediction's n-grams found in the reference, each as often as it is
    there. A text shorter than n is one n-gram; without any the share is 0."""
    rows = len(predictions)
    points, owner, sizes = _letters([*predictions, *references])
    letter = np.unique(points, return_inverse=True)[1].astype(np.int64)
    kinds = int(letter.max()) + 1 if len(letter) else 1
    ends = np.cumsum(sizes)[owner] if len(owner) else owner
    at, gram, out = np.arange(len(points)), letter, np.zeros((rows, most))
    short_equal = np.array([p == r for p, r in zip(predictions, references, strict=True)])
    for n in range(1, most + 1):
        if n > 1:
            whole = at + n <= ends[at]
            at = at[whole]
            gram = np.unique(gram[whole] * kinds + letter[at + n - 1], return_inverse=True)[1].astype(np.int64)
        pair, side = owner[at] % max(rows, 1), owner[at] >= rows
        grams = int(gram.max()) + 1 if len(gram) else 1
        keys, which = np.unique(pair * grams + gram, return_inverse=True)
        theirs = np.bincount(which[side], minlength=len(keys))
        ours = np.bincount(which[~side], minlength=len(keys))
        matched = np.bincount(keys // grams, np.minimum(ours, theirs), minlength=rows)
        total = np.maximum(sizes[:rows] - n + 1, 0)
        out[:, n - 1] = np.divide(matched, total, out=np.zeros(rows), where=total > 0)
        short = (sizes[:rows] > 0) & (sizes[:rows] < n)
        out[short, n - 1] = short_equal[short]
    return out


def bleu(predictions: list[str], references: list[str], most: int) -> np.ndarray:
    """[text, :]: the precisions, then their geometric mean (each at least 1e-10) times the brevity penalty."""
    each = precisions(predictions, references, most)
    ours, theirs = (np.array([len(t) for t in x], float) for x in (predictions, references))
    brevity = np.minimum(1.0, np.exp(1 - theirs / np.maximum(ours, 1)))
    whole = brevity * np.exp(np.log(np.maximum(each, 1e-10)).mean(axis=1))
    return np.concatenate([each, whole[:, None]], axis=1)


def _pieces(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHARACTERS:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def char_bleu_scores(prediction: Column, reference: Column, most: int = 4) -> Column:
    """A struct bleu1 .. bleu<most>, bleu of two trimmed texts; null where the prediction is."""
    names = [*(f"bleu{n}" for n in range(1, most + 1)), "bleu"]

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def score(p: pa.Array, r: pa.Array) -> pa.Array:
        ours, theirs = (x.fill_null("").to_pylist() for x in (p, r))
        parts = [bleu(ours[s], theirs[s], most) for s in _pieces([len(a) + len(b) for a, b in zip(ours, theirs, strict=True)])]
        found = np.concatenate([np.zeros((0, most + 1)), *parts])
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(most + 1)], names, mask=pc.is_null(p))

    return score(prediction, reference)
