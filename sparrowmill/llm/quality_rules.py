"""Quality rules whose cutoffs come with a guarantee.

Base counts are taken in one scan of each text. The score rule then rejects documents whose score,
the worst of several weighted ratios, lies above the cutoff of their stratum. Cutoffs are chosen on
labelled documents: one part proposes how tight a cutoff may get while nearly all it rejects is bad,
the other part (the holdout) certifies cutoffs from the loosest on, as long as the exact binomial
upper bound of the share of good documents rejected stays within the risk. Testing in that fixed
order needs no correction within a stratum; across strata the error is divided (Bonferroni), so that
with the stated confidence every stratum loses at most ``risk`` of its good documents to the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize, sliced
from sparrowmill.llm.words import SCAN_BYTES, Texts, Words, equal_ranges, find_words, mix, padded, range_hashes, window_hashes

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that counts as repeated.
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
#: Of the COUNTS, those that come before the verdict.
FIRST = 5
#: Shares in thousandths, weighted against one another; a higher one is worse.
RATIOS = {
    "symbols": (10, "1000 * n_symbols / greatest(word_chars, 1)"),
    "repeated_lines": (2, "1000 * n_dup_lines / greatest(n_lines, 1)"),
    "repeated_words": (3, "1000 * n_repeat_words / greatest(n_words, 1)"),
    "capitals": (4, "1000 * n_capitals / greatest(word_chars, 1)"),
    "shouts": (5, "1000 * n_shouts / greatest(n_words, 1)"),
}
#: No score lies above: a share of all, with the largest weight.
TOP = 1000 * max(w for w, _ in RATIOS.values())
#: Percent of the labelled documents that certify; the others propose.
HOLDOUT_PERCENT = 60


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags in each of the ranges between bounds."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][bounds])


def count_all(texts: Texts) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    data, n = texts.data, len(texts.offsets) - 1
    words = find_words(texts)
    out = {"n_words": np.diff(words.first)}
    cover = np.zeros(len(data) + 1, np.int8)
    cover[words.starts] += 1
    cover[words.ends] -= 1  # a word that starts here adds its own one
    solid = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = _sums(solid & ((data & 0xC0) != 0x80), texts.offsets)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS.encode())] = True
    out["n_symbols"] = _sums(is_symbol[data], texts.offsets)
    out["n_capitals"] = _sums((data >= 65) & (data <= 90), texts.offsets)
    out["n_shouts"] = _sums(data == ord("!"), texts.offsets)
    solid_bytes = padded(data)

    # Lines that hold a word, by text; a repeated one is any but the first of its kind.
    cuts = np.flatnonzero(data == 10)
    starts = np.union1d(cuts + 1, texts.offsets[:-1])
    starts = starts[starts < len(data)]
    ends = np.searchsorted(cuts, starts)
    ends = np.r_[cuts, len(data)][ends]
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    ends = np.minimum(ends, texts.offsets[owner + 1])
    full = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, owner = starts[full], ends[full], owner[full]
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = _equal_lines(solid_bytes, starts, ends, owner, n)
    out["n_repeat_words"] = _sums(_in_repeats(solid_bytes, words), words.first)
    return out


def _with_first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key stands at an earlier place too, and the first place with that key."""
    order = np.argsort(keys, kind="stable")
    head = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)]
    first = order[head][np.cumsum(head) - 1]
    return order[~head], first[~head]


def _equal_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many lines of each text equal an earlier one: found by hashes, settled by bytes."""
    later, first = _with_first(mix(range_hashes(data, starts, ends) + owner.astype(np.uint64)))
    same = (owner[later] == owner[first]) & (ends[later] - starts[later] == ends[first] - starts[first])
    same[same] = equal_ranges(data, starts[later[same]], data, starts[first[same]], (ends - starts)[later[same]])
    out = np.bincount(owner[later[same]], minlength=n)
    for t in np.unique(np.r_[owner[later[~same]], owner[first[~same]]]).tolist():  # hashes met by chance
        lines = [data[a:b].tobytes() for a, b in zip(starts[owner == t].tolist(), ends[owner == t].tolist(), strict=True)]
        out[t] = len(lines) - len(set(lines))
    return out


def _in_repeats(data: np.ndarray, words: Words) -> np.ndarray:
    """For each word whether it is in a window of WINDOW words that occurs twice or more in its text."""
    starts, sizes = words.starts, words.ends - words.starts
    ahead = np.zeros(len(starts) + 1, np.int64)
    if len(starts) < WINDOW:
        return ahead[:-1] > 0
    windows = window_hashes(range_hashes(data, starts, words.ends), WINDOW)
    at = np.arange(len(windows))
    owner = np.searchsorted(words.first, at, side="right") - 1
    inside = at + WINDOW <= words.first[owner + 1]
    at, owner = at[inside], owner[inside]
    later, first = _with_first(mix(windows[inside] + owner.astype(np.uint64)))
    same, later_at, first_at = owner[later] == owner[first], at[later], at[first]
    for j in range(WINDOW):
        same &= sizes[later_at + j] == sizes[first_at + j]
        same[same] = equal_ranges(data, starts[later_at[same] + j], data, starts[first_at[same] + j], sizes[later_at[same] + j])
    wrong = np.unique(np.r_[owner[later[~same]], owner[first[~same]]])
    found = [np.unique(np.r_[later_at[same], first_at[same]])]
    if len(wrong):  # hashes met by chance
        found = [found[0][~np.isin(np.searchsorted(words.first, found[0], side="right") - 1, wrong)]]
    for t in wrong.tolist():
        own = [data[a:b].tobytes() for a, b in zip(starts[words.first[t] : words.first[t + 1]].tolist(), words.ends[words.first[t] : words.first[t + 1]].tolist(), strict=True)]
        grams = [tuple(own[i : i + WINDOW]) for i in range(len(own) - WINDOW + 1)]
        times = Counter(grams)
        found.append(words.first[t] + np.array([i for i, g in enumerate(grams) if times[g] > 1], np.int64))
    for part in found:
        np.add.at(ahead, part, 1)
        np.add.at(ahead, part + WINDOW, -1)
    return np.cumsum(ahead)[:-1] > 0


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and the COUNTS as long; a null text counts as empty."""
    others = [c for c in docs.columns if c != text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SCAN_BYTES):
            found = count_all(Texts.of(batch.column(text)))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {c: pa.array(found[c].astype(np.int64)) for c in COUNTS})

    schema = docs.select(*others).withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema
    return docs.select(*others, text).mapInArrow(giving_back(scan), schema)


def binomial_tail(x: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(X <= x) of a binomial variable, from exact terms in logarithms."""
    k = np.arange(int(x.max()) + 1)
    log_n = math.lgamma(n + 1)
    terms = np.array([log_n - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in k.tolist()])
    return np.minimum(1, np.cumsum(np.exp(terms)))[x]


def certified_cutoff(train_good: np.ndarray, train_bad: np.ndarray, holdout_good: np.ndarray, risk: float, error: float, purity: float) -> int:
    """The tightest cutoff that the training part proposes and the holdout certifies.

    Arrays count documents by score 0 .. TOP; a cutoff rejects the scores above it, so TOP rejects
    nothing. A cutoff c is certified if P(Binomial(n, risk) <= good holdout documents rejected)
    <= error for it and all looser ones, which is that the Clopper-Pearson upper bound at
    1 - error lies within risk.
    """
    above = lambda h: np.cumsum(h[::-1])[::-1] - h
    n = int(holdout_good.sum())
    if n == 0:
        return TOP
    good, bad = above(train_good), above(train_bad)
    pure = np.flatnonzero((bad > 0) & (bad >= purity * (good + bad)))
    if not len(pure):
        return TOP
    held = above(holdout_good)
    passed = binomial_tail(held, n, risk) <= error
    cutoff = TOP
    while cutoff - 1 >= pure[0] and passed[cutoff - 1]:
        cutoff -= 1
    return cutoff


def score() -> F.Column:
    """The worst of the weighted RATIOS, 0 .. TOP, from the COUNTS."""
    return F.least(F.lit(TOP), F.greatest(*[F.floor(w * F.expr(e)) for w, e in RATIOS.values()])).cast("int")


def fit_cutoffs(scored: DataFrame, risk: float, error: float, purity: float) -> DataFrame:
    """(stratum, cutoff, n_holdout) from rows (stratum, score, label, holdout); labels 1 good, 0 bad.

    n_holdout is the number of good holdout documents. A group is the histogram of one stratum.
    """
    counts = scored.groupBy("stratum", "score", "holdout", "label").count()
    tests = max(1, scored.where("holdout and label = 1").select("stratum").distinct().count())

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        def hist(holdout: bool, label: int) -> np.ndarray:
            own = part[(part.holdout == holdout) & (part.label == label)]
            return np.bincount(own.score, own["count"], TOP + 1).astype(np.int64)

        held = hist(True, 1)
        cutoff = certified_cutoff(hist(False, 1), hist(False, 0), held, risk, error / tests, purity)
        return pd.DataFrame({"stratum": [key[0]], "cutoff": [cutoff], "n_holdout": [int(held.sum())]})

    return counts.groupBy("stratum").applyInPandas(fit, "stratum string, cutoff int, n_holdout long")


def labelled(scores: DataFrame, labels: DataFrame, holdout_percent: int = HOLDOUT_PERCENT) -> DataFrame:
    """``scores`` with doc_id joined to its label, and whether it belongs to the holdout, by a hash of doc_id."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    holdout = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("holdout")), F.lit(100)) < holdout_percent
    return scores.join(known, "doc_id").withColumn("holdout", holdout)


def judge_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.04, error: float = 0.05, purity: float = 0.9, min_words: int = 20, max_repeat_percent: int = 30, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the first COUNTS, base_failed, kept, the other COUNTS, and the columns named in ``carry``.

    ``labels`` has doc_id and quality (1 good, 0 bad; others are ignored, and of several labels of
    a document the lowest counts). A document is kept if it passes the base rules and its score
    does not lie above the cutoff certified for its stratum. A null stratum is the stratum ''.
    With four strata, a stratum needs 108 good holdout documents, none of them rejected, to certify
    anything; others get the base rules only. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).cast("string").alias("text"), *carry)
    counts = materialize(text_counts(rows), "quality-counts")
    scored = materialize(labelled(counts.select("doc_id", "stratum", score().alias("score")), labels), "quality-labelled")
    cutoffs = fit_cutoffs(scored, risk, error, purity).where(F.col("cutoff") < TOP)
    out = counts.join(cutoffs.select("stratum", "cutoff"), "stratum", "left")
    rejected = F.coalesce(score() > F.col("cutoff"), F.lit(False))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select("doc_id", *COUNTS[:FIRST], base.alias("base_failed"), (~base & ~rejected).alias("kept"), *COUNTS[FIRST:], *carry)


NAME, SQL = "op5_quality_rules", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
