"""Quality rules by line labelling: a linear-chain conditional random field
marks each line as content or boilerplate, decoded by Viterbi; the share of
content decides. A few fixed rules on counts come first.

The field is fitted on a bounded sample of labelled documents. Lines of a
document of low quality count as boilerplate, unless the same line stands in
the sample's good documents too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .carry import with_text_columns
from .kernels import IS_WORD, Prints, Words, chunks, covered, lists, mixed, row_of, stretch_prints
from .session import table

#: Labelled documents that the field is fitted on, at most, and lines of one of them.
SAMPLE = 1000
SAMPLE_LINES = 64
CONTENT_SHARE = 0.5
MIN_WORDS = 50
ROUNDS = 80

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[0x41:0x5B] = True
IS_LOWER = np.zeros(256, bool)
IS_LOWER[0x61:0x7B] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[0x30:0x3A] = True
IS_LOUD = np.zeros(256, bool)
IS_LOUD[list(b"!?=_~^\\{}[]@")] = True
FEATURES = 8


def _before(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


class Lines:
    """The lines of a chunk, with the counts that rules and features need."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        n_rows = len(offsets) - 1
        breaks = np.flatnonzero(values == 0x0A)
        row = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, "right") - 1])
        start, stop = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
        self.row = np.sort(row)
        self.start, self.stop = start[np.lexsort((start, row))], stop[np.lexsort((stop, row))]
        self.bounds = np.searchsorted(self.row, np.arange(n_rows + 1))

        words = Words(values, offsets)
        self.n_words = np.diff(words.bounds)
        word_prints = words.prints()
        word_row = row_of(words.bounds)
        in_word = IS_WORD[values]
        chars = _before(in_word & ((values & 0xC0) != 0x80))
        symbols = _before(IS_SYMBOL[values])
        self.word_chars, self.n_symbols = np.diff(chars[offsets]), np.diff(symbols[offsets])

        # Words in windows of three that stand in the text twice or more.
        n = len(word_prints)
        repeated = np.zeros(n, bool)
        if n >= 3:
            at = np.flatnonzero(word_row[2:] == word_row[:-2])
            key = mixed(Prints(word_prints).grams(3)[at] ^ (word_row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            repeated = covered(n, at[twice], at[twice] + 3)
        repeats = _before(repeated)
        self.n_repeat_words = np.diff(repeats[words.bounds])

        # Lines with a word that equal an earlier line of their row.
        first, last = np.searchsorted(words.starts, self.start), np.searchsorted(words.starts, self.stop)
        has_word = last > first
        self.line_print = stretch_prints(values, self.start, self.stop)
        line_print = mixed(self.line_print ^ (self.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(line_print, kind="stable")
        again = np.zeros(len(self.row), bool)
        again[order[1:][line_print[order][1:] == line_print[order][:-1]]] = True
        again &= has_word
        self.n_dup_lines = np.bincount(self.row[again], minlength=n_rows)

        def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
            before = _before(mask)
            return (before[self.stop] - before[self.start]) / np.maximum(of, 1)

        self.weight = chars[self.stop] - chars[self.start]
        letters = _before(IS_LOWER[values] | IS_UPPER[values] | (values >= 0xC0))
        n_letters = letters[self.stop] - letters[self.start]
        self.features = np.stack(
            [
                np.ones(len(self.row)),
                np.minimum(8 * share(IS_SYMBOL[values], self.weight), 1),
                share(IS_UPPER[values], n_letters),
                share(IS_DIGIT[values], self.weight),
                np.minimum(4 * share(IS_LOUD[values], self.weight), 1),
                again.astype(float),
                (repeats[last] - repeats[first]) / np.maximum(last - first, 1),
                (last - first < 3).astype(float),
            ],
            axis=1,
        )


@dataclass(frozen=True)
class Field:
    """weights: of a line's features for boilerplate against content. steps: [from, to]. begins: of the first label."""

    weights: np.ndarray
    steps: np.ndarray
    begins: np.ndarray

    def decode(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi over the lines of each row, all rows together; True for content."""
        n = np.diff(bounds)
        score = np.stack([np.zeros(len(features)), features @ self.weights], axis=1)
        order = np.argsort(-n, kind="stable")
        best = np.zeros((len(n), 2))
        back = np.zeros((len(features), 2), np.int8)
        longest = int(n.max()) if len(n) else 0
        live = np.searchsorted(-n[order], -np.arange(longest), "left")
        for t in range(longest):
            rows = order[: live[t]]
            at = bounds[rows] + t
            if t == 0:
                best[rows] = self.begins + score[at]
                continue
            options = best[rows][:, :, None] + self.steps
            back[at] = options.argmax(axis=1)
            best[rows] = options.max(axis=1) + score[at]
        label = np.zeros(len(features), np.int8)
        current = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            rows = order[: live[t]]
            at = bounds[rows] + t
            label[at] = current[rows]
            current[rows] = back[at, current[rows]]
        return label == 0


def fit_field(features: np.ndarray, labels: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Largest conditional likelihood by gradient steps; gradients from forward and backward sums."""
    n = np.diff(bounds)
    d, t_max = len(n), int(n.max())
    x = np.zeros((d, t_max, features.shape[1]))
    y = np.zeros((d, t_max), np.int64)
    on = np.arange(t_max) < n[:, None]
    x[on], y[on] = features, labels
    sizes = [features.shape[1], 4, 2]
    theta = np.zeros(sum(sizes))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    gold_w = (x * y[:, :, None]).sum(axis=(0, 1))
    gold_s = np.zeros((2, 2))
    pair = on[:, 1:]
    np.add.at(gold_s, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    gold_b = np.bincount(y[:, 0], minlength=2).astype(float)

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, rounds + 1):
        w, s, b = theta[: sizes[0]], theta[sizes[0] : sizes[0] + 4].reshape(2, 2), theta[-2:]
        emit = np.stack([np.zeros((d, t_max)), x @ w], axis=2)
        ahead = np.zeros((d, t_max, 2))
        ahead[:, 0] = b + emit[:, 0]
        for t in range(1, t_max):
            step = log_sum(ahead[:, t - 1, :, None] + s, 1) + emit[:, t]
            ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
        behind = np.zeros((d, t_max, 2))
        for t in range(t_max - 2, -1, -1):
            step = log_sum(s + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(on[:, t + 1, None], step, 0)
        total = log_sum(ahead[:, -1], 1)
        one = np.exp(ahead + behind - total[:, None, None]) * on[:, :, None]
        two = np.exp(ahead[:, :-1, :, None] + s + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair[:, :, None, None]
        slope = np.concatenate([gold_w - np.einsum("dt,dtf->f", one[:, :, 1], x), (gold_s - two.sum(axis=(0, 1))).ravel(), gold_b - one[:, 0].sum(axis=0)]) / d - decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(theta[: sizes[0]], theta[sizes[0] : sizes[0] + 4].reshape(2, 2), theta[-2:])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """A field fitted on at most `sample` labelled documents, chosen by hash of their ids.

    Documents of more than `sample_lines` lines are not fitted on (they are judged like all others).
    None where no document of one of the kinds is left.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{quality_col}`").alias("good")).dropna().orderBy(F.xxhash64("id"), "id", "good").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    # The chosen rows are at most `sample`, so they can go to all executors.
    found = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "good", "text").limit(sample).select("text", "good").toArrow()
    if not len(found):
        return None
    good = found["good"].to_numpy().astype(bool)
    if good.all() or not good.any():
        return None
    parts = []
    for row, values, offsets in chunks(found["text"]):
        lines = Lines(values, offsets)
        short = np.diff(lines.bounds) <= sample_lines
        keep = short[lines.row]
        parts.append((lines.features[keep], lines.line_print[keep], lines.row[keep] + row))
    features, prints, row = (np.concatenate(x) for x in zip(*parts))
    if good[row].all() or not good[row].any():
        return None
    label = ~good[row] & ~np.isin(prints, np.unique(prints[good[row]]))
    bounds = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row))
    return fit_field(features, label.astype(np.int64), bounds)


def quality_rules(docs: DataFrame, field: Field | None, text_col: str = "text", content_share: float = CONTENT_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds the counts and verdicts of the rules to all columns of docs.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long);
    content_lines, a flag for each line; content_share, the share of word
    characters in content lines; base_failed; kept. Columns of docs with these
    names give way. A null text has no lines and no words, an empty one a
    single empty line; both fail the base rules, and their content_share is 0.
    Without a field all lines are content. Repeated rows are judged alike.
    """

    def step(values: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        lines = Lines(values, offsets)
        content = field.decode(lines.features, lines.bounds) if field is not None else np.ones(len(lines.row), bool)
        kept_chars = np.bincount(lines.row, weights=lines.weight * content, minlength=len(null))
        share = kept_chars / np.maximum(lines.word_chars, 1)
        failed = (lines.n_words < min_words) | (100 * lines.n_repeat_words > 50 * lines.n_words)
        shown = ~null[lines.row]
        flags = lists(np.concatenate([[0], np.cumsum(np.bincount(lines.row[shown], minlength=len(null)))]), pa.array(content[shown]))
        counts = [pa.array(np.asarray(x, np.int64)) for x in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)]
        return [*counts, flags, pa.array(share), pa.array(failed), pa.array(~failed & (share >= content_share))]

    kinds = {k: "long" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"content_lines": "array<boolean>", "content_share": "double", "base_failed": "boolean", "kept": "boolean"}
    return with_text_columns(docs, text_col, kinds, step, 1 << 19)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


