"""Quality rules: rule statistics of whole texts, and an isolation forest over them with a threshold set on labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import add_columns
from placewise.llm.words import LINE_BYTES, WHITE, WORD_BYTES, byte_set, mix, runs, shingles
from placewise.tables import by_shuffle, materialize

# The symbols that a rule counts.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_distinct"]
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "marks", "word_length", "distinct", "line_words"]

_SYMBOL, _UPPER, _MARK = byte_set(SYMBOLS), byte_set(bytes(range(65, 91))), byte_set(b"!?")


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def _repeated(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value occurs twice or more in its text, whether it is such an occurrence after the first)."""
    if not len(values):
        return np.zeros(0, bool), np.zeros(0, bool)
    keys = mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:]] = same
    later[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of each text of an Arrow column."""
    words = runs(texts)
    data, offsets = words.data, words.offsets
    begin, end = offsets[:-1], offsets[1:]
    in_word = WORD_BYTES[data]
    out = {"n_words": words.counts, "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), begin, end)}
    out["n_symbols"] = _sums(_SYMBOL[data], begin, end)
    lines = runs(texts, LINE_BYTES)
    filled = _sums(in_word, lines.starts, lines.ends) > 0
    owner = lines.owner[filled]
    _, later = _repeated(lines.hashes[filled], owner)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=len(texts))
    out["n_lines"] = np.bincount(owner, minlength=len(texts))
    windows, first = shingles(words, 3)
    real = np.repeat(words.counts >= 3, np.diff(first))
    at = np.arange(len(windows)) + np.repeat(words.first[:-1] - first[:-1], np.diff(first))
    many, _ = _repeated(windows[real], np.repeat(np.arange(len(texts)), np.diff(first))[real])
    covered = np.zeros(len(words.hashes) + 3, bool)
    for j in range(3):
        covered[at[real][many] + j] = True
    out["n_repeat_words"] = _sums(covered[:-3], words.first[:-1], words.first[1:])
    _, again = _repeated(words.hashes, words.owner)
    out["n_distinct"] = _sums(~again, words.first[:-1], words.first[1:])
    out["n_upper"] = _sums(_UPPER[data], begin, end)
    out["n_marks"] = _sums(_MARK[data], begin, end)
    return {name: out[name].astype(np.int64) for name in STATISTICS}


def add_statistics(docs: DataFrame, text: str = "text", forest: IsolationForest | None = None, part: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with the rule statistics of the whole text, and with ``forest`` its score as anomaly; null or empty text: zeros.

    ``part`` names the text's field if the column is a struct.
    """
    fields = [(name, T.LongType()) for name in STATISTICS] + ([("anomaly", T.DoubleType())] if forest else [])

    def compute(column):
        found = statistics(column if part is None else column.field(part))
        return [*found.values(), *([forest.scores(features(found))] if forest else [])]

    return add_columns(docs, text, fields, compute, arrow=True, keep_text=keep_text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics, one row per text; independent of a text's length as far as they can be."""
    n = np.maximum(stats["n_words"], 1).astype(float)
    chars = np.maximum(stats["word_chars"], 1).astype(float)
    lines = np.maximum(stats["n_lines"], 1).astype(float)
    return np.column_stack([
        np.log1p(20 * stats["n_symbols"] / n), stats["n_dup_lines"] / lines, stats["n_repeat_words"] / n, stats["n_upper"] / chars,
        np.log1p(20 * stats["n_marks"] / n), stats["word_chars"] / n, np.log1p(stats["n_distinct"]) / np.log1p(n), np.log1p(n / lines),
    ])


@dataclass
class IsolationForest:
    """Random split trees in flat arrays; a leaf has feature -1 and its expected path length as value."""

    feature: np.ndarray  # trees x nodes
    value: np.ndarray
    child: np.ndarray  # the left child; the right one follows it
    norm: float
    threshold: float = 0.6
    n_rows: int = 0  # counted in every tree

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node in which each row ends."""
        every = np.arange(len(rows))
        for feature, value, child in zip(self.feature, self.value, self.child):
            node = np.zeros(len(rows), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                at = every[inner]
                own = node[inner]
                node[inner] = child[own] + (rows[at, feature[own]] >= value[own])
            yield node

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the power of minus the mean path length over its expectation."""
        total = np.zeros(len(rows))
        for value, node in zip(self.value, self.leaves(rows)):
            total += value[node]
        return np.exp2(-total / max(len(self.feature), 1) / self.norm)


_FEW = 256  # trees are judged by what so many rows, drawn at random, would look like on average
_EXPECTED = np.array([0.0, 0.0, 1.0] + [2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n for n in range(3, _FEW + 1)])
_GRID = 1 << 20  # scores are counted in steps of one over this


def _expected(n: np.ndarray | float) -> np.ndarray:
    return np.interp(n, np.arange(len(_EXPECTED)), _EXPECTED)


def grow_trees(low: np.ndarray, high: np.ndarray, trees: int = 100, seed: int = 7) -> IsolationForest:
    """Complete trees of random cuts in the box from ``low`` to ``high``; no row is needed to make them. The children of node i are 2 i + 1 and 2 i + 2.

    Cutting the box that all labelled rows span also splits on a rule that no ordinary text breaks: there the ordinary texts all lie in one spot, and a text beyond the cut is alone after a
    short path.
    """
    rng, depth_limit = np.random.default_rng(seed), int(np.log2(_FEW)) + 4
    lows, highs = (np.broadcast_to(x, (trees, 1, len(x))).copy() for x in (low, high))
    features_, values = [], []
    for depth in range(depth_limit + 1):
        wide = highs > lows
        chosen = np.where(wide, rng.random(wide.shape), -1.0).argmax(-1)
        inner = wide.any(-1) & (depth < depth_limit)
        at = chosen[..., None]
        left, right = np.take_along_axis(lows, at, -1), np.take_along_axis(highs, at, -1)
        cut = left + rng.random(left.shape) * (right - left)
        features_.append(np.where(inner, chosen, -1))
        values.append(np.where(inner, cut[..., 0], 0.0))
        low_right, high_left = lows.copy(), highs.copy()
        np.put_along_axis(low_right, at, cut, -1)
        np.put_along_axis(high_left, at, cut, -1)
        lows = np.stack([lows, low_right], 2).reshape(trees, -1, lows.shape[-1])
        highs = np.stack([high_left, highs], 2).reshape(trees, -1, highs.shape[-1])
    feature = np.concatenate(features_, 1)
    child = np.where(feature >= 0, 2 * np.arange(feature.shape[1]) + 1, 0)
    return IsolationForest(feature, np.concatenate(values, 1), child, float(_expected(_FEW)))


def count_leaves(forest: IsolationForest, counts: np.ndarray) -> IsolationForest:
    """The forest with its path lengths, by how many rows end in each node (``counts``, trees x nodes) of the complete trees; a node that holds a row or less of ``_FEW`` is a leaf."""
    held = counts.astype(float)
    for node in range(held.shape[1] - 1, 0, -1):
        held[:, (node - 1) // 2] += held[:, node]
    n = held[:, :1]
    few = np.minimum(n, _FEW)
    scaled = held * few / np.maximum(n, 1)
    depth = np.log2(np.arange(held.shape[1]) + 1).astype(int)
    leaf = (forest.feature < 0) | (scaled <= 1)
    value = np.where(leaf, depth + _expected(scaled), forest.value)
    return IsolationForest(np.where(leaf, -1, forest.feature), value, np.where(leaf, 0, forest.child), max(float(_expected(few[0, 0])), 1e-9), n_rows=int(n[0, 0]))


def calibrate(forest: IsolationForest, steps: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float = 0.002) -> IsolationForest:
    """Set the threshold by how many good and bad labelled rows have a score of each of the ascending ``steps`` (of one over ``_GRID``): the cut with the best balance of found bad and lost
    good rows, never losing more than ``most_lost`` of the good ones.

    Without rows of both labels the threshold stays as it is.
    """
    if good.sum() and bad.sum():
        at = np.searchsorted(np.cumsum(good), [rank + 1 for rank in (int(np.floor((good.sum() - 1) * (1 - most_lost))), int(np.ceil((good.sum() - 1) * (1 - most_lost))))])
        share = (good.sum() - 1) * (1 - most_lost) % 1
        floor = steps[at[0]] + share * (steps[at[1]] - steps[at[0]])
        over = [np.cumsum(x[::-1])[::-1] / x.sum() for x in (bad, good)]
        cut = max(floor, float(steps[(over[0] - over[1]).argmax()]))
        above, below = steps[steps >= cut], steps[steps < cut]
        # Half way to the next score below, if there is one.
        forest.threshold = float((above.min() + below.max() + 1) / 2 if len(above) and len(below) else cut) / _GRID
    return forest


def train_quality_forest(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> IsolationForest:
    """A forest and threshold from all labelled texts.

    The box is that of all labelled rows, every good row is counted in every tree, and every labelled row's score counts for the threshold. Only sums reach the driver: the box, the nodes' counts
    and the scores' counts. Labels that are null, without a text or doubled for a key are left out. Without labels the forest is empty and keeps every text.
    """
    clean = labels.select(F.col(key).alias("_pw_key"), F.col("quality").alias("_pw_quality")).where("_pw_key is not null and _pw_quality is not null")
    clean = clean.groupBy("_pw_key").agg(F.min("_pw_quality").alias("_pw_quality"), F.max("_pw_quality").alias("_pw_most")).where("_pw_quality = _pw_most")
    # Texts stay where they are: their statistics are joined.
    rows = add_statistics(docs.select(F.col(key).alias("_pw_key"), F.col(text).alias("_pw_body")), "_pw_body", keep_text=False).where(~base_failed())
    rows = materialize(rows.join(by_shuffle(clean.select("_pw_key", (F.col("_pw_quality") > 0).alias("_pw_good"))), "_pw_key").select("_pw_good", *STATISTICS))

    def over_rows(spread: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
        """``spread`` of each batch's features and labels."""

        def run(batches):
            for batch in batches:
                found = features({name: batch.column(name).to_numpy() for name in STATISTICS})
                made = spread(found, batch.column("_pw_good").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=[part.split()[0] for part in schema.split(", ")])

        return rows.mapInArrow(run, schema)

    ends = over_rows(lambda found, good: [np.repeat(np.arange(len(FEATURES)), 2), np.stack([found.min(0), found.max(0)], 1).ravel()] if len(found) else [np.zeros(0, np.int64), np.zeros(0)], "at long, value double")
    box = {r.at: (r.low, r.high) for r in ends.groupBy("at").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    if not box:
        return IsolationForest(np.full((1, 1), -1), np.ones((1, 1)), np.zeros((1, 1), np.int64), 1.0, threshold=2.0)
    forest = grow_trees(*np.array([box[i] for i in range(len(FEATURES))]).T)
    every = rows.where("_pw_good").isEmpty()  # then the trees count all rows
    width = forest.feature.shape[1]

    def nodes(found: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        ends = [node + tree * width for tree, node in enumerate(forest.leaves(found if every else found[good]))]
        return list(np.unique(np.concatenate(ends), return_counts=True))

    counted = over_rows(nodes, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(forest.feature.size, np.int64)
    counts[counted["node"].to_numpy()] = counted["n"].to_numpy()
    forest = count_leaves(forest, counts.reshape(forest.feature.shape))
    scored = over_rows(lambda found, good: [np.floor(forest.scores(found) * _GRID).astype(np.int64), good.astype(np.int64)], "step long, good long")
    steps = scored.groupBy("step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas().sort_values("step")
    return calibrate(forest, *(steps[c].to_numpy() for c in ("step", "good", "bad")))


def add_verdict(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """``rows`` (with statistics and anomaly) with base_failed and kept."""
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.threshold))


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the rule statistics, base_failed, anomaly and kept.

    A text fails by base rules (under 50 words, or more than half of its words in repeated 3-word windows) or by an
    anomaly score over the threshold that labelled rows set. Null or empty text: zero statistics, fails. Equal texts get equal verdicts.
    """
    forest = train_quality_forest(docs, labels, key, text)
    return add_verdict(add_statistics(docs, text, forest, keep_text=keep_text), forest)
