"""Quality rules: decision lists learned by sequential covering.

Statistics of every text are taken in one pass. Labelled documents teach a list of
conjunctions of thresholds: each rule grows by the condition of largest gain over the
rows not yet covered, is pruned on rows kept apart, and joins the list while it is
precise there. The list becomes one ordered Spark expression, ``CASE WHEN rule THEN
'reject' ...``, that is applied to all documents.

Labels are read whole; of the labelled documents at most ``SAMPLE`` (those with the
smallest hash of their id) teach the list.

Defined cases: null and empty texts have no words and fail the base rules; documents
without label are judged like any other; several labels of a document count each;
null labels teach nothing; without usable labels the list is empty and keeps what
the base rules keep; other columns pass unchanged, but columns named like the
statistics, ``rule``, ``base_failed`` or ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.words import Words, map_batches, mixed, parts, pieces, texts

SAMPLE = 20_000
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_top", "n_capital", "n_short")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _statistics(raw: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of some texts."""
    w = Words(raw)
    n, docs = w.n_docs, w.doc
    points = w.code_points()
    per_doc = lambda values: np.bincount(docs, weights=values, minlength=n).astype(np.int64)
    chars = points[w.end] - points[w.start]
    hashes = w.hashes()
    repeated = np.zeros(len(hashes) + 1, dtype=np.int64)
    window, at = w.windows(hashes, WINDOW)
    keys = mixed(window ^ mixed(docs[at].astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        i = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[i] == keys]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, np.minimum(hit + WINDOW, len(hashes)), -1)
    covered = np.cumsum(repeated)[:-1] > 0
    # how often each different word occurs in its text
    word_key = mixed(hashes ^ mixed(docs.astype(np.uint64)))
    order = np.argsort(word_key)
    own = word_key[order]
    edges = np.flatnonzero(np.concatenate([np.ones(min(len(own), 1), dtype=bool), own[1:] != own[:-1]]))
    runs = np.diff(np.concatenate([edges, [len(own)]]))
    run_doc = docs[order][edges]
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, run_doc, runs)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    ends = np.concatenate([w.doc_start[1:], [len(w.data)]])
    first = w.data[w.start] if len(w.start) else np.empty(0, np.uint8)
    lines, dup = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(raw):
        full = [x for x in text.split(b"\n") if x.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    return {
        "n_words": w.n_words.astype(np.int64),
        "word_chars": per_doc(chars),
        "n_symbols": symbols[ends] - symbols[w.doc_start],
        "n_dup_lines": dup,
        "n_repeat_words": per_doc(covered),
        "n_lines": lines,
        "n_top": top,
        "n_capital": per_doc((first >= 65) & (first <= 90)),
        "n_short": per_doc(chars <= 3),
    }


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with COUNTS and EXTRA as long columns."""
    new = [*COUNTS, *EXTRA]
    keep = [c for c in (keep or docs.columns) if c not in new]
    schema = T.StructType(
        [*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in new)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            raw = texts(batch, text_col)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for lo, hi in pieces(raw):
                found = _statistics(raw[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in kept), *(pa.array(found[c]) for c in new)],
                    names=[*keep, *new],
                )

    wanted = list(dict.fromkeys([*keep, text_col]))
    return map_batches(docs.select(*(f"`{c}`" for c in wanted)), run, schema)


def features() -> dict[str, Column]:
    """What rules may test, from the statistics: shares that do not follow from a text's length.

    Labelled texts are mostly short, so a threshold on length, or on a share that falls
    with length such as that of different words, would reject long clean texts.
    """
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "chars_per_word": share("word_chars", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "top_share": share("n_top", "n_words"),
        "capital_share": share("n_capital", "n_words"),
        "short_share": share("n_short", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def column(self, feature: Column) -> Column:
        return feature > self.value if self.above else feature <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of largest information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (bad & inside).sum() >= MIN_COVER and (~bad & inside).any():
        p0 = (bad & inside).sum() / inside.sum()
        best, gain = None, 0.0
        for name, values in x.items():
            here = values[inside]
            cuts = np.unique(np.quantile(here, np.linspace(0, 1, 65), method="nearest"))[:-1]
            order = np.argsort(here, kind="stable")
            hits = np.concatenate([[0], np.cumsum(bad[inside][order])])
            below = np.searchsorted(here[order], cuts, side="right")
            for above in (False, True):
                n = len(here) - below if above else below
                p = hits[-1] - hits[below] if above else hits[below]
                ok = p >= MIN_COVER
                score = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - np.log2(p0)), 0)
                i = int(score.argmax()) if len(score) else 0
                if len(score) and score[i] > gain:
                    best, gain = Condition(name, above, float(cuts[i])), score[i]
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x[best.feature])
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on rows kept apart, its precision and cover."""
    best: tuple[Rule, float, int] = ((), 0.0, 0)
    value = -2.0
    for n in range(len(rule), 0, -1):
        inside = _covers(rule[:n], x)
        p, q = int((bad & inside).sum()), int((~bad & inside).sum())
        if p + q and (p - q) / (p + q) + 1e-9 * p > value:
            value = (p - q) / (p + q) + 1e-9 * p
            best = (rule[:n], p / (p + q), p)
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Sequential covering; rows with ``fold`` 0 of 3 are kept apart for pruning."""
    rules: list[Rule] = []
    open_ = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, test = open_ & (fold != 0), open_ & (fold == 0)
        if bad[grow].sum() < MIN_COVER or not test.any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        rule, precision, cover = _prune(rule, {k: v[test] for k, v in x.items()}, bad[test])
        if not rule or precision < PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
        open_ &= ~_covers(rule, x)
    return rules


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    label_id_col: str, sample: int = SAMPLE,
) -> DataFrame:
    """Statistics and label of at most ``sample`` labelled documents."""
    chosen = (
        labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).alias("label"))
        .where("label_id IS NOT NULL AND label IS NOT NULL")
        .orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    )
    # at most ``sample`` rows
    taught = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "label_id"
    )
    return text_statistics(taught, "text", ["label_id", "label"])


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", label_id_col: str = "doc_id", sample: int = SAMPLE,
) -> list[Rule]:
    """The decision list; label 0 is bad."""
    names = list(features())
    rows = (
        labelled_statistics(docs, labels, id_col, text_col, label_col, label_id_col, sample)
        .select("label", F.pmod(F.xxhash64(F.lit("fold"), "label_id"), F.lit(3)).alias("fold"),
                "label_id", *(f.alias(f"f_{k}") for k, f in features().items()))
        .toPandas()
        .sort_values(["label_id", "label"], kind="stable")
    )
    if rows.empty:
        return []
    x = {k: rows[f"f_{k}"].to_numpy(dtype=float) for k in names}
    return learn_rules(x, rows["label"].to_numpy() == 0, rows["fold"].to_numpy())


def rule_column(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    known = features()
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds &= c.column(known[c.feature])
        out = F.when(holds, F.lit(" AND ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Statistics, ``base_failed``, the ``rule`` that rejects (null: none) and ``kept``."""
    keep = [c for c in (keep or docs.columns) if c not in ("rule", "base_failed", "kept")]
    return (
        text_statistics(docs, text_col, keep)
        .withColumn("rule", rule_column(rules))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
