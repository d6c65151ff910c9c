"""Quality classifier: document evidence within hierarchical empirical Bayes.

1. Evidence. Every text becomes a set of features: lower-cased words without punctuation, by
   their whole 64-bit hash, so no word stands for another, and binned statistics. At most
   ``SAMPLE`` labelled documents, chosen by hash, give for each feature counts of documents
   with and without the trait, added up within tasks; the sample is broadcast to the
   texts, which stay where they are. Features whose log odds are clearly not
   zero weigh in; they are features of the sample, so their number is bounded with it. A
   text's evidence is the sum of its ``STRONGEST`` largest weights of
   each sign, so that a long text does not gather many weak ones; it is calibrated by a
   logistic curve on at most ``SAMPLE`` labelled documents.
2. Sites. All labelled documents are counted by host and by path. A host's rate is shrunk
   toward the global rate, a path's toward its host's; how strongly follows from how
   much rates differ between sites beyond chance (method of moments), so sparse sites
   stay near their parent.
3. A document's log odds are its evidence plus what its path's rate adds to the global.

Two traits are judged: low quality (label 0) and toxicity (label 1); ``kept`` is
neither.

Defined cases: null and empty texts have the features of an empty text; a null host or
path is a site of its own; repeated rows are each judged; several labels of a document
count each; a document with one label counts for that trait alone; without labels of both kinds a trait has no evidence and
the rate 0; other columns than the id, text, host and path are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_lookup, stored
from auditlake.llm.quality_rules import COUNTS, EXTRA, _statistics
from auditlake.llm.words import Words, map_batches, mixed, parts, pieces, texts

SAMPLE = 20_000
BINS = 8
Z = 5.0
LEAST = 1.0
SEEN = 5
STRONGEST = 1
TRAITS = ("bad", "toxic")
_COUNTS = ("n_bad", "bad", "n_toxic", "toxic")
_SHARES = (
    ("n_symbols", "n_words"), ("word_chars", "n_words"), ("n_repeat_words", "n_words"),
    ("n_dup_lines", "n_lines"), ("n_top", "n_words"),
    ("n_capital", "n_words"), ("n_short", "n_words"),
)
_MARKS = bytes.maketrans(b".,;:!?\"()[]{}#*$%&|<>", b" " * 21)
N_FEATURES = len(_SHARES) * (BINS + 1)
# beside word hashes: binned statistics below N_FEATURES, and ALL, which counts every text
ALL = N_FEATURES
COUNTED = 1 << 18


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; words are whole 64-bit hashes."""
    w = Words([t.lower().translate(_MARKS) for t in raw])
    found = _statistics(raw)
    docs, features = [w.doc.astype(np.int64)], [w.hashes().view(np.int64)]
    every = np.arange(len(raw))
    for i, (a, b) in enumerate(_SHARES):
        share = found[a] / np.maximum(found[b], 1)
        if a == "word_chars":
            share = share / 16
        docs.append(every)
        features.append(i * (BINS + 1) + np.minimum(np.ceil(share * BINS), BINS).astype(np.int64))
    doc, feature = np.concatenate(docs), np.concatenate(features)
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _added_up(feature: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every feature once, with the sums of its rows."""
    order = np.argsort(feature, kind="stable")
    feature = feature[order]
    start = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])[: len(feature)])
    return feature[start], np.add.reduceat(marks[order], start, axis=0) if len(start) else marks[:0]


def _known_marks() -> list[Column]:
    """Documents with a label and with the trait, for each trait; a null label is neither."""
    return [
        F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
        for t in TRAITS for name, c in ((f"n_{t}", F.col(t).isNotNull().cast("int")), (t, F.col(t)))
    ]


def clear_features(taught: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights by trait) of the features that are clear of chance, sorted.

    Tasks add up their own counts and pass them on whenever they hold ``COUNTED``
    features. What is clear is found where the counts are, so the driver takes only the
    features with a weight, of which a labelled text has few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            at, sums = _added_up(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays(
                [pa.array(at), *(pa.array(sums[:, k]) for k in range(4))], names=["feature", *_COUNTS],
            )

        for batch in parts(batches):
            raw = texts(batch, "text")
            marks = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], axis=1)
            held.append((np.array([ALL]), marks.sum(axis=0)[None, :]))
            for lo, hi in pieces(raw):
                doc, feature = _features(raw[lo:hi])
                held.append(_added_up(feature, marks[lo + doc]))
                size += len(held[-1][0])
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = stored(
        map_batches(taught.select("text", *_known_marks()), run,
                    "feature long, " + ", ".join(f"{c} long" for c in _COUNTS))
        .groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))
        .where((F.greatest("n_bad", "n_toxic") >= SEEN) | (F.col("feature") == ALL))
    )
    total = counts.where(F.col("feature") == ALL).select(*_COUNTS).first()
    if total is None:
        return np.empty(0, dtype=np.int64), np.empty((0, 2), dtype=np.float32)
    whole = np.array(total, dtype=float)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            c = np.stack(columns[1:], axis=1).astype(float)
            # each trait over the documents that have its label
            w = np.stack([weights(c[:, [k, k + 1, k + 1]], whole[[k, k + 1, k + 1]])[:, 0] for k in (0, 2)], axis=1)
            use = w.any(axis=1) & (columns[0] != ALL)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0][use]), *(pa.array(w[use, k]) for k in range(2))],
                names=["feature", "bad", "toxic"],
            )

    rows = map_batches(counts, weigh, "feature long, bad float, toxic float").toPandas()
    rows = rows.sort_values("feature")
    return rows["feature"].to_numpy(np.int64), rows[["bad", "toxic"]].to_numpy(np.float32)


def weights(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds a feature adds, by trait; zero unless large and clear of chance.

    Long texts have many features: what is weak or due to chance would add up there.
    """
    out = np.zeros((len(counts), 2), dtype=np.float32)
    for k in (1, 2):
        pos, neg = counts[:, k], counts[:, 0] - counts[:, k]
        n_pos, n_neg = total[k], total[0] - total[k]
        if not n_pos or not n_neg:
            continue
        log_odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        # likelihood ratio against the global rate: also right for few documents
        rate, n = total[k] / total[0], np.maximum(counts[:, 0], 1)
        deviance = 2 * (pos * np.log(np.maximum(pos, 1) / (n * rate))
                        + neg * np.log(np.maximum(neg, 1) / (n * (1 - rate))))
        out[:, k - 1] = np.where((deviance > Z * Z) & (np.abs(log_odds) > LEAST), log_odds, 0)
    return out


def strongest(doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """By text, the sum of the largest weights above zero and of those below."""
    out = np.zeros(n_docs)
    for sign in (1, -1):
        at = np.flatnonzero(weight * sign > 0)
        at = at[np.lexsort((-sign * weight[at], doc[at]))]
        own = doc[at]
        rank = np.arange(len(at)) - np.searchsorted(own, own)
        top = at[rank < STRONGEST]
        out += np.bincount(doc[top], weights=weight[top], minlength=n_docs)
    return out


def with_evidence(
    docs: DataFrame, clear: tuple[np.ndarray, np.ndarray], keep: list[str]
) -> DataFrame:
    """``keep`` with the summed weights ``e_bad`` and ``e_toxic``."""
    held = docs.sparkSession.sparkContext.broadcast(clear)
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in keep),
                           *(T.StructField(f"e_{t}", T.DoubleType()) for t in TRAITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, w = held.value
        for batch in parts(batches):
            raw = texts(batch, "text")
            sums = np.zeros((len(raw), 2))
            for lo, hi in pieces(raw):
                doc, feature = _features(raw[lo:hi])
                at = np.searchsorted(used, feature)
                known = at < len(used)
                known[known] = used[at[known]] == feature[known]
                for k in range(2):
                    sums[lo:hi, k] = strongest(doc[known], w[at[known], k], hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep),
                 *(pa.array(sums[:, k]) for k in range(2))],
                names=schema.names,
            )

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic curve by Newton's method, lightly regularised."""
    if not len(label) or label.all() or not label.any():
        return 0.0, 0.0
    scale = max(float(np.abs(evidence).max()), 1e-9)
    x = np.stack([evidence / scale, np.ones(len(label))], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (label - p) - 1e-3 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _strength(groups: DataFrame, parent: str, trait: str) -> float:
    """How many documents a parent's rate counts for, from the spread between sites."""
    groups = groups.where(F.col(f"n_{trait}") > 0)
    n, k, p = F.col(f"n_{trait}"), F.col(trait), F.col(parent)
    r = groups.agg(
        F.sum(n).alias("N"), F.sum(n * n).alias("NN"), F.count("*").alias("G"),
        F.sum(n * (k / n - p) * (k / n - p)).alias("S"), F.sum(n * p * (1 - p)).alias("V"),
    ).first()
    if not r.N or r.G < 2:
        return 1e6
    chance = r.V / r.N
    between = (r.S - (r.G - 1) * chance) / max(r.N - r.NN / r.N, 1e-9)
    if between <= 0 or chance <= 0:
        return 1e6
    return float(min(max(chance / between - 1, 1.0), 1e6))


def site_rates(taught: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Rates of paths shrunk to hosts' (host, path, r_bad, r_toxic), of hosts shrunk to the
    global ones (host, h_bad, h_toxic), and the global ones; each trait over its own labels."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    paths = stored(taught.select("host", "path", *_known_marks()).groupBy("host", "path").agg(*sums))
    hosts = stored(paths.groupBy("host").agg(*sums))
    total = hosts.agg(*sums).first()
    rates = {t: (total[t] or 0) / total[f"n_{t}"] if total[f"n_{t}"] else 0.0 for t in TRAITS}
    for t in TRAITS:
        m = _strength(hosts.withColumn("g", F.lit(rates[t])), "g", t)
        hosts = hosts.withColumn(f"h_{t}", (F.col(t) + m * rates[t]) / (F.col(f"n_{t}") + m))
    shrunk = hosts.select(F.col("host").alias("h"), *(f"h_{t}" for t in TRAITS))
    paths = paths.join(shrunk, F.col("host").eqNullSafe(F.col("h")))
    out = stored(paths)
    for t in TRAITS:
        m = _strength(out, f"h_{t}", t)
        out = out.withColumn(f"r_{t}", (F.col(t) + m * F.col(f"h_{t}")) / (F.col(f"n_{t}") + m))
    return out.select("host", "path", *(f"r_{t}" for t in TRAITS)), hosts, rates


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
    text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality",
    toxic_col: str = "toxic", sample: int = SAMPLE,
) -> DataFrame:
    """id, host, path, ``p_bad``, ``p_toxic`` (probabilities) and ``kept`` of every document."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
    )
    marks = labels.select(
        F.col(label_id_col).alias("id"), (F.col(quality_col) == 0).cast("bigint").alias("bad"),
        (F.col(toxic_col) == 1).cast("bigint").alias("toxic"),
    ).where("id IS NOT NULL AND (bad IS NOT NULL OR toxic IS NOT NULL)")
    chosen = marks.orderBy(F.xxhash64("id"), "id", "bad", "toxic").limit(sample)
    # at most ``sample`` narrow rows are sent, so no text moves
    clear = clear_features(rows.select("id", "text").join(F.broadcast(chosen), "id"))
    judged = stored(with_evidence(rows, clear, ["id", "host", "path"]))
    taught = stored(judged.join(marks, "id"))
    seen = taught.orderBy(F.xxhash64("id"), "id").limit(sample).select("e_bad", "e_toxic", *TRAITS).toPandas()
    paths, hosts, rates = site_rates(taught)
    hosts = hosts.select("host", *(f"h_{t}" for t in TRAITS))
    sited = salted_lookup(salted_lookup(judged, hosts, ["host"], ["id"]), paths, ["host", "path"], ["id"])
    for t in TRAITS:
        known = seen[seen[t].notna()]
        slope, offset = calibrate(known[f"e_{t}"].to_numpy(float), known[t].to_numpy(float))
        rate = F.coalesce(f"r_{t}", f"h_{t}", F.lit(rates[t]))
        odds = F.col(f"e_{t}") * slope + offset + _logit(rate) - _logit(F.lit(rates[t]))
        p = 1 / (1 + F.exp(-odds)) if 0 < rates[t] < 1 else F.lit(rates[t])
        sited = sited.withColumn(f"p_{t}", p)
    return sited.select(
        F.col("id").alias(id_col), "host", "path", "p_bad", "p_toxic",
        ((F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"),
    )
