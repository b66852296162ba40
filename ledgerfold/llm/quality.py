"""Quality of documents by a text classifier and hierarchical empirical Bayes over sites.

A logistic model on text statistics and on the evidence of hashed words, word
pairs and character 4-grams, fitted on a bounded sample of labelled
rows, gives each document a probability. A gram's evidence is the log ratio of its shares
of good and of bad documents; the model is fitted on evidence from other folds of the sample. Hosts and the paths below them get
posterior means of it, by grouped sums over all documents: a host is shrunk
toward the global mean, a path toward its host, each by a prior strength that is
estimated from the spread between groups. A document's log odds are then moved
by what its site says, its own evidence taken out of the site's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrowtext import buffers, lower_ascii, mixed, steps, tidy, word_hashes
from .scratch import small_enough, stored

#: Labelled rows that the classifier is fitted on, at most: those with the least hash of their id.
SAMPLE = 10_000
#: Prior strengths are kept within these bounds (in documents).
STRENGTH = (5.0, 10_000.0)
#: A document is kept from this probability on; to lose a good one is the worse error.
THRESHOLD = 0.4

#: Byte classes whose shares are features.
_CLASSES = [b"|", b"!", b"#$%&*", b"+=<>@~^_\\/{}[]", b"0123456789", b".,;:'\"?()-", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b" \t"]
STATISTICS = len(_CLASSES) + 7
#: Kinds of grams (words, word pairs, character 4-grams), and the codes that each is hashed to.
KINDS, CODES = 3, 1 << 16
FEATURES = STATISTICS + KINDS
#: Folds of the sample.
FOLDS = 5


def _counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes in each text."""
    before = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=before[1:])
    return np.diff(before[offsets])


def _grams(low: np.ndarray, offsets: np.ndarray, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, offsets by text) for each kind of grams of lower-cased texts; grams don't reach over the end of a text."""
    yield (words & np.uint64(CODES - 1)).astype(np.int32), at
    pair = np.zeros(len(words), np.int32)
    if len(words) > 1:
        pair[:-1] = (mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) & np.uint64(CODES - 1)).astype(np.int32)
    yield _but_last(pair, at, 1)
    four = np.zeros(len(low), np.int32)
    if len(low) > 3:
        wide = low.astype(np.uint32)
        code = wide[:-3] * np.uint32(0x01000193) ^ wide[1:-2]
        for j in (2, 3):
            code *= np.uint32(0x01000193)
            code ^= wide[j : len(low) - 3 + j]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        four[:-3] = code >> np.uint32(16)
    yield _but_last(four, offsets, 3)


def _but_last(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes without the last n of each text."""
    size = np.diff(offsets)
    kept = np.maximum(size - n, 0)
    mark = np.ones(len(codes), bool)
    for j in range(1, n + 1):
        mark[offsets[1:][size >= j] - j] = False
    return codes[mark], np.concatenate(([0], np.cumsum(kept)))


def gram_counts(column: pa.Array, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Number of texts that have a gram, by (fold, y, kind, code)."""
    out = np.zeros((FOLDS, 2, KINDS, CODES), np.int32)
    data, offsets = buffers(column)
    for a, b in steps(offsets):
        low, own = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        words, at = word_hashes(low, own)
        for kind, (codes, by) in enumerate(_grams(low, own, words, at)):
            text, code = np.divmod(np.unique(np.repeat(np.arange(b - a), np.diff(by)) * CODES + codes), CODES)  # each gram of a text once
            np.add.at(out, (fold[a + text], y[a + text].astype(np.int64), kind, code), 1)
    return out


def evidence(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """(kind, code): log ratio of the shares of good and bad texts with a gram. counts: (y, kind, code); texts: by y."""
    share = (counts + 0.5) / (texts[:, None, None] + 1.0)
    return np.log(share[1] / share[0]).astype(np.float32)


def features(column: pa.Array, tables: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
    """A row of text statistics and mean evidence for each text; table: the number of each text's evidence in tables, else the first."""
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for a, b in steps(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        size = np.maximum(np.diff(own), 1)
        columns = []
        for chars in _CLASSES:
            marks = np.zeros(256, bool)
            marks[list(chars)] = True
            columns.append(_counted(marks[part], own) / size)
        columns.append(_counted(part >= 0x80, own) / size)
        low = lower_ascii(part)
        words, at = word_hashes(low, own)
        n = np.diff(at)
        again = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            same = words[1:] == words[:-1]
            same[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(words))] - 1] = False  # not across texts
            again[2:] = np.cumsum(same)
        repeated = again[at[1:]] - again[at[:-1]]
        text = np.repeat(np.arange(b - a), n)
        order = np.lexsort((words, text))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (np.diff(text[order]) > 0) | (words[order][1:] != words[order][:-1])
        distinct = np.bincount(text[order][fresh], minlength=b - a)
        some = np.maximum(n, 1)
        columns += [np.log1p(n), size / some / 10, repeated / some, distinct / some, np.log1p(size), (n == 0).astype(float)]
        which = np.zeros(b - a, np.int64) if table is None else table[a:b]
        for kind, (codes, by) in enumerate(_grams(low, own, words, at)):
            count = np.diff(by)
            value = tables[0][kind][codes] if table is None else np.stack([t[kind] for t in tables])[np.repeat(which, count), codes]
            total = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
            columns.append((total[by[1:]] - total[by[:-1]]) / np.maximum(count, 1))
        out[a:b] = np.stack(columns, axis=1)
    return out


@dataclass(frozen=True)
class Model:
    """A logistic model over standardised features and their squares, and the evidence that features are made with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    table: np.ndarray

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -12, 12)

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray, table: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> Model:
        """Penalised maximum likelihood by Newton steps. Without rows of both kinds, the model is a constant."""
        if len(y) == 0:
            return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES + 1), table)
        empty = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(2 * FEATURES + 1), table)
        design, w = empty._design(x), empty.weights.copy()
        ridge = penalty * np.eye(len(w))
        ridge[-1, -1] = 0.01
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return Model(empty.mean, empty.scale, w, table)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, y, text) of at most `sample` labelled ids, those with the least hash.

    Rows with a null id or label are not used, several labels of an id are
    averaged, of several texts of an id the smallest is taken.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the texts of at most `sample` labelled ids; see labelled."""
    fold = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FOLDS)).cast("int")
    known = labelled(docs, labels, id_col, text_col, label_col, sample).select("y", fold.alias("fold"), "text")

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, KINDS, CODES), np.int32)
        for batch in batches:
            total += gram_counts(batch.column(2), np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])

    # no more rows than there are codes by fold, label and kind
    found = known.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FOLDS * 2 * KINDS * CODES, np.int64)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(FOLDS, 2, KINDS, CODES)
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in known.groupBy("fold", "y").count().collect():
        sizes[r["fold"], r["y"]] = r["count"]
    every, all_texts = counts.sum(axis=0), sizes.sum(axis=0)
    tables = [evidence(every - counts[f], all_texts - sizes[f]) for f in range(FOLDS)]

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2), tables, np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    sampled = known.mapInArrow(rows, "y int, x array<double>").toArrow()  # `sample` rows at most
    y = np.asarray(sampled["y"].combine_chunks(), np.float64)
    x = np.array(sampled["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    order = np.lexsort(np.vstack([x.T, y]))  # the same sums whatever order the rows came in
    return Model.fitted(x[order], y[order], evidence(every, all_texts))


def with_probability(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """docs with the classifier's probability in column `name`."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    names = to_arrow_schema(schema).names
    at = docs.columns.index(text_col)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for start, end in steps(buffers(texts)[1]):
                p = 1 / (1 + np.exp(-model.logit(features(texts[start:end], [model.table]))))
                yield pa.RecordBatch.from_arrays([*batch[start:end].columns, pa.array(p)], names)

    return docs.mapInArrow(rows, schema)


def site_sums(scored: DataFrame, host: Column, path: Column, p: str) -> DataFrame:
    """(host, path, n, s, q): number, sum and sum of squares of probabilities by path."""
    return scored.groupBy(host.alias("host"), path.alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("q")
    )


def _strength(groups: DataFrame) -> float:
    """Prior strength from the spread of the means of groups (n, s, q) around their common mean."""
    r = groups.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return STRENGTH[1]
    within = max(r["q"] - r["b"], 1e-9) / (r["n"] - r["k"])
    between = (r["b"] - r["s"] ** 2 / r["n"] - (r["k"] - 1) * within) / (r["n"] - r["n2"] / r["n"])
    return float(np.clip(within / between, *STRENGTH)) if between > 0 else STRENGTH[1]


def posteriors(sums: DataFrame) -> tuple[DataFrame, float, float, float]:
    """((host, path, n, s, host_n, host_s), global mean, host strength, path strength)."""
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total["s"] / total["n"]) if total["n"] else 0.5
    sites = sums.select("host", "path", "n", "s").join(
        hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s")), F.col("host").eqNullSafe(F.col("h"))
    )
    return sites.drop("h"), mean, _strength(hosts), _strength(sums)


def judged(scored: DataFrame, host: Column, path: Column, p: str, threshold: float, prefix: str = "") -> DataFrame:
    """scored with p_host, p_path, p_quality and kept, their names after `prefix`.

    p_host and p_path are the posteriors of the document's site without the document.
    """
    sites, mean, host_strength, path_strength = posteriors(stored(site_sums(scored, host, path, p)))
    sites = stored(sites.withColumnsRenamed({c: f"{prefix}_{c}" for c in sites.columns}))
    if small_enough(sites.count(), 200):
        sites = F.broadcast(sites)
    at = lambda c: F.col(f"{prefix}_{c}")
    odds = lambda x: F.log(x / (1 - x))
    bounded = lambda x: F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), x))
    own = bounded(F.col(p))
    joined = scored.join(sites, host.eqNullSafe(at("host")) & path.eqNullSafe(at("path")))
    names = [f"{prefix}{c}" for c in ("p_host", "p_path", "p_quality", "kept")]
    return (
        joined.withColumn(names[0], bounded((at("host_s") - F.col(p) + host_strength * mean) / (at("host_n") - 1 + host_strength)))
        .withColumn(names[1], bounded((at("s") - F.col(p) + path_strength * F.col(names[0])) / (at("n") - 1 + path_strength)))
        .withColumn(names[2], 1 / (1 + F.exp(-(odds(own) + odds(F.col(names[1])) - odds(bounded(F.lit(mean)))))))
        .withColumn(names[3], F.col(names[2]) >= threshold)
        .drop(*(f"{prefix}_{c}" for c in ("host", "path", "n", "s", "host_n", "host_s")))
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: id, host, path, p_text, p_host, p_path, p_quality, kept.

    Null hosts and paths are sites of their own. Null and empty texts are scored
    as texts without words, texts of any length whole. Rows that repeat an id are
    judged each by its text; a document at the threshold is kept. Other columns of
    docs and labels are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text")
    )
    scored = stored(with_probability(rows, model, "text", "p_text").drop("text"))
    return judged(scored, F.col("host"), F.col("path"), "p_text", threshold)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """docs, all columns, without the rows that quality rejects."""
    model = fit(docs, labels, id_col, text_col)
    new = "__"
    while any(c.startswith(new) for c in docs.columns):
        new += "_"
    scored = stored(with_probability(docs, model, text_col, new + "p"))  # read twice: for the sites, then for the verdicts
    return judged(scored, F.col(host_col), F.col(path_col), new + "p", threshold, new).where(F.col(new + "kept")).select(*docs.columns)
