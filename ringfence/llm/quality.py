"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= j) = 1 / (1 + exp(score - threshold_j)). The expected grade and the tail probability P(grade >= g) follow.

Features of a document: the distinct runs of letters, lower case, and
the first 4 and 5 bytes of longer ones, as 64-bit hashes, and the binned shares of capitals, digits
and symbols, of words that end in a symbol, the word length and the share of distinct words. The fit keeps features
that occur often enough and whose documents' grades differ clearly from the rest, so that the hash space stays
64 bits wide and a clean word does not share the weight of another.

The fit reads a sample of about ``sample_rows`` (id, grade) pairs, chosen by a hash of the id, each with the number of its ratings
as weight and with one text, where rows share the id the least one; one task holds it.

Defined cases: a null text is empty, an empty text scores by its shape; labels without a document, or with a null,
are left out; where a document has several labels all count; with fewer than two grades nothing is rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ringfence.llm.kernels import LOWER, SPACE, mix, pieces, word_hashes, words
from ringfence.session import cut, join_small

_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
SYMBOL = ~(LETTER | DIGIT | SPACE | np.isin(_BYTES, [ord(c) for c in ".,;:'\"()-?"]))

STEMS = (4, 5)
MODEL = "features binary, weights binary, thresholds binary, shares binary"


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _levels(share: np.ndarray) -> np.ndarray:
    """Nine bins of a share, finer near 0."""
    return np.searchsorted([1e-9, 0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8], share, "right")


def distinct(docs: np.ndarray, feats: np.ndarray):
    """Each (document, feature) pair once, in order."""
    order = np.lexsort((feats, docs))
    docs, feats = docs[order], feats[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (feats[1:] != feats[:-1])
    return docs[new], feats[new]


def document_features(buf: np.ndarray, at: np.ndarray):
    """(document, feature) pairs of a piece, with repeats."""
    low = LOWER[buf]
    starts, ends, first = words(low, at, ~LETTER)
    docs = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes = word_hashes(low, starts, ends)
    stems = [(docs, hashes)]
    for k in STEMS:  # the first bytes of longer words: compounds and inflections share them
        longer = ends - starts > k
        stems.append((docs[longer], mix(word_hashes(low, starts[longer], starts[longer] + k), k)))
    n, size = np.maximum(np.diff(first), 1), np.maximum(np.diff(at), 1)
    tokens, token_ends, token_first = words(buf, at)
    m = np.maximum(np.diff(token_first), 1)
    shapes = [
        _levels(_sums(UPPER[buf], at) / size), _levels(_sums(DIGIT[buf], at) / size), _levels(_sums(SYMBOL[buf], at) / size),
        _levels(np.diff(np.concatenate([[0], np.cumsum(SYMBOL[buf[token_ends - 1]])])[token_first]) / m),
        np.minimum(_sums(LETTER[buf], at) // n, 20),
        _levels(np.bincount(distinct(docs, hashes)[0], minlength=len(at) - 1) / n),
    ]
    bins = [mix(np.uint64(1_000_003 * (k + 1)) + s.astype(np.uint64), 7) for k, s in enumerate(shapes)]
    every = np.arange(len(at) - 1)
    return np.concatenate([*[d for d, _ in stems], *[every] * len(bins)]), np.concatenate([*[h for _, h in stems], *bins])


def _sampled(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b, buf, at in pieces(batch.column("text")):
            docs, feats = distinct(*document_features(buf, at))
            parts = np.split(feats, np.cumsum(np.bincount(docs, minlength=b - a))[:-1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(a, b - a) for c in ("doc_id", "grade", "weight")], pa.array([p.tobytes() for p in parts], pa.binary())],
                ["doc_id", "grade", "weight", "features"])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None, steps: int = 600, rate: float = 0.1, ridge: float = 1e-5):
    """Weights and ordered thresholds by full gradient steps with adaptive rates (Adam)."""
    n, p = x.shape
    weight = np.ones(n) if weight is None else weight / weight.mean()
    share = np.clip(np.cumsum(np.bincount(grade, weight, minlength=grades))[:-1] / n, 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    # thresholds as the first one and the logarithms of the gaps keep their order
    par = np.concatenate([np.zeros(p), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, cuts = par[:p], par[p] + np.concatenate([[0], np.cumsum(np.exp(par[p + 1:]))])
        score = x @ w.astype(x.dtype)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -30, 30)))
        upper = np.column_stack([below, np.ones(n)])[np.arange(n), grade]
        lower = np.column_stack([np.zeros(n), below])[np.arange(n), grade]
        inv = weight / np.maximum(upper - lower, 1e-9)
        slope = below * (1 - below)
        du = np.where(grade < grades - 1, slope[np.arange(n), np.minimum(grade, grades - 2)], 0) * inv
        dl = np.where(grade > 0, slope[np.arange(n), np.maximum(grade - 1, 0)], 0) * inv
        by_cut = np.array([(dl * (grade == j + 1)).sum() - (du * (grade == j)).sum() for j in range(grades - 1)]) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([x.T @ ((du - dl).astype(x.dtype)) / n + ridge * w, tail[:1], np.exp(par[p + 1:]) * tail[1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par = par - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return par[:p], par[p] + np.concatenate([[0], np.cumsum(np.exp(par[p + 1:]))])


# parts of the hash space that the fit looks at in turn
RANGES = 16


def _evidence(each, grade: np.ndarray, weight: np.ndarray, least: int):
    """The features of all documents, ascending, and how clearly the grades of theirs differ from the rest; ``each`` has a document's in order."""
    edges = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)
    cuts = np.array([[0, *np.searchsorted(e, edges), len(e)] for e in each])
    mean = np.average(grade, weights=weight)
    spread = np.average((grade - mean) ** 2, weights=weight)
    names, clear = [], []
    for k in range(RANGES):
        doc = np.repeat(np.arange(len(each)), cuts[:, k + 1] - cuts[:, k])
        found, index = np.unique(np.concatenate([e[a:b] for e, a, b in zip(each, cuts[:, k], cuts[:, k + 1])]), return_inverse=True)
        df, mass = np.bincount(index), np.bincount(index, weight[doc])
        own = np.bincount(index, (weight * grade)[doc]) / mass
        names.append(found)
        clear.append(np.where(df >= least, np.abs(own - mean) / np.sqrt(spread / df), 0))
    return np.concatenate(names), np.concatenate(clear)


def _fit(grades: int, least: int, clear: float, most: int):
    def fit(batches):
        import pyarrow as pa

        rows, each = [np.empty((0, 3), np.int64)], []
        for b in batches:
            rows.append(np.column_stack([b.column(c).to_numpy() for c in ("doc_id", "grade", "weight")]))
            each += [np.frombuffer(f.as_buffer(), np.uint64) for f in b.column("features")]
        rows = np.concatenate(rows)
        order = np.lexsort(rows.T[::-1])
        grade, weight = rows[order, 1], rows[order, 2].astype(float)
        feats, w, cuts = np.empty(0, np.uint64), np.empty(0), np.full(grades - 1, -np.inf)
        if len(set(grade.tolist())) > 1:
            each = [each[i] for i in order]
            names, z = _evidence(each, grade, weight, least)
            keep = np.sort(np.argsort(-z, kind="stable")[:most])
            feats = names[keep[z[keep] >= clear]]
            x = np.zeros((len(each), len(feats)), np.float32)
            for row, e in zip(x, each):
                row[:] = e[np.minimum(np.searchsorted(e, feats), len(e) - 1)] == feats
            del names, z, each, row, e
            w, cuts = fit_ordinal(x, grade, grades, weight)
        shares = np.array([np.average(grade >= j, weights=weight) if len(grade) and len(feats) else 0.0 for j in range(1, grades)])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (feats, w, cuts, shares)], [f.split()[0] for f in MODEL.split(", ")])

    return fit


def fit_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample_rows: int = 20_000, least: int = 8, clear: float = 6.0, most: int = 1024) -> DataFrame:
    """A one-row table with the model; ``ratings`` has doc_id and ``grade`` from 0 to grades - 1."""
    rated = ratings.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade")).dropna()
    rated = cut(rated.groupBy("_id", "grade").agg(F.count(F.lit(1)).alias("weight")), "ratings")
    share = min(1.0, sample_rows / max(1, rated.count()))
    chosen = cut(rated.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "chosen")
    sample = join_small(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), chosen, F.col("doc_id") == F.col("_id"))
    sample = sample.groupBy("doc_id", "grade", "weight").agg(F.min("text").alias("text"))
    sample = sample.mapInArrow(_sampled, "doc_id long, grade int, weight long, features binary")
    return cut(sample.repartition(1).mapInArrow(_fit(grades, least, clear, most), MODEL), "quality-model")


def _grades(model, buf, at):
    """P(grade >= 1), P(grade >= 2), ... of the documents of a piece."""
    feats, w, cuts, _ = model
    total = np.zeros(len(at) - 1)
    if len(feats):
        docs, found = document_features(buf, at)
        place = np.minimum(np.searchsorted(feats, found), len(feats) - 1)
        hit = feats[place] == found
        docs, place = distinct(docs[hit], place[hit])
        total = np.bincount(docs, w[place], minlength=len(total))
    return 1 / (1 + np.exp(np.clip(cuts - total[:, None], -700, 700)))


def _model(model: DataFrame):
    row = model.first()
    return [np.frombuffer(bytes(row[c]), t) for c, t in (("features", np.uint64), ("weights", float), ("thresholds", float), ("shares", float))]


def _bar(parts, tail: int, least: float) -> float:
    """``least``, or the share of such grades in the sample where that is less, so that a weak fit rejects little."""
    return min(least, float(parts[3][tail - 1]))


def score_quality(docs: DataFrame, model: DataFrame, tail: int = 2, least: float = 0.8) -> DataFrame:
    """doc_id, expected_grade, tail_probability = P(grade >= tail) and kept (at least ``least``) of every document.

    The model has at most ``most`` features (see :func:`fit_quality`) and goes to the tasks with the code.
    """
    parts = _model(model)
    bar = _bar(parts, tail, least)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, buf, at in pieces(batch.column("text")):
                above = _grades(parts, buf, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(above.sum(1)), pa.array(above[:, tail - 1]), pa.array(above[:, tail - 1] >= bar)],
                                                 ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select_quality(docs: DataFrame, model: DataFrame, least: float, tail: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability is ``least`` or more."""
    parts, at_text = _model(model), docs.columns.index("text")
    bar = _bar(parts, tail, least)

    def select(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, buf, at in pieces(batch.columns[at_text]):
                yield batch.slice(a, b - a).filter(pa.array(_grades(parts, buf, at)[:, tail - 1] >= bar))

    return docs.mapInArrow(select, docs.schema)


def grade_of(quality: Column, toxic: Column) -> Column:
    """The rating of a labelled document: a point for quality, one for not being toxic."""
    return (quality + 1 - toxic).cast("int")
