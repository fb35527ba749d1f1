"""Themes of a corpus: a non-negative factorisation of its TF-IDF rows, fitted in passes over all documents.

Documents are kept as batches of arrays in the checkpoint folder; a pass sums small matrices over them, so what reaches
the driver grows with terms and cores, not with documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.storage import cut

#: Themes: number, terms of one and two tokens at most; passes at most, and the share of the first violation at which they end.
THEMES, TERMS, PASSES, TOLERANCE = 8, 8_000, 1_000, 1e-4
#: Start: columns and steps of the Krylov space in which the singular vectors are found.
_COLUMNS, _STEPS = 12, 5
#: Least squares with signs: rows at most of which every set is tried, and changes of the sets.
_SETS, _CHANGES = 8, 8
_TERM = re.compile(r"[a-z0-9_]{2,}")

Batches = Iterator[pa.RecordBatch]


def _plain(text: str) -> F.Column:
    """The text from which ``T.topic_tokens`` takes tokens, with all the blanks and signs that only separate these."""
    c = raw = F.coalesce(text, F.lit(""))
    c = F.when(raw.contains("<"), F.regexp_replace(c, r"<[^>]+>", " ")).otherwise(c)
    c = F.when(raw.contains("http") | raw.contains("www."), F.regexp_replace(c, r"https?://[^\s]+|www\.[^\s]+", " URL ")).otherwise(c)
    return F.lower(c)


def _column(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in values], kind)


def _packed(batches: Batches) -> Batches:
    """A row a batch: keys of the documents with a topic token, their numbers of tokens, all tokens as codes, and the words."""
    stop = set(T.STOPWORDS)
    for b in batches:
        runs = pc.split_pattern_regex(b.column(1), r"[^a-z0-9'#+.\-]+")
        coded, lens = runs.flatten().dictionary_encode(), pc.list_value_length(runs).to_numpy()
        words: dict[str, int] = {}
        topic, size, flat = [], [], []
        for run in coded.dictionary.to_pylist():
            t = run.lstrip("0123456789'#+.-").rstrip("'#+.-")
            topic.append(len(t) >= 3 and t not in stop)
            parts = [p for p in _TERM.findall(t) if p not in stop] if topic[-1] else []
            size.append(len(parts))
            flat += [words.setdefault(p, len(words)) for p in parts]
        codes, at = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(lens)])
        per = lambda x: np.concatenate([[0], np.cumsum(np.array(x, np.int64)[codes])])
        some, ends = np.diff(per(topic)[at]) > 0, per(size)
        first = (np.cumsum(size) - size)[codes] if len(codes) else codes
        tokens = np.array(flat, np.uint32)[np.repeat(first - ends[:-1], np.diff(ends)) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.uint32)
        row = [b.column(0).filter(pa.array(some)).to_pylist(), np.diff(ends[at])[some].astype(np.int32), tokens, list(words)]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(b.column(0).type)), _column(row[1:2]), _column(row[2:3]), pa.array([row[3]], pa.list_(pa.string()))], ["keys", "lens", "tokens", "words"])


def _documents(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its document and code; of each pair of neighbours their document and place."""
    lens, tokens = np.frombuffer(b.column(1)[i].as_py(), np.int32), np.frombuffer(b.column(2)[i].as_py(), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    return doc, tokens, doc[pair], pair


def _counted(batches: Batches) -> Batches:
    """(term, df, total) within each batch."""
    for b in batches:
        for i in range(b.num_rows):
            doc, tokens, other, pair = _documents(b, i)
            words = b.column(3)[i].values
            w = len(words)
            if not w:
                continue
            found, tf = np.unique(np.concatenate([doc, other]) * (w + w * w) + np.concatenate([tokens, w + tokens[pair] * w + tokens[pair + 1]]), return_counts=True)
            term, place = np.unique(found % (w + w * w), return_inverse=True)
            one, two = term[term < w], term[term >= w] - w
            names = pa.concat_arrays([words.take(pa.array(one)), pc.binary_join_element_wise(words.take(pa.array(two // w)), words.take(pa.array(two % w)), " ")])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(place, minlength=len(term)).astype(np.int64)), pa.array(np.bincount(place, tf, len(term)).astype(np.int64))], ["term", "df", "total"])


def _weighted(names: list[str], idf: np.ndarray) -> Callable[[Batches], Batches]:
    """A row a batch: keys, numbers of terms, the terms with repetition, and lengths of the TF-IDF rows."""

    def run(batches: Batches) -> Batches:
        at, m = {t: j for j, t in enumerate(names)}, len(names)
        pairs = [(*t.split(" "), j) for t, j in at.items() if " " in t]
        for b in batches:
            for i in range(b.num_rows):
                doc, tokens, other, pair = _documents(b, i)
                words = {t: j for j, t in enumerate(b.column(3)[i].as_py())}
                w, n = len(words), len(b.column(1)[i].as_py()) // 4
                known = sorted((words[x] * w + words[y], j) for x, y, j in pairs if x in words and y in words)
                left, right = np.array([k for k, _ in known] + [w * w]), np.array([j for _, j in known] + [-1])
                code = tokens[pair] * w + tokens[pair + 1]
                place = np.searchsorted(left, code)
                term = np.concatenate([np.array([at.get(t, -1) for t in words], np.int64)[tokens], np.where(left[place] == code, right[place], -1)])
                held = term >= 0
                found, tf = np.unique(np.concatenate([doc, other])[held] * m + term[held], return_counts=True)
                row, term = found // m, found % m
                norm = np.sqrt(np.bincount(row, (tf * idf[term]) ** 2, n))
                lens = np.bincount(row, tf, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), _column([lens]), _column([np.repeat(term, tf).astype(np.uint16)]), _column([norm])], ["keys", "lens", "terms", "norm"])

    return run


class _Rows:
    """The TF-IDF rows of a batch, documents without terms left out."""

    def __init__(self, b: pa.RecordBatch, i: int, idf: np.ndarray):
        lens, norm = np.frombuffer(b.column("lens")[i].as_buffer(), np.int32), np.frombuffer(b.column("norm")[i].as_buffer(), np.float64)
        self.full = lens > 0
        self.lens, self.norm, self.idf = lens[self.full], norm[self.full], idf
        self.at, self.terms = np.cumsum(self.lens) - self.lens, np.frombuffer(b.column("terms")[i].as_buffer(), np.uint16).astype(np.intp)

    def times(self, h: np.ndarray) -> np.ndarray:
        """``h X'``, a column a document."""
        spare = np.empty(len(self.terms))
        return np.array([np.add.reduceat(np.take(x, self.terms, out=spare, mode="clip"), self.at) for x in h * self.idf]) / self.norm

    def sums(self, w: np.ndarray) -> np.ndarray:
        """``w X`` with a column of ``w`` a document."""
        return np.array([np.bincount(self.terms, np.repeat(x, self.lens), len(self.idf)) for x in w / self.norm]) * self.idf


def _inverses(g: np.ndarray) -> np.ndarray:
    """For every set of rows, by its bits, the inverse of that part of g, zeros elsewhere."""
    held = (np.arange(1 << len(g))[:, None] >> np.arange(len(g))) & 1
    pair = held[:, :, None] * held[:, None, :]
    return np.linalg.pinv(g * pair, hermitian=True) * pair


def nonnegative(g: np.ndarray, b: np.ndarray, least: float = 1e-10, sweeps: int = 10_000, inverses: np.ndarray | None = None) -> np.ndarray:
    """The columns x >= 0 with the least ``x'gx / 2 - b'x``.

    Rows that have the wrong sign, in x or in the slope, change between zero and free until none has; columns for which
    that doesn't end soon, and all with many rows, by coordinate descent until none moves by more than ``least``.
    ``inverses`` are those of g, for callers with many b.
    """
    x, live = np.maximum(np.linalg.pinv(g, hermitian=True) @ b, 0), np.arange(b.shape[1])
    if len(g) <= _SETS:
        inverses, part = _inverses(g) if inverses is None else inverses, np.ascontiguousarray(b.T)
        free, low = x.T > 0, lambda v, of: v < -1e-12 * np.abs(of).max(1, keepdims=True)
        for _ in range(_CHANGES):
            y = np.einsum("nij,nj->ni", inverses[free @ (1 << np.arange(len(g)))], part)
            slope = y @ g - part
            wrong = np.where(free, low(y, y), low(slope, part))
            more = wrong.any(1)
            x[:, live] = np.maximum(y, 0).T
            live, part, free = live[more], part[more], free[more] ^ wrong[more]
            if not len(live):
                return x
    diagonal = np.maximum(np.diag(g), 1e-12)
    part, aim = x[:, live], b[:, live]
    for _ in range(sweeps):
        moved = np.zeros(len(live))
        for k in range(len(g)):
            new = np.maximum(part[k] + (aim[k] - g[k] @ part) / diagonal[k], 0)
            np.maximum(moved, np.abs(new - part[k]), out=moved)
            part[k] = new
        go = moved > least * np.maximum(1, part.max(0))
        if not go.all():
            x[:, live] = part
            live = live[go]
            part, aim = x[:, live], b[:, live]
        if not len(live):
            break
    x[:, live] = part
    return x


@contextmanager
def _handed(spark: SparkSession, rows: int) -> Iterator[None]:
    """Workers get so many rows at a time, which here are large, and begin while the next are read."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _summed(packed: DataFrame, idf: np.ndarray, f: Callable[[_Rows], np.ndarray]) -> np.ndarray:
    """The sum of f over all batches."""

    def run(batches: Batches) -> Batches:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                rows = _Rows(b, i, idf)
                if len(rows.lens):
                    total = f(rows) if total is None else total + f(rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([_column([total])], ["total"])

    def join(batches: Batches) -> Batches:
        total = sum(np.frombuffer(x.as_py()) for b in batches for x in b.column(0))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([_column([total])], ["total"])

    cores = packed.sparkSession.sparkContext.defaultParallelism
    got = packed.select("lens", "terms", "norm").coalesce(cores).mapInArrow(run, "total binary")
    if cores > 64:
        got = got.repartition(8).mapInArrow(join, "total binary")
    with _handed(packed.sparkSession, 4):
        return np.sum([np.frombuffer(r.total) for r in got.collect()], 0)


def _start(packed: DataFrame, idf: np.ndarray, k: int, n: int) -> np.ndarray:
    """Non-negative parts of the leading singular vectors, zeros filled with the mean weight (NNDSVDa)."""
    m = len(idf)
    q = np.linalg.qr(np.random.default_rng(42).normal(size=(m, min(m, max(_COLUMNS, k)))))[0]
    space, image = np.zeros((m, 0)), np.zeros((m, 0))
    for _ in range(_STEPS):
        y = _summed(packed, idf, lambda r, q=q: r.sums(r.times(q.T)).ravel()).reshape(-1, m).T
        space, image = np.hstack([space, q]), np.hstack([image, y])
        rest = y
        for _ in range(2):
            rest = rest - space @ (space.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        q = u[:, s > 1e-9 * max(1.0, np.linalg.norm(y))][:, : m - space.shape[1]]
        if not q.shape[1]:
            break
    value, vector = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
    v = (space @ vector[:, ::-1][:, :k]).T
    s = np.sqrt(np.maximum(value[::-1][:k], 0))

    def sides(r: _Rows) -> np.ndarray:
        p = r.times(np.vstack([v, np.ones(m)]))
        return np.concatenate([(np.maximum(p[:-1], 0) ** 2).sum(1), (np.minimum(p[:-1], 0) ** 2).sum(1), [p[-1].sum()]])

    got = _summed(packed, idf, sides)
    up, un = np.sqrt(got[:k]) / np.maximum(s, 1e-12), np.sqrt(got[k : 2 * k]) / np.maximum(s, 1e-12)
    h = np.zeros((k, m))
    h[0] = np.sqrt(s[0]) * np.abs(v[0])
    for j in range(1, k):
        p, q = np.maximum(v[j], 0), np.maximum(-v[j], 0)
        a, b = up[j] * np.linalg.norm(p), un[j] * np.linalg.norm(q)
        part, weight = (p, a) if a > b else (q, b)
        h[j] = np.sqrt(s[j] * weight) * part / max(np.linalg.norm(part), 1e-12)
    h[h < 1e-6] = 0
    h[h == 0] = got[-1] / (n * m)
    return h


def factorised(packed: DataFrame, idf: np.ndarray, k: int, n: int, passes: int = PASSES, tolerance: float = TOLERANCE) -> np.ndarray:
    """H of ``X = WH`` by alternating exact least squares, extrapolated where that lowers the error.

    A pass finds the best W of every document, so nothing but H is kept between passes.  They end when the projected
    gradient is at most ``tolerance`` of the first one, as absolute sums.  In the end each theme has as much weight in W as in H.
    """
    m = len(idf)
    h = tried = _start(packed, idf, k, n)
    least, first, ahead = np.inf, 0.0, 0.5

    def both(g: np.ndarray, h: np.ndarray) -> Callable[[_Rows], np.ndarray]:
        sets = _inverses(g) if k <= _SETS else None

        def f(r: _Rows) -> np.ndarray:
            w = nonnegative(g, r.times(h), 1e-7, inverses=sets)
            return np.concatenate([r.sums(w).ravel(), (w @ w.T).ravel(), [w.shape[1]]])

        return f

    for at in range(passes):
        got = _summed(packed, idf, both(tried @ tried.T, tried))
        wx, ww = got[: k * m].reshape(k, m), got[k * m : -1].reshape(k, k)
        error = got[-1] - 2 * (wx * tried).sum() + (ww * (tried @ tried.T)).sum()
        if error > least and tried is not h:
            tried, ahead = h, ahead / 2
            continue
        slope = ww @ tried - wx
        violation = np.abs(np.where(tried > 0, slope, np.minimum(slope, 0))).sum()
        first = first or violation
        weight = np.sqrt(np.diag(ww))
        best, least, last = tried, error, h
        if violation <= tolerance * first or at + 1 == passes:
            break
        h = nonnegative(ww, wx)
        tried, ahead = (h if at == 0 else np.maximum(h + ahead * (h - last), 0)), min(1.0, ahead * 1.05)
    own = np.linalg.norm(best, axis=1)
    return best * np.sqrt(np.divide(weight, own, out=np.ones(k), where=(own > 0) & (weight > 0)))[:, None]


def themes(docs: DataFrame, key: str, text: str, k: int = THEMES) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): rows (key, theme, strength), terms (theme, term, weight, rank) of weights above zero.

    Documents are those with a topic token.  Terms are runs of one and two of their tokens as in ``tfidf_terms``, in at
    least 1, 2 or 3 documents by the size of the corpus and at most 95 % of them; of these the most frequent ``TERMS``,
    ties by term.  Rows of smooth TF-IDF have unit length.  A document's theme is the one with the largest weight, the
    lower number at ties; its strength is that weight.  Documents without any of the terms have theme 0 and strength 0.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    tokens = cut(docs.select(key, _plain(text).alias("_t")).mapInArrow(_packed, f"keys array<{kind}>, lens binary, tokens binary, words array<string>"))
    n = tokens.agg(F.sum(F.size("keys"))).first()[0] or 0
    least = 1 if n < 30 else 2 if n < 100 else 3
    counts = tokens.mapInArrow(_counted, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = counts.filter((F.col("df") >= least) & (F.col("df") <= 0.95 * n)).orderBy(F.desc("total"), "term").limit(TERMS).select("term", "df").collect()
    names, idf = [r.term for r in kept], np.log((1.0 + n) / (1.0 + np.array([r.df for r in kept], float))) + 1.0
    packed = cut(tokens.mapInArrow(_weighted(names, idf), f"keys array<{kind}>, lens binary, terms binary, norm binary"))
    h = factorised(packed, idf, min(k, n, len(names)), n) if names else np.zeros((1, 0))
    sets = _inverses(h @ h.T) if len(h) <= _SETS else None

    def dealt(batches: Batches) -> Batches:
        for b in batches:
            for i in range(b.num_rows):
                rows, keys = _Rows(b, i, idf), b.column("keys")[i].values
                w = np.zeros((len(h), len(keys)))
                w[:, rows.full] = nonnegative(h @ h.T, rows.times(h), inverses=sets)
                w = w.round(6)
                yield pa.RecordBatch.from_arrays([keys, pa.array(w.argmax(0).astype(np.int32)), pa.array(w.max(0))], [key, "theme", "strength"])

    found = [(j, names[t], float(h[j, t]), r + 1) for j in range(len(h)) for r, t in enumerate(np.argsort(-h[j], kind="stable")) if h[j, t] > 0]
    columns = [list(c) for c in zip(*found)] or [[]] * 4
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64(), pa.int32()))], ["theme", "term", "weight", "rank"])
    return packed.mapInArrow(dealt, f"{key} {kind}, theme int, strength double"), spark.createDataFrame(table)
