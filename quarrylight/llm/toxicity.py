"""Abusive, hateful or sexually explicit language: scores, passages, rates.

Method: every token gets the log-odds of a toxic against a clean language model,
both smoothed by Dirichlet priors from counts of the whole corpus (pairs of
neighbours, backed by single words).  The maximal-scoring segments of a text,
found in linear time, are its toxic passages; extreme-value statistics turn a
segment's score and the text's length into a p-value that compares across lengths.

Fitting: a bounded, hash-ordered sample of reviewed comments (``MAX_LABELLED``)
starts the models on whole comments; then the toxic model is refitted on the
passages found inside comments reviewed as abusive, and the clean one on the
rest, so that the harmless sentences around an insult stop counting.  A passage
that stands in the corpus more often than its labelled share can explain is
harmless (``Evidence``).  Prior counts come from all comments; the calibration is
fitted on labelled clean comments by models that didn't see them.

Defined results: null and blank texts have score 0, p-value 1 and no passage.  A
repeated ``comment_id`` counts once, with its highest score.  Without any usable
labels of both kinds, or with an empty table, every score is 0.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample that is collected for fitting.
MAX_LABELLED = 30_000
#: A comment is abusive when its best passage is at least this unlikely in clean text of its length.
SIGNIFICANCE = 4e-4
#: Prior strengths: corpus counts in the toxic and in the clean model, as shares of their own tokens.
#: The corpus is mostly clean, so it weighs heavily there; the toxic model leans on its passages.
TOXIC_PRIOR, CLEAN_PRIOR = 0.1, 4.0
#: A pair may lift a word's own log-odds by this much, so that no single odd pair makes a passage.
PAIR_LIFT = 3.0
ROUNDS = 4
#: Calibration: folds of the labelled sample, share of clean labels that may be wrong, and the least scale.
FOLDS, WRONG, LEAST_SCALE = 3, 0.08, 0.2
_CACHE = 200_000

_CJK = "぀-ヿ㐀-鿿가-힣"
_TOKEN = re.compile(rf"[{_CJK}]|[^\s.,;:?\"“”«»()\[\]{{}}<>/\\|…—–，。！？、।؟¿¡#&%+=~^{_CJK}]+")
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤︎️﻿]")
#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKE = str.maketrans("авекмнорстухіјѕԁԛԝһӏαβεικνορτυχγω", "abekmhopctyxijsdqwhlabeiknoptuxyw")
_SIGNS = str.maketrans("013457890@$!€£", "oieastbgoasiel")
_LATIN, _REPEAT = re.compile("[a-z]"), re.compile(r"(\w)\1{2,}")
_HYPHENED = re.compile(r"^\w(?:-\w)+$|^\w-\w{3,}$")


def fold(raw: str) -> str:
    """A token without case, look-alikes, signs for letters and drawn-out letters; ``#`` for numbers."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", raw)).lower().strip("!'’*-_`$€£") if "*" not in raw else (
        unicodedata.normalize("NFKC", _INVISIBLE.sub("", raw)).lower().strip("!'’-_`")
    )
    if raw[:1] in "$@" and _LATIN.search(raw.lower()):
        t = raw.lower().strip("!'’-_`")
    if not t:
        return ""
    if _LATIN.search(t):
        if not t.isascii():
            t = t.translate(_LOOKALIKE)
        if sum(c.isdigit() for c in t) >= 4 and not any(c in "@$" for c in t):
            return "#"
        if any(c in "0134578@$!" for c in t) and sum(c.isalpha() for c in t) * 5 >= len(t) and "@" != t[-1:]:
            t = t.translate(_SIGNS)
        if "-" in t and _HYPHENED.match(t):
            t = t.replace("-", "")
        return _REPEAT.sub(r"\1", t)
    return "#" if any(c.isdigit() for c in t) else t


class Folder:
    """Folded tokens of texts, remembering the tokens it has seen."""

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}

    def __call__(self, text: str | None) -> list[str]:
        return self._folded(_TOKEN.findall(text), None) if text else []

    def spans(self, text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
        """Tokens and where each stands in the text, end exclusive."""
        at = [m.span() for m in _TOKEN.finditer(text or "")]
        return self._folded([text[a:b] for a, b in at], at), at

    def _folded(self, raws: list[str], at: list[tuple[int, int]] | None) -> list[str]:
        """Tokens of the raw words; ``at``, their places, is brought into line with what is dropped and joined."""
        seen, out = self.seen, []
        if len(seen) > _CACHE:
            seen.clear()
        kept: list[tuple[int, int]] | None = [] if at is not None else None
        run = 0
        for i, raw in enumerate(raws):
            t = seen.get(raw)
            if t is None:
                t = seen[raw] = fold(raw)
            if t:
                out.append(t)
                if kept is not None:
                    kept.append(at[i])
                if len(t) == 1 and t != "#" and t < "　":
                    run += 1
                    continue
            if run >= 3:
                _join(out, kept, run, bool(t))
            run = 0
        if run >= 3:
            _join(out, kept, run, False)
        if kept is not None:
            at[:] = kept
        return out


def _join(out: list[str], at: list[tuple[int, int]] | None, run: int, after: bool) -> None:
    """Letters that stand alone, one after another, become the word they spell."""
    end = len(out) - after
    out[end - run : end] = ["".join(out[end - run : end])]
    if at is not None:
        at[end - run : end] = [(at[end - run][0], at[end - 1][1])]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) in linear time."""
    found: list[list] = []  # first, end, sum before, sum up to its end, last one before it with a lesser sum before
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


class Model:
    """Log-odds of words and of word pairs, with what is needed to calibrate them."""

    def __init__(self, words: dict[str, float], pairs: dict[str, dict[str, float]], unseen: float, k: float, scale: float = 1.0):
        self.words, self.pairs, self.unseen, self.k, self.scale = words, pairs, unseen, k, scale
        self.masked = [w for w, s in words.items() if s > 1.0 and len(w) > 3]
        self.known: dict[str, str] = {}

    def lookup(self, token: str) -> str:
        """The word of the model that a token with masked letters stands for."""
        if "*" not in token:
            return token
        if token not in self.known:
            fits = re.compile(r"\w{1,3}".join(map(re.escape, re.split(r"\*+", token))) + "$")
            self.known[token] = max((w for w in self.masked if fits.match(w)), key=self.words.__getitem__, default=token)
        return self.known[token]

    def scores(self, tokens: list[str]) -> list[float]:
        words, pairs, unseen, out, before = self.words, self.pairs, self.unseen, [], ""
        for t in tokens:
            if "*" in t:
                t = self.lookup(t)
            after = pairs.get(before)
            s = after.get(t) if after is not None else None
            if s is None:
                s = words.get(t, unseen)
            out.append(s)
            before = t
        return out

    def best(self, tokens: list[str]) -> float:
        """Score of the best segment."""
        top = now = 0.0
        for s in self.scores(tokens):
            now += s
            if now < 0:
                now = 0.0
            elif now > top:
                top = now
        return top

    def p_value(self, score: float, length: int) -> float:
        """Chance that clean text of ``length`` tokens holds a segment of this score."""
        if score <= 0 or not length:
            return 1.0
        return -math.expm1(-self.k * length * math.exp(-self.scale * score))


def _language_model(texts: Iterable[list[str]], supported: bool) -> tuple[Counter, dict[str, Counter], int]:
    """Counts of words and pairs.  ``supported``: what a single text holds doesn't speak for itself, so one text less counts."""
    words: Counter = Counter()
    flat: Counter = Counter()
    for t in texts:
        found = zip(t, t[1:])
        words.update(set(t) if supported else t)
        flat.update(set(found) if supported else found)
    if supported:
        words = Counter({w: n - 1 for w, n in words.items() if n > 1})
        flat = Counter({w: n - 1 for w, n in flat.items() if n > 1})
    pairs: dict[str, Counter] = {}
    for (v, w), n in flat.items():
        pairs.setdefault(v, Counter())[w] = n
    return words, pairs, sum(words.values())


class Corpus:
    """Counts and smoothed rates of words and pairs in the whole corpus, and the number of its texts."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int, texts: int) -> None:
        self.words, self.pairs, self.total, self.texts = words, pairs, total + len(words) + 1, texts

    def word(self, w: str) -> float:
        return (self.words.get(w, 0) + 1) / self.total

    def pair(self, v: str, w: str) -> float:
        return (self.pairs[v, w] + self.word(v)) / self.total


def supported_pairs(texts: Iterable[list[str]]) -> set[tuple[str, str]]:
    """Pairs of neighbours that stand in at least two of the texts; only these can speak for a passage."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(set(zip(t, t[1:])))
    return {p for p, n in seen.items() if n > 1}


def _odds(toxic: list[list[str]], clean: list[list[str]], corpus: Corpus, paired: bool) -> Model:
    """Log-odds of the toxic against the clean model.

    Words and pairs alike have the counts of the whole corpus as prior, strongly in the clean model and weakly in the
    toxic one, so what is frequent everywhere needs as much more evidence to count as toxic.
    """
    tw, tp, tn = _language_model(toxic, True)
    cw, cp, cn = _language_model(clean, False)
    at, ac = max(1.0, TOXIC_PRIOR * tn), max(1.0, CLEAN_PRIOR * cn)

    def odds(t: int, c: int, base: float) -> float:
        return math.log((t + at * base) / (tn + at)) - math.log((c + ac * base) / (cn + ac))

    words = {w: odds(tw[w], cw[w], corpus.word(w)) for w in tw.keys() | cw.keys()}
    pairs: dict[str, dict[str, float]] = {}
    if paired:
        none: Counter = Counter()
        for v in tp.keys() | cp.keys():
            a, b = tp.get(v, none), cp.get(v, none)
            pairs[v] = {
                w: min(odds(a[w], b[w], corpus.pair(v, w)), max(words.get(w, 0.0), 0.0) + PAIR_LIFT)
                for w in a.keys() | b.keys()
                if (v, w) in corpus.pairs
            }
    return Model(words, pairs, math.log((at / (tn + at)) / (ac / (cn + ac))), 1.0)


def tail(tops: list[tuple[float, int]]) -> tuple[float, float]:
    """(scale, K) of the extreme-value law ``P(top <= s) = exp(-K n exp(-scale s))`` from (top, length) of clean texts.

    Censored maximum likelihood, the lengths as offset: of tops below the median only that they are below counts, of the
    highest ``WRONG``, where labels may be wrong, only that they are as high.
    """
    x, n = np.array([s for s, _ in tops]), np.log([float(n) for _, n in tops])
    low, high = np.quantile(x, 0.5), np.quantile(x, 1 - WRONG)
    high = max(high, low + 1e-6)
    below, above = x <= low, x >= high
    held, held_n = x[~below & ~above], n[~below & ~above]

    def likelihood(scale: float, log_k: float) -> float:
        inner = log_k + held_n - scale * held
        top = np.exp(np.minimum(log_k + n[above] - scale * high, 30.0))
        return (
            -np.exp(log_k + n[below] - scale * low).sum()
            + (math.log(scale) + inner - np.exp(inner)).sum()
            + np.log(np.maximum(-np.expm1(-top), 1e-300)).sum()
        )

    def best(f, a: float, b: float, steps: int) -> float:
        for _ in range(steps):
            c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
            a, b = (a, d) if f(c) > f(d) else (c, b)
        return (a + b) / 2

    k_at = lambda scale: best(lambda k: likelihood(scale, k), -15.0, 10.0, 30)
    scale = best(lambda s: likelihood(s, k_at(s)), LEAST_SCALE, 1.0, 16)
    return scale, math.exp(k_at(scale))


class Evidence:
    """How far the corpus bears out that a pair is toxic: abusive comments are a few, and a share of these is labelled.

    Of a toxic pair's occurrences that share, ``rate``, lies in comments labelled as abusive; of a clean pair's only
    ``rate`` times the share of abusive comments, as they hold harmless sentences too.
    """

    def __init__(self, bad: list[list[str]], good: list[list[str]], corpus: Corpus) -> None:
        clean = {p for t in good for p in zip(t, t[1:])}
        held: Counter = Counter()
        for t in bad:
            held.update(set(zip(t, t[1:])))
        sure = sorted(held[p] / max(corpus.pairs[p], held[p]) for p in held if held[p] >= 3 and p not in clean and p in corpus.pairs)
        self.rate = min(0.95, sure[len(sure) // 2]) if sure else 0.5
        few = min(0.5, max(1e-3, len(bad) / self.rate / max(corpus.texts, 1)))
        prior, seen, unseen = math.log(few / (1 - few)), math.log(1 / few), math.log((1 - self.rate) / (1 - self.rate * few))
        self.odds = {p: max(-5.0, min(5.0, prior + n * seen + max(corpus.pairs.get(p, n) - n, 0) * unseen)) for p, n in held.items()}

    def bears_out(self, passage: list[str]) -> bool:
        odds = [self.odds.get(p, 0.0) for p in zip(passage, passage[1:])]
        return sum(odds) >= 0


def _fit(bad: list[list[str]], good: list[list[str]], corpus: Corpus) -> Model:
    """Model of whole comments first, then of the passages found in the abusive ones that the corpus bears out, the rest counting as clean."""
    model = _odds(bad, good, corpus, False)
    evidence = Evidence(bad, good, corpus)
    for turn in range(ROUNDS):
        toxic: list[list[str]] = []
        rest = list(good)
        floor = 4.0 if turn == 0 else 6.0
        for t in bad:
            t = [model.lookup(w) for w in t]
            at = 0
            for a, b, s in segments(model.scores(t)):
                if s >= floor and evidence.bears_out(t[a:b]):
                    rest.append(t[at:a])
                    toxic.append(t[a:b])
                    at = b
            rest.append(t[at:])
        if not toxic:
            break
        model = _odds(toxic, [r for r in rest if r], corpus, turn > 0)
    return model


def fit(labelled: list[tuple[str, bool]], corpus: Corpus) -> Model | None:
    """A model from (text, is abusive) rows and counts of the whole corpus, calibrated on clean texts it wasn't fitted on."""
    folder = Folder()
    bad = [t for x, y in labelled if y and (t := folder(x))]
    good = [t for x, y in labelled if not y and (t := folder(x))]
    if not bad or not good:
        return None
    model = _fit(bad, good, corpus)
    tops: list[tuple[float, int]] = []
    for k in range(FOLDS):
        part = [[t for i, t in enumerate(ts) if i % FOLDS != k] for ts in (bad, good)]
        if all(part):
            other = _fit(*part, corpus)
            tops += [(other.best(t), len(t)) for t in good[k::FOLDS]]
    if len(tops) >= 20:
        model.scale, model.k = tail(tops)
    return model


# -- Spark ------------------------------------------------------------------------------------------------------------


_PAIR = "\u0001"


def _counter(wanted_var):
    """Counts of the wanted words and pairs (joined by ``_PAIR``), of all tokens ("") and of texts (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = wanted_var.value
        folder, counts, paired, tokens, texts = Folder(), Counter(), Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = folder(text)
                if t:
                    tokens += len(t)
                    texts += 1
                    counts.update(filter(words.__contains__, t))
                    paired.update(filter(pairs.__contains__, zip(t, t[1:])))
        keys = [None, "", *counts, *map(_PAIR.join, paired)]
        yield pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.string()), "n": pa.array([texts, tokens, *counts.values(), *paired.values()], pa.int64())})

    return run


def train(comments: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of reviewed comments and on counts over all comments of the words and pairs in them."""
    spark = comments.sparkSession
    votes = (
        labels.filter(F.col("is_abusive").isNotNull() & F.col("comment_id").isNotNull())
        .groupBy("comment_id")
        .agg(F.avg(F.col("is_abusive").cast("double")).alias("share"))
        .filter("share <> 0.5")
        .select("comment_id", (F.col("share") > 0.5).alias("bad"))
        .orderBy(F.xxhash64("comment_id"), "comment_id")
        .limit(MAX_LABELLED)
        .collect()
    )
    if not votes:
        return None
    known = spark.createDataFrame(votes, "comment_id string, bad boolean")
    # At most MAX_LABELLED ids: small by construction.
    rows = (
        comments.select("comment_id", "comment_clean")
        .join(F.broadcast(known), "comment_id")
        .groupBy("comment_id")
        .agg(F.max("comment_clean").alias("text"), F.first("bad").alias("bad"))
        .orderBy("comment_id")
        .collect()
    )
    labelled = [(r.text, r.bad) for r in rows if r.text]
    folder = Folder()
    texts = [folder(x) for x, _ in labelled]
    words = {w for t in texts for w in t}
    if not words:
        return None
    # No more than the words and pairs of MAX_LABELLED texts.
    wanted = spark.sparkContext.broadcast((words, supported_pairs(texts)))
    counts = comments.select("comment_clean").mapInArrow(_counter(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = {r.token: r.n for r in counts.collect()}
    pairs = {tuple(k.split(_PAIR)): n for k, n in got.items() if k and _PAIR in k}
    return fit(labelled, Corpus({k: n for k, n in got.items() if k and _PAIR not in k}, pairs, got[""], got[None]))


_SCORED = "comment_id string, score double, p_value double"


def _scorer(model_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folder = model_var.value, Folder()
        for batch in batches:
            memo: dict[str | None, tuple[float, float]] = {}
            out = []
            for text in batch.column(1).to_pylist():
                got = memo.get(text)
                if got is None:
                    tokens = folder(text)
                    top = model.best(tokens) if model else 0.0
                    got = memo[text] = (top, model.p_value(top, len(tokens)) if model else 1.0)
                out.append(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array([s for s, _ in out], pa.float64()), pa.array([p for _, p in out], pa.float64())],
                ["comment_id", "score", "p_value"],
            )

    return run


def score_rows(comments: DataFrame, model: Model | None) -> DataFrame:
    """(comment_id, score, p_value) of every row, repeated rows included."""
    var = comments.sparkSession.sparkContext.broadcast(model)
    return comments.select("comment_id", "comment_clean").mapInArrow(_scorer(var), _SCORED)


def abusive(comments: DataFrame, labels: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """comment_id of the comments with a significant toxic passage."""
    return (
        score_rows(comments, train(comments, labels))
        .filter((F.col("p_value") < significance) & F.col("comment_id").isNotNull())
        .select("comment_id")
        .distinct()
    )


def scored(comments: DataFrame, labels: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """(comment_id, score, p_value, is_abusive): one row per comment, by its best passage."""
    return (
        score_rows(comments, train(comments, labels))
        .filter(F.col("comment_id").isNotNull())
        .groupBy("comment_id")
        .agg(F.round(F.max("score"), 4).alias("score"), F.min("p_value").alias("p_value"))
        .withColumn("is_abusive", F.col("p_value") < significance)
    )


def rates(comments: DataFrame, labels: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """Comments and abusive comments per docket and per channel (``kind``, ``name``); repeated rows count once."""
    model = train(comments, labels)
    var = comments.sparkSession.sparkContext.broadcast(model)
    run = _scorer(var)

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in run(iter([batch])):
                bad = pa.array([p < significance for p in s.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), bad], ["comment_id", "docket_id", "channel", "bad"])

    rows = (
        comments.select("comment_id", "comment_clean", "docket_id", F.lower(F.trim("channel")).alias("channel"))
        .mapInArrow(with_keys, "comment_id string, docket_id string, channel string, bad boolean")
        .filter(F.col("comment_id").isNotNull())
        .groupBy("comment_id")
        .agg(F.max("docket_id").alias("docket_id"), F.max("channel").alias("channel"), F.max("bad").alias("bad"))
    )
    keyed = rows.select("bad", F.explode(F.create_map(F.lit("docket"), F.col("docket_id"), F.lit("channel"), F.col("channel"))).alias("kind", "name"))
    return keyed.groupBy("kind", "name").agg(
        F.count("*").alias("comments"),
        F.sum(F.col("bad").cast("int")).alias("abusive"),
        F.round(F.avg(F.col("bad").cast("int")), 6).alias("rate"),
    )


def passages(comments: DataFrame, labels: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """(comment_id, passage_no, start_char, end_char, score, p_value, passage): every significant passage, as it stands in the text."""
    var = comments.sparkSession.sparkContext.broadcast(train(comments, labels))
    types = {"comment_id": pa.string(), "passage_no": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "score": pa.float64(), "p_value": pa.float64(), "passage": pa.string()}
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folder = var.value, Folder()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, at = folder.spans(text)
                if not model or key is None or model.p_value(model.best(tokens), len(tokens)) >= significance:
                    continue
                good = [(a, b, s, p) for a, b, s in segments(model.scores(tokens)) if (p := model.p_value(s, len(tokens))) < significance]
                for n, (a, b, s, p) in enumerate(good, 1):
                    start, end = at[a][0], at[b - 1][1]
                    rows.append(dict(zip(types, (key, n, start, end, round(s, 4), p, text[start:end]))))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return (
        comments.select("comment_id", "comment_clean")
        .mapInArrow(run, "comment_id string, passage_no int, start_char int, end_char int, score double, p_value double, passage string")
        .distinct()
    )
