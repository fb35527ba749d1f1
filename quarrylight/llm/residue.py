"""Template residue, filler, error pages and demands for scripts in place of text.

Sentences of collected pages get weak labels from response status phrases and
placeholder syntax; a linear classifier with L2 penalty over hashed character and
word n-grams, length and title features learns from them on a bounded sample of
pages (``MAX_PAGES``, by hash of the id) and scores every sentence of every page.
A second one tells demands for scripts from the rest.  High probabilities decide
alone, also beside a story; lower ones are confirmed by exact forms.  It is
validated on hosts that it never saw (``validation``).  A page is found when a sentence is residue; a demand for scripts or a wait-here notice counts only
where the page holds no story beside it.

Defined results: null and blank texts are never found; a repeated ``article_id``
counts once; without weak labels of both kinds nothing is found but what the weak
labels say; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample of pages for fitting.
MAX_PAGES = 6_000
BITS = 17
L2, STEPS, RATE = 1e-4, 150, 0.5

_I = re.IGNORECASE
#: Weak labels, fixed values: what template engines, forms and servers leave behind.
_PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|[$#]\{[\w.]+\}|<%.*?%>|%%?[A-Z][A-Z_]{3,}%%?|\[\[[\w ]+\]\]|(?<![\w\"“'])\{[a-z]+_[a-z_]+\}|\[(?:INSERT|ADD|PASTE)\b[^\]]*\]|<TK\b|\bTKTK\b|\bTODO\b|\bXX,XXX\b"
    r"|\[object Object\]|\bundefined undefined\b|\bNaN (?:days|hours|minutes)\b|^(?:null|undefined|None|nan)$"
)
_FILLER = re.compile(
    r"lorem ipsum|\bipsum dolor|\b(?:text|headline|caption|story|title) (?:goes|will go|will follow) here\b|\binsert (?:pull )?quote\b|\bsample paragraph\b|\breplace it with your own\b"
    r"|\b(?:blah ){2}|\basdf asdf\b|^x{3,}(?: x+)+$|hier steht ihr text|texte de l'article à venir|aquí va el texto|texto de relleno|此处填写正文|ここに本文|यहाँ पाठ|النص هنا",
    _I,
)
_ERROR = re.compile(
    r"^\W*(?:http/[\d.]+ |error:? )?\(?[45]\d\d\)?(?:\W|$)|^\W*error:|\bbad gateway\b|\bservice (?:temporarily )?unavailable\b|\binternal server error\b|\b(?:403 )?forbidden\b|\bnot be found on this server\b"
    r"|\bdon't have permission to view\b|\bsomething went wrong on our end\b|\bcan't seem to find what you are looking for\b|\bhas been removed or is no longer available\b|\btoo many requests from\b|\baccess denied\b"
    r"|\bblocked by our security service\b|^traceback \(most recent|^warning: undefined|syntaxerror: |\bupstream timed out\b|^origin unreachable|\bno route to article\b"
    r"|página no encontrada|page est introuvable|seite (?:wurde )?nicht gefunden|页面(?:不存在|未找到|无法)|ページが見つかりません|पृष्ठ नहीं मिला|الصفحة غير موجودة|не найдена",
    _I,
)
_SCRIPTS = re.compile(
    r"\b(?:javascript|scripts?)\b.*\b(?:enabled?|required?|turn(?:ed)? (?:it )?on|activ\w+|allowed)\b|\b(?:enable|requires?|activ\w+|aktivieren\w*|habilit\w+|activez)\b.*\bjavascript\b|checking your browser|verify that you are a human|scripts and cookies must|\bturn it on in your browser\b|\breload the page\b"
    r"|启用 ?javascript|javascript ?を有効|जावास्क्रिप्ट चालू|تفعيل جافاسكريبت|bitte aktivieren sie javascript",
    _I,
)
#: Weak labels of ordinary text: notices beside a story, and reports or quotations of messages.
_ORDINARY = re.compile(r"\bcomments\b|\bbest viewed\b|\b(?:officials|dean|spokesperson|lawmakers|students|staff|library|bureau|office) (?:said|told|later|blamed|shows?)\b|an error that|error logs|met a page-not-found|report an error", _I)

_SENTENCE = re.compile(r"(?<=[.!?])[\"”»]?\s+|(?<=[。！？।])")
_DIGITS = re.compile(r"\d[\d,.]*")
_CASELESS = re.compile("[؀-ۿऀ-ॿ぀-ヿ㐀-鿿]")


def sentences(text: str | None) -> list[str]:
    if not text:
        return []
    return [s for line in text.split("\n") for part in _SENTENCE.split(line) if (s := part.strip())]


def weak_label(sentence: str) -> int:
    """1 residue or error, 2 demand for scripts, 0 neither."""
    if _ORDINARY.search(sentence):
        return 0
    if _PLACEHOLDER.search(sentence) or _FILLER.search(sentence) or _ERROR.search(sentence):
        return 1
    return 2 if _SCRIPTS.search(sentence) else 0


_NAMES = re.compile(r"(?<=[\w,;:’'\"(–—-] )(?:[A-Z][a-zà-ÿ’'-]+(?: (?=[A-Z][a-z]))?)+")


def shape(sentence: str) -> str:
    """The sentence without what varies between pages: digits, and capitalised words inside it."""
    return _NAMES.sub("Nn", _DIGITS.sub("0", sentence))


#: Probability at which a sentence counts, and that at which it does so without an exact form.
LIKELY, ALONE = 0.5, 0.9
_LETTERS = re.compile(r"[^\W\d_]{2}|[^\x00-\u02ff\W\d_]")


@lru_cache(maxsize=64)
def _title_words(title: str | None) -> frozenset[str]:
    return frozenset((title or "").lower().split())


def title_class(sentence: str, title: str | None) -> tuple[int, bool]:
    """How many words the sentence shares with the title, 4 at most, and whether there is no title."""
    known = _title_words(title)
    return min(len(known.intersection(sentence.lower().split())) if known else 0, 4), not known


#: Multipliers of the five bytes of an n-gram, and the one that mixes the sum (odd 32-bit numbers).
_BYTE, _MIX = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1], np.uint32), np.uint32(0x9E3779B1)


#: Characters of the sentences whose features are worked out together; one sentence may have more.
CHUNK = 200_000

Key = tuple[str, int, bool]  # shape, words shared with the title, whether there is no title


@lru_cache(maxsize=4096)
def _class_features(words: int, shared: int, untitled: bool, end: str, upper: bool) -> tuple[int, ...]:
    names = (f"len{min(words, 40) // 4}", f"title{shared}", f"notitle{untitled}", f"end{end}", f"upper{upper}")
    return tuple(zlib.crc32(k.encode(), 13) & ((1 << BITS) - 1) for k in names)


def features(keys: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """(features, ends): the sets of hashed features of sentences, one behind the other: character 3- to 5-grams, length and title classes."""
    parts, ends, total = [], [], 0
    upto, cuts = 0, [0]
    for i, (s, _, _) in enumerate(keys):
        if upto and upto + len(s) > CHUNK:
            cuts.append(i)
            upto = 0
        upto += len(s) + 1
    for at, end in zip(cuts, [*cuts[1:], len(keys)]):
        some = keys[at:end]
        raws = [f" {s.lower()} ".encode("utf-8", "replace") for s, _, _ in some]
        raw = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        owner = np.repeat(np.arange(len(some), dtype=np.int64) << BITS, [len(r) + 1 for r in raws])
        wide, inside = raw.astype(np.uint32), raw != 0
        codes, sums, whole = [], wide[:-1] * _BYTE[0] + wide[1:] * _BYTE[1], inside[:-1] & inside[1:]
        for n in (3, 4, 5):
            sums, whole = sums[:-1] + wide[n - 1 :] * _BYTE[n - 1], whole[:-1] & inside[n - 1 :]
            grams = ((sums[whole] + np.uint32(n)) * _MIX) >> np.uint32(32 - BITS)
            codes.append(owner[: len(whole)][whole] | grams)
        classes = [_class_features(s.count(" ") + 1, shared, untitled, s[-1:] if not s[-1:].isalnum() else "a", s[:1].isupper()) for s, shared, untitled in some]
        codes.append((np.array(classes, np.int64) | (np.arange(len(some), dtype=np.int64) << BITS)[:, None]).ravel())
        found = np.sort(np.concatenate(codes))
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        parts.append((found & ((1 << BITS) - 1)).astype(np.int32))
        ends.append(np.searchsorted(found, np.arange(1, len(some) + 1, dtype=np.int64) << BITS) + total)
        total += len(found)
    return np.concatenate(parts), np.concatenate(ends)


class Classifier:
    """Logistic regression over sets of hashed features, scaled by the root of their number."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = 0.0

    def fit(self, index: np.ndarray, ends: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Classifier:
        sizes = np.diff(ends, prepend=0)
        scale = 1 / np.sqrt(sizes)
        per = np.repeat(np.arange(len(ends)), sizes)
        # What only one sentence has can't generalise, so it is left out, but for one feature that keeps the sentence's place.
        shared = np.bincount(index, minlength=1 << BITS)[index] > 1
        shared[ends - sizes] = True
        index, per = index[shared], per[shared].astype(np.int32)
        starts = np.searchsorted(per, np.arange(len(ends)))
        w, b = np.zeros(1 << BITS), 0.0
        grown = np.full(1 << BITS, 1e-8)
        total = weights.sum()
        for _ in range(STEPS):
            z = np.add.reduceat(w[index], starts) * scale + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / total
            g = np.bincount(index, (err * scale)[per], 1 << BITS) + L2 * w
            grown += g * g
            w -= RATE * g / np.sqrt(grown)
            b -= RATE * err.sum() * 5
        self.weights, self.bias = w.astype(np.float32), float(b)
        return self

    def probabilities(self, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = np.diff(ends, prepend=0)
        z = np.add.reduceat(self.weights[index], ends - sizes) / np.sqrt(sizes) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def host_part(domain: str | None) -> int:
    return zlib.crc32((domain or "").strip().lower().encode()) % 5


class Model:
    """``affected`` tells affected sentences from ordinary ones, ``demand`` demands for scripts from other affected ones."""

    def __init__(self, keys: list[Key], kinds: np.ndarray, often: np.ndarray) -> None:
        self.affected = _fit(keys, kinds > 0, often)
        of = np.flatnonzero(kinds)
        one = set(kinds[of]) if len(set(kinds[of])) == 1 else None
        self.demand = float(2 in one) if one else _fit([keys[i] for i in of], kinds[of] == 2, often[of])

    def probabilities(self, keys: list[Key]) -> list[tuple[float, bool]]:
        """Probability that each sentence is affected, and whether it then is a demand."""
        index, ends = features(keys)
        p = self.affected.probabilities(index, ends)
        demands = np.full(len(keys), self.demand) if isinstance(self.demand, float) else self.demand.probabilities(index, ends)
        return list(zip(p.tolist(), (demands >= 0.5).tolist()))


def _fit(keys: list[Key], labels: np.ndarray, often: np.ndarray) -> Classifier:
    """Both classes weigh the same."""
    weights = often * np.where(labels, 0.5 / often[labels].sum(), 0.5 / often[~labels].sum())
    return Classifier().fit(*features(keys), labels.astype(float), weights)


def _examples(pages: Iterable[tuple[str, str | None]]) -> Counter:
    """(shape, words shared with the title, untitled, weak label) of the sentences of (text, title) pages, with counts."""
    times: Counter = Counter()
    for text, title in pages:
        for s in sentences(text):
            k = shape(s)
            times[k, *title_class(k, title), weak_label(s)] += 1
    return times


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = _examples(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = [pa.array([k[i] for k in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(got.values(), pa.int64())], ["shape", "shared", "untitled", "label", "n"])


def model_of(examples: Counter) -> Model | None:
    """The classifiers of ``_examples``; a shape is affected by the label of most of its sentences."""
    best: dict[tuple, tuple[int, int]] = {}
    for (*k, label), n in examples.items():
        key = tuple(k)
        best[key] = max(best.get(key, (0, 0)), (n, label))
    order = sorted(best)
    kinds, often = np.array([best[k][1] for k in order], int), np.sqrt([best[k][0] for k in order])
    if len(set(kinds > 0)) < 2:
        return None
    return Model(order, kinds, often)


def train(articles: DataFrame) -> Model | None:
    """Fit on a sample of ``MAX_PAGES`` pages by hash; workers reduce them to distinct shapes, which come to the driver."""
    usable = articles.filter(F.col("article_text").isNotNull() & F.col("article_id").isNotNull())
    # At most MAX_PAGES ids.
    chosen = usable.select(F.xxhash64("article_id").alias("h"), F.col("article_id").alias("chosen")).distinct().orderBy("h", "chosen").limit(MAX_PAGES)
    pages = usable.join(F.broadcast(chosen), F.col("article_id") == F.col("chosen"), "left_semi")
    rows = (
        pages.select("article_text", "title")
        .mapInArrow(_shapes, "shape string, shared int, untitled boolean, label int, n long")
        .groupBy("shape", "shared", "untitled", "label")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return model_of(Counter({(r.shape, r.shared, r.untitled, r.label): r.n for r in rows}))


def is_story(sentence: str) -> bool:
    """A sentence of the length and form of running text."""
    if _CASELESS.search(sentence):
        return len(sentence) >= 14 and sentence[-1:] in "。！？।.؟!"
    return len(sentence) >= 45 and sentence[-1:] in ".!?\"”»" and sentence.count(" ") >= 7


def decide(sentence: str, p: float, demand: bool) -> int:
    """1 residue or error, 2 demand for scripts, 0 neither; p: probability that it is affected, demand: the kind it then is."""
    if p < LIKELY:
        return 0
    if label := weak_label(sentence):
        return label
    if p >= ALONE and _LETTERS.search(sentence) and not _ORDINARY.search(sentence):
        return 2 if demand else 1
    return int(_looks_filled(sentence))


def residue(scored: list[tuple[str, float, bool]]) -> bool:
    """Whether a page is a case, by its sentences with probability and kind, as ``Scorer`` gives them."""
    demands, rest = False, []
    for s, p, demand in scored:
        kind = decide(s, p, demand)
        if kind == 1:
            return True
        if kind:
            demands = True
        else:
            rest.append(s)
    return demands and not any(is_story(s) and not _ORDINARY_NOTICE.search(s) for s in rest)


_ORDINARY_NOTICE = re.compile(r"\bcookies?\b|\bsubscribe from\b|\bfree articles left\b|all rights reserved|\bcomments\b|best viewed|\bsign up for\b", _I)


def _looks_filled(sentence: str) -> bool:
    """Few distinct words for its length, as in filler."""
    words = re.findall(r"\w+", sentence.lower())
    return len(words) >= 8 and len(set(words)) <= 0.75 * len(words)


class Scorer:
    """Scores pages sentence by sentence, and remembers the shapes and title classes it has scored."""

    def __init__(self, model: Model | None) -> None:
        self.model = model
        self.memo: dict[Key, tuple[float, bool]] = {}

    def __call__(self, pages: Iterable[tuple[str | None, str | None]]) -> list[list[tuple[str, float, bool]]]:
        """(sentence, probability, demand) of every sentence of each (text, title)."""
        split = [(sentences(text), title) for text, title in pages]
        if self.model is None:
            return [[(s, float(weak_label(s) > 0), False) for s in found] for found, _ in split]
        keyed = [[(s, (k := shape(s), *title_class(k, title))) for s in found] for found, title in split]
        if len(self.memo) > 100_000:
            self.memo.clear()
        memo = self.memo
        if new := list(dict.fromkeys(k for found in keyed for _, k in found if k not in memo)):
            memo.update(zip(new, self.model.probabilities(new)))
        return [[(s, *memo[k]) for s, k in found] for found in keyed]


def found(articles: DataFrame) -> DataFrame:
    """article_id of pages with residue."""
    var = articles.sparkSession.sparkContext.broadcast(train(articles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(var.value)
        for batch in batches:
            keys, texts, titles = (batch.column(i).to_pylist() for i in range(3))
            bad = [k for k, scored in zip(keys, score(zip(texts, titles))) if residue(scored)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["article_id"])

    rows = articles.filter(F.col("article_text").isNotNull() & F.col("article_id").isNotNull())
    return rows.select("article_id", "article_text", "title").mapInArrow(run, "article_id string").distinct()


def validation(articles: DataFrame) -> DataFrame:
    """Precision and recall of ``decide`` against the weak labels, over all pages of hosts that were held out of fitting (a fifth of them)."""
    held = F.udf(lambda domain: host_part(domain) == 0, "boolean")(F.col("domain"))
    model = train(articles.filter(~held))
    spark = articles.sparkSession
    out = "hosts long, sentences long, positives long, precision double, recall double"
    if model is None:
        return spark.createDataFrame([], out)
    var = spark.sparkContext.broadcast(model)
    names = ["domain", "form", "truth", "guess"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(var.value)
        for batch in batches:
            seen: dict[tuple, tuple[bool, bool]] = {}
            texts, titles, domains = (batch.column(i).to_pylist() for i in range(3))
            for scored, title, domain in zip(score(zip(texts, titles)), titles, domains):
                seen[domain, None] = False, False  # a host without sentences
                for s, p, demand in scored:
                    k = shape(s)
                    shared, untitled = title_class(k, title)
                    key = domain, f"{shared} {untitled} {k}"
                    if key not in seen:
                        seen[key] = weak_label(s) > 0, decide(s, p, demand) > 0
            columns = ([d for d, _ in seen], [k for _, k in seen], [y for y, _ in seen.values()], [g for _, g in seen.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.bool_()) for i, c in enumerate(columns)], names)

    rows = articles.filter(F.col("article_text").isNotNull() & F.col("article_id").isNotNull()).filter(held)
    scored = rows.select("article_text", "title", "domain").mapInArrow(run, "domain string, form string, truth boolean, guess boolean").persist()
    # A form is positive, or found, if it is on any page.
    forms = scored.filter("form is not null").groupBy("form").agg(F.max("truth").alias("truth"), F.max("guess").alias("guess"))
    share = lambda of: F.when(F.count("*") > 0, F.round(F.count_if(F.col("truth") & F.col("guess")) / F.greatest(F.lit(1), F.count_if(of)), 4))
    row = forms.agg(F.count("*").alias("sentences"), F.count_if("truth").alias("positives"), share(F.col("guess")).alias("precision"), share(F.col("truth")).alias("recall"))
    hosts = scored.agg(F.countDistinct(F.coalesce("domain", F.lit(""))).alias("hosts"))
    got = hosts.crossJoin(row).first()
    scored.unpersist()
    return spark.createDataFrame([tuple(got)], out)
