"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and counts of lexicon words (as written, and after undoing letter substitutions and
stretched letters), those near second-person words, capitals, punctuation, obfuscation and length. All are read from
every text, whether it holds lexicon words or not, and fixed and learned terms are undone alike. The lexicon is
learned from the training rows by document frequencies (words and beginnings of words), beside a short fixed list. Trees are grown on histograms with
logistic loss; out-of-fold margins of the training rows fit the calibration.

Training sees a bounded sample of labelled rows (`max_rows`, a hash threshold, so every size is treated alike); all
rows are scored, whole texts, without a shuffle. Scores use the text only: no label, id, language or source.

Defined cases: rows with a null label or id do not train; without both classes in the training rows every score is
the share of toxic training rows (0 without rows); a null text scores like an empty one; repeated rows score alike; an
empty table gives no rows; other columns stay, but for `score` and `predicted`, which are replaced. Texts of any length
are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypath.llm.common import checkpoint, documents, map_texts

MAX_ROWS = 12_000
#: Share of the toxic training rows that a learned term is in, at least; candidates and terms kept, at most.
SUPPORT = 0.02
MAX_TERMS = 50_000
MAX_WORDS = 300
CUT = 0.3
SEED_WORDS = (
    "idiot moron stupid scum loser pathetic trash worthless disgusting clown jerk dumb fool garbage filthy retard bastard bitch asshole "
    "idiota estúpido imbécil basura asqueroso idiote stupide connard ordure imbécile dégoûtant dumm dummkopf trottel arschloch abschaum ekelhaft"
).split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti".split())

_WORD = re.compile(r"[^\W_]+")
_EDGES = ".,;:!?()[]{}\"'«»¿¡…|-–—"
_LEET = str.maketrans("013457@$!", "oieastasi", "*.-_")
_STRETCHED = re.compile(r"(.)\1{2,}")
_TRIPLES = tuple(3 * c for c in "abcdefghijklmnopqrstuvwxyz")
_TRIPLE_BEYOND = re.compile(r"([^\x00-\x7F])\1\1")
_BEYOND = re.compile(r"[^\x00-\x7F]+")
_CAPITALS = bytes(range(65, 91))
FEATURES = 14


def normalised(word: str) -> set[str]:
    """The word without letter substitutions, its stretched letters once or twice."""
    plain = word.lower().translate(_LEET)
    return {_STRETCHED.sub(r"\1", plain), _STRETCHED.sub(r"\1\1", plain)}


def capitals(text: str) -> int:
    """Number of upper-case characters."""
    raw = text.encode("utf-8", "replace")
    n = len(raw) - len(raw.translate(None, _CAPITALS))
    return n if text.isascii() else n + sum(map(str.isupper, "".join(_BEYOND.findall(text))))


def automaton(fixed: Iterable[str], learned: Iterable[str]) -> ahocorasick.Automaton:
    """Finds the fixed words and the learned terms (words, or beginnings of words where a star ends them)."""
    found = ahocorasick.Automaton()
    for words, kind in ((learned, 1), (fixed, 0)):
        for w in words:
            pattern = f" {w[:-1]}" if w.endswith("*") else f" {w} "
            found.add_word(pattern, (len(pattern), kind))
    found.make_automaton()
    return found


def disguised_form(token: str, lexicon: ahocorasick.Automaton) -> str | None:
    """The form of the token, its disguise undone, that is a term of the lexicon or begins with one."""
    return min((v for v in normalised(token) if next(lexicon.iter(f" {v} "), None)), default=None)


def stretched(low: str) -> bool:
    """Whether a character that may be a letter comes three times in a row."""
    return any(map(low.__contains__, _TRIPLES)) or not low.isascii() and _TRIPLE_BEYOND.search(low) is not None


def undone_words(low: str, lexicon: ahocorasick.Automaton, hits: set[int]) -> list[tuple[int, str]]:
    """Place (number of words before it) and form of each disguised word; hits are the places of words that count as written."""
    found: list[tuple[int, str]] = []
    place = 0
    for token in low.split():
        words = _WORD.findall(token)
        whole = None
        if hits.isdisjoint(range(place, place + len(words))) and not (x := token.strip(_EDGES)).isalpha() and x and not x.isdecimal():
            whole = disguised_form(x, lexicon)
        if whole:
            found.append((place, whole))
        else:
            found += [(i, v) for i, w in enumerate(words, place) if i not in hits and _STRETCHED.search(w) and (v := disguised_form(w, lexicon))]
        place += len(words)
    return found


def features(text: str | None, lexicon: ahocorasick.Automaton) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    low = text.lower()
    words = _WORD.findall(low)
    m = max(1, len(words))
    joined = f" {' '.join(words)} "
    at: tuple[set, set] = (set(), set())
    seen = place = 0
    for end, (size, kind) in lexicon.iter(joined):
        start = end - size + 1
        if start >= place:
            seen += joined.count(" ", place, start)
            place = start
            at[kind].add(seen)
        else:
            at[kind].add(seen - joined.count(" ", start, place))
    hits = at[0] | at[1]
    # words with digits or signs between their letters, and with a letter three times in a row
    disguised = [x for t in low.split() if not (x := t.strip(_EDGES)).isalpha() and x and not x.isdecimal()]
    undone = undone_words(low, lexicon, hits) if stretched(low) or any(disguised_form(x, lexicon) for x in disguised) else []
    places = [*hits, *(i for i, _ in undone)]
    near = sum(1 for i in places if not SECOND_PERSON.isdisjoint(words[max(0, i - 5) : i + 6]))
    return [
        len(places) / m, float(len(places)), len(at[0]) / m, len(at[1]) / m, float(len({words[i] for i in hits} | {v for _, v in undone})),
        float(near), near / m, capitals(text) / n, text.count("!") / n, (text.count("?") + text.count(".") + text.count(",")) / n,
        len(disguised) / m, float(len(undone)), float(np.log1p(m)), sum(map(len, words)) / m,
    ]


@dataclass
class Boosted:
    """Trees as arrays: node k splits on feature[k] at threshold[k]; children 2k+1, 2k+2; leaves hold values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
            out += value[k - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Boosted:
    """Histogram gradient boosting with logistic loss."""
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q) + 1e-12
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, n * (bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(key, h, n * (bins + 1)).reshape(n, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = j
                threshold[first : first + n][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return Boosted(base, trees, depth)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    edge = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.flatnonzero(edge)
    w = np.diff(np.append(at, len(s))).astype(float)
    v = np.add.reduceat(v, at) / w
    blocks: list[list[float]] = []  # value, weight, first, last
    for i, (a, b) in enumerate(zip(v, w)):
        blocks.append([a, b, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            x = blocks.pop()
            z = blocks[-1]
            z[0] = (z[0] * z[1] + x[0] * x[1]) / (z[1] + x[1])
            z[1] += x[1]
            z[3] = x[3]
    knots = [(s[at[int(k)]], b[0]) for b in blocks for k in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([p for _, p in knots])


@dataclass
class Model:
    fixed: frozenset
    learned: tuple[str, ...]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, texts: list, lexicon: ahocorasick.Automaton) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, lexicon) for t in texts]).reshape(-1, FEATURES)
        margin = self.trees.margin(x)
        # the margin breaks ties between texts of one calibrated step
        return np.clip(0.998 * np.interp(margin, *self.knots) + 0.002 / (1 + np.exp(-margin)), 0, 1)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, text, label) of about max_rows labelled rows at most that are not held out."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    n = marked.count()
    share = min(1.0, max_rows / max(1, n))
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["id", "label"])
    # bounded by max_rows (and repeated labels of one id), so it may be sent to all executors
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def terms(text: str | None) -> set[str]:
    """A text's words, and their beginnings of 4 to 8 letters, marked by a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in range(4, min(9, len(w)))}


def learned_words(rows: DataFrame, support: float = SUPPORT, max_terms: int = MAX_TERMS, max_words: int = MAX_WORDS) -> list[str]:
    """Terms in a share `support` of the toxic rows or more, and at least eight times as frequent there as in the others.

    Toxic rows name the candidates (max_terms most frequent at most); the other rows count these only, per task first.
    """
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return []

    def counts(label: int, wanted: frozenset | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    found.update(terms(t) if wanted is None else terms(t) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        return rows.where(F.col("label") == label).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    often = counts(1, None).where(F.col("n") >= max(3, support * bad)).orderBy(F.desc("n"), "term").limit(max_terms)
    bad_n = {r.term: r.n for r in often.collect()}
    good_n = {r.term: r.n for r in counts(0, frozenset(bad_n)).collect()}
    ratio = {t: ((n + 0.5) / (bad + 1)) / ((good_n.get(t, 0) + 0.5) / (good + 1)) for t, n in bad_n.items()}
    return sorted((t for t in ratio if ratio[t] >= 8), key=lambda t: (-ratio[t], t))[:max_words]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, folds: int = 3) -> Model:
    rows = checkpoint(training_rows(docs, labels, id_col, text_col, label_col, max_rows))  # bounded, and read five times
    fixed = frozenset(SEED_WORDS)
    learned = tuple(learned_words(rows))

    def make():
        lexicon = automaton(fixed, learned)
        return lambda ts: [[features(t, lexicon) for t in ts]]

    made = map_texts(rows, "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], make, ["label", "id"])
    data = made.toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = data["label"].to_numpy().astype(float)
    x = np.array(data["x"].to_pylist(), dtype=float).reshape(-1, FEATURES)
    prior = float(y.mean()) if len(y) else 0.0
    if min(y.sum(), len(y) - y.sum()) < folds:
        return Model(fixed, learned, None, (np.zeros(1), np.zeros(1)), prior)
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        out[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(fixed, learned, boost(x, y), isotonic(out, y), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        lexicon = automaton(shared.value.fixed, shared.value.learned)

        def f(texts: list) -> list[list]:
            s = shared.value.scores(texts, lexicon)
            return [s.tolist(), (s >= CUT).astype(int).tolist()]

        return f

    return map_texts(docs, text_col, fields, make, keep)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "score", "predicted")
