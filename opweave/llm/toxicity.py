"""Toxicity by noisy-channel deobfuscation.

A token is read as a lattice: each of its characters may stand for itself, for letters it resembles, or, for
separators and repetitions, for nothing. Viterbi decoding takes the path that is likeliest under the channel and
a character trigram model of the corpus. A token with one path only needs no decoding; of the others, the token as
it stands and its likeliest path are both scored, and the one with more weight counts. Letters spaced out are one
token; where the first may be a word of its own (a, i), it is tried without as well. Words and character 5-grams
have weights, log odds of toxic against clean documents, and a logistic regression on a document's largest
weights gives its score.

Learning: the character model counts the trigrams of all words of all documents, whether labelled or not; letters
beyond Latin are one class to it, so that its table is bounded by its alphabet. Weights and regression are fitted
on labelled documents, at most about ``TRAIN_DOCS`` of them (a bounded sample, the smallest hashes of doc_id), one
half for the weights, one for the regression; the lexicon keeps every entry that the sample supports.
Labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null or empty text has no words and gets the score of a text without toxic words; a token of any
length is decoded whole; a doc_id with several labels counts as toxic if one says so; labels that are null or
whose document is missing are left out; without any label of a kind, every score is that kind's prior; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.session import table

TRAIN_DOCS, GRAM = 20_000, 5
#: Lexicon entries: met in this many toxic documents at least, and in this ratio.
LEAST, RATIO = 3, 4.0
#: Letters that a character may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
GAPS = set(".-_*~^'`,:;/\\ ")
_EDGE = ".,;:?\"'#%&*()[]{}<>=~^`-_/\\|!$+"
#: Tokens whose lattice has more than one path that can matter: they hold a letter, and a look-alike, a gap
#: between letters, or a letter twice.
_LETTER = re.compile(r"[^\W\d_]")
_SEVERAL = re.compile(r"[\d@$!|+(€£¡]|[^\W\d_][.\-_*~^'`,:;/\\]+[^\W\d_]|([^\W\d_])\1")
#: Log10 probabilities of the channel: a look-alike, a dropped gap or repetition.
LOOK_COST, DROP_COST = -0.4, -0.2
#: Letters below this code point count one by one in the character model, all others as one.
LATIN, OTHER = 0x250, "\uffff"
#: Tokens whose readings a worker keeps, and characters between two looks at what all paths share.
KEPT, SHARED_EVERY = 300_000, 64


def _letter(c: str) -> str:
    return c if ord(c) < LATIN else OTHER


def trigrams(words: dict[str, int], into: Counter) -> Counter:
    """Adds the character trigrams of counted words, which hold letters alone; ``^`` begins and ``$`` ends a word.
    Words with a letter three times are left out."""
    if not words:
        return into
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = "^^" + "$^^".join(words) + "$"
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), LATIN).astype(np.int64)
    at = np.flatnonzero(c != ord("^"))  # a letter or an end
    u, back = np.unique((c[at - 2] * (LATIN + 1) + c[at - 1]) * (LATIN + 1) + c[at], return_inverse=True)
    counts = np.fromiter(words.values(), np.int64, len(words))
    triple = np.flatnonzero((c[2:] == c[1:-1]) & (c[2:] == c[:-2]))
    counts[np.repeat(np.arange(len(words)), sizes + 3)[triple]] = 0
    weight = np.repeat(counts, sizes + 1)
    sums = np.bincount(back, weight).astype(np.int64)
    name = lambda k: chr(k) if k < LATIN else OTHER
    for k, n in zip(u[sums > 0].tolist(), sums[sums > 0].tolist()):
        k, z = divmod(k, LATIN + 1)
        x, y = divmod(k, LATIN + 1)
        into[name(x) + name(y) + name(z)] += n
    return into


class CharModel:
    """Character trigrams with backed-off additive smoothing, in log10."""

    def __init__(self, tri: dict[str, int]):
        bi, uni = Counter(), Counter()
        for t, n in tri.items():
            bi[t[:2]] += n
            uni[t[2]] += n
        self.tri, self.bi, self.uni, self.all = dict(tri), dict(bi), dict(uni), sum(uni.values()) + 1
        self.known: dict[str, float] = {}

    def __call__(self, three: str) -> float:
        p = self.known.get(three)
        if p is None:
            t = "".join(map(_letter, three))
            u = (self.uni.get(t[2], 0) + 1) / (self.all + 200)
            p = math.log10((self.tri.get(t, 0) + 2 * u) / (self.bi.get(t[:2], 0) + 2))
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[three] = p
        return p


def decoded(token: str, model: CharModel) -> tuple[float, str]:
    """The log10 probability and the word of the token's likeliest path."""
    states = {("^^", ""): (0.0, "")}  # last two letters and last character read -> score, word
    done: list[str] = []  # what every path begins with
    known = model.known.get
    for k, c in enumerate(token):
        nxt: dict = {}
        looks, gap = LOOKS.get(c, ""), c in GAPS
        for (two, last), (score, word) in states.items():
            p = known(two + c)
            state, new = (two[1] + c, c), score + (model(two + c) if p is None else p)
            if state not in nxt or new > nxt[state][0]:
                nxt[state] = (new, word + c)
            for letter in looks:
                state, new = (two[1] + letter, c), score + LOOK_COST + model(two + letter)
                if state not in nxt or new > nxt[state][0]:
                    nxt[state] = (new, word + letter)
            if gap or c == last:
                state, new = (two, c), score + DROP_COST
                if state not in nxt or new > nxt[state][0]:
                    nxt[state] = (new, word)
        states = nxt
        if k % SHARED_EVERY == SHARED_EVERY - 1 and (n := len(commonprefix([w for _, w in states.values()]))):
            done.append(next(iter(states.values()))[1][:n])
            states = {s: (x, w[n:]) for s, (x, w) in states.items()}
    score, word = max((s + model(two + "$"), w) for (two, _), (s, w) in states.items())
    return score, "".join([*done, word])


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a token."""
    return decoded(token, model)[1]


def readings(token: str, model: CharModel) -> tuple[str, ...]:
    """A token's words: as it stands, without the marks at its ends, and its likeliest path if there are several."""
    w = token.strip(_EDGE)
    if _LETTER.search(token) and _SEVERAL.search(token):
        other = decode(token.strip(" ,.;:?\"'()[]{}"), model).strip(_EDGE)
        return tuple(dict.fromkeys(x for x in (w, other) if x))
    return (w,) if w else ()


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, and runs of three and more letters apart as tokens of their own."""
    every = text.lower().split()
    out = set(every)
    single = {t: w for t in out if len(w := t.strip(_EDGE) or t) == 1}
    if single:
        for ok, run in groupby(every, single.__contains__):
            if ok and len(word := "".join(single[t] for t in run)) >= 3:
                out.add(word)
                if word[0] in "ai" and len(word) > 3:
                    out.add(word[1:])
    return out


def restored(text: str, model: CharModel, cache: dict) -> set[str]:
    """All readings of a text's tokens; cache holds those of tokens met before."""
    words: set[str] = set()
    for t in tokens(text):
        got = cache.get(t)
        if got is None:
            if len(cache) > KEPT:
                cache.clear()
            got = cache[t] = readings(t, model)
        words.update(got)
    return words


def grams(word: str) -> set[str]:
    """A word, marked as whole, and its character 5-grams."""
    return {f"={word}", *(word[i : i + GRAM] for i in range(len(word) - GRAM + 1))}


class Scorer:
    def __init__(self, weights: dict[str, float], model: CharModel, beta: np.ndarray):
        self.weights, self.model, self.beta, self.best = weights, model, beta, {}

    def _weighed(self, token: str) -> tuple[float, str]:
        """The largest weight of a token's readings, by the grams of each, and the reading."""
        get, best = self.weights.get, (0.0, "")
        for w in readings(token, self.model):
            x = get("=" + w, 0.0)
            for i in range(len(w) - GRAM + 1):
                if (y := get(w[i : i + GRAM])) is not None and y > x:
                    x = y
            if x > best[0]:
                best = (x, w)
        return best

    def features(self, text: str) -> tuple[float, ...]:
        """Intercept; largest and second largest weight of a word; how many words have weight, damped."""
        found: dict[str, float] = {}
        for t in tokens(text):
            x = self.best.get(t)
            if x is None:
                if len(self.best) > KEPT:
                    self.best.clear()
                x = self.best[t] = self._weighed(t)
            if x[0]:
                found[x[1]] = x[0]
        top = sorted(found.values(), reverse=True)
        return 1.0, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, math.log1p(sum(x > 5 for x in top))

    def __call__(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(self.beta, self.features(text)))))))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Newton steps for a regression on a few features."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        g = x.T @ (p - y) / len(y) + decay * beta
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(x.shape[1])
        beta -= np.linalg.solve(h, g)
    return beta


def corpus_trigrams(docs: DataFrame) -> dict[str, int]:
    """Character trigrams of the words of all docs(text), counted in each task first; words in disguise (with
    other signs than letters, or a letter three times) are left out."""

    def count(batches):
        words, out = Counter(), Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                words.update((text or "").lower().split())
                if len(words) > KEPT:
                    fold(words, out)
        fold(words, out)
        yield pa.record_batch([pa.array(out, pa.string()), pa.array(out.values(), pa.int64())], ["g", "n"])

    def fold(words: Counter, out: Counter) -> None:
        plain: dict[str, int] = {}
        for t, n in words.items():
            if (w := t.strip(_EDGE)).isalpha():
                plain[w] = plain.get(w, 0) + n
        trigrams(plain, out)
        words.clear()

    rows = docs.select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # bounded by the alphabet
    return {r["g"]: r["n"] for r in sorted(rows)}


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs(doc_id, text) and labels(doc_id, toxic)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = marks.orderBy(order, "doc_id").limit(TRAIN_DOCS).withColumn("half", F.pmod(order, F.lit(2)))
    rows = picked.collect()  # TRAIN_DOCS at most
    spark = docs.sparkSession
    small = spark.createDataFrame([(r["doc_id"], r["toxic"], r["half"]) for r in rows], "doc_id long, toxic int, half long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id")

    def count(batches):
        sides, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                own = {t.strip(_EDGE) for t in (text or "").lower().split()}
                n[toxic] += 1
                sides[toxic].update({g for w in own if w for g in grams(w)})
        out = [("g", g, sides[1][g], sides[0][g]) for g in {*sides[0], *sides[1]}] + [("n", "", n[1], n[0])]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "g", "t", "c"])

    counted = texts.where("half = 0").select("text", "toxic").mapInArrow(count, "kind string, g string, t long, c long").groupBy("kind", "g").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = counted.where(f"(kind = 'g' and t >= {LEAST}) or kind = 'n'").persist()
    total = kept.where("kind = 'n'").first()
    nt, nc = (total["t"], total["c"]) if total else (0, 0)
    odds = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    lexicon = kept.where("kind = 'g'").withColumn("w", odds).where(F.col("w") >= math.log(RATIO))  # of the sample, so bounded with it
    weights = {r["g"]: r["w"] for r in lexicon.select("g", "w").collect()} if nt and nc else {}
    kept.unpersist()
    model = CharModel(corpus_trigrams(docs))
    blank = Scorer(weights, model, np.zeros(4))

    def featured(batches):
        for batch in batches:
            x = [blank.features(t or "") for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["toxic"], pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = texts.where("half = 1").select("text", "toxic").mapInArrow(featured, "toxic int, x array<double>").collect()  # four numbers for each of TRAIN_DOCS at most
    y = np.array([r["toxic"] for r in got], float)
    x = np.array([r["x"] for r in got], float).reshape(len(got), 4)
    order = np.lexsort((*x.T, y))
    return Scorer(weights, model, logistic(x[order], y[order]) if len(y) and 0 < y.mean() < 1 else np.array([4.0 if len(y) and y.mean() == 1 else -4.0, 0, 0, 0]))


def scored(docs: DataFrame, scorer: Scorer, name: str = "toxic_score") -> DataFrame:
    """Every column of docs, and the score under a name that docs doesn't have."""
    names = docs.columns
    at = names.index("text")
    kept = scorer.weights, scorer.model.tri, scorer.beta

    def score(batches):
        own = Scorer(kept[0], CharModel(kept[1]), kept[2])
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([own(t or "") for t in batch.column(at).to_pylist()], pa.float64())], names=[*names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op4(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = train(docs.select("doc_id", "text"), labels.where(~held))
    with_text = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    s = F.col("toxic_score")
    return scored(with_text, scorer).select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4}
