"""Personal data: patterns, and a skip-chain conditional random field.

``base_spans`` finds what the patterns for e-mail, IP, card and phone numbers match. The field then labels
tokens (white-space separated, holding a digit or an ``@``) as one of these kinds or none. Its potentials:
features of the token's form, edges between neighbouring tokens, and skip edges between distant tokens of
a document that are alike: equal, with the same digits, or in runs of digit tokens that end in the same seven
digits (a number repeated in other groups, or without its prefix). A token is linked to the last one alike and to
the first. Loopy sum-product message passing goes on until the messages settle, so that evidence reaches every
repetition. The patterns' own finds are never taken away; what the field adds are runs of neighbouring tokens that
the patterns leave out and that it gives one kind, one of them with probability ``SURE`` or more, if the run is

* alike to a base span of its document (the same core, the same digits, seven or more, of the span or of a token
  in it, or the last seven and more of its digits), or
* by itself what that kind can be: a phone number of 9 to 15 digits in groups, a card number of 12 to 19 digits
  that passes Luhn's test, an address of four numbers to 255, an e-mail address with a dot after its sign.

Learning: a bounded sample of documents (``TRAIN_DOCS``, the smallest hashes of doc_id among those with a
digit or an ``@``), whose base spans are the labels. Only counts of forms come to the driver.

Edge cases: a null text is empty; no spans give the hash of the empty string and an empty string; spans
are in code points; kinds may overlap each other, one kind never itself; repeated rows give repeated
results; without training documents nothing is added; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.session import table

KINDS = ("email", "ip", "card", "phone")
#: Pairs of alike tokens assumed before any are counted, and the share of them with one label.
ALIKE, SAME = 10.0, 0.8
TRAIN_DOCS, SURE = 2000, 0.9
#: Messages have settled when none changes by more; a graph that goes round and round is left after so many rounds.
SETTLED, ROUNDS = 1e-4, 1000
#: Digits by which two runs are alike.
ALIKE_DIGITS = 7
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A run of digits that fails from its start fails from any of its digits: later starts need no look.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")
#: Tried at the first character of a token only, and without going back: linear in the longest of texts.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; leftmost and non-overlapping for each kind."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = at + 1  # what stands before this sign can't be part of a later match
        at = text.find("@", at + 1 if not m else free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def form(token: str, before: bool) -> tuple[str, ...]:
    """Indicator features of a token's form."""
    digits = _NOT_DIGIT.sub("", token)
    letters = sum(c.isalpha() for c in token)
    parts = token.strip("()[]<>,;:!?\"'").split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
    at = token.find("@")
    out = [
        "1",
        f"d{min(len(digits), 20)}",
        f"l{min(letters, 4)}",
        f"dots{min(token.count('.'), 4)}",
        f"hyphens{min(token.count('-'), 4)}",
        f"quad{quad and all(int(p) <= 255 for p in parts)}",
        f"plus{token.startswith('+')}",
        f"paren{'(' in token}{')' in token}",
        f"at{at > 0}{'.' in token[at:] if at >= 0 else ''}",
        f"luhn{12 <= len(digits) <= 19 and letters == 0 and luhn(digits)}",
        f"before{before}",
    ]
    return (*out, f"{out[1]}{out[2]}", f"{out[1]}{out[4]}")


def core(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}<>*#&$%|").lower()


_MARKS = ".,;:!?\"'[]{}<>*#&$%|"
_DIGITS_ONLY = re.compile(r"[^\W\d_]")


class Graph:
    """Candidate tokens of some texts, with chain and skip edges. A run is a number of neighbouring tokens without
    letters, as (first token, last token, digits without leading zeros)."""

    def __init__(self, texts: list[str]):
        self.spans, self.doc, self.forms, self.label, self.base = [], [], [], [], []
        self.chain, self.skip, self.near, self.runs = [], [], [], []
        for d, text in enumerate(texts):
            base = base_spans(text)
            self.base.append(base)
            last, seen, first = None, {}, len(self.spans)
            for m in _TOKEN.finditer(text) if _DIGIT.search(text) or "@" in text else ():
                t, a, b = m[0], m.start(), m.end()
                k, near = len(self.spans), last is not None and a - last <= 1
                if near:
                    self.chain.append((k - 1, k))
                c, digits = core(t), _NOT_DIGIT.sub("", t)
                self._link(k, {c, digits if len(digits) >= ALIKE_DIGITS else c}, seen)
                self.spans.append((a, b))
                self.doc.append(d)
                self.near.append(near)
                self.forms.append(form(t, near))
                self.label.append(next((kind + 1 for s, kind, e in base if s < b and e > a), 0) if base else 0)
                last = b
            self._runs(text, first, seen)

    def _link(self, k: int, keys: set, seen: dict) -> None:
        """Skip edges to the last and the first token of each key, if there are any but the neighbour."""
        self.skip += [(j, k) for j in sorted({j for key in keys if key in seen for j in seen[key]} - {k})]
        for key in keys:
            seen[key] = (seen[key][0] if key in seen else k, k)

    def _runs(self, text: str, first: int, seen: dict) -> None:
        k = first
        while k < len(self.spans):
            end = k + 1
            if not _DIGITS_ONLY.search(text, *self.spans[k]):
                while end < len(self.spans) and self.near[end] and not _DIGITS_ONLY.search(text, *self.spans[end]):
                    end += 1
                digits = _NOT_DIGIT.sub("", text[self.spans[k][0] : self.spans[end - 1][1]]).lstrip("0")
                if len(digits) >= ALIKE_DIGITS:
                    self.runs.append((k, end - 1, digits))
                    for back in range(min(end - k, 4)):  # tokens of alike runs, counted from their ends
                        self._link(end - 1 - back, {(digits[-ALIKE_DIGITS:], back)}, seen)
            k = end


class SkipChain:
    """Weights of the field and its inference."""

    def __init__(self, weights: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip
        self.none = np.zeros(len(KINDS) + 1)
        self.known: dict = {}

    @classmethod
    def fit(cls, forms: Counter, chain: np.ndarray, skip: np.ndarray) -> SkipChain:
        """forms counts (features, label); chain and skip count pairs of labels."""
        labels = len(KINDS) + 1
        names = sorted({f for fs, _ in forms for f in fs})
        at = {f: i for i, f in enumerate(names)}
        rows = sorted(forms.items())
        x = np.zeros((len(rows), len(names)))
        for r, ((fs, _), _) in enumerate(rows):
            x[r, [at[f] for f in fs]] = 1
        y, n = np.array([k for (_, k), _ in rows], int), np.array([c for _, c in rows], float)
        w = np.zeros((len(names), labels))
        for _ in range(400):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            w -= 2.0 * (x.T @ (p * n[:, None]) / max(n.sum(), 1) + 1e-4 * w)

        def agreement(c):
            c = (c + c.T) / 2 + 0.5
            return np.log(c * c.sum() / c.sum(axis=1, keepdims=True) / c.sum(axis=0, keepdims=True)).clip(-3, 3)

        # skip edges: how much likelier two labels are together than the labels of any two tokens
        prior = np.bincount(y, n, labels) + 1.0
        prior /= prior.sum()
        apart = np.outer(prior, prior)
        c = (skip + skip.T) / 2 + ALIKE * (SAME * np.diag(prior) + (1 - SAME) * apart)
        return cls({f: w[i] for f, i in at.items()}, agreement(chain), np.log(c / c.sum() / apart).clip(-3, 3))

    def unary(self, fs: tuple) -> np.ndarray:
        u = self.known.get(fs)
        if u is None:
            if len(self.known) > 100_000:
                self.known.clear()
            u = sum((self.weights.get(f, self.none) for f in fs), self.none)
            u = self.known[fs] = u - np.logaddexp.reduce(u)
        return u

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs of every token's labels, by loopy message passing."""
        u = np.array([self.unary(f) for f in g.forms]).reshape(-1, len(KINDS) + 1)
        edges = np.array(g.chain + g.skip, int).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
        messages = np.zeros((len(src), u.shape[1]))
        belief = u.copy()
        for _ in range(ROUNDS if len(src) else 0):
            out = np.logaddexp.reduce((belief[src] - messages[back])[:, :, None] + pair, axis=1)
            new = 0.5 * messages + 0.5 * (out - np.logaddexp.reduce(out, axis=1)[:, None])
            moved, messages = np.abs(new - messages).max(), new
            belief = u.copy()
            np.add.at(belief, dst, messages)
            if moved <= SETTLED:
                break
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None]) if len(u) else u

    def added(self, texts: list[str]) -> tuple[list[list], list[list]]:
        """Base spans, and all spans, of each text."""
        g = Graph(texts)
        every = [list(b) for b in g.base]
        if not g.spans:
            return g.base, every
        p = self.marginals(g)
        kinds, sure = np.where(np.array(g.label) == 0, p.argmax(axis=1), 0), p.max(axis=1) >= SURE
        known: dict = {}  # document -> cores, digits, and last digits of base spans and of tokens in them
        for k, last, digits in g.runs:  # a run of digit tokens is one candidate, whatever its groups
            own = slice(k, last + 1)
            if last == k or any(g.label[own]) or not (kinds[own].astype(bool) & sure[own]).any():
                continue
            d, kind = g.doc[k], int(p[own, 1:].mean(axis=0).argmax()) + 1
            if d not in known:
                known[d] = self._known(g, texts[d], d)
            likely = p[own, kind].mean() >= 0.5 and (p[own, kind] >= SURE).any()
            span = (g.spans[k][0], kind - 1, g.spans[last][1]) if self._repeats(digits, known[d]) else self._span(texts[d], g, k, last, kind, known[d]) if likely else None
            if span:
                every[d].append(span)
                kinds[own] = 0
        k = 0
        while k < len(g.spans):
            kind, end = int(kinds[k]), k + 1
            if kind:
                d = g.doc[k]
                while end < len(g.spans) and g.near[end] and kinds[end] == kind:
                    end += 1
                if d not in known:
                    known[d] = self._known(g, texts[d], d)
                whole = self._span(texts[d], g, k, end - 1, kind, known[d]) if sure[k:end].any() else None
                every[d] += [whole] if whole else [x for j in range(k, end) if sure[j] and (x := self._span(texts[d], g, j, j, kind, known[d]))]
            k = end
        return g.base, [sorted(x) for x in every]

    @staticmethod
    def _known(g: Graph, text: str, d: int) -> tuple[set, set, set]:
        base = g.base[d]
        digits = {x for s, _, e in base if len(x := _NOT_DIGIT.sub("", text[s:e])) >= ALIKE_DIGITS}
        low = bisect_left(g.doc, d)
        for j in range(low, bisect_right(g.doc, d)):
            if g.label[j] and len(x := _NOT_DIGIT.sub("", text[slice(*g.spans[j])])) >= ALIKE_DIGITS:
                digits.add(x)
        return {core(text[s:e]) for s, _, e in base}, digits, {x[-ALIKE_DIGITS:] for x in digits}

    @staticmethod
    def _repeats(digits: str, known: tuple[set, set, set]) -> bool:
        """Whether digits, without leading zeros, end a known number, or the other way round."""
        _, numbers, ends = known
        return len(digits) >= ALIKE_DIGITS and digits[-ALIKE_DIGITS:] in ends and any(x.endswith(digits) or digits.endswith(x) for x in numbers)

    @staticmethod
    def _span(text: str, g: Graph, first: int, last: int, kind: int, known: tuple[set, set, set]) -> tuple[int, int, int] | None:
        """The run as a span, if it is alike to a base span or can be of the kind by itself."""
        a, b = g.spans[first][0], g.spans[last][1]
        t = text[a:b]
        whole, digits = (a, kind - 1, b), _NOT_DIGIT.sub("", t)
        cores, numbers, _ = known
        if core(t) in cores or digits in numbers:
            return whole
        if SkipChain._repeats(digits.lstrip("0"), known):
            return whole
        low, high = a + len(t) - len(t.lstrip(_MARKS)), b - (len(t) - len(t.rstrip(_MARKS)))
        t = text[low:high]
        letters = _DIGITS_ONLY.search(t)
        fits = (
            "@" in t[1:] and "." in t[t.rindex("@") :] and " " not in t,
            not letters and len(parts := t.split(".")) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts),
            not letters and 12 <= len(digits) <= 19 and luhn(digits),
            not letters and 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", t)) >= 3,
        )[kind - 1]
        return (low, kind - 1, high) if fits else None


def train(docs: DataFrame) -> SkipChain:
    """docs(doc_id, text)."""
    picked = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(TRAIN_DOCS)
    few = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id")  # TRAIN_DOCS ids at most

    def count(batches):
        for batch in batches:
            g = Graph([t or "" for t in batch["text"].to_pylist()])
            out = Counter((" ".join(f), k) for f, k in zip(g.forms, g.label))
            for name, edges in (("\x00chain", g.chain), ("\x00skip", g.skip)):
                out.update((name, g.label[a] * 10 + g.label[b]) for a, b in edges)
            yield pa.record_batch([pa.array([f for f, _ in out], pa.string()), pa.array([k for _, k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["form", "label", "n"])

    rows = few.mapInArrow(count, "form string, label int, n long").groupBy("form", "label").agg(F.sum("n").alias("n")).orderBy("form", "label").collect()  # forms are few: they hold no text
    size = len(KINDS) + 1
    pairs = {"\x00chain": np.zeros((size, size)), "\x00skip": np.zeros((size, size))}
    forms: Counter = Counter()
    for r in rows:
        if r["form"] in pairs:
            pairs[r["form"]][divmod(r["label"], 10)] += r["n"]
        else:
            forms[tuple(r["form"].split(" ")), r["label"]] += r["n"]
    return SkipChain.fit(forms, *pairs.values())


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found(docs: DataFrame, field: SkipChain) -> DataFrame:
    kept = field.weights, field.chain, field.skip
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def rows(batches):
        own = SkipChain(*kept)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                base, every = own.added([t or "" for t in part["text"].to_pylist()])
                kinds = [Counter(k for _, k, _ in b) for b in base]
                yield pa.record_batch([part["doc_id"].cast(pa.int64()), *(pa.array([c[k] for c in kinds], pa.int64()) for k in range(len(KINDS))), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(e) for e in every], pa.string()), pa.array([len(e) - len(b) for b, e in zip(base, every)], pa.int64())], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, field: SkipChain) -> DataFrame:
    """The rows of docs with personal data masked in text; where there is an n_chars column it follows."""
    kept = field.weights, field.chain, field.skip
    names = docs.columns

    def rows(batches):
        own = SkipChain(*kept)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = part["text"].to_pylist()
                _, every = own.added([t or "" for t in texts])
                new = [t if t is None else mask(t, s) for t, s in zip(texts, every)]
                cols = {n: part.column(i) for i, n in enumerate(names)}
                cols["text"] = pa.array(new, cols["text"].type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([n if not s else len(t) for n, s, t in zip(cols["n_chars"].to_pylist(), every, new)], cols["n_chars"].type)
                yield pa.record_batch(list(cols.values()), names=names)

    return docs.mapInArrow(rows, docs.schema)


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return found(docs, train(docs))


QUERIES = {"op7_pii": op7}
