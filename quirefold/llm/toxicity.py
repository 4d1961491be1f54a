"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel compares words by the three- and four-letter subsequences they share,
each occurrence weighing DECAY to the power of the stretch it covers, so a word with
inserted characters or letters spaced apart still shares most of them. With landmarks
z and coefficients a, the decision of a word x,
sum_z a_z k(x, z) + b, is linear in x's subsequence weights, and is folded into one
table of a number per subsequence: scoring looks subsequences up and never touches a
landmark.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import ship_package

DECAY = 0.7
STRETCH = 5
ORDERS = (3, 4)
WIDTH = 24
SHORT = 6
HIT = 0.6
#: Texts of this probability or more are rejected.
REJECT = 0.7
BEGIN, LETTERS = 27, 28
SENTENCE = re.compile(r"[.!?\n]+\s")
#: Letters written one by one ("a b c d") are read as a word too. What is between two letters is taken
#: whole, so that a run of blanks is read once.
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\W_]++(?<=\s)){2,}[^\W\d_](?!\w)")
_OFFSETS = {p: [(0, *c) for c in combinations(range(1, STRETCH), p - 1)] for p in ORDERS}
_WORKER: dict = {}


def _codes() -> np.ndarray:
    """Letter 1 to 26 of each character below U+10000 without its accents, else 0."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for i in range(0x2000):
        base = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if "a" <= base <= "z":
            table[i] = ord(base) - 96
    table[ord("ß")] = ord("s") - 96
    return table


_CODES = _codes()


def _norms() -> np.ndarray:
    """Of a word of n letters without gaps: the kernel with itself if no subsequence repeats."""
    out = np.ones(WIDTH + 2)
    for n in range(WIDTH + 2):
        total = 0.0
        for p in ORDERS:
            for off in _OFFSETS[p]:
                total += max(0, n - off[-1]) * DECAY ** (2 * (off[-1] + 1))
        out[n] = np.sqrt(total) if total else 1.0
    return out


_NORMS = _norms()


def _cut(word: str) -> list[str]:
    """A long word as overlapping stretches of ``WIDTH``, another one as it is."""
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2)]


def _matrix(words: list[str], width: int) -> np.ndarray:
    """One row of letters for each word of at most ``width`` characters, behind a begin mark."""
    out = np.zeros((len(words), width + 1), dtype=np.int32)
    out[:, 0] = BEGIN
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype="<u4")
    codes = _CODES[np.minimum(points, 0xFFFF)]
    lengths = np.array([len(w) for w in words])
    rows = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at + 1] = codes
    return out


def _subsequences(m: np.ndarray, p: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each offset pattern the numbers of the subsequences at all starts, 0 where there is none."""
    n = m.shape[1]
    for off in _OFFSETS[p]:
        width = n - off[-1]
        if width <= 0:
            continue
        code, real = m[:, :width], m[:, :width] > 0
        for o in off[1:]:
            part = m[:, o : o + width]
            code = code * LETTERS + part
            real = real & (part > 0)
        yield np.where(real, code, 0), DECAY ** (off[-1] + 1)


def _sizes(m: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself: what its kernels are divided by.

    Short words, with hardly a subsequence, count as words of SHORT letters at least,
    or any shared one would be a match.
    """
    total = np.zeros(len(m))
    for p in ORDERS:
        keys, weights = [], []
        for code, weight in _subsequences(m, p):
            row, col = np.nonzero(code)
            keys.append(row * LETTERS**p + code[row, col].astype(np.int64))
            weights.append(np.full(len(row), weight))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        if len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total += np.bincount(key[starts] // LETTERS**p, np.add.reduceat(weight[order], starts) ** 2, minlength=len(m))
    return np.maximum(np.sqrt(total), _NORMS[SHORT])


@dataclass
class Model:
    """Tables of a number per subsequence for each order, a bias, and the scale to a probability."""

    tables: dict[int, np.ndarray]
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = 0.0
    plain: frozenset[str] = frozenset()

    def _rows(self, m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(m), dtype=np.float64)
        for p in ORDERS:
            table = self.tables[p]
            n = m.shape[1]
            for off in _OFFSETS[p]:
                width = n - off[-1]
                if width > 0:
                    code = m[:, :width]
                    for o in off[1:]:
                        code = code * LETTERS + m[:, o : o + width]
                    total += table[code].sum(axis=1) * DECAY ** (off[-1] + 1)
        # a word without gaps is no smaller than its letters make it: an exact size only near the margin
        letters = m > 0
        n = letters.sum(axis=1)
        gaps = n < m.shape[1] - np.argmax(letters[:, ::-1], axis=1)
        sizes = _NORMS[np.clip(n, SHORT, WIDTH + 1)]
        near = np.flatnonzero(total / np.where(gaps, _NORMS[SHORT], sizes) + self.bias > -0.5)
        if len(near):
            sizes[near] = _sizes(m[near])
        return total / sizes + self.bias

    def words(self, words: list[str]) -> np.ndarray:
        """Decision of each word; of a long one the largest of its stretches."""
        best = np.full(len(words), -np.inf)
        groups: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            for part in _cut(w):
                width = 8 if len(part) <= 8 else 14 if len(part) <= 14 else WIDTH
                at, parts = groups.setdefault(width, ([], []))
                at.append(i)
                parts.append(part)
        for width, (at, parts) in groups.items():
            for a in range(0, len(parts), 4096):
                np.maximum.at(best, at[a : a + 4096], self._rows(_matrix(parts[a : a + 4096], width)))
        for i in np.flatnonzero(best > -0.5):
            if _bare(words[i]) in self.plain:
                best[i] = -1.0
        return best

    def evidence(self, decisions: list[float]) -> tuple[float, float]:
        """The highest decision of a text's words, within -1 to 1.5, and how often
        decisions are over HIT, as the logarithm of the number in 50 words."""
        top = min(1.5, max(decisions, default=-1.0))
        hits = sum(d > HIT for d in decisions) if top > HIT else 0
        return max(-1.0, top), float(np.log2((hits + 0.5) / (len(decisions) + 30) * 50))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ np.asarray(self.slopes) + self.offset, -30, 30)))


def _bare(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def tokens(text: str) -> list[str]:
    """White-space separated words, and runs of single letters as words of their own."""
    out = text.split()
    for run in SPACED.findall(text):
        out.append("".join(c for c in run if c.isalpha()))
    return out


def _signed_g2(p: int, n: int, P: int, N: int) -> float:
    a, b = p / P, n / N
    if a <= b:
        return 0.0
    q = (p + n) / (P + N)

    def ll(k: int, m: int, r: float) -> float:
        r = min(max(r, 1e-12), 1 - 1e-12)
        return k * np.log(r) + (m - k) * np.log(1 - r)

    return 2 * (ll(p, P, a) + ll(n, N, b) - ll(p, P, q) - ll(n, N, q))


@lru_cache(maxsize=4_000)
def _grams(word: str) -> frozenset[str]:
    plain = "^" + "".join(chr(96 + c) for c in _CODES[[min(ord(x), 0xFFFF) for x in word]] if c)
    return frozenset(plain[i : i + n] for n in (4, 5) for i in range(len(plain) - n + 1))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 2.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows within the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(50):
        on = y * (z @ w) < 1
        zc = z[on] * weight[on, None]
        new = np.linalg.solve(np.diag(ridge) + c * zc.T @ z[on], c * zc.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if _ > 20 else new
    return w[:-1], float(w[-1])


def _kernel(words: list[str], index: dict[int, np.ndarray], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words with landmarks, given the landmarks' weights (subsequence x landmark)."""
    out = np.zeros((len(words), landmarks.shape[1]))
    n = landmarks.shape[0]
    for a in range(0, len(words), 128):
        m = _matrix(words[a : a + 128], WIDTH)
        cells, values = [], []
        for p in ORDERS:
            for code, weight in _subsequences(m, p):
                at = index[p][code]
                row, col = np.nonzero(at >= 0)
                cells.append(row * n + at[row, col])
                values.append(np.full(len(row), weight))
        dense = np.bincount(np.concatenate(cells), np.concatenate(values), minlength=len(m) * n).reshape(len(m), n)
        out[a : a + 128] = (dense @ landmarks) / _sizes(m)[:, None]
    return out


def _fit(positive: Counter, negative: Counter, hard: list[str], n_landmarks: int) -> tuple[dict[int, np.ndarray], float]:
    """Landmarks are the commonest positive words and the hardest, else commonest, negative ones."""
    good = [w for w, _ in positive.most_common(n_landmarks // 4)]
    marks = good + (hard + [w for w, _ in negative.most_common() if w not in set(hard)])[: n_landmarks - len(good)]
    m = _matrix(marks, WIDTH)
    index = {p: np.full(LETTERS**p, -1, dtype=np.int32) for p in ORDERS}
    total, found = 0, {}
    for p in ORDERS:
        seen = np.unique(np.concatenate([c.ravel() for c, _ in _subsequences(m, p)]))
        seen = seen[seen > 0]
        found[p] = seen
        index[p][seen] = total + np.arange(len(seen))
        total += len(seen)
    weights = np.zeros((total, len(marks)))
    for p in ORDERS:
        for code, weight in _subsequences(m, p):
            row, col = np.nonzero(code)
            np.add.at(weights, (index[p][code[row, col]], row), weight)
    weights /= _sizes(m)[None, :]
    words = list(positive) + list(negative)
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    balance = np.log2(1.0 + np.array([*positive.values(), *negative.values()], dtype=np.float64))
    balance[y > 0] *= balance[y < 0].sum() / balance[y > 0].sum()
    value, vector = np.linalg.eigh(weights.T @ weights)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-6)))[None, :] * (value > 1e-6)[None, :] @ vector.T
    w, bias = _svm(_kernel(words, index, weights) @ root, y, balance)
    folded = weights @ (root @ w)
    tables = {}
    for p in ORDERS:
        table = np.zeros(LETTERS**p)
        table[found[p]] = folded[index[p][found[p]]]
        tables[p] = table.astype(np.float32)
    return tables, bias


def _logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Two slopes, not negative, and an offset."""
    z = np.hstack([s, np.ones((len(s), 1))])
    w = np.zeros(3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ ((p - y) * weight) + 0.05 * w
        h = (z * (np.maximum(p * (1 - p), 1e-9) * weight)[:, None]).T @ z + 0.05 * np.eye(3)
        new = w - np.clip(np.linalg.solve(h, g), -2, 2)
        new[:2] = np.maximum(new[:2], 0.0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return (float(w[0]), float(w[1])), float(w[2])


def _disguised(positive: Counter, words: int = 60) -> Counter:
    """Commonest positive words with one character put in, at each place, or one between all letters."""
    out: Counter = Counter()
    for w, n in positive.most_common(words):
        bare = _bare(w)
        if 4 <= len(bare) <= 10:
            for i in range(1, len(bare)):
                out[f"{bare[:i]}-{bare[i:]}"] += max(1, n // 8)
                out[f"{bare[:i]}x{bare[i:]}"] += max(1, n // 16)
            out[".".join(bare)] += max(1, n // 4)
    return out


def fit(
    texts: list[str], labels: list[int], rate: float, n_landmarks: int = 400, per_text: int = 5, n_positive: int = 800,
    n_sampled: int = 4000, n_common: int = 1000, n_hard: int = 1500, n_disguised: int = 60,
) -> Model:
    """Learn from whole texts, each sentence of which carries its text's label.

    A toxic text has toxic sentences and others, so the words that stand for the
    toxic class are chosen: first those with letter groups far more common in toxic
    texts (G squared), at most ``per_text`` a text, then, three times, the highest-scored
    ones of each text; the highest-scored words of other texts join the negatives and become
    landmarks. Long words are learnt, as they are scored, in stretches. Words weigh by the
    logarithm of the texts they are in. Two thirds of the texts are learnt from. Words of
    two of their clean texts or more are known to be plain whatever they resemble. The rest
    of the texts scale a text's evidence to a probability, at the share ``rate`` of toxic
    texts.

    The machine sees at most ``n_positive`` words of the toxic class, the commonest, and of
    the other class ``n_sampled`` by a hash, the ``n_common`` commonest and ``n_hard`` a
    round that it gets most wrong; ``n_disguised`` common toxic words are taught with a
    character put in, too. Null texts count as empty, repeated texts count as often as they
    come, ties go by the word. Without any toxic text, any other text or any word that stands
    out the model is the constant ``rate``.
    """
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    empty = Model({p: np.zeros(LETTERS**p, dtype=np.float32) for p in ORDERS}, offset=float(np.log(rate / (1 - rate))))
    docs = [{x for s in SENTENCE.split(t or "") for w in tokens(s) for x in _cut(w.lower())} for t in texts]
    learn = [i for i in range(len(docs)) if i % 3 != 2]
    toxic, clean = [i for i in learn if labels[i]], [i for i in learn if not labels[i]]
    if not toxic or not clean:
        return empty
    in_toxic = Counter()
    for i in toxic:
        in_toxic.update(set().union(*map(_grams, docs[i])) if docs[i] else ())
    in_toxic = Counter({g: n for g, n in in_toxic.items() if n > 1})
    in_clean = Counter()  # of groups that are counted above alone
    for i in clean:
        in_clean.update({g for w in docs[i] for g in _grams(w) if g in in_toxic})
    score = {g: _signed_g2(n, in_clean[g], len(toxic), len(clean)) for g, n in in_toxic.items()}
    seen = Counter(w for i in clean for w in sorted(docs[i]))  # sorted: ties among counts go by first come
    words = Counter(w for i in toxic for w in sorted(docs[i]))
    own = {w for w, n in words.items() if n * len(clean) > 4 * seen[w] * len(toxic)}  # hardly in other texts
    positive: Counter = Counter()
    for i in toxic:
        ranked = sorted(((max((score.get(g, 0.0) for g in _grams(w)), default=0.0), w) for w in docs[i] & own), reverse=True)
        positive.update(w for s, w in ranked[:per_text] if s > 12)
    del in_toxic, in_clean, score
    _grams.cache_clear()
    if not positive:
        return empty
    other = sorted(seen, key=lambda w: (hash_of(w), w))
    chosen = set(other[:n_sampled]) | {w for w, _ in seen.most_common(n_common)}
    hard: list[str] = []
    for round_ in range(4):
        taught = Counter(dict(positive.most_common(n_positive))) + _disguised(positive, n_disguised)
        tables, bias = _fit(taught, Counter({w: seen[w] for w in sorted(chosen)}), hard, n_landmarks)
        model = Model(tables, bias)
        of = model.words(other)
        if round_ == 3:
            common = Counter()
            for w, n in seen.items():
                common[_bare(w)] += n
            bare_own = {_bare(w) for w in own}
            model.plain = frozenset(
                b for b in {_bare(other[i]) for i in np.flatnonzero(of > -0.5)} if common[b] > 1 and b not in bare_own
            )
            break
        wrong = (of + 1) * np.log2(1.0 + np.array([seen[w] for w in other]))
        hard = [other[i] for i in np.argsort(-wrong, kind="stable")[:n_hard]]
        chosen |= set(hard)
        for i in toxic:
            mine = sorted(docs[i] & own)
            if mine:
                values = model.words(mine)
                positive.update(mine[j] for j in np.argsort(-values, kind="stable")[:per_text] if values[j] > 0)
    held = [i for i in range(len(docs)) if i % 3 == 2] or learn
    s = np.array([model.evidence(_decisions(model, texts[i] or "")) for i in held])
    y = np.array([float(labels[i]) for i in held])
    if not 0 < y.sum() < len(y):
        s, y = np.vstack([s, [1.0, 1.0], [-1.0, -1.0]]), np.r_[y, 1.0, 0.0]
    share = y.mean()
    weight = np.where(y > 0, rate / share, (1 - rate) / (1 - share))
    model.slopes, model.offset = _logistic(s, y, weight)
    return model


def _decisions(model: Model, text: str) -> list[float]:
    counts = Counter(tokens(text))
    words = sorted(counts)
    return [v for w, v in zip(words, model.words(words), strict=True) for _ in range(counts[w])]


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def may_learn(id_col: Column) -> Column:
    """Rows that labels may be learnt from; the others are held out."""
    return F.crc32(id_col.cast("string")) % 3 != 1


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 800, **bounds,
) -> Model:
    """A model from at most ``per_class`` labelled documents of each class.

    The sample takes labelled ids, not held out, in order of a hash, and their whole texts
    come to the driver; ``bounds`` are those of ``fit``. Rows whose label is null or that
    have no document are passed over; of rows that repeat an id one text comes, the first by
    a hash; empty tables give a constant model.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & may_learn(F.col(id_col)))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for y in (0, 1):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(chosen.distinct()), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t"))
    rows = sorted((r["id"], r["t"], r["y"]) for r in rows.collect())
    rows.sort(key=lambda r: (hash_of(str(r[0])), r))
    return fit([t for _, t, _ in rows], [y for *_, y in rows], rate, **bounds)


def score(col: Column, model: Model, cache_size: int = 150_000) -> Column:
    """Column: probability that a text is toxic, from its highest-scored words.

    Words are scored once in a worker and looked up after that. Null counts as empty;
    a text without words has the lowest evidence there is. Equal texts score alike, whole
    and however long they are; an empty table gives no rows.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        if _WORKER.get("model") is not m:
            _WORKER.clear()
            _WORKER.update(model=m, cache={})
        cache = _WORKER["cache"]

        def decide(texts: list[str]) -> list[tuple[float, float]]:
            if len(cache) > cache_size:
                cache.clear()
            split = [tokens(x) for x in texts]
            got = [list(map(cache.get, words)) for words in split]
            missing = list({
                w for words, ns in zip(split, got, strict=True) if None in ns
                for w, n in zip(words, ns, strict=True) if n is None
            })
            new = dict(zip(missing, m.words(missing).tolist(), strict=True))
            out = [
                m.evidence([new[w] if n is None else n for w, n in zip(words, ns, strict=True)] if None in ns else ns)
                for words, ns in zip(split, got, strict=True)
            ]
            cache.update((w, n) for w, n in new.items() if len(w) <= 64)
            return out

        for texts in batches:
            found: list[tuple[float, float]] = []
            group: list[str] = []
            chars = 0
            for text in texts:
                group.append(text or "")
                chars += len(group[-1])
                if chars > 500_000:
                    found += decide(group)
                    group, chars = [], 0
            found += decide(group)
            yield pd.Series(m.probability(np.asarray(found).reshape(-1, 2)), dtype="float64")

    return of(col)
