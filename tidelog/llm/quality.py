"""Document quality by line labels: a linear-chain conditional random field marks content and boilerplate.

Each line has features of its shape (length, case, digits, symbols, punctuation, repetition, place) and of its words,
hashed into HASHED buckets.  Viterbi decoding finds the best labelling of a document's lines, and the document is
kept if lines of content have at least MIN_SHARE of its words and it passes the base rules.

Labels exist for documents only, so those of lines are latent.  They start from what is known without them: lines
that different documents of the sample share are boilerplate wherever they stand, the other lines follow their
document.  Then the field is trained by conditional likelihood, forward and backward, and relabels all lines by Viterbi
decoding, ROUNDS times over; the document's label bounds the result: at least MIN_SHARE of a good document's words stay
content, less than MIN_SHARE of a bad one's, by moving the lines that cost the least.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, bounded_sample, mapped, quoted, small_rows

SAMPLE_DOCS, SEGMENT, EPOCHS, ROUNDS, RATE, RIDGE, MIN_SHARE = 4000, 256, 20, 3, 0.05, 1e-3, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SHAPE, HASHED, SHARED_CHARS = 13, 128, 10
FEATURES = SHAPE + HASHED

_WORDS = re.compile(WORD)
_SPACE = " \t\n\x0b\x0c\r"


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _BANG, _BLANK = (_class(c) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SYMBOLS, "!?", _SPACE))


class _Buckets(dict):
    """Word -> bucket, of words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        b = self[word] = xxhash.xxh64_intdigest(word) % HASHED
        return b


_BUCKETS = _Buckets()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and its number of words."""
    coded = text.encode()
    raw = np.frombuffer(coded + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    blank = _BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    words, length = count(begins), ends - starts
    n = np.maximum(1, length - count(blank) + 1)
    full = words > 0
    first, last = raw[starts], raw[np.maximum(starts, ends - 1)]
    seen, repeated = set(), []
    for line in text.split("\n"):
        repeated.append(line in seen)
        seen.add(line)
    x = np.zeros((len(ends), FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(words) / 3
    x[:, 2] = np.where(full, np.minimum(n / np.maximum(1, words), 30) / 10, 0)
    for i, kind in ((3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, _BANG)):
        x[:, i] = np.minimum(1, count(kind[raw]) / n * 3)
    x[:, 7] = full & np.isin(last, list(b".!?:;\"'"))
    x[:, 8] = full & _UPPER[first]
    x[:, 9] = ~full
    x[:, 10] = full & np.array(repeated)
    x[0, 11] = x[-1, 12] = 1
    buckets = np.fromiter(map(_BUCKETS.__getitem__, coded.lower().split()), dtype=np.int64, count=int(words.sum()))
    at = np.repeat(np.arange(len(ends)) * HASHED, words) + buckets
    x[:, SHAPE:] = np.bincount(at, minlength=len(ends) * HASHED).reshape(-1, HASHED) * (3 / np.maximum(1, words))[:, None]
    return x, words


@dataclass
class Field:
    """Scores of labels 0 (boilerplate) and 1 (content): nodes[label, feature], steps[from, to]."""

    nodes: np.ndarray
    steps: np.ndarray

    @staticmethod
    def untrained() -> Field:
        """Calls everything content."""
        nodes = np.zeros((2, FEATURES))
        nodes[1, 0] = 1
        return Field(nodes, np.zeros((2, 2)))

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi: the best labels; of equal ones, content."""
        s = (x @ self.nodes.T).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        (a, b), back = s[0], []
        for u, v in s[1:]:
            from_a, from_b = a + aa > b + ba, a + ab > b + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = u + (a + aa if from_a else b + ba), v + (a + ab if from_b else b + bb)
        label = 0 if a > b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def share(self, text: str) -> float:
        """Of the words, those in lines of content; 1 for a text without words."""
        x, words = line_features(text)
        total = int(words.sum())
        return float(words[np.array(self.decode(x)) == 1].sum() / total) if total else 1.0

    def dump(self) -> str:
        return json.dumps([self.nodes.tolist(), self.steps.tolist()])

    @staticmethod
    def load(s: str) -> Field:
        return Field(*map(np.array, json.loads(s)))


def likelihood(field: Field, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, Field]:
    """Mean negative log-likelihood of labels y for sequences x (batch, time, feature), and its gradient."""
    batch, time, _ = x.shape
    s = x @ field.nodes.T
    live = np.arange(time)[None, :] < lengths[:, None]
    ahead, behind = np.zeros((batch, time, 2)), np.zeros((batch, time, 2))
    ahead[:, 0] = s[:, 0]
    for t in range(1, time):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.steps, axis=1) + s[:, t]
        ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
    for t in range(time - 2, -1, -1):
        step = np.logaddexp.reduce(field.steps + (s[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(live[:, t + 1, None], step, 0)
    z = np.logaddexp.reduce(ahead[:, -1], axis=1)
    p = np.exp(ahead + behind - z[:, None, None]) * live[:, :, None]
    pairs = live[:, 1:]
    xi = np.exp(ahead[:, :-1, :, None] + field.steps + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
    own = np.eye(2)[y] * live[:, :, None]
    seen = own[:, :-1, :, None] * own[:, 1:, None, :]
    loss = (z - (own * s).sum(axis=(1, 2)) - (seen * field.steps).sum(axis=(1, 2, 3))).sum()
    n = live.sum()
    return loss / n, Field(np.einsum("btk,btf->kf", p - own, x) / n, (xi - seen).sum(axis=(0, 1)) / n)


def shared_lines(texts: list[str], words: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, which of its lines other, different texts have too.  None where these are most of the words: such
    a text is a copy, not a page around shared lines."""
    keys = [[line.strip(_SPACE).lower() for line in text.split("\n")] for text in texts]
    own = {text: {k for k in ks if len(k) >= SHARED_CHARS} for text, ks in zip(texts, keys)}
    holders = Counter(k for ks in own.values() for k in ks)
    out = []
    for ks, n in zip(keys, words):
        found = np.array([holders[k] > 1 for k in ks])
        out.append(found if n[found].sum() <= (1 - MIN_SHARE) * n.sum() else np.zeros(len(ks), dtype=bool))
    return out


def bounded_labels(labels: np.ndarray, margin: np.ndarray, words: np.ndarray, shared: np.ndarray, good: int) -> np.ndarray:
    """The labels, moved as little as the document's label demands; margin: score of content over boilerplate."""
    labels, total = np.where(shared, 0, labels), words.sum()
    content = int(words[labels == 1].sum())
    for i in np.argsort(-margin if good else margin, kind="stable"):
        if (content >= MIN_SHARE * total) == bool(good) or not total:
            break
        if labels[i] != good and not shared[i]:
            labels[i] = good
            content += int(words[i]) * (1 if good else -1)
    return labels


def _batches(xs: list[np.ndarray], labels: list[np.ndarray], size: int) -> list[tuple]:
    """Segments of like length, padded together; whole texts, long ones in segments of SEGMENT lines."""
    parts = sorted(((x[i : i + SEGMENT], y[i : i + SEGMENT]) for x, y in zip(xs, labels) for i in range(0, len(x), SEGMENT)), key=lambda p: len(p[0]))
    out = []
    while parts:
        n = max(1, min(512, size // len(parts[0][0])))
        own, parts = parts[:n], parts[n:]
        lengths = np.array([len(x) for x, _ in own])
        x, y = np.zeros((len(own), lengths.max(), FEATURES), dtype=np.float32), np.zeros((len(own), lengths.max()), dtype=np.int64)
        for i, (features, own_labels) in enumerate(own):
            x[i, : len(features)], y[i, : len(features)] = features, own_labels
        out.append((x, y, lengths))
    return out


class _Adam:
    """Steps down the gradient of a field's likelihood, with a ridge."""

    def __init__(self, rate: float, ridge: float):
        self.rate, self.ridge, self.k, self.moments = rate, ridge, 0, {}

    def step(self, field: Field, gradient: Field) -> None:
        self.k += 1
        for name in ("nodes", "steps"):
            value = getattr(field, name)
            g = getattr(gradient, name) + self.ridge * value
            first, second = self.moments.get(name, (np.zeros_like(value), np.zeros_like(value)))
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
            self.moments[name] = first, second
            setattr(field, name, value - self.rate * (first / (1 - 0.9**self.k)) / (np.sqrt(second / (1 - 0.99**self.k)) + 1e-8))


def train(documents: list[tuple[str, int]], epochs: int = EPOCHS, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE, size: int = 8192) -> Field:
    """A field from texts with the label of the document: good 1, bad 0.  size: lines of a batch."""
    if len({good for _, good in documents}) < 2:
        return Field.untrained()
    found = [line_features(text) for text, _ in documents]
    xs, words = [x.astype(np.float32) for x, _ in found], [n for _, n in found]
    shared = shared_lines([text for text, _ in documents], words)
    labels = [np.where(s, 0, good) for s, (_, good) in zip(shared, documents)]
    field = Field(np.zeros((2, FEATURES)), np.zeros((2, 2)))
    for _ in range(rounds):
        adam, batches = _Adam(rate, ridge), _batches(xs, labels, size)
        for _ in range(epochs):
            for batch in batches:
                adam.step(field, likelihood(field, *batch)[1])
        for i, (x, (_, good)) in enumerate(zip(xs, documents)):
            labels[i] = bounded_labels(np.array(field.decode(x)), x @ (field.nodes[1] - field.nodes[0]), words[i], shared[i], good)
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> Field:
    """A field for docs with labels (doc_id, quality 0 or 1), from at most rows labels, chosen by a hash
    of doc_id, in one task; the driver gets the parameters alone.  Without both labels: Field.untrained()."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = bounded_sample(docs.filter("text IS NOT NULL"), known, "y", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([train(data).dump()])], names=["field"])

    found = mapped(chosen, run, "field string").collect()
    return Field.load(found[0].field) if found else Field.untrained()


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORDS.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen and line.strip(_SPACE):
            repeated += 1
        seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    again = {w for w, n in Counter(windows).items() if n > 1}
    marked, end = 0, 0
    if again:
        for i, w in enumerate(windows):
            if w in again:
                marked += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated, marked


def judge(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    One pass over whole texts without a shuffle.  Null or empty text has no words and fails the base rules.  Rows that
    repeat are judged each.  Columns of docs that bear a result's name are replaced.
    """
    sent, own = field.dump(), [c for c in docs.columns if c not in RESULTS]
    fields = [docs.schema[c] for c in own]
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Field.load(sent)
        for b in small_rows(batches):
            cols = [[] for _ in RESULTS]
            for text in b.column(at).to_pylist():
                text = text or ""
                counts = base(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                share = crf.share(text)
                for c, v in zip(cols, (*counts, failed, share, not failed and share >= min_share)):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names, *RESULTS])

    rows = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)))
    return mapped(rows, run, f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean").toDF(*own, *RESULTS)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
