"""Latent line labels: planted boilerplate inside good documents, bounds by the document's label, verdicts by brute force."""

import itertools
import random

import numpy as np
from conftest import prose
from tidelog.llm import quality

NOTICES = ["All rights reserved by the owners of this site.", "Subscribe to our newsletter for daily updates.", "Share this page with friends on every network.", "Terms of service, privacy policy and cookie notice.", "Log in or register to leave a comment below."]


def planted(rnd, n):
    out = []
    for _ in range(n):
        lines = [" ".join(prose(rnd, rnd.randrange(8, 30)).split()) for _ in range(rnd.randrange(3, 9))]
        marks = [1] * len(lines)
        for notice in rnd.sample(NOTICES, rnd.randrange(3)):
            at = rnd.randrange(len(lines) + 1)
            lines.insert(at, notice)
            marks.insert(at, 0)
        out.append((lines, marks))
    return out


def test_planted_boilerplate_is_marked_inside_good_documents():
    rnd = random.Random(50)
    junk = lambda: "\n".join(" | ".join(prose(rnd, 1).strip() for _ in range(12)) for _ in range(6))
    data = [("\n".join(lines), 1) for lines, _ in planted(rnd, 200)] + [(junk(), 0) for _ in range(60)]
    rnd.shuffle(data)
    field = quality.train(data)
    right, both = {0: [], 1: []}, 0
    for lines, marks in planted(rnd, 100):
        labels = field.decode(quality.line_features("\n".join(lines))[0])
        both += len(set(labels)) == 2
        for mark, label in zip(marks, labels):
            right[mark].append(mark == label)
        assert field.share("\n".join(lines)) >= quality.MIN_SHARE
    assert np.mean(right[0]) > 0.9 and np.mean(right[1]) > 0.97 and both > 40
    assert all(field.share(junk()) < quality.MIN_SHARE for _ in range(30))


def test_labels_are_bounded_by_the_document():
    rnd = np.random.default_rng(51)
    for _ in range(300):
        n = int(rnd.integers(1, 12))
        labels, margin, words, shared, good = rnd.integers(0, 2, n), rnd.normal(size=n), rnd.integers(0, 20, n), np.zeros(n, dtype=bool), int(rnd.integers(0, 2))
        got = quality.bounded_labels(labels, margin, words, shared, good)
        if words.sum():
            assert (words[got == 1].sum() >= quality.MIN_SHARE * words.sum()) == bool(good)
        moved = np.flatnonzero(got != labels)
        assert all(labels[i] != good for i in moved)
        if (words[labels == 1].sum() >= quality.MIN_SHARE * words.sum()) == bool(good):
            assert not len(moved)


def test_copies_are_not_taken_for_shared_lines():
    text = "the first line of a copied text\nits second line is copied as well"
    texts = [text, text + " here", "alone\nthe first line of a copied text\n" + "and many words of its own " * 9]
    words = [quality.line_features(t)[1] for t in texts]
    assert [s.tolist() for s in quality.shared_lines(texts, words)] == [[True, False], [True, False], [False, True, False]]
    assert [s.tolist() for s in quality.shared_lines([text, text], [words[0], words[0]])] == [[False, False], [False, False]]


def test_verdicts_by_brute_force(spark):
    rnd, verdicts = random.Random(52), set()
    texts = ["\n".join(prose(rnd, rnd.randrange(0, 25)).replace("\n", " ") for _ in range(rnd.randrange(1, 9))) for _ in range(60)] + ["", None, "\n\n"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").cache()
    for seed in range(6):
        gen = np.random.default_rng(seed)
        field = quality.Field(gen.normal(size=(2, quality.FEATURES)), gen.normal(size=(2, 2)))
        field.nodes[:, 0] = 0
        for r in quality.judge(df, field).collect():
            x, words = quality.line_features(r.text or "")
            nodes = x @ field.nodes.T
            score = lambda y: sum(nodes[i, k] for i, k in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))
            best = max(itertools.product((0, 1), repeat=len(x)), key=score)
            share = sum(n for n, k in zip(words, best) if k) / sum(words) if sum(words) else 1.0
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert abs(r.content_share - share) < 1e-9 and r.base_failed == failed and r.kept == (not failed and share >= 0.5)
            verdicts.add((failed, r.kept))
    assert len(verdicts) == 3
