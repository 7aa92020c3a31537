"""Operators do the whole job: nothing is left out by its count, its length or its place."""

import pytest

from loomwright.llm import line_dedup, ngram
from tests.llm.conftest import as_frame


def test_ngrams_seen_once_are_kept(spark):
    rows = [(i, " ".join(f"w{(7 * i + k * k) % 50}" for k in range(20))) for i in range(30)] + [(100, "one passage that stands only here in training")]
    model = ngram.train_model(as_frame(spark, rows).select("text"))
    tokens = [["<s>", *t.split(), "</s>"] for _, t in rows]
    assert [x.n for x in model.levels[1:]] == [len({tuple(t[k - n : k + 1]) for t in tokens for k in range(n, len(t))}) for n in (1, 2)]
    copy, mixed = ngram.score_texts(model, [rows[-1][1], " ".join(reversed(rows[-1][1].split()))])["score"]
    assert copy > mixed + 5
    p1 = lambda c: (c + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1))
    # after a context that was seen once with this word: 0.25 + 0.75 of the shorter context
    two = 0.25 + 0.75 * p1(1)
    got = ngram.score_texts(model, ["one passage that"])
    assert got["n_known"][0] == 4
    assert 10 ** (ngram.score_texts(model, ["one passage that stands"])["score"][0] - got["score"][0]) == pytest.approx(0.25 + 0.75 * two, rel=0.05)


def test_short_and_unspaced_lines_go(spark):
    rows = [
        (1, "one\nlines of four words\n\n \nfive words stand in here\n" + "漢字の行" * 20),
        (2, "one\nlines of four words\n\n \nfive words stand in there\n" + "漢字の行" * 20),
        (3, "lines of some words\nfive words stand here\nsix more words stand in here\nfive words or six in here"),
        (4, "seven words of which one goes away\nsix more words now stand in here\nseven words of which one goes"),
    ]
    got = {r["doc_id"]: r["gone_lines"] for r in line_dedup.dedup_lines(as_frame(spark, rows)).collect()}
    # blank lines stay; of near lines both have five words or more
    assert got == {1: [], 2: [0, 1, 4, 5], 3: [], 4: [1, 2]}
