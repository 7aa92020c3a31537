"""Segmentation against the plain table of all starts of all ends, and its work a letter."""

import math
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.functions.similarity import word_splitter


def plain(glued, counts, total, longest):
    best = [(0.0, 0)]
    for end in range(1, len(glued) + 1):
        choices = []
        for start in range(max(0, end - longest), end):
            w = glued[start:end]
            cost = math.log10(total / counts[w]) if w in counts else math.log10(total) + len(w) - 1
            choices.append((best[start][0] + cost, start))
        best.append(min(choices))
    out, end = [], len(glued)
    while end:
        out.append(glued[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=60), st.dictionaries(st.text("abc", min_size=1, max_size=9), st.integers(1, 12), max_size=25), st.sampled_from([1, 10, 97, 1000]), st.integers(1, 12))
def test_words_equal_plain_python(glued, counts, total, longest):
    counts = {w: n for w, n in counts.items() if len(w) <= longest}
    total = max(total, sum(counts.values()))
    assert word_splitter(counts, total, longest)(glued) == plain(glued, counts, total, longest)


def test_work_does_not_follow_the_longest_word():
    rnd = random.Random(3)
    counts = {"".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 99) for _ in range(5000)}
    words = [rnd.choice(list(counts)) for _ in range(2000)]
    counts["x" * 2000] = 1
    split, begun = word_splitter(counts, sum(counts.values()), 2000), time.process_time()
    assert "".join(split("".join(words))) == "".join(words)
    assert time.process_time() - begun < 2
