"""Token counts at every character, against the library."""

import random

import numpy as np
import pytest

from riskloom.llm import subwords, token_counts
from tests.llm.test_counts_and_packing import ODD, _docs, _fuzz

MODEL = subwords.PieceCounts(subwords.PIECE_MODEL)
UNSPACED = ["日本語" * 60, "漢字かな交じり文🙂" * 20, "word\nlines\n" * 30, "Donaudampfschifffahrtsgesellschaft" * 8, "abcabcabd" * 40]


def _count(text):
    return len(MODEL.model.encode(text))


def test_table_of_a_unit_equals_the_library():
    r = random.Random(5)
    units = [u for t in UNSPACED for u in [t]] + ["".join(r.choice("aeinrst\n日éthe0") for _ in range(150)) for _ in range(40)]
    units += [t.replace("▁", "").strip(" ") for t in _fuzz(200, 8)]
    for u in units:
        if u and " " not in u:
            assert MODEL._prefix_table(u).tolist() == [_count(u[: k + 1]) for k in range(len(u))], u


@pytest.mark.parametrize("text", [t for t in ODD if t] + UNSPACED + _fuzz(60, 9) + ["a  b   ", "keeping the  international 日本語 "])
def test_longest_prefix_equals_brute_force(text):
    ends, tokens = token_counts.prefix_table(MODEL.units(text), MODEL.counts([text])[0], MODEL.by_unit)
    counts = [_count(text[:k]) for k in range(len(text) + 1)]
    assert token_counts.all_prefixes(MODEL, text, ends, tokens).tolist() == counts[1:]
    for budget in sorted({0, 1, 2, 3, 5, 9, 20, counts[-1] - 1, counts[-1]}):
        if budget >= 0:
            want = max(k for k, n in enumerate(counts) if n <= budget)
            assert token_counts.longest_prefix(MODEL, text, ends, tokens, budget) == want, budget


def test_texts_without_spaces_are_cut_inside(spark):
    texts = ["日本語" * 4000, "wording\n" * 6000]
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(_docs(spark, texts), tables=True).collect()}
    for i, t in enumerate(texts):
        cut = rows[i]["fit_chars"]
        assert cut and _count(t[:cut]) <= 4096 and all(_count(t[:k]) > 4096 for k in range(cut + 1, cut + 12))
        assert rows[i]["prefix_ends"] == list(range(1, len(t) + 1)) and rows[i]["prefix_tokens"][cut - 1] == _count(t[:cut])
        assert np.all(np.array(rows[i]["prefix_tokens"])[[-1]] == rows[i]["n_tokens"])
