"""Language ID: the unknown words of a text are scored together, as each would be alone."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from strandline.llm import langid


@pytest.mark.parametrize("longest", [4, 20])
def test_unknown_words_score_as_alone(longest):
    r = random.Random(2)
    words = ["".join(r.choices("abcdeéñß", k=r.randint(1, 8))) for _ in range(300)]
    counts = {x: {n: {} for n in range(longest + 1)} for x in ("a", "b")}
    for k, w in enumerate(words[:150]):
        of = counts["ab"[k % 2]]
        of[0][w] = of[0].get(w, 0) + 1
        for n in range(1, longest + 1):
            for g in langid.grams_of(w, n)[:2]:
                of[n][g] = of[n].get(g, 0) + 1
    scorer = langid.Scorer(langid.Model(counts, longest))
    asked = [w for w in [*words, "ж", "жаb", "\U0001f600x", "zz"] if w not in scorer.words]
    assert scorer.coded == (longest == 4)
    for w, got in zip(asked, scorer.unknown_all(asked), strict=True):
        assert got.tolist() == pytest.approx(scorer.unknown(w), rel=1e-12)
    for text in (" ".join(words), "zz, (abé). b1c 12 ***", "ABÉ! abé", "²x ²"):
        p = sum((scorer.model.word(w) * n for w, n in Counter(langid.words_of(text)).items() if any(map(str.isalpha, w))), 0.0)
        best, score = scorer.judge(text)
        assert best == scorer.model.langs[int(p.argmax())] and 0 <= score <= 1
