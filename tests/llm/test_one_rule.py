"""Abusive passages are told by one rule, however many documents are labelled."""

import random

import pytest

from lexigauge.llm import toxicity


@pytest.mark.parametrize("n", [150, 198, 202, 400])
def test_a_phrase_of_one_labelled_document_counts_at_every_size(n):
    rng = random.Random(n)
    plain = ["the ring is flat and open", "every proof needs a lemma", "we compare the two maps", "an open lemma is short", "two flat maps meet"]
    doc = lambda *extra: ". ".join([*(rng.choice(plain) for _ in range(5)), *extra]) + "."
    held = [doc("you are a worthless moron") for _ in range(n)] + [doc("lemma maps flat proof ring")]
    model = toxicity.fitted(held, [doc() for _ in range(3 * n)])
    assert model.score("you are a worthless moron.") >= toxicity.THRESHOLD
    assert model.score("lemma maps flat proof ring.") >= toxicity.THRESHOLD
    assert max(model.score(doc()) for _ in range(50)) < toxicity.THRESHOLD
