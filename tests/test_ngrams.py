"""The n-gram model against plain loops: log probabilities, best words, greedy completions, odd texts."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from dialoom.operators.ngrams import Model

rng = random.Random(4)
TEXTS = [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", None, " a  b ", "a"]


class Plain:
    def __init__(self, texts, order, mu):
        self.order, self.mu, self.n, self.t = order, mu, Counter(), Counter()
        for text in texts:
            w = ["<s>"] * (order - 1) + [x for x in (text or "").split(" ") if x] + ["</s>"]
            for i in range(order - 1, len(w)):
                for k in range(order):
                    self.n[tuple(w[i - k : i]), w[i]] += 1
                    self.t[tuple(w[i - k : i])] += 1
        self.known = sorted({w for h, w in self.n if not h})

    def p(self, h, w):
        out = 1 / (len(self.known) + 1)
        for k in range(self.order):
            c = tuple(h[len(h) - k :])
            out = (self.n[c, w] + self.mu * out) / (self.t[c] + self.mu)
        return out

    def logprobs(self, prefix, text):
        w = ["<s>"] * (self.order - 1) + [x for x in (prefix or "").split(" ") if x]
        out = []
        for x in [x for x in (text or "").split(" ") if x]:
            out.append(math.log(self.p(w[1 - self.order :], x)))
            w.append(x)
        return out

    def complete(self, prompt, most):
        w, said = ["<s>"] * (self.order - 1) + [x for x in (prompt or "").split(" ") if x], []
        while len(said) < most:
            x = min(self.known, key=lambda x: (-self.p(w[1 - self.order :], x), x))
            if x == "</s>":
                break
            said.append(x)
            w.append(x)
        return " ".join(said)


@pytest.mark.parametrize("order, mu", [(2, 1.0), (3, 2.0), (4, 0.5)])
def test_scores_and_completions(spark, order, mu):
    plain = Plain(TEXTS, order, mu)
    model = Model.count(spark.createDataFrame([(t,) for t in TEXTS], "text string"), order=order, mu=mu)
    asked = [("", "a b c"), ("a", "b"), ("a b c d", "e zz a"), ("zz zz", "a"), ("", ""), ("x", " ")] + [(TEXTS[i] or "", TEXTS[i + 1] or "") for i in range(12)]
    asked = list(dict.fromkeys(asked))
    got = {(r.prefix, r.text): r.logprobs for r in model.score(spark.createDataFrame(asked, "prefix string, text string")).collect()}
    assert set(got) == set(asked)
    for key, values in got.items():
        assert values == pytest.approx(plain.logprobs(*key), abs=1e-12)
    prompts = [(i, t) for i, t in enumerate(["", "a", "b c", "zz", "a b c d e", "zz a", None, "e e"])]
    said = {r.id: r.completion for r in model.complete(spark.createDataFrame(prompts, "id int, prompt string"), 8).collect()}
    assert said == {i: plain.complete(t, 8) for i, t in prompts}


def test_no_texts(spark):
    model = Model.count(spark.createDataFrame([], "text string"))
    got = model.score(spark.createDataFrame([("a", "b c")], "prefix string, text string")).first().logprobs
    assert got == [0.0, 0.0]  # nothing is known, so the one unknown word has all
    assert model.complete(spark.createDataFrame([(1, "a")], "id int, prompt string"), 4).first().completion is None


def test_completions_read_one_table_of_best_words(spark):
    """The best words are counted once, not again wherever contexts are looked up."""
    from dialoom.sources.tables import settled

    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().analyzed().toString().count("Aggregate"))
        return settled(df)

    model = Model.count(spark.createDataFrame([("a b",), ("a c",)], "text string"))
    got = model.complete(spark.createDataFrame([(1, "a")], "id int, prompt string"), 4, keep)
    assert got.first().completion == "b"
    assert sum(n > 0 for n in plans) == 1 and "Aggregate" not in got._jdf.queryExecution().analyzed().toString()
