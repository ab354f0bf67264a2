"""Queries that take whole tables and whole texts where others of their kind take a part; see also test_oracles.py."""

from __future__ import annotations

import hashlib
import os

import pytest
from conftest import DATA
from test_rules import _lcs

from dialoom import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", ["vector_top_k", "vector_distinct_top_k"])
def test_each_twentieth_vector(name, spark, duck):
    got = {r.q for r in catalog.queries()[name](spark, DATA).select("q").distinct().collect()}
    assert got == {r[0] for r in duck.execute("select vec_id from embeddings where vec_id % 20 = 0").fetchall()}


def test_whole_prompts(spark, duck):
    vectors = dict(duck.execute("select vec_id, embedding from embeddings").fetchall())
    items = dict(duck.execute("select item_id, text from benchmark").fetchall())
    want = {}
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        v = vectors[i % len(vectors)]
        near = sorted(items, key=lambda k: (-round(sum(x * y for x, y in zip(v, vectors[k])), 6), k))[:3]
        added = "".join(f'"""{items[k]}"""\n' for k in near) + "# Example 1"
        want[i] = hashlib.md5((text + "# Example 1").replace("# Example 1", added).encode()).hexdigest()
    assert {r.doc_id: r.prompt for r in catalog.queries()["injected_prompts"](spark, DATA).collect()} == want


def test_fuzzy_lookup_at_90(spark, duck):
    names = dict(duck.execute("select p_partkey, lower(p_name) from part").fetchall())
    name = duck.execute("select lower(p_name) from part order by length(p_name) desc, p_name").fetchone()[0]
    name = name[:2] + name[3:]

    def partial(a, b):
        a, b = sorted((a, b), key=len)
        return max(round(200 * _lcs(a, b[i : i + len(a)]) / (2 * len(a))) for i in range(len(b) - len(a) + 1))

    want = {k for k, v in names.items() if partial(name, v) >= 90}
    assert want and not any(name in v for v in names.values())
    assert {r.id for r in catalog.queries()["constraint_fuzzy"](spark, DATA).collect()} == want


def _ratio(a, b):
    return 100 if a == b else round(200 * _lcs(a, b) / (len(a) + len(b)))


def _partial(a, b):
    a, b = sorted((a, b), key=len)
    return max(_ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def test_ratios_of_parts(spark, duck):
    rows = duck.execute("select a.p_partkey, lower(a.p_name), lower(a.p_type), lower(a.p_brand), b.p_name from part a join part b on b.p_partkey = a.p_partkey + 1").fetchall()
    want = {k: (_ratio(n, t), _ratio(n, c), _partial(n, o)) for k, n, t, c, o in rows}
    assert {r.p_partkey: (r.type, r.brand, r.next) for r in catalog.queries()["fuzzy_ratios"](spark, DATA).collect()} == want


def test_delexicalised_turns(spark, duck):
    """By all word n-grams of a turn, in the order of start and length."""
    import re
    import string

    def key(x):
        return "".join(c for c in x.lower() if c not in string.punctuation).strip()

    def replaced(text, value, name):
        words, best = text.split(" "), (89, None)
        for i in range(len(words)):
            for n in range(1, min(8, len(words) - i) + 1):  # no value has more than two words
                gram = " ".join(words[i : i + n])
                if gram and abs(len(key(gram)) - len(key(value))) <= 12 and (score := _ratio(key(gram), key(value))) > best[0]:
                    best = score, gram
        return text if best[1] is None else re.sub(r"(?<!\[value_)" + re.escape(best[1]), name, text)

    got = {(r.conv_id, r.turn): r.text for r in catalog.queries()["fuzzy_delex"](spark, DATA).collect()}
    for c, t, text in duck.execute("select conv_id, turn, text from conversations where conv_id < 8").fetchall():
        w = text.split(" ")
        at = (c * 7 + t) % max(1, len(w) - 1)
        two = " ".join(w[at : at + 2])
        values = [("name", two[:3] + two[4:]), ("area", w[-1])]
        for slot, value in sorted(values, key=lambda p: (-len(p[1]), *p)):
            text = replaced(text, value, f"[value_{slot}]") if value else text
        assert got[c, t] == text, (c, t)


def test_active_domains_of_conversations(spark, duck):
    """By the definition, turn by turn, over the states that the query makes."""
    want = {}
    for c, turns in duck.execute("select conv_id, list({'r': role, 'n': length(text) % 7} order by turn) from conversations group by conv_id").fetchall():
        state, old, current, before, out = {}, {}, None, [], []
        for t in turns:
            state = {**state, t["r"]: t["n"]}
            changed = sorted(k for k, v in state.items() if old.get(k) != v)
            if not changed and current is None:
                out.append([])
                continue
            if not changed and len(before) > 1:
                current = next((d for d in before if d != current), current)
            elif changed and current not in changed:
                current = changed[0]
            old, before = state, changed
            out.append([current])
        want[c] = out
    import json

    assert {r.conv_id: json.loads(r.active) for r in catalog.queries()["active_domains"](spark, DATA).collect()} == want
