"""Rules on fixed examples: comparison, parsing, folds, states, times, rewriting."""

from __future__ import annotations

import random

import plain_folds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.functions import fuzzy
from dialoom.functions.text import canonical_time, minutes
from dialoom.operators import candidates as C
from dialoom.operators import folds, rewrite
from dialoom.operators import state as S


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_ratio(a, b):
    assert fuzzy.lcs(a, b) == _lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert 0 <= fuzzy.partial(a, b) <= 100


def test_ratio_values(spark):
    assert (fuzzy.ratio("acorn", "acron"), fuzzy.ratio("kitten", "sitting"), fuzzy.ratio("", "")) == (80, 62, 100)
    assert (fuzzy.partial("acorn", "the acorn house"), fuzzy.partial("", "x")) == (100, 0)
    rows = spark.createDataFrame([("kitten", "sitting"), ("acorn", "acron"), ("", ""), ("", "x"), (None, "x")], "a string, b string")
    from pyspark.sql import functions as F

    got = rows.select(fuzzy.ratio_column("a", "b").alias("r"), fuzzy.ratio_by_fold(F.col("a"), F.col("b")).alias("f")).collect()
    assert [r.r for r in got] == [62, 80, 100, 0, None]
    assert [r.f for r in got][:4] == [62, 80, 100, 0]


@pytest.mark.parametrize("text, want", [("09:30", 570), ("9:30", 570), ("7:41", 461), ("13:02", 782), ("23:59", 1439), ("00:00", 0), ("0:00", 0), ("10:15onsaturday", 0), ("somethingbefore10:15", 0)])
def test_minutes(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(minutes(F.lit(text))).first()[0] == want


def test_times(spark):
    from pyspark.sql import functions as F

    said = {"afternoon": "13:00", "12:30 pm": "24:30", "5pm": "17:00", "by 7:05": "07:05", "after 6": "06:00", "": "00:00", "0715": "07:15", "9 : 45": "09:45", "one o'clock p.m.": "13:00", "8 a.m.": "08:00", "11:20.": "11:20"}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", canonical_time(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == said


def test_delta(spark):
    from pyspark.sql import functions as F

    before = {"hotel": {"name": "test", "type": "hotel", "parking": "yes", "x": ""}, "taxi": {"destination": "all saints"}, "train": {"destination": "all saints"}}
    after = {"hotel": {"name": "test", "type": "guest house", "area": "west"}, "attraction": {"area": "west"}}
    df = spark.createDataFrame([(before, after), (None, after), (after, None)], f"a {S.STATE}, b {S.STATE}")
    got = df.select(S.compute_delta(F.col("a"), F.col("b")).alias("d"), S.apply_update(F.col("a"), S.compute_delta(F.col("a"), F.col("b"))).alias("r")).collect()
    assert got[0].d == {"hotel": {"type": "guest house", "parking": "[DELETE]", "area": "west"}, "taxi": {"destination": "[DELETE]"}, "train": {"destination": "[DELETE]"}, "attraction": {"area": "west"}}
    assert got[0].r == after and got[1].r == after and got[2].r == {}


def test_parsing():
    assert C.parse_calls("[Inform(entity=Hotel(name='a', area='west', name='b')), Request(service='hotel', values=['x', 'y'])") == [
        {"type": "Inform", "args": {"entity": {"type": "Hotel", "args": {"name": "a", "area": "west"}}}},
        {"type": "Request", "args": {"service": "hotel", "values": ["x", "y"]}},
    ]
    assert C.parse_calls("__import__('os').system('x')") == [{"type": "system", "args": {}}]  # read, never run
    assert C.parse_calls("1 +") == [] and C.parse_calls("") == []
    assert C.split_calls("Inform(a=1), Request(b=(2)), Bye()") == ["Inform(a=1)", "Request(b=(2))", "Bye()"]
    assert C.deduplicated("f(a=1, b='x', a=2)") == "f(a=1, b='x')"


def test_active_domains():
    h, t = {"hotel": {"area": "west"}}, {"train": {"day": "monday", "to": "ely"}}
    assert plain_folds.active_domains([{}, h, h, {**h, **t}, {**h, **t}]) == [[], ["hotel"], ["hotel"], ["train"], ["train"]]
    both = {"hotel": {"area": "west", "name": "x"}, "train": {"day": "monday"}}
    assert plain_folds.active_domains([both, both]) == [["hotel"], ["train"]]
    assert plain_folds.active_domains([{"b": {"x": "1"}, "a": {"x": "1"}}]) == [["a"]]
    assert plain_folds.active_domains([both] * 4) == [["hotel"], ["train"], ["train"], ["train"]]  # it moves on once


def test_judge():
    goal = {"hotel": {"informable": {"area": "west"}, "requestable": ["REFERENCE"], "venues": ["1", "2"]}}
    turn = {"slots": ["NAME", "REFERENCE"], "domains": ["hotel"], "venues": {"hotel": ["1"]}}
    assert plain_folds.judge([turn], goal, [["hotel"]]) == {"hotel": (True, True)}
    assert plain_folds.judge([turn], goal, [[]]) == {"hotel": (True, False)}
    assert plain_folds.judge([turn | {"venues": {"hotel": ["3"]}}], goal, [["hotel"]]) == {"hotel": (False, False)}
    # a mention that nothing meets withdraws the offer
    assert plain_folds.judge([turn, turn | {"venues": {"hotel": []}}], goal, [["hotel"], ["hotel"]]) == {"hotel": (False, False)}
    assert plain_folds.judge([turn, turn | {"venues": {"hotel": []}}, turn], goal, [["hotel"]] * 3) == {"hotel": (True, True)}
    named = {"hotel": {"informable": {"name": "x"}, "requestable": [], "venues": []}}
    assert plain_folds.judge([], named, []) == {"hotel": (True, True)}
    train = {"train": {"informable": {}, "requestable": [], "venues": ["T1"]}}
    assert plain_folds.judge([], train, []) == {"train": (True, True)}


def test_folds_as_expressions(spark):
    """Against the plain versions, on random dialogues."""
    rng = random.Random(6)
    domains, slots = ["hotel", "train", "taxi", "area"], ["a", "b"]
    state = lambda: {d: {s: rng.choice("xy") for s in slots if rng.random() < 0.6} for d in domains if rng.random() < 0.5}

    def dialogue():
        out = []
        for _ in range(rng.randint(0, 7)):
            out.append(out[-1] if out and rng.random() < 0.4 else {**(out[-1] if out else {}), **state()})
        return out

    many = [(i, dialogue()) for i in range(150)]
    got = folds.with_active_domains(spark.createDataFrame(many, f"id int, states array<{folds.STATE}>")).collect()
    assert {r.id: r.active for r in got} == {i: plain_folds.active_domains(x) for i, x in many}

    some = lambda items, p=0.5: [x for x in items if rng.random() < p]
    turn = lambda: {"slots": some(["NAME", "TRAINID", "PHONE", "REFERENCE", "AREA"]), "domains": some(domains), "venues": {d: some(["1", "2", "3"], 0.6) for d in some(domains, 0.8)}}
    want = lambda: {"informable": {k: "x" for k in some(["name", "area"], 0.3)}, "requestable": some(["PHONE", "REFERENCE", "TRAINID"], 0.3), "venues": some(["1", "2", "3"], 0.8)}
    rows = []
    for i in range(200):
        turns = [turn() for _ in range(rng.randint(0, 5))]
        rows.append((str(i), turns, {d: want() for d in some(domains, 0.4)}, [some(domains) for _ in turns]))
    frame = spark.createDataFrame(rows, f"dialogue string, turns array<{folds.TURN}>, goal {folds.GOAL}, booked array<array<string>>")
    expected = {(i, d, *x) for i, t, g, b in rows for d, x in plain_folds.judge(t, g, b).items()}
    assert {tuple(r) for r in folds.judged(frame).collect()} == expected and len({x[2:] for x in expected}) == 3


def test_rewriting():
    assert rewrite.replace_fuzzy("stay at acorn guset house now", "Acorn Guest House", "[value_name]") == "stay at [value_name] now"
    assert rewrite.replace_fuzzy("nothing here", "acorn guest house", "[x]") == "nothing here"
    assert rewrite.delexicalise("the west and [value_area] west", [("area", "west")]).count("[value_area]") == 3
    assert rewrite.replace_fuzzy("- west", "west", "[v]") == "[v]"  # the first start, then the shortest
    assert rewrite.replace_fuzzy("in the west", "west", "[v]") == "in the [v]"
    assert rewrite.placeholders_fixed("[name] at [address], [value_parking], [value_price_range] [trainid] [x y]", True) == "[value_name] at [value_address], [parking], [value_price] [value_id] [x y]"
    assert rewrite.placeholders_fixed("[name] [value_area]") == "[value_name] [value_area]"
    assert rewrite._values('["a", "b"]') == ["a", "b"] and rewrite._values("[x") == ["[x"] and rewrite._values(None) == []
    assert rewrite.name_of("entrance fee", True) == "[value_price]" and rewrite.name_of("parking", True) == "[parking]"


def test_seeds_lose_no_place(monkeypatch):
    """Against comparing every word n-gram: odd letters, blanks, punctuation, short and repeating values."""
    rng = random.Random(8)
    words = ["acorn", "guest", "House", "house,", "the", "", "-", "a", "aa", "aaa", "É", "İs", "[value_x]", "west", "Σς", "cheap.", "o'clock"]
    rows = []
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        value = list(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))))
        for _ in range(rng.randint(0, 3)):
            value[rng.randint(0, len(value)) : rng.randint(0, len(value) + 1)] = rng.choice(["", "x", " "])
        rows.append((text, "".join(value)))
    for least in (90, 95):
        seeded = [rewrite.replace_fuzzy(t, v, "[v]", least) for t, v in rows]
        with monkeypatch.context() as m:
            m.setattr(rewrite.Words, "starts", lambda self, want, least: range(len(self.words)))
            assert seeded == [rewrite.replace_fuzzy(t, v, "[v]", least) for t, v in rows]
        assert 50 < sum("[v]" in x for x in seeded) < 1400


def test_delexicalised(spark):
    from pyspark.sql import functions as F

    from dialoom.operators.acts import ACT

    acts = [("Inform", "hotel", {"name": '["acorn house", "ely lodge"]', "area": "west"}, None), ("Request", "hotel", None, ["stars"])]
    rows = spark.createDataFrame([("Acorn House or ely lodge, in the west of [area]", acts), ("acorn house", []), (None, acts), ("the stars", acts[1:])], f"t string, a array<{ACT}>")
    got = [r[0] for r in rows.select(rewrite.delexicalised(F.col("t"), F.col("a"))).collect()]
    assert got == ["[value_name] or [value_name] in the [value_area] of [value_area]", "acorn house", None, "the stars"]


def test_slot_f1(spark):
    from dialoom.operators.metrics import slot_f1

    gold = [(1, "a", "the acorn house"), (1, "b", "dontcare"), (2, "a", "west"), (3, "a", "x")]
    pred = [(1, "a", "acorn house"), (2, "a", "east"), (3, "a", "x"), (3, "c", "y")]
    turns = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int")
    of = lambda rows: spark.createDataFrame(rows, "k int, slot string, value string")
    r = slot_f1(of(gold), of(pred), "k", turns=turns).first()
    # tp: 1a, 3a; fp: 2a, 3c; fn: 2a; turn 1 misses a slot that says nothing, so only the empty turn 4 matches jointly
    assert (round(r.precision, 6), round(r.recall, 6), round(r.joint_accuracy, 6)) == (0.5, round(2 / 3, 6), 25.0)


def test_numbers_as_words():
    from dialoom.functions import aliases as N

    said = {0: "zero", 17: "seventeen", 40: "forty", 99: "ninety-nine", 100: "one hundred", 121: "one hundred and twenty-one", 1005: "one thousand and five", 1200: "one thousand, two hundred", 2_000_000: "two million"}
    assert {n: N.number_words(n) for n in said} == said
    assert {"acorn", "the acorn", "acorn guest house", "acorn hotel", "the acorn hotel"} <= set(N.writings("the acorn guest house"))
    assert [v for v in ("restaurant 17", "restaurant seventeen", "restaurant one seven", "the restaurant seventeen hotel") if not N.is_written("restaurant 17", v)] == []
    assert not N.is_written("restaurant seventeen", "restaurant 17") and not N.is_written("2 17", "two one seven 2") and not N.is_written("17 17", "seventeen one seven")
    long = " ".join(str(x) for x in range(100, 140))  # of forty numerals any may be said
    assert len(N.writings(long)) <= 3 * 22 and N.is_written(long, "the " + long.replace("120", "one hundred and twenty") + " hotel")


def test_writings_are_all_that_can_be_listed():
    """Against listing every way to say every subset of a name's numerals."""
    from itertools import product

    from dialoom.functions import aliases as N

    rng = random.Random(3)
    words = ["acorn", "the", "hotel", "house", "2", "17", "007", "guest", "two", "seventeen", "one", "seven"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    for text in texts:
        listed = set()
        for stem in N.stems(text):
            tokens = stem.split()
            for say in N.SAY[1:]:
                for flags in product(*[[0, 1] if N.is_numeral(t) else [0] for t in tokens]):
                    listed.add(" ".join(say(t) if f else t for t, f in zip(tokens, flags)))
            listed.add(stem)
        for value in texts + sorted(listed):
            assert N.is_written(text, value) == bool(listed & N.stems(value)), (text, value)
            assert not N.is_written(text, value) or set(N.keys(text)) & set(N.keys(value)), (text, value)


@pytest.mark.parametrize("least", [87, 90, 97])
def test_near_pairs(spark, least):
    """The index loses no pair: against comparing all."""
    from dialoom.functions.fuzzy import ratio
    from dialoom.operators.near import near_pairs

    rng = random.Random(least)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 24))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaab", "abababab", "babababa", "", "a", "b"]

    def changed(t):
        for _ in range(rng.randint(1, 4)):
            i = rng.randint(0, len(t))
            t = t[:i] + rng.choice(["", "x", "ab", "é"]) + t[i + rng.randint(0, 2) :]
        return t

    right = base + [changed(rng.choice(base)) for _ in range(200)]
    a = spark.createDataFrame([(i % 2, t) for i, t in enumerate(base)] + [(0, None)], "k int, a string")
    b = spark.createDataFrame([(i % 2, t) for i, t in enumerate(right)] + [(1, None)], "k int, b string")
    got = sorted(map(tuple, near_pairs(a, b, "a", "b", ["k"], least).collect()))
    assert got == sorted({(i % 2, x, y, ratio(x, y)) for i, x in enumerate(base) for j, y in enumerate(right) if i % 2 == j % 2 and ratio(x, y) >= least})
    plan = near_pairs(a, b, "a", "b", (), least)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        near_pairs(a, b, "a", "b", (), 86)


def test_canonical(spark):
    from dialoom.operators.lookup import canonical

    known = spark.createDataFrame([("r", "name", v) for v in ("restaurant one seven", "acorn guest house", "pizza hut fen ditton", "aaaa bbbb", "aaaa bbbc")], "service string, slot string, value string")
    asked = {"Acorn Guest House": "acorn guest house", "the acorn hotel": "acorn guest house", "restaurant 17": "restaurant one seven", "pizza hut fenditton": "pizza hut fen ditton", "nowhere": None, "": None}
    rows = [(i, "r", "name", t) for i, t in enumerate(asked)] + [(90, "r", "leave at", "9:05"), (91, "r", "leave at", "25:99"), (92, "r", "book time", "dontcare"), (93, "r", "name", None), (0, "r", "name", "acorn guest house")]
    got = {(r.id, r.text): r.canonical for r in canonical(spark.createDataFrame(rows, "id int, service string, slot string, text string"), known).collect()}
    assert got == {(i, t.lower()): c for i, (t, c) in enumerate(asked.items())} | {(90, "9:05"): "09:05", (91, "25:99"): None, (92, "dontcare"): "dontcare", (93, None): None, (0, "acorn guest house"): "acorn guest house"}


def test_find(spark):
    from dialoom.operators.lookup import find

    v = spark.createDataFrame([("1", "west", "guesthouse"), ("2", "east", "?")], "id string, area string, type string")
    ids = lambda d, c: sorted(r.id for r in find(v, d, c).collect())
    assert ids("hotel", {"area": "not mentioned", "type": "do not care"}) == ["1", "2"]
    assert ids("hotel", {"type": "Guest House", "area": "west"}) == ["1"] and ids("taxi", {}) == []


def test_random_k(spark):
    from dialoom.operators.sampling import random_k

    q = spark.createDataFrame([(i,) for i in range(40)], "q int")
    pool = spark.createDataFrame([(i,) for i in range(400)], "p int")
    got = {}
    for r in random_k(q, pool, "q", "p", 5).collect():
        got.setdefault(r.q, []).append(r.p)
    assert len(got) == 40 and all(len(set(x)) == 5 for x in got.values())
    assert sum(len(set(got[a]) & set(got[b])) for a in range(40) for b in range(a)) < 200  # by chance about 50
    few = random_k(q, pool.where("p < 3"), "q", "p", 5).collect()
    assert len(few) == 120 and random_k(q, pool.limit(0), "q", "p", 5).count() == 0


def test_completions_that_cannot_follow_are_errors(spark):
    from pyspark.errors import SparkRuntimeException
    from pyspark.sql import functions as F

    from dialoom.operators import prompts as P

    row = spark.createDataFrame([("no call", "hi")], "code string, text string")
    with pytest.raises(SparkRuntimeException, match="must begin with"):
        row.select(P.completion("causal_dst", F.col("code"))).collect()
    assert row.select(P.completion("noisy_channel_dst", F.col("text"))).first()[0] == '"hi"'
    assert P.predicted("noisy_channel_dst") == "user_intent" and P.predicted("noisy_channel_dst", True) == "user_utterance"


def test_prompts(spark):
    from pyspark.sql import functions as F

    from dialoom.operators import prompts as P

    row = spark.createDataFrame([("BeliefState()", "hi \"x\"", None, "agent.no_change()")], "belief_state string, last_system_utterance string, user_utterance string, user_intent string")
    args = {c: F.col(c) for c in row.columns}
    got = row.select(P.prompt("causal_dst", args, F.array(F.struct(*row.columns)), "# task").alias("p")).first().p
    one = "    response = agent.handle_turn(\n        belief_state=BeliefState(),\n        last_system_utterance=\"hi \\\"x\\\"\",\n        user_utterance=None,\n        user_intent="
    assert got == "# task\n\n    # Example 1\n" + one + "agent.no_change()\n    )\n\n    # Example 2\n" + one + "[agent."
    pairs = P.training_pairs(row.withColumn("user_intent", F.lit("[agent.no_change()]")), "causal_dst", args).collect()
    assert [p.completion for p in pairs] == ["no_change()]"]
    said = spark.createDataFrame([(["", "b", "d", "f"], ["a", "c", "e", "g"])], "s array<string>, u array<string>")
    assert said.select(P.history(F.col("s"), F.col("u"))).first()[0] == ["c", "d", "e", "f", "g"]
    with pytest.raises(ValueError):
        P.weighed({"causal_dst": row}, {"other": 2.0})


def test_canonical_completion(spark):
    from pyspark.sql import functions as F

    texts = ["find_hotel(price_range='cheap', area='west')]", "[agent.find_hotel(area='west')", "no_change()]", "find_hotel(area=", "find_train(day='monday')"]
    rows = spark.createDataFrame([(i, t, {"hotel": {"area": "west"}}) for i, t in enumerate(texts)], f"i int, t string, prior {S.STATE}")
    call = C.canonical_completion(F.col("t"), F.col("prior"), [("find_hotel", "hotel", ["area", "price range"])], names={"hotel": {"price range": "price range"}})
    got = {r.i: r.c for r in rows.select("i", call.alias("c")).collect()}
    assert got == {0: 'find_hotel(price_range="cheap")', 1: "agent.no_change()", 2: "agent.no_change()", 3: "agent.no_change()", 4: None}
    bad = {r.i: r.b for r in rows.select("i", C.unread(F.col("t")).alias("b")).collect()}
    assert bad == {0: False, 1: False, 2: False, 3: True, 4: False}
    state = spark.createDataFrame([({"hotel": {"cost": "1", "area": "x"}, "bus": {"cost": "2"}},)], f"s {S.STATE}")
    assert state.select(C.schema_names(F.col("s"), {"hotel": {"cost": "price range"}})).first()[0] == {"hotel": {"price range": "1", "area": "x"}, "bus": {"cost": "2"}}


def test_matched_is_matching_without_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from dialoom.operators import lookup as L

    rng = random.Random(5)
    some = lambda: rng.choice([None, 0.0, -1.5, 2.25, float(rng.randint(-9, 9))])
    q = spark.createDataFrame([(i % 290, rng.choice([None, "a", "b", "?", "z"]), some()) for i in range(300)], "c long, want string, least double")
    v = spark.createDataFrame([(i, rng.choice([None, "a", "b", "?"]), some()) for i in range(200)], "s long, kind string, most double")
    for venues in (v, v.where("kind = 'a'"), v.limit(0)):
        pairs = L.matching(q, venues, {"want": "kind"}, lower={"least": "most"}).groupBy("c").agg(F.count("*").alias("n"), F.min("s").alias("first"))
        got = L.matched(q, venues, "c", ("want", "kind"), ("least", "most"), "s")
        assert sorted(map(tuple, got.select("c", "n", "first").collect())) == sorted(map(tuple, pairs.collect()))


def _mentions(s, v):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    most = 1 if len(v) < 6 else 2
    return s != "" and any(edits(s[i : i + max(len(v) + d, 0)], v) <= most for d in (-1, 0, 1, 2) for i in range(max(1, len(s) - len(v) - d + 1)))


def test_mentions_in_many_tasks(spark):
    import random

    from conftest import DATA
    from dialoom import catalog
    from dialoom.operators.state import mentions

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    pairs = [(word(rng.randint(0, 14)), word(rng.randint(0, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(pairs)], "i int, s string, v string")
    got = {r.i: r.m for r in rows.select("i", mentions(rows.s, rows.v).alias("m")).collect()}
    assert got == {i: _mentions(s, v) for i, (s, v) in enumerate(pairs)}
    for name in ("value_mentions", "value_references"):  # one file of the table, but a task for each core and more
        assert catalog.queries()[name](spark, DATA).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_draws_stay_in_their_row(spark):
    from dialoom.operators.sampling import random_k

    q, pool = spark.range(50).selectExpr("id % 40 as q"), spark.range(1000).withColumnRenamed("id", "p")
    got = random_k(q, pool, "q", "p", 5)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("row_number()") == 1 and "min(_j" not in plan  # the pool's places alone are ranked
    rows = sorted((r.q, r["rank"], r.p) for r in got.collect())
    assert [(a, b) for a, b, _ in rows] == [(i, k) for i in range(40) for k in range(1, 6)] and len({(a, p) for a, _, p in rows}) == 200
