"""Quality metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.fuzzy import partial, partial_column
from dialoom.functions.text import ngrams
from dialoom.operators import acts as A


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., tp, fp, fn) counts -> precision, recall, f1; empty denominators give 0."""
    s = rows.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    s = s.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def set_counts(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) of two sets."""
    return F.size(F.array_intersect(predicted, gold)), F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))


def slot_f1(gold: DataFrame, predicted: DataFrame, *key: str, turns: DataFrame | None = None, least: int = 95) -> DataFrame:
    """State precision, recall, f1 and joint accuracy from (key..., slot, value) rows of both sides.

    Values agree if their partial ratio is over ``least``. A slot that both set with values that don't is a false
    positive and a false negative; misses of gold values that say nothing ('', '?', 'dontcare') don't count, but
    a turn matches jointly only if both sides set the same slots, those included. ``turns`` (key...) are all
    turns, those without any slot too, which match; without it, turns are those that some side has a slot in.
    1e-10 is added to denominators; f1 and joint accuracy are per cent, precision and recall are not.
    """
    both = gold.withColumnRenamed("value", "g").withColumn("in_g", F.lit(True)).join(predicted.withColumnRenamed("value", "p").withColumn("in_p", F.lit(True)), [*key, "slot"], "full")
    paired = F.col("in_g").isNotNull() & F.col("in_p").isNotNull()
    same = F.when(paired, F.when(F.col("g") == F.col("p"), True).otherwise(F.coalesce(partial_column("g", "p") > least, F.lit(False)))).otherwise(False)
    rows = both.select(*key, "in_g", "in_p", "g", paired.alias("paired"), same.alias("same"))
    counted = F.col("in_g").isNotNull() & ~F.coalesce(F.col("g").isin("", "?", "dontcare"), F.lit(False))
    each = rows.groupBy(*key).agg(
        F.sum(F.col("same").cast("int")).alias("tp"), F.sum((F.col("in_p").isNotNull() & ~F.col("same")).cast("int")).alias("fp"),
        F.sum((counted & ~F.col("same")).cast("int")).alias("fn"), F.min(F.col("same").cast("int")).alias("joint"),
    )
    if turns is not None:
        each = turns.select(*key).distinct().join(each, list(key), "left").na.fill({"tp": 0, "fp": 0, "fn": 0, "joint": 1})
    total = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("joint").alias("joint"), F.count("*").alias("n"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-10), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-10)
    return total.select(p.alias("precision"), r.alias("recall"), (100 * 2 * p * r / (p + r + 1e-10)).alias("f1"), (100 * F.col("joint") / (F.col("n") + 1e-10)).alias("joint_accuracy"))


def joint_goal(predicted: Column, gold: Column, least: int = 95) -> Column:
    """Whether flat states (map slot -> value) have the same slots and every value nearly agrees (partial ratio over ``least``)."""
    import pandas as pd

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([set(x) == set(y) and all(partial(x[k], y[k]) > least for k in x) for x, y in zip(map(_pairs, a), map(_pairs, b))], dtype=bool)

    of.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "boolean")(F.map_entries(predicted), F.map_entries(gold))


def _pairs(entries) -> dict[str, str]:
    return {} if entries is None else {e["key"]: e["value"] for e in entries}


def counts_of(predicted: Column, gold: Column) -> Column:
    """A turn's counters (tp, fp, fn) of two sets; null is the empty set."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(*[c.cast("long").alias(n) for n, c in zip(("tp", "fp", "fn"), set_counts(F.coalesce(predicted, none), F.coalesce(gold, none)))])


def merged(counts: Column, over: W | None = None) -> Column:
    """Counters added up: of a group, or of all rows up to each one with a window. Sums of sums are the same, so parts merge in any order."""
    added = [F.sum(counts[n]) for n in ("tp", "fp", "fn")]
    return F.struct(*[(c if over is None else c.over(over)).alias(n) for n, c in zip(("tp", "fp", "fn"), added)])


def scores_of(counts: Column) -> Column:
    """(precision, recall, f1) that counters stand for, 0 where nothing was predicted, or was there."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(counts["tp"], counts["tp"] + counts["fp"]), safe(counts["tp"], counts["tp"] + counts["fn"])
    return F.struct(p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def running_scores(turns: DataFrame, predicted: str, gold: str, by: list[str], order: list[str]) -> DataFrame:
    """``turns`` with ``so_far``, the counters of its part of the corpus up to each turn, and ``scores``, what they stand for."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = turns.withColumn("counts", counts_of(F.col(predicted), F.col(gold))).withColumn("so_far", merged(F.col("counts"), upto))
    return rows.withColumn("scores", scores_of(F.col("so_far"))).drop("counts")


def folded(predicted: Column, gold: Column, least: int = 90) -> Column:
    """The predicted set with each value that a gold one nearly holds, or is held in, replaced by it (the first gold one in order)."""
    import pandas as pd

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            gold_ = sorted(y) if y is not None else []
            out.append(sorted({next((g for g in gold_ if partial(p, g) >= least), p) for p in (x if x is not None else [])}))
        return pd.Series(out, dtype=object)

    of.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "array<string>")(predicted, gold)


def act_scores(turns: DataFrame, least: int = 90) -> DataFrame:
    """One row of precision, recall and f1 of a corpus, for the acts' names, slots and values apart.

    ``turns`` has act lists ``pred`` and ``gold``; null is no act. Each turn's predicted set is folded onto its gold set.
    """
    none = F.expr(f"cast(array() as array<{A.ACT}>)")
    sides = turns.select(F.coalesce("pred", none).alias("pred"), F.coalesce("gold", none).alias("gold"))
    counts = []
    for kind, of in (("acts", A.act_names), ("slots", A.slot_names), ("values", A.slot_values)):
        got = set_counts(folded(of(F.col("pred")), of(F.col("gold")), least), of(F.col("gold")))
        counts.append(F.array(*[c.cast("long") for c in got]).alias(kind))
    rows = sides.select(*counts)
    total = rows.agg(*[F.sum(F.col(kind)[i]).alias(f"{kind}_{n}") for kind in ("acts", "slots", "values") for i, n in enumerate(("tp", "fp", "fn"))])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = []
    for kind in ("acts", "slots", "values"):
        tp, fp, fn = (F.coalesce(F.col(f"{kind}_{n}"), F.lit(0)) for n in ("tp", "fp", "fn"))
        p, r = safe(tp, tp + fp), safe(tp, tp + fn)
        out += [p.alias(f"{kind}_precision"), r.alias(f"{kind}_recall"), safe(2 * p * r, p + r).alias(f"{kind}_f1")]
    return total.select(*out)


def bleu_counts(rows: DataFrame, candidate: str, reference: str, order: int = 4) -> DataFrame:
    """(n, matched, total, cand_len, ref_len) of a corpus: clipped n-gram matches of token arrays, by n."""
    base = rows.select(F.monotonically_increasing_id().alias("row"), candidate, reference)
    grams = None
    for n in range(1, order + 1):
        for side, c in ((0, candidate), (1, reference)):
            part = base.select("row", F.lit(n).alias("n"), F.lit(side).alias("side"), F.explode(ngrams(F.col(c), n)).alias("gram"))
            grams = part if grams is None else grams.unionByName(part)
    counts = grams.groupBy("row", "n", "gram").agg(F.sum((F.col("side") == 0).cast("long")).alias("c"), F.sum((F.col("side") == 1).cast("long")).alias("r"))
    return counts.groupBy("n").agg(F.sum(F.least("c", "r")).alias("matched"), F.sum("c").alias("total"))


def bleu(rows: DataFrame, candidate: str, reference: str, order: int = 4) -> DataFrame:
    """One row (bleu): the geometric mean of clipped precisions times the brevity penalty, in per cent.

    An order without matches counts as 1 / 2**k matches, k being how many orders up to it have none; orders that the
    candidates are too short for are left out; without any words it is 0.
    """
    c = bleu_counts(rows, candidate, reference, order)
    lengths = rows.agg(F.sum(F.size(candidate)).alias("cl"), F.sum(F.size(reference)).alias("rl"))
    empty = F.sum((F.col("matched") == 0).cast("int")).over(W.orderBy("n"))  # ``order`` rows
    c = c.where("total > 0").withColumn("hits", F.when(F.col("matched") > 0, F.col("matched").cast("double")).otherwise(F.pow(F.lit(2.0), -empty)))
    mean = c.agg(F.coalesce(F.exp(F.avg(F.log(F.col("hits") / F.col("total")))), F.lit(0.0)).alias("mean"))
    both = mean.crossJoin(lengths)  # one row each
    brevity = F.when(F.col("cl") >= F.col("rl"), F.lit(1.0)).when(F.col("cl") > 0, F.exp(1 - F.col("rl") / F.col("cl"))).otherwise(F.lit(0.0))
    return both.select((100 * F.col("mean") * brevity).alias("bleu"))


def richness(turns: DataFrame, words: str) -> DataFrame:
    """One row: average tokens, distinct 1- to 3-grams (none across turns), unigram entropy, conditional bigram entropy.

    Both of the conditional entropy's denominators come from unigram counts.
    """
    each = F.flatten(F.array(*[F.transform(ngrams(F.col(words), n), lambda g: F.struct(F.lit(n).alias("k"), g.alias("g"))) for n in (1, 2, 3)]))  # noqa: B023
    counts = turns.select(F.inline(each)).groupBy("k", "g").agg(F.count("*").alias("c"))
    total = turns.agg(F.avg(F.size(words)).alias("avg_tokens"), F.sum(F.size(words)).alias("n"))
    one = counts.where("k = 1").select(F.col("g").alias("w"), F.col("c").alias("cw"))
    rows = counts.withColumn("w", F.when(F.col("k") == 2, F.substring_index("g", " ", 1))).join(one, "w", "left").crossJoin(total)  # total is one row
    p = F.col("c") / F.col("n")
    kinds = [F.sum((F.col("k") == n).cast("long")).alias(name) for n, name in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams"))]
    h1, h2 = -F.sum(F.when(F.col("k") == 1, p * F.log2(p))), -F.sum(F.when(F.col("k") == 2, p * F.log2(F.col("c") / F.col("cw"))))
    got = rows.groupBy("avg_tokens").agg(*kinds, h1.alias("entropy"), h2.alias("conditional_entropy"))
    return got.select("avg_tokens", "unigrams", "entropy", "bigrams", "conditional_entropy", "trigrams")


def msttr(turns: DataFrame, words: str, *order: str, segment: int = 50, bucket: int = 4096) -> DataFrame:
    """One row (msttr): the mean type-token ratio of full segments of the turns' concatenation.

    A token's place is its turn's offset plus its place in the turn. Offsets are prefix sums at three levels, so that
    no task orders all turns: of buckets of ``bucket`` values of the first order column (an integer), of its values
    in a bucket, and of the turns of a value.
    """
    first = order[0]
    sized = turns.withColumn("_n", F.size(words)).withColumn("_b", F.floor(F.col(first) / bucket))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = sized.groupBy("_b", first).agg(F.sum("_n").alias("_g"))
    buckets = groups.groupBy("_b").agg(F.sum("_g").alias("_s")).select("_b", before(W.orderBy("_b"), "_s").alias("_x"))  # a row for each bucket
    groups = groups.join(buckets, "_b").select(F.col(first).alias("_v"), (F.col("_x") + before(W.partitionBy("_b").orderBy(first), "_g")).alias("_y"))
    placed = sized.join(groups, F.col(first).eqNullSafe(F.col("_v")))
    placed = placed.withColumn("_before", F.col("_y") + before(W.partitionBy(first).orderBy(*order[1:]), "_n"))
    each = placed.select(F.posexplode(words).alias("k", "w"), "_before").select(F.floor((F.col("_before") + F.col("k")) / segment).alias("s"), "w")
    parts = each.groupBy("s").agg(F.count("*").alias("n"), F.countDistinct("w").alias("d")).where(F.col("n") == segment)
    return parts.agg(F.avg(F.col("d") / segment).alias("msttr"))


def rates(judged: DataFrame) -> DataFrame:
    """(dialogue, domain, match, success) -> per domain and ``total``: rates in per cent, rounded to a digit.

    A dialogue counts in total as matched (successful) if all its domains are.
    """
    each = judged.groupBy("domain").agg(F.avg(F.col("match").cast("double")).alias("m"), F.avg(F.col("success").cast("double")).alias("s"))
    whole = judged.groupBy("dialogue").agg(F.min(F.col("match").cast("int")).alias("m"), F.min(F.col("success").cast("int")).alias("s"))
    total = whole.agg(F.avg("m").alias("m"), F.avg("s").alias("s")).select(F.lit("total").alias("domain"), "m", "s")
    return each.unionByName(total).select("domain", F.bround(100 * F.col("m"), 1).alias("inform"), F.bround(100 * F.col("s"), 1).alias("success"))
