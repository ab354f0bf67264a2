"""A language model that needs no weights: interpolated word n-grams, counted, looked up and followed as DataFrames.

P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu), where h' is h without its first word, down to an even share for
every known word and one unknown. Texts are scored by joins of their distinct n-grams with the counts. Of all words the
likeliest after h is one that was seen there, or else the likeliest after h', as the others keep their order;
so the best word of each context is a join too, and greedy completions of any number of prompts come from doubling
the steps of that table.

Null texts count as empty. Words are split at blanks. Ties go to the smaller word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.sources.tables import settled

BEGIN, END = "<s>", "</s>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


@dataclass
class Model:
    """``counts`` (k, context, word, n) and ``totals`` (k, context, total) of k-grams up to ``order``; contexts are words joined by blanks.

    What is read often is kept by ``keep`` (frame -> frame): checkpointed, or as the caller says.
    """

    counts: DataFrame
    totals: DataFrame
    known: int
    order: int
    mu: float

    @classmethod
    def count(cls, texts: DataFrame, text: str = "text", order: int = 3, mu: float = 2.0, keep=None) -> Model:
        """Of all texts."""
        keep = keep or settled
        padded = F.concat(F.array(*[F.lit(BEGIN)] * (order - 1)), words(F.col(text)), F.array(F.lit(END)))
        rows = texts.select(padded.alias("w"))
        places = F.sequence(F.lit(order), F.size("w"))
        grams = F.flatten(F.transform(places, lambda i: F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(F.slice("w", i - k + 1, F.lit(k - 1)), " ").alias("context"), F.element_at("w", i).alias("word")) for k in range(1, order + 1)])))
        counts = keep(rows.select(F.explode(grams).alias("g")).groupBy("g.k", "g.context", "g.word").agg(F.count("*").alias("n")))
        totals = keep(counts.groupBy("k", "context").agg(F.sum("n").alias("total")))
        return cls(counts, totals, counts.where("k = 1").count(), order, mu)

    def mixed(self, n: Column, total: Column, below: Column) -> Column:
        return (F.coalesce(n, F.lit(0)) + self.mu * below) / (F.coalesce(total, F.lit(0)) + self.mu)

    def even(self) -> Column:
        return F.lit(1.0 / (self.known + 1))

    def grams(self, asked: DataFrame) -> DataFrame:
        """``asked`` (history array<string>, word), distinct -> with logprob."""
        rows, p = asked, self.even()
        for k in range(1, self.order + 1):
            context = F.array_join(F.slice("history", F.lit(1 - k), F.lit(k - 1)), " ") if k > 1 else F.lit("")
            rows = rows.withColumn("context", context)
            own = self.counts.where(F.col("k") == k).select("context", "word", F.col("n").alias(f"n{k}"))
            whole = self.totals.where(F.col("k") == k).select("context", F.col("total").alias(f"t{k}"))
            rows = rows.join(own, ["context", "word"], "left").join(whole, "context", "left")
            p = self.mixed(F.col(f"n{k}"), F.col(f"t{k}"), p)
        return rows.select("history", "word", F.log(p).alias("logprob"))

    def score(self, texts: DataFrame) -> DataFrame:
        """(prefix, text), distinct -> with logprobs, one for each word of ``text`` after the words before it: a Scorer."""
        before = F.slice(F.concat(F.array(*[F.lit(BEGIN)] * (self.order - 1)), words(F.col("prefix"))), F.lit(1 - self.order), F.lit(self.order - 1))
        rows = texts.select("prefix", "text", F.concat(before, words(F.col("text"))).alias("w"))
        each = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda s: s["at"] >= self.order - 1)
        rows = rows.select("prefix", "text", "w", F.explode(each).alias("s"))
        rows = rows.select("prefix", "text", F.col("s.at").alias("at"), F.slice("w", F.col("s.at") - self.order + 2, F.lit(self.order - 1)).alias("history"), F.col("s.word").alias("word"))
        known = self.grams(rows.select("history", "word").distinct())
        scored = rows.join(known, ["history", "word"]).groupBy("prefix", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "logprob"))), lambda s: s["logprob"]).alias("logprobs"))
        return texts.join(scored, ["prefix", "text"], "left").select("prefix", "text", F.coalesce("logprobs", F.expr("cast(array() as array<double>)")).alias("logprobs"))

    def best(self) -> DataFrame:
        """(context, word, p): the likeliest next word after each context that was seen, of every length."""
        likely = lambda rows, *key: rows.groupBy(*key).agg(F.min(F.struct((-F.col("p")).alias("m"), "word")).alias("b")).select(*key, "b.word", (-F.col("b.m")).alias("p"))
        below = self.counts.where("k = 1").join(self.totals.where("k = 1").select("context", "total"), "context")
        below = below.select("context", "word", self.mixed(F.col("n"), F.col("total"), self.even()).alias("p"))  # all words, for each seen context of the length before
        found = likely(below, "context")
        out = found
        for k in range(2, self.order + 1):
            shorter = F.regexp_replace("context", "^[^ ]* ?", "")
            totals = self.totals.where(F.col("k") == k).select("context", "total", shorter.alias("after"))
            seen = self.counts.where(F.col("k") == k).select("context", "word", "n").join(totals, "context")
            seen = seen.join(below.select(F.col("context").alias("after"), "word", F.col("p").alias("lower")), ["after", "word"])
            seen = seen.select("context", "word", self.mixed(F.col("n"), F.col("total"), F.col("lower")).alias("p"))
            other = totals.join(found.select(F.col("context").alias("after"), "word", "p"), "after")
            other = other.select("context", "word", self.mixed(F.lit(0), F.col("total"), F.col("p")).alias("p"))
            # where the other was seen here too, its own share is the larger of its two rows
            found, below = likely(seen.unionByName(other), "context"), seen
            out = out.unionByName(found)
        return out

    def complete(self, prompts: DataFrame, most: int = 8, keep=None) -> DataFrame:
        """(id, prompt) -> with completion: the likeliest next word, again and again, up to ``most`` words (a power of two) or the end."""
        keep = keep or settled
        best = keep(self.best())  # read six times below
        contexts = best.select("context")
        onward = best.select("context", "word", F.concat_ws(" ", F.expr("nullif(context, '')"), "word").alias("on"))
        steps = self._longest(onward.where(F.col("word") != END), contexts, "on").select("context", F.array("word").alias("said"), "next")
        ended = onward.where(F.col("word") == END).select("context", F.expr("cast(array() as array<string>)").alias("said"), F.lit(None).cast("string").alias("next"))
        paths = keep(steps.unionByName(ended))
        doubled = 1
        while doubled < most:
            more = paths.select(F.col("context").alias("next"), F.col("said").alias("more"), F.col("next").alias("then"))
            paths = keep(paths.join(more, "next", "left").select("context", F.concat("said", F.coalesce("more", F.expr("cast(array() as array<string>)"))).alias("said"), F.col("then").alias("next")))
            doubled *= 2
        start = F.array_join(F.concat(F.array(*[F.lit(BEGIN)] * (self.order - 1)), words(F.col("prompt"))), " ")
        begun = self._longest(prompts.withColumn("on", start), contexts, "on")
        said = paths.select(F.col("context").alias("next"), F.array_join("said", " ").alias("completion"))
        return begun.join(said, "next", "left").drop("next", "on")

    def _longest(self, rows: DataFrame, contexts: DataFrame, on: str) -> DataFrame:
        """Adds ``next``: the longest end of ``on``'s last words that is a known context."""
        out, found = rows, []
        for k in range(self.order - 1, 0, -1):
            parts = F.split(F.col(on), " ")
            key = F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.lit(-k), F.lit(k)), " "))
            out = out.withColumn(f"_{k}", key).join(contexts.select(F.col("context").alias(f"_{k}"), F.lit(True).alias(f"_has{k}")), f"_{k}", "left")
            found.append(F.when(F.col(f"_has{k}"), F.col(f"_{k}")))
        out = out.withColumn("next", F.coalesce(*found, F.lit("")))
        return out.select(*rows.columns, "next")
