"""Delexicalisation: values in a text become placeholders. Sequential by nature, so in Arrow batches."""

from __future__ import annotations

import json
import re
import string
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import fixed
from dialoom.functions.fuzzy import ratio
from dialoom.operators.near import lost

_PUNCTUATION = str.maketrans("", "", string.punctuation)


def _key(x: str) -> str:
    return x.lower().translate(_PUNCTUATION).strip()


class Words:
    """A text's words, and the line of them as it is compared, made once for all values that are looked for in it."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split(" ")
        self.line = text.lower().translate(_PUNCTUATION)

    def starts(self, want: str, least: int) -> Iterable[int]:
        """The words at which an n-gram near ``want`` can begin: those after which enough of its letter pairs stand near by.

        An n-gram at ``least`` or more keeps all pairs of ``want`` but a bounded share, and isn't much longer.
        """
        if len(want) < 2 or least < 87:
            return range(len(self.words))
        share = (least - 0.5) / 100
        needed = len(want) - 1 - int(len(want) * lost(least) + 1e-9)
        reach = int(len(want) * (2 - share) / share + 1e-9)
        line, hits = self.line, []
        for pair in {want[i : i + 2] for i in range(len(want) - 1)}:
            at = line.find(pair)
            while at >= 0:
                hits.append(at)
                at = line.find(pair, at + 1)
        if len(hits) < needed:
            return ()
        hits.sort()
        # from each hit as far as an n-gram reaches there are enough: only n-grams that hold such a hit first are looked at
        first = [a for k, a in enumerate(hits) if k + needed <= len(hits) and hits[k + needed - 1] < a + reach - 1]
        if not first:
            return ()
        out, at, k = [], 0, 0
        for i, word in enumerate(line.split(" ")):
            if word:
                while k < len(first) and first[k] < at:
                    k += 1
                if k == len(first):
                    break
                if bisect_left(hits, at + reach - 1) - bisect_left(hits, at) >= needed:
                    out.append(i)
            else:  # an n-gram that begins with nothing is the one after it, with a blank that goes
                out.append(i)
            at += len(word) + 1
        return out


def replace_fuzzy(text: str | Words, value: str, replacement: str, least: int = 90) -> str:
    """All places of the word n-gram that is nearest to ``value``, at ``least`` or more; the first of the nearest by start, then length.

    Places right after ``[value_`` stay. N-grams grow with their words, so each start ends where its n-gram has
    become too long for a better ratio, and those whose length rules it out otherwise aren't compared.
    """
    index = text if isinstance(text, Words) else Words(text)
    want, words = _key(value), index.words
    best, found = least - 1, None
    for i in index.starts(want, least):
        for stop in range(i + 1, len(words) + 1):
            gram = " ".join(words[i:stop])
            got = _key(gram)
            if 200 * min(len(got), len(want)) < (best + 0.5) * (len(got) + len(want)):
                if len(got) > len(want):
                    break
                continue
            if gram and (score := ratio(got, want)) > best:
                best, found = score, gram
    if found is None:
        return index.text
    return re.sub(rf"(?<!\[value_){re.escape(found)}", lambda _: replacement, index.text)


def name_of(slot: str, evaluation: bool = False) -> str:
    if not evaluation:
        return f"[value_{slot.replace(' ', '_')}]"
    slot = slot.replace("_", " ")
    return f"[{slot}]" if slot in fixed.UNPREFIXED else f"[value_{fixed.PLACEHOLDERS.get(slot, slot)}]"


def placeholders_fixed(text: str, evaluation: bool = False) -> str:
    """A text's own ``[slot]`` and ``[value_slot]`` under the names that delexicalising gives."""
    for own in re.findall(r"\[\w+\]", text):
        text = text.replace(own, name_of(own[1:-1].removeprefix("value_"), evaluation))
    return text


def delexicalise(text: str, pairs: list[tuple[str, str]], evaluation: bool = False, least: int = 90) -> str:
    """Values of (slot, value) pairs replaced, longest first, then by slot and value."""
    index = Words(text)
    for slot, value in sorted({(s, v) for s, v in pairs if v and s != "service"}, key=lambda p: (-len(p[1]), *p)):
        after = replace_fuzzy(index, value, name_of(slot, evaluation), least)
        if after != index.text:
            index = Words(after)
    return index.text


def _values(value: str | None) -> list[str]:
    """A slot's value, or the values of a JSON list."""
    if value and value.startswith("["):
        try:
            return [str(v) for v in json.loads(value)]
        except ValueError:
            pass
    return [] if value is None else [value]


def delexicalised(text: Column, acts: Column, evaluation: bool = False) -> Column:
    """``text`` with the values of its acts' entities as placeholders; requests have none.

    Placeholders that it has already, as a predicted text may, get their names first; without acts nothing changes.
    """
    pairs = F.flatten(F.transform(F.filter(acts, lambda a: (a["type"] != "Request") & a["entity"].isNotNull()), lambda a: F.map_entries(a["entity"])))

    def of(texts: pd.Series, some: pd.Series, many: pd.Series) -> pd.Series:
        out = []
        for t, any_, ps in zip(texts, some, many):
            if t and any_:
                t = delexicalise(placeholders_fixed(t, evaluation), [(p["key"], v) for p in (ps if ps is not None else []) for v in _values(p["value"])], evaluation)
            out.append(t)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "string")(text, F.coalesce(F.size(acts) > 0, F.lit(False)), pairs)


def fix_placeholders(text: Column, evaluation: bool = True) -> Column:
    """Placeholders that a text already has, by their names in evaluation (or in plain delexicalising)."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else placeholders_fixed(t, evaluation))

    return F.pandas_udf(of, "string")(text)


def by_spans(text: Column, spans: Column) -> Column:
    """Spans (slot, value, start, stop) replaced, in order; those that overlap an earlier one or say ``dontcare`` stay."""
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["value"] != "dontcare"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["slot"].alias("slot"))))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(acc, s):
        moved = F.struct(F.concat(acc["text"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["slot"], F.lit("]")).alias("text"), s["stop"].cast("int").alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(moved)

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["text"], F.substr(text, acc["at"] + 1, F.length(text))))


def with_spans(turns: DataFrame, spans: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """``turns`` with the annotated spans (key..., slot, value, start, stop) of each replaced in its text; turns without any stay."""
    found = spans.groupBy(*key).agg(F.collect_list(F.struct("slot", "value", "start", "stop")).alias("_spans"))
    joined = turns.join(found, list(key), "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNotNull(), by_spans(F.col(text), F.col("_spans"))).otherwise(F.col(text))).drop("_spans")
