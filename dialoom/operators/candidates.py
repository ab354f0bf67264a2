"""Candidate completions: sampling kept, stop sequences, reranking, choice, and safe parsing.

Candidates are rows (item, completion, score, token_logprobs); a scorer is any function that maps a frame
with (prompt, completion) to token log probabilities, as the one below that needs no model.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.operators import acts as A
from dialoom.operators import state as S


def best_n(candidates: DataFrame, n: int) -> DataFrame:
    """The n best rows of each item; equal completions then collapse into the one with the best score."""
    order = W.partitionBy("item").orderBy(F.desc("score"), "completion")
    kept = candidates.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return kept.groupBy("item", "completion").agg(F.max("score").alias("score"))


def best(candidates: DataFrame) -> DataFrame:
    """One row (item, completion, score): the best score, ties to the smaller completion."""
    order = W.partitionBy("item").orderBy(F.desc("score"), "completion")
    return candidates.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def sum_logprobs(logprobs: Column) -> Column:
    return F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x)


def trim_stop(text: Column, logprobs: Column, pattern: str, ends: Column) -> tuple[Column, Column]:
    """(text before the first stop sequence, summed score of the tokens up to there).

    ``ends``: where each token ends in the text. The token in which the match starts counts unless the
    match starts the text; without a match the score is 0.
    """
    at = F.regexp_instr(text, F.lit(f"({pattern})"))
    before = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    counted = F.filter(F.arrays_zip(logprobs.alias("p"), ends.alias("e")), lambda z: z["e"] < at)
    size = F.size(counted) + F.when(at > 1, 1).otherwise(0)
    return before, F.when(at > 0, sum_logprobs(F.slice(logprobs, 1, size))).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, channel: DataFrame) -> DataFrame:
    """Noisy-channel reranking: (item, completion, channel_logprobs) scores replace the candidates' own.

    An item with one candidate keeps its score; items whose texts to score are all the same score 0, as
    a ``same`` flag of the channel rows says.
    """
    one = F.count("*").over(W.partitionBy("item")) == 1
    joined = candidates.join(channel, ["item", "completion"], "left")
    new = F.when(F.coalesce("same", F.lit(False)), F.lit(0.0)).otherwise(sum_logprobs(F.col("channel_logprobs")))
    return joined.withColumn("score", F.when(one, F.col("score")).otherwise(F.coalesce(new, F.col("score")))).select("item", "completion", "score")


def channel_texts(candidates: DataFrame, mode: str = "cond") -> DataFrame:
    """(item, prompt, completion, target) -> distinct (prefix, text) to score, with the rows that ask for them.

    ``joint`` scores completion and target after the prompt; ``cond`` the target after prompt and completion.
    """
    prefix = F.col("prompt") if mode == "joint" else F.concat("prompt", "completion")
    text = F.concat("completion", "target") if mode == "joint" else F.col("target")
    rows = candidates.select("item", "completion", prefix.alias("prefix"), text.alias("text"))
    return rows.withColumn("same", F.min(F.concat("prefix", "text")).over(W.partitionBy("item")) == F.max(F.concat("prefix", "text")).over(W.partitionBy("item")))


def score_once(texts: DataFrame, scorer) -> DataFrame:
    """Score each distinct (prefix, text) once, and give the scores back to every row that asks."""
    scored = scorer(texts.select("prefix", "text").distinct())
    return texts.join(scored, ["prefix", "text"]).select("item", "completion", "same", F.col("logprobs").alias("channel_logprobs"))


def mock_scorer(texts: DataFrame) -> DataFrame:
    """A scorer without a model: each word's log probability falls with its length."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return texts.withColumn("logprobs", F.transform(words, lambda w: -F.length(w).cast("double") / 10))


# --- parsing: calls with constant keyword arguments, never evaluated -------------------------------------------------

_CALL = re.compile(r"[A-Za-z_]\w*\(")


def balanced(text: str) -> str:
    """Open brackets closed at the end, in order; a closing bracket that nothing opened ends the text."""
    open_, out, quote = [], [], ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            open_.append({"(": ")", "[": "]", "{": "}"}[c])
        elif c in ")]}":
            if not open_ or open_[-1] != c:
                break
            open_.pop()
        out.append(c)
    return "".join(out) + quote + "".join(reversed(open_))


def _value(node: ast.expr):
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_value(x) for x in node.elts]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_value(node.operand)
    if isinstance(node, ast.Call):
        return _call(node)
    raise ValueError(type(node).__name__)


def _call(node: ast.Call) -> dict:
    name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id
    args: dict = {}
    for k in node.keywords:
        args.setdefault(k.arg, _value(k.value))  # of repeated arguments the first counts
    return {"type": name, "args": args}


def deduplicated(text: str) -> str:
    """Repeated keyword arguments of a call out of its text; the first of each stays."""
    out, seen, depth = [], [set()], 0
    for part in re.findall(r"[A-Za-z_]\w*\(|\)|,?\s*[A-Za-z_]\w*\s*=\s*(?:'[^']*'|\"[^\"]*\"|\[[^\]]*\]|[^,()\s\[\]'\"]+)(?!\()|.", text, re.S):
        name = re.match(r",?\s*([A-Za-z_]\w*)\s*=", part)
        if _CALL.fullmatch(part):
            depth += 1
            seen.append(set())
        elif part == ")" and depth:
            depth -= 1
            seen.pop()
        elif name and depth:
            if name[1] in seen[-1]:
                continue
            seen[-1].add(name[1])
        out.append(part)
    return "".join(out)


def parse_calls(text: str) -> list[dict]:
    """The calls of a completion, or [] if it isn't a list of calls with constant arguments."""
    try:
        body = balanced(deduplicated(text.strip().removeprefix("[")))
        tree = ast.parse(f"[{body}]", mode="eval").body
        items = tree.elts
        if len(items) == 1 and isinstance(items[0], ast.List):
            items = items[0].elts
        return [_call(x) for x in items if isinstance(x, ast.Call)]
    except (SyntaxError, ValueError, AttributeError, RecursionError, MemoryError):
        return []


def split_calls(text: str) -> list[str]:
    """The text cut before each top-level call."""
    starts, depth = [], 0
    for m in re.finditer(r"[A-Za-z_]\w*\(|\(|\)", text):
        if m[0] == ")":
            depth -= 1
        else:
            if depth == 0 and m[0] != "(":
                starts.append(m.start())
            depth += 1
    ends = [*starts[1:], len(text)] if starts else []
    return [text[a:b].strip(" ,") for a, b in zip(starts, ends)]


def parsed_acts(text: Column) -> Column:
    """A completion as a JSON list of calls; ``[]`` where it can't be read."""

    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(parse_calls(t or ""), sort_keys=True))

    return F.pandas_udf(of, "string")(text)


def parsed_state(text: Column, prior: Column) -> Column:
    """The state after a completion's calls ``find_<service>(slot=value, ...)``; where it can't be read, the prior one.

    Slots are written with underscores; a value ``[DELETE]`` removes its slot.
    """

    def of(s: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(s, before):
            state = {k: dict(v) for k, v in json.loads(p or "{}").items()}
            for c in parse_calls(t or ""):
                service = c["type"].split("_", 1)[1] if "_" in c["type"] else None
                if service is None or c["type"] == "no_change":
                    continue
                for k, v in c["args"].items():
                    slots = state.setdefault(service, {})
                    if v == "[DELETE]":
                        slots.pop(k.replace("_", " "), None)
                    else:
                        slots[k.replace("_", " ")] = str(v)
            out.append(json.dumps({k: v for k, v in state.items() if v}, sort_keys=True))
        return pd.Series(out, dtype=object)

    return F.from_json(F.pandas_udf(of, "string")(text, F.to_json(prior)), "map<string, map<string, string>>")


def unread(text: Column) -> Column:
    """Whether a completion can't be read as calls (a failed parse; ``[]`` and calls that change nothing can)."""
    return (F.size(F.from_json(parsed_acts(text), "array<string>")) == 0) & (F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\s]", "") != "")


def schema_names(state: Column, names: dict[str, dict[str, str]]) -> Column:
    """Slots that prompts write otherwise back to the schema's names (service -> {written: slot}); others stay."""
    pairs = [F.lit(x) for service, slots in names.items() for written, slot in slots.items() for x in (f"{service}\t{written}", slot)]
    if not pairs:
        return state
    table = F.create_map(*pairs)
    own = lambda s, k: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\t"), k)), k)
    renamed = lambda s, m: F.transform_keys(F.map_filter(m, lambda k, _: own(s, k) != k), lambda k, _: own(s, k))
    # what was written last, under the other name, counts
    return F.transform_values(state, lambda s, m: F.map_concat(F.map_filter(m, lambda k, _: (own(s, k) == k) & ~F.map_contains_key(renamed(s, m), k)), renamed(s, m)))


def canonical_completion(text: Column, prior: Column, intents: list[tuple[str, str, list[str]]], normalise=None, names: dict[str, dict[str, str]] | None = None, prefix: str = "[agent.") -> Column:
    """A completion as the canonical call of the change that it makes: read, brought to the schema's names, normalised, rendered.

    ``normalise`` is a function of a state column. A completion without ``prefix`` gets it.
    """
    whole = F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))
    state = parsed_state(whole, prior)
    state = schema_names(state, names) if names else state
    state = normalise(state) if normalise else state
    return A.intent_call(S.compute_delta(prior, state), intents)
