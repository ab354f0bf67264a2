"""Prompts of the labelling stages: a call of the agent per turn, solved examples before the one to complete.

A mode names the call's arguments in order. A stage predicts the last one, with the prefix that all its predictions
share; where that is a text which the stage is given (a noisy channel), it predicts the code before it, and only training
completes the text, from its first character on. Examples show a whole call, the last call stops where its
prediction begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: mode -> arguments in order
MODES = {
    "causal_dst": ("belief_state", "last_system_utterance", "user_utterance", "user_intent"),
    "noisy_channel_dst": ("belief_state", "last_system_utterance", "user_intent", "user_utterance"),
    "non_causal_sys_act_resp_only": ("system_response", "system_acts"),
    "non_causal_sys_act_resp_only_noisy_channel": ("system_acts", "system_response"),
    "causal_sys_act_policy_from_hist": ("history", "system_acts"),
    "causal_sys_act_policy_simple": ("last_system_utterance", "user_utterance", "system_acts"),
    "response_gen_simple": ("last_system_utterance", "user_utterance", "system_acts", "system_response"),
}
#: Arguments that come as code already; all others are texts.
CODE = ("belief_state", "user_intent", "db_result", "history", "system_acts")


def is_channel(mode: str) -> bool:
    return "noisy_channel" in mode


def predicted(mode: str, training: bool = False) -> str:
    """The argument that a mode's prompt leaves to complete."""
    return MODES[mode][-2 if is_channel(mode) and not training else -1]


def completion_prefix(mode: str, training: bool = False) -> str:
    """What each completion of a mode begins with, which its prompt gives already."""
    if training and is_channel(mode) or mode.startswith("response_gen"):
        return ""
    return "[agent." if predicted(mode) == "user_intent" else "["


def quoted(text: Column) -> Column:
    """A text as a JSON literal; null is ``None``."""
    array = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("None")).otherwise(array.substr(F.lit(2), F.length(array) - 2))


def history(system: Column, user: Column, most: int = 5) -> Column:
    """The last ``most`` utterances of both sides in turn, empty ones of the system left out."""
    both = F.flatten(F.zip_with(system, user, lambda s, u: F.when(F.coalesce(s, F.lit("")) != "", F.array(s, u)).otherwise(F.array(u))))
    return F.when(F.size(both) > most, F.slice(both, -most, most)).otherwise(both)


def call(number: Column, arguments: list[tuple[str, Column]], predict: str | None = None) -> Column:
    """One call: all arguments, or those given and the name of the one to predict."""
    args = [F.concat(F.lit(f"\n        {k}="), F.coalesce(v, F.lit("None")) if k in CODE else quoted(v), F.lit(",")) for k, v in arguments]
    head = F.concat(F.lit("    # Example "), number.cast("string"), F.lit("\n    response = agent.handle_turn("))
    if predict is not None:
        return F.concat(head, *args, F.lit(f"\n        {predict}="))
    said = F.concat(F.lit(""), *args)
    return F.concat(head, said.substr(F.lit(1), F.length(said) - 1), F.lit("\n    )"))


def example(mode: str, turn: Column, number: Column) -> Column:
    """A solved turn (a struct with the mode's arguments) as an example."""
    return call(number, [(k, turn[k]) for k in MODES[mode]])


def prompt(mode: str, arguments: dict[str, Column], examples: Column | None = None, preamble: str = "", training: bool = False) -> Column:
    """A mode's prompt: preamble, solved examples (an array of turns), and the turn up to what it predicts.

    Predictions from the history take no examples, and those given are left out.
    """
    target = predicted(mode, training)
    names = MODES[mode][: MODES[mode].index(target)]
    none = examples is None or mode == "causal_sys_act_policy_from_hist"
    shown = F.lit("") if none else F.array_join(F.transform(examples, lambda e, i: F.concat(example(mode, e, i + 1), F.lit("\n\n"))), "")
    number = F.lit(1) if none else F.size(examples) + 1
    own = [(k, arguments[k]) for k in names if k in arguments]
    return F.concat(F.lit(f"{preamble}\n\n"), shown, call(number, own, target), F.lit(completion_prefix(mode, training)))


def completion(mode: str, value: Column, training: bool = True) -> Column:
    """What the prompt of a mode leaves to complete, of the predicted argument's value; a value that can't follow the prompt is an error."""
    said = F.coalesce(value, F.lit("None")) if predicted(mode, training) in CODE else quoted(value)
    prefix = completion_prefix(mode, training)
    wrong = F.raise_error(F.concat(F.lit(f"{mode}: a completion must begin with {prefix}: "), said)).cast("string")
    return F.when(said.startswith(prefix), said.substr(F.lit(len(prefix) + 1), F.length(said))).otherwise(wrong)


def training_pairs(turns: DataFrame, mode: str, arguments: dict[str, Column], preamble: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, prompt, completion) of all turns, with the prompt that inference uses (a noisy channel's goes on to the text)."""
    target = arguments[predicted(mode, True)]
    return turns.select(*keep, prompt(mode, arguments, preamble=preamble, training=True).alias("prompt"), completion(mode, target).alias("completion"))


def weighed(pairs: dict[str, DataFrame], weights: dict[str, float]) -> dict[str, tuple[DataFrame, float]]:
    """Modes' pairs with their weights in the training mix (1 where none is given), for ``sampling.mixture``."""
    unknown = set(weights) - set(pairs)
    if unknown:
        raise ValueError(f"weights of modes that aren't there: {sorted(unknown)}")
    return {mode: (rows, weights.get(mode, 1.0)) for mode, rows in pairs.items()}
