"""Plain versions of the folds over a dialogue, turn by turn."""

from __future__ import annotations

REQUESTABLE = ("PHONE", "ADDRESS", "POST", "REFERENCE", "TRAINID")
#: Domains without a venue table.
AUTOMATIC = ("taxi", "police", "hospital")


def active_domains(states: list[dict[str, dict[str, str]]]) -> list[list[str]]:
    """Each turn's active domains.

    A turn with new (slot, value) pairs activates the changed domain, or stays with the current one if it
    is among several; otherwise the changed domain with most slots, the first by name on ties. A turn
    without any keeps the current domain, unless the turn right before changed several: then the next of those
    that is still in the state. Before the first change there is none.
    """
    out, before, current, changed_before = [], {}, None, []
    for state in states:
        changed = sorted(d for d, slots in state.items() if set(slots.items()) - set(before.get(d, {}).items()))
        if not changed and current is None:
            out.append([])
            continue  # the state to compare with stays the old one
        if not changed:
            others = [d for d in changed_before if d != current and d in state]
            if len(changed_before) > 1 and others:
                current = others[0]
        elif current not in changed:
            current = max(changed, key=lambda d: (len(state[d]), [-ord(c) for c in d]))
        out.append([current])
        before, changed_before = state, changed
    return out


def judge(turns: list[dict], goal: dict[str, dict], booked: list[list[str]]) -> dict[str, tuple[bool, bool]]:
    """domain -> (match, success) of a dialogue.

    A turn: slots (evaluation slots that the response mentions), domains (active), venues (domain -> ids that
    meet the state now), found earlier. The goal: domain -> informable, requestable, venues (ids).
    An offer is made when a name (or a train's id) is mentioned, and replaced only when some venue of the old
    one no longer meets the state; where none does, that withdraws the offer. References count only in turns
    where the domain is booked.
    """
    offered: dict[str, list] = {d: [] for d in goal}
    given: dict[str, set] = {d: set() for d in goal}
    for turn, books in zip(turns, booked):
        for d in turn["domains"]:
            if d not in goal:
                continue
            said = set(turn["slots"])
            if d not in AUTOMATIC and ("TRAINID" if d == "train" else "NAME") in said:
                now = turn["venues"].get(d) or []
                if not offered[d] or set(offered[d]) - set(now):
                    offered[d] = now
            for slot in REQUESTABLE:
                if slot in said and (slot != "REFERENCE" or d in books):
                    given[d].add(slot)
    out = {}
    for d, want in goal.items():
        if d in AUTOMATIC or "name" in want["informable"] or (d == "train" and not offered[d] and "TRAINID" not in want["requestable"]):
            match = True
        else:
            match = bool(offered[d]) and set(offered[d]) <= set(want["venues"])
        out[d] = match, set(want["requestable"]) <= given[d]
    if not all(m for m, _ in out.values()):
        out = {d: (m, False) for d, (m, _) in out.items()}
    return out
