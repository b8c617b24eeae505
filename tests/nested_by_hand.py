"""A walk over every value of a run, as the brute-force version of the operator."""

import json

STEP_KINDS = ("entity", "predicate")
ENCODED_DEPTH = 40


def decode(text):
    """The value of JSON text, also where it was encoded repeatedly; None for what is no JSON."""
    value = text
    for _ in range(ENCODED_DEPTH):
        if not isinstance(value, str):
            return value
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return None if isinstance(value, str) else value


def find_number(value, name: str) -> int | None:
    """The whole number under ``name`` at the shallowest level that has one; text that spells a number counts."""
    level = [value]
    while level:
        below = []
        for v in level:
            if isinstance(v, dict):
                got = v.get(name)
                if isinstance(got, str):
                    got = got.strip()
                    got = int(got) if got.lstrip("+-").isdecimal() else None
                if isinstance(got, (int, float)) and not isinstance(got, bool) and got == got // 1:
                    return int(got)
                below += v.values()
            elif isinstance(v, list):
                below += v
        level = [v for v in below if isinstance(v, (dict, list))]
    return None


def _step(value) -> tuple[str, str] | None:
    """(kind, id) of a step, whichever way it is written."""
    if isinstance(value, list):
        if len(value) >= 2 and isinstance(value[0], str) and value[0].strip().lower() in STEP_KINDS:
            member = value[1].get("id") if isinstance(value[1], dict) else value[1]
            return (value[0].strip().lower(), member) if isinstance(member, str) else None
        return None
    if isinstance(value, dict):
        kind = value.get("kind")
        holder = value.get("ref") if isinstance(value.get("ref"), dict) else value
        member = holder.get("id")
        if isinstance(kind, str) and kind.strip().lower() in STEP_KINDS and isinstance(member, str):
            return kind.strip().lower(), member
        if kind is None and len(value) == 1:
            ((kind, member),) = value.items()
            if kind.strip().lower() in STEP_KINDS and isinstance(member, str):
                return kind.strip().lower(), member
    return None


def _items(value) -> list:
    """Elements of a list, values of a map, a single value by itself."""
    if value is None:
        return []
    if isinstance(value, list):
        return value
    return list(value.values()) if isinstance(value, dict) else [value]


def raw_paths(value) -> list[list[tuple[str, str]]]:
    """Paths of (kind, id) steps: a list or map of paths, one path alone, or either as JSON text."""
    if isinstance(value, str):
        value = decode(value)
    if value is None or not isinstance(value, (list, dict)):
        return []
    if _step(value):
        return [[_step(value)]]
    elements = _items(value)
    if any(_step(e) for e in elements):
        elements = [elements]
    paths = []
    for e in elements:
        e = decode(e) if isinstance(e, str) else e
        if isinstance(e, (list, dict)):
            paths.append([s for s in map(_step, [e] if _step(e) else _items(e)) if s])
    return paths


def questions(value) -> list[tuple[str, list]]:
    """(question id, raw paths) of a run's results: a list of records, or a map by question id, also under ``results``."""
    value = decode(value)
    for _ in range(ENCODED_DEPTH):
        if isinstance(value, dict) and "results" in value:
            value = decode(value["results"]) if isinstance(value["results"], str) else value["results"]
    if isinstance(value, dict):
        if isinstance(value.get("question_id"), str):
            pairs = [(None, value)]
        else:
            pairs = list(value.items())
    else:
        pairs = [(None, v) for v in value or []] if isinstance(value, list) else []
    out = []
    for key, record in pairs:
        record = decode(record) if isinstance(record, str) else record
        if isinstance(record, dict):
            question = record.get("question_id", key)
            out.append((question if isinstance(question, str) else key, raw_paths(record.get("raw_paths"))))
    return out
