"""From prompts to predictions through an injected responder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: (system prompt, user prompts) to replies, a batch at a time.
Responder = Callable[[str, list[str]], list[str]]


def stub_responder(system: str, prompts: list[str]) -> list[str]:
    """A rule-based STUB for tests without a network; it is no language model and says nothing about matching quality.

    Replies 1 where the two attribute names of a prompt share a word.
    """
    replies = []
    for prompt in prompts:
        names = re.findall(r"\b[a-z]+-[a-z_]+\b", prompt)[:2]
        parts = [set(re.split(r"[-_]", n)) for n in names]
        replies.append("1" if len(parts) == 2 and parts[0] & parts[1] else "0")
    return replies


_REGISTRY: dict[str, Callable[[], Responder]] = {"stub": lambda: stub_responder}


def register_responder(name: str, factory: Callable[[], Responder]) -> None:
    """Make a responder known under ``name``; the factory runs once in every worker."""
    _REGISTRY[name] = factory


def responder_factory(name: str) -> Callable[[], Responder]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown model {name!r}, expected one of {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def respond(prompts: DataFrame, system: str, model: str = "stub", prompt: str = "prompt") -> DataFrame:
    """Adds ``reply`` and ``error`` to every row.

    Null prompts get a null reply. Prompts are sent in batches; where a batch
    fails each of its prompts is sent alone, and one that fails again has a
    null reply and says why in ``error``.
    """
    factory = responder_factory(model)
    columns = [c for c in prompts.columns if c not in ("reply", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()

        def answered(asked: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                replies = call(system, asked)
                if len(replies) != len(asked):
                    raise ValueError(f"{len(replies)} replies to {len(asked)} prompts")
                return [(r, None) for r in replies]
            except Exception as e:
                if len(asked) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
            return [pair for one in asked for pair in answered([one])]

        for pdf in batches:
            asked = pdf[prompt].notna()
            found = pd.DataFrame({"reply": None, "error": None}, index=pdf.index, dtype=object)
            if asked.any():
                found.loc[asked] = answered(pdf.loc[asked, prompt].tolist())
            yield pdf.assign(reply=found["reply"], error=found["error"])

    narrow = prompts.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.mapInPandas(run, f"{schema}, reply string, error string")


def predict(questions: DataFrame, model: str = "stub", paths: str | None = None) -> DataFrame:
    """Adds prompt, reply and prediction to rows with a ``question`` (and a column of graph context)."""
    q = F.col("question")
    prompt = tx.kg_prompt(q, F.col(paths)) if paths else tx.plain_prompt(q)
    system = tx.SYSTEM_WITH_CONTEXT if paths else tx.SYSTEM_PLAIN
    return respond(questions.withColumn("prompt", prompt), system, model).withColumn("prediction", tx.extract_label(F.col("reply")))
