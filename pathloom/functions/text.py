"""Text expressions: questions, prompts, cells, ids, labels in replies. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that a generated question has to have, and the sentinel of an empty path list.
QUESTION_PARTS = (
    "Attribute 1 ",
    " and its description 1 ",
    " \nAttribute 2 ",
    " and its description 2 ",
    " \nDo attribute 1 and attribute 2 are semantically matched with each other?",
)
NO_PATH = "No path found"

# Grammar of ids and of the addresses they are taken from.
ID_PATTERN = r"^[QP]\d+$"
PROPERTY_URI, ENTITY_URI = r"/prop/direct/(P\d+)$", r"/entity/(Q\d+)$"

#: Our own wording of what a model is asked, with worked examples of our own.
_TASK = "You compare two database attributes. Decide whether they carry the same meaning. "
_TIPS = (
    "Names may be abbreviated or carry a schema prefix. "
    "Compare what the attributes hold, not how they are spelled: a date of birth and an age are related, yet not the same. "
    "A code and the label of that code do not match. "
)
_EXAMPLES_PLAIN = (
    "\n\nExample 1\nAttribute 1 ship-dep_port and its description 1 harbour a vessel leaves from\n"
    "Attribute 2 voyage-origin and its description 2 port at which the voyage starts\nReply: 1"
    "\n\nExample 2\nAttribute 1 ship-crew_no and its description 1 number of people on board\n"
    "Attribute 2 voyage-id and its description 2 number that identifies the voyage\nReply: 0\n\n"
)
_EXAMPLES_WITH_CONTEXT = (
    "\n\nExample 1\nAttribute 1 ship-dep_port and its description 1 harbour a vessel leaves from\n"
    "Attribute 2 voyage-origin and its description 2 port at which the voyage starts\n"
    "Graph facts: harbour (Q1), subclass of (P1), port (Q2)\nReply: 1"
    "\n\nExample 2\nAttribute 1 ship-crew_no and its description 1 number of people on board\n"
    "Attribute 2 voyage-id and its description 2 number that identifies the voyage\n"
    "Graph facts: crew (Q3) --[part of] (P2)--> ship (Q4) --[used for] (P3)--> voyage (Q5)\nReply: 0\n\n"
)
_REPLY = "Reply 1 for a match and 0 otherwise."
SYSTEM_WITH_CONTEXT = (
    _TASK + "Facts from a knowledge graph may be given; use them where they help and leave aside those that do not bear on the question. "
    + _TIPS + _EXAMPLES_WITH_CONTEXT + _REPLY
)
SYSTEM_PLAIN = _TASK + _TIPS + _EXAMPLES_PLAIN + _REPLY
NO_CONTEXT = "(none; decide from the attributes alone)"


def strip(c: Column) -> Column:
    """Without outer blanks, tabs and line breaks."""
    return F.trim(c, F.lit(" \t\r\n"))


def generate_question(src_attr: Column, src_desc: Column, tgt_attr: Column, tgt_desc: Column, parity: bool = True) -> Column:
    """The matching question; in parity mode a null prints as ``nan``, otherwise as nothing."""
    text = lambda c: F.coalesce(c, F.lit("nan" if parity else ""))
    a, b, c, d, e = (F.lit(p) for p in QUESTION_PARTS)
    return F.concat(a, text(src_attr), b, text(src_desc), c, text(tgt_attr), d, text(tgt_desc), e)


def has_context(paths: Column) -> Column:
    """Null, blank and the word null are no context."""
    return paths.isNotNull() & ~F.lower(strip(paths)).isin("", "null")


def kg_prompt(question: Column, paths: Column) -> Column:
    """Prompt with graph context."""
    context = F.when(has_context(paths), paths).otherwise(F.lit(NO_CONTEXT))
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nGraph facts:\n"), context, F.lit("\n\nAnswer with 1 or 0."))


def plain_prompt(question: Column) -> Column:
    """Prompt without graph context."""
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nAnswer with 1 or 0."))


def extract_label(reply: Column) -> Column:
    """The first character that is 0 or 1, as a number; -1 where there is none (also for null)."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, "[01]", 0), F.lit("")).cast("int"), F.lit(-1))


def parse_entity_cell(cell: Column) -> Column:
    """Entity ids of a comma-separated cell, in order."""
    return F.filter(F.transform(F.split(cell, ","), lambda x: strip(x)), lambda x: x.startswith("Q"))


def entity_ids(cell: Column) -> Column:
    """Every entity id of a cell in whatever packing, in order."""
    return F.regexp_extract_all(cell, F.lit(r"\bQ\d+\b"), F.lit(0))


def parse_mentions(reply: Column) -> Column:
    """Comma-separated mentions; blanks and the word null are none."""
    return F.filter(F.transform(F.split(reply, ","), lambda x: strip(x)), lambda x: ~F.lower(x).isin("", "null"))


def parse_llm_paths(reply: Column) -> Column:
    """Paths of a reply, separated by ``|``; blanks and the word null are none."""
    return F.filter(F.transform(F.split(reply, r"\|"), lambda x: strip(x)), lambda x: ~F.lower(x).isin("", "null"))


def is_valid_id(value: Column) -> Column:
    """Whether a value is an entity or property id."""
    return value.rlike(ID_PATTERN)


def uri_to_id(uri: Column) -> Column:
    """The id at the end of an entity or property address, null for others."""
    found = F.coalesce(F.nullif(F.regexp_extract(uri, PROPERTY_URI, 1), F.lit("")), F.nullif(F.regexp_extract(uri, ENTITY_URI, 1), F.lit("")))
    return found


def normalise_paths(cell: Column) -> Column:
    """A cell as a list: null is the empty list, a JSON list itself, any other text a list of one."""
    listed = F.when(strip(cell).startswith("["), F.from_json(cell, "array<string>", {"allowSingleQuotes": "false"}))
    return F.when(cell.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(cell)))


def full_text(label: Column, description: Column, key: Column) -> Column:
    """``label. description.``, falling back to the id where both are missing."""
    a, b = F.coalesce(F.trim(label), F.lit("")), F.coalesce(F.trim(description), F.lit(""))
    return F.when((a == "") & (b == ""), key).otherwise(F.concat(a, F.lit(". "), b, F.lit(".")))
