"""Deeply nested records of changing shape to related flat tables.

The JSON is brought into one canonical nested array (question, raw paths,
steps) by built-in expressions, level by level: an element is kept as the text
of its JSON until its own level is read, so it may have any shape, and may be
JSON text within JSON text. The array reaches Python as Arrow buffers. There
each level is flattened by its list offsets, parent-index kernels say which
parent an element has, and the parents' keys reach the children by vectorised
take; no value is visited by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of a path's steps.
STEP_KINDS = ("entity", "predicate")
#: Room for any depth and length; the parser's own bounds would drop whole records. Text of an element is limited to
#: 1,000 levels all the same, so records deeper than that are read by the names that are asked for alone.
_OPTIONS = {"maxNestingDepth": "1000000", "maxStringLen": "2147483647", "maxNumLen": "1000000", "allowNumericLeadingZeros": "false"}
_LIST, _MAP = "array<string>", "map<string,string>"
_STEPS = "array<struct<kind:string,id:string>>"
_RECORD = "struct<question_id:string,raw_paths:string>"
_QUESTIONS = f"array<struct<question_id:string,raw_paths:array<{_STEPS}>>>"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def _elements(text: Column) -> Column:
    """The elements of a JSON list, as text; null for any other text."""
    return F.when(text.startswith("["), F.from_json(text, _LIST, _OPTIONS))


def _members(text: Column) -> Column:
    """The members of a JSON map by name, as text; null for any other text."""
    return F.when(text.startswith("{"), F.from_json(text, _MAP, _OPTIONS))


def _record(text: Column) -> Column:
    """What a record is read for; null for text that is no JSON map."""
    return F.when(text.startswith("{"), F.from_json(text, _RECORD, _OPTIONS))


def _items(text: Column) -> Column:
    """Elements of a list, or values of a map."""
    return F.coalesce(_elements(text), F.map_values(_members(text)))


def _repeat(value: Column, times: Column, step) -> Column:
    """``step`` applied to ``value`` so many times."""
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(1), times), value, lambda v, _: step(v))).otherwise(value)


def _repaired(text: Column) -> Column:
    """JSON text with the replacement sign for escaped lone halves of surrogate pairs."""
    fixed = F.regexp_replace(text, r"(\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\+u[dD][c-fC-F]))|((?<!\\u[dD][89abAB][0-9a-fA-F]{2})(?<!\\u[dD][89abAB][0-9a-fA-F]{2}\\)\\u[dD][c-fC-F][0-9a-fA-F]{2})", r"\\ufffd")
    return F.when(text.rlike(r"\\u[dD][89a-fA-F]"), fixed).otherwise(text)


def decoded(text: Column, repair: bool = False) -> Column:
    """The text of a JSON list or map, also where it was encoded repeatedly; null for anything else.

    Text encoded n times starts with n quotation marks, each behind twice as
    many backslashes and one as the one before, so the run it starts with
    bounds n. ``repair`` replaces lone surrogate halves, once for a whole record.
    """
    trim = lambda t: F.trim(t, F.lit(" \t\r\n"))
    whole = _repaired(text) if repair else text

    def once(t: Column) -> Column:
        inner = F.from_json(F.concat(F.lit("["), t, F.lit("]")), _LIST, _OPTIONS)
        return F.when(t.startswith('"'), _let(inner, lambda a: F.when(F.size(a) == 1, trim(a[0])))).otherwise(t)

    run = F.length(F.regexp_extract(trim(text), r'^["\\]*', 0))
    depth = F.when(run > 0, F.ceil(F.log2(run.cast("double") + 1)).cast("int")).otherwise(0)
    sound = lambda t: t.startswith("[") | t.startswith("{")
    deep = _let(_repeat(trim(whole), depth, once), lambda t: F.when(sound(t), t))
    return F.when(sound(text), whole).when(text.isNotNull(), deep)


def _known_kind(kind: Column) -> Column:
    return _let(F.lower(F.trim(kind)), lambda k: F.when(k.isin(*STEP_KINDS), k))


def _read(text: Column) -> Column:
    """The elements or the members of JSON text, parsed once; both null for any other text."""
    return F.struct(_elements(text).alias("list"), _members(text).alias("map"))


def _items_of(read: Column) -> Column:
    return F.coalesce(read["list"], F.map_values(read["map"]))


def _step(read: Column) -> Column:
    """(kind, id) of a step, whichever way it is written; null if it is none."""

    def pair(kind: Column, member: Column) -> Column:
        step = F.struct(_known_kind(kind).alias("kind"), member.alias("id"))
        return _let(step, lambda s: F.when(s["kind"].isNotNull() & s["id"].isNotNull(), s))

    def named(text: Column) -> Column:
        """An id, or the id of a map that holds one."""
        return F.when(text.startswith("{"), _members(text)["id"]).otherwise(text)

    a, m = read["list"], read["map"]
    member = F.coalesce(F.when(m["ref"].startswith("{"), F.get_json_object(m["ref"], "$.id")), m["id"])
    single = F.when(F.size(m) == 1, pair(F.map_keys(m)[0], F.map_values(m)[0]))
    of_map = F.when(m["kind"].isNotNull(), pair(m["kind"], member)).otherwise(single)
    of_list = F.when((F.size(a) >= 2) & ~F.substring(a[0], 1, 1).isin("[", "{"), pair(a[0], named(a[1])))
    return F.when(a.isNotNull(), of_list).when(m.isNotNull(), of_map)


def step_of(text: Column) -> Column:
    """(kind, id) of a step written as JSON text; null if it is none."""
    return _let(_read(text), _step)


def raw_paths(text: Column) -> Column:
    """Paths of (kind, id) steps: a list or map of paths, one path alone, one step alone, or any of them as JSON text.

    Each level is parsed once: the whole, its paths, their steps.
    """
    sound = lambda steps: F.filter(steps, lambda s: s.isNotNull())

    def path(read: Column) -> Column:
        """A step alone, or the steps of a list or map."""
        several = sound(F.transform(_items_of(read), lambda e: step_of(_as_text(e))))
        return _let(_step(read), lambda s: F.when(s.isNotNull(), F.array(s)).otherwise(several))

    def of_elements(reads: Column) -> Column:
        """If any element is a step they are one path, else each list or map is a path."""
        own = _let(sound(F.transform(reads, _step)), lambda s: F.when(F.size(s) > 0, F.array(s)))
        return F.coalesce(own, F.transform(F.filter(reads, lambda r: r["list"].isNotNull() | r["map"].isNotNull()), path))

    def of_whole(read: Column) -> Column:
        elements = F.transform(_items_of(read), lambda e: _read(decoded(e)))
        return _let(_step(read), lambda s: F.when(s.isNotNull(), F.array(F.array(s))).otherwise(_let(elements, of_elements)))

    return F.coalesce(_let(_read(decoded(text)), of_whole), F.array().cast(f"array<{_STEPS}>"))


def _as_text(e: Column) -> Column:
    return F.when(e.startswith("[") | e.startswith("{"), e).otherwise(F.trim(e, F.lit(" \t\r\n")))


def questions(text: Column) -> Column:
    """(question id, raw paths) of a run's results: a list of records, or a map by question id, also under ``results``."""
    record = lambda q, r: F.struct(q.alias("question_id"), r["raw_paths"].alias("raw_paths"))

    def within(t: Column) -> Column:
        return _let(_members(t), lambda m: F.when(F.array_contains(F.map_keys(m), "results"), decoded(m["results"])).otherwise(t))

    def of_records(entries: Column) -> Column:
        """From (key, text) entries; what is no map is no record."""
        read = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _record(decoded(e["value"])).alias("r")))
        return of_read(read)

    def of_read(entries: Column) -> Column:
        sound = F.filter(entries, lambda e: e["r"].isNotNull())
        return F.transform(sound, lambda e: record(F.coalesce(e["r"]["question_id"], e["key"]), e["r"]))

    def keyed(typed: Column) -> Column:
        return F.transform(typed, lambda r: F.struct(F.lit(None).cast("string").alias("key"), r.alias("r")))

    def of_list(t: Column) -> Column:
        """All elements as records at once, if all of them are maps; else one by one."""
        one_by_one = of_records(F.transform(_elements(t), lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value"))))

        def typed(records: Column) -> Column:
            whole = records.isNotNull() & F.forall(records, lambda r: r.isNotNull())
            return F.when(whole, of_read(keyed(records))).otherwise(F.coalesce(one_by_one, of_read(keyed(records))))

        return _let(F.from_json(t, f"array<{_RECORD}>", _OPTIONS), typed)

    def of_map(t: Column, m: Column) -> Column:
        typed = F.map_entries(F.from_json(t, f"map<string,{_RECORD}>", _OPTIONS))
        entries = F.transform(typed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("r")))
        several = F.coalesce(of_records(F.map_entries(m)), of_read(entries))
        return _let(_record(t), lambda r: F.when(r["question_id"].isNotNull(), F.array(record(r["question_id"], r))).otherwise(several))

    def of_text(t: Column) -> Column:
        return F.when(t.startswith("["), of_list(t)).otherwise(_let(_members(t), lambda m: of_map(t, m)))

    depth = F.size(F.split(text, '"results')) - 1  # each level under that name writes it once
    records = _let(_repeat(decoded(text, True), depth, within), of_text)
    read = F.transform(records, lambda r: F.struct(r["question_id"].alias("question_id"), raw_paths(r["raw_paths"]).alias("raw_paths")))
    return F.coalesce(read, F.array().cast(_QUESTIONS))


def find_number(text: Column, name: str) -> Column:
    """The whole number under ``name`` at the shallowest level of JSON text that has one, as int; text that spells a number counts."""

    whole = lambda t: _let(F.trim(t).try_cast("double"), lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 2.0**31), x.cast("int")))
    state = F.struct(F.lit(None).cast("int").alias("found"), F.array(decoded(text)).alias("level"))

    def down(s: Column) -> Column:
        maps = F.transform(s["level"], _members)
        found = F.filter(F.transform(maps, lambda m: whole(m[name])), lambda x: x.isNotNull())
        below = F.filter(F.flatten(F.transform(s["level"], lambda t: F.coalesce(_items(t), F.array().cast(_LIST)))), lambda t: t.startswith("[") | t.startswith("{"))
        return F.when(s["found"].isNotNull() | (F.size(s["level"]) == 0), s).otherwise(F.struct(F.get(found, F.lit(0)).alias("found"), below.alias("level")))

    depth = F.length(text) - F.length(F.regexp_replace(text, r"[\[{]", ""))  # as many levels as brackets, mostly fewer
    return _repeat(state, depth, down)["found"]


def flatten(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Child values of a list array, the index of each one's parent, and its position from 1."""
    parents = pc.list_parent_indices(lists)
    at = np.arange(len(parents), dtype=np.int64)
    first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    return lists.flatten(), parents, pa.array((at - first[parents.to_numpy()] + 1).astype(np.int32))


#: Columns of the flat table of each level; a child keeps the keys of all its parents.
LEVELS = {
    "runs": "run_id bigint, max_hops int",
    "questions": "run_id bigint, max_hops int, question_no int, question_id string",
    "paths": "run_id bigint, max_hops int, question_no int, question_id string, path_no int, n_steps int",
    "steps": "run_id bigint, max_hops int, question_no int, question_id string, path_no int, step_no int, kind string, member_id string",
}


def _flat_rows(level: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {"run_id": batch.column(0), "max_hops": batch.column(1)}
            question, parent, no = flatten(batch.column(2))
            keys = {k: v.take(parent) for k, v in keys.items()} | {"question_no": no, "question_id": question.field("question_id")}
            if level in ("paths", "steps"):
                path, parent, no = flatten(question.field("raw_paths"))
                keys = {k: v.take(parent) for k, v in keys.items()} | {"path_no": no}
            if level == "paths":
                keys["n_steps"] = pc.list_value_length(path)
            if level == "steps":
                step, parent, no = flatten(path)
                keys = {k: v.take(parent) for k, v in keys.items()} | {"step_no": no, "kind": step.field("kind"), "member_id": step.field("id")}
            yield pa.RecordBatch.from_pydict(keys)

    return run


def flatten_runs(
    runs: DataFrame, level: str = "steps", id_col: str = "run_id", metadata_col: str = "metadata", results_col: str = "results"
) -> DataFrame:
    """The flat table of one level (see ``LEVELS``), each row distinct.

    Null, empty and broken JSON gives no children; a run without the number,
    or with one no int holds, has ``max_hops`` -1; questions without raw paths
    give no paths and no steps; what is neither entity nor predicate is no
    step, ids that are numbers count as their text. JSON text within JSON text
    is read however often it was encoded. Runs repeated with the same content
    come out once. Other columns are pruned from the scan.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}, expected one of {sorted(LEVELS)}")
    hops = F.coalesce(find_number(F.col(metadata_col), "max_hops"), F.lit(-1)).alias("max_hops")
    narrow = runs.select(F.col(id_col).cast("long").alias("run_id"), hops, F.col(results_col).alias("results"))
    if level == "runs":
        return narrow.select("run_id", "max_hops").distinct()
    nested = narrow.distinct().select("run_id", "max_hops", questions(F.col("results")).alias("questions"))
    return nested.mapInArrow(_flat_rows(level), LEVELS[level]).distinct()
