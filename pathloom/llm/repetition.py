"""Share of repeated content inside one document.

A table of named thresholds (length, symbols, stop words, lines, repeated
runs) is compiled into Spark projections of built-in expressions; there is no
user function and no shuffle, so a scan of any size stays a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_WORDS = 5
REPEATED_SHARE = 0.3

# Common function words of the languages in the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das der die ein eine für ist mit nicht oder und "
    "de del el en la las los no o para por que un una y "
    "au ce dans des du est et le les ou par pour qui sur "
    "do i jest na nie oraz się w z"
).split()


@dataclass(frozen=True)
class Threshold:
    """One rule: ``metric`` compared by ``op`` (``ge`` or ``le``) with ``value``."""

    name: str
    metric: str
    op: str
    value: float

    def expression(self) -> Column:
        metric = F.col(self.metric)
        return metric >= F.lit(self.value) if self.op == "ge" else metric <= F.lit(self.value)


#: The table that ``repetition_flags`` compiles by default.
THRESHOLDS: tuple[Threshold, ...] = (
    Threshold("repeated_runs", "repeated_share", "ge", REPEATED_SHARE),
    Threshold("repeated_lines", "repeated_line_share", "ge", 0.3),
    Threshold("mostly_symbols", "symbol_share", "ge", 0.5),
    Threshold("no_stop_words", "stop_word_share", "le", 0.0),
    Threshold("very_short", "n_words", "le", 3),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a one-element array whose element the lambda names."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Longest runs of Unicode letters and digits, in lower case."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, F.lower)


def _repeated_words(words: Column, run: int) -> Column:
    """How many words lie in a run of ``run`` words that equals an earlier run of the same array.

    ``words`` must be bound (see ``_let``): it is read once for every run.
    """
    last = F.size(words) - run
    runs = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, run)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def later(s: Column) -> Column:
        rest = F.greatest(F.size(s) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(s, 1, rest), F.slice(s, 2, rest), lambda a, b: F.when(a["h"] == b["h"], b["i"]))
        return F.sort_array(F.filter(pairs, lambda i: i.isNotNull()))

    starts = _let(F.sort_array(runs), later)
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        state,
        lambda s, i: F.struct((i + run).alias("end"), (s["n"] + i + run - F.greatest(s["end"], i)).alias("n")),
        lambda s: s["n"],
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _word_measures(words: Column, run: int) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    n = F.size(words)
    stops = F.size(F.filter(words, lambda w: F.array_contains(stop, w)))
    return _let(
        _repeated_words(words, run),
        lambda repeated: F.struct(
            n.alias("n_words"),
            repeated.alias("n_repeated_words"),
            _share(repeated, n).alias("repeated_share"),
            _share(stops, n).alias("stop_word_share"),
        ),
    )


def _line_measures(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    return _let(lines, lambda x: _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))


def repetition_metrics(docs: DataFrame, text_col: str = "text", run: int = RUN_WORDS) -> DataFrame:
    """Every column of ``docs`` plus the measures the thresholds refer to.

    Null, empty and word-free texts: all counts and shares are 0. Texts under
    ``run`` words have no run, so their share is 0. Equal texts get equal
    values; rows are neither dropped nor merged. Input columns named like a
    measure are replaced by the measure. Runs are compared by a 64-bit hash
    within one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    measures = _let(words_of(F.col(text_col)), lambda w: _word_measures(w, run))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    return docs.withColumns(
        {
            "_words": measures,
            "symbol_share": _share(symbols, F.length(text)),
            "repeated_line_share": _line_measures(text),
        }
    ).withColumns(
        {c: F.col("_words")[c] for c in ("n_words", "n_repeated_words", "repeated_share", "stop_word_share")}
    ).drop("_words")


def repetition_flags(
    docs: DataFrame, text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS, run: int = RUN_WORDS
) -> DataFrame:
    """Metrics plus one boolean column ``is_<rule>`` per row of the threshold table."""
    measured = repetition_metrics(docs, text_col, run)
    return measured.withColumns({f"is_{t.name}": t.expression() for t in thresholds})


def repetitive_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ids of the documents that the repeated-run threshold of the table catches.

    Only that rule is compiled, so the measures of the other rules are pruned
    from the plan. A document id that occurs on several rows comes out once.
    """
    rule = next(t for t in THRESHOLDS if t.name == "repeated_runs")
    narrow = docs.select(F.col(id_col), F.col(text_col))
    flagged = repetition_flags(narrow, text_col, (rule,)).filter(F.col(f"is_{rule.name}"))
    return flagged.select(id_col).distinct()
