"""Quality rules: a table of thresholds compiled into one Spark projection without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus' four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "as", "with", "be", "by", "this", "have", "or",
    "le", "la", "les", "de", "des", "un", "une", "et", "que", "qui", "dans", "pour", "par", "sur", "pas", "au", "avec", "il", "elle",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "dem", "auf", "für", "sich",
    "el", "los", "las", "del", "y", "en", "es", "por", "con", "para", "una", "se", "no", "su", "lo",
]


@dataclass(frozen=True)
class Rule:
    """Metric ``metric`` must lie within [low, high]; None is open. The metric is a value of ``metrics``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The verdict beside the base rules. Bounds are wide: prose of any length and language passes.
RULES = [
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("marks_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("open_line_ratio", None, 0.5),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words within windows of ``width`` words that are found twice or more."""
    windows = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        def places(rows: Column) -> Column:
            same = lambda i, j: F.get(rows, i)["h"] == F.get(rows, j)["h"]
            twice = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda i: F.get(rows, i)["i"]))

        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.aggregate(let(ranked, places), start, step, lambda acc: acc["n"]))

    return let(windows, covered)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def removed(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def metrics(text: Column) -> dict[str, Column]:
    """Every metric that rules can name, as expressions of ``text`` (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    inked = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    lines = let(inked, lambda x: F.struct(
        F.size(x).cast("long").alias("n"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
        F.size(F.filter(x, lambda s: s.rlike("^[ \\t-\\r]*[-*•]"))).cast("long").alias("bullet"),
        F.size(F.filter(x, lambda s: s.rlike("(\\.\\.\\.|…)[ \\t-\\r]*$"))).cast("long").alias("open"),
    ))
    words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        repeated_words(w).alias("repeat"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop"),
    ))
    return {"words": words, "lines": lines, "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"), "n_symbols": removed(text, "#*$%&|<>"), "n_marks": removed(text, "!?")}


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``failed`` (names of the rules
    broken), ``base_failed`` and ``kept``.

    A null or empty text has no words, fails the base and isn't kept. Rows are judged one by one, so that
    repeated rows get equal verdicts; other columns pass through whatever their names, those of the new names are replaced.
    """
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    made = docs.withColumns({f"{own}{k}": v for k, v in metrics(F.col("text")).items()})
    n, c = F.col(f"{own}words.n"), F.col(f"{own}words.repeat")
    value = {
        "mean_word_chars": ratio(F.col(f"{own}word_chars"), n),
        "symbols_per_word": ratio(F.col(f"{own}n_symbols"), n),
        "marks_per_word": ratio(F.col(f"{own}n_marks"), n),
        "stop_word_ratio": ratio(F.col(f"{own}words.stop"), n),
        "dup_line_ratio": ratio(F.col(f"{own}lines.dup"), F.col(f"{own}lines.n")),
        "bullet_line_ratio": ratio(F.col(f"{own}lines.bullet"), F.col(f"{own}lines.n")),
        "open_line_ratio": ratio(F.col(f"{own}lines.open"), F.col(f"{own}lines.n")),
        "n_words": n,
    }
    broken = [F.when(F.lit(False) if r.low is None else value[r.metric] < r.low, F.lit(f"{r.metric} below {r.low}")).when(F.lit(False) if r.high is None else value[r.metric] > r.high, F.lit(f"{r.metric} above {r.high}")) for r in rules]
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    base = (n < least_words) | (100 * c > repeat_percent * n)
    new = {"n_words": n, "word_chars": F.col(f"{own}word_chars"), "n_symbols": F.col(f"{own}n_symbols"), "n_dup_lines": F.col(f"{own}lines.dup"), "n_repeat_words": c, "failed": failed, "base_failed": base, "kept": ~base & (F.size(failed) == 0)}
    out = made.withColumns(new)
    return out.drop(*[x for x in out.columns if x.startswith(own)])
