"""Op 6: quality rules: a threshold table compiled into one Spark projection.

All statistics are built-in functions of the row's whole text: no user
function, no shuffle.  ``RULES`` is the table; ``compile_rules`` turns it into
boolean columns of one ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, quoted

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Frequent function words of English, French, German and Spanish, and these languages' codes.
STOP_LANGS = ("en", "eng", "fr", "fra", "fre", "de", "deu", "ger", "es", "spa")
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "with",
    "this", "be", "at", "or", "from", "by", "an", "not", "have", "has",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour",
    "pas", "sur", "au", "avec", "il", "elle",
    "der", "die", "das", "den", "dem", "und", "ist", "von", "zu", "mit", "auf", "sich", "ein",
    "eine", "nicht", "auch", "als", "im", "für",
    "el", "los", "las", "y", "en", "con", "por", "para", "se", "del", "no", "una", "su", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` once ``n_words >= from_words``.

    Statistics are named; a missing denominator is 1.  A document with a zero
    denominator passes, and so does one of a null or another language than
    ``langs``, if these are given.
    """
    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    langs: tuple[str, ...] = ()


RULES = (
    Rule("length", "n_words", low=MIN_WORDS),
    Rule("mean_word_length", "word_chars", "n_words", low=1.5, high=25.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05, from_words=50, langs=STOP_LANGS),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more."""
    n = F.size(words)

    def window(i):
        return F.xxhash64(*[words[i + k] for k in range(WINDOW)])

    def covered(hashes):
        # Sorted by (hash, place), a repeated window stands next to its like.
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s):
            last = F.size(s) - 1
            same = F.filter(s, lambda x, i: F.when(i > 0, s[i - 1]["h"] == x["h"])
                            .otherwise(False)
                            | F.when(i < last, s[i + 1]["h"] == x["h"]).otherwise(False))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def length(p):
            end = F.size(p) - 1
            steps = F.transform(p, lambda x, i: F.when(i < end, F.least(
                F.lit(WINDOW), p[i + 1] - x)).otherwise(F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _bind(_bind(tagged, places), length)

    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), window)
    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))
                  .otherwise(F.lit(0)))
    return F.when(n >= WINDOW, found).otherwise(F.lit(0))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a one-element array's variable)."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> Column:
    """Struct of the whole text's statistics (null text: all zero)."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def of_words(w):
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint")
            .alias("n_stop_words"))

    return F.struct(
        _bind(words, of_words).alias("w"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"))


STATISTICS = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols",
              "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words",
              "n_stop_words": "w.n_stop_words", "n_lines": "l.n_lines"}


def stat(q: Column, name: str) -> Column:
    for part in STATISTICS[name].split("."):
        q = q[part]
    return q


def _language(docs: DataFrame, lang: str) -> Column:
    """The primary part of the language tag in lower case (``en`` of ``en-GB``); null if there is none."""
    if lang not in docs.columns:
        return F.lit(None).cast("string")
    return F.lower(F.regexp_extract(F.col(f"`{lang}`"), "^[A-Za-z]+", 0))


def compile_rules(rules: Sequence[Rule], q: Column, lang: Column) -> dict[str, Column]:
    """Rule name -> boolean column over the statistics struct ``q`` and the row's language."""
    out = {}
    for r in rules:
        under = stat(q, r.denominator) if r.denominator else F.lit(1)
        # Products instead of quotients: exact, and a zero denominator passes.
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & ((stat(q, r.numerator) >= F.lit(r.low) * under) | (under == 0))
        if r.high is not None:
            ok = ok & ((stat(q, r.numerator) <= F.lit(r.high) * under) | (under == 0))
        out[r.name] = ok | (stat(q, "n_words") < r.from_words)
        if r.langs:
            out[r.name] = out[r.name] | ~F.coalesce(lang.isin(*r.langs), F.lit(False))
    return out


def _base_failed(q: Column) -> Column:
    return ((stat(q, "n_words") < MIN_WORDS)
            | (100 * stat(q, "n_repeat_words") > MAX_REPEAT_PERCENT * stat(q, "n_words")))


def _kept(q: Column, rules: Sequence[Rule], lang: Column) -> Column:
    kept = ~_base_failed(q)
    for ok in compile_rules(rules, q, lang).values():
        kept = kept & ok
    return kept


def quality_verdicts(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
                     keep: Sequence[str] = ("doc_id",), lang: str = "lang") -> DataFrame:
    """``keep`` columns, the statistics, ``base_failed``, ``kept`` and ``failed_rules``.

    Null and empty texts have zero words and fail.  One row per input row; no
    shuffle.  Columns of ``docs`` that share a name with the result matter only
    if they are in ``keep``.  Rules of some languages need the column ``lang``.
    """
    same, name = quoted(keep), free_name(docs, "_q")
    code = free_name(docs, "_lang")
    staged = docs.select(*same, statistics(F.col(text)).alias(name), _language(docs, lang).alias(code))
    q, spoken = F.col(name), F.col(code)
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name))
                                       for name, ok in compile_rules(rules, q, spoken).items()]))
    return staged.select(*same, *[stat(q, name).alias(name) for name in STATISTICS],
                         _base_failed(q).alias("base_failed"), _kept(q, rules, spoken).alias("kept"),
                         failed.alias("failed_rules"))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
              lang: str = "lang") -> DataFrame:
    """The rows whose verdict is ``kept``, all columns unchanged.

    The verdict is one bound expression: pushed into a filter, it still
    computes the statistics once per row.
    """
    return docs.where(_bind(statistics(F.col(text)), lambda q: _kept(q, rules, _language(docs, lang))))
