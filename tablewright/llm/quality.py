"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text and every rule an
integer comparison of two measures, so that no user function runs, no row
moves, and Spark and any SQL engine decide alike.

Defined results: a null text counts as empty; an empty or blank text has no
words and is rejected; a text of one very long word or line is measured like any
other; repeated rows are judged alike; an empty table gives an empty result;
further columns of the input are passed through by ``apply_rules`` untouched
unless they bear the name of a measure, which the measure then replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, only, text_or_empty, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an not "
    "der die und den von zu das sich mit des auf für nicht im ist dem ein eine als auch "
    "de la le et les en un du une que pour est dans qui au par sur pas avec il "
    "el y los las se del por con no su para al es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text when ``low`` <= 1000 * measure / per <= ``high``."""
    name: str
    measure: str
    per: str | None
    low: int | None = None
    high: int | None = None


#: Those two decide ``base_failed``; with per=None the bounds are on the measure itself.
BASE_RULES = (
    Rule("enough words", "n_words", None, low=50),
    Rule("little repetition", "n_repeat_words", "n_words", high=500),
)
RULES = (
    Rule("word length", "word_chars", "n_words", low=3000, high=10000),
    Rule("few symbols", "n_symbols", "n_words", high=100),
    Rule("few capitals", "n_capitals", "word_chars", high=300),
    Rule("stop words", "n_stop_words", "n_words", low=50),
    Rule("few repeated lines", "n_dup_lines", "n_lines", high=400),
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``w``."""
    def window(make):
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                           lambda x, i: make(x, F.get(w, i + 1), F.get(w, i + 2), i))

    def covered(s):  # s: windows and places, sorted, so that equal windows are neighbours
        places = F.filter(
            F.transform(s, lambda x, j: F.when((x["t"] == F.get(s, j - 1)["t"]) | (x["t"] == F.get(s, j + 1)["t"]), x["i"])),
            lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    exact = let(F.array_sort(window(lambda a, b, c, i: F.struct(F.concat_ws(" ", a, b, c).alias("t"), i.alias("i")))), covered)
    return let(window(lambda a, b, c, i: F.xxhash64(a, b, c)),
               lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact))


def measures(text: Column, stop_words=STOP_WORDS) -> Column:
    """One struct of all measures of a text."""
    def without(chars):
        return F.length(text) - F.length(F.translate(text, chars, ""))

    def build(w, lines):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            without(CAPITALS).cast("long").alias("n_capitals"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?"))).isin(*stop_words))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(words(text), lambda w: let(lines, lambda ls: build(w, ls)))


def _holds(rule: Rule, value) -> Column:
    """``rule`` on the measures ``value(name)``; a ratio over nothing holds."""
    x = value(rule.measure)
    scale = 1000 if rule.per else 1
    per = value(rule.per) if rule.per else F.lit(1)
    out = F.lit(True)
    if rule.low is not None:
        out = out & (x * scale >= per * rule.low)
    if rule.high is not None:
        out = out & (x * scale <= per * rule.high)
    return out


def apply_rules(docs: DataFrame, rules=RULES, base_rules=BASE_RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with every measure, ``base_failed`` and ``kept``, in one projection."""
    m = "_quality"
    while m in (c.lower() for c in docs.columns):
        m += "_"
    names = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]

    def verdict(v):
        held = [_holds(r, lambda n: v[n]) for r in base_rules]
        base = held[0]
        for x in held[1:]:
            base = base & x
        kept = base
        for r in rules:
            kept = kept & _holds(r, lambda n: v[n])
        return F.struct(*[v[n].alias(n) for n in names], (~base).alias("base_failed"), kept.alias("kept"))

    judged = docs.withColumn(m, let(measures(text_or_empty(), stop_words), verdict))
    outs = [*names, "base_failed", "kept"]
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c not in outs], *[F.col(f"{m}.{n}").alias(n) for n in outs])


def quality_query(docs: DataFrame) -> DataFrame:
    return apply_rules(only(docs, doc_id="long", text="string")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_capitals", "n_lines", "n_stop_words", "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    per, scale = (r.per, 1000) if r.per else ("1", 1)
    parts = [f"{r.measure} * {scale} >= {per} * {r.low}"] * (r.low is not None)
    parts += [f"{r.measure} * {scale} <= {per} * {r.high}"] * (r.high is not None)
    return "(" + " AND ".join(parts) + ")"


def sql(rules=RULES, base_rules=BASE_RULES, stop_words=STOP_WORDS) -> str:
    """The same rules for DuckDB."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    base = " AND ".join(_rule_sql(r) for r in base_rules)
    more = " AND ".join(_rule_sql(r) for r in rules)
    stops = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, {ws}) <> '') AS ls FROM d
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win) WHERE c > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(trim(x, '.,;:!?')) IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (rid)
)
SELECT *, NOT ({base}) AS base_failed, ({base}) AND {more} AS kept FROM m
"""
