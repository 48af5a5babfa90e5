"""Licence scans by ordered signature rules, in column functions alone.

Rules are tried on a text only if it holds their keywords. Of detections that overlap, one inside another
goes, and of the rest each word belongs to the detection of the first rule; a detection stands if all its
words are its own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.common import stored
from hiremill.llm.licenserules import BASE, Rule, all_rules

#: Digits, letters a-z and everything beyond ASCII; applied after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one letter beyond ASCII whose small form is an ASCII letter; only A-Z are to be lower-cased.
KELVIN = "K"
RULE_TYPE = (
    "array<struct<number: int, label: string, kind: string, confidence: double, gates: array<array<string>>, pattern: string>>"
)


def words_of(text: Column) -> Column:
    """The words of a whole text in order; none for a null."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ĸ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def words_in(text: Column) -> Column:
    """Words of a text in which every word stands between spaces of its own."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def rule_table(rules: Sequence[Rule]) -> Column:
    """All rules as one literal."""
    return F.from_json(F.lit(json.dumps([rule._asdict() for rule in rules])), RULE_TYPE)


def _matches(words: Column, rules: Sequence[Rule]) -> Column:
    """For each match of a rule: rule, its number in the text, words between it and the match before, and its own."""
    keywords = F.array(*[F.lit(w) for w in sorted({w for rule in rules for gate in rule.gates for w in gate})])

    def of_rule(text: Column, rule: Column) -> Column:
        between = F.split(text, rule["pattern"], -1)
        return F.transform(
            F.regexp_extract_all(text, rule["pattern"], F.lit(0)),
            lambda match, k: F.struct(
                rule["number"].alias("rule"), rule["label"].alias("label"), rule["kind"].alias("kind"),
                rule["confidence"].alias("confidence"), k.alias("k"), words_in(F.get(between, k)).alias("gap"),
                words_in(match).alias("words"),
            ),
        )

    def of_text(own: Column, present: Column) -> Column:
        tried = F.filter(rule_table(rules), lambda rule: F.forall(rule["gates"], lambda g: F.arrays_overlap(g, present)))
        text = F.concat(F.lit(" "), F.array_join(own, "  "), F.lit(" "))
        # bound once, not spelled out for every rule
        return F.flatten(F.get(F.transform(F.array(text), lambda t: F.flatten(F.transform(tried, lambda r: F.array(of_rule(t, r))))), F.lit(0)))

    present = F.array_intersect(words, keywords)
    return F.get(F.transform(F.array(present), lambda p: F.when(F.size(p) > 0, of_text(words, p))), F.lit(0))


def _with_matches(docs: DataFrame, text: str, keep: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """A stored table of row_id, n_words, matches and the kept columns, one row per document."""
    found = F.transform(
        F.array(words_of(F.col(text))),
        lambda own: F.struct(F.size(own).cast("long").alias("n_words"), _matches(own, rules).alias("matches")),
    )
    rows = docs.select(*[F.col(c) for c in keep], F.get(found, F.lit(0)).alias("found_"))
    return stored(
        rows.select(*keep, F.monotonically_increasing_id().alias("row_id"), "found_.n_words", "found_.matches"), "license-rows"
    )


def _resolved(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per match with its place, and whether it stands."""
    each = rows.where(F.size("matches") > 0).select("row_id", *carried, F.inline("matches"))
    before = Window.partitionBy("row_id", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn(
        "first_word", (F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("words")).over(before), F.lit(0))).cast("long")
    ).withColumn("end_word", F.col("first_word") + F.col("words"))
    wider = Window.partitionBy("row_id").orderBy("first_word", F.desc("end_word"), "rule")
    inside = F.max("end_word").over(wider.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("end_word")
    marked = placed.withColumn("inside", F.coalesce(inside, F.lit(False)))
    place = F.struct("rule", "first_word")
    each_word = marked.where("not inside").select(
        "row_id", place.alias("place"), F.explode(F.sequence("first_word", F.col("end_word") - 1)).alias("word")
    )
    own = F.min("place").over(Window.partitionBy("row_id", "word")) == F.col("place")
    standing = (
        each_word.withColumn("own", own).groupBy("row_id", "place").agg(F.min("own").alias("stands"))
        .select("row_id", "place.rule", "place.first_word", "stands")
    )
    return (
        marked.drop("k", "gap", "inside").join(standing, ["row_id", "rule", "first_word"], "left")
        .withColumn("stands", (F.col("kind") == "base") | F.coalesce("stands", F.lit(False)))
    )


def detections(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per standing detection: the columns of `keep`, label, kind, confidence, first_word, words.

    Matches of one rule are leftmost and do not overlap. Texts are taken whole. Matches of the base
    phrases stand whatever overlaps them. The columns of `keep` may have any names.
    """
    packed = docs.select(F.col(text).alias("text"), F.struct(*[F.col(c) for c in keep]).alias("kept_"))
    rows = _with_matches(packed, "text", ["kept_"], all_rules() if rules is None else rules)
    return _resolved(rows, ["kept_"]).where("stands").select(
        "kept_.*", "label", "kind", "confidence", "first_word", F.col("words").cast("long").alias("words")
    )


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases, first_word and last_word are the first and last of
    them. labels are those of all detections that stand, score the confidence of the surest. Defined cases: a null
    or empty text has no word, no label, null places and score 0; a null id stays null; repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored.
    """
    rows = _with_matches(docs.select("doc_id", "text"), "text", ["doc_id"], all_rules() if rules is None else rules)
    base = F.col("kind") == "base"

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = _resolved(rows, ["doc_id", "n_words"]).groupBy("row_id", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("stands")).alias("labels"),
        F.max(F.when(F.col("stands"), F.col("confidence"))).alias("score"),
    )
    none = rows.where("coalesce(size(matches), 0) <= 0").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )
    return found.drop("row_id").unionByName(none)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle() -> str:
    """The scan in SQL, from the same rules."""
    rules = ",\n".join(
        f"({r.number}, {_quoted(r.label)}, {_quoted(r.kind)}, {r.confidence}::DOUBLE, "
        f"[{', '.join('[' + ', '.join(map(_quoted, g)) + ']' for g in r.gates)}], {_quoted(r.pattern)})"
        for r in all_rules()
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(rule, label, kind, confidence, gates, pattern) AS (VALUES
{rules}),
docs AS (SELECT row_number() OVER () AS row_id, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
tried AS (SELECT row_id, ' ' || array_to_string(words, '  ') || ' ' AS t, rules.*
  FROM docs JOIN rules ON len(list_filter(gates, lambda g: NOT list_has_any(words, g))) = 0),
matched AS (SELECT row_id, rule, label, kind, confidence, regexp_extract_all(t, pattern) AS matches,
  regexp_split_to_array(t, pattern) AS gaps FROM tried),
each AS (SELECT row_id, rule, label, kind, confidence, k,
  length(replace(gaps[k], ' ', '')) AS x, (length(gaps[k]) - length(replace(gaps[k], ' ', ''))) // 2 AS gap,
  (length(matches[k]) - length(replace(matches[k], ' ', ''))) // 2 AS words
  FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS k FROM matched)),
placed AS (SELECT *, gap + coalesce(sum(gap + words) OVER (PARTITION BY row_id, rule ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word FROM each),
marked AS (SELECT *, coalesce(max(first_word + words) OVER (PARTITION BY row_id ORDER BY first_word, first_word + words DESC, rule
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) >= first_word + words AS inside FROM placed),
lost AS (SELECT DISTINCT row_id, rule, first_word FROM (
  SELECT *, min(struct_pack(a := rule, b := first_word)) OVER (PARTITION BY row_id, word) <> struct_pack(a := rule, b := first_word) AS other
  FROM (SELECT *, unnest(range(CAST(first_word AS BIGINT), CAST(first_word + words AS BIGINT))) AS word FROM marked WHERE NOT inside))
  WHERE other),
stood AS (SELECT marked.*, kind = 'base' OR (NOT inside AND lost.rule IS NULL) AS stands
  FROM marked LEFT JOIN lost USING (row_id, rule, first_word)),
summed AS (SELECT row_id, count_if(kind = 'base') AS n_base, min(first_word) FILTER (kind = 'base') AS first_word,
  max(first_word) FILTER (kind = 'base') AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands) AS labels, max(confidence) FILTER (stands) AS score
  FROM stood GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN summed USING (row_id)
"""
