"""Licence scans: exact set-similarity join of text blocks with notice templates (operator 8).

Only DataFrame operations. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered.

*Phrases* (base): places where a phrase's words stand consecutively.

*Templates*: a text block is a line, or each window of 64 words (32 apart) of
a longer line or, across its lines, of the whole text. It matches a template when it holds at least ``percent`` per cent of the
template's distinct words and, where marks are given, every word that tells its label from
the others (``lesser``, ``nc``, ``sa``...). The join that finds every such block orders the template
words by their frequency in all documents, rarest first, and uses

- the prefix filter: a match holds one of the template's |T| - a + 1 rarest
  words, a being the words it needs; documents without any such word are never cut into blocks
- the length filter: the block has at least a template words
- the positional filter: from the first common word on, both have enough words left

and then counts the words that both have and looks for the marks. Templates are a parameter of bounded size; their
words are all that is broadcast, and one count per template word reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PERCENT = 80
WINDOW, STEP = 64, 32

# Phrases with their labels, and notice texts with theirs (32 distinct words at most).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
)
#: Words that a label's templates may not go without, where they hold them: what sets them apart from notices that share most words.
MARKS = {"apache": ("apache",), "mit": ("mit",), "gpl": ("general",), "lgpl": ("lesser",), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "cc0": ("cc0",),
         "mpl": ("mozilla",)}


def lowered(text: Column) -> Column:
    """ASCII capitals only; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def normal(text: Column) -> Column:
    """Words of lowered text with one space between them."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _holds(norm: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {phrase} ")


def phrase_starts(norm: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins; words are looked at only where the text holds the phrase at all."""
    parts = phrase.split(" ")
    # the array is bound once, by the outer transform over a single element
    found = F.transform(F.array(words(norm)), lambda a: F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(a) - len(parts), F.lit(0))),
        lambda i: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]),
                           lambda x: F.coalesce(F.get(a, i + x["k"]) == x["p"], F.lit(False)))))[0]
    return F.when(_holds(norm, phrase), found).otherwise(F.array().cast("array<int>"))


def template_rows(templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, words needed at 100 per cent) of every template."""
    out = []
    for number, (label, text) in enumerate(templates):
        distinct = list(dict.fromkeys(re.sub(NOT_WORD, " ", text.lower()).split()))
        if not distinct or len(distinct) > STEP:
            raise ValueError(f"a template has 1 to {STEP} distinct words")
        out.append((number, label, distinct, len(distinct)))
    return out


def _marks(marks: Mapping[str, Sequence[str]], label: str, distinct: list[str]) -> list[str]:
    return [w for w in marks.get(label, ()) if w in distinct]


def template_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT,
                     marks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(doc_id, text_hash, block, template, label, containment): every block that meets the threshold and holds the template's marks.

    Lines and windows count from 0; where a document has several lines, its whole text comes after them as one more.
    """
    spark = docs.sparkSession
    rows = template_rows(templates)
    vocabulary = sorted({w for _, _, distinct, _ in rows for w in distinct})
    base = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    counts = {r["w"]: r["n"] for r in base.select(F.explode(words(normal(F.col("low")))).alias("w")).where(F.col("w").isin(vocabulary))
              .groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row a template word
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    table, prefix = [], []
    for number, label, distinct, size in rows:
        need = -(-percent * size // 100)
        ordered = sorted(distinct, key=rank.__getitem__)
        table.append((number, label, ordered, size, need, _marks(marks or {}, label, distinct)))
        prefix += [(w, number, i, size, need) for i, w in enumerate(ordered[:size - need + 1])]
    rare = sorted({p[0] for p in prefix})
    fewest = min(t[4] for t in table)
    prefixes = spark.createDataFrame(prefix, "w string, template int, i int, size int, need int")
    sets = spark.createDataFrame(table, "template int, label string, set array<string>, size int, need int, marks array<string>").drop("size", "need")
    ordered_words = F.array(*map(F.lit, order))
    norm = normal(F.col("low"))
    some = base.where(F.concat(F.lit(" "), norm, F.lit(" ")).rlike(" (?:" + "|".join(map(re.escape, rare)) + ") "))
    lines = some.select("doc_id", F.xxhash64("low").alias("text_hash"), F.posexplode(F.concat(
        F.split("low", "\n"), F.when(F.col("low").contains("\n"), F.array("low")).otherwise(F.array().cast("array<string>")))).alias("line", "text"))
    lines = lines.select("doc_id", "text_hash", "line", words(normal(F.col("text"))).alias("w")).where(F.size("w") >= fewest)
    blocks = lines.select("doc_id", "text_hash", "line", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - WINDOW) / STEP).cast("int"))),
        lambda k: F.slice(F.col("w"), k * STEP + 1, F.lit(WINDOW)))).alias("window", "w"))
    # the block's template words, rarest first
    blocks = blocks.select("doc_id", "text_hash", "line", "window", F.array_intersect(ordered_words, F.col("w")).alias("b")).where(F.size("b") >= fewest)
    pairs = (blocks.select("*", F.posexplode("b").alias("j", "w")).join(F.broadcast(prefixes), "w")
             .where((F.size("b") >= F.col("need"))
                    & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("need"))))
    checked = (pairs.join(F.broadcast(sets), "template")
               .withColumn("both", F.size(F.array_intersect("b", "set"))).where((F.col("both") >= F.col("need")) & (F.size(F.array_except("marks", "b")) == 0)))
    return (checked.groupBy("doc_id", "text_hash", "line", "window", "template", "label")
            .agg((F.max("both") / F.first("size")).alias("containment")))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
         percent: int = PERCENT, marks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per document: n_words, phrase places, labels and score.

    ``marks`` are words that a label's templates may not go without (the query takes ``MARKS``).

    ``score`` is 1 with a phrase, else the best containment, else 0. A null or
    empty text has no words. Repeated rows each get their row; a null id is an
    id like others; other columns are not carried; an empty table gives no rows.
    """
    base = docs.select("doc_id", lowered(F.col("text")).alias("low")).select("doc_id", F.xxhash64("low").alias("text_hash"), normal(F.col("low")).alias("norm"))
    starts = base.select("doc_id", "text_hash", F.when(F.col("norm") == "", 0).otherwise(
        F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).cast("bigint").alias("n_words"),
        *(phrase_starts(F.col("norm"), p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)))
    places = F.concat(*(F.col(f"p{k}") for k in range(len(phrases))))
    found = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))),
                                                   lambda x: x.isNotNull())))
    own = starts.select("doc_id", "text_hash", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"),
                        F.array_max(places).cast("bigint").alias("last_word"), found.alias("base"))
    matched = (template_matches(docs, templates, percent, marks).groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
               .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))  # a label a template at most
    out = own.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                      F.array_join(every, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, percent: int = PERCENT,
               marks: Mapping[str, Sequence[str]] | None = None) -> str:
    """DuckDB SQL that tests every block with every template and every word with every phrase."""
    def quoted(xs):
        return "[" + ", ".join("'" + x + "'" for x in xs) + "]::varchar[]"

    values = ", ".join(f"({n}, '{label}', {quoted(distinct)}, {size}, {quoted(_marks(marks or {}, label, distinct))})" for n, label, distinct, size in template_rows(templates))
    tests = ", ".join("list_filter(range(0, greatest(len(w) - {n} + 1, 0)), lambda i: {t})".format(
        n=len(p.split()), t=" and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))) + f" as p{i}" for i, (p, _) in enumerate(phrases))
    places = " || ".join(f"p{k}" for k in range(len(phrases)))
    found = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(phrases)) + "], lambda x: x is not null)))"
    split = "list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with templates(number, label, words, size, marks) as (values {values}),
docs as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
tokens as (select r, doc_id, {split.format('low')} as w from docs),
phrases as (select r, doc_id, len(w) as n_words, {tests} from tokens),
lines as (select r, unnest(string_split(low, chr(10)) || case when contains(low, chr(10)) then [low] else [] end) as line from docs where low like '%' || chr(10) || '%' or low <> ''),
line_words as (select r, {split.format('line')} as w from lines),
blocks as (select r, list_slice(w, k * {STEP} + 1, k * {STEP} + {WINDOW}) as w from
  (select r, w, unnest(range(0, greatest(0, cast(ceil((len(w) - {WINDOW}) / {STEP}.0) as bigint)) + 1)) as k from line_words)),
matched as (select r, label, len(list_intersect(b.w, t.words)) / size as c from blocks b, templates t
  where len(list_intersect(b.w, t.words)) * 100 >= {percent} * size and len(list_intersect(b.w, t.marks)) = len(t.marks)),
more as (select r, list(distinct label) as labels, max(c) as best from matched group by r)
select doc_id, cast(n_words as bigint) as n_words, cast(len({places}) as bigint) as n_base, cast(list_min({places}) as bigint) as first_word,
  cast(list_max({places}) as bigint) as last_word, coalesce(array_to_string({found}, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct({found} || coalesce(labels, []))), ','), '') as labels,
  cast(case when len({places}) > 0 then 1.0 else coalesce(best, 0.0) end as double) as score
from phrases left join more using (r)"""
