"""License scans by diagonal voting.

Every pair of neighbouring words of every text is hashed, exploded, and joined to the places where templates have that
pair. A hit votes for a diagonal: its place in the text minus its place in the template. Words that a text has in the
same order as a template thus vote for one diagonal; a word more or less in between moves the rest to a neighbouring
one, so each diagonal is merged with those within its template's reach. A merged span is verified by its coverage: the
share of the template's pairs, each counted once however often the text repeats it, that stand within that reach of
their place. So no span is longer than its template and the reach on both sides, whatever stands around it. Of spans
that overlap the best stays. Hits compare words, not only hashes, so there are no chance hits.

Short phrases are templates like the others; they need all their pairs on one diagonal.

Only DataFrame functions are used. The templates are a parameter, and the join broadcasts their pairs only up to
MOST_PAIRS. Texts are read once and never shuffled: hits carry doc_id and a hash of the text, and each text also has one
hit of its own, on a template that stands for its number of words, so that texts without hits stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What separates words, after A-Z have become lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that become an ASCII letter in lower case though they aren't ASCII: texts with them take the slow way.
ODD = ("\u0130", "\u212a")
MOST_PAIRS = 50_000
#: Share of a template's pairs that a span must hold.
COVERAGE = 0.6
#: Words that a pair may stand before or after its place, the largest that is at most a quarter of the template's pairs;
#: they divide SCALE, so that one range of scaled diagonals fits all templates.
REACHES, SCALE = (2, 3, 4, 6, 8, 12), 24


@dataclass(frozen=True)
class Template:
    """words: joined by spaces. exact: every pair on one diagonal (a phrase), else a notice that may be reworded."""

    label: str
    words: str
    exact: bool


PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Opening or operative sentences of public licence texts.
NOTICES = [
    Template(label, words, False)
    for label, words in (
        ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
        ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
        ("gpl-3.0-grant", "this work is licensed under the gnu general public license version 3"),
        ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
        ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
        ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
        ("cc-by-nc", "licensed under cc by nc 4 0"),
        ("apache-2.0-grant", "licensed under the apache license version 2 0"),
        ("mit-grant", "released under the mit license"),
        ("apache-2.0-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
        ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
        ("agpl-notice", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
        ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
        ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
        ("bsd-3-names", "may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
        ("boost-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
        ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
        ("epl-2.0-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
        ("cc-by-sa-notice", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
        ("cc-by-nc-notice", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
        ("cc0-notice", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
        ("gfdl-notice", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    )
]


def template_pairs(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(h, t_first, t_second, template, t_pos) for each pair of neighbouring words, and the sentinel, template -1."""
    rows = [(n, i, a, b) for n, t in enumerate(templates) for w in [t.words.split()] for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"{len(rows)} pairs of template words; {MOST_PAIRS} at most are broadcast")
    pairs = spark.createDataFrame([*rows, (-1, 0, "", "")], "template int, t_pos int, t_first string, t_second string")
    return pairs.withColumn("h", F.xxhash64("t_first", "t_second"))


def spans(df: DataFrame, templates: list[Template], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans: (id, text_hash, copies, n_words, template, first, end, coverage), first and end in words.

    Rows of equal id and text are one (copies: how many). Every such row also has one with template -1 and no span, so
    none is lost: null and empty texts have just that, with n_words 0.
    """
    lower = "abcdefghijklmnopqrstuvwxyz"
    plain = F.coalesce(common.quoted(text).cast("string"), F.lit(""))
    odd = F.col("plain").contains(ODD[0]) | F.col("plain").contains(ODD[1])
    low = F.when(odd, F.translate("plain", lower.upper(), lower)).otherwise(F.lower("plain"))
    words = df.select(common.quoted(id).alias("id"), plain.alias("plain")).select(
        "id", F.xxhash64("plain").alias("text_hash"), F.filter(F.split(low, SEPARATORS), lambda w: w != "").alias("words")
    )
    n = F.size("words")
    starts = F.sequence(F.lit(-1), F.greatest(n - 2, F.lit(-1)))  # -1 is the sentinel
    hits = words.select("id", "text_hash", "words", n.alias("n_words"), F.explode(starts).alias("pos"))
    first = F.when(F.col("pos") < 0, "").otherwise(F.get("words", F.col("pos")))
    second = F.when(F.col("pos") < 0, "").otherwise(F.get("words", F.col("pos") + 1))
    hits = hits.select("id", "text_hash", "n_words", "pos", first.alias("a"), second.alias("b"))
    pairs = F.broadcast(template_pairs(df.sparkSession, templates))
    same = (F.xxhash64("a", "b") == pairs.h) & (F.col("a") == pairs.t_first) & (F.col("b") == pairs.t_second)
    hits = hits.join(pairs, same)
    unit = ["id", "text_hash"]
    diagonal = (F.col("pos") - F.col("t_pos")).alias("diagonal")
    votes = hits.groupBy(*unit, "template", diagonal).agg(
        F.count("*").alias("votes"),
        F.collect_set("t_pos").alias("places"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.max("n_words").alias("n_words"),
    )
    of = templates_frame(df.sparkSession, templates)
    votes = votes.join(F.broadcast(of), "template").withColumn("scaled", F.col("diagonal") * F.col("scale"))
    copies = F.max(F.when(F.col("template") < 0, F.col("votes"))).over(_window(unit))
    votes = votes.withColumn("copies", copies)
    # what may be verified: diagonals that have, with those in reach, pairs enough; and those in reach of one of these
    reach = _window([*unit, "template"]).orderBy("scaled").rangeBetween(-SCALE, SCALE)
    most = F.when(F.col("exact"), F.size("places")).otherwise(F.sum(F.size("places")).over(reach))
    votes = votes.withColumn("live", (most >= F.when(F.col("exact"), F.col("pairs")).otherwise(F.col("least"))).cast("int"))
    votes = votes.withColumn("wanted", F.max("live").over(reach)).where("wanted = 1")
    merged = lambda c: F.when(F.col("exact"), F.col(c))  # noqa: E731  a phrase's diagonals stay apart
    held = F.when(F.col("exact"), F.size("places")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("places").over(reach)))))
    votes = votes.select(
        *unit, "template", "copies", "n_words", "exact", "pairs", "scaled", "live", "least",
        held.alias("held"),
        merged("first").otherwise(F.min("first").over(reach)).alias("first"),
        (merged("last").otherwise(F.max("last").over(reach)) + 2).alias("end"),
    ).where("live = 1 and held >= least")
    rank = F.struct("held", -F.col("scaled"))
    votes = votes.withColumn("best", F.col("exact") | (rank == F.max(rank).over(reach))).where("best")
    return votes.select(*unit, "copies", "n_words", "template", "first", "end", (F.col("held") / F.col("pairs")).alias("coverage"))


def reach_of(pairs: int) -> int:
    """How far a pair may stand from its place."""
    return max([r for r in REACHES if 4 * r <= pairs], default=REACHES[0])


def templates_frame(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = []
    for i, t in enumerate(templates):
        pairs = len(t.words.split()) - 1
        least = pairs if t.exact else math.ceil(COVERAGE * pairs - 1e-9)
        rows.append((i, t.label, t.exact, pairs, least, SCALE // reach_of(pairs)))
    return spark.createDataFrame([*rows, (-1, None, True, 1, 1, 1)], "template int, label string, exact boolean, pairs int, least int, scale int")


def _window(columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan(df: DataFrame, templates: list[Template] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start (null without
    any), base_labels their labels, labels those of all verified spans, score the best coverage (0 without spans), and
    spans lists (label, first, end, coverage); of two equally good spans in reach of each other the first stays. Null and
    empty texts have no words and empty labels; very long texts are read whole; repeated rows give repeated rows; null ids
    stay null; an empty table gives an empty table. Columns other than id and text are not read; the id may not be called
    like one of the results.
    """
    if id.lower() in RESULTS:
        raise ValueError(f"the id is called like a result: {id}")
    templates = PHRASES + NOTICES if templates is None else templates
    found = spans(df, templates, id, text).join(F.broadcast(templates_frame(df.sparkSession, templates)), "template")
    base = F.col("exact") & (F.col("template") >= 0)
    labels = lambda when: F.concat_ws(",", F.sort_array(F.collect_set(F.when(when, F.col("label")))))
    real = F.col("template") >= 0
    rows = found.groupBy("id", "text_hash").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(real, F.struct("first", "end", "label", "coverage")))).alias("spans"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.withColumn("copy", copies).drop("text_hash", "copies", "copy").withColumnRenamed("id", id)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    """The same rows without votes: phrases are compared word by word, and notices by the definition of their coverage,
    the distinct pairs near their places, for each place of the text that a pair of the notice could make its start."""
    phrase = " UNION ALL ".join(
        f"SELECT id, '{t.label}' AS label, i - 1 AS p FROM (SELECT id, w, unnest(generate_series(1, len(w) - {len(x) - 1})) AS i FROM d WHERE len(w) >= {len(x)}) "
        f"WHERE {' AND '.join(f'w[i + {j}] = ' + repr(y) for j, y in enumerate(x))}"
        for t in PHRASES
        for x in [t.words.split()]
    )
    pairs = ", ".join(
        f"({n}, '{t.label}', {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}', {reach_of(len(w) - 1)})"
        for n, t in enumerate(NOTICES) for w in [t.words.split()] for i in range(len(w) - 1)
    )
    return rf"""
        WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        base AS ({phrase}),
        b AS (SELECT id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY id),
        t(n, label, pairs, tp, a, b, reach) AS (VALUES {pairs}),
        g AS (SELECT id, i - 1 AS p, w[i] AS a, w[i + 1] AS b FROM (SELECT id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
        h AS (SELECT id, n, label, pairs, reach, tp, p FROM g JOIN t USING (a, b)),
        hold AS (SELECT id, n FROM h GROUP BY id, n, pairs HAVING count(DISTINCT tp) >= {COVERAGE} * pairs),
        l AS (SELECT h.* FROM h JOIN hold USING (id, n)),
        starts AS (SELECT DISTINCT id, n, p - tp AS start FROM l),
        m AS (SELECT s.id, any_value(l.label) AS label, count(DISTINCT l.tp)::DOUBLE / any_value(l.pairs) AS c FROM starts s
              JOIN l ON l.id = s.id AND l.n = s.n AND l.p BETWEEN s.start + l.tp - l.reach AND s.start + l.tp + l.reach
              GROUP BY s.id, s.n, s.start HAVING count(DISTINCT l.tp) >= {COVERAGE} * any_value(l.pairs)),
        a AS (SELECT id, label, 1.0::DOUBLE AS c FROM base UNION ALL SELECT id, label, c FROM m),
        al AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM a GROUP BY id)
        SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
               last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN b ON b.id = d.id LEFT JOIN al ON al.id = d.id"""


QUERIES = {"op2_license_scan": op2_license_scan}


def oracles() -> dict[str, str]:
    return {"op2_license_scan": _oracle()}
