"""Licence scans by a positional rare-token index, in DataFrame functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. The index posts, for each
licence template, its ``RARE`` words of highest inverse document frequency in the corpus with their positions.
Every posted word that a file holds is looked up; postings that agree on the relative position of two
words (or all, if a template posts fewer) make a candidate. A candidate is verified in place: the template's
mandatory phrases must stand at their positions, and ``MIN_SCORE`` of all its words must agree.

Besides, *base* phrases count wherever their words stand consecutively.

Defined results: a null or wordless text has no words, no labels and score 0; repeated rows have equal
results; a null id is a row like others; equally frequent words go by the alphabet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.durable import durable

RARE = 3
MIN_SCORE = 0.8

# Phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, the words of a notice or of the opening of a licence, mandatory phrases.
TEMPLATES = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("apache-2.0-notice", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0-notice", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "sublicense and or sell copies", "substantial portions of the software", "without warranty of any kind"),
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties", "tortious action"),
    ),
    (
        "bsd-2-clause-full",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "procurement of substitute goods"),
    ),
    (
        "unlicense-full",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        ("free and unencumbered software", "dedicate any and all copyright interest", "overt act of relinquishment in perpetuity"),
    ),
)

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def base_hits(words: Column, phrases=BASE_PHRASES) -> Column:
    """``at, label`` for all places where a base phrase's words stand consecutively."""
    none = F.array().cast("array<struct<at:int,label:string>>")

    def hits(q: list[str], label: str) -> Column:
        here = lambda i: F.coalesce(reduce(Column.__and__, [F.get(words, i + k) == x for k, x in enumerate(q)]), F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        has = reduce(Column.__and__, [F.array_contains(words, x) for x in sorted(set(q))])
        return F.when(has, F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))).otherwise(none)

    return F.concat(*[hits(phrase.split(), label) for phrase, label in phrases])


def document_frequencies(worded: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts each licence word stands; as many numbers as the templates have words."""
    found = worded.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, words)))).alias("w"))
    return {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}


def index(frequencies: dict[str, int], templates=TEMPLATES, rare: int = RARE) -> list[tuple[str, int, int, int, int]]:
    """Postings: word, its frequency, template number, position, words that must agree."""
    out = []
    for n, (_, text, _) in enumerate(templates):
        w = text.split()
        picked = sorted(set(w), key=lambda x: (frequencies.get(x, 0), x))[:rare]
        out += [(x, frequencies.get(x, 0), n, p, min(2, len(picked))) for p, x in enumerate(w) if x in picked]
    return out


def _template_rows(templates) -> list[tuple]:
    out = []
    for n, (label, text, phrases) in enumerate(templates):
        w = text.split()
        must = []
        for p in phrases:
            q = p.split()
            must.append((next(i for i in range(len(w)) if w[i : i + len(q)] == q), q))
        out.append((n, label, w, must))
    return out


def candidates(files: DataFrame, postings: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """``did, th, template, shift``: where postings of a file's licence words agree. ``files`` has its words."""
    spark = files.sparkSession
    looked = F.array(*[F.lit(w) for w in sorted({p[0] for p in postings})])  # bounded by the templates, so none is left out
    places = files.select("did", "th", F.posexplode("words").alias("at", "w")).where(F.array_contains(looked, F.col("w")))
    posted = spark.createDataFrame(postings, "w string, f long, template int, p int, need int")
    met = places.join(F.broadcast(posted), "w")  # the postings are the templates' own, a fixed few
    agree = met.groupBy("did", "th", "template", (F.col("at") - F.col("p")).alias("shift"), "need").agg(F.count_distinct("w").alias("n"))
    return agree.where("n >= need").select("did", "th", "template", "shift")


def verified(found: DataFrame, files: DataFrame, templates=TEMPLATES, min_score: float = MIN_SCORE) -> DataFrame:
    """``did, th, label, score`` of the candidates whose mandatory phrases and enough other words stand in place."""
    spark = files.sparkSession
    known = spark.createDataFrame(_template_rows(templates), "template int, label string, tw array<string>, must array<struct<p: int, q: array<string>>>")
    placed = found.join(F.broadcast(known), "template").join(files.dropDuplicates(["did", "th"]), ["did", "th"])
    word = lambda i: F.get("words", F.col("shift") + i)
    agree = F.size(F.filter(F.transform("tw", lambda x, i: word(i) == x), lambda b: b))
    phrases = F.forall("must", lambda m: F.forall(F.transform(m["q"], lambda x, i: F.coalesce(word(m["p"] + i) == x, F.lit(False))), lambda b: b))
    return placed.where(phrases).select("did", "th", "label", (agree / F.size("tw")).alias("score")).where(F.col("score") >= min_score)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row: id, ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    docs = documents.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    # the texts are cut to words once; all that follows reads those
    worded = durable(docs.select("_id", "did", "th", words_of(F.col("_text")).alias("words")))
    postings = index(document_frequencies(worded, vocabulary(templates)), templates)
    rare = F.array(*[F.lit(w) for w in sorted({p[0] for p in postings})])
    files = worded.where(F.size(F.array_intersect("words", rare)) > 0).select("did", "th", "words")
    labelled = verified(candidates(files, postings), files, templates).groupBy("did", "th").agg(F.collect_set("label").alias("own"), F.max("score").alias("best"))
    got = worded.select("_id", "did", "th", F.size("words").cast("long").alias("n_words"), base_hits(F.col("words")).alias("hits"))
    got = got.select("_id", "did", "th", "n_words", F.transform("hits", lambda s: s["at"].cast("long")).alias("at"), F.array_sort(F.array_distinct(F.transform("hits", lambda s: s["label"]))).alias("base"))
    both = got.join(labelled, ["did", "th"], "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return both.select(F.col("_id").alias(id_col), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))
