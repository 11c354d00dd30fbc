"""Licence scans by a positional index of rare words. A template is the name of a licence or a notice in its usual words, with
key phrases that must stand in it. The index posts, for each key phrase of each template, its rarest word (the highest
inverse document frequency over all documents) with its place in the template. A file looks up those of its words that are
posted; a posting gives the place where the template would begin, and only beginnings on which the postings of all its key
phrases agree are kept. There the key phrases are verified word by word, and the words of the whole template that stand in
place are counted. Every key phrase is mandatory and one of its words is posted, so that the index loses no match, whatever
the frequencies are. DataFrame operations only: a document is one row throughout, and nothing but the frequencies is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that must stand in place.
MIN_SHARE = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, before A-Z are put in lower case, and what stands between them.
_WORDS, _BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases every scan counts, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Fixed values: (label, notice, key phrases), notices as their licences give them.
NOTICES = (
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("redistribute it and or modify it", "gnu lesser general public license")),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("except in compliance with the license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "v 2 0")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def template_words(text: str) -> list[str]:
    return re.findall(_WORDS, text.translate(str.maketrans(_UPPER, _LOWER)))


def templates(notices=NOTICES) -> list[tuple[str, list[str], list[list[int]]]]:
    """(label, words, places of each key phrase's words); the phrases of BASE come first, each its own key."""
    out = []
    for label, text, keys in [(label, phrase, (phrase,)) for phrase, label in BASE] + list(notices):
        w = template_words(text)
        places = []
        for key in map(template_words, keys):
            at = next((i for i in range(len(w)) if w[i : i + len(key)] == key), None)
            if not key or at is None:
                raise ValueError(f"the template of {label} lacks its key phrase {' '.join(key)!r}")
            places.append(list(range(at, at + len(key))))
        out.append((label, w, places))
    return out


def _words(text: str) -> Column:
    """Split at what is no word: to extract each word would copy the whole text for each."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BETWEEN), "")


def frequencies(documents: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; the driver gets one row a word of it."""
    own = F.filter(_words("text"), lambda w: F.lower(w).isin(*sorted(vocabulary)))
    rows = documents.select(F.explode(F.array_distinct(F.transform(own, F.lower))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def postings(known: list[tuple[str, list[str], list[list[int]]]], found: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, its place in the template): the rarest word of each key phrase, the first of equally rare ones."""
    return sorted({(w[at], t, at) for t, (_, w, keys) in enumerate(known) for at in [min(key, key=lambda i: (found.get(w[i], 0), i)) for key in keys]})


def scan(documents: DataFrame, notices=NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, and matches: array of (template, label, first, share), a row for each row of documents.

    first is the word at which the template begins (from 0), share that of its words which stand in place, A-Z in lower
    case. Templates may overlap, and every place counts. Null and empty texts have no words; rows with equal or null doc_id
    are results of their own; an empty table gives an empty result; other columns are ignored.
    """
    known = templates(notices)
    vocabulary = {w[i] for _, w, keys in known for key in keys for i in key}
    index = postings(known, frequencies(documents, vocabulary))
    need = F.array(*[F.lit(sum(p[1] == t for p in index)) for t in range(len(known))])
    posted = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(at).alias("at")) for w, t, at in index])
    texts = F.array(*[F.array(*map(F.lit, w)) for _, w, _ in known])
    keys = F.array(*[F.array(*[F.lit(i) for key in keys for i in key]) for _, _, keys in known])
    labels = F.array(*[F.lit(label) for label, _, _ in known])

    looked = F.array_compact(F.transform("words", lambda w, i: F.when(F.lower(w).isin(*sorted({p[0] for p in index})), F.struct(F.lower(w).alias("w"), i.alias("i")))))
    begins = F.flatten(F.transform(looked, lambda x: F.transform(F.filter(posted, lambda p: p["word"] == x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("first")))))
    rows = documents.select("doc_id", _words("text").alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", F.array_sort(begins).alias("begins"))
    # Sorted, equal beginnings are neighbours: as many as the template has postings, and the first of them stands for all.
    same = lambda x, k, n: F.coalesce(F.get("begins", k + n) == x, F.lit(False))
    agreed = F.filter("begins", lambda x, k: (x["first"] >= 0) & ~same(x, k, -1) & same(x, k, F.get(need, x["t"]) - 1))
    rows = rows.select("doc_id", "n_words", F.when(F.size("begins") > 0, F.col("words")).alias("words"), agreed.alias("agreed"))

    def placed(x):
        equal = F.zip_with(F.slice(F.col("words"), x["first"] + 1, F.size(F.get(texts, x["t"]))), F.get(texts, x["t"]), lambda a, b: F.coalesce(F.translate(a, _UPPER, _LOWER) == b, F.lit(False)))
        return F.struct(x["t"].alias("t"), x["first"].cast("long").alias("first"), equal.alias("equal"))

    rows = rows.select("doc_id", "n_words", F.transform("agreed", placed).alias("placed"))
    verified = F.filter("placed", lambda x: F.forall(F.get(keys, x["t"]), lambda i: F.get(x["equal"], i)))
    match = F.transform(verified, lambda x: F.struct(x["t"].alias("template"), F.get(labels, x["t"]).alias("label"), x["first"].alias("first"), (F.size(F.filter(x["equal"], lambda y: y)) / F.size(x["equal"])).alias("share")))
    return rows.select("doc_id", "n_words", match.alias("matches")).select("doc_id", "n_words", F.filter("matches", lambda m: m["share"] >= min_share).alias("matches"))


def report(found: DataFrame) -> DataFrame:
    """The query's columns from scan's: score is the largest share of a template in place, 1 for a licence's whole name, 0
    without a match; places and base labels are those of BASE, labels those of all templates."""
    base = F.filter("matches", lambda m: m["template"] < len(BASE))
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    rows = found.select("doc_id", "n_words", "matches", base.alias("base"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        named("base").alias("base_labels"), named("matches").alias("labels"), F.coalesce(F.array_max("matches.share"), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB, without an index: every place of a template's first key word is compared whole."""
    rows = ",\n".join(f"({t}, '{label}', {w!r}, {[i for k in keys for i in k]!r})" for t, (label, w, keys) in enumerate(templates()))
    return f"""WITH t(t, label, w, k) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS words FROM documents),
p AS (SELECT r, words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
c AS (SELECT r, words, t, label, w, k, i - k[1] AS s FROM p JOIN t ON word = w[k[1] + 1] WHERE i >= k[1]),
m AS (SELECT r, t, label, s, list_sum(list_transform(range(len(w)), lambda j: CASE WHEN words[s + j + 1] = w[j + 1] THEN 1 ELSE 0 END)) / len(w) AS share FROM c
  WHERE list_sum(list_transform(k, lambda j: CASE WHEN words[s + j + 1] = w[j + 1] THEN 0 ELSE 1 END)) = 0),
f AS (SELECT r, count(*) FILTER (t < {len(BASE)}) AS n_base, min(s) FILTER (t < {len(BASE)}) AS first_word, max(s) FILTER (t < {len(BASE)}) AS last_word, list_distinct(list(label) FILTER (t < {len(BASE)})) AS base_labels,
  list_distinct(list(label)) AS labels, max(share) AS score FROM m WHERE share >= {MIN_SHARE} GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(labels), ','), '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN f USING (r)"""
