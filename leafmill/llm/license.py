"""License scans by a positional rare-token index.

Licence sentences (TEMPLATES) are indexed by their informative words: word -> (template, position). Every licence word
of a file is looked up; each occurrence votes for the
offset at which its template would begin, so postings intersect by relative position. An offset with enough of a template's words is
verified: the template's mandatory phrase must stand at its place. Besides, BASE_PHRASES are found wherever their words
stand consecutively; their labels always stay.

Words: A-Z are lower-cased, and runs of digits, a-z and code points from U+0080 are words.

Defined results: null text is empty; very long texts are scanned whole; columns other than doc_id and text are not read, whatever their names;
of licences with equal shares all are labels; a file without words has n_words 0, no labels and score 0; repeated rows and rows
with one doc_id get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import pick, stored

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase, label.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Label, sentence of the licence or of its notice, mandatory phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "software is provided as is"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing software distributed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "purpose with or without fee is hereby granted"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "nor the names of its contributors"),
    ("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "distributed in the hope that it will be useful"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "no event will the authors be held liable"),
    ("bsl", "boost software license version 1 0", "boost software license"),
    ("artistic", "this package is free software you can redistribute it under the terms of the artistic license", "the artistic license"),
    ("odbl", "this database is made available under the open database license", "open database license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "strictly prohibited proprietary and confidential"),
]
#: Words that tell nothing and aren't indexed.
COMMON = {"a", "all", "and", "any", "are", "as", "at", "by", "can", "for", "in", "is", "it", "not", "of", "or", "that", "the", "this", "to", "use", "with", "you", "0", "2", "3", "4", "v"}
#: The share of a template's indexed words that must align.
SHARE = 0.6


def postings() -> list[tuple[str, int, int]]:
    """word, template, position of each indexed template word."""
    return [(w, t, i) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in COMMON]


def _within(text: str, phrase: str) -> int:
    """The word position of phrase in text."""
    return len(text[: f" {text} ".index(f" {phrase} ")].split())


VOCABULARY = sorted({w for w, _, _ in postings()} | {w for p, _ in BASE_PHRASES for w in p.split() if w not in COMMON})
INDEXED = [sum(1 for _, u, _ in postings() if u == t) for t in range(len(TEMPLATES))]
PHRASES = sorted({p for p, _ in BASE_PHRASES} | {p for _, _, p in TEMPLATES})


def _places(words: Column, found: Column, phrase: str) -> Column:
    """Array of the word positions at which phrase starts; words is the file's words, found its licence words."""
    own = phrase.split()
    if any(own[:k] == own[-k:] for k in range(1, len(own))):
        raise ValueError(f"{phrase}: a phrase may not overlap itself")
    mark = max((w for w in own if w not in COMMON), key=len)
    spaced = "".join(f" {w} " for w in own)
    line = F.translate(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), _UPPER, _LOWER)
    parts = F.split(line, rf"\Q{spaced}\E")
    size = lambda s: F.floor((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")
    start = F.struct(F.lit(-len(own)).alias("at"), F.array().cast("array<int>").alias("all"))
    ends = F.aggregate(
        parts,
        start,
        lambda a, part: F.struct((a["at"] + len(own) + size(part)).alias("at"), F.concat(a["all"], F.array(a["at"] + len(own) + size(part))).alias("all")),
        lambda a: F.slice(a["all"], 1, F.size(a["all"]) - 1),
    )
    return F.when(F.exists(found, lambda f: f["word"] == mark), ends).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, found: array of (at, word), and a column p0, p1 .. of starts for each of PHRASES."""
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.split(F.coalesce("text", F.lit("")), _GAP).alias("parts"))
    words = rows.select("doc_id", F.filter("parts", lambda w: w != "").alias("words"))
    lower = lambda w: F.translate(w, _UPPER, _LOWER)
    hit = lambda w, i: F.when(F.lower(w).isin(VOCABULARY) & lower(w).isin(VOCABULARY), F.struct(i.alias("at"), lower(w).alias("word")))
    found = words.select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"), F.filter(F.transform("words", hit), lambda x: x.isNotNull()).alias("found"))
    places = [_places(F.col("words"), F.col("found"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "found", *places)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per file."""
    spark = docs.sparkSession
    files = stored(scanned(docs), "license-scan")
    some = files.where(F.size("found") > 0)
    looked = some.select("row", F.explode("found").alias("f"))
    index = spark.createDataFrame(postings(), "word string, template int, place int")
    votes = (
        looked.select("row", F.col("f.at").alias("at"), F.col("f.word").alias("word"))
        .join(F.broadcast(index), "word")  # a fixed table
        .groupBy("row", "template", (F.col("at") - F.col("place")).alias("offset"))
        .agg(F.count("*").alias("votes"))
    )
    size = F.element_at(F.array(*map(F.lit, INDEXED)), F.col("template") + 1)
    aligned = votes.withColumn("share", F.col("votes") / size).where(F.col("share") >= SHARE)
    starts = F.array(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    which = F.array(*[F.lit(PHRASES.index(p)) for _, _, p in TEMPLATES])
    within = F.array(*[F.lit(_within(text, phrase)) for _, text, phrase in TEMPLATES])
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    phrases = some.select(F.col("row").alias("p_row"), starts.alias("starts"))
    at = F.col("offset") + F.element_at(within, F.col("template") + 1)
    verified = (
        aligned.join(phrases, aligned["row"] == phrases["p_row"])
        .where(F.array_contains(F.element_at("starts", F.element_at(which, F.col("template") + 1) + 1), at))
        .select("row", F.element_at(labels, F.col("template") + 1).alias("label"), "share")
        .groupBy("row")
        .agg(F.collect_set("label").alias("own_labels"), F.max("share").alias("share"))
        .withColumnRenamed("row", "v_row")
    )
    base = [F.col(f"p{PHRASES.index(p)}") for p, _ in BASE_PHRASES]
    every = F.flatten(F.array(*base))
    base_labels = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for c, (_, label) in zip(base, BASE_PHRASES, strict=True)]))))
    joined = files.join(verified, files["row"] == verified["v_row"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("own_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def scan_sql(docs: str = "documents") -> str:
    """scan in SQL: every licence word of a file is looked up."""
    quoted = lambda s: "'" + s + "'"
    rows = lambda xs: ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in xs)
    consecutive = lambda p: " and ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))
    phrases = " union all ".join(f"select r, '{p}' as phrase, i as pos from spots where {consecutive(p)}" for p in PHRASES)
    within = [(t, INDEXED[t], label, p, _within(text, p)) for t, (label, text, p) in enumerate(TEMPLATES)]
    return f"""
with files as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from {docs}),
spots as (select r, words, unnest(range(0, len(words))) as i from files),
phrases as ({phrases}),
found as (select r, words[i + 1] as word, i as pos from spots where words[i + 1] in ({", ".join(map(quoted, VOCABULARY))})),
posting(word, template, place) as (values {rows(postings())}),
template(template, size, label, phrase, within) as (values {rows(within)}),
votes as (
  select r, template, pos - place as off, count(*) as votes
  from found join posting using (word) group by all),
verified as (
  select v.r, t.label, v.votes / t.size::double as share from votes v join template t using (template)
  where v.votes / t.size::double >= {SHARE} and exists (select 1 from phrases p where p.r = v.r and p.phrase = t.phrase and p.pos = v.off + t.within)),
base(phrase, label) as (values {rows(BASE_PHRASES)}),
hits as (select r, pos, label from phrases join base using (phrase)),
b as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hits group by r),
l as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from hits union select r, label from verified) group by r),
s as (select r, max(share) as share from verified group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, greatest(coalesce(share, 0.0), case when n_base > 0 then 1.0 else 0.0 end)::double as score
from files left join b using (r) left join l using (r) left join s using (r)
"""
