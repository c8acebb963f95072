"""License scans: an exact set-similarity join of text blocks with license templates. Built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import cut

#: Digits, a-z and all that is not ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that name a license wherever they stand.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Percent of a template's word pairs that a block must hold.
SHARE = 90
#: (label, family, text), fixed values: sentences by which licenses are granted or named. In a block, the best of a family counts.
TEMPLATES = (
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "mit", "Licensed under the MIT License."),
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "gpl", "licensed under the GNU General Public License, version 2."),
    ("gpl-3", "gpl", "licensed under the GNU General Public License, version 3."),
    ("gpl-2", "gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "cc0", "has waived all copyright and related or neighboring rights to this work worldwide under the law"),
    ("cc-by", "cc", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "cc", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "cc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "cc", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def plain_words(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(LICENSE_WORD, text.translate(str.maketrans(UPPER, LOWER)))


def pairs_of(words: list[str]) -> list[str]:
    """The different pairs of words in a row, in order."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def wanted(tokens: int, share: int) -> int:
    """How many of a template's tokens a block must hold."""
    return -(-tokens * share // 100)


def literals(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small table of constants."""
    structs = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r, names, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LICENSE_WORD), 0)


def phrase_places(words: Column, joined: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """start and label of each place where a phrase's words stand in a row. Words are only looked through where the phrase is in their text."""

    def places(label: str, phrase: list[str]) -> Column:
        def here(w: Column, i: Column) -> Column:
            met = w == phrase[0]
            for j, p in enumerate(phrase[1:], 1):
                met = met & F.coalesce(F.get(words, i + j) == p, F.lit(False))
            return F.when(met, F.struct(i.alias("start"), F.lit(label).alias("label")))

        found = F.array_compact(F.transform(words, here))
        none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
        return F.when(F.contains(joined, F.lit(f" {' '.join(phrase)} ")), found).otherwise(none)

    return F.concat(*[places(label, plain_words(p)) for label, p in phrases])


def template_hits(words: Column, tokens: Sequence[str]) -> Column:
    """at and token of each two words in a row that some template has."""
    after = F.get(words, F.lit(1)).isNotNull()
    both = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform(both, lambda t, i: F.when(t.isin(list(tokens)), F.struct(i.alias("at"), t.alias("token"))))
    return F.when(after, F.array_compact(placed)).otherwise(F.expr("cast(array() as array<struct<at:int,token:string>>)"))


def ranked_tokens(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens (token) with rank, the rarest first by their occurrences in all documents, ties by the token: as many rows as templates have tokens."""
    counts = hits.groupBy("token").agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.coalesce("_n", F.lit(0)), "token")
    return cut(tokens.join(counts, "token", "left").select("token", F.row_number().over(order).alias("rank")))


def joined_blocks(hits: DataFrame, templates: DataFrame, ranks: DataFrame, stride: int) -> DataFrame:
    """_key, block, label, family, first, last and score of each block that holds `need` of a template's tokens.

    Blocks and templates are sets of ranks in rising order. Where they share `need` tokens, the first
    that they share is among the template's first m - need + 1 (prefix), the block has `need` tokens
    at least (length), and what follows that token on either side reaches the rest (position).
    Only such pairs are verified, on the whole sets. Tokens that no template has are never shared, so
    blocks are held without them; a block has 2 * stride tokens at most.
    """
    sets = templates.join(F.broadcast(ranks), "token").groupBy("template", "label", "family", "need").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    sets = cut(sets)
    least = sets.agg(F.min("need")).first()[0]

    ranked = hits.join(F.broadcast(ranks), "token").select("_key", "at", "rank")
    # two words that lie within a block; the block before reaches to the next one's end
    own = F.floor(F.col("at") / stride).cast("int")
    before = F.when((own > 0) & (F.col("at") % stride < stride - 1), own - 1)
    spread = ranked.withColumn("block", F.explode(F.array_compact(F.array(own, before))))
    blocks = spread.groupBy("_key", "block").agg(F.array_sort(F.collect_set("rank")).alias("held"), F.min("at").alias("first"), (F.max("at") + 1).alias("last"))
    blocks = blocks.where(F.size("held") >= least)

    prefix = sets.select("template", "label", "family", "need", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("need") + 1)).alias("i", "rank"))
    met = blocks.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - (least - 1))).alias("j", "rank")).join(F.broadcast(prefix), "rank")
    long_enough = F.size("held") >= F.col("need")
    reach = 1 + F.least(F.size("ranks") - F.col("i"), F.size("held") - F.col("j")) - 1 >= F.col("need")
    # one row a pair: that of the first token in common
    opens = F.size(F.array_intersect(F.slice("held", F.lit(1), F.col("j")), F.slice("ranks", F.lit(1), F.col("i")))) == 0
    candidates = met.where(long_enough & reach & opens)
    shared = F.size(F.array_intersect("held", "ranks"))
    return candidates.withColumn("_shared", shared).where(F.col("_shared") >= F.col("need")).withColumn("score", F.col("_shared") / F.size("ranks")).select("_key", "block", "label", "family", "first", "last", "score")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, share: int = SHARE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs (text and others) with n_words, places, blocks and score, one row a document.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. places are the
    starts and labels of all occurrences of the phrases, in words from 0. blocks are the stretches of
    2L words, one from every L words on, L being the words of the longest template, that hold `share`
    percent or more of a template's pairs of words in a row: block, label, score (the share held) and
    the first and last word of the block's template pairs. So a template stands whole in some block
    wherever it begins, and blocks are bounded however long the text. Of templates of one family a
    block has the best only, all of them if they tie. score is the best of the blocks, 1 where a phrase stands, else 0.

    Null and empty texts have no words and score 0; a text of any length is read whole; rows that
    repeat, or share an id, are scanned each for itself. An empty table gives an empty result. Without
    phrases or templates nothing is found by them; a template of one word is ignored. Columns of docs
    other than those kept are ignored.
    """
    spark = docs.sparkSession
    split = [(label, family, plain_words(text)) for label, family, text in templates]
    split = [(label, family, words, pairs_of(words)) for label, family, words in split if len(words) > 1]
    listed = [(k, label, family, wanted(len(tokens), share), t) for k, (label, family, _, tokens) in enumerate(split) for t in tokens]
    vocabulary = sorted({row[-1] for row in listed})
    stride = max((len(words) for _, _, words, _ in split), default=2)

    base = docs.select(*keep, F.monotonically_increasing_id().alias("_key"), words_of(F.col("text")).alias("_words"))
    base = base.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    places = phrase_places(F.col("_words"), F.col("_joined"), phrases) if phrases else none
    seen = base.select(*keep, "_key", F.size("_words").cast("long").alias("n_words"), places.alias("places"), template_hits(F.col("_words"), vocabulary).alias("_hits"))
    seen = cut(seen)  # without texts; each is read and split once
    kind = "array<struct<block:int,label:string,first:int,last:int,score:double>>"
    by_phrase = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    if not listed:
        return seen.select(*keep, "n_words", "places", F.expr(f"cast(array() as {kind})").alias("blocks"), by_phrase.alias("score"))

    hits = seen.select("_key", F.inline("_hits"))
    table = literals(spark, listed, ("template", "label", "family", "need", "token"))
    ranks = ranked_tokens(hits, literals(spark, [(t,) for t in vocabulary], ("token",)))
    found = joined_blocks(hits, table, ranks, stride)
    # as many rows in a group as templates of a family
    family = found.groupBy("_key", "block", "family").agg(F.max("score").alias("score"), F.collect_set(F.struct("block", "label", "first", "last", "score")).alias("b"))
    best = family.select("_key", F.explode(F.filter("b", lambda b: b["score"] == F.col("score"))).alias("b"))
    blocks = best.groupBy("_key").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    out = seen.drop("_hits").join(blocks, "_key", "left").withColumn("blocks", F.coalesce("blocks", F.expr(f"cast(array() as {kind})")))
    score = F.greatest(by_phrase, F.coalesce(F.array_max(F.transform("blocks", lambda b: b["score"])), F.lit(0.0)))
    return out.select(*keep, "n_words", "places", "blocks", score.alias("score"))
