"""Licence scans with a positional index of rare licence words.

Licences are passages: the notices that files carry, and parts of the licences' bodies without names or dates. Each is
indexed under its words with their positions. A file that has all key phrases of a passage, version phrases among
them, looks up those of its words that are the passage's and that fewest documents contain. Each place of such a word proposes
offsets, where the passage would begin; offsets that most of the words agree in are the intersection. There the
passage is compared word by word, weighted by rarity, and the key phrases must stand in their places. Plain phrases of
well-known licences are found besides.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NON_WORD, ascii_lower, pinned

#: Phrase and label of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PUBLIC = "it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_GRANT = "permission is hereby granted free of charge to any person"
#: Label, passage and its mandatory phrases, in lower-case words. What licences say is fixed.
PASSAGES = [
    ("gpl-3.0", _PUBLIC.format("general public license", "3"), ["gnu general public license", "either version 3 of the license"]),
    ("gpl-2.0", _PUBLIC.format("general public license", "2"), ["gnu general public license", "either version 2 of the license"]),
    ("lgpl-3.0", _PUBLIC.format("lesser general public license", "3"), ["gnu lesser general public license", "either version 3 of the license"]),
    ("lgpl-2.1", _PUBLIC.format("lesser general public license", "2 1"), ["gnu lesser general public license", "either version 2 1 of the license"]),
    ("lgpl-2.0", _PUBLIC.format("library general public license", "2"), ["gnu library general public license", "either version 2 of the license"]),
    ("agpl-3.0", _PUBLIC.format("affero general public license", "3"), ["gnu affero general public license", "either version 3 of the license"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "it under the terms of the gnu general public license version 2 as published by the free software foundation", ["gnu general public license version 2 as published"]),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", ["free copyleft license for software and other kinds of works"]),
    ("gpl-2.0", "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users", ["intended to guarantee your freedom to share and change free software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license version 2 0 january 2004"]),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ["each contributor hereby grants to you a perpetual worldwide", "irrevocable copyright license"]),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation", ["this product includes software developed by the apache software foundation"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", _GRANT + " obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["to deal in the software without restriction"]),
    ("boost-1.0", _GRANT + " or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ["any person or organization obtaining a copy of the software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by", ["all advertising materials mentioning features or use of this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["copy modify and or distribute this software for any purpose"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ["permission is granted to anyone to use this software for any purpose"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license", ["mozilla public license version 1 1"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ["eclipse public license v1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("cc0-1.0", "released under the creative commons cc0 1 0 universal public domain dedication", ["creative commons cc0 1 0 universal"]),
    ("cc0-1.0", "creative commons zero v1 0 universal", ["creative commons zero v1 0 universal"]),
]
_KINDS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
for _kind, _name in _KINDS.items():
    for _version in ("2 0", "2 5", "3 0", "4 0"):
        for _said in (f"cc {_kind} {_version}", f"creative commons {_name} {_version}"):
            PASSAGES.append((f"cc-{_kind.replace(' ', '-')}-{_version.replace(' ', '.')}", f"licensed under {'a ' if 'creative' in _said else ''}{_said}", [_said]))
#: Words of which every passage's key phrases hold one: a text without any has no passage.
MARKERS = ["license", "software", "creative commons", "cc by", "redistribution", "licenses"]
#: A file's rarest words of a passage that are looked up, the share of them that agree in an offset.
RARE, AGREE = 6, 0.75


def normal(text: Column) -> Column:
    """The text's words, lower-cased, with one space between."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents in all, and for each word of the passages how many documents have it: as many rows as these have words."""
    vocabulary = sorted({w for _, text, _ in PASSAGES for w in text.split()})
    words = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(normal(F.col("text")), " "))
    # The empty string stands for the document itself.
    found = docs.select(F.explode(F.array_append(words, F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {w: n for w, n in found}
    return counts.pop("", 0), counts


def rarity(n_docs: int, count: int) -> float:
    """A word's weight: its inverse document frequency, and a little for words of every document."""
    return math.log((n_docs + 1) / (count + 1)) + 0.1


def places_of(words: list[str], phrase: str) -> list[tuple[int, str]]:
    key = phrase.split()
    start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return [(start + k, w) for k, w in enumerate(key)]


def scanned(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base: places of base phrases; first_word and last_word: their smallest and largest start in words
    from 0, null if there are none; base_labels and labels: arrays of sorted distinct labels; score: the
    largest weighted share of a passage that stands at an offset with its key phrases in place, 0 if there is none; a label is given
    from ``least`` on; spans: array of (label, first word, share) of these. A null text is empty. A passage that is repeated has a
    span for each place; rows that repeat are scanned each. Existing columns of these names are replaced.
    """
    n_docs, counts = document_frequencies(docs)
    weight = lambda w: rarity(n_docs, counts.get(w, 0))
    rows = []
    for label, text, phrases in PASSAGES:
        words = text.split()
        rarest = sorted(dict.fromkeys(words), key=lambda w: (-weight(w), words.index(w)))
        key = [x for phrase in phrases for x in places_of(words, phrase)]
        lits = lambda xs: F.array(*map(F.lit, xs))
        keys = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(w).alias("word")) for i, w in key))
        rows.append(F.struct(F.lit(label).alias("label"), lits(words).alias("words"), lits([weight(w) for w in words]).alias("weights"), lits(rarest).alias("rarest"), keys.alias("key")))
    passages = F.array(*rows)

    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    df = pinned(docs.drop(*own), __norm=normal(F.col("text")))
    df = pinned(df, __words=F.when(F.col("__norm") == "", F.array().cast("array<string>")).otherwise(F.split("__norm", " ")))

    phrase = "(?<![^ ])(" + "|".join(PHRASES) + ")(?![^ ])"
    maybe = F.col("__norm").contains("license") | F.col("__norm").contains("cc by")
    df = pinned(df, __found=F.when(maybe, F.regexp_extract_all("__norm", F.lit(phrase), F.lit(1))).otherwise(F.array().cast("array<string>")))
    hit = F.size("__found") > 0
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    df = df.withColumn("__before", F.when(hit, F.split("__norm", phrase, 2)[0])).withColumn("__until", F.when(hit, F.regexp_extract("__norm", "(?s)^(.*)" + phrase, 1)))

    padded = F.concat(F.lit(" "), F.col("__norm"), F.lit(" "))
    has = lambda phrases: reduce(and_, (F.contains(F.col("__padded"), F.lit(f" {p} ")) for p in phrases))
    df = pinned(df, __padded=F.when(reduce(or_, (F.contains("__norm", F.lit(m)) for m in MARKERS)), padded))
    gated = F.filter(F.array(*(F.when(has(phrases), F.lit(t)) for t, (_, _, phrases) in enumerate(PASSAGES))), lambda t: t.isNotNull())
    df = pinned(df, __gated=F.when(F.col("__padded").isNotNull(), gated).otherwise(F.array().cast("array<int>")))
    # The words of the file with their places, for files with a gated passage only.
    empty = F.array().cast("array<struct<w:string,i:int>>")
    placed = F.transform("__words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    df = pinned(df, __placed=F.when(F.size("__gated") > 0, placed).otherwise(empty))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def offsets(passage: Column) -> Column:
        rare = F.slice(F.array_intersect(passage["rarest"], F.col("__words")), 1, RARE)

        def proposed(words: Column) -> Column:
            mine = F.filter("__placed", lambda x: F.array_contains(words, x["w"]))
            theirs = F.filter(F.transform(passage["words"], lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda x: F.array_contains(words, x["w"]))
            every = let(theirs, lambda ps: F.flatten(F.transform(mine, lambda x: F.transform(F.filter(ps, lambda y: y["w"] == x["w"]), lambda y: x["i"] - y["p"]))))
            need = F.ceil(F.size(words) * F.lit(AGREE)).cast("int")
            # In a sorted list an offset that ``need`` postings agree in stands again so many places on.
            return let(F.array_sort(every), lambda s: F.array_distinct(F.filter(F.transform(s, lambda o, i: F.when(F.get(s, i + need - 1) == o, o)), lambda o: o.isNotNull())))

        return let(rare, proposed)

    def compared(passage: Column) -> Column:
        word = lambda i: F.get(F.col("__words"), i)
        total = F.aggregate(passage["weights"], F.lit(0.0), lambda a, x: a + x)

        def at(o: Column) -> Column:
            same = F.transform(passage["words"], lambda w, p: F.when(F.coalesce(word(o + p) == w, F.lit(False)), F.get(passage["weights"], p)).otherwise(F.lit(0.0)))
            share = F.round(F.aggregate(same, F.lit(0.0), lambda a, x: a + x) / total, 9)
            keyed = F.forall(passage["key"], lambda k: F.coalesce(word(o + k["pos"]) == k["word"], F.lit(False)))
            return F.struct(passage["label"].alias("label"), o.alias("first"), share.alias("share"), keyed.alias("key"))

        return F.transform(offsets(passage), at)

    tried = F.flatten(F.transform("__gated", lambda t: let(F.get(passages, t), compared)))
    df = pinned(df, __tried=F.filter(tried, lambda x: x["key"]))
    good = F.filter("__tried", lambda x: x["share"] >= least)
    df = pinned(df, spans=F.transform(good, lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), x["share"].alias("share"))))
    base = F.filter(F.array(*(F.when(F.array_contains("__found", p), F.lit(label)) for p, label in PHRASES.items())), lambda x: x.isNotNull())
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "n_base": F.size("__found").cast("bigint"),
            "first_word": spaces(F.col("__before")).cast("bigint"),
            "last_word": spaces(F.col("__until")).cast("bigint"),
            "base_labels": F.sort_array(base),
        }
    )
    df = df.withColumn("labels", F.sort_array(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda x: x["label"])))))
    df = df.withColumn("score", F.coalesce(F.array_max(F.transform("__tried", lambda x: x["share"])), F.lit(0.0)))
    return df.drop("__norm", "__words", "__found", "__before", "__until", "__padded", "__gated", "__placed", "__tried")
