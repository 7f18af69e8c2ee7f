"""License scan by a positional rare-token index, in DataFrame and SQL functions only.

Inverse document frequencies of all licence words are counted over the whole corpus. The index holds
postings (template, position) of the words that are rare enough: as rare as every template's rarest
one at least, so that none goes without. A file's words of that rarity are looked up; each posting
gives the place where the template would have to start, and places that all of a template's rare
words agree on are checked for its mandatory phrases.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text as words; phrases: those that must stand at their places, the whole text if none."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def placed(self) -> list[tuple[int, list[str]]]:
        """(position in the template, words) of every mandatory phrase."""
        out = []
        for phrase in self.phrases or (self.text,):
            p = phrase.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p), p))
        return out


# The base phrases, and well-known sentences of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("may not use this file except in compliance",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it under the terms of the gnu general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", ("subject to the terms of the mozilla public license",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-nc", "licensed under a creative commons attribution non commercial", ("creative commons attribution non commercial",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("proprietary", "all rights reserved"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("under the terms of the gnu affero general public license",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("under the terms of the gnu lesser general public license",)),
    Template("lgpl", "under the terms of the gnu library general public license", ("gnu library general public license",)),
    Template("gpl", "released under the gnu general public license", ("under the gnu general public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("under the terms of the eclipse public license",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy of the software and accompanying documentation",)),
    Template("bsl", "distributed under the boost software license", ("boost software license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising",)),
    Template("artistic", "you may distribute this program under the terms of the artistic license", ("terms of the artistic license",)),
    Template("wtfpl", "do what the fuck you want to public license", ("what the fuck you want to public license",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution license",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a creative commons attribution share alike", ("creative commons attribution share alike",)),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives", ("creative commons attribution noderivatives",)),
    Template("python", "psf license agreement for python", ("psf license agreement",)),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without a written agreement is hereby granted",)),
    Template("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("software developed by the openssl project",)),
    Template("ofl", "this font software is licensed under the sil open font license", ("sil open font license",)),
    Template("eupl", "licensed under the eupl the european union public licence", ("european union public licence",)),
    Template("odbl", "made available under the open database license", ("open database license",)),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    Template("ms-pl", "microsoft public license ms pl", ("microsoft public license",)),
)


def words_of(text: str) -> Column:
    """Words of column `text`: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), NOT_WORD, -1), "")


def document_frequency(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and in how many of them each word of the (small, fixed) vocabulary occurs."""
    held = F.concat(F.array(F.lit("")), F.array_intersect(words_of(text_col), F.array(*map(F.lit, vocabulary))))
    counted = {r[0]: r[1] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    return counted.pop("", 0), counted


def idf(rows: int, frequency: int) -> float:
    return math.log((rows + 1) / (frequency + 1))


def postings(templates: tuple[Template, ...], weight: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[int], list[str]]:
    """The index: word to (template, position), how many postings each template has, and each one's rarest word.

    Positions are those of mandatory phrases. Words are as rare as the least rare of all templates'
    rarest words, so every template has a posting, and a file that holds a template holds all of them.
    """
    inside = [sorted({i for p, phrase in t.placed() for i in range(p, p + len(phrase))}) for t in templates]
    rarest = [max((t.words[i] for i in places), key=lambda w: (weight[w], w)) for t, places in zip(templates, inside)]
    least = min(weight[w] for w in rarest)
    index: dict[str, list[tuple[int, int]]] = {}
    held = [0] * len(templates)
    for k, (t, places) in enumerate(zip(templates, inside)):
        for i in places:
            if weight[t.words[i]] >= least:
                index.setdefault(t.words[i], []).append((k, i))
                held[k] += 1
    return index, held, sorted(set(rarest))


def _list(values: list, kind: str = "") -> str:
    each = ", ".join(f"'{x}'" if isinstance(x, str) and not x.startswith(("array(", "named_struct(")) else str(x).lower() if isinstance(x, bool) else str(x) for x in values)
    return f"CAST(array({each}) AS ARRAY<{kind}>)" if kind else f"array({each})"


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The columns `keep` and a struct gw: n_words, hits (array of template, label, base, start, share).

    hits has every verified place of every template in order of templates, then start; share is the
    part of the template's words found there, 1 for a whole one. idf counts every row of docs. A
    null text counts as empty; repeated rows are returned each; an empty table gives an empty table.
    Columns of docs may have any names but gw_text, gw_words.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    rows, frequency = document_frequency(docs, text_col, vocabulary)
    index, held, gates = postings(templates, {w: idf(rows, frequency.get(w, 0)) for w in vocabulary})
    struct = lambda **x: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")"
    table = "map(" + ", ".join(f"'{w}', {_list([struct(t=t, p=p) for t, p in places])}" for w, places in sorted(index.items())) + ")"
    phrases = _list([_list([struct(p=p, w=_list(phrase)) for p, phrase in t.placed()]) for t in templates])
    whole = _list([_list(t.words) for t in templates])
    hit = f"""named_struct('template', x.t, 'label', {_list([t.label for t in templates])}[x.t], 'base', {_list([t.base for t in templates])}[x.t], 'start', CAST(x.s AS BIGINT), 'share',
      CAST(aggregate(zip_with(slice(words, x.s + 1, size({whole}[x.t])), {whole}[x.t], (a, b) -> CASE WHEN a = b THEN 1 ELSE 0 END), 0, (n, v) -> n + v) AS DOUBLE) / size({whole}[x.t]))"""
    # places sorted: one that all of a template's postings give stands there as often as it has postings
    hits = f"""
      transform(array(gw_words), words -> CASE WHEN arrays_overlap(words, {_list(gates)}) THEN
        transform(array(array_sort(flatten(transform(
          filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> x.w IN ({", ".join(f"'{w}'" for w in sorted(index))})),
          x -> transform({table}[x.w], y -> named_struct('t', y.t, 's', x.i - y.p)))))), found ->
          transform(filter(
            filter(found, (x, j) -> x.s >= 0 AND (j = 0 OR found[greatest(j, 1) - 1] <> x) AND coalesce(get(found, j + {_list(held)}[x.t] - 1) = x, false)),
            x -> forall({phrases}[x.t], y -> slice(words, x.s + y.p + 1, size(y.w)) = y.w)), x -> {hit}))[0]
      ELSE CAST(array() AS ARRAY<STRUCT<template: INT, label: STRING, base: BOOLEAN, start: BIGINT, share: DOUBLE>>) END)[0]"""
    df = docs.select(*(F.col(f"`{c}`") for c in keep or []), words_of(text_col).alias("gw_words"))
    return df.select(*(F.col(f"`{c}`") for c in keep or []), F.struct(F.size("gw_words").cast("long").alias("n_words"), F.expr(hits).alias("hits")).alias("gw"))
