"""Licence scans: a paragraph classifier with template comparison (operator 8).

Training is a small computation on the driver over the templates below; documents pass
DataFrame functions only."""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Short licence notices by family, as commonly written.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "public-domain": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
#: Paragraphs that use such words without being a notice.
OTHERS = [
    "The driver must carry a license and the version of the form that was released last year.",
    "All guests reserved a table and were free to use the garden for the rest of the day.",
    "She was granted permission to copy the public records under the terms of the court.",
    "Human rights are reserved to all persons, and the general public has a duty to work for them.",
    "A new source of free software was released by the foundation, under a general plan.",
    "The work of the library is to lend books, without fee, for any purpose.",
    "He worked under cover in a public house and was by all accounts free to go.",
    "The file was released, and its version number is in the source.",
    "Version 3 of the public plan is under review.",
    "This is the domain of common sense, creative work and attribution of praise.",
]


def split_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _examples(seed: int = 11) -> list[tuple[list[str], str]]:
    """Templates, and templates with words dropped or added, each with its family;
    parts of other paragraphs, and templates cut below recognition, as unknown."""
    rng = random.Random(seed)
    other = [w for t in OTHERS for w in split_words(t)]
    out: list[tuple[list[str], str]] = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = split_words(text)
            out += [(w, family)] * 4
            for _ in range(8):
                kept = [x for x in w if rng.random() > 0.08]
                at = rng.randrange(len(other))
                out.append((rng.choice([other[at : at + rng.randrange(4)], []]) + kept + rng.choice([other[at : at + rng.randrange(6)], []]), family))
            for _ in range(3):
                out.append(([x for x in w if rng.random() > 0.75], UNKNOWN))
    for text in OTHERS:
        w = split_words(text)
        out += [(w, UNKNOWN)] * 3
        for _ in range(12):
            i = rng.randrange(len(w))
            out.append((w[i:] + other[: rng.randrange(12)], UNKNOWN))
    for _ in range(60):
        rng.shuffle(other)
        out.append((other[: rng.randrange(1, 25)], UNKNOWN))
    return out


def train(rounds: int = 25, rate: float = 0.5, sparsity: float = 2e-4) -> dict:
    """Multinomial logistic regression over word one- and two-grams with an L1 penalty
    (stochastic steps in a fixed order, weights shrunk to zero after each round), then a
    temperature and an acceptance level calibrated on examples left out of training."""
    examples = _examples()
    fitted, left = [e for i, e in enumerate(examples) if i % 4], examples[::4]
    classes = [*sorted(TEMPLATES), UNKNOWN]
    weights: dict[str, list[float]] = {}
    bias = [0.0] * len(classes)

    def logits(words: list[str]) -> list[float]:
        z = list(bias)
        for g in set(grams(words)):
            for k, w in enumerate(weights.get(g, ())):
                z[k] += w
        return z

    def softmax(z: list[float], heat: float = 1.0) -> list[float]:
        top = max(z)
        e = [math.exp((x - top) / heat) for x in z]
        return [x / sum(e) for x in e]

    for step in range(rounds):
        pace = rate / (1 + 0.1 * step)
        for words, family in fitted:
            p = softmax(logits(words))
            own = set(grams(words))
            y = classes.index(family)
            scale = pace / max(1.0, math.sqrt(len(own)))
            for k in range(len(classes)):
                push = scale * ((k == y) - p[k])
                bias[k] += push * 0.1
                for g in own:
                    weights.setdefault(g, [0.0] * len(classes))[k] += push
        for g, row in list(weights.items()):
            shrunk = [math.copysign(max(0.0, abs(w) - pace * sparsity * 10), w) for w in row]
            if any(shrunk):
                weights[g] = shrunk
            else:
                del weights[g]

    def loss(heat: float) -> float:
        return -sum(math.log(max(1e-12, softmax(logits(w), heat)[classes.index(f)])) for w, f in left)

    heat = min((0.25 * 1.25**i for i in range(20)), key=loss)
    unknown = sorted(max(softmax(logits(w), heat)[:-1]) for w, f in left if f == UNKNOWN)
    level = min(0.9, max(0.5, unknown[int(0.98 * len(unknown))] if unknown else 0.5))
    return {"classes": classes, "weights": weights, "bias": bias, "heat": heat, "level": level}


def cues(share: float) -> list[str]:
    """Words of which every paragraph has one that holds ``share`` of the distinct words
    of any template: of each template its longest ones, more than the rest it may lack."""
    out: set[str] = set()
    for texts in TEMPLATES.values():
        for text in texts:
            w = sorted(set(split_words(text)), key=lambda x: (-len(x), x))
            out.update(w[: int(math.floor((1 - share) * len(w) + 1e-9)) + 1])
    return sorted(out)


#: Between two words of one paragraph: anything but a word, over one line break at most.
_GAP = r"(?:[^a-z0-9\n]++(?:\n[^a-z0-9\n]*+)?|\n[^a-z0-9\n]*+)"
_VERSION = r"(?:v(?:ersion)? )?[0-9]+"

#: Names of each family, in full and as identifiers, and runs of words that
#: its notices have in common. A blank stands for any gap between words.
NAMES: dict[str, tuple[str, str]] = {
    "apache": (r"apache (?:software )?licen[sc]e", r"apache"),
    "mit": (r"(?:mit|expat) licen[sc]e", r"mit"),
    "gpl": (r"(?:gnu general public licen[sc]e|gnu gpl(?:v[0-9]+)?|gpl(?:v[0-9]+)?(?: licen[sc]e)?)", r"gpl(?:v?[0-9]+)?"),
    "lgpl": (r"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl(?:v[0-9]+)?|lgpl(?:v[0-9]+)?(?: licen[sc]e)?)", r"lgpl(?:v?[0-9]+)?"),
    "bsd": (r"bsd(?: [0-9])?(?: clause)?(?: style)? licen[sc]e", r"(?:bsd|0bsd)"),
    "mpl": (r"mozilla public licen[sc]e", r"mpl"),
    "cc-by-nc": (r"(?:creative commons )?attribution non ?commercial|cc by nc", r"cc by nc"),
    "cc-by": (r"creative commons attribution (?:[1-4]|licen[sc]e|international)|cc by [1-4]", r"cc by [1-4]"),
    "isc": (r"isc licen[sc]e", r"isc"),
    "public-domain": (r"public domain|unlicense|cc0", r"(?:unlicense|cc0)"),
    "proprietary": (r"proprietary licen[sc]e", r"proprietary"),
}
PASSAGES: dict[str, list[str]] = {
    "mit": ["permission is hereby granted free of charge", "any person obtaining a copy of this software"],
    "gpl": ["terms of the gnu general public licen[sc]e"],
    "lgpl": ["terms of the gnu (?:lesser|library) general public licen[sc]e"],
    "bsd": ["redistributions? (?:and use )?in source and binary forms?"],
    "mpl": ["subject to the terms of the mozilla public licen[sc]e"],
    "isc": ["permission to use copy modify and or distribute"],
    "public-domain": ["free and unencumbered software", "(?:released|placed|dedicated)(?: [a-z0-9]++){0,4} (?:in|into|to) the public domain"],
    "proprietary": ["all rights reserved", "unauthori[sz]ed (?:copying|reproduction|use|distribution) of this"],
}
_LEADS = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|issued|governed|covered|redistributed?|terms|conditions|subject to)"

#: Beginnings of words of which every notice_pattern needs one.
ANCHOR = r"(?<![a-z0-9])(?:apache|mit(?![a-z])|expat|l?gpl|gnu|0?bsd|mozilla|mpl|attribution|cc(?![a-z])|isc(?![a-z])|unlicense|proprietary|permission|any[^a-z0-9]+person|redistribution|unencumbered|public|rights|unauthori)"


def notice_pattern(family: str) -> str:
    """A pattern, for lower-cased text, of what tells a notice of ``family`` in a paragraph
    however its lines are wrapped: a passage; a name behind a word of licensing, nine words
    on at most, or alone on its line; an identifier behind ``under``, or behind an SPDX tag
    or ``license:`` on the same line."""
    name, short = NAMES[family]
    name = f"(?:{name})"
    near = "(?:[^a-z0-9\\n]++[a-z0-9]++){0,6}[^a-z0-9\\n]++"
    ways = [
        *PASSAGES.get(family, []),
        f"{_LEADS}(?: [a-z0-9]++){{0,8}} {name}",
        f"(?:licen[sc]ed|released|distributed|available|published) under(?: (?:the|a|an|terms|of))*? {short}",
    ]
    ends = "(?![a-z0-9])"
    worded = f"(?<![a-z0-9])(?:{'|'.join(ways)}){ends}"
    titled = f"(?m:^[^a-z0-9\\n]*+(?:the )?{name}(?: {_VERSION}| clause)*[^a-z0-9\\n]*+$)"
    tagged = f"(?<![a-z0-9])(?:identifier|licen[sc]e)[\"'\\t]*+[:=](?:{near}|[^a-z0-9\\n]*+)(?<![a-z0-9]){short}{ends}"
    return "|".join(x.replace(" ", _GAP) for x in (worded, titled, tagged))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(docs: DataFrame, model: dict | None = None, share: float = 0.8, column: str = "text", window: int = 64, lines: int = 8) -> DataFrame:
    """``docs`` with licenses: array of (paragraph, family, probability, similarity), by
    the number of the line (from 0) where a notice begins, then by family.

    A paragraph is the lines up to one without a word. A notice is found in it by a
    family's characteristic passages, names and identifiers, over line breaks
    (notice_pattern), or if the classifier gives a family at the calibrated level at
    least to a line, or to a window of ``window`` words, and that holds ``share`` of the
    distinct words of one of the family's templates. Windows begin with each line, and at
    every half window in longer ones, and run on over at most ``lines`` lines; lines of more
    than ``window`` words are judged by windows only, and a window's notice is told of
    where no line of it, nor the window one line on, tells of the family. probability is
    the classifier's for the family, similarity the greatest share of a template.

    Words are runs of ASCII letters and digits, lower-cased. Parts without any of the
    cue words can't hold that share of any template and are passed over before
    their grams are made, which changes no result. No shuffle.

    A null or empty text has no notices; repeated rows give a row each; an
    empty table gives none; the lesser family name wins a tie. A column named
    licenses is replaced."""
    m = train() if model is None else model
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    cue = f"(?:{'|'.join(cues(share))})"
    families = m["classes"][:-1]
    kept = {g: w for g, w in sorted(m["weights"].items())}
    table = json.dumps({g: [round(v, 6) for v in w] for g, w in kept.items()})
    by_gram = F.from_json(F.lit(table), "map<string,array<double>>")  # a constant of the plan
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(w) for w in sorted(set(split_words(t)))]).alias("words")) for f in families for t in TEMPLATES[f]])
    nothing = F.array(*[F.lit(0.0)] * len(m["classes"]))
    names = F.array(*map(F.lit, families))
    LINE, WINDOW, NOTICE = 0, 1, 2

    def worded(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))

    def unit(place: Column, kind: int, words: Column, named: Column | None = None) -> Column:
        return F.struct(place.alias("place"), F.lit(kind).alias("kind"), words.alias("words"), (F.lit(None).cast("string") if named is None else named).alias("named"))

    def running(rows: Column, i: Column) -> Column:
        """Line i and those that follow in its paragraph."""
        later = F.transform(F.slice(rows, i + 2, lines - 1), lambda t: F.substring(t, 1, 8 * window))
        return F.split(F.concat_ws("\n", F.element_at(rows, i + 1), later), "\n[^a-z0-9\n]*+(?:\n|$)", 2)[0]

    def parts(rows: Column) -> Column:
        def of_line(t: Column, i: Column) -> Column:
            def of_words(own: Column, run: Column) -> Column:
                alone = F.when((F.size(own) <= window) & t.rlike(cue), F.array(unit(i, LINE, own)))
                starts = F.sequence(F.lit(0), F.size(own) - 1, F.lit(window // 2))
                more = F.when(F.size(own) > 0, _bound(worded(run), lambda w: F.transform(starts, lambda o: unit(i, WINDOW, F.slice(w, o + 1, window)))))
                wide = F.filter(F.coalesce(more, none), lambda u: F.array_join(u["words"], " ").rlike(cue))
                return F.concat(F.coalesce(alone, none), wide)

            return _bound(worded(t), lambda own: of_words(own, running(rows, i)))

        cued = lambda marks: F.zip_with(rows, marks, lambda t, c: F.struct(t.alias("t"), c.alias("c")))
        near = lambda x: F.transform(x, lambda p, i: F.when(F.exists(F.slice(x, i + 1, lines), lambda q: q["c"]), of_line(p["t"], i)).otherwise(none))
        return F.flatten(_bound(cued(F.transform(rows, lambda t: t.rlike(cue))), near))

    def notices(low: Column, rows: Column) -> Column:
        def of_family(f: str) -> Column:
            pattern = notice_pattern(f)
            marked = F.split(F.regexp_replace(F.translate(low, "\x01", ""), pattern, "\x01$0"), "\n", -1)
            found = F.filter(F.transform(marked, lambda t, i: F.struct(i.alias("i"), t.contains("\x01").alias("hit"))), lambda x: x["hit"])
            units = F.transform(found, lambda x: unit(x["i"], NOTICE, F.slice(worded(running(rows, x["i"])), 1, window), F.lit(f)))
            return F.when(low.rlike(pattern), units).otherwise(none)

        return F.concat(*map(of_family, families))

    none = F.array().cast("array<struct<place:int,kind:int,words:array<string>,named:string>>")

    def judged(p: Column) -> Column:
        words = p["words"]
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        own = F.array_distinct(F.concat(words, pairs))
        start = F.array(*[F.lit(round(b, 6)) for b in m["bias"]])
        z = F.aggregate(own, start, lambda s, g: F.zip_with(s, F.coalesce(F.element_at(by_gram, g), nothing), lambda a, b: a + b))
        return F.struct(p["place"].alias("place"), p["kind"].alias("kind"), p["named"].alias("named"), F.array_distinct(words).alias("words"), z.alias("z"))

    def softened(p: Column) -> Column:
        top = F.array_max(p["z"])
        e = F.transform(p["z"], lambda x: F.exp((x - top) / m["heat"]))
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        known = F.slice(e, 1, len(families))
        best = F.coalesce(F.array_position(names, p["named"]), F.array_position(known, F.array_max(known))).cast("int")
        return F.struct(p["place"].alias("place"), p["kind"].alias("kind"), p["words"].alias("words"), F.element_at(names, best).alias("family"), (F.element_at(known, best) / total).alias("probability"))

    def compared(p: Column) -> Column:
        own = F.filter(templates, lambda t: t["family"] == p["family"])
        like = F.transform(own, lambda t: F.size(F.array_intersect(t["words"], p["words"])).cast("double") / F.size(t["words"]))
        return F.struct(p["place"].cast("long").alias("paragraph"), p["family"].alias("family"), F.round(p["probability"], 4).alias("probability"), F.round(F.array_max(like), 4).alias("similarity"), p["kind"].alias("kind"))

    def told(found: Column) -> Column:
        """One of each family and line; of windows, those that nothing nearer tells of."""

        def first(p: Column) -> Column:
            same = F.filter(found, lambda q: q["family"] == p["family"])
            nearer = F.exists(same, lambda q: F.when(q["kind"] == WINDOW, q["paragraph"] == p["paragraph"] + 1).otherwise((q["paragraph"] >= p["paragraph"]) & (q["paragraph"] < p["paragraph"] + lines)))
            by_line = F.exists(same, lambda q: (q["kind"] == LINE) & (q["paragraph"] == p["paragraph"]))
            return F.when(p["kind"] == LINE, True).when(p["kind"] == NOTICE, ~by_line).otherwise(~nearer)

        return F.array_distinct(F.transform(F.filter(found, first), lambda p: F.struct(*[p[c].alias(c) for c in ("paragraph", "family", "probability", "similarity")])))

    def judge(units: Column) -> Column:
        found = F.transform(F.transform(F.transform(units, judged), softened), compared)
        fits = F.filter(found, lambda p: (p["kind"] == NOTICE) | (p["probability"] >= m["level"]) & (p["similarity"] >= share))
        return F.array_sort(_bound(fits, told))

    whole = _bound(F.lower(text), lambda low: _bound(F.split(low, "\n", -1), lambda rows: judge(F.concat(F.when(low.rlike(cue), parts(rows)).otherwise(none), F.when(low.rlike(ANCHOR), notices(low, rows)).otherwise(none)))))
    return docs.withColumn("licenses", whole)


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, families (sorted, comma-joined), places (paragraph:family,
    comma-joined) of scan()."""
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda p: p["family"])))
    places = F.transform("licenses", lambda p: F.concat_ws(":", p["paragraph"].cast("string"), p["family"]))
    return scanned.select("doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.array_join(families, ",").alias("families"), F.array_join(places, ",").alias("places"))
