"""Licence notices by the Dice coefficient over word bigrams, in DataFrame functions only.

A text's units are its lines and, if it has several, the whole of it; and places inside it, see
below. A unit is normalised (lower case, runs of anything but letters and digits become one space) and becomes the set of its word
bigrams; a template does too. A unit shows a template if twice the number of shared bigrams,
over the sum of both sizes, is at least the least coefficient t.

Sizes bound the coefficient: for sizes a and b it is at most 2 min(a, b) / (a + b), so only
templates with t / (2 - t) * a <= b <= (2 - t) / t * a are compared with a unit of size a; most units are
compared with none.

Some notices differ by a few words (those of one family of licences, say). Templates whose own
coefficient is half or more are rivals: of rivals that a unit shows only the likest counts.

A shared bigram needs its words. A unit that reaches t with a template of size b shares at least
t / (2 - t) * b of its bigrams, so it has a word of any set of words that all but fewer bigrams
contain. A small such set is chosen for all templates together; text without any of these words
is not normalised at all. This loses nothing: it is a bound like that on sizes.

Places are runs of consecutive words, over line ends or inside a line, so that a wrapped notice or
one sentence of a line is found too. A run that reaches t has at most (2 - t) / t times as many
bigrams as its template; one that begins or ends with a bigram the template lacks is no better
than without it. So only runs from one of the template's bigrams to another are compared, and
only from where enough different ones lie within that length. Larger templates are placed first (rivals count as equally large, and of them the run that
shares most bigrams goes first), then greater coefficients, then earlier runs; a run that overlaps a placed one is left out, as it is part of the
same notice. A place is a unit of its own unless a line it touches, or the whole text, shows its
template already.

At scale: everything is a projection of the row it is about: no shuffle, no join, nothing
collected. The templates are literals in the plan; they are few, and their number is limited by
``MOST_TEMPLATES``, beyond which the call fails instead of leaving any out.

Defined results: null, empty or one-word text has no bigrams and shows nothing. Equal
coefficients: the lesser name is the best. Repeated rows are judged one by one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import text_column

LEAST_DICE = 0.8
MOST_TEMPLATES = 1000

#: Wording of public licence notices.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "Apache-2.0-terms": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD": "Released under the BSD License",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "MIT-terms": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software."
    ),
    "all-rights-reserved": "All rights reserved",
}

#: Templates whose own coefficient is at least this are rivals.
RIVAL_DICE = 0.5


#: Words of ordinary prose, which tell least about a text.
COMMON = frozenset("a an and any as at be by for free from in is it not of on or out so that the this to under with without you".split())


def words_of(text: str) -> list[str]:
    """The words of a template, as :func:`words` finds those of a column."""
    plain = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in _lower(text))
    return plain.split()


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words(text: Column) -> Column:
    """ASCII letters and digits in lower case; everything else parts words."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bigrams(found: Column) -> Column:
    """The set of bigrams of an array of words."""
    last = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, F.lit(1), last), F.slice(found, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def needed_words(sets: Mapping[str, list[str]], least: float) -> list[str]:
    """Words of which every unit that shows a template has one, few and long ones first."""
    missing = {name: len(grams) - ceil(least * len(grams) / (2 - least) - 1e-9) + 1 for name, grams in sets.items()}
    left = {name: set(grams) for name, grams in sets.items()}
    found: list[str] = []
    while any(n > 0 for n in missing.values()):
        gains: dict[str, int] = {}
        for name, grams in left.items():
            if missing[name] > 0:
                touched: dict[str, int] = {}
                for gram in grams:
                    for word in set(gram.split()):
                        touched[word] = touched.get(word, 0) + 1
                for word, n in touched.items():
                    gains[word] = gains.get(word, 0) + min(n, missing[name])
        best = max(sorted(gains), key=lambda w: (w not in COMMON, gains[w] * len(w) ** 2))
        found.append(best)
        for name, grams in left.items():
            gone = {g for g in grams if best in g.split()}
            left[name] = grams - gone
            missing[name] -= len(gone)
    return found


def _has_any(text: Column, needed: list[str]) -> Column:
    """Whether the words occur in the text, as parts of others too; lower() changes ASCII letters like translate()."""
    lower, found = F.lower(text), F.lit(False)
    for word in needed:
        found = found | F.contains(lower, F.lit(word))
    return F.coalesce(found, F.lit(False))


def _sets(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Bigrams of the templates that have any."""
    sets = {name: bigrams_of(text) for name, text in sorted(templates.items())}
    return {name: grams for name, grams in sets.items() if grams}


def rivals(sets: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """For each template the others so like it that a text showing one may seem to show the other."""
    size = {n: len(g) for n, g in sets.items()}
    alike = lambda a, b: 2 * len(set(sets[a]) & set(sets[b])) >= RIVAL_DICE * (size[a] + size[b])
    return {a: [b for b in sets if b != a and alike(a, b)] for a in sets}


def _literals(sets: Mapping[str, list[str]], templates: Mapping[str, str], least: float) -> Column:
    """The templates as one constant array, so that the plan does not grow with their number.

    ``order`` places the larger first, rivals as if all were as large as the largest of them.
    """
    near = rivals(sets)
    rows = [
        {
            "license": name,
            "size": len(grams),
            "grams": grams,
            "rivals": near[name],
            "order": -max(len(sets[n]) for n in (name, *near[name])),
            "least_shared": ceil(least * len(grams) / (2 - least) - 1e-9),
            "longest": floor((2 - least) / least * (len(words_of(templates[name])) - 1) + 1e-9),
        }
        for name, grams in sets.items()
    ]
    kind = "array<struct<license:string,size:int,grams:array<string>,rivals:array<string>,order:int,least_shared:int,longest:int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def notices(unit: Column, templates: Mapping[str, str], least: float) -> Column:
    """array<struct<license, dice>> of the templates that a unit shows, of rivals the likest only."""
    sets = _sets(templates)
    kind = "array<struct<license:string,dice:double>>"
    if not sets:
        return F.array().cast(kind)
    known = _literals(sets, templates, least)

    def compared(grams: Column) -> Column:
        size = F.size(grams)
        # only templates within the bounds are compared
        near = F.filter(known, lambda t: least * (size + t["size"]) <= 2 * F.least(size, t["size"]))

        def against(t: Column) -> Column:
            dice = 2 * F.size(F.array_intersect(grams, t["grams"])) / (size + t["size"])
            return F.struct(t["license"].alias("license"), dice.alias("dice"), t["rivals"].alias("rivals"))

        return _let(F.filter(F.transform(near, against), lambda s: s["dice"] >= least), best)

    def best(found: Column) -> Column:
        def beaten(s: Column) -> Column:
            better = lambda o: (o["dice"] > s["dice"]) | ((o["dice"] == s["dice"]) & (o["license"] < s["license"]))
            return F.exists(found, lambda o: F.array_contains(s["rivals"], o["license"]) & better(o))

        left = F.filter(found, lambda s: ~beaten(s))
        return F.transform(left, lambda s: F.struct(s["license"].alias("license"), s["dice"].alias("dice")))

    shown = _let(bigrams(words(unit)), compared)
    return F.when(_has_any(unit, needed_words(sets, least)), shown).otherwise(F.array().cast(kind))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def places(lines: Column, templates: Mapping[str, str], least: float) -> Column:
    """array<struct<license, dice, first, last>> of the runs of words that show a template, none
    overlapping another, with the numbers of the lines they begin and end in."""
    sets = _sets(templates)
    if not sets:
        return F.array().cast("array<struct<license:string,dice:double,first:int,last:int>>")
    every = sorted({g for grams in sets.values() for g in grams})

    known = _literals(sets, templates, least)

    def runs(t: Column, hits: Column, grams: Column) -> Column:
        """For each begin the best run of one template: greatest coefficient, then shortest."""
        size, least_shared, longest = t["size"], t["least_shared"], t["longest"]

        def best(own: Column, at: Column) -> Column:
            begin = F.get(own, at)
            near = F.filter(F.slice(own, at + 1, longest), lambda x: x["k"] < begin["k"] + longest)

            def until(near: Column, n: Column) -> Column:
                end = F.get(near, n - 1)
                shared = F.size(F.array_distinct(F.transform(F.slice(near, F.lit(1), n), lambda x: x["g"])))
                length = end["k"] - begin["k"] + 1
                found = F.size(F.array_distinct(F.transform(F.slice(grams, begin["k"] + 1, length), lambda x: x["g"])))
                return F.struct(
                    (-2 * shared / (found + size)).alias("minus_dice"),
                    begin["k"].alias("begin"),
                    end["k"].alias("end"),
                    t["license"].alias("license"),
                    begin["first"].alias("first"),
                    end["last"].alias("last"),
                    (-shared).alias("minus_shared"),
                )

            def chosen(near: Column) -> Column:
                enough = F.size(F.array_distinct(F.transform(near, lambda x: x["g"]))) >= least_shared
                ends = F.sequence(least_shared, F.size(near))
                return F.when(enough, F.array_min(F.transform(ends, lambda n: until(near, n))))

            return _let(near, chosen)

        def begins(own: Column) -> Column:
            dense = lambda at: F.get(own, at + least_shared - 1)["k"] < F.get(own, at)["k"] + longest
            at = F.filter(F.sequence(F.lit(0), F.size(own) - least_shared), dense)
            found = F.filter(F.transform(at, lambda k: best(own, k)), lambda r: r["minus_dice"] <= -least)
            # of rivals the one that shares most is placed, not a shorter one that lies in it whole
            rank = lambda r: F.when(F.size(t["rivals"]) > 0, r["minus_shared"]).otherwise(0)
            columns = ("minus_dice", "begin", "end", "license", "first", "last")
            ranked = lambda r: F.struct(t["order"].alias("order"), rank(r).alias("rank"), *[r[c].alias(c) for c in columns])
            return F.when(F.size(own) >= least_shared, F.transform(found, ranked))

        return _let(F.filter(hits, lambda x: F.array_contains(t["grams"], x["g"])), begins)

    def placed(candidates: Column) -> Column:
        apart = lambda done, r: ~F.exists(done, lambda d: (d["begin"] <= r["end"] + 1) & (r["begin"] <= d["end"] + 1))
        none = F.filter(candidates, lambda r: F.lit(False))
        return F.aggregate(candidates, none, lambda done, r: F.when(apart(done, r), F.array_append(done, r)).otherwise(done))

    def found(grams: Column) -> Column:
        hits = F.filter(grams, lambda x: x["g"].isin(every))
        by_template = lambda hits: F.flatten(F.filter(F.transform(known, lambda t: runs(t, hits, grams)), lambda r: r.isNotNull()))
        return _let(F.array_sort(_let(hits, by_template)), placed)

    def numbered(line: Column, k: Column) -> Column:
        return F.transform(words(line), lambda w: F.struct(w.alias("w"), k.alias("line")))

    def pairs(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - 1, F.lit(0))
        made = F.zip_with(
            F.slice(tokens, F.lit(1), last),
            F.slice(tokens, F.lit(2), last),
            lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("g"), a["line"].alias("first"), b["line"].alias("last")),
        )
        return F.transform(made, lambda x, k: F.struct(x["g"].alias("g"), k.alias("k"), x["first"].alias("first"), x["last"].alias("last")))

    runs_of_text = _let(_let(F.flatten(F.transform(lines, numbered)), pairs), found)
    kept = lambda r: F.struct(r["license"].alias("license"), (-r["minus_dice"]).alias("dice"), r["first"].alias("first"), r["last"].alias("last"))
    return F.transform(runs_of_text, kept)


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    least: float = LEAST_DICE,
) -> DataFrame:
    """(id, n_lines, n_notices, licenses, best_license, best_dice) for every row: lines, units (places
    among them) that show a template, the names shown (sorted, comma-joined), and the best of them."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; more than {MOST_TEMPLATES} do not belong in a plan")
    text = text_column(docs, text_col)
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    several = F.size(lines) > 1
    units = F.concat(lines, F.when(several, F.array(text)).otherwise(F.array().cast("array<string>")))
    shown = F.transform(units, lambda unit: notices(unit, templates, least))
    possible = _has_any(text, needed_words(_sets(templates), least))
    shown = F.when(possible, shown).otherwise(F.array().cast("array<array<struct<license:string,dice:double>>>"))
    within = places(lines, templates, least)
    within = F.when(possible, within).otherwise(F.array().cast("array<struct<license:string,dice:double,first:int,last:int>>"))
    bare = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.size(lines).cast("bigint").alias("n_lines"),
        shown.alias("shown"),
        within.alias("within"),
    )
    # lines come first in shown, the whole text after them
    known = lambda units, p: F.exists(units, lambda unit: F.exists(unit, lambda s: s["license"] == p["license"]))
    touched = lambda p: F.slice("shown", p["first"] + 1, p["last"] - p["first"] + 1)
    whole = F.filter("shown", lambda unit, k: k >= F.col("n_lines"))
    more = F.filter("within", lambda p: ~known(touched(p), p) & ~known(whole, p))
    more = F.transform(more, lambda p: F.array(F.struct(p["license"].alias("license"), p["dice"].alias("dice"))))
    bare = bare.select(id_col, "n_lines", F.concat("shown", more).alias("shown"))
    flat = F.flatten("shown")
    best = F.array_max(F.transform(flat, lambda s: s["dice"]))
    names = F.array_sort(F.array_distinct(F.transform(flat, lambda s: s["license"])))
    first = F.array_min(F.transform(F.filter(flat, lambda s: s["dice"] == best), lambda s: s["license"]))
    return bare.select(
        id_col,
        "n_lines",
        F.size(F.filter("shown", lambda s: F.size(s) > 0)).cast("bigint").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        first.alias("best_license"),
        best.alias("best_dice"),
    )
