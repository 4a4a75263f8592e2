"""License scans by ordered signature rules.

Signatures are regular expressions over a text's words: sentences of license texts and notices, written
by hand, and the names of license families in the phrases in which a license is granted or named. A text is looked at more closely only if one of its words
is a signature's keyword, and then only in segments around these. In a segment only the signatures are
tried whose own keyword is among its words. Of the detections, each is suppressed whose interval of words lies within
that of one of the same or a higher priority. All is done row by row, by SQL functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import ascii_lower, table

#: Fixed phrases that are always counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: label, the keyword that gates its signatures, pattern of the name, versions with the pattern of each.
FAMILIES = [
    ("mit", "mit", "mit(?: x11| expat)?", {}),
    ("expat", "expat", "expat", {}),
    ("apache", "apache", "(?:the )?apache(?: software)?", {"1": "1(?: 0)?", "1.1": "1 1", "2": "2(?: 0)?"}),
    ("gpl", "gpl", "(?:gnu )?gpl", {"1": "v?1(?: 0)?", "2": "v?2(?: 0)?", "3": "v?3(?: 0)?"}),
    ("gpl", "gplv2", "gplv2", {}),
    ("gpl", "gplv3", "gplv3", {}),
    ("gpl", "gnu", "gnu general public", {"1": "v?1(?: 0)?", "2": "v?2(?: 0)?", "3": "v?3(?: 0)?"}),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", {"2": "v?2(?: 0)?", "2.1": "v?2 1", "3": "v?3(?: 0)?"}),
    ("lgpl", "lesser", "gnu lesser general public", {"2.1": "v?2 1", "3": "v?3(?: 0)?"}),
    ("lgpl", "library", "gnu library general public", {"2": "v?2(?: 0)?"}),
    ("agpl", "agpl", "(?:gnu )?agpl", {"1": "v?1(?: 0)?", "3": "v?3(?: 0)?"}),
    ("agpl", "affero", "gnu affero general public", {"3": "v?3(?: 0)?"}),
    ("fdl", "documentation", "gnu free documentation", {"1.1": "1 1", "1.2": "1 2", "1.3": "1 3"}),
    ("bsd", "bsd", "(?:new |modified |simplified |revised |original )?bsd", {"0": "0 clause", "1": "1 clause", "2": "(?:2|two) clause", "3": "(?:3|three) clause", "4": "(?:4|four) clause"}),
    ("mpl", "mozilla", "mozilla public", {"1": "1 0", "1.1": "1 1", "2": "2(?: 0)?"}),
    ("mpl", "mpl", "mpl", {"1": "1 0", "1.1": "1 1", "2": "2(?: 0)?"}),
    ("epl", "eclipse", "eclipse public", {"1": "1(?: 0)?", "2": "2(?: 0)?"}),
    ("cddl", "cddl", "cddl", {"1": "1(?: 0)?", "1.1": "1 1"}),
    ("cddl", "distribution", "common development and distribution", {"1": "1(?: 0)?", "1.1": "1 1"}),
    ("cc0", "cc0", "(?:creative commons )?cc0", {"1": "1(?: 0)?"}),
    ("artistic", "artistic", "artistic", {"1": "1(?: 0)?", "2": "2(?: 0)?"}),
    ("bsl", "boost", "boost software", {"1": "1(?: 0)?"}),
    ("eupl", "eupl", "eupl", {"1.1": "1 1", "1.2": "1 2"}),
    ("eupl", "union", "european union public", {"1.1": "1 1", "1.2": "1 2"}),
    ("ofl", "ofl", "(?:sil )?ofl", {"1": "1(?: 0)?", "1.1": "1 1"}),
    ("ofl", "font", "(?:sil )?open font", {"1": "1(?: 0)?", "1.1": "1 1"}),
    ("isc", "isc", "isc", {}),
    ("zlib", "zlib", "zlib(?: libpng)?", {}),
    ("python", "python", "python(?: software foundation)?", {"2": "2(?: 0)?"}),
    ("php", "php", "php", {"3": "3(?: 0)?", "3.01": "3 01"}),
    ("ruby", "ruby", "ruby", {}),
    ("openssl", "openssl", "openssl", {}),
    ("postgresql", "postgresql", "postgresql", {}),
    ("vim", "vim", "vim", {}),
    ("wtfpl", "wtfpl", "wtfpl", {"2": "2(?: 0)?"}),
    ("odbl", "odbl", "odbl", {"1": "1(?: 0)?"}),
    ("odbl", "database", "open database", {"1": "1(?: 0)?"}),
    ("ms-pl", "microsoft", "microsoft public", {}),
    ("ms-rl", "reciprocal", "microsoft reciprocal", {}),
    ("unlicense", "unlicense", "unlicense", {}),
    ("public-domain", "domain", "public domain", {}),
] + [
    (f"cc-{kind.replace(' ', '-')}", key, f"{name} {words}", {v: v.replace(".", " ") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")})
    for key, name in (("cc", "cc"), ("commons", "creative commons"))
    for kind, words in (("by", "(?:by|attribution)"), ("by sa", "(?:by sa|attribution sharealike|attribution share alike)"), ("by nd", "(?:by nd|attribution noderivs|attribution noderivatives)"), ("by nc", "(?:by nc|attribution noncommercial|attribution non commercial)"), ("by nc sa", "(?:by nc sa|attribution noncommercial sharealike)"), ("by nc nd", "(?:by nc nd|attribution noncommercial noderivs)"))
]
#: Sentences of license texts and notices: label, the keyword that gates it, pattern. They come before all names.
_ANY = "(?: [^ ]+){1,16}"
NOTICES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "(?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so(?! subject)"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", f"neither the names? of{_ANY} may be used to endorse or promote products derived from this software"),
    ("bsd-3", "endorse", "(?:the )?names? of(?: [^ ]+){1,6} may not be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("curl", "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsl-1", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("unicode", "unicode", "obtaining a copy of the unicode data files and any associated documentation"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "commercial", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "apache", "a copy of the license at https? www apache org licenses license 2 0"),
    ("apache", "apache", "this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2-or-later", "gnu", "the terms of the gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"),
    ("gpl-3-or-later", "gnu", "the terms of the gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl-2", "gnu", "the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1-or-later", "lesser", "the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version"),
    ("lgpl-3-or-later", "lesser", "the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3-or-later", "affero", "the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("fdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license(?: v)? ?2 0"),
    ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "accompanying", "the accompanying program is provided under the terms of this common public license"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php", "this product includes php(?: software)? freely available from"),
    ("python", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font names?"),
    ("eupl", "eupl", "licensed under the eupl(?: version [^ ]+(?: [^ ]+)?)?(?: or as soon they will be approved by the european commission)?"),
    ("artistic", "verbatim", "you may make and give away verbatim copies of the (?:source form of the )?standard version of this package"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc0-1", "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0-1", "waiving", "dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work"),
    ("cc-by", "attribution", "this work is licensed under a creative commons attribution(?: [1234] 0)? (?:international|unported|generic) license"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "noncommercial", "for noncommercial purposes only"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
]
#: Names that are words of other subjects too: of the first kind no weak phrase does, and a grant needs `license` or a version; of the second a weak phrase needs a version.
COMMON = {"python", "ruby", "vim", "php", "boost", "openssl", "postgresql"}
LOOSE = {"artistic", "expat", "database", "font", "union", "library", "distribution", "documentation"}
#: Phrases: priority, confidence, what stands before a name and, of a license, after it.
_GRANT = "(?:is |are )?(?:licensed|released|distributed|available|published|provided|made available|redistributed) (?:to you )?under (?:the )?(?:terms of (?:the )?)?"
_CALLED = " licen[sc]e"
PHRASES = [
    (3, 1.0, "spdx license identifier ", ""),
    (3, 0.95, _GRANT, f"(?:{_CALLED})?"),
    (2, 0.8, "", _CALLED),
    (1, 0.6, "(?:under|license|licence) (?:the )?", ""),
]
#: Before a name with a version these are enough.
_WEAK = "(?:under|license|licence|see|by) (?:the )?"
#: No signature is longer in words, nor any phrase with the longest name and version.
LONGEST = 64


def signatures() -> list[tuple[str, str, int, float, str]]:
    """Keyword, label, priority, confidence and pattern of each signature, in their order."""
    out = [(key, label, 4, 1.0, pattern) for label, key, pattern in NOTICES]
    for label, key, name, versions in FAMILIES:
        for priority, confidence, before, after in PHRASES:
            if weak := priority == 1:
                if key in COMMON:
                    continue
            for version, pattern in versions.items():
                v = f" (?:version |v )?{pattern}"
                out.append((key, f"{label}-{version.removesuffix('.0')}", priority, confidence, f"{_WEAK if weak else before}{name}(?:{after}{v}|{v}{after})" if after else f"{_WEAK if weak else before}{name}{v}"))
            if not (weak and key in LOOSE):
                out.append((key, label, priority, confidence, f"{before}{name}{_CALLED if key in COMMON and before == _GRANT else after}"))
    return out


#: Marks of a match's ends; control characters, which no word has.
_FROM, _TO = "\x01", "\x02"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _rules() -> Column:
    """keyword -> its signatures, a literal of a fixed size."""
    by: dict[str, list[dict]] = {}
    for i, (key, label, priority, confidence, pattern) in enumerate(signatures()):
        by.setdefault(key, []).append({"label": label, "priority": priority, "order": i, "confidence": confidence, "pattern": f"(?<= )(?:{pattern})(?= )"})
    return F.from_json(F.lit(json.dumps(by)), "map<string, array<struct<label: string, priority: int, `order`: int, confidence: double, pattern: string>>>")


def _detections(segment: Column) -> Column:
    """All matches in one segment (at, words): an array of (first, last, priority, order, label, confidence)."""
    text = F.concat(F.lit(" "), F.array_join(segment["words"], " "), F.lit(" "))
    rules_of = _rules()
    keys = F.array_intersect(segment["words"], F.map_keys(rules_of))
    rules = F.filter(F.flatten(F.transform(keys, lambda k: F.element_at(rules_of, k))), lambda r: F.rlike(text, r["pattern"]))

    def places(rule: Column) -> Column:
        # the first and last word of a match get a mark, which no word has otherwise
        marked = F.split(F.btrim(F.regexp_replace(text, rule["pattern"], F.lit(f"{_FROM}$0{_TO}"))), " ")
        at = lambda mark: F.filter(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        spans = F.arrays_zip(at(_FROM).alias("first"), at(_TO).alias("last"))
        return F.transform(spans, lambda x: F.struct((segment["at"] + x["first"]).alias("first"), (segment["at"] + x["last"]).alias("last"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    return F.flatten(F.transform(rules, places))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text is an empty one, without words: counts of 0, null places, empty labels, score 0. score is
    the highest confidence of a detection that stays; 1 for a base phrase. detections: label, first and
    last word, confidence of each that stays. Rows may repeat; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = docs.select(F.col(id_col).alias("id"), F.btrim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")).alias("norm"))
    # every signature and base phrase has a keyword among its words; lower() changes more than A-Z, but never takes a keyword away
    anchors = sorted({k for k, *_ in signatures()})
    gate = F.rlike(F.concat(F.lit(" "), F.col("lower"), F.lit(" ")), F.lit(f" (?:{'|'.join(anchors)}) "))
    norm = norm.withColumn("lower", F.lower("norm"))
    norm = norm.select(
        "id",
        F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1).cast("long").alias("n_words"),
        F.when(gate, ascii_lower(F.col("norm"))).alias("near"),
    )
    # each word between spaces of its own, so that phrases side by side are counted both
    norm = norm.withColumn("wide", F.concat(F.lit(" "), F.replace("near", F.lit(" "), F.lit("  ")), F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    back = F.reverse("wide")
    for phrase, label in BASE.items():
        p = f" {phrase.replace(' ', '  ')} "
        n = F.when(F.contains("wide", F.lit(p)), F.expr(f"(length(wide) - length(replace(wide, '{p}', ''))) div {len(p)}")).otherwise(F.lit(0).cast("long"))
        at = F.instr("wide", F.lit(p))
        before = F.substring(F.col("wide"), F.lit(1), at - 1)
        after = F.substring(back, F.lit(1), F.instr(back, F.lit(p[::-1])) - 1)
        counts.append(n)
        firsts.append(F.when(at > 0, _spaces(before) / 2))
        lasts.append(F.when(at > 0, F.col("n_words") - _spaces(after) / 2 - len(phrase.split())))
        labels.append(F.when(at > 0, F.lit(label)))
    words = F.when(F.col("near").isNotNull(), F.split("near", " "))
    norm = norm.select(
        "id",
        "n_words",
        F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        words.alias("w"),
    )
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*anchors), i)), lambda i: i.isNotNull())
    norm = norm.withColumn("hits", hits)
    # hits further apart than two signatures belong to two segments
    near = 2 * LONGEST
    first = F.filter("hits", lambda x, i: (i == 0) | (x - F.get(F.col("hits"), i - 1) > near))
    last = F.filter("hits", lambda x, i: (i == F.size("hits") - 1) | (F.get(F.col("hits"), i + 1) - x > near))
    norm = norm.withColumn("spans", F.arrays_zip(first.alias("first"), last.alias("last")))
    cuts = F.transform("spans", lambda s: F.struct(F.greatest(s["first"] - LONGEST, F.lit(0)).alias("at"), F.slice("w", F.greatest(s["first"] - LONGEST, F.lit(0)) + 1, s["last"] - F.greatest(s["first"] - LONGEST, F.lit(0)) + LONGEST + 1).alias("words")))
    norm = norm.withColumn("segments", cuts).drop("w", "hits", "spans")
    norm = norm.withColumn("found", F.flatten(F.transform("segments", _detections))).drop("segments")
    # of one start and priority only the longest can stay, and of these a text has few within LONGEST words
    key = lambda x: F.struct(x["first"].alias("first"), (-x["priority"]).alias("p"), (-x["last"]).alias("l"), x["order"].alias("order"), x["label"].alias("label"), x["confidence"].alias("confidence"))
    norm = norm.withColumn("found", F.sort_array(F.transform("found", key)))
    before = lambda i: F.get(F.col("found"), i - 1)
    norm = norm.withColumn("lead", F.filter("found", lambda x, i: (i == 0) | (x["first"] != before(i)["first"]) | (x["p"] != before(i)["p"])))
    wider = lambda x: F.struct(x["first"].alias("first"), x["l"].alias("l"), x["p"].alias("p"), x["order"].alias("order"), x["label"].alias("label"), x["confidence"].alias("confidence"))
    norm = norm.withColumn("lead", F.sort_array(F.transform("lead", wider))).drop("found")
    reach = (1 + len({p for p, *_ in PHRASES})) * (LONGEST + 1)
    inside = lambda x, i: F.exists(F.slice("lead", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), lambda b: (b["l"] <= x["l"]) & (b["p"] <= x["p"]))
    norm = norm.withColumn("stay", F.filter("lead", lambda x, i: ~inside(x, i))).drop("lead")
    none = F.array().cast("array<string>")
    all_labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("stay", lambda x: x["label"]), none))))
    best = F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(0.0), F.coalesce(F.array_max(F.transform("stay", lambda x: x["confidence"])).cast("double"), F.lit(0.0)))
    detections = F.coalesce(F.transform("stay", lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), (-x["l"]).alias("last"), x["confidence"].alias("confidence"))), F.array().cast("array<struct<label:string,first:int,last:int,confidence:double>>"))
    return norm.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), best.alias("score"), detections.alias("detections"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
