"""License scan with ordered signature rules, in DataFrame functions only.

A rule has a keyword, a regex, a priority and a label. Texts without any word of the gate, one of which
is in all that rules can match, are only counted; in the others, a rule's regex runs only if its own
keyword occurs, and its places are looked up only if it matches. Where detections overlap, one that lies
inside another is dropped if the other has a better priority or, at the same priority, is longer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import begins, bound, running

#: Characters of words and of what is between them; A-Z count as a-z, so regexes ignore ASCII case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int


#: Words that don't tell one license from another.
_COMMON = set("a and agreement free general index license licence library name new of open or public software source the to".split())


def keyword(words: str) -> str:
    """The word that a rule of a phrase looks for first."""
    own = words.split()
    return min([w for w in own if w not in _COMMON] or own, key=lambda w: (-len(w), w))


def phrase(words: str) -> str:
    """A regex of whole consecutive words."""
    return f"(?i)(?<!{WORD}){GAP.join(words.split())}(?!{WORD})"


# The phrases that count as places, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families with their public names and versions.
FAMILIES = {
    "GPL": ("gnu general public license", "1.0 2.0 3.0"),
    "LGPL": ("gnu lesser general public license", "2.1 3.0"),
    "LGPL-library": ("gnu library general public license", "2.0"),
    "AGPL": ("gnu affero general public license", "1.0 3.0"),
    "GFDL": ("gnu free documentation license", "1.1 1.2 1.3"),
    "Apache": ("apache license", "1.0 1.1 2.0"),
    "MPL": ("mozilla public license", "1.0 1.1 2.0"),
    "EPL": ("eclipse public license", "1.0 2.0"),
    "CDDL": ("common development and distribution license", "1.0 1.1"),
    "EUPL": ("european union public licence", "1.0 1.1 1.2"),
    "CPL": ("common public license", "1.0"),
    "IPL": ("ibm public license", "1.0"),
    "OSL": ("open software license", "1.0 1.1 2.0 2.1 3.0"),
    "AFL": ("academic free license", "1.1 1.2 2.0 2.1 3.0"),
    "APSL": ("apple public source license", "1.0 1.1 1.2 2.0"),
    "Artistic": ("artistic license", "1.0 2.0"),
    "BSL": ("boost software license", "1.0"),
    "BUSL": ("business source license", "1.1"),
    "CECILL": ("cecill free software license agreement", "1.0 1.1 2.0 2.1"),
    "CPAL": ("common public attribution license", "1.0"),
    "ECL": ("educational community license", "1.0 2.0"),
    "EFL": ("eiffel forum license", "1.0 2.0"),
    "LPPL": ("latex project public license", "1.0 1.1 1.2 1.3"),
    "MS-PL": ("microsoft public license", ""),
    "MS-RL": ("microsoft reciprocal license", ""),
    "NPL": ("netscape public license", "1.0 1.1"),
    "OFL": ("sil open font license", "1.0 1.1"),
    "OLDAP": ("openldap public license", "2.0 2.3 2.7 2.8"),
    "ODbL": ("open database license", "1.0"),
    "PHP": ("php license", "3.0 3.01"),
    "PSF": ("python software foundation license", "2.0"),
    "QPL": ("q public license", "1.0"),
    "RPL": ("reciprocal public license", "1.1 1.5"),
    "SPL": ("sun public license", "1.0"),
    "SSPL": ("server side public license", "1.0"),
    "UPL": ("universal permissive license", "1.0"),
    "W3C": ("w3c software notice and license", ""),
    "ZPL": ("zope public license", "1.1 2.0 2.1"),
    "ISC": ("isc license", ""),
    "Zlib": ("zlib license", ""),
    "NCSA": ("university of illinois ncsa open source license", ""),
    "PostgreSQL": ("postgresql license", ""),
    "Sleepycat": ("sleepycat license", ""),
    "Unlicense": ("the unlicense", ""),
    "Elastic": ("elastic license", "2.0"),
    "MIT": ("mit license", ""),
    "BSD-2-Clause": ("simplified bsd license", ""),
    "BSD-3-Clause": ("new bsd license", ""),
    "BSD": ("bsd license", ""),
}
CC_FORMS = {
    "BY": "attribution", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC": "attribution noncommercial",
    "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives",
}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Sentences of license texts.
SENTENCES = {
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "BSD": "redistribution and use in source and binary forms with or without modification are permitted",
    "BSD-3-Clause": "neither the name of the copyright holder nor the names of its contributors may be used",
    "BSD-4-Clause": "all advertising materials mentioning features or use of this software must display",
    "Apache-2.0": "you may not use this file except in compliance with the license",
    "GPL-2.0-or-later": "either version 2 of the license or at your option any later version",
    "GPL-3.0-or-later": "either version 3 of the license or at your option any later version",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
    "BSL-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy",
    "WTFPL": "do what the fuck you want to public license",
    "CC0-1.0": "to the extent possible under law the person who associated cc0 with this work has waived all copyright",
    "public-domain": "placed in the public domain",
    "proprietary": "all rights reserved",
    "confidential": "proprietary and confidential",
}


#: Hand-written signatures, a space standing for what is between words: priority, label, regex.
#: 1: dual licenses and exceptions, 2: notices and headers, 3: short names, 4: hints.
SIGNATURES = [
    # dual licenses
    (1, "Apache-2.0 OR MIT", "licensed under either of(?: the)? (?:apache license|mit license)"),
    (1, "Apache-2.0 OR MIT", "dual licensed under(?: the)? (?:mit(?: license)? (?:and|or)(?: the)? apache|apache(?: license)?(?: version)?(?: 2(?: 0)?)? (?:and|or)(?: the)? mit)"),
    (1, "GPL OR MIT", "dual licensed under(?: the)? (?:mit(?: license)? (?:and|or)(?: the)? gpl|gpl (?:and|or)(?: the)? mit)"),
    (1, "BSD OR GPL", "dual licensed under(?: the)? (?:bsd(?: license)? (?:and|or)(?: the)? gpl|gpl (?:and|or)(?: the)? bsd)"),
    (1, "BSD OR GPL", "dual bsd gpl"),
    (1, "GPL OR MIT", "dual mit gpl"),
    (1, "GPL OR MPL", "dual mpl gpl"),
    (1, "GPL-2.0 OR LGPL-2.1 OR MPL-1.1", "mpl 1 1 gpl 2 0 lgpl 2 1"),
    (1, "Artistic OR GPL", "(?:under|on) the same terms as perl(?: itself)?"),
    (1, "CDDL OR GPL-2.0", "cddl(?: 1 [01])? (?:and|or|plus) gpl(?: ?v?2)?"),
    (1, "CDDL OR GPL-2.0", "the gnu general public license version 2 only gpl or the common development and distribution license"),
    (1, "dual", "double licen[cs]e[ds]? under"),
    # exceptions
    (1, "Classpath-exception", "classpath exception"),
    (1, "Classpath-exception", "linking this library statically or dynamically with other modules is making a combined work"),
    (1, "GCC-exception", "gcc runtime library exception"),
    (1, "Bison-exception", "you may create a larger work that contains part or all of the bison parser skeleton"),
    (1, "Autoconf-exception", "a program that contains a configuration script generated by autoconf"),
    (1, "LLVM-exception", "(?:with )?llvm exceptions?"),
    (1, "Linux-syscall-note", "linux syscall note"),
    (1, "Linux-syscall-note", "user programs that use kernel services by normal system calls"),
    (1, "Font-exception", "if you create a document which uses this font and embed this font"),
    (1, "OpenSSL-exception", "openssl (?:linking )?exception"),
    (1, "WxWindows-exception", "wxwindows (?:library )?exception"),
    (1, "FOSS-exception", "universal foss exception"),
    (1, "Commons-Clause", "commons clause(?: license)?(?: condition)?"),
    # notices of the gnu licenses
    (2, "GPL-2.0-only", "version 2 of the license only"),
    (2, "GPL-2.0-only", "gnu general public license(?: as published by the free software foundation)? version 2 only"),
    (2, "GPL-3.0-only", "gnu general public license(?: as published by the free software foundation)? version 3 only"),
    (2, "GPL-2.0-or-later", "gnu general public license(?: gpl)? (?:version|v) ?2(?: 0)? or (?:at your option )?(?:any )?later"),
    (2, "GPL-3.0-or-later", "gnu general public license(?: gpl)? (?:version|v) ?3(?: 0)? or (?:at your option )?(?:any )?later"),
    (2, "LGPL-2.1-or-later", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1(?: of the license)? or (?:at your option )?any later"),
    (2, "LGPL-3.0-or-later", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or (?:at your option )?any later"),
    (2, "AGPL-3.0-or-later", "gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or (?:at your option )?any later"),
    (2, "GFDL", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (2, "GPL", "this program is free software(?: you can redistribute it and or modify it)? under the terms of the gnu general public license"),
    (2, "LGPL", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (2, "GPL", "you should have received a copy of the gnu general public license"),
    (2, "LGPL", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    (2, "AGPL", "you should have received a copy of the gnu affero general public license"),
    # notices and headers of others
    (2, "Apache-2.0", "licensed under the apache license version 2 0(?: the license)?"),
    (2, "Apache-2.0", "under one or more contributor license agreements"),
    (2, "Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (2, "MIT", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    (2, "MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (2, "BSD", "(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?bsd licen[cs]e"),
    (2, "BSD", "governed by a bsd style licen[cs]e"),
    (2, "BSD", "redistributions in binary form must reproduce the above copyright notice"),
    (2, "MPL-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (2, "MPL-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (2, "EPL", "made available under the terms of the eclipse public license"),
    (2, "CDDL", "subject to the terms of the common development and distribution license"),
    (2, "BSL-1.0", "distributed under the boost software license(?: version 1 0)?"),
    (2, "OFL", "this font software is licensed under the sil open font license"),
    (2, "Unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (2, "Zlib", "the origin of this software must not be misrepresented"),
    (2, "FSFAP", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    (2, "JSON", "the software shall be used for good not evil"),
    (2, "Beerware", "you can buy me a beer in return"),
    (2, "ODC-By", "open data commons attribution license"),
    (2, "ODbL", "open data commons open database license"),
    (2, "PDDL", "open data commons public domain dedication(?: and)? license"),
    (2, "community", "(?:model|llama)(?: [0-9])*(?: model)? community license(?: agreement)?"),
    (2, "OpenRAIL", "(?:creativeml |bigscience )?openrail(?: [a-z])?(?: license)?"),
    # short names
    (3, "GPL-2.0", "gplv2(?: 0)?"),
    (3, "GPL-3.0", "gplv3(?: 0)?"),
    (3, "LGPL-2.1", "lgplv2(?: 1)?"),
    (3, "LGPL-3.0", "lgplv3"),
    (3, "AGPL-3.0", "agplv3"),
    (3, "BSD-2-Clause", "(?:2|two) clause bsd(?: licen[cs]e)?"),
    (3, "BSD-3-Clause", "(?:3|three) clause bsd(?: licen[cs]e)?"),
    (3, "BSD-4-Clause", "(?:4|four) clause bsd(?: licen[cs]e)?"),
    (3, "0BSD", "(?:0|zero) clause bsd(?: licen[cs]e)?"),
    (3, "BSD-3-Clause", "(?:modified|revised) bsd license"),
    (3, "BSD-4-Clause", "original bsd license"),
    (3, "BSD-2-Clause", "freebsd license"),
    (3, "CC0-1.0", "cc0(?: 1 0)?(?: universal| public domain dedication)"),
    (3, "CC0-1.0", "creative commons zero"),
    (3, "WTFPL", "wtfpl"),
    (3, "Libpng", "(?:zlib )?libpng license"),
    (3, "OpenSSL", "openssl license"),
    (3, "Ruby", "ruby license"),
    (3, "Vim", "vim license"),
    (3, "curl", "curl license"),
    (3, "X11", "x11 license"),
    (3, "Info-ZIP", "info zip license"),
    (3, "TCL", "tcl tk license"),
    (3, "Beerware", "the beer ware license"),
    (3, "Hippocratic", "hippocratic license"),
    # hints
    (4, "public-domain", "(?:released|dedicated) (?:in)?to the public domain"),
    (4, "public-domain", "no rights reserved"),
    (4, "proprietary", "unauthorized copying of this (?:file|software)"),
    (4, "proprietary", "is the (?:confidential and )?proprietary information of"),
    (4, "EULA", "end user license agreement"),
    (4, "proprietary", "may not be redistributed"),
    (4, "noncommercial", "non ?commercial use only"),
    (4, "research-only", "for research purposes only"),
    (4, "evaluation-only", "for evaluation purposes only"),
]


def signature(words: str) -> str:
    """The regex of a hand-written signature."""
    return rf"(?i)(?<!{WORD})(?:{words.replace(' ?', f'(?:{GAP})?').replace(' ', GAP)})(?!{WORD})"


def always(words: str) -> list[str]:
    """The words of a hand-written signature that are outside of all groups, so that each match has them."""
    before = None
    while before != words:  # groups from the inside out
        before, words = words, re.sub(r"\(\?:[^()]*\)[?*]*", "", words)
    return re.findall(r"(?<!\S)\w+(?!\S)", words.replace(" ?", " ").replace("licen[cs]e", "licen"))


#: Each rule's matches hold one of these, or the words cc by.
GATE = {"licen", "spdx", "creative", *map(keyword, SENTENCES.values())}
GATE |= {keyword(" ".join(own)) for _, _, words in SIGNATURES if "licen" not in " ".join(own := always(words))}


#: Of rules, the best one first.
PRIORITIES = 1, 2, 3, 4


def rules() -> list[Rule]:
    """All rules in order: tags (1), sentences and names with a version (2), names alone (3), hints (4); then the hand-written signatures."""
    out = [Rule(label, keyword(words), phrase(words), 3) for words, label in BASE.items()]
    tag = rf"(?i)spdx{GAP}license{GAP}identifier\s*:\s*"
    for family, (name, versions) in FAMILIES.items():
        word = keyword(name)
        out += [Rule(family, word, phrase(name), 3), Rule(family, "spdx", rf"{tag}{family}(?![\w.-])", 1)]
        for version in versions.split():
            short = version.removesuffix(".0")
            number = version.replace(".", r"\.") if short == version else rf"{short}(?:\.0)?"
            between = rf"(?:{GAP}(?:version|v|ver))?{GAP}v?"
            out += [
                Rule(f"{family}-{version}", word, rf"(?i)(?<!{WORD}){GAP.join(name.split())}{between}{number}(?!{WORD}|\.\d)", 2),
                Rule(f"{family}-{version}", "spdx", rf"{tag}{family}-{number}(?:-only|-or-later|\+)?(?![\w-]|\.\d)", 1),
            ]
    for form, name in CC_FORMS.items():
        words = form.replace("-", "[ -]")
        out += [
            Rule(f"CC-{form}", "creativecommons.org", rf"(?i)creativecommons\.org/licenses/{form}(?![\w-])", 3),
            Rule(f"CC-{form}", "creative commons", rf"(?i)creative{GAP}commons{GAP}{GAP.join(name.split())}(?!{WORD})", 3),
        ]
        for version in CC_VERSIONS.split():
            number = version.replace(".", r"\.")
            out += [
                Rule(f"CC-{form}-{version}", "cc", rf"(?i)(?<!{WORD})cc[ -]{words}[ -]{number}(?!{WORD}|\.\d)", 1),
                Rule(f"CC-{form}-{version}", "creativecommons.org", rf"(?i)creativecommons\.org/licenses/{form}/{number}", 2),
            ]
    for label, words in SENTENCES.items():
        out.append(Rule(label, keyword(words), phrase(words), 2 if len(words) > 30 else 4))
    return out + [Rule(label, keyword(" ".join(always(words))), signature(words), priority) for priority, label, words in SIGNATURES]


def _places(text: Column, rule: Column) -> Column:
    """begin, end (in characters from 0), priority and label of each match of a rule."""
    regex = rule["regex"]
    found, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    sizes = F.zip_with(found, between, lambda m, x: F.struct(F.length(x).alias("gap"), F.length(m).alias("size")))  # the last gap has no match
    steps = lambda own: F.transform(own, lambda s: (s["gap"] + F.coalesce(s["size"], F.lit(0))).cast("long"))
    sums = lambda own: running(steps(own), lambda x, y: x + y, F.lit(0).cast("long"))
    place = lambda s, at: F.struct((at + s["gap"]).cast("int").alias("begin"), (at + s["gap"] + s["size"]).cast("int").alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
    placed = lambda own: F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(sums(own), 1, F.size(own) - 1), place)
    return bound(sizes, placed)


def _not_suppressed(rows: DataFrame) -> DataFrame:
    """Adds detections (begin, end, label): those of ``found`` that no other one suppresses.

    Sorted by begin and, the longest first, by end, whatever holds a detection comes before it. So one is
    suppressed if the largest end before it, among those of its priority or a better one, reaches its own
    end. Detections of one place and priority stand or fall together.
    """
    rows = rows.withColumn("sorted", F.array_sort(F.transform("found", lambda d: F.struct(d["begin"].alias("begin"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label")))))
    rows = rows.withColumn("begins", begins("sorted", lambda x, y: (x["begin"] == y["begin"]) & (x["back"] == y["back"]) & (x["priority"] == y["priority"])))
    rows = rows.withColumn("tops", F.transform("begins", lambda i: F.get("sorted", i)))

    def reach(p: int) -> Column:
        ends = F.transform("tops", lambda t: F.when(t["priority"] <= p, -t["back"]).otherwise(-1).cast("long"))
        return running(ends, lambda x, y: F.greatest(x, y), F.lit(-1).cast("long"))

    def left_over(reaches: Column) -> Column:
        return F.transform("tops", lambda t, k: F.when(F.get(F.get(reaches, t["priority"] - 1), k) < -t["back"], k))

    # bound: within a function of elements a column that is used once would be computed for each of them
    rows = rows.withColumn("left", bound(F.array(*map(reach, PRIORITIES)), left_over))
    group = lambda k: F.slice("sorted", F.get("begins", k) + 1, F.coalesce(F.get("begins", k + 1), F.size("sorted")) - F.get("begins", k))
    left = F.flatten(F.transform(F.filter("left", lambda k: k.isNotNull()), group))
    rows = rows.withColumn("left", F.array_sort(F.transform(left, lambda d: F.struct(d["begin"].alias("begin"), (-d["back"]).alias("end"), d["label"].alias("label")))))
    rows = rows.withColumn("detections", F.transform(begins("left", lambda x, y: x == y), lambda i: F.get("left", i)))
    return rows.drop("sorted", "begins", "tops", "left")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in each whole text.

    Returns a row for every row of ``docs``: doc_id, n_words, n_base (places of the ``BASE`` phrases),
    first_word and last_word (least and largest start of these, in words from 0, or null), base_labels
    and labels (sorted; labels has the base ones and those of all detections left), detections (begin
    and end in characters, label) and score, n / (n + 1) of n places and other detections.

    A null text counts as empty: no words, no labels, score 0. Ids may be null or repeat; other
    columns are not looked at. Texts may be of any length: work is nearly linear in it and in the
    number of detections.
    """
    own = rules()
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority")) for r in own])
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # columns of their own, each computed once a row
    low = F.col("low")
    gate = reduce(or_, [F.contains(low, F.lit(k)) for k in sorted(GATE)]) | (F.contains(low, F.lit("cc")) & F.col("text").rlike(rf"(?i)(?<!{WORD})cc{GAP}by(?!{WORD})"))
    picked = F.filter(table, lambda r: F.contains(low, r["keyword"]) & F.rlike("text", r["regex"]))
    found = F.flatten(F.transform(picked, lambda r: _places(F.col("text"), r)))
    none = F.array().cast("array<struct<begin:int,end:int,priority:int,label:string>>")
    rows = docs.withColumn("low", F.lower("text")).withColumn("gated", gate)
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(f"{WORD}+")).cast("long").alias("n_words"), F.when(F.col("gated"), found).otherwise(none).alias("found"))
    base = F.array(*[F.lit(x) for x in BASE.values()])
    rows = rows.withColumn("base", F.filter("found", lambda d: F.array_contains(base, d["label"])))
    rows = _not_suppressed(rows)
    starts = F.transform("base", lambda d: d["begin"])
    words = lambda n: F.regexp_count(F.substring("text", F.lit(1), n), F.lit(f"{WORD}+")).cast("long")
    names = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"])))
    n = F.size("base") + F.size(F.filter("detections", lambda d: ~F.array_contains(base, d["label"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(F.size("base") > 0, words(F.array_min(starts))).alias("first_word"),
        F.when(F.size("base") > 0, words(F.array_max(starts))).alias("last_word"),
        names("base").alias("base_labels"),
        F.array_sort(F.array_union(names("base"), names("detections"))).alias("labels"),
        "detections",
        (n / (n + 1.0)).alias("score"),
    )
