"""License scan by ordered signature rules (native).

Texts are lower-cased and read as words; rules are regular expressions over the
words joined by single blanks, ' w1 w2 ... ', so punctuation never hides a
phrase.  Three hand-written lists make the rules: sentences of the license
texts and file headers themselves, which need no license name, and license
names crossed with the phrase forms they stand in (several hundred rules).
Every rule has a keyword and runs only on texts that contain it.

Overlaps: detections are word intervals.  In the order (start, longer first,
higher priority, rule order) a detection is suppressed if an earlier one of at
least its priority contains it.  Sentences of license texts have the highest
priority, so a name inside one is not reported beside it.  The running maxima
of the ends per priority are found by doubling the reach of a maximum, so a
text of n detections costs n log n.  Base phrases are counted at all their
places and their labels always stay.  Repetitions of word groups are possessive:
the matcher neither recurses nor backtracks over long chains of numbers.

Everything is computed in the row: nothing is shuffled.  Edge cases: a null or
wordless text has no words and no detections (null first and last, empty
labels, score 0); repeated rows and null ids give rows like any other; other
columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import let, text_or_empty

#: Phrases whose places are counted, with their labels (fixed values).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

LIC = "licen[cs]e"
#: label, keyword that must occur, pattern of the name (hand-written).
NAMES = [
    ("gpl", "general public", f"(?:gnu )?general public {LIC}"), ("gpl", "gpl", "(?:gnu )?gpl(?:v?[123])?"),
    ("lgpl", "lesser general", f"(?:gnu )?lesser general public {LIC}"),
    ("lgpl", "library general", f"(?:gnu )?library general public {LIC}"), ("lgpl", "lgpl", "(?:gnu )?lgpl(?:v?[23])?"),
    ("agpl", "affero general", f"(?:gnu )?affero general public {LIC}"), ("agpl", "agpl", "(?:gnu )?agpl(?:v?3)?"),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {LIC}"),
    ("apache", "apache", f"apache (?:software )?{LIC}"), ("mit", "mit licen", f"mit {LIC}"),
    ("mit", "expat licen", f"expat {LIC}"), ("x11", "x11 licen", f"x11 {LIC}"),
    ("bsd", "bsd", f"(?:[0234] clause )?(?:new |modified |simplified |original )?bsd(?: [0234] clause)?(?: style)? {LIC}"),
    ("mpl", "mozilla public", f"mozilla public {LIC}"), ("epl", "eclipse public", f"eclipse public {LIC}"),
    ("edl", "eclipse distribution", f"eclipse distribution {LIC}"), ("cpl", "common public", f"common public {LIC}"),
    ("cddl", "common development", f"common development and distribution {LIC}"),
    ("isc", "isc licen", f"isc {LIC}"), ("zlib", "zlib", f"zlib(?: libpng)? {LIC}"),
    ("bsl-1.0", "boost software", f"boost software {LIC}"), ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"), ("wtfpl", "do what the", f"do what the f\\S+ you want to public {LIC}"),
    ("artistic", "artistic licen", f"(?:clarified )?artistic {LIC}"),
    ("cc0", "cc0", "cc0"), ("cc0", "commons zero", "creative commons zero"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc", "cc by nc", "cc by nc"), ("cc-by-sa", "cc by sa", "cc by sa"), ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by", "cc by", "cc by"),
    ("cc-by-sa", "commons attribution", "creative commons attribution share ?alike"),
    ("cc-by-nc-sa", "commons attribution", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc", "commons attribution", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons attribution", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", "commons attribution", "creative commons attribution"),
    ("ofl", "open font", f"(?:sil )?open font {LIC}"), ("ms-pl", "microsoft public", f"microsoft public {LIC}"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {LIC}"),
    ("psf", "python software", f"python software foundation {LIC}"), ("php", "php licen", f"php {LIC}"),
    ("ruby", "ruby licen", f"ruby {LIC}"), ("postgresql", "postgresql licen", f"postgresql {LIC}"),
    ("openssl", "openssl licen", f"openssl {LIC}"), ("qpl", "q public", f"q public {LIC}"),
    ("eupl", "european union public", f"european union public {LIC}"), ("eupl", "eupl", "eupl"),
    ("osl", "open software licen", f"open software {LIC}"), ("afl", "academic free", f"academic free {LIC}"),
    ("upl", "universal permissive", f"universal permissive {LIC}"), ("ncsa", "ncsa", f"ncsa(?: open source)? {LIC}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {LIC}"), ("vim", "vim licen", f"vim {LIC}"),
    ("lppl", "latex project", f"latex project public {LIC}"), ("curl", "curl licen", f"curl {LIC}"),
    ("odbl", "open database", f"open database {LIC}"), ("odbl", "odbl", "odbl"),
    ("odc-by", "open data commons", f"open data commons attribution {LIC}"),
    ("pddl", "public domain dedication", f"public domain dedication and {LIC}"),
    ("busl", "business source", f"business source {LIC}"), ("sspl", "server side public", f"server side public {LIC}"),
    ("elastic", "elastic licen", f"elastic {LIC}"), ("cecill", "cecill", "cecill(?: [abc])?"),
    ("intel", "intel open source", f"intel open source {LIC}"), ("ipl", "ibm public", f"ibm public {LIC}"),
    ("spl", "sun public", f"sun public {LIC}"), ("npl", "netscape public", f"netscape public {LIC}"),
    ("ecl", "educational community", f"educational community {LIC}"), ("0bsd", "zero clause", f"zero clause bsd(?: {LIC})?"),
    ("json", "json licen", f"json {LIC}"), ("beerware", "beerware", "beerware"),
    ("public-domain", "public domain", "public domain"), ("proprietary", "all rights reserved", "all rights reserved"),
]

GRANT = "(?:licensed|released|distributed|available|published|provided|issued|offered|covered|redistributed)"
CHAIN = "(?: \\d++(?= ))*+"  # further numbers of a version, each a whole word
VERSION = "(?: version| v)? v?\\d++" + CHAIN
#: priority, label prefix, form; {name} is the name's pattern (hand-written).
FORMS = [
    (5, "not-", f"(?:not|never|no longer) {GRANT} under (?:the )?(?:terms of (?:the )?)?{{name}}"),
    (4, "", f"{GRANT} under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{{name}}{VERSION}(?: or (?:any |at your option any )?later(?: version)?)?"),
    (4, "", f"{GRANT} under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{{name}}"),
    (4, "", f"spdx license identifier {{name}}{CHAIN}(?: only| or later)?"),
    (3, "", f"{{name}}{VERSION} or (?:any |at your option any )?later(?: version)?"),
    (3, "", f"(?:subject to|governed by|under the terms of|in accordance with|in compliance with) (?:the )?{{name}}"),
    (2, "", f"(?:a copy of|see|read|text of) (?:the )?{{name}}"),
    (2, "", f"{{name}}{VERSION}"),
    (1, "", "{name}"),
]
#: label, keyword, sentence of a license text or file header (hand-written).
TEXTS = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "except as contained", "except as contained in this notice the names? of (?:the )?(?:\\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("ncsa", "deal with the software", "to deal with the software without restriction"),
    ("json", "for good not evil", "the software shall be used for good not evil"),
    ("bsl-1.0", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("postgresql", "written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "its documentation for any", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "(?:neither the names? of|the names? of) (?:the )?(?:\\S+ ){1,12}(?:may not |may |to )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "submitted for inclusion", "any contribution intentionally submitted for inclusion in the work by you to the licensor"),
    ("gpl", "general public", "(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "general public", "(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "affero general", "(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public license along with"),
    ("lgpl", "received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "received a copy", "you should have received a copy of the gnu affero general public license along with"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mpl was not", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl", "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl", "eclipse distribution", "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cpl", "common public", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("cddl", "common development", "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("zlib", "held liable for any damages", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "name is changed", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", "worth it you can buy me", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", "with this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "statement of purpose", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights"),
    ("artistic", "package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "copyright holder maintains", "such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("ofl", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl", "licensed fonts", "the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    ("psf", "psf is making", "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "includes php software", "this product includes php software freely available from"),
    ("lppl", "latex project", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("vim", "vim maintainer", "the conditions under which changes to vim may be distributed|charityware you can use and copy it as much as you like"),
    ("cecill", "under french law", "this software is governed by the cecill(?: [abc])? license under french law and abiding by the rules of distribution of free software"),
    ("eupl", "eupl", "licensed under the eupl version 1 [012](?: or as soon they will be approved by the european commission subsequent versions of the eupl)?"),
    ("sspl", "as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("odbl", "database contents", "any rights in individual contents of the database are licensed under the database contents license"),
    ("ms-pl", "patent grant subject", "each contributor grants you a non exclusive worldwide royalty free license under its licensed patents"),
    ("upl", "larger works", "to deal in both a the software and b any piece of software and or hardware listed in the"),
    ("w3c", "w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("proprietary", "strictly prohibited", "unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? of (?:this|the) (?:file|software|document|program|code)(?: via any medium)?(?: in whole or in part)? is strictly prohibited"),
    ("proprietary", "proprietary information", "this (?:software|document|file|source code) is the confidential and proprietary information of"),
]
LEVELS = 6
#: Every name holds one of these; texts without any of them or of the sentences' keywords are not looked at further.
ANCHORS = ("licen", "gpl", "wtfpl", "cc by", "cc0", "commons", "eupl", "odbl", "cecill", "zero clause", "beerware",
           "public domain", "all rights reserved")


def anchors() -> list[str]:
    """What some keyword's texts hold; a keyword that holds an anchor needs none of its own."""
    return [*ANCHORS, *sorted({k for _, k, _ in TEXTS if not any(a in k for a in ANCHORS)})]


def rules() -> list[tuple[str, str, int, str]]:
    """(keyword, label, priority, pattern) of every rule, in order."""
    said = [(keyword, label, LEVELS, f"(?<= )(?:{sentence})(?= )") for label, keyword, sentence in TEXTS]
    return said + [(keyword, prefix + label, priority, "(?<= )" + form.format(name=name) + "(?= )")
                   for priority, prefix, form in FORMS for label, keyword, name in NAMES]


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _families() -> Column:
    """array<struct<keyword, rules: array<struct<rule, label, priority, pattern>>>> as a constant."""
    by_keyword: dict[str, list[str]] = {}
    for k, (keyword, label, priority, pattern) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(
            f"named_struct('rule', {k}, 'label', '{label}', 'priority', {priority}, 'pattern', {_quoted(pattern)})")
    return F.expr("array(" + ", ".join(f"named_struct('keyword', '{k}', 'rules', array({', '.join(r)}))"
                                       for k, r in by_keyword.items()) + ")")


def joined_words(text: Column) -> Column:
    """' w1 w2 ... wn ': words of letters, digits and non-ASCII characters, lower case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _blanks(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


PLACES = "cast(array() as array<struct<start: bigint, stop: bigint, text: string>>)"


def _places(words: Column, pattern: Column) -> Column:
    """array<struct<start, stop, text>>: the pattern's matches as word intervals.
    A mark is set before every match, so that its word's index is its start."""
    def intervals(found):
        marked = F.split(F.regexp_replace(words, pattern, F.lit("\x01$0")), " ", -1)
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\x01"), i - 1)), lambda i: i.isNotNull())
        return F.when(F.size(found) > 0, F.zip_with(starts, found, lambda at, hit: F.struct(
            at.cast("long").alias("start"), (at + 1 + _blanks(hit)).alias("stop"), hit.alias("text")))).otherwise(F.expr(PLACES))
    return let(F.regexp_extract_all(words, pattern, F.lit(0)), intervals)


def _candidates(words: Column) -> Column:
    """Matches of all rules whose keyword occurs, in suppression order."""
    def of_rule(r):
        return F.transform(_places(words, r["pattern"]), lambda p: F.struct(
            p["start"].alias("start"), (-p["stop"]).alias("back"), (-r["priority"]).alias("rank"), r["rule"].alias("rule"),
            r["label"].alias("label"), p["text"].alias("text")))

    present = F.filter(_families(), lambda f: F.contains(words, f["keyword"]))
    return F.sort_array(F.flatten(F.transform(present, lambda f: F.flatten(F.transform(f["rules"], of_rule)))))


def _surviving(candidates: Column) -> Column:
    """Candidates not contained in an earlier one of at least their priority."""
    def stop(c):
        return -c["back"]

    def reach(cands):
        """At each candidate, per priority, the largest end up to it of candidates of that priority and up."""
        own = F.transform(cands, lambda c: F.transform(F.sequence(F.lit(1), F.lit(LEVELS)),
                                                       lambda p: F.when(p <= -c["rank"], stop(c)).otherwise(F.lit(-1).cast("long"))))
        # reach of 1, 2, 4, ... candidates back
        spans = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("long")),
                         lambda n: n < F.size(cands))
        return F.aggregate(spans, own, lambda acc, n: F.transform(acc, lambda ends, i: F.when(i >= n, F.zip_with(
            ends, F.element_at(acc, (i - n + 1).cast("int")), lambda a, b: F.greatest(a, b))).otherwise(ends)))

    def alive(cands, ends):
        return F.filter(cands, lambda c, i: (i == 0) | (F.element_at(F.element_at(ends, F.greatest(i, F.lit(1))), (-c["rank"]).cast("int")) < stop(c)))

    def kept(cands):
        return F.transform(let(reach(cands), lambda ends: alive(cands, ends)), lambda c: F.struct(
            c["start"].alias("start"), stop(c).alias("stop"), c["rule"].alias("rule"), c["label"].alias("label"),
            (-c["rank"]).cast("int").alias("priority"), c["text"].alias("text")))
    return let(candidates, kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (places of base phrases),
    first_word, last_word, base_labels, labels, score, detections (the
    surviving intervals: start, stop, rule, label, priority, text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), joined_words(text_or_empty(text_col)).alias("_w"))
    w = F.col("_w")
    maybe = F.lit(False)
    for a in anchors():
        maybe = maybe | F.contains(w, F.lit(a))

    def labelled(label):
        return lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label"))

    base = F.flatten(F.array(*[F.transform(_places(w, F.lit(f"(?<= ){phrase}(?= )")), labelled(label))
                               for phrase, label in BASE]))
    none = F.struct(F.expr("cast(array() as array<struct<start: bigint, label: string>>)").alias("base"),
                    F.expr("cast(array() as array<struct<start: bigint, stop: bigint, rule: int, label: string, "
                           "priority: int, text: string>>)").alias("found"))
    rows = rows.withColumn("_n", F.when(w == "  ", 0).otherwise(_blanks(w) - 1).cast("long"))
    rows = rows.withColumn("_d", F.when(maybe, F.struct(base.alias("base"), _surviving(_candidates(w)).alias("found")))
                           .otherwise(none)).select("doc_id", "_n", "_d.base", "_d.found")
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return rows.select(
        "doc_id", F.col("_n").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("found.label"))), ",").alias("labels"),
        (F.coalesce(F.array_max("found.priority"), F.lit(0)) / LEVELS).alias("score"),
        F.col("found").alias("detections"))
