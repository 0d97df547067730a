"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: at points, marks and empty lines, not at the line breaks inside a paragraph; numbers
of a list and lines of only a web address are no sentences. Each sentence is normalized (lower case, runs of anything
but letters, digits and points as one space) and mapped to the identifiers of all known licence sentences that it
contains, in their order. What then stands for the document is its sequence of identifiers, with a gap for every
other sentence. The rules are ordered; each one names a licence and the run of identifiers that grants it, takes all
such runs out of the sequence, and leaves the rest to later rules. Identifiers that no rule takes are reported as
unmatched.

Results for the special cases: null and empty texts, and texts without a licence sentence, have empty strings
and 0; rows equal in id are scanned each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import texts

# Known licence sentences as (code, identifier, pattern over the normalized sentence), the first one wins where several match.
SENTENCES = (
    ("d", "apache-comply", "you may not use this (file|work|software) except in compliance with the license"),
    ("b", "apache-copy", "you may obtain a copy of the license at"),
    ("c", "apache-as-is", "distributed on an as is basis"),
    ("a", "apache-2.0", "(under|terms of) (the )?apache (software )?license (version )?v?2"),
    ("p", "mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("q", "mit-notice", "above copyright notice and this permission notice shall be included in all copies"),
    ("m", "mit", "(under|terms of) (the )?mit license"),
    ("w", "no-warranty", "is provided (by the copyright holders and contributors )?as is (without warranty of any kind|and any express or implied warranties)"),
    ("r", "bsd-use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("s", "bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("t", "bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("n", "bsd-endorse", "may be used to endorse or promote products"),
    ("f", "gpl-free", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("v", "gpl-3-later", "either version 3 of the license or at your option any later version"),
    ("u", "gpl-2-later", "either version 2 of the license or at your option any later version"),
    ("F", "agpl-free", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("L", "lgpl-free", "free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("e", "lgpl-2.1-later", "either version 2.1 of the license or at your option any later version"),
    ("I", "isc-grant", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("O", "0bsd-grant", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("D", "author-disclaims", "is provided as is and the author disclaims all warranties"),
    ("Z", "zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("B", "bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("X", "bsl-1.0", "(under|terms of) (the )?boost software license"),
    ("U", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("C", "cc0-1.0", "(under|to) (the )?(terms of (the )?)?(cc0|creative commons zero)"),
    ("E", "epl-2.0", "(under|terms of) (the )?(terms of the )?eclipse public license (version |v. ?|v )?2"),
    ("H", "epl-1.0", "(under|terms of) (the )?(terms of the )?eclipse public license (version |v. ?|v )?1"),
    ("T", "artistic-2.0", "(under|terms of) (the )?(terms of the )?artistic license (version |v)?2"),
    ("G", "agpl-3", "(under|terms of) (the )?(terms of the )?gnu affero general public license (version |v)?3"),
    ("i", "lgpl-3", "(under|terms of) (the )?(terms of the )?gnu lesser general public license (version |v)?3"),
    ("j", "lgpl-2.1", "(under|terms of) (the )?(terms of the )?gnu lesser general public license (version |v)?2.1"),
    ("l", "lgpl", "(under|terms of) (the )?(terms of the )?gnu lesser general public license"),
    ("g", "gpl-3", "(under|terms of) (the )?(terms of the )?gnu general public license (version |v)?3"),
    ("h", "gpl-2", "(under|terms of) (the )?(terms of the )?gnu general public license (version |v)?2"),
    ("o", "mpl-2.0", "(under|terms of) (the )?(terms of the )?mozilla public license"),
    ("x", "cc-by-nc-4.0", "under (the )?(cc by nc|creative commons attribution non ?commercial) 4.0"),
    ("y", "cc-by-sa-4.0", "under (the )?(cc by sa|creative commons attribution share ?alike) 4.0"),
    ("V", "cc-by-nd-4.0", "under (the )?(cc by nd|creative commons attribution no ?deriv(ative)?s) 4.0"),
    ("z", "cc-by-4.0", "under (the )?(cc by|creative commons attribution) 4.0"),
    ("k", "other-license", "licen[sc]ed under|(released|made available) under .*licen[sc]e"),
)
# Ordered rules as (licence, codes of its sentences in order).
RULES = (
    ("Apache-2.0", "adbc"), ("Apache-2.0", "dbc"), ("Apache-2.0", "ab"), ("Apache-2.0", "a"),
    ("MIT", "mpqw"), ("MIT", "pqw"), ("MIT", "pq"), ("MIT", "m"),
    ("BSD-3-Clause", "rstnw"), ("BSD-3-Clause", "rstn"), ("BSD-2-Clause", "rstw"), ("BSD-2-Clause", "rst"),
    ("AGPL-3.0-or-later", "Fv"), ("LGPL-3.0-or-later", "Lv"), ("LGPL-2.1-or-later", "Le"), ("LGPL-2.0-or-later", "Lu"), ("AGPL-3.0", "F"), ("LGPL", "L"),
    ("ISC", "ID"), ("ISC", "I"), ("0BSD", "OD"), ("0BSD", "O"), ("Zlib", "Z"), ("BSL-1.0", "B"), ("BSL-1.0", "X"), ("Unlicense", "U"), ("CC0-1.0", "C"),
    ("EPL-2.0", "E"), ("EPL-1.0", "H"), ("Artistic-2.0", "T"), ("AGPL-3.0", "G"), ("LGPL-3.0", "i"), ("LGPL-2.1", "j"),
    ("GPL-3.0-or-later", "fv"), ("GPL-2.0-or-later", "fu"), ("LGPL", "l"), ("GPL-3.0", "g"), ("GPL-2.0", "h"),
    ("MPL-2.0", "o"), ("CC-BY-NC-4.0", "x"), ("CC-BY-SA-4.0", "y"), ("CC-BY-ND-4.0", "V"), ("CC-BY-4.0", "z"),
)
#: What every known sentence holds; texts without it are not cut up.
#: Of sentences too, once they are normalized.
HINT = "(?i)licen[cs]|redistribut|permission|warrant|endorse|as[^a-z0-9.]+is|under|unencumbered|cc0|creative"
GAP, TAKEN = "-", "|"


#: Where two sentences meet: after a mark, and at empty lines.
CUT = r"(?<=[.!?])[ \t\r\n]+|\n[ \t\r]*\n\s*"
#: A line of only a web address, and a normalized sentence that is only the number of a list's entry.
ADDRESS, NUMBER = r"(?m)^[^A-Za-z0-9\n]*https?://\S+[ \t\r]*$", "^([0-9]+|[a-z]|[ivx]+)?$"


def _known() -> str:
    """Any known sentence. What leads up to a named licence belongs to it, and the last, general pattern ends before one."""
    named, general = "|".join(p for _, _, p in SENTENCES[:-1]), SENTENCES[-1][2]
    return f"((licen[sc]ed|released) )?(under the )?({named})|" + general.replace(".*", f"((?!{named}).)*?")


def sentences(text: Column) -> Column:
    """The normalized sentences of a text."""
    spaced = lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9.]+", " ")
    cut = F.transform(F.split(F.regexp_replace(text, ADDRESS, ""), CUT, -1), lambda s: F.regexp_replace(spaced(s), r"^[ .]+|[ .]+$", ""))
    return F.filter(cut, lambda s: ~s.rlike(NUMBER))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences (each joined by commas) and n_unmatched of each row."""

    def code(s: Column) -> Column:
        out = F.when(s.rlike(SENTENCES[0][2]), SENTENCES[0][0])
        for sign, _, pattern in SENTENCES[1:]:
            out = out.when(s.rlike(pattern), sign)
        return out

    def codes(s: Column) -> Column:
        return F.when(s.rlike(HINT), told(s)).otherwise(GAP)

    def told(s: Column) -> Column:
        found = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_known()), F.lit(0)), code), "")
        return F.when(found == "", GAP).otherwise(found)

    cut = F.when(F.col("text").rlike(HINT), F.array_join(F.transform(sentences(F.col("text")), codes), "")).otherwise("")
    coded = texts(docs).select("doc_id", cut.alias("codes"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(run).alias("run")) for name, run in RULES])
    start = F.struct(F.col("codes").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit(TAKEN)).alias("rest"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    names = F.create_map(*[x for sign, name, _ in SENTENCES for x in (F.lit(sign), F.lit(name))])
    done = coded.select("doc_id", "codes", F.when(F.col("codes").rlike("[A-Za-z]"), F.aggregate(rules, start, apply)).alias("state"))
    signs = F.filter(F.split(F.col("codes"), ""), lambda c: (c != GAP) & (c != ""))
    return done.select(
        "doc_id",
        F.array_join(F.transform(signs, lambda c: F.element_at(names, c)), ",").alias("sentence_ids"),
        F.coalesce(F.array_join(F.array_distinct(F.col("state.found")), ","), F.lit("")).alias("licences"),
        F.coalesce(F.length(F.regexp_replace(F.col("state.rest"), "[^A-Za-z]", "")), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def license_sql() -> str:
    """In DuckDB's SQL, with a simpler cut: every line break ends a sentence, and a sentence gives its first identifier only.
    Where a licence sentence is a line of its own and holds one identifier, as in the given tables, both agree."""
    case = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{sign}'" for sign, _, p in SENTENCES)
    ids = " ".join(f"WHEN '{sign}' THEN '{name}'" for sign, name, _ in SENTENCES)
    steps = ["r0 AS (SELECT *, codes AS rest, CAST([] AS VARCHAR[]) AS found FROM coded)"]
    for k, (name, run) in enumerate(RULES):
        steps.append(f"r{k + 1} AS (SELECT doc_id, codes, replace(rest, '{run}', '|') AS rest, CASE WHEN contains(rest, '{run}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{k})")
    return f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r]+', '\\1\n', 'g'), '\n') AS ss FROM documents),
norm AS (SELECT doc_id, list_transform(ss, lambda s: regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS ss FROM cut),
coded AS (SELECT doc_id, array_to_string(list_transform(ss, lambda s: CASE {case} ELSE '-' END), '') AS codes FROM norm),
{', '.join(steps)}
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(codes, ''), lambda c: c NOT IN ('-', '')), lambda c: CASE c {ids} END), ',') AS sentence_ids,
       array_to_string(found, ',') AS licences, CAST(length(regexp_replace(rest, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_unmatched
FROM r{len(RULES)}
"""
