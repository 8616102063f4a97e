"""Licence scans by sentence rules: normalised sentences become identifiers, ordered rules read their sequence.

A text is lower-cased, freed of comment marks at line starts and of repeated
white space, and cut into sentences.  Each sentence becomes the identifiers of
the known licence sentences it holds.  The identifiers in order are matched
against the rules, longest evidence first; a rule that matches names its
licence and uses its identifiers up.  All of it is DataFrame expressions on
one row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, as searched in normalised text.  Every pattern holds one of MARKERS.
SENTENCES: list[tuple[str, str]] = [
    ("SPDX-MIT", r"spdx-license-identifier: mit\b"),
    ("SPDX-Apache-2.0", r"spdx-license-identifier: apache-2\.0"),
    ("SPDX-GPL-2.0", r"spdx-license-identifier: gpl-2\.0"),
    ("SPDX-GPL-3.0", r"spdx-license-identifier: gpl-3\.0"),
    ("SPDX-BSD-3-Clause", r"spdx-license-identifier: bsd-3-clause"),
    ("MIT-permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT-notice", r"copyright notice and this permission notice shall be included in all copies"),
    ("MIT-reference", r"\b(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("MIT-title", r"^(the )?mit license$"),
    ("ISC-permission", r"permission to use, copy, modify, and/?(or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-source", r"redistributions of source code must retain the above copyright notice"),
    ("BSD-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-endorse", r"neither the name of .* may be used to endorse .* without specific prior written permission"),
    ("BSD-reference", r"\b(released|licensed|distributed|available) under the (terms of the )?(new |modified |3-clause )?bsd license"),
    ("Apache-2.0-reference", r"\blicensed under the apache license,? version 2\.0"),
    ("Apache-2.0-obtain", r"you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0"),
    ("Apache-2.0-compliance", r"you may not use this file except in compliance with the license"),
    ("Apache-2.0-basis", r"distributed under the license is distributed on an \S?as is\S? basis"),
    ("GPL-3-reference", r"\blicensed under the gnu general public license,? (version|v) ?3"),
    ("GPL-2-reference", r"\blicensed under the gnu general public license,? (version|v) ?2"),
    ("GPL-redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("GPL-2-later", r"either version 2 of the license, or \(at your option\) any later version"),
    ("GPL-3-later", r"either version 3 of the license, or \(at your option\) any later version"),
    ("GPL-see", r"see the gnu general public license for more details"),
    ("LGPL-redistribute", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("MPL-2.0-subject", r"subject to the terms of the mozilla public license, v\. 2\.0"),
    ("CC-BY-NC-reference", r"\blicensed under (a )?(cc|creative commons) by-nc 4\.0"),
    ("CC-BY-NC-SA-reference", r"\blicensed under (a )?(cc|creative commons) by-nc-sa 4\.0"),
    ("CC-BY-SA-reference", r"\blicensed under (a )?(cc|creative commons) by-sa 4\.0"),
    ("CC-BY-reference", r"\blicensed under (a )?(cc|creative commons) by 4\.0"),
    ("CC0-dedication", r"\bdedicated? .* to the public domain"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("AS-IS", r"\bprovided \S?as[ -]is\S?,? without warrant"),
    ("NO-WARRANTY", r"without any warranty; without even the implied warranty"),
    ("NO-LIABILITY", r"in no event shall .* be liable"),
    ("RIGHTS-RESERVED", r"\ball rights reserved\b"),
    ("COPYRIGHT", r"\bcopyright (\(c\)|©|[0-9]{4})"),
]

# Ordered rules: (licence, identifiers that must follow one another, identifiers of SENTENCES only).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Apache-2.0-reference", "Apache-2.0-compliance", "Apache-2.0-obtain", "Apache-2.0-basis")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "AS-IS", "NO-LIABILITY")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "AS-IS", "NO-LIABILITY")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary")),
    ("MIT", ("MIT-permission", "MIT-notice", "AS-IS", "NO-LIABILITY")),
    ("MIT", ("MIT-permission", "MIT-notice")),
    ("ISC", ("ISC-permission", "AS-IS", "NO-LIABILITY")),
    ("ISC", ("ISC-permission",)),
    ("GPL-2.0-or-later", ("GPL-redistribute", "GPL-2-later", "NO-WARRANTY", "GPL-see")),
    ("GPL-2.0-or-later", ("GPL-redistribute", "GPL-2-later")),
    ("GPL-3.0-or-later", ("GPL-redistribute", "GPL-3-later", "NO-WARRANTY", "GPL-see")),
    ("GPL-3.0-or-later", ("GPL-redistribute", "GPL-3-later")),
    ("LGPL", ("LGPL-redistribute",)),
    ("MPL-2.0", ("MPL-2.0-subject",)),
    ("MIT", ("SPDX-MIT",)),
    ("Apache-2.0", ("SPDX-Apache-2.0",)),
    ("GPL-2.0", ("SPDX-GPL-2.0",)),
    ("GPL-3.0", ("SPDX-GPL-3.0",)),
    ("BSD-3-Clause", ("SPDX-BSD-3-Clause",)),
    ("MIT", ("MIT-reference",)),
    ("MIT", ("MIT-title",)),
    ("BSD", ("BSD-reference",)),
    ("Apache-2.0", ("Apache-2.0-reference",)),
    ("GPL-3.0", ("GPL-3-reference",)),
    ("GPL-2.0", ("GPL-2-reference",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-reference",)),
    ("CC-BY-NC-SA-4.0", ("CC-BY-NC-SA-reference",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-reference",)),
    ("CC-BY-4.0", ("CC-BY-reference",)),
    ("CC0", ("CC0-dedication",)),
    ("Unlicense", ("Unlicense",)),
    ("Proprietary", ("COPYRIGHT", "RIGHTS-RESERVED")),
    ("Proprietary", ("RIGHTS-RESERVED",)),
]

# A text or sentence without any of these holds no known sentence.
MARKERS = ("licen", "copyright", "warrant", "permission", "redistribut", "rights reserved", "liab", "public domain")

COMMENT_MARKS = r"(?m)^[ \t]*[#*/%;!<>-]+[ \t]*"
# signs inside known sentences end none
INSIDE = r"(?!(?<=spdx-license-identifier): |(?<=mozilla public license, v)\. 2|(?<=without any warranty); without even )"
SENTENCE_END = INSIDE + r"[.;:!?]+(?: |$)|\n\n"
# the address of a licence often stands below an empty line
BEFORE_ADDRESS = r"(?<=copy of the license at):? ?\x01 ?(?=https?://)"


def _marked(text: Column) -> Column:
    found = F.contains(text, F.lit(MARKERS[0]))
    for marker in MARKERS[1:]:
        found = found | F.contains(text, F.lit(marker))
    return found


def normalised(text: Column) -> Column:
    """Lower case, without comment marks; white space is one space, an empty line is a sentence end, except before the address of a licence."""
    plain = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    plain = F.regexp_replace(plain, COMMENT_MARKS, "")
    plain = F.regexp_replace(plain, r"\n[ \t]*(?:\n[ \t]*)+", "\u0001")
    plain = F.regexp_replace(plain, r"[\t\n\x0b\f ]+", " ")
    plain = F.regexp_replace(plain, BEFORE_ADDRESS, " ")
    return F.regexp_replace(plain, " ?\u0001 ?", "\n\n")


def sentences(text: Column) -> Column:
    """The normalised sentences that hold a marker, in order, without the sign at their end."""
    cut = F.split(normalised(text), SENTENCE_END)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), _marked)


def identifiers(found: Column) -> Column:
    """The identifiers of the known sentences, in order of the text, then of SENTENCES."""
    def of(sentence: Column) -> Column:
        return F.filter(F.array(*[F.when(sentence.rlike(p), F.lit(name)) for name, p in SENTENCES]), lambda x: x.isNotNull())

    return F.flatten(F.transform(found, of))


def licences(found: Column) -> Column:
    """Struct (left, names): what no rule used of the identifier sequence, and the licences by rule order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES])
    sequence = F.array_join(F.transform(found, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
            F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    return F.aggregate(rules, start, apply)


def licence_scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, sentence_ids, licences, unmatched) of the documents that hold a known licence sentence.

    sentence_ids are the identifiers in order, licences the names that the
    rules give, unmatched the number of identifiers that no rule used.  The
    whole text is read.  Null and empty texts hold nothing; repeated rows give
    repeated results; a null doc_id is kept.  Other columns are not read.
    """
    # the names are unlike any that a caller may bring
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(_marked(F.lower("text")))
    rows = rows.select("doc_id", identifiers(sentences(F.col("text"))).alias("sentence_ids")).where(F.size("sentence_ids") > 0)
    rows = rows.withColumn("_read", licences(F.col("sentence_ids")))
    left = F.regexp_count("_read.left", F.lit("<"))
    return rows.select("doc_id", "sentence_ids", F.col("_read.names").alias("licences"), left.cast("int").alias("unmatched"))
