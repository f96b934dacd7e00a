"""Licence recognition by sentences (operator 3).

A text is cut in sentences, which may be wrapped over lines and stand behind comment marks; a normalised sentence
that is known, as a whole or by its beginning, stands for an identifier, also from the start of a line in it. The identifiers of a document, in order, are matched against licence rules in their order:
a rule is a sequence of identifiers; what it matches is used up, so a longer rule goes before one that is
a part of it. What no rule uses is left and reported. All of it is DataFrame expressions on single rows.

Defined cases: a null or empty text has no sentence; repeated rows come back each; a sentence that a text
repeats is an identifier each time, a licence counts once. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Identifiers and the normalised sentences they stand for; one that ends in * is a beginning.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("Apache2Ref", "licensed under the apache license version 2 0*"),
    ("Apache2Use", "you may not use this file except in compliance with the license*"),
    ("Apache2Copy", "you may obtain a copy of the license at*"),
    ("AsIsBasis", "unless required by applicable law or agreed to in writing*"),
    ("MitRef", "released under the mit license*"),
    ("MitRef", "licensed under the mit license*"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy*"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included*"),
    ("MitAsIs", "the software is provided as is without warranty of any kind*"),
    ("BsdIntro", "redistribution and use in source and binary forms with or without modification*"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice*"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice*"),
    ("BsdName", "neither the name of*"),
    ("Gpl3Ref", "this work is licensed under the gnu general public license version 3"),
    ("Gpl3Ref", "licensed under the gnu general public license version 3"),
    ("GplFree", "this program is free software*"),
    ("Gpl3Later", "either version 3 of the license or at your option any later version"),
    ("Gpl2Later", "either version 2 of the license or at your option any later version"),
    ("CcByNc4", "licensed under cc by nc 4 0"),
    ("CcBy4", "licensed under cc by 4 0"),
    ("CcBySa4", "licensed under cc by sa 4 0"),
    ("Cc0", "dedicated to the public domain under cc0*"),
)

#: Licences and the identifiers that state them, in the order they are tried.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BsdIntro", "BsdSource", "BsdBinary", "BsdName")),
    ("BSD-2-Clause", ("BsdIntro", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("Apache-2.0", ("Apache2Ref", "Apache2Use", "Apache2Copy", "AsIsBasis")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later")),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
)

_TERMS = "you can redistribute it and or modify it under the terms of the gnu"
_PUBLISHED = "as published by the free software foundation"
_LATER = "of the license or at your option any later version*"
_CC = "this work is licensed under a creative commons attribution"

#: Further fixed values: sentences of standard notices as they stand in texts, longer ones first.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Gpl3Terms", f"{_TERMS} general public license {_PUBLISHED} either version 3 {_LATER}"),
    ("Gpl2Terms", f"{_TERMS} general public license {_PUBLISHED} either version 2 {_LATER}"),
    ("Gpl3Only", f"{_TERMS} general public license {_PUBLISHED} version 3*"),
    ("Gpl3Only", f"{_TERMS} general public license version 3 {_PUBLISHED}*"),
    ("Gpl2Only", f"{_TERMS} general public license version 2 {_PUBLISHED}*"),
    ("Lgpl3Terms", f"{_TERMS} lesser general public license {_PUBLISHED} either version 3 {_LATER}"),
    ("Lgpl21Terms", f"{_TERMS} lesser general public license {_PUBLISHED} either version 2 1 {_LATER}"),
    ("LgplTerms", f"{_TERMS} lesser general public license {_PUBLISHED}"),
    ("Lgpl21Later", f"either version 2 1 {_LATER}"),
    ("Agpl3Terms", f"{_TERMS} affero general public license {_PUBLISHED} either version 3 {_LATER}"),
    ("BsdName", "the name of the author may not be used to endorse*"),
    (
        "IscGrant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice*",
    ),
    (
        "ZeroBsdGrant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    ("MplRef", "this source code form is subject to the terms of the mozilla public license v*"),
    ("EplRef", "this program and the accompanying materials are made available under the terms of the eclipse "
     "public license 2 0*"),
    ("BoostRef", "distributed under the boost software license version 1 0*"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy*"),
    ("ZlibOrigin", "the origin of this software must not be misrepresented*"),
    ("Unlicense", "this is free and unencumbered software released into the public domain*"),
    ("CcByNcNd4Name", f"{_CC} noncommercial noderivatives 4 0 international*"),
    ("CcByNcSa4Name", f"{_CC} noncommercial sharealike 4 0 international*"),
    ("CcByNc4", f"{_CC} noncommercial 4 0 international*"),
    ("CcByNd4Name", f"{_CC} noderivatives 4 0 international*"),
    ("CcBySa4", f"{_CC} sharealike 4 0 international*"),
    ("CcBy4", f"{_CC} 4 0 international*"),
)

#: Their rules, tried after the others.
NOTICE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    *(
        (name, ids)
        for name, terms in (
            ("GPL-3.0-or-later", ("Gpl3Terms",)),
            ("GPL-2.0-or-later", ("Gpl2Terms",)),
            ("GPL-3.0-only", ("Gpl3Only",)),
            ("GPL-2.0-only", ("Gpl2Only",)),
            ("LGPL-3.0-or-later", ("Lgpl3Terms",)),
            ("LGPL-2.1-or-later", ("Lgpl21Terms",)),
            ("LGPL-2.1-or-later", ("LgplTerms", "Lgpl21Later")),
            ("LGPL-3.0-or-later", ("LgplTerms", "Gpl3Later")),
            ("AGPL-3.0-or-later", ("Agpl3Terms",)),
        )
        for ids in (("GplFree", *terms), terms)
    ),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant",)),
    ("MPL-2.0", ("MplRef",)),
    ("EPL-2.0", ("EplRef",)),
    ("BSL-1.0", ("BoostRef",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Zlib", ("ZlibOrigin",)),
    ("Unlicense", ("Unlicense",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4Name",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4Name",)),
    ("CC-BY-ND-4.0", ("CcByNd4Name",)),
)

#: Where the query's SQL cuts: at each line break too, so it knows no sentence that is wrapped.
SENTENCE_END = r"\n|[;:]|[.!?]+[ \t\r\n]|[.!?]+$"
#: A sentence ends at a line without letters and digits, a semicolon, a colon, or a stop before white space or
#: the text's end.
WRAPPED_END = r"\n[^A-Za-z0-9\n]*(?=\n)|[;:]|[.!?]+(?=[ \t\r\n])|[.!?]+$"


def normalised(sentence: Column) -> Column:
    """A-Z in lower case, line breaks as ``|``, all else but a-z and 0-9 as single spaces, none at the ends.

    Comment marks and bullets beside a break go with it.
    """
    plain = F.translate(sentence, f"{UPPER}|\n", f"{LOWER} |")
    plain = F.regexp_replace(plain, "[^a-z0-9|]+", " ")
    return F.trim(F.regexp_replace(plain, " ?[|][ |]*", "|"))


def known_in(sentence: Column, sentences: Sequence[tuple[str, str]]) -> Column:
    """The known sentences that begin where a normalised sentence or one of its lines does, in order.

    One that is known as a whole ends with a line or with the sentence.
    """
    each = [
        known[:-1].replace(" ", "[ |]") if known.endswith("*") else known.replace(" ", "[ |]") + "(?=[|]|$)"
        for _, known in sentences
    ]
    starts = f"(?:^|[|])(?:(?:[0-9][0-9]?|[a-z]) )?(?=({'|'.join(each)}))"
    return F.transform(
        F.regexp_extract_all(sentence, F.lit(starts), F.lit(1)), lambda s: F.translate(s, "|", " ")
    )


def identifier(sentence: Column, sentences: Sequence[tuple[str, str]] = SENTENCES) -> Column:
    """The identifier of a normalised sentence, null for an unknown one; the first that fits."""
    cases = F.lit(None).cast("string")
    for name, known in reversed(sentences):
        fits = sentence.startswith(known[:-1]) if known.endswith("*") else sentence == known
        cases = F.when(fits, name).otherwise(cases)
    return cases


def may_hold(text: Column, sentences: Sequence[tuple[str, str]] = SENTENCES) -> Column:
    """False only where no sentence of a text can be known.

    A known sentence's longest word stands in the text as it is, but for case, so texts with none of these
    words need not be cut.
    """
    cues = sorted({max(known.rstrip("*").split(), key=len) for _, known in sentences})
    plain = F.translate(text, UPPER, LOWER)
    return reduce(Column.__or__, [F.contains(plain, F.lit(cue)) for cue in cues])


def scanned(
    docs: DataFrame,
    sentences: Sequence[tuple[str, str]] = NOTICES + SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES + NOTICE_RULES,
) -> DataFrame:
    """doc_id, ``sentence_ids``, ``licenses`` and ``unused`` of every document, each a comma-joined list.

    ``sentence_ids`` are in text order, ``licenses`` in the rules' order; ``unused`` are identifiers no rule used.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.filter(
        F.transform(
            F.flatten(F.transform(F.split(text, WRAPPED_END), lambda s: known_in(normalised(s), sentences))),
            lambda s: identifier(s, sentences),
        ),
        lambda name: name.isNotNull(),
    )
    none = F.array().cast("array<string>")
    found = F.when(may_hold(text, sentences), named).otherwise(none)
    # Ids stand between double commas, so neighbouring rules don't share one.
    chain = F.concat(F.lit(","), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(","))), ","))
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in ids)).alias("chain"))
            for name, ids in rules
        ]
    )

    def applied(state: Column, rule: Column) -> Column:
        fits = F.contains(state["left"], rule["chain"])
        return F.struct(
            F.when(fits, F.replace(state["left"], rule["chain"], F.lit("/"))).otherwise(state["left"]).alias("left"),
            F.when(fits, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    start = F.struct(
        F.when(F.size("ids") > 0, chain).otherwise("").alias("left"),
        none.alias("names"),
    )
    unused = F.filter(F.split(F.col("state.left"), "[,/]+"), lambda x: x != "")
    return (
        docs.select("doc_id", found.alias("ids"))
        .withColumn("state", F.aggregate(table, start, applied))
        .select(
            "doc_id",
            F.array_join("ids", ",").alias("sentence_ids"),
            F.array_join(F.array_distinct("state.names"), ",").alias("licenses"),
            F.array_join(unused, ",").alias("unused"),
        )
    )
