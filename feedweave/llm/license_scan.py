"""License scans (operator 3): sentence rules.

A text is split into sentences; each is normalised (lower case, runs of other characters than letters and digits become
one blank) and looked up in a table of known licence sentences, which gives its identifier or none. The identifier
sequence of the document, unknown sentences left out of runs as ``-``, is matched against ordered rules: a rule is a
sequence of identifiers; earlier rules win, and the identifiers that a rule used are gone for the later ones. All steps are
row-wise column expressions, so nothing is shuffled and hot sources do not matter.

Defined cases: null or empty text gives an empty identifier list and no licence; repeated sentences count each time; an
empty table gives an empty result; only doc_id and text are read, extra columns pass through ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import documents, plain_names, whole_text

#: Ends of sentences: line ends, or a full stop, semicolon or colon before white space or the end.
SENTENCE_END = r"(?:[.;:]+(?:[ \t\r]+|$)|[.;:]*[\r\n]+|[.;:]+$)"

#: Known sentences in normal form and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "Apache-2.0-notice",
    "licensed under the apache license version 2 0 the license": "Apache-2.0-notice",
    "you may not use this file except in compliance with the license": "Apache-compliance",
    "you may obtain a copy of the license at": "Apache-copy",
    "http www apache org licenses license 2 0": "Apache-2.0-url",
    "see the license for the specific language governing permissions and limitations under the license": "Apache-see",
    "released under the mit license": "MIT-notice",
    "licensed under the mit license": "MIT-notice",
    "this project is licensed under the mit license": "MIT-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice-kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs-MIT",
    "this work is licensed under the gnu general public license version 3": "GPL-3.0-notice",
    "licensed under the gnu general public license version 3": "GPL-3.0-notice",
    "licensed under the gnu general public license version 2": "GPL-2.0-notice",
    "this program is free software": "GPL-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL-terms",
    "either version 2 of the license or at your option any later version": "GPL-2-or-later",
    "either version 3 of the license or at your option any later version": "GPL-3-or-later",
    "licensed under the gnu lesser general public license version 2 1": "LGPL-2.1-notice",
    "licensed under the gnu affero general public license version 3": "AGPL-3.0-notice",
    "licensed under cc by nc 4 0": "CC-BY-NC-4.0-notice",
    "licensed under cc by 4 0": "CC-BY-4.0-notice",
    "licensed under cc by sa 4 0": "CC-BY-SA-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC-BY-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-permit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-names",
    "licensed under the bsd 3 clause license": "BSD-3-Clause-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2.0-notice",
    "all rights reserved": "AllRights",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "AsIs-ISC",
    "licensed under the isc license": "ISC-notice",
    "this software is provided as is without any express or implied warranty": "AsIs-zlib",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlib-grant",
    "this is free and unencumbered software released into the public domain": "Unlicense-notice",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "Unlicense-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL-1.0-grant",
    "distributed under the boost software license version 1 0": "BSL-1.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "EPL-2.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "EPL-1.0-notice",
    "the contents of this file are subject to the terms of the common development and distribution license": "CDDL-notice",
    "do what the fuck you want to public license": "WTFPL-title",
    "you just do what the fuck you want to": "WTFPL-grant",
    "licensed under the eupl": "EUPL-notice",
    "licensed under the eupl version 1 2": "EUPL-1.2-notice",
    "licensed under the gnu lesser general public license version 3": "LGPL-3.0-notice",
    "this library is free software": "LGPL-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPL-terms",
    "either version 2 1 of the license or at your option any later version": "GPL-2.1-or-later",
    "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules and to copy and distribute the resulting executable under terms of your choice provided that you also meet for each linked independent module the terms and conditions of the license of that module": "Classpath-exception",
    "either version 3 of the license or at your option any later version of the gnu affero general public license": "AGPL-3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPL-terms",
    "licensed under the artistic license 2 0": "Artistic-2.0-notice",
    "this font software is licensed under the sil open font license version 1 1": "OFL-1.1-notice",
    "licensed under the microsoft public license": "MS-PL-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0-1.0-notice",
    "licensed under cc0 1 0": "CC0-1.0-notice",
    "licensed under cc by nd 4 0": "CC-BY-ND-4.0-notice",
    "licensed under cc by nc sa 4 0": "CC-BY-NC-SA-4.0-notice",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "PostgreSQL-grant",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD-advertising",
    "licensed under the bsd 2 clause license": "BSD-2-Clause-notice",
}

#: Ordered rules, longest and most specific first.
RULES = (
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ("GPL-free", "GPL-terms", "GPL-2-or-later", "Classpath-exception")),
    ("GPL-3.0-or-later", ("GPL-free", "GPL-terms", "GPL-3-or-later")),
    ("GPL-2.0-or-later", ("GPL-free", "GPL-terms", "GPL-2-or-later")),
    ("AGPL-3.0-or-later", ("GPL-free", "AGPL-terms", "GPL-3-or-later")),
    ("LGPL-2.1-or-later", ("LGPL-free", "LGPL-terms", "GPL-2.1-or-later")),
    ("LGPL-3.0-or-later", ("LGPL-free", "LGPL-terms", "GPL-3-or-later")),
    ("BSD-4-Clause", ("BSD-permit", "BSD-source", "BSD-binary", "BSD-advertising", "BSD-names")),
    ("BSD-3-Clause", ("BSD-permit", "BSD-source", "BSD-binary", "BSD-names")),
    ("BSD-2-Clause", ("BSD-permit", "BSD-source", "BSD-binary")),
    ("MIT", ("MIT-grant", "MIT-notice-kept", "AsIs-MIT")),
    ("MIT", ("MIT-grant", "MIT-notice-kept")),
    ("Apache-2.0", ("Apache-2.0-notice", "Apache-compliance", "Apache-copy", "Apache-2.0-url")),
    ("Apache-2.0", ("Apache-2.0-notice",)),
    ("Apache-2.0", ("Apache-2.0-url",)),
    ("MIT", ("MIT-notice",)),
    ("MIT", ("MIT-grant",)),
    ("GPL-3.0-only", ("GPL-3.0-notice",)),
    ("GPL-2.0-only", ("GPL-2.0-notice",)),
    ("LGPL-2.1-only", ("LGPL-2.1-notice",)),
    ("AGPL-3.0-only", ("AGPL-3.0-notice",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0-notice",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4.0-notice",)),
    ("CC-BY-4.0", ("CC-BY-4.0-notice",)),
    ("BSD-3-Clause", ("BSD-3-Clause-notice",)),
    ("MPL-2.0", ("MPL-2.0-notice",)),
    ("BSD-2-Clause", ("BSD-2-Clause-notice",)),
    ("ISC", ("ISC-grant",)),
    ("ISC", ("ISC-notice",)),
    ("0BSD", ("0BSD-grant",)),
    ("Zlib", ("AsIs-zlib", "Zlib-grant")),
    ("Zlib", ("Zlib-grant",)),
    ("Unlicense", ("Unlicense-notice",)),
    ("BSL-1.0", ("BSL-1.0-grant",)),
    ("BSL-1.0", ("BSL-1.0-notice",)),
    ("EPL-2.0", ("EPL-2.0-notice",)),
    ("EPL-1.0", ("EPL-1.0-notice",)),
    ("CDDL-1.0", ("CDDL-notice",)),
    ("WTFPL", ("WTFPL-title",)),
    ("WTFPL", ("WTFPL-grant",)),
    ("EUPL-1.2", ("EUPL-1.2-notice",)),
    ("EUPL", ("EUPL-notice",)),
    ("LGPL-3.0-only", ("LGPL-3.0-notice",)),
    ("Artistic-2.0", ("Artistic-2.0-notice",)),
    ("OFL-1.1", ("OFL-1.1-notice",)),
    ("MS-PL", ("MS-PL-notice",)),
    ("CC0-1.0", ("CC0-1.0-notice",)),
    ("CC-BY-ND-4.0", ("CC-BY-ND-4.0-notice",)),
    ("CC-BY-NC-SA-4.0", ("CC-BY-NC-SA-4.0-notice",)),
    ("PostgreSQL", ("PostgreSQL-grant",)),
    ("GPL-unversioned", ("GPL-free", "GPL-terms")),
    ("LGPL-unversioned", ("LGPL-free", "LGPL-terms")),
    ("Proprietary", ("AllRights",)),
)


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the text's sentences in order; null where a sentence is unknown."""
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    normal = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, SENTENCE_END, "\u0001")), "[^a-z0-9\u0001]+", " ")), " ?\u0001 ?")
    return F.transform(F.filter(normal, lambda s: s != ""), lambda s: F.try_element_at(known, s))


RESULTS = ("n_sentences", "sentence_ids", "licenses")


def pattern(ids: tuple[str, ...]) -> str:
    """A rule's identifiers, each between blanks of its own."""
    return "".join(f" {x} " for x in ids)


def matched(sequence: Column, rules: tuple) -> Column:
    """Names of the rules that the sequence holds, in rule order: each rule takes what it matches out of the sequence."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(ids)).alias("pattern")) for name, ids in rules])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["pattern"])
        rest = F.when(hit, F.replace(acc["rest"], rule["pattern"], F.lit(" - "))).otherwise(acc["rest"])
        names = F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"])
        return F.struct(rest.alias("rest"), names.alias("names"))

    return F.aggregate(table, start, step, lambda acc: F.array_distinct(acc["names"]))


def scan(df: DataFrame, text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """df plus n_sentences, sentence_ids (known ones in order, joined by blanks) and licenses (in rule order, joined by commas)."""
    names = df.columns
    plain = plain_names(names)
    inner = df.toDF(*plain).withColumn("_ids", identifiers(whole_text(plain[names.index(text_col)]), sentences))
    sequence = F.concat(F.lit(" "), F.array_join("_ids", "  ", "-"), F.lit(" "))
    known = F.array_compact("_ids")
    # a generator of one row binds what several results use
    inner = inner.withColumn("_got", F.explode(F.array(F.struct(F.size("_ids").cast("long").alias("n"), known.alias("ids"), F.when(F.size(known) > 0, sequence).alias("seq")))))
    found = F.when(F.size("_got.ids") > 0, F.array_join(matched(F.col("_got.seq"), rules), ",")).otherwise("")
    results = (F.col("_got.n"), F.array_join("_got.ids", " "), found)
    return inner.select(*[F.col(p).alias(x) for p, x in zip(plain, names, strict=True) if x not in RESULTS], *[c.alias(x) for c, x in zip(results, RESULTS, strict=True)])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses")


def oracle() -> str:
    keys = ", ".join(f"'{k}'" for k in SENTENCES)
    values = ", ".join(f"'{v}'" for v in SENTENCES.values())
    steps, cases, last = [], [], "seq0"
    for i, (name, ids) in enumerate(RULES):
        p = pattern(ids)
        cases.append(f"CASE WHEN contains({last}, '{p}') THEN '{name}' END")
        steps.append(f"replace({last}, '{p}', ' - ') AS seq{i + 1}")
        last = f"seq{i + 1}"
    end = SENTENCE_END
    return f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '{end}', chr(1), 'g')), '[^a-z0-9' || chr(1) || ']+', ' ', 'g')), ' ?' || chr(1) || ' ?'), lambda s: s <> '') AS s FROM documents),
i AS (SELECT doc_id, len(s) AS n, list_transform(s, lambda x: CASE WHEN list_contains([{keys}], x) THEN ([{values}])[list_position([{keys}], x)] END) AS ids FROM t),
j AS (SELECT doc_id, n, list_filter(ids, lambda x: x IS NOT NULL) AS known, ' ' || array_to_string(list_transform(ids, lambda x: coalesce(x, '-')), '  ') || ' ' AS seq0 FROM i),
k AS (SELECT *, {', '.join(steps)} FROM j),
h AS (SELECT *, list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS hits FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, array_to_string(known, ' ') AS sentence_ids,
       array_to_string(list_filter(list_transform(range(1, len(hits) + 1), lambda p: CASE WHEN list_position(hits, hits[p]) = p THEN hits[p] END), lambda x: x IS NOT NULL), ',') AS licenses
FROM h"""
