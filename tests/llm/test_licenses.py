import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from credsight.llm import licenses as L

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def scanner(spark):
    return L.fit(spark)


def test_held_out_accuracy(spark, scanner):
    rows = [(line, family) for line, family, held in L.training_rows() if held]
    out = scanner.classify(L.with_grams(spark.createDataFrame(rows, "line string, want string").coalesce(1))).select("line", "want", "family").collect()
    other = [r for r in out if r.want == L.OTHER]
    known = [r for r in out if r.want != L.OTHER]
    assert sum(r.family == r.want for r in known) >= 0.97 * len(known)
    assert sum(r.family != L.OTHER for r in other) <= 0.02 * len(other) + 1


def test_findings(docs_of, scanner):
    text = "Some prose.\n  licensed under the APACHE license, version 2.0\nAll rights reserved.\n\nShe had a fishing licence.\nAll rights reserved."
    rows = [(1, text), (1, text), (2, None), (None, "Released under the MIT License."), (3, "mit der Zeit")] + [(10 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(4, "word " * 30_000 + "All rights reserved."), (5, "Redistribution of wealth was discussed.\nreserved"), (6, "This work is licensed under the GNU General Public License, version 3.")]
    found = L.scan(docs_of(rows), scanner).collect()
    got = sorted((r.paragraph, r.family, r.confirmed) for r in found)
    assert got.count((1, "apache-2.0", True)) == 1 and got.count((2, "all-rights", True)) == 1 and got.count((5, "all-rights", True)) == 1
    assert (0, "mit", True) in got and (0, "gpl", True) in got
    assert not any(r.paragraph == 4 for r in found)
    assert L.scan(docs_of(rows).limit(0), scanner).count() == 0


def test_query(spark):
    df = L.op4_license_scan(spark, SF_SMALL)
    con = duckdb.connect()
    want = dict(con.execute(f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM '{SF_SMALL}/documents.parquet')
        SELECT doc_id, count(*) FROM l WHERE regexp_matches(line, '^(Licensed under|Released under|This work is licensed|All rights reserved)') GROUP BY 1""").fetchall())
    rows = df.collect()
    assert len(rows) == spark.read.parquet(SF_SMALL + "/documents.parquet").count() and want
    assert {r.doc_id: r.n_confirmed for r in rows if r.n_confirmed} == want
    assert all(r.n_found == r.n_confirmed for r in rows)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_paragraphs_without_a_cue_word(docs_of, scanner):
    """No hand-made list decides before the classifier: public domain, Creative Commons and hyphenated statements."""
    want = {1: ("This is free and unencumbered software released into the public domain.", "public-domain"),
            2: ("This work is in the public domain.", "public-domain"), 3: ("Creative Commons Attribution 4.0 International", "cc-by"),
            4: ("MIT-licensed", "mit"), 5: ("The parser is MIT-licensed.", "mit"), 6: ("All our code is BSD-licensed, too.", "bsd"),
            7: ("publish, distribute, sublicense, and/or sell copies", "mit"), 8: ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa")}
    prose = {20: "Er kam mit der Bahn, sie ging mit dem Rad.", 21: "She works in the public sector and is free to sell the software.", 22: "word of the this public domain name " * 400}
    found = L.scan(docs_of([(i, t) for i, (t, _) in want.items()] + [*prose.items()]), scanner)
    key = {r.k: r.doc_id for r in docs_of([(i, t) for i, (t, _) in want.items()] + [*prose.items()]).select("doc_id", L.C.row_key("doc_id", "text").alias("k")).collect()}
    assert {key[r.row_key]: r.family for r in found.collect()} == {i: f for i, (_, f) in want.items()}


def test_prefilter_loses_nothing(spark, scanner):
    """A line without a needed word or pair is other when scored, whatever words of the vocabulary it has."""
    needed = set(scanner.needed())
    free = [g for g in scanner.vector.vocabulary if len(g.split(" ")) < 3 and not needed & {g, *g.split(" ")}]
    lines = [*free, " ".join(g for g in free if " " not in g), " x ".join(free)]
    rows = spark.createDataFrame([(x,) for x in lines + [line for line, _, _ in L.training_rows()]], "line string").coalesce(1)
    out = scanner.classify(L.with_grams(rows)).withColumn("possible", scanner.possible()(F.col("line"))).collect()
    assert not any(r.family != L.OTHER and not r.possible for r in out) and any(not r.possible for r in out)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."}


def test_wrapped_notices(docs_of, scanner):
    """A notice with hard line breaks is confirmed as a whole, alone, in comments and between other paragraphs."""
    rows, want = [], {}
    for i, (family, text) in enumerate(WRAPPED.items()):
        lines = text.split("\n")
        rows += [(i, text), (10 + i, "A title\n\n \n" + "\r\n".join(lines) + "\n\nThe end of it."), (20 + i, "/*\n * " + "\n * ".join(lines) + "\n *\n */\ncode"),
                 (30 + i, "Thth er the onin.\n" + text + "\nAn ouer of the anre.")]
        want |= {i: (0, family), 10 + i: (3, family), 20 + i: (1, family), 30 + i: (0, family)}
    rows.append((50, "She asked for permission\nto redistribute the general plan\nof the public school."))
    docs = docs_of(rows)
    key = {r.k: r.doc_id for r in docs.select("doc_id", L.C.row_key("doc_id", "text").alias("k")).collect()}
    found = [(key[r.row_key], r.paragraph, r.family) for r in L.scan(docs, scanner).collect() if r.confirmed]
    assert sorted(found) == sorted((i, *x) for i, x in want.items())


def test_lines_and_numbers(docs_of, scanner):
    """Lines keep their numbers; a wrapped notice beside one-line notices is found too, once."""
    text = "\n\n12\tx\nAll rights reserved.\n" + WRAPPED["mit"] + "\n\n\t\nReleased under the MIT License.\nReleased under the\nBSD license."
    found = [(r.paragraph, r.family) for r in L.scan(docs_of([(1, text), (1, text)]), scanner).collect() if r.confirmed]
    assert sorted(found) == [(2, "mit"), (3, "all-rights"), (9, "bsd"), (9, "mit")]


# Wordings that no training row has.
UNSEEN = ["It is free software under the {}", "Use of this source code is governed by the {} that can be found here.",
          "See the file COPYING for the terms of the {}.", "We publish this module under the {}, as before.", "Terms: the {}"]
KNOWN = {
    "mpl-2.0": "Mozilla Public License Version 2.0",
    "apache-2.0": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file",
    "bsd": "Distributed under the terms of the Modified BSD License",
    "gpl": "It is free software under the GPL, version 3 or later",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost": "Distributed under the Boost Software License, Version 1.0. (See accompanying file", "eupl": "SPDX-License-Identifier: EUPL-1.2"}


def test_unseen_wordings(spark, scanner):
    """Names inside wordings that training never saw, and prose that has the words of both."""
    rows = [(x.format(name), family) for family, names in L.NAMES.items() for name in names for x in UNSEEN]
    assert not {t for t, _ in rows} & {line for line, _, _ in L.training_rows()}
    rows += [(t, f) for f, t in KNOWN.items()]
    prose = ["The general public saw the eclipse.", "A boost for the European Union and its public.", "She drove under the bridge with a new license.",
             "The source of the river is subject to review.", "Mozilla is a browser maker.", "He was granted permission to use the pool.", "Apache and Mozilla are foundations.",
             "This program is about public health.", "The distribution of the software was a success.", "The terms of the treaty were published as before."]
    rows += [(t, L.OTHER) for t in prose]
    out = scanner.classify(L.with_grams(spark.createDataFrame(rows, "line string, want string").coalesce(1))).select("line", "want", "family").collect()
    known = [r for r in out if r.want != L.OTHER]
    wrong = [(r.line, r.family) for r in known if r.family != r.want]
    assert len(wrong) <= 0.05 * len(known), wrong
    false = [(r.line, r.family) for r in out if r.want == L.OTHER != r.family]
    assert len(false) <= 1, false
    assert not [x for x in wrong if x[0] in KNOWN.values()]


def test_known_notices_are_confirmed(docs_of, scanner):
    docs = docs_of([(i, "Some prose.\n\n" + t) for i, t in enumerate(KNOWN.values())])
    found = L.scan(docs, scanner).collect()
    assert sorted(r.family for r in found if r.confirmed) == sorted(KNOWN) and {r.paragraph for r in found} == {2}


def brute_scan(text, scanner):
    """(paragraph, family) of confirmed lines of a text without joined lines, by plain loops over the fitted weights."""
    names = {g: i for i, g in enumerate(scanner.vector.vocabulary)}
    w, b = scanner.regression.coefficientMatrix.toArray(), scanner.regression.interceptVector.toArray()
    templates = [(f, x) for told in (L.TEMPLATES, L.NAMES) for f, lines in told.items() for x in lines]
    templates += [(f, f"the {x}") for f, lines in L.NAMES.items() for x in lines if len(L._words(x)) == 1]
    out = []
    for i, line in enumerate(text.split("\n")):
        t = re.findall(r"[^\W_]+(?:\.[^\W_]+)*", line.lower())
        grams = {" ".join(t[j:j + n]) for n in (1, 2, 3) for j in range(len(t) - n + 1)}
        z = b + w[:, [names[g] for g in grams if g in names]].sum(axis=1)
        p = np.exp(z - z.max())
        p /= p.sum()
        family = scanner.families[int(p.argmax())]
        if family == L.OTHER or p.max() < scanner.threshold:
            continue
        for f, x in templates:
            x = re.findall(r"[^\W_]+(?:\.[^\W_]+)*", x.lower())
            pairs = set(zip(x, x[1:]))
            if f == family and pairs and len(pairs & set(zip(t, t[1:]))) >= L.CONFIRM * len(pairs):
                out.append((i, family))
                break
    return out


def test_scan_by_brute_force(docs_of, scanner):
    """Vectoriser, score and confirmation, line by line (an empty line parts all lines, so that none are joined)."""
    lines = [line for line, _, held in L.training_rows() if held and line.strip()]
    texts = ["\n\n".join(lines[i::40]) for i in range(40)]
    docs = docs_of(list(enumerate(texts)))
    key = {r.k: r.doc_id for r in docs.select("doc_id", L.C.row_key("doc_id", "text").alias("k")).collect()}
    got = sorted((key[r.row_key], r.paragraph, r.family) for r in L.scan(docs, scanner).collect() if r.confirmed)
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in brute_scan(t, scanner)) and len(got) > 200


def test_paragraphs_are_tokenised_and_scored_once(docs_of, scanner):
    """Filters on the scores don't repeat tokens and scores; a long paragraph meets the templates by its known pairs only."""
    found = L.scan(docs_of([(1, "All rights reserved.\nReleased under the MIT License.")]), scanner)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2                  # of the paragraphs and of the templates
    text = "some words of the terms " * 2000 + "\nThis work is licensed under the GNU General\nPublic License, version 3.\n" + "more prose " * 2000
    rows = L.scan(docs_of([(1, text)]), scanner).collect()
    assert [(r.paragraph, r.family, r.confirmed, r.similarity) for r in rows] == [(0, "gpl", True, 1.0)]
