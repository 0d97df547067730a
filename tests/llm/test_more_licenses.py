"""Notices as they are published, wrapped and in comments, and prose that is no licence."""

from __future__ import annotations

import pytest

from sievelake.llm.license_scan import RULES, SENTENCES, license_scan

NOTICES = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for
any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0.""",
    "CC0-1.0": "The data set is released under CC0 1.0 Universal.",
    "Artistic-2.0": "This module is distributed under the terms of the\nArtistic License 2.0.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License v3.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
PROSE = (
    "You owe the rent under the terms of the agreement with your landlord.",
    "Permission was granted to the fishermen. The warrant was under the table.",
    "They served under a creative captain, as is the custom.",
    "",
)


def scanned(spark, texts):
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)).collect()
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("form", ["wrapped", "one line", "stars", "hashes", "windows"])
def test_published_notices(spark, form):
    forms = {
        "wrapped": lambda t: t,
        "one line": lambda t: " ".join(t.split()),
        "stars": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */",
        "hashes": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        "windows": lambda t: t.replace("\n", "\r\n"),
    }
    got = scanned(spark, [f"Copyright 2020 Some Body.\n\n{forms[form](t)}\n\nThe code begins here." for t in NOTICES.values()])
    assert {k: got[i]["licences"] for i, k in enumerate(NOTICES)} == {k: k for k in NOTICES}
    assert {r["n_unmatched"] for r in got.values()} == {0}


def test_prose_has_no_licence(spark):
    assert [(r["sentence_ids"], r["licences"], r["n_unmatched"]) for r in scanned(spark, PROSE).values()] == [("", "", 0)] * len(PROSE)


def test_tables_are_consistent():
    signs = [sign for sign, _, _ in SENTENCES]
    assert len(set(signs)) == len(signs) and len({name for _, name, _ in SENTENCES}) == len(signs)
    assert all(set(run) <= set(signs) for _, run in RULES) and len({run for _, run in RULES}) == len(RULES)
    for k, (_, run) in enumerate(RULES):  # no rule is out of reach behind a part of its own run
        assert not any(earlier in run for _, earlier in RULES[:k]), run
