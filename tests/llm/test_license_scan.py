from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from sievelake.llm.license_scan import RULES, SENTENCES, license_scan, license_sql

CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0", "Apache-2.0", 0),
    ("Some text. Released under the MIT License. More text.", "mit", "MIT", 0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nThe above copyright notice and this permission notice shall be included in all copies.", "mit-grant,mit-notice", "MIT", 0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy.\nSomething else.\nThe above copyright notice and this permission notice shall be included in all copies.", "mit-grant,mit-notice", "", 2),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License. Either version 3 of the License, or (at your option) any later version.", "gpl-free,gpl-3-later", "GPL-3.0-or-later", 0),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.", "cc-by-nc-4.0,mit,mit", "MIT,CC-BY-NC-4.0", 0),
    ("Licensed under the Sausage License.", "other-license", "", 1),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", "GPL-3.0", 0),
    ("A license is needed. No permission.", "", "", 0),
    ("", "", "", 0),
    (None, "", "", 0),
    ("x" * 200_000 + "\nreleased under the mit license", "mit", "MIT", 0),
]


def test_cases(spark):
    rows = [(i, c[0], "x") for i, c in enumerate(CASES)]
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, codes string")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_is_native_and_whole(docs, rows, empty):
    out = license_scan(docs)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)
    assert license_scan(empty).count() == 0


def test_rules_name_known_sentences():
    codes = {c for c, _, _ in SENTENCES}
    assert len(codes) == len(SENTENCES) and all(set(run) <= codes for _, run in RULES)


@pytest.mark.parametrize("null", [False, True])
def test_sql_agrees(spark, null):
    rows = [(i, c[0]) for i, c in enumerate(CASES) if null or c[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = "doc_id, sentence_ids, licences, n_unmatched"
    assert sorted(con.sql(f"SELECT {cols} FROM ({license_sql()})").fetchall()) == sorted(map(tuple, license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
