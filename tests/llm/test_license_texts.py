from __future__ import annotations

import re

from sievelake.llm.license_scan import license_scan

MIT = """MIT License

Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD_2 = """Copyright (c) 2020, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_W = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
BSD_N = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Copyright 2020 Jo Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
PUBLISHED = [
    (MIT, "mit-grant,mit-notice,no-warranty", "MIT"),
    (BSD_2 + BSD_W, "bsd-use,bsd-source,bsd-binary,no-warranty", "BSD-2-Clause"),
    (BSD_2 + BSD_N + BSD_W, "bsd-use,bsd-source,bsd-binary,bsd-endorse,no-warranty", "BSD-3-Clause"),
    (APACHE, "apache-2.0,apache-comply,apache-copy,apache-as-is", "Apache-2.0"),
    (GPL, "gpl-free,gpl-3-later", "GPL-3.0-or-later"),
    (GPL.replace("3", "2"), "gpl-free,gpl-2-later", "GPL-2.0-or-later"),
]
LAYOUTS = [
    lambda t: t,
    lambda t: re.sub(r"(?<!\n)\n(?!\n) *", " ", t),  # a paragraph a line
    lambda t: " ".join(t.split()),  # all in one line
    lambda t: t.replace("\n", "\r\n"),
    lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint main() {}",
    lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.split("\n")),
]
SEVERAL = [
    ("Released under the MIT License\nLicensed under the Sausage License\nreleased under the Apache License 2", "mit,other-license,apache-2.0", "Apache-2.0,MIT", 1),
    ("Released under both the terms of the MIT License and a sausage license.", "mit", "MIT", 0),
    ("Released under the Sausage License\nReleased under the Pepper License", "other-license,other-license", "", 2),
    ("released under " + "x " * 300_000 + "\n\nunder the MIT License", "mit", "MIT", 0),
]


def test_published_texts(spark):
    rows, want = [], []
    for text, ids, licence in PUBLISHED:
        for layout in LAYOUTS:
            rows.append((len(rows), layout(text)))
            want.append((ids, licence, 0))
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_several_in_a_sentence(spark):
    rows = [(i, c[0]) for i, c in enumerate(SEVERAL)]
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(SEVERAL)}
