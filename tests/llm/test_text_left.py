from __future__ import annotations

from collections import Counter

import numpy as np
from test_suffix_dedup import spans_of

from sievelake.llm.suffix_dedup import repeat_digests


def test_the_text_that_is_left(docs, rows):
    bodies = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], bytes(np.frombuffer(b, np.uint8)[~hit]).decode(errors="ignore")) for r, b, hit in zip(rows, bodies, spans_of(bodies, 120), strict=True))
    got = repeat_digests(docs, 120, with_text=True)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert [r["n_bytes"] for r in repeat_digests(docs.limit(0), 120, with_text=True).collect()] == []
