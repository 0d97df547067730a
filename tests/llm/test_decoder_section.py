from __future__ import annotations

import json

import pytest

from sievelake.llm.numpy_bpe import token_table


@pytest.mark.parametrize("decoder", [None, {"type": "ByteLevel"}])
def test_a_decoder_section_is_refused(tmp_path, decoder):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0}}, "added_tokens": [{"content": "<x>", "id": 1}], "decoder": decoder}))
    if decoder:
        with pytest.raises(ValueError, match="decoder"):
            token_table(str(path))
    else:
        assert token_table(str(path)).tolist() == [b"a", b"<x>"]
