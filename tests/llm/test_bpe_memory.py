"""What the byte-level BPE holds in a worker."""

import public_tokenizers

from modloom.llm import byte_bpe


def test_full_caches_begin_anew_early_and_ids_stay():
    c = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "some words, some more words"
    c.prepare([text])
    want = c.encode([text])
    c.units.update({f"unit {i}": b"" for i in range(200_000)})
    c.words.update({f"word {i}": b"" for i in range(700_000)})
    c.prepare([text])
    assert len(c.units) < 10 and len(c.words) < 10
    assert c.encode([text]) == want and c.decode(want) == [text.encode()]
