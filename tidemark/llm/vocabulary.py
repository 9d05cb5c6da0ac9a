"""Where the queries and the pipeline find their vocabulary. Operators take the path as a parameter."""

from __future__ import annotations

try:
    import public_tokenizers

    WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
except ModuleNotFoundError:
    WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"
