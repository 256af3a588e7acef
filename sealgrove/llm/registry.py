"""The operators whose queries are registered."""

from sealgrove.llm import bpe, langid, lines, media, mixing, negatives, phrases, quality, sharding, simhash, substrings, tokens, topk

MODULES = (bpe, langid, lines, media, mixing, quality, sharding, simhash, substrings, topk, negatives, tokens, phrases)
