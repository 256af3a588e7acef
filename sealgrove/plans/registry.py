"""The modules whose queries are registered."""

from sealgrove.plans import detection, edits, entities, findings, more, parts, review, small, texts, whole

MODULES = (detection, entities, texts, small, edits, review, parts, whole, more, findings)
