"""The value sets of enumerated columns."""

from __future__ import annotations

# The value sets of the enumerated columns, in rank order.
SOURCES = ("commit", "issue", "pr", "comment")
CATEGORIES = ("bot_rage", "tooling_rage", "self_own", "generic", "lang_rage")
SEVERITIES = ("mild", "strong", "slur_masked")
CTX_ACTIONS = ("none", "upgraded", "downgraded")
TARGET_TYPES = ("none", "bot", "tool", "lang", "framework")
DETECTOR_SOURCES = ("template", "lemma")
