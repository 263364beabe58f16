"""All queries of the subpackage; importing registers them."""

from __future__ import annotations

from evenhand.llm import chat, decontaminate, lexical, mixing, quality, quality_rules, sharding, simhash, spelling, stream_dedup, substring_dedup, toxicity, url_rules  # noqa: F401
from evenhand.llm.registry import ORACLES, QUERIES  # noqa: F401
