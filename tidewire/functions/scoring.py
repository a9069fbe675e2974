"""Importance, grades and topics by rule: an optional extra beside a model's own scores.

No step of the daily run uses it; it suits runs without a language model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the six parts of importance, each from 0 to 100; fixed values.
WEIGHTS = (("global_impact", 0.30), ("technology", 0.20), ("business", 0.20), ("policy", 0.15), ("market", 0.10), ("credibility", 0.05))
GRADES = (("S", 95), ("A+", 90), ("A", 85), ("B+", 80))
#: Least and most items of each section of a full report; fixed values.
SECTION_QUOTAS = {"top_news": (5, 7), "model_tech": (5, 8), "funding": (4, 6), "policy": (3, 5), "research": (3, 5), "industry": (4, 7)}
ITEMS_PER_COMPANY = 3


#: Topic labels of an item, two to five each; fixed values.
TOPICS = (
    "foundation_model", "reasoning", "multimodal", "video_gen", "image_gen", "audio_gen",
    "coding_agent", "ai_agent", "computer_use", "mcp", "a2a", "agent_protocol",
    "world_model", "rlhf", "distillation", "inference", "training_efficiency",
    "gpu", "ai_chip", "asic", "hbm", "datacenter", "ai_infra", "edge_ai",
    "humanoid_robot", "embodied_ai", "robotics",
    "funding", "acquisition", "ipo", "valuation", "venture_capital",
    "regulation", "policy", "safety", "security", "jailbreak", "alignment",
    "copyright", "export_control", "antitrust",
    "open_source", "closed_source",
    "us", "china", "eu", "uk", "japan", "global",
)
MOST_TOPICS = 5


def topic_labels(topics: Column, known=TOPICS, most: int = MOST_TOPICS) -> Column:
    """Up to ``most`` labels, distinct, lower-case with underscores, those of the vocabulary first."""
    named = F.array_distinct(F.filter(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(F.trim(t)), r"[\s-]+", "_")), lambda t: t != ""))
    listed = F.array(*map(F.lit, known))
    first = F.filter(named, lambda t: F.array_contains(listed, t))
    return F.slice(F.concat(first, F.array_except(named, first)), 1, most)


def importance(parts: dict[str, Column], weights=WEIGHTS) -> Column:
    """The weighted sum of the parts, missing ones counting 0, within 0 and 100."""
    total = F.lit(0.0)
    for name, weight in weights:
        total = total + F.lit(weight) * F.coalesce(parts.get(name, F.lit(None)).cast("double"), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))


def grade(score: Column) -> Column:
    """S, A+, A, B+ or C."""
    out = F.lit("C")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
