"""Column builders for scores, zones and state transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component weights of the knowledge-gap score.
GAP_WEIGHTS = {"temporal_gap": 0.25, "llm_uncertainty": 0.20, "cross_model_divergence": 0.15, "citation_velocity": 0.15, "niche_penetration": 0.10, "source_authority": 0.08, "multilingual_gap": 0.04, "format_diversity": 0.03}
# Weights of a topic's priority (they sum to 1.20).
PRIORITY = {"gate": 0.20, "quality": 0.45, "uniqueness": 0.25, "gap": 0.20, "demand": 0.10}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def judge(grounding: Column, citation: Column, completeness: Column, language: Column, hallucination: Column, penalty: float = 0.3) -> Column:
    s = 0.40 * grounding + 0.25 * citation + 0.20 * completeness + 0.15 * language
    return F.when(hallucination, F.greatest(F.lit(0.0), F.least(s - penalty, F.lit(1.0 - penalty)))).otherwise(clamp(s))


def zone(score: Column, green: float = 0.88, grey: float = 0.70) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= green, "green").when(s >= grey, "grey").otherwise("red")


def knowledge_gap(parts: dict[str, Column]) -> Column:
    """Weighted sum; a missing component counts as neutral."""
    total = F.lit(0.0)
    for name, weight in GAP_WEIGHTS.items():
        total = total + weight * clamp(F.coalesce(parts[name], F.lit(0.5)))
    return F.round(clamp(total), 4)


def citation_velocity(weekly: Column, quarterly: Column) -> Column:
    return F.when(quarterly == 0, F.when(weekly == 0, 0.0).otherwise(0.8)).otherwise(clamp((13 * weekly / quarterly - 1) / 4))


def niche(count: Column) -> Column:
    return clamp(1 - F.log10(F.greatest(F.lit(1.0), count.cast("double"))) / 5)


def priority(gate: Column, quality: Column, uniqueness: Column, gap: Column, demand: Column) -> Column:
    return PRIORITY["gate"] * gate.cast("double") + PRIORITY["quality"] * quality + PRIORITY["uniqueness"] * uniqueness + PRIORITY["gap"] * gap + PRIORITY["demand"] * demand


def route_after_judge(score: Column, turn: Column, retries: Column, threshold: float = 0.82, max_retries: int = 3) -> Column:
    return F.when(score >= threshold, "append").when(turn > 0, "write").when(retries < max_retries, "retry").otherwise("unresolvable")


def claim(status: Column, retries: Column) -> Column:
    return F.when((status == "new") & (retries < 3), "in_progress").otherwise(status)


def finalise(status: Column, success: Column, retries: Column, max_retries: int = 3) -> Column:
    """Ready and unresolvable are terminal."""
    return F.when(status.isin("ready", "unresolvable"), status).when(success, "ready").when(retries + 1 >= max_retries, "unresolvable").otherwise("new")


def retrieval_size(retries: Column, history_tokens: Column, left_tokens: Column) -> Column:
    base = F.when(history_tokens >= 3000, 3).when(retries > 0, 12).otherwise(8)
    return F.when(left_tokens < 500, F.floor(base / 2).cast("int")).otherwise(base)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (both == 0), 0.0).otherwise(dot / both)


def index_percentile(values: Column, q: float) -> Column:
    """Element floor(n * q) of the sorted array: not interpolated."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * q), F.size(ordered) - 1).cast("int"))


def watermark(client: Column, batch: Column, index: Column, secret: str) -> Column:
    return F.sha2(F.concat_ws("|", client, batch, index.cast("string"), F.lit(secret)), 256)


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC from nested hashes: hex digest of ``message`` (string)."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)
