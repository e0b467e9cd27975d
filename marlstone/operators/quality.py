"""Quality score of Markdown, wholly in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as t

# --- fixed values: what is counted, and what it costs --------------------------
SAMPLE = 65_536
NOISE_CHARS, NOISE_TOKENS = 400, 40
BIG_DOCUMENT = 20_000
TOC_RESIDUE = r"(?m)^\S.{0,120}?\s+•\s+\d{1,4}\s*$|�{2,}|\.{6,}\s*\d{1,4}\s*$"
LONE_BULLET = r"(?m)^\s*•\s*$"
RAW_BULLET = r"(?m)^\s*•\s+\S"
HEADING = r"(?m)^#{1,6}\s+\S"
FENCE = r"(?m)^\s*```(\w*)\s*$"
BARE_FENCE = r"(?m)^\s*```\s*$"
HARD_WRAP = r"(?m)^.{60,90}[a-z,]\n[a-z]"
PREPRESS = r"(?i)\.indd\b|\bJob(?:\s*No\.?)?\s*:\s*[\d-]+\s+Title\s*:|#\d+\s+DTP\s*:|\bDtp\s*:\s*\w+\s+Page\s*:"
DOUBLED = r"\b(?:([A-Za-z])\1){3,}\b"
#: Counter, how many cost a point, the most they cost, and how the issue is worded.
COSTS = (
    ("prepress_residue", 10, 20, "prepress slug residue"), ("doubled_words", 20, 10, "doubled (shadow) text"), ("toc_residue", 10, 20, "TOC residue"),
    ("lone_bullets", 20, 15, "sheared bullets"), ("raw_bullet_lines", 50, 10, "non-Markdown bullets"), ("hard_wrap_hints", 100, 10, "hard-wrapped prose"),
)
COUNTERS = ("headings", "fenced_blocks", "unlabeled_fences", "toc_residue", "lone_bullets", "raw_bullet_lines", "hard_wrap_hints", "prepress_residue", "doubled_words")


def counters(text: Column) -> dict[str, Column]:
    fences = t.hits(text, FENCE)
    blocks = F.floor(fences / 2).cast("int")
    doubled = F.size(F.filter(F.regexp_extract_all(text, F.lit(DOUBLED), F.lit(0)), t.is_shadow))
    return {
        "chars": F.length(text), "est_tokens": t.est_tokens(text), "headings": t.hits(text, HEADING), "fenced_blocks": blocks,
        "unlabeled_fences": F.greatest(F.lit(0), t.hits(text, BARE_FENCE) - blocks), "fence_parity_ok": fences % 2 == 0,
        "toc_residue": t.hits(text, TOC_RESIDUE), "lone_bullets": t.hits(text, LONE_BULLET), "raw_bullet_lines": t.hits(text, RAW_BULLET),
        "hard_wrap_hints": t.hits(text, HARD_WRAP), "prepress_residue": t.hits(text, PREPRESS), "doubled_words": doubled,
    }


def noise(text: Column) -> dict[str, Column]:
    part = F.substring(text, 1, SAMPLE)
    tokens = t.count_words(part)
    return {"n_sample": F.length(part), "n_tokens": tokens, "noise_ratio": F.coalesce(t.noise_characters(part) / F.nullif(F.length(part), F.lit(0)), F.lit(0.0)), "word_ratio": F.when(tokens > 0, t.wordlike_tokens(part) / tokens).otherwise(1.0)}


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and those of the report; null and empty texts score 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns(counters(body)).withColumns(noise(body))
    long_enough = (F.col("n_sample") >= NOISE_CHARS) & (F.col("n_tokens") >= NOISE_TOKENS)
    binary = long_enough & ((F.col("noise_ratio") >= 0.10) | ((F.col("noise_ratio") >= 0.02) & (F.col("word_ratio") <= 0.15)) | (F.col("word_ratio") <= 0.05))
    rows = rows.withColumn("binary_noise", binary).drop("n_sample", "n_tokens")
    unheaded = (F.col("chars") > BIG_DOCUMENT) & (F.col("headings") == 0)
    marks: list[tuple[Column, Column, Column]] = [
        (F.col("binary_noise"), F.lit(80), F.lit("output looks like binary noise (source may be corrupt)")), (unheaded, F.lit(25), F.lit("no headings")),
        (~F.col("fence_parity_ok"), F.lit(15), F.lit("unbalanced code fences")),
        *((F.col(c) > 0, F.least(F.lit(most), 1 + F.floor(F.col(c) / per).cast("int")), F.concat_ws(" ", F.col(c).cast("string"), F.lit(label))) for c, per, most, label in COSTS),
    ]
    cost = sum((F.when(hit, points).otherwise(0) for hit, points, _ in marks), F.lit(0))
    issues = F.array_compact(F.array(*[F.when(hit, label) for hit, _, label in marks]))
    empty = F.col("chars") == 0
    rows = rows.withColumns({"score": F.when(empty, 0).otherwise(F.greatest(F.lit(0), 100 - cost)).cast("int"), "issues": F.when(empty, F.array(F.lit("empty output"))).otherwise(issues)})
    return rows.withColumn("est_tokens", F.when(empty, 0).otherwise(F.col("est_tokens")))


def summary() -> Column:
    """One line on a row of assess()."""
    issues = F.when(F.size("issues") > 0, F.concat(F.lit("issues: "), F.array_join("issues", "; ")))
    parts = [F.concat(F.lit("~"), F.format_number("est_tokens", 0), F.lit(" tokens")), F.concat(F.col("headings"), F.lit(" heading(s)")), F.concat(F.col("fenced_blocks"), F.lit(" code block(s)")), issues]
    return F.concat(F.lit("Quality "), F.col("score"), F.lit("/100 - "), F.array_join(F.array_compact(F.array(*parts)), ", "))


#: Keys of a report as JSON, in their order.
REPORT = ("score", "est_tokens", "chars", "headings", "fenced_blocks", "unlabeled_fences", "fence_parity_ok", "toc_residue", "lone_bullets", "raw_bullet_lines", "hard_wrap_hints", "prepress_residue", "doubled_words", "noise_ratio", "word_ratio", "binary_noise", "issues")


def as_json() -> Column:
    """A row of assess() as one JSON object of seventeen keys; ratios have three places."""
    return F.to_json(F.struct(*[F.round(k, 3).alias(k) if k.endswith("_ratio") else F.col(k) for k in REPORT]))
