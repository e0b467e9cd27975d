"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains
(0).  The counts of vote patterns over all documents, at most 3**len(RULES) of
them, feed an expectation-maximisation for the share of good documents and each
rule's vote probabilities given the hidden class.  A document is kept when its
posterior probability of being good reaches the threshold and it hasn't failed
the base limits.

Defined cases: a null text has no words, and fails the base limits like an
empty one; repeated rows and null ids are rows like any other; with an empty
table the starting values stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh
from marlstone.llm.hashing import _SPACE, BLOCK, U64, mix, rows_of_words, separated, span_hashes, stream, text_blocks, word_hashes
from marlstone.storage import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
ROUNDS = 60
#: Weight of the starting values, as a share of the documents; it keeps the hidden class the one that the rules mean.
PRIOR = 0.05
START_SHARE = 0.8
#: Starting probabilities of (bad, abstain, good) votes, for bad and for good documents.
START_VOTES = ((0.3, 0.5, 0.2), (0.01, 0.39, 0.6))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_distinct")

#: Rules by name: bad beyond the first limit, good on the right side of the second, else they abstain; limits are percents of the second count.
#: Where being free of one kind of damage says nothing of the others there's no second limit: such good votes, given to most bad texts too, would drown a bad one.
RULES = (
    ("short", "n_words", None, "<", 60, None),
    ("symbols", "n_symbols", "n_words", ">", 20, 2),
    ("prose", "n_letters", "word_chars", "<", 80, 93),
    ("repeats", "n_repeat_words", "n_words", ">", 30, None),
    ("dup_lines", "n_dup_lines", "n_lines", ">", 50, None),
    ("capitals", "n_upper", "n_letters", ">", 35, 8),
    ("shouting", "n_shouts", "n_words", ">", 15, None),
    ("variety", "n_distinct", "n_words", "<", 12, 60),
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True


def _line_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of lines; long ones apart, so that memory stays bounded."""
    if len(raw) <= 2 * BLOCK:
        return span_hashes(raw, starts, ends)
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())], dtype=U64)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def block_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each row of a block of rows."""
    n = len(offsets) - 1
    text, own = raw, offsets
    raw, offsets = separated(raw, offsets)
    words, starts = word_hashes(raw, lower=False)
    bounds = rows_of_words(starts, offsets)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = {k: np.zeros(n, dtype=np.int64) for k in COUNTS}
    out["n_words"] = np.diff(bounds)
    out["word_chars"] = _sums(~_SPACE[text] & ((text & 0xC0) != 0x80), own)
    out["n_symbols"] = _sums(_SYMBOL[text], own)
    out["n_upper"] = _sums(_UPPER[text], own)
    out["n_letters"] = _sums(_LETTER[text], own)
    out["n_shouts"] = _sums(text == 33, own)
    salt = stream(41, 1)[0]
    with np.errstate(over="ignore"):
        rows = mix((row.astype(U64) + U64(1)) * salt)
        if len(words):
            out["n_distinct"] = np.bincount(row[np.unique(words ^ rows, return_index=True)[1]], minlength=n)
        if len(words) > 2:
            m = len(words) - 2
            tri = mix(mix(words[:m] * U64(3) + words[1 : m + 1]) * U64(5) + words[2:]) ^ rows[:m]
            inside = row[:m] == row[2:]
            at = np.flatnonzero(inside)
            _, inverse, counts = np.unique(tri[at], return_inverse=True, return_counts=True)
            covered = np.zeros(len(words), dtype=bool)
            twice = at[counts[inverse] > 1]
            for k in range(3):
                covered[twice + k] = True
            out["n_repeat_words"] = _sums(covered, bounds)
    # lines, within the rows as they are
    cut = np.unique(np.concatenate([np.flatnonzero(text == 10) + 1, own[:-1]]))
    cut = cut[cut < len(text)]
    if len(cut):
        ends = np.append(cut[1:], len(text))
        line_row = np.searchsorted(own, cut, side="right") - 1
        ends = ends - (text[ends - 1] == 10)
        word_bytes = np.concatenate([[0], np.cumsum(~_SPACE[text])])
        real = word_bytes[ends] > word_bytes[cut]
        cut, ends, line_row = cut[real], ends[real], line_row[real]
        out["n_lines"] = np.bincount(line_row, minlength=n)
        if len(cut):
            with np.errstate(over="ignore"):
                key = _line_hashes(text, cut, ends) ^ mix((line_row.astype(U64) + U64(1)) * salt)
            first = np.unique(key, return_index=True)[1]
            out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first], minlength=n)
    return np.stack([out[k] for k in COUNTS])


def counter(text_index: int, name: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [block_counts(raw, offsets) for _, _, raw, offsets in text_blocks(batch.column(text_index))]
            if not parts:
                continue
            table = np.concatenate(parts, axis=1)
            counts = pa.StructArray.from_arrays([pa.array(x) for x in table], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, name])

    return run


SIGNALS = "__signals"


def with_signals(docs: DataFrame, columns: list[str], name: str = SIGNALS) -> DataFrame:
    """The named columns, ``text`` among them, and a struct of counts called ``name``."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = StructType([*rows.schema.fields, StructField(name, StructType([StructField(k, LongType()) for k in COUNTS]))])
    return rows.mapInArrow(counter(columns.index("text"), name), schema)


def votes(signals: str = SIGNALS) -> list[Column]:
    """A vote column for each rule."""
    out = []
    for name, count, of, side, bad, good in RULES:
        c = F.col(f"{signals}.{count}")
        base = F.lit(1) if of is None else F.col(f"{signals}.{of}")
        x = c if of is None else c * 100
        low = x > base * bad if side == ">" else x < base * bad
        high = F.lit(False) if good is None else x <= base * good if side == ">" else x >= base * good
        some = F.col(f"{signals}.n_words") > 0
        out.append(F.when(some & low, -1).when(some & high, 1).otherwise(0).cast("int").alias(name))
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[float, np.ndarray]:
    """Share of good documents, and p[rule, class, vote + 1], from vote patterns and how often each came."""
    n_rules = patterns.shape[1] if len(patterns) else len(RULES)
    share, p = START_SHARE, np.tile(np.array(START_VOTES), (n_rules, 1, 1)).astype(float)
    if not len(patterns):
        return share, p
    which = np.arange(n_rules)
    start, prior = p.copy(), prior * counts.sum()
    for _ in range(rounds):
        like = np.stack([np.log(p[which, c, patterns + 1]).sum(axis=1) for c in (0, 1)])
        like += np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        mass = np.stack([counts * (1 - good), counts * good])
        share = float(np.clip((mass[1].sum() + START_SHARE * prior) / (counts.sum() + prior), 0.01, 0.99))
        for c in (0, 1):
            for v in (0, 1, 2):
                p[:, c, v] = ((patterns == v - 1) * mass[c][:, None]).sum(axis=0) + prior * start[:, c, v]
        p /= p.sum(axis=2, keepdims=True)
    return share, p


def posterior(share: float, p: np.ndarray, columns: list[Column]) -> Column:
    """Probability of a good document as a column of its votes."""
    logit = F.lit(float(np.log(share / (1 - share))))
    for r, c in enumerate(columns):
        w = np.log(p[r, 1] / p[r, 0])
        logit = logit + F.when(c < 0, float(w[0])).when(c > 0, float(w[2])).otherwise(float(w[1]))
    return 1 / (1 + F.exp(-logit))


def accuracies(model: tuple[float, np.ndarray]) -> dict[str, tuple[float, float]]:
    """For each rule, how often the model takes its bad and its good votes to be right."""
    share, p = model
    out = {}
    for (name, *_), q in zip(RULES, p):
        bad, good = (1 - share) * q[0], share * q[1]
        out[name] = (float(bad[0] / (bad[0] + good[0])), float(good[2] / (bad[2] + good[2])))
    return out


def learn(rows: DataFrame, signals: str = SIGNALS) -> tuple[float, np.ndarray]:
    """The fitted model; reads one count for each vote pattern."""
    names = [r[0] for r in RULES]
    found = rows.select(*votes(signals)).groupBy(*names).count().collect()
    patterns = np.array([[row[k] for k in names] for row in found], dtype=np.int64).reshape(len(found), len(names))
    order = np.lexsort(patterns.T)
    return fit(patterns[order], np.array([row["count"] for row in found], dtype=float)[order])


def verdict(model: tuple[float, np.ndarray], min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, threshold: float = THRESHOLD, signals: str = SIGNALS) -> dict[str, Column]:
    s = lambda k: F.col(f"{signals}.{k}")
    failed = (s("n_words") < min_words) | (100 * s("n_repeat_words") > max_repeat_percent * s("n_words"))
    good = posterior(*model, votes(signals))
    return {"base_failed": failed, "posterior": good, "kept": ~failed & (good >= threshold)}


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, each rule's vote, base_failed, posterior and kept, a row for each row."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = with_signals(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ["doc_id", "text"]).drop("text")
    rows = scratch.keep(rows, "signals")
    named = {f"vote_{r[0]}": v for r, v in zip(RULES, votes())}
    return rows.select("doc_id", *[F.col(f"{SIGNALS}.{k}").alias(k) for k in COUNTS], *[v.alias(k) for k, v in named.items()], *[v.alias(k) for k, v in verdict(learn(rows)).items()])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are read and counted once: rows go to the shared folder beside their
    counts, and from there to the model and to the result.
    """
    name = fresh(docs, SIGNALS)[0]
    rows = Scratch(docs.sparkSession, "rules").keep(with_signals(docs, docs.columns, name), "signals")
    model = learn(rows, name)
    return rows.where(verdict(model, signals=name)["kept"]).drop(name)


def sql() -> str:
    """DuckDB's form of judge(), with posteriors to six places: the same counts by its own means, and the fit by recursion over vote patterns."""
    word = r"[^\x20\x09-\x0D]+"

    def vote(name: str, of: str | None, side: str, bad: int, good: int | None) -> str:
        x, base = (name, "1") if of is None else (f"{name} * 100", of)
        other = "<=" if side == ">" else ">="
        good_case = "" if good is None else f" WHEN {x} {other} {base} * {good} THEN 1"
        return f"CASE WHEN n_words = 0 THEN 0 WHEN {x} {side} {base} * {bad} THEN -1{good_case} ELSE 0 END"

    names = [r[0] for r in RULES]
    votes_ = ", ".join(f"CAST({vote(*r[1:])} AS INTEGER) AS vote_{r[0]}" for r in RULES)
    start = "[" + ", ".join(str(float(x)) for _ in RULES for c in START_VOTES for x in c) + "]"
    listed = "[" + ", ".join(f"vote_{n}" for n in names) + "]"
    # the table of vote probabilities is a list: rule k, class c, vote x stand at 6k + 3c + x
    chance = lambda v, t: " * ".join(f"{t}[{6 * k} + {{0}} + {v}[{k + 1}] + 2]" for k in range(len(RULES)))
    good, bad = chance("v", "t").format(3), chance("v", "t").format(0)
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws, row_number() OVER () AS rid FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS at_word FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}') GROUP BY rid),
c AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(text, '[A-Za-z]|[^\x00-\x7F]')) AS BIGINT) AS n_letters,
  CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_shouts, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct FROM w LEFT JOIN l ON w.rid = l.rid LEFT JOIN rep ON w.rid = rep.rid),
d AS MATERIALIZED (SELECT * EXCLUDE (rid), {votes_} FROM c),
p AS (SELECT {listed} AS v, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1),
em AS (SELECT 0 AS round, {START_SHARE}::DOUBLE AS share, {start}::DOUBLE[] AS t
  UNION ALL SELECT round + 1, greatest(0.01, least(0.99, (m[2] + {START_SHARE} * wt) / (total + wt))), list_transform(range(0, {6 * len(RULES)}), lambda j: (sums[j + 1] + wt * {start}[j + 1]) / (m[(j // 3) % 2 + 1] + wt))
  FROM (SELECT round, {PRIOR} * total AS wt, total, [total - mass, mass] AS m, sums FROM (
    SELECT round, (SELECT sum(n) FROM p) AS total, (SELECT sum(n * share * {good} / (share * {good} + (1 - share) * {bad})) FROM p) AS mass,
      (SELECT list(x ORDER BY j) FROM (SELECT j, sum(CASE WHEN v[j // 6 + 1] = j % 3 - 1 THEN n * CASE WHEN (j // 3) % 2 = 1 THEN share * {good} ELSE (1 - share) * {bad} END / (share * {good} + (1 - share) * {bad}) ELSE 0 END) AS x FROM p, (SELECT unnest(range(0, {6 * len(RULES)})) AS j) GROUP BY j)) AS sums
    FROM em WHERE round < {ROUNDS}))),
f AS (SELECT share, t FROM em WHERE round = {ROUNDS}),
z AS (SELECT d.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, share * {good} / (share * {good} + (1 - share) * {bad}) AS posterior FROM (SELECT *, {listed} AS v FROM d) d, f)
SELECT * EXCLUDE (v, posterior, base_failed), base_failed, round(posterior, 6) AS posterior, NOT base_failed AND posterior >= {THRESHOLD} AS kept FROM z"""
