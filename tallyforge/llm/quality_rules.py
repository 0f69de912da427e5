"""Operator 4, quality rules: a bitmask ledger.

``ledger`` evaluates every rule once and keeps the measurements and one failure bit a rule. A policy is a versioned mask
over the bits, so judging by another policy, or asking what each rule alone decides, reads only the narrow ledger:
``verdicts`` is one bitwise test and ``ablation`` one aggregation.

Edge cases: null and empty texts have no words and fail ``few_words``; ratios are integer comparisons, so nothing divides
by zero; long texts are read whole; repeated rows are judged one by one; an empty table gives an empty ledger; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.statistics import document_statistics

#: Name and failing condition; a rule's bit is its place. Append only: bits in stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
    ("upper_case", "10 * n_upper > 4 * (n_upper + n_lower)"),
    ("marks", "10 * n_marks > 6 * n_words"),
    ("many_words", "n_words > 1000000"),
)
BIT = {name: 1 << at for at, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("web-1", (*BASE.rules, "symbols", "word_length", "upper_case", "marks", "many_words")), Policy("web-strict-1", tuple(BIT)))}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the text fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long")) for at, (_, cond) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return document_statistics(docs).withColumn("failed", failed)


def verdicts(book: DataFrame, policy: str = "web-1") -> DataFrame:
    """``base_failed`` and ``kept`` under a policy."""
    base, all_of = (F.col("failed").bitwiseAND(F.lit(POLICIES[p].mask).cast("long")) for p in ("base-1", policy))
    return book.withColumn("base_failed", base != 0).withColumn("kept", (base == 0) & (all_of == 0)).withColumn("policy", F.lit(policy))


def ablation(book: DataFrame, policy: str = "web-1") -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, rows kept if it were dropped. One pass."""
    mask = POLICIES[policy].mask
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count("*").alias("n"), F.count_if(hit == 0).alias("kept")]
    for rule in POLICIES[policy].rules:
        bit = F.lit(BIT[rule]).cast("long")
        sums += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"{rule}_failed"), F.count_if(hit == bit).alias(f"{rule}_alone")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_alone").alias("n_only"), (F.col("kept") + F.col(f"{r}_alone")).alias("n_kept_without")) for r in POLICIES[policy].rules])
    return book.agg(*sums).select(F.lit(policy).alias("policy"), "n", "kept", F.explode(rows).alias("r")).select("policy", "n", "kept", "r.*")


#: The same verdicts in DuckDB SQL over ``documents``; ``web-1`` as in POLICIES.
ORACLE_SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce("text", '') as txt from documents),
w as (select r, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') as ws from t),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from again) group by r),
ln as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
       from (select r, unnest(string_split(txt, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (select w.r, len(ws) as n_words, length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) as n_symbols,
             length(txt) - length(regexp_replace(txt, '[A-Z]', '', 'g')) as n_upper,
             length(txt) - length(regexp_replace(txt, '[a-z]', '', 'g')) as n_lower,
             length(txt) - length(regexp_replace(txt, '[!?;:"''()\[\]{}=+/\\_~^@`-]', '', 'g')) as n_marks from w),
a as (select m.*, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_dup_lines, 0) as n_dup_lines from m left join rep using (r) left join ln using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             10 * n_symbols > n_words or word_chars < 3 * n_words or word_chars > 12 * n_words or 10 * n_upper > 4 * (n_upper + n_lower)
             or 10 * n_marks > 6 * n_words or n_words > 1000000 as more from a)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not more as kept
from v join t using (r)
"""
