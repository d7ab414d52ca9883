"""Secret scans that link the parts of a credential, with DataFrame functions only.

Strong spans (assignments, access identifiers, long hexadecimal runs) are always reported. Weak
candidates (account names, short assigned values, mixed blobs, endpoints) are reported only where
the parts that complement them lie within a scope around them and are no part of the same
characters: a range join of each text's spans with themselves, done as range windows that look for the
nearest end and the farthest start of each role, so that no pairs are made.

Results for odd input: a null text counts as the empty one and has no spans; null ids and
repeated rows pass through, one result each; texts are scanned whole; spans with the same start
are ordered by kind, then end; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeload.llm.common import text_of

# Distance in code points between the starts of a credential's parts.
SCOPE = 300

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))" + _VALUE
# Kinds in the order of their listing: pattern, group of the value, and least length of the value.
# A run of a class, taken whole and then dropped if too short, equals the run of that least length.
STRONG = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "account": (r"((?i:client|account|user|access|key)[_-]?(?i:id|name))" + _VALUE, 2, 4),
    "short": (ASSIGN, 2, 6),  # values under 12 characters; longer ones are strong
    "blob": (r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    "endpoint": (r"[a-z][a-z0-9+.-]{1,15}://[^\s\x22'<>]{4,}", 0, 8),
}
KINDS = [*STRONG, *WEAK]
_IDENTIFIERS, _SECRETS = ("access", "account"), ("assign", "hex", "short", "blob")
# What a text must hold for a pattern to be tried: cheaper than the pattern.
_NEEDED = {
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "endpoint": lambda t: F.contains(t, F.lit("://")),
    "blob": lambda t: t.rlike(r"[A-Za-z0-9+/]{32}"),
}


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """A struct for each match: kind, number, code points since the last match, own, of the value.

    The text is split at the matches; the lengths of the pieces add up to positions.
    """
    needed = _NEEDED.get(kind, lambda t: t.rlike(pattern))(text)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("own"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    spans = F.transform(
        F.filter(zipped, lambda x: x["own"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"),
            i.alias("number"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["own"]).alias("own"),
            F.length(x["value"]).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<rank:int,number:int,gap:int,own:int,value:int>>")
    return F.when(needed, spans).otherwise(none)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"]),
    )
    return F.array_join(parts, ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, counts ``n_<kind>``, ``base`` (the strong spans) and ``spans`` (all reported).

    A row is given a number of its own at the scan, so equal rows stay apart. Only spans are
    shuffled, by that number; a text's spans are a window, at most as many as the text is long.
    """
    patterns = {**STRONG, **WEAK}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    found = F.concat(*[_matches(F.col("text"), kind, *patterns[kind]) for kind in KINDS])
    each = rows.select("row", "doc_id", F.explode_outer(found).alias("m")).select("row", "doc_id", "m.*")
    placed = Window.partitionBy("row", "rank").orderBy("number")
    ended = each.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(placed))
    starts = ended.withColumn("start", F.col("end") - F.col("own"))
    least = F.element_at(F.array(*[F.lit(patterns[k][2]) for k in KINDS]), F.col("rank") + 1)
    short = F.col("rank") == KINDS.index("short")
    real = (F.col("value") >= least) & ~(short & (F.col("value") >= STRONG["assign"][2]))
    real = F.coalesce(real, F.lit(False))
    ranks = {role: [KINDS.index(k) for k in kinds] for role, kinds in
             {"identifier": _IDENTIFIERS, "secret": _SECRETS, "endpoint": ("endpoint",)}.items()}
    by_start = Window.partitionBy("row").orderBy("start")
    before, after = by_start.rangeBetween(-scope, -1), by_start.rangeBetween(0, scope)

    def has(among: list[int]) -> Column:
        """Whether a span of these kinds ends before this one starts, or starts after it ends."""
        own = real & F.col("rank").isin(among)
        ended = F.min(F.when(own, F.col("end"))).over(before) <= F.col("start")
        started = F.max(F.when(own, F.col("start"))).over(after) >= F.col("end")
        return F.coalesce(ended, F.lit(False)) | F.coalesce(started, F.lit(False))

    counted = starts.select("*", real.alias("real"), *[has(among).alias(f"near_{role}") for role, among in ranks.items()])
    strong = F.col("rank") < len(STRONG)
    linked = (
        F.when(F.col("rank") == KINDS.index("account"), F.col("near_secret"))
        .when(F.col("rank") == KINDS.index("endpoint"), F.col("near_secret") & F.col("near_identifier"))
        .otherwise(F.col("near_identifier") | F.col("near_endpoint"))
    )
    kept = counted.withColumn("kept", F.col("real") & (strong | linked))
    span = F.struct("start", "rank", "end")
    gathered = kept.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("all"),
    )
    base = F.filter("all", lambda s: s["rank"] < len(STRONG))

    def count(rank: int) -> Column:
        return F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return gathered.select("doc_id", *counts, _listed(base).alias("base"), _listed(F.col("all")).alias("spans"))
