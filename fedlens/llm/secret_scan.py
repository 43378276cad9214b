"""Secrets in texts, judged by how many owners hold them; column expressions only.

Matches of the fixed kinds always count. Further long tokens that look like keys are candidates; the hashes of all
candidate values are counted over the corpus by distinct owner and repository. A value that many owners hold is an example
that was copied, and so is a key-like token in many repositories of few owners; other key-like tokens are taken for live
credentials. The spans of the query have those of a single owner only, as its SQL says; redaction masks all of them.
Only hashes of values leave a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import stored

# Kinds in their order with pattern, the group that holds the value, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}", 0, 20),
)
OWNED = len(KINDS) - 1
NAMES = [k[0] for k in KINDS]
SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"
EXAMPLE_OWNERS = 3
#: Key-like tokens in so many repositories are examples whatever their owners; matches of the fixed kinds are not.
EXAMPLE_REPOSITORIES = 100
LIVE_DISTINCT = 10
MASK = "[SECRET]"


def _found(text: Column, kind: int) -> Column:
    """Spans of one kind, left to right: gaps and matches in turn give the places, in code points."""
    _, pattern, group, least = KINDS[kind]
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(none, F.array()).cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        span = F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), part["value"].alias("value"))
        good = part["whole"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(
            F.coalesce(end, start).cast("long").alias("at"),
            F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate(parts, begin, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(begin["spans"])


def _live_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_`` (spans of the fixed kinds, in order) and ``more_`` (key-like tokens apart from those)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("base_", F.array_sort(F.concat(*(_found(text, k) for k in range(OWNED)))))
    apart = lambda g: ~F.exists("base_", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"]))
    docs = docs.withColumn("more_", F.filter(_found(text, OWNED), lambda g: _live_looking(g["value"]) & apart(g)))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))
    return docs.withColumns({c: F.transform(c, hashed) for c in ("base_", "more_")})


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repositories`` from rows of ``hash, owner, repository``; a null owner or repository counts as one.

    Sums go repository, owner, hash, so a value that half the corpus holds is one row an owner before its own key is
    shuffled.
    """
    each = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def is_live(s: Column) -> Column:
    """Whether a span is a credential to mask: by owners, and for key-like tokens by repositories too."""
    few = (s["kind"] < OWNED) | (s["n_repositories"] < EXAMPLE_REPOSITORIES)
    return (s["n_owners"] < EXAMPLE_OWNERS) & few


def scanned(spark: SparkSession, docs: DataFrame, owner: str, repository: str, every: bool = False) -> DataFrame:
    """The struct ``doc`` (a row of ``docs``) and ``spans``: array of start, kind, end, n_owners, n_repositories, added.

    Spans are by start, then kind. ``added`` marks key-like tokens. Those of more than one owner are left out unless
    ``every`` is set; base spans never are. A null text has no spans. Rows are kept as often as they occur; an empty table gives no rows. Rows
    without candidates are not moved. The row's columns travel in one struct, so their names can't clash.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = with_candidates(docs.select(F.struct(*names).alias("doc"), F.col("text")))
    has_any = (F.size("base_") > 0) | (F.size("more_") > 0)
    hits = stored(spark, packed.where(has_any).select(F.monotonically_increasing_id().alias("row_"), "doc", "base_", "more_"), "secret-rows")
    each = hits.select("row_", F.col(f"doc.`{owner}`").alias("owner"), F.col(f"doc.`{repository}`").alias("repository"), F.explode(F.concat("base_", "more_")).alias("s"))
    each = each.select("row_", "owner", "repository", "s.*")
    judged = each.join(ownership(each), "hash")
    if not every:
        judged = judged.where((F.col("kind") < OWNED) | (F.col("n_owners") == 1))
    span = F.struct("start", "kind", "end", "n_owners", "n_repositories", (F.col("kind") == OWNED).alias("added"))
    spans = judged.groupBy("row_").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kind = "array<struct<start:bigint,kind:int,end:bigint,n_owners:bigint,n_repositories:bigint,added:boolean>>"
    none = F.array().cast(kind)
    found = hits.select("row_", "doc").join(spans, "row_", "left").select("doc", F.coalesce("spans", none).alias("spans"))
    return found.unionByName(packed.where(~has_any).select("doc", none.alias("spans")))


def digests(found: DataFrame) -> DataFrame:
    """Counts a kind, the digest of the base spans, all spans, and how many are copied examples or single-owner."""
    text = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        *(of_kind(k).alias(f"n_{NAMES[k]}") for k in range(OWNED)),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        count(lambda s: s["n_owners"] >= EXAMPLE_OWNERS).alias("n_copied"),
        count(lambda s: s["n_owners"] == 1).alias("n_single_owner"),
    )


def redacted(spark: SparkSession, docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """``docs`` with every span masked but copied examples; ``n_chars``, where there is one, follows the new text."""
    found = scanned(spark, docs, owner, repository, every=True).withColumn("spans", F.filter("spans", is_live))
    text = F.col("doc.text")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = text.substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], text.substr((state["at"] + 1).cast("int"), F.length(text)))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", begin, step, rest)).otherwise(text)
    found = found.withColumn("masked_", masked)
    own = {"text": F.col("masked_")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("masked_")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
