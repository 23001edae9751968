"""Secret scanning with corpus-wide ownership frequency, in SQL functions only.

Patterns propose candidates in each text.  The hashes of their values are counted
over the whole corpus by distinct repositories (documents) and owners (sources):
a value that many owners hold is a copied example, one that few owners hold in very
many repositories is copied within them, and one that few hold in few places looks
like a live credential.  Base kinds are always reported; opaque tokens, which no base
kind covers, are reported only while they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (kind, pattern, group that holds the value, least characters of that group).
BASE = (
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    # {n,} finds what the plain runs with a later length test would: runs are maximal.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: Values that more owners hold are taken for copied examples.
MAX_OWNERS = 2
#: Values that so few owners hold in more repositories are taken for copies of their own.
MAX_REPOSITORIES = 20


def matches_of(text: str, order: int, pattern: str, group: int) -> Column:
    """Array of (ord, place, gap, len, value) of the pattern's matches, in code points.

    gap is what lies between a match and the one before it, or the start of the text.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = f"regexp_extract_all({text}, {p}, {group})"
    parts = f"named_struct('v', {value}, 'g', split({text}, {p}, -1), 'm', " + ("NULL" if not group else f"regexp_extract_all({text}, {p}, 0)") + ")"
    match = "x.v[i]" if not group else "x.m[i]"
    one = f"named_struct('ord', {order}, 'place', i, 'gap', length(x.g[i]), 'len', length({match}), 'value', x.v[i])"
    none = "array_repeat(named_struct('ord', 0, 'place', 0, 'gap', 0, 'len', 0, 'value', ''), 0)"
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN transform(array({parts}), x -> transform(sequence(0, size(x.v) - 1), i -> {one}))[0] ELSE {none} END")


def found_spans(docs: DataFrame, patterns: tuple) -> DataFrame:
    """Rows (rid, owner, start, ord, end, value) of the matches in the arrays `found` whose value is long enough.

    A running sum over the gaps and matches of a text gives the places, however many there are.
    """
    rows = docs.select("rid", "owner", F.explode("found").alias("s")).select("rid", "owner", "s.*")
    so_far = Window.partitionBy("rid", "ord").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int")
    least = F.get(F.array(*[F.lit(p[3]) for p in patterns]), F.col("ord"))
    placed = rows.withColumn("end", end).where(F.length("value") >= least)
    return placed.select("rid", "owner", (F.col("end") - F.col("len")).alias("start"), "ord", "end", "value")


def uncovered(spans: DataFrame, n_base: int) -> DataFrame:
    """The spans without those of kind n_base that overlap a base span or lack a letter or a digit."""
    base = F.col("ord") < n_base
    up = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("rid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    seen = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("after", F.min(F.when(base, F.col("start"))).over(down))
    hit = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    token = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & ~hit
    return seen.where(base | token).drop("before", "after")


def scan(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, owner_col: str = "source",
    base: tuple = BASE, opaque: tuple = OPAQUE,
) -> DataFrame:
    """Finds secrets in each text; one row per input row.

    Returns doc_id, base (array of start, ord, end, value), spans (array of start, ord, end,
    kind, state, owners, repositories): all base spans plus opaque tokens with a letter and a
    digit that no base span overlaps and that look live; n_live, n_copied, n_shared, and the
    largest numbers of owners and repositories of a value in the text.  state is copied where
    more than max_owners owners hold the value, else shared where it is in more than
    max_repositories repositories (rows), else live.

    A null text counts as empty; a null owner is one owner.  Repeated rows are scanned each
    and count as repositories of their own, null ids are kept, further columns are left out.
    Texts may be of any length and have any number of matches; matches that start at one
    place are ordered by kind.  An empty table gives an empty result.
    """
    patterns = (*base, opaque)
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    found = F.concat(*[matches_of("t", i, p[1], p[2]) for i, p in enumerate(patterns)])
    rows = cut(text.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", found.alias("found")))
    spans = uncovered(found_spans(rows, patterns), len(base))
    spans = cut(spans.withColumn("hash", F.sha2("value", 256)))
    # Written first, so that both sides of the join are plain and a value that very many
    # documents hold can be split over tasks.
    held = cut(
        spans.groupBy("hash", "owner", "rid").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    state = (
        F.when(F.col("owners") > max_owners, F.lit("copied")).when(F.col("repositories") > max_repositories, F.lit("shared")).otherwise(F.lit("live"))
    )
    name = F.get(F.array(*[F.lit(p[0]) for p in patterns]), F.col("ord"))
    one = F.struct("start", "ord", "end", name.alias("kind"), "state", "owners", "repositories", "value")
    judged = (
        spans.join(held, "hash").withColumn("state", state)
        .where((F.col("ord") < len(base)) | (F.col("state") == "live"))
        .groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("all"))
    )
    kind = f"array<{judged.schema['all'].dataType.elementType.simpleString()}>"
    every = F.coalesce("all", F.array().cast(kind))
    out = rows.select("rid", "doc_id").join(judged, "rid", "left").select("doc_id", every.alias("all"))
    count = lambda s: F.size(F.filter("all", lambda x: x["state"] == s)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("all", lambda x: x[c])), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.transform(F.filter("all", lambda x: x["ord"] < len(base)), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["value"].alias("value"))).alias("base"),
        F.transform("all", lambda x: x.dropFields("value")).alias("spans"),
        *[count(s).alias(f"n_{s}") for s in ("live", "copied", "shared")],
        *[most(c).alias(f"most_{c}") for c in ("owners", "repositories")],
    )
