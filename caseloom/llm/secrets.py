"""Secret scans with corpus-wide ownership frequency, in Spark expressions only.

Base kinds are spans that a pattern alone decides.  Opaque kinds (long mixed values, keys
with a provider's prefix, passwords in links) are candidates: their hashes are counted by
distinct repository and owner over the whole corpus, and a value that few owners have is
taken as a live credential, while one that many have is a copied example.  Base spans are
counted alike and labelled, but stay in either case.

Positions come from the text between matches: ``split`` and ``regexp_extract_all`` walk the
same matches, so match i starts after the first i + 1 pieces and the first i matches.
Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import stage, text_or_empty

# Base kinds, in the order in which ties are listed.  A run of one class of
# characters that is long enough is the same as a greedy run of sufficient length.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ASSIGNED = 12

# Candidate kinds that ownership decides.
OPAQUE = {
    "provider": r"\b(?:gh[pousr]_|github_pat_|xox[abprs]-|sk-|pk_live_|sk_live_|AIza|glpat-|eyJ)[A-Za-z0-9_.-]{16,}",
    "link": r"://[A-Za-z0-9._~%+-]+:[^\s:@/]{4,}@",
    "mixed": r"[A-Za-z0-9+/_=-]{24,}",
}
BLOCK = 256
MAX_OWNERS = 2


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans ``kind, start, end, value`` of all leftmost non-overlapping matches whose ``group``
    (``value``) has ``least`` characters.  The empty text has none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)

    def spans(s: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(s["found"], F.char_length))
        starts = running(F.zip_with(s["pieces"], before, lambda piece, match: piece + match))
        out = F.zip_with(
            s["found"], F.slice(starts, 1, F.size(s["found"])),
            lambda m, at: F.struct(
                F.lit(kind).alias("kind"), at.alias("start"), (at + F.char_length(m)).alias("end"),
                (F.regexp_extract(m, pattern, group) if group else m).alias("value"),
            ),
        )
        return F.filter(out, lambda x: F.char_length(x["value"]) >= least)

    found_and_pieces = F.struct(found.alias("found"), pieces.alias("pieces"))
    return bound(found_and_pieces, lambda s: F.when(F.size(s["found"]) > 0, spans(s)).otherwise(spans_type()))


def spans_type() -> Column:
    """No spans."""
    return F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")


def running(numbers: Column) -> Column:
    """Running sums of at least one number, by blocks: appending to one long array would copy
    it for every number."""

    def sums(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array().cast("array<int>"),
            lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
        )

    def blocks(all_: Column) -> Column:
        numbered = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(numbered, lambda b: sums(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))

    def shifted(parts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(parts, lambda p: F.element_at(p, -1)))
        offsets = F.slice(sums(ends), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p, lambda x: x + o)))

    return bound(numbers, lambda all_: bound(blocks(all_), shifted))


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]), s["end"], s["value"], s["kind"]).cast(
        "struct<start:int,place:bigint,end:int,value:string,kind:string>"))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (spans, in order) and ``opaque`` (candidate spans that touch no
    base span) of each whole text."""
    text = text_or_empty(text_col)
    base = [
        matches(text, p, kind, 2, ASSIGNED) if kind == "assign" else matches(text, p, kind)
        for kind, p in BASE.items()
    ]
    found = docs.withColumn("base", in_order(F.concat(*base), list(BASE)))
    opaque = [matches(text, p, kind) for kind, p in OPAQUE.items()]
    whole = F.concat(*opaque)

    def lives(s: Column) -> Column:
        free = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        mixed = (
            s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
            & ~s["value"].rlike(r"(.)\1\1\1")
        )
        return free & ((s["kind"] != "mixed") | mixed)

    return found.withColumn("opaque", F.filter(whole, lives))


def ownership(found: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """``hash, n_repos, n_owners`` of every candidate value of the corpus.

    Distinct (value, repository, owner) rows come first, so a value that is everywhere is
    combined where it is read.  A null repository or owner counts as one unnamed one.
    """
    each = found.select(
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.explode(F.array_distinct(F.transform(F.concat("base", "opaque"), lambda s: F.sha2(s["value"], 256)))).alias("hash"),
    ).distinct()
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = each.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def _judged(found: DataFrame, max_owners: int) -> DataFrame:
    """``row, spans`` for rows with spans, from staged candidates."""
    counts = ownership(found, F.col("scanned_repo"), F.col("scanned_owner"))
    spans = found.select("row", F.explode(F.concat("base", "opaque")).alias("span")).withColumn(
        "hash", F.sha2("span.value", 256)
    )
    live = F.col("n_owners") <= max_owners
    kinds = F.array(*[F.lit(k) for k in [*BASE, *OPAQUE]])
    return (
        spans.join(counts, "hash")
        .where(F.col("span.kind").isin(*BASE) | live)
        .select("row", F.struct(
            F.col("span.start").alias("start"), F.array_position(kinds, F.col("span.kind")).alias("place"),
            F.col("span.kind").alias("kind"), F.col("span.end").alias("end"), F.col("span.value").alias("value"),
            "n_owners", "n_repos", live.alias("live"),
        ).alias("span"))
        .groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    )


def _owner_and_repo(repo: Column | None, owner: Column | None) -> list[Column]:
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", owner, F.col("lang")) if repo is None else repo
    return [repo.cast("string").alias("scanned_repo"), owner.cast("string").alias("scanned_owner")]


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None,
    owner: Column | None = None, max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``spans``.

    ``spans`` holds all base spans and the opaque ones whose value at most ``max_owners``
    owners have, by start and kind; each has ``value``, ``n_owners``, ``n_repos`` and ``live``
    (at most ``max_owners`` owners).  Null texts count as empty and have no spans; repeated
    rows and rows with equal or null ids are judged each for itself; no rows give no rows.
    Columns besides the named ones are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("scanned_id"), F.col(text_col).alias("scanned_text"), *_owner_and_repo(repo, owner)
    )
    found = candidates(rows, "scanned_text").drop("scanned_text")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    judged = _judged(found, max_owners)
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.join(judged, "row", "left").select(
        F.col("scanned_id").alias(id_col), "base", F.coalesce("spans", none).alias("spans")
    )


def redacted(
    docs: DataFrame, text_col: str = "text", repo: Column | None = None, owner: Column | None = None,
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``[SECRET]`` (live) or ``[EXAMPLE]``
    (a value that more owners have).  Overlapping spans are replaced as one, live if one is.

    All rows and columns stay; null texts stay null.  Rows without candidates are not shuffled.
    """
    own = F.struct(*docs.columns).alias("redacted_doc")
    rows = docs.select(own, F.col(text_col).alias("scanned_text"), *_owner_and_repo(repo, owner))
    found = candidates(rows, "scanned_text").drop("scanned_text")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    has = F.size(F.concat("base", "opaque")) > 0
    busy = found.where(has).select("row", "redacted_doc").join(
        _judged(found.where(has).drop("redacted_doc"), max_owners), "row", "left"
    )
    text = F.col("redacted_doc")[text_col]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(acc: Column, s: Column) -> Column:
        # A span that begins inside the text replaced so far adds only what lies beyond it.
        label = F.when(s["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, label))).when(
            s["live"], F.concat(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1), F.array(label))
        ).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    spans = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["live"]))
    cleaned = F.aggregate(
        spans, start, cut,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    new = F.when(F.size("spans") > 0, cleaned).otherwise(text)
    changed = busy.select(*[
        new.alias(c) if c == text_col else F.col("redacted_doc")[c].alias(c) for c in docs.columns
    ])
    return found.where(~has).select("redacted_doc.*").unionByName(changed)
