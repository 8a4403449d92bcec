"""Secret scan: spans that look like credentials, told apart from examples by who owns copies of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: The three base kinds in their listed order (kind, pattern, pattern of the secret part in a match, least length of it).
KINDS = [
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+",
     "^[A-Za-z_]+[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 8),
    ("access", "AKIA[A-Z0-9]+", "^(.*)$", 16),
    ("hex", "[0-9a-f]{32,}", "^(.*)$", 32),
]
#: The kind this method adds: long runs of the usual key alphabets.
WIDE = "[A-Za-z0-9+/_=-]{20,}"
ORDER = [k for k, *_ in KINDS] + ["owned"]


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, match): code points, end exclusive. The gaps that
    `split` leaves give the starts; texts without a match pass one search only. The running sum goes by blocks of the
    square root of the number of matches, as appending to an array copies it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pieces = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(m, F.lit("")).alias("match")))
    block = lambda p: F.ceil(F.sqrt(F.size(p))).cast("int")
    blocks = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), block(p)), lambda i: F.slice(p, i, block(p)))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    walk = lambda items, at, step: F.aggregate(items, F.struct(at.alias("at"), empty.alias("out")), step)
    add = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + F.length(p["match"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + F.length(p["match"])).alias("end"), p["match"].alias("match")))).alias("out"))
    join = lambda acc, done: F.struct(done["at"].alias("at"), F.concat(acc["out"], done["out"]).alias("out"))
    walked = walk(blocks(pieces), F.lit(0), lambda acc, b: join(acc, walk(b, acc["at"], add)))["out"]
    return F.when(text.rlike(pattern), F.filter(walked, lambda s: s["match"] != "")).otherwise(empty)


def _live(value: Column) -> Column:
    """Letters and digits mixed, of ten different characters at least: what a generated key looks like."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= 10)


def _valued(spans: str, k: int) -> Column:
    """The spans of kind `k` with the secret part of their match, those long enough."""
    _, _, inner, least = KINDS[k]
    value = lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["match"], inner, 1).alias("value"))
    return F.filter(F.transform(spans, value), lambda s: F.length(s["value"]) >= least)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with `base` (kind number, start, end, value) and `wide` (start, end, value): every candidate
    that a corpus-wide count then judges."""
    t = F.col("_t")
    scanned = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumns({f"_{kind}": spans_of(t, pattern) for kind, pattern, _, _ in KINDS} | {"_wide": spans_of(t, WIDE)})
    kept = [_valued(f"_{kind}", k) for k, (kind, *_) in enumerate(KINDS)]
    found = scanned.withColumn("base", F.concat(*kept))
    free = lambda s: _live(s["match"]) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    wide = F.transform(F.filter("_wide", free), lambda s: F.struct(F.lit(len(KINDS)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value")))
    return found.withColumn("wide", wide).drop("_t", "_wide", *[f"_{kind}" for kind, *_ in KINDS])


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """hash, n_documents, n_repositories, n_owners of every candidate value. Copies within a repository are summed
    before the distinct counts, so a value that a third of all documents hold is a few rows by then."""
    rows = found.select("doc_id", owner.alias("owner"), repository.alias("repository"), F.explode(F.concat("base", "wide")).alias("c")).select("doc_id", "owner", "repository", F.sha2("c.value", 256).alias("hash"))
    by_repository = rows.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_documents"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def _joined(spans: Column) -> Column:
    kind = lambda s: F.get(F.array(*map(F.lit, ORDER)), s["kind"])
    text = lambda s: F.concat(kind(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def text_key(text: Column) -> Column:
    """What tells apart the texts of rows that share an id, or have none."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def scan_secrets(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """One row per document of `docs` (doc_id, text, source): n_assign, n_access, n_hex, base_sha256, spans, and
    n_live and n_examples, the spans by what the corpus says of their value; `span_list` has kind, start, end, verdict,
    and `text_key` goes with doc_id to name the text they belong to.

    The repository is the `source`, its owner the part before the first `/` (a null source is a repository and an owner
    of its own). Every base match stays. Besides, each long mixed run of key characters that no base span covers is a
    candidate. A value that `example_owners` or more owners hold is a copied example, fewer: live, in however many
    repositories these owners have it. Candidates are added as `owned` when they are live. `live_repositories` is the
    largest number of repositories that hold the value of one of the document's live spans: how far it must be revoked.

    Null and empty texts have no spans. Rows of one doc_id, or without one, are one document if their texts are equal
    (returned once per row), else documents of their own; an empty table gives no rows; other columns are ignored."""
    repository = F.coalesce(F.col("source").cast("string"), F.lit(""))
    found = materialise(candidates(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"), repository.alias("repository"))).drop("text"), "candidates")
    owners = materialise(ownership(found, F.split(F.col("repository"), "/")[0], F.col("repository")), "owners")
    spread = (found.where("size(base) + size(wide) > 0").select("doc_id", "text_key", F.explode(F.concat("base", "wide")).alias("c"))
              .select("doc_id", "text_key", F.sha2("c.value", 256).alias("hash"), "c.kind", "c.start", "c.end").distinct())
    judged = spread.join(owners, "hash").where((F.col("kind") < len(KINDS)) | (F.col("n_owners") < example_owners))
    verdict = F.when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    # all spans of one document: as many as its own text holds
    spans = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", verdict.alias("verdict"), F.col("n_repositories").cast("long").alias("n_repositories")))).alias("all"))
    rows = found.select("doc_id", "text_key", "base").join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    base = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    every = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,verdict:string,n_repositories:bigint>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    judged_as = lambda v: F.size(F.filter(every, lambda s: s["verdict"] == v)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"),
        judged_as("live").alias("n_live"), judged_as("example").alias("n_examples"),
        F.coalesce(F.array_max(F.transform(F.filter(every, lambda s: s["verdict"] == "live"), lambda s: s["n_repositories"])), F.lit(0).cast("long")).alias("live_repositories"), every.alias("span_list"), "text_key")


def mask_spans(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each span replaced; overlapping spans become one mark."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
