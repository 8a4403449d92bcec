"""From raw documents to a training mix: language, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every one but the last has the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, near_dups, secrets
from tidemark.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is accepted from this score on.
LEAST_SCORE = 0.3
# Ids that grow with the documents join their texts by merging at every size (`hint("merge")`): a plan that sends them to
# all executors while they are few would not last.
#: Share of each source in the mix: its own share to this power, made to add up to 1.
MIX_POWER, MIX_SEED = 0.5, 42


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter or fit no learned language go."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    judged = language.identify(docs.select(*COLUMNS), model)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8): the one with the smallest id. Different texts
    under one id are documents of their own, told apart by their texts (where they stand in for an id, the smallest hash
    takes the place of the smallest id); equal texts under one id are copies, of which one row stays. Rows without an id
    cannot be named as anybody's duplicate and stay."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS).where("doc_id is not null").withColumn("_of", key)
    texts = rows.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("_of").alias("_lo"), F.max("_of").alias("_hi"))
    repeated = materialise(texts.where("_n > 1").select("doc_id", (F.col("_lo") < F.col("_hi")).alias("_mixed")), "repeated_ids")
    if repeated.isEmpty():
        # every id names one row: nothing to tell apart, and no text is moved
        named = rows.withColumns({"_mixed": F.lit(None).cast("boolean"), "_row": F.col("doc_id")})
    else:
        named = materialise(rows.join(repeated, "doc_id", "left").withColumn("_row", F.when(F.col("_mixed"), F.col("_of")).otherwise(F.col("doc_id"))), "named")
    kept = near_dups.near_duplicates(named.select(F.col("_row").alias("doc_id"), "text"), n=5, percent=80).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    stay = named.join(kept.hint("merge"), F.col("_row") == F.col("_id"), "left_semi")
    # rows of one id and text: the one with the smallest hash of its columns
    once = stay.where("_mixed is not null").withColumn("_h", F.xxhash64(*COLUMNS)).groupBy("_row").agg(F.min_by(F.struct(*COLUMNS), "_h").alias("r")).select("r.*")
    nameless = docs.select(*COLUMNS).where("doc_id is null")
    return stay.where("_mixed is null").select(*COLUMNS).unionByName(once).unionByName(nameless)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, judged by their own text also where ids repeat or lack; passages of items
    without an id count."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True, unnamed_items=True)
    bad = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_bad"))
    rows = docs.select(*COLUMNS, secrets.text_key(F.col("text")).alias("_key"))
    return rows.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_bad")), "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced by a mark; widely copied examples stay as they are."""
    spans = secrets.scan_secrets(docs).where("n_live > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_of")).agg(F.first("span_list").alias("_spans"))
    rows = docs.select(*COLUMNS, secrets.text_key(F.col("text")).alias("_key"))
    rows = rows.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    live = F.filter("_spans", lambda s: s["verdict"] == "live")
    text = F.when(F.col("_spans").isNotNull(), secrets.mask_spans(F.col("text"), live)).otherwise(F.col("text"))
    n_chars = F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("text", text).withColumn("n_chars", n_chars).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents repeated to their sources' weights, in a global random order."""
    return mixing.mix_sources(docs.select(*COLUMNS), mixing.tempered_weights(docs, power=MIX_POWER), seed=MIX_SEED)


STAGES = [
    ("language_id", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)


#: SQL can express neither the trained language model nor the sketches; the tests hold run() against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
