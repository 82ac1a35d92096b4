"""Queries on values and texts: problems 5, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.canonical import map_rows, match_values
from orefield.llm.mixing import mix, reached_shares
from orefield.llm.packing import pack
from orefield.llm.queries import LLM
from orefield.llm.residue import residue_documents, residue_lines
from orefield.llm.tokens import VOCABULARY, token_count
from orefield.operators.hotkeys import bounded_broadcast
from orefield.session import cut_lineage
from orefield.sources.tables import table


REF_CITIES = 10_000


def typed_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business rows whose city is neither null nor blank."""
    return table(spark, sf_dir, "business").select("record_id", "city").where(F.col("city").rlike("[^\\s\\u00a0]"))


def city_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_values(typed_cities(spark, sf_dir), "city", table(spark, sf_dir, "ref_city"), "city_id", "city_name", ["alias"])


@LLM.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed city each freely typed one means, 0 if none; rows that have a listed name exactly are left out."""
    exact = bounded_broadcast(table(spark, sf_dir, "ref_city").select(F.col("city_name").alias("value")), REF_CITIES)
    matches = city_matches(spark, sf_dir)
    mapped = map_rows(typed_cities(spark, sf_dir), "city", matches, ["record_id"])
    return mapped.join(exact, "value", "left_anti").select("record_id", F.coalesce("ref_id", F.lit(0)).cast("int").alias("city_id"))


@LLM.add(
    "p5_plain",
    """
    WITH k AS (SELECT lower(city_name) AS k, min(city_id) AS city_id FROM (SELECT city_id, city_name FROM ref_city UNION ALL SELECT city_id, alias FROM ref_city WHERE alias IS NOT NULL) GROUP BY 1)
    SELECT record_id, city_id FROM business JOIN k ON lower(trim(city)) = k WHERE city NOT IN (SELECT city_name FROM ref_city)
    """,
)
def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p5_found`` whose city is a listed name or alias but for case and blanks around it."""
    ref = table(spark, sf_dir, "ref_city")
    names = ref.select(F.lower("city_name").alias("k")).unionByName(ref.select(F.lower("alias").alias("k"))).where("k IS NOT NULL").distinct()
    typed = table(spark, sf_dir, "business").select("record_id", F.lower(F.trim("city")).alias("k"))
    return p5_found(spark, sf_dir).join(typed.join(bounded_broadcast(names, 2 * REF_CITIES), "k", "left_semi"), "record_id", "left_semi")


@LLM.add("p5_unmatched")
def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cities that mean no entry of the list, with their number of rows."""
    return city_matches(spark, sf_dir).where("ref_id IS NULL").select(F.col("value").alias("city"), F.col("n").alias("n_rows"))


CAPACITY = 2048


def sized_documents(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Documents with their size in tokens, written once: sizes are used several times, texts are read once."""
    documents = table(spark, sf_dir, "documents")
    return cut_lineage(documents.select("doc_id", *columns, token_count(F.col("text"), VOCABULARY).alias("n_tokens")))


@LLM.add("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens: which part of which document lies where."""
    packed = pack(sized_documents(spark, sf_dir, []), "doc_id", "n_tokens", CAPACITY)
    return packed.withColumnRenamed("item_id", "doc_id")


@LLM.add("p8_kept", "SELECT count(*) AS n_docs, TRUE AS all_tokens, TRUE AS split_only_if_longer, TRUE AS within_capacity, TRUE AS little_room FROM documents WHERE text <> ''")
def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers hold every token of every document once, only longer texts are split, and 99 % of the room but for one container is used."""
    sized = cut_lineage(sized_documents(spark, sf_dir, []).where("n_tokens > 0"))
    packed = cut_lineage(pack(sized, "doc_id", "n_tokens", CAPACITY))
    docs = packed.groupBy(F.col("item_id").alias("doc_id")).agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("parts"))
    whole = sized.join(docs, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_docs"), F.bool_and(F.coalesce(F.col("held") == F.col("n_tokens"), F.lit(False))).alias("all_tokens"), F.bool_and((F.col("parts") == 1) | (F.col("n_tokens") > CAPACITY)).alias("split_only_if_longer")
    )
    room = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.max(F.col("at") + F.col("n_tokens")).alias("end"))
    rooms = room.agg(F.bool_and((F.col("t") <= CAPACITY) & (F.col("end") == F.col("t"))).alias("within_capacity"), (F.sum("t") >= 0.99 * CAPACITY * (F.count(F.lit(1)) - 1)).alias("little_room"))
    return whole.crossJoin(F.broadcast(rooms))


@LLM.add("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by number of parts, their tokens and the share of their room that is used."""
    packed = p8_pack(spark, sf_dir).where("container_id IS NOT NULL")
    per = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("tokens"))
    return per.groupBy("n_parts").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used_share", F.round(F.col("tokens") / F.col("containers") / CAPACITY, 6))


#: The domain of each source: a shortage of a source goes to the others of its domain before it goes to other domains.
DOMAINS = {"review_page": "opinion", "tip": "opinion", "forum": "opinion", "business_profile": "business", "owner_reply": "business", "newsletter": "business", "city_guide": "guide"}
#: Weights of the languages where they are asked for.
LANGUAGES = {"en": 0.4, "es": 0.2, "fr": 0.2, "de": 0.2}


def mixed(spark: SparkSession, sf_dir: str, total_share: float | None = None, languages: dict[str, float] | None = None) -> DataFrame:
    sized = sized_documents(spark, sf_dir, ["source", "lang"])
    total = None if total_share is None else int((sized.agg(F.sum("n_tokens")).first()[0] or 0) * total_share)
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    placed = sized.withColumn("domain", F.coalesce(names[F.col("source")], F.lit("other")))
    weights = {"lang": languages} if languages else {}
    selected = mix(placed, "doc_id", "n_tokens", ["domain", "source", "lang"], table(spark, sf_dir, "mix_target"), total=total, seed=42, level="source", weights=weights)
    return selected.withColumnRenamed("item_id", "doc_id")


@LLM.add("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix in which every source has its target share."""
    return mixed(spark, sf_dir).drop("domain")


@LLM.add("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of that mix."""
    return reached_shares(mixed(spark, sf_dir).withColumnRenamed("doc_id", "item_id"), "source", table(spark, sf_dir, "mix_target"))


@LLM.add("p9_kept", "SELECT source, TRUE AS share_reached, TRUE AS repeats_kept FROM mix_target WHERE source IN (SELECT source FROM documents WHERE text <> '')")
def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether that mix reaches each target but for one token a leaf, and uses no document too often."""
    shares = cut_lineage(p9_shares(spark, sf_dir))
    weights = shares.where("tokens > 0").agg(F.sum("target_share").alias("all"), F.sum("tokens").alias("total"))
    near = F.abs(F.col("tokens") - F.col("target_share") / F.col("all") * F.col("total")) <= 100
    return shares.where("tokens > 0").crossJoin(F.broadcast(weights)).select("source", near.alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


@LLM.add("p9_shares_full")
def p9_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix as large as the corpus, where small sources fall short and the others take over."""
    return reached_shares(mixed(spark, sf_dir, 1.0).withColumnRenamed("doc_id", "item_id"), "source", table(spark, sf_dir, "mix_target"))


@LLM.add("p9_languages")
def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sources and languages of a mix of half the corpus with weights of languages; those that run short leave the rest to the others."""
    used = mixed(spark, sf_dir, 0.5, LANGUAGES).groupBy("domain", "source", "lang", "doc_id").agg(F.sum("used_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    sums = used.groupBy("domain", "source", "lang").agg(F.sum("t").alias("tokens"), F.sum("k").alias("uses"), F.max("k").alias("most_uses"))
    total = sums.agg(F.sum("tokens").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("domain", "source", "lang", "tokens", (F.col("tokens") / F.col("all")).alias("reached_share"), "uses", "most_uses")


@LLM.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, an error page or a notice asking for scripts."""
    return residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id")


@LLM.add("p10_evidence")
def p10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lines that hold the evidence, with its kind."""
    return residue_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
