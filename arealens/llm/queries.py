"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.quality import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("text_hash")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.pieces import sentencepiece_round_trip

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_round_trip(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.line_dedup import dedup_lines

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "removed", F.sha2("text", 256).alias("text_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.ngram_join import ngram_components

    return ngram_components(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.mixing import mix_sources

    mixed = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.array_min(F.transform("draws", lambda d: F.struct(d["shard"], d["place"], d["at"])))  # where the first part stands in the mix
    mixed = mixed.withColumn("_first", first)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_parts"), *[F.col(f"_first.{c}").alias(f"first_{c}") for c in ("shard", "place", "at")])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.sharding import shuffle_to_shards

    placed = shuffle_to_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.token_files import token_file_digests

    digests = token_file_digests(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return digests.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.ann import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.langid import held_out, learn, predict

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = learn(docs.where("not held_out"))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.revisit import captures, resolve_revisits

    resolved = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    shown = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.select("record_id", "kind", "canonical", "status", "refers_to", F.array_join(shown, ";").alias("headers"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.simhash import simhash_components

    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.align import align_tokenizers

    return align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arealens.llm.lexical import lexical_search

    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_sharding": op2_sharding,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_simhash": op11_simhash,
    "op12_token_alignment": op12_token_alignment,
    "op13_lexical_search": op13_lexical_search,
}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op13_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
        corpus AS (SELECT count(*) AS n_docs, sum(len(w)) AS length FROM d WHERE len(w) > 0),
        tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY row, doc_id, n, t),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
        s AS (SELECT item_id, row, doc_id, sum(cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // length))))) AS score
            FROM q JOIN tf USING (t) JOIN df USING (t), corpus GROUP BY item_id, row, doc_id)
        SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, cast(score AS bigint) AS score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
