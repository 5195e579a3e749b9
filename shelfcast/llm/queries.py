"""Registered queries of the numbered operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm import (
    bpe,
    chat,
    exact_dedup,
    hashing_index,
    language_id,
    license_scan,
    merkle,
    mixing,
    near_dedup,
    oracles,
    quality,
    turn_repair,
    url_filter,
    warc,
)
from shelfcast.operators.joins import null_safe_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> str:
    """Where the public byte-level vocabulary is installed; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, s AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents) d
WINDOW g AS (PARTITION BY s)"""
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_exact_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS f FROM p),
b AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(letters, 1 + CAST(
           (CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '')
           AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM m, b"""
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


@query()
def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mix_sources(docs, target_entropy=0.95, repetition_limit=4.0)
    return mix.select("doc_id", "source", "mix_pass", "mix_block", "mix_position")


@query()
def op6_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, byte_vocabulary())
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: fifty documents make a directory below a source, and the first of them is
    its licence file, or that of the directory above for every thousandth document."""
    doc_id = F.col("doc_id")
    top = F.concat(F.col("source"), F.lit("/"), F.floor(doc_id / 1000))
    leaf = F.concat(top, F.lit("/"), F.floor(doc_id / 50))
    path = F.when(doc_id % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(doc_id % 50 == 0, F.concat(leaf, F.lit("/LICENSE")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(path, F.concat(leaf, F.lit("/"), doc_id, F.lit(".txt"))).alias("path"), "text")
    found = license_scan.scan_licences(files, windows=True)
    return found.select("doc_id", "path", "licence", F.round("licence_score", 6).alias("licence_score"), "licence_line", "licence_from", "licence_dir")


@query(
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '\\\1\2', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
                ELSE length(role) + 21 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = rows.withColumn("node", F.row_number().over(order)).withColumns(
        {"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(1.0)}
    )
    formatted = chat.format_paths(chat.best_paths(tree))
    read = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.parsed(F.col("formatted")).alias("turns"),
        chat.unescaped_spans(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit_model(docs.where(~out))
    found = language_id.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# categories that public blocklists have, as they name hosts
LISTED_HOSTS = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."


@query(
    r"""
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=&]*|gclid|fbclid|msclkid|ref)(=|$)'))) AS q
  FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^.*@', ''), '^www\.|:(80|443)?$', '', 'g')
         || regexp_replace(path, '/$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS k
  FROM u),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c),
l AS (
  SELECT DISTINCT k FROM c
  WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN k IN (SELECT k FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no blocklist; the URLs of pages on hosts named after blocked categories serve as one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(oracles.manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = merkle.manifest(
        docs,
        changed={"text": F.translate("text", url_filter.UPPER, url_filter.LOWER)},
        where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
    )
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of their rows, by crc32 of conversation and turn."""
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), draw.alias("draw")
    ).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


@query(oracles.repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract has one text of a whole conversation hashed, so the repaired turns of one meet there."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, repaired = turn_repair.repair(damaged(rows))
    turns = F.sort_array(F.collect_list(F.struct("seg", "idx", "role", "text")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    texts = repaired.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.sha2(whole.cast("binary"), 256).alias("repaired_sha256"))
    every = rows.select("conv_id").distinct()
    found = null_safe_join(null_safe_join(every, summary, ["conv_id"]), texts, ["conv_id"])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
