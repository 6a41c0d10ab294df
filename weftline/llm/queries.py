"""The queries op1 to op13 and pipeline, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, contamination, exact_dedup, language, licenses, manifest, mixing, near_dedup, periodic, pieces, quality, sharding, toxicity

N_SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that begins empty."""
    documents = table(spark, sf_dir, "documents")
    index = exact_dedup.fresh_index(spark, exact_dedup.buckets_for(spark, documents.count()))
    out = exact_dedup.exact_dedup(documents, index)
    index.close()
    return out


SQL["op7_exact_dedup"] = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT text_sha256, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) AS group_size
    FROM n GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: row numbers by doc_id, permuted, dealt to 40 shards."""
    documents = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = documents.select("doc_id", sharding.text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return sharding.shard(rows, order, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL["op9_sharding"] = sharding.shard_sql(N_SHARDS)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    m = F.col("matches")
    return out.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["n_hit"].alias("n_hit"),
        F.size(m["items"]).cast("bigint").alias("n_items"),
        contamination.items_digest(m["items"]).alias("items_sha256"),
        (m["n_hit"] > 0).alias("contaminated"),
        m["longest"].alias("longest"),
        m["longest_at"].alias("longest_at"),
    )


SQL["op8_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT row_number() OVER () AS n, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), ba AS (
    SELECT n, item_id, k, i AS j, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT n, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
), bw AS (
    SELECT DISTINCT item_id, k, win FROM ba
), dw AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), m AS (
    SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)
), h AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
), g AS (
    SELECT doc_id, i, n, k, i - j AS away, i - row_number() OVER (PARTITION BY doc_id, n, i - j ORDER BY i) AS run FROM dw JOIN ba USING (k, win)
), e AS (
    SELECT doc_id, max(size) AS longest, min(place) FILTER (size = most) AS longest_at
    FROM (SELECT *, max(size) OVER (PARTITION BY doc_id) AS most FROM (SELECT doc_id, count(*) + any_value(k) - 1 AS size, min(i) - 1 AS place FROM g GROUP BY doc_id, n, away, run))
    GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(longest, 0) AS longest, longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.*")


SQL["op3_license_scan"] = licenses.scan_sql()


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.format_chats(table(spark, sf_dir, "conversations").select(columns).unionByName(own)))


SQL["op5_chat_format"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), r AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           length(regexp_replace(text, '(\\|</?s>|\[/?(?:INST|SYS|ROLE))', '\\\1', 'g')) + CASE role
               WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5
               ELSE 16 + length(regexp_replace(role, '([\\\[\]<])', '\\\1', 'g')) END AS width
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
    SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM r
), g AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
           CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, raked to smoothed shares of source, language and topic."""
    out = mixing.mix(mixing.described(table(spark, sf_dir, "documents")))
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


SQL["op10_mixing"] = rf"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
    FROM documents
), v AS (
    SELECT word FROM (SELECT unnest(list_distinct(w)) AS word FROM d) WHERE strlen(word) BETWEEN {mixing.SHORTEST} AND {mixing.LONGEST}
    GROUP BY word HAVING count(*) * {mixing.RARER} <= (SELECT count(*) FROM d) ORDER BY count(*) DESC, word LIMIT {mixing.TOPICS}
), o AS (
    SELECT row, first(word ORDER BY n DESC, word) AS topic FROM (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) JOIN v USING (word) GROUP BY ALL) GROUP BY row
), r AS (
    SELECT doc_id, source, lang, coalesce(topic, '(none)') AS topic, tokens FROM d LEFT JOIN o USING (row)
), c AS (
    SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL
), t AS (
    SELECT *, pow(s, {mixing.ALPHA["source"]}) AS s_to, pow(l, {mixing.ALPHA["lang"]}) AS l_to, pow(o, {mixing.ALPHA["topic"]}) AS o_to
    FROM (SELECT *, sum(tokens) OVER (PARTITION BY source) AS s, sum(tokens) OVER (PARTITION BY lang) AS l, sum(tokens) OVER (PARTITION BY topic) AS o FROM c)
), u AS (
    SELECT source, lang, topic, tokens, s_to / (SELECT sum(DISTINCT_s) FROM (SELECT any_value(s_to) AS DISTINCT_s FROM t GROUP BY source)) AS s_to,
           l_to / (SELECT sum(x) FROM (SELECT any_value(l_to) AS x FROM t GROUP BY lang)) AS l_to,
           o_to / (SELECT sum(x) FROM (SELECT any_value(o_to) AS x FROM t GROUP BY topic)) AS o_to
    FROM t
), k AS (
    SELECT 0 AS n, *, tokens / sum(tokens) OVER () AS w FROM u
    UNION ALL
    SELECT n + 1, source, lang, topic, tokens, s_to, l_to, o_to, w * o_to / sum(w) OVER (PARTITION BY topic) AS w FROM (
        SELECT * REPLACE (w * l_to / sum(w) OVER (PARTITION BY lang) AS w) FROM (
            SELECT * REPLACE (w * s_to / sum(w) OVER (PARTITION BY source) AS w) FROM k WHERE n < {mixing.ROUNDS}))
), q AS (
    SELECT source, lang, topic, tokens, w * sum(tokens) OVER () / tokens AS weight FROM k WHERE n = {mixing.ROUNDS} AND tokens > 0
), f AS (
    SELECT *, ({mixing.SAMPLE_SHARE} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight * tokens) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
    FROM q
), b AS (
    SELECT max_by(c, weight) AS c FROM f WHERE c * weight <= 1
), p AS (
    SELECT source, lang, topic, weight, least(1.0, coalesce(b.c, 'inf'::DOUBLE) * weight) AS probability FROM q, b
)
SELECT doc_id, source, lang, topic, tokens, round(coalesce(weight, 0.0), 9) AS weight, round(coalesce(probability, 1.0), 9) AS probability,
       ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT / pow(16, 13) < coalesce(probability, 1.0) AS kept
FROM r LEFT JOIN p USING (source, lang, topic)
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against each other."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


SQL["op2_near_dedup"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
    SELECT DISTINCT a AS root, a AS node FROM l
    UNION
    SELECT root, b FROM r JOIN l ON l.a = r.node
), m AS (
    SELECT node, min(root) AS low FROM r GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from the labels of those that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from the labels of those that are not held out."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten with a periodic end."""
    documents = table(spark, sf_dir, "documents")
    return periodic.summary(periodic.periodic_runs(documents.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))))


SQL["op11_periodic_runs"] = periodic.runs_sql()


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded with an end id, and decoded."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return pieces.digests(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; half of them, by crc32 of the id, tampered with by deleting line ends."""
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
    out = manifest.manifest(table(spark, sf_dir, "documents"), tampered)
    folded = manifest.fold(F.coalesce("altered", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op13_merkle_manifest"] = manifest.manifest_sql()
