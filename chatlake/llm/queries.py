"""The registered queries of this subpackage: thin contracts over the operators, with their DuckDB SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, divergence, minhash, mixing, pii, quality, topk, warc, whitening
from chatlake.llm import chat_format as cf
from chatlake.llm import suffix_dedup as sd
from chatlake.llm import toxicity as tox
from chatlake.llm import exact_dedup as xd
from chatlake.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return xd.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def bpe_path() -> str:
    """The public vocabulary file; its path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path(), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = warc.archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return seen.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "response.refers_to")


SQL["op3_warc_captures"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
             min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""


@query
def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed = mixing.assign(docs)
    placed = placed.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")
    return placed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op6_curriculum_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
             [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i, sum(source_size) OVER () AS total,
             sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST) - cap AS before,
             sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST) AS rest FROM s),
l AS (SELECT *, (total - before) / rest AS level FROM o),
f AS (SELECT min(i) AS i, min_by(level, i) AS level FROM l WHERE cap > level * weight),
t AS (SELECT l.source, l.source_size, CASE WHEN f.i IS NULL OR l.i < f.i THEN l.cap ELSE f.level * l.weight END AS target FROM l, f),
m AS (SELECT doc_id, size, t.source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) - size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * ((middle < target)::INT + (middle + source_size < target)::INT + (middle + 2 * source_size < target)::INT) AS BIGINT) AS taken
FROM m
"""


@query
def op7_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


SQL["op7_norm_sorted_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.unionByName(extra).select("conv_id", "turn", "role", cf.text_parts(F.col("text")).alias("parts"))
    pieces = cf.format_pieces(rows)
    turns = F.transform(cf.read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = pieces.select("conv", "piece", F.size(cf.read_turns(F.col("text"))).cast("long").alias("turns"),
                         F.array_join(turns, "").alias("all"), F.array_join(cf.read_loss(F.col("text"), F.col("loss")), "").alias("loss"),
                         F.char_length("text").cast("long").alias("chars"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", c))), lambda p: p[c]), "")
    chats = read.groupBy("conv").agg(F.sum("turns").alias("n_turns"), joined("all").alias("all"), joined("loss").alias("loss"),
                                     F.sum("chars").alias("formatted_chars"))
    return chats.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2("all", 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL["op5_chat_parts"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, length('<turn><body><text></turn>') + sum_len AS chars FROM (SELECT *, (SELECT
        length(regexp_replace(role, p, '\1\\\2\3', 'g')) + length(regexp_replace(text, p, '\1\\\2\3', 'g')) FROM
        (SELECT '([<\[])(\\*)(/?turn>|body>|(?:text|image|audio|document|part)>|/?s>|/?INST\])' AS p)) AS sum_len FROM c)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sd.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def held_out(col) -> Column:
    """The fold that learns nothing: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tox.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return tox.train(docs, labels, ~held_out(F.col("id")))


@query
def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tox.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def quality_held_out(col) -> Column:
    """The fold that learns nothing: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels, ~quality_held_out(F.col("id"))))
    return scored.select("doc_id", quality_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL["op13_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS i FROM documents),
t AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, total, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS size
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, f.n, 1 + (1000000000::HUGEINT * (f.n + 2)) // (size + 2 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (total + 2)) // (v.n + 2 * v)::HUGEINT AS q FROM f JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
