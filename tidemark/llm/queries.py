"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, jaccard_join, lm_score, mixing, quality_mil, quality_rules, token_lengths, token_store, tokens, warc
from tidemark.llm.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: exponents for source, language and kind of text, and the share of all tokens to keep; SQL has no loop that ends by itself, so it takes
#: many more rounds than it takes to meet the targets
MIX_TARGETS, MIX_KEEP, MIX_ROUNDS = (0.5, 0.7, 0.5), 0.5, 400


def mix_dims() -> list:
    return [F.col("source"), F.col("lang"), mixing.style("text")]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mix_dims(), MIX_TARGETS, keep=MIX_KEEP)
    return out.select(
        "doc_id", "source", "lang", F.col("mix_2").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 8).alias("probability"), F.col("mix_sampled").alias("sampled"),
    )


def _op1_sql() -> str:
    dims = ("source", "lang", "topic")
    step = " ".join(f"WHEN {k} THEN CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0.0 END" for k, d in enumerate(dims))
    goals = ", ".join(f"{d}_t AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(CAST(sum(tokens) AS DOUBLE), {e}) ELSE 0.0 END AS s FROM cells GROUP BY 1), {d}_g AS (SELECT {d}, s / sum(s) OVER () * total AS goal_{d} FROM {d}_t, sums)" for d, e in zip(dims, MIX_TARGETS))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'notice' WHEN contains(lower(text), 'license') THEN 'licensed' WHEN length(coalesce(text, '')) < 600 THEN 'short' ELSE 'prose' END AS topic FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL), sums AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM cells), {goals},
w AS (SELECT 0 AS step, source, lang, topic, CAST(tokens AS DOUBLE) AS tokens, CAST(tokens AS DOUBLE) AS weight, goal_source, goal_lang, goal_topic FROM cells JOIN source_g USING (source) JOIN lang_g USING (lang) JOIN topic_g USING (topic)
  UNION ALL SELECT step + 1, source, lang, topic, tokens, CASE step % 3 {step} END, goal_source, goal_lang, goal_topic FROM w WHERE step < {3 * MIX_ROUNDS}),
r AS (SELECT *, tokens / weight AS ratio, sum(weight) OVER () AS w_all, coalesce(sum(tokens) OVER b, 0) AS t_before, coalesce(sum(weight) OVER b, 0) AS w_before FROM w WHERE step = {3 * MIX_ROUNDS} AND weight > 0
  WINDOW b AS (ORDER BY tokens / weight, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT r.*, total * {MIX_KEEP} AS budget, t_before + ratio * (w_all - w_before) <= total * {MIX_KEEP} AS is_full FROM r, sums),
p AS (SELECT source, lang, topic, CASE WHEN is_full THEN 1.0 ELSE least(1.0, (budget - coalesce(sum(CASE WHEN is_full THEN tokens END) OVER (), 0)) / (w_all - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0)) / ratio) END AS p FROM f)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(CAST(coalesce(p, 0) AS DOUBLE), 8) AS probability,
  CAST(CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < coalesce(p, 0) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)
"""


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = token_store.store(table(spark, sf_dir, "documents"), tokens.default_path())
    return token_store.checksums(rows)


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.by_limit(token_lengths.lengths(table(spark, sf_dir, "documents"), tokens.default_path()))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    formatted = stored(chat.render(rows.unionByName(own)), "chats")
    return chat.read_back(formatted)


def _op3_sql() -> str:
    escaped = " + ".join(["2 * length(t) - length(replace(t, chr(92), ''))", *(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)])
    added = " ".join(f"WHEN '{r}' THEN {len(chat.inst_template([{'role': r, 'text': ''}]))}" for r in ("user", "assistant", "system"))
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({escaped} + CASE role {added} ELSE 11 + length(role) END) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewritten_at
FROM c GROUP BY conv_id
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: the same model by joins with the counts of all words, pairs and triples; DuckDB has no crc32, so it's computed bit by bit
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(coalesce(ascii(x), 0) AS BIGINT))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, y: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384::BIGINT) ELSE z // 2 END)), 4294967295::BIGINT) % 10 = 0 AS held_out,
  list_concat(['<'], list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), lambda x: 'w' || x), ['>']) AS l FROM documents),
u AS MATERIALIZED (SELECT r, doc_id, held_out, i, l[i] AS c, CASE WHEN i > 1 THEN l[i - 1] END AS b, CASE WHEN i > 2 THEN l[i - 2] END AS a FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
t AS (SELECT * FROM u WHERE NOT held_out),
one AS MATERIALIZED (SELECT c, count(*) AS n FROM t GROUP BY ALL), two AS MATERIALIZED (SELECT b, c, count(*) AS n FROM t WHERE i > 1 GROUP BY ALL), three AS (SELECT a, b, c, count(*) AS n FROM t WHERE i > 2 GROUP BY ALL),
k AS (SELECT coalesce(sum(n), 0) AS n, count(*) AS v FROM one WHERE c <> '<'),
p AS (SELECT u.r, u.doc_id, u.held_out, u.i, coalesce(o.n, 0) AS known, CAST(k.n AS BIGINT) AS train_tokens, (coalesce(o.n, 0) + {lm_score.FLOOR}) / (k.n + {lm_score.FLOOR} * (k.v + 1)) AS p0, coalesce(h.n, 0) AS nb, coalesce(w.n, 0) AS nbc, coalesce(g.n, 0) AS nab, coalesce(e.n, 0) AS nabc
  FROM u CROSS JOIN k LEFT JOIN one o ON o.c = u.c LEFT JOIN one h ON h.c = u.b LEFT JOIN two w ON w.b = u.b AND w.c = u.c LEFT JOIN two g ON g.b = u.a AND g.c = u.b LEFT JOIN three e ON e.a = u.a AND e.b = u.b AND e.c = u.c WHERE u.i > 1),
q AS (SELECT *, (nbc + {lm_score.STRENGTH} * p0) / (nb + {lm_score.STRENGTH}) AS p1 FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known > 0) AS n_known, train_tokens, round(sum(log10(p0)), 6) AS base_score,
  round(sum(log10(CASE WHEN i > 2 THEN (nabc + {lm_score.STRENGTH} * p1) / (nab + {lm_score.STRENGTH}) ELSE p1 END)), 6) AS score
FROM q GROUP BY r, doc_id, held_out, train_tokens
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND m < page_id THEN m END AS refers_to FROM f
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_key").alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


#: lengths of windows are those of the benchmark's items, ten at most
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (decontaminate.n_hit() > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_mix_sources": op1_mix_sources, "op2_token_store": op2_token_store, "op3_chat_format": op3_chat_format, "op4_lm_score": op4_lm_score, "op5_warc": op5_warc, "op6_jaccard_join": op6_jaccard_join, "op7_token_lengths": op7_token_lengths, "op8_quality_mil": op8_quality_mil, "op9_decontaminate": op9_decontaminate, "op10_quality_rules": op10_quality_rules}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _op1_sql(), "op3_chat_format": _op3_sql(), "op4_lm_score": OP4_SQL, "op5_warc": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op9_decontaminate": OP9_SQL}
