"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    ann,
    centroids,
    chat,
    html,
    language,
    mixing,
    neardup,
    packing,
    quality,
    repair,
    scoring,
    sharding,
    wavelet,
)
from tablewright.llm.common import count_words, stored, tokenizer_file
from tablewright.plans.registry import table
from tablewright.session import scratch_path

N_SHARDS = 8
END_ID = 1


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    columns = "conv_id long, turn long, role string, text string"
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], columns)
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes = chat.chains(conversations.unionByName(extra), "conv_id", "turn", "role", "text")
    formatted = chat.format_branches(nodes)
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        "formatted",
    )
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]))', '\1\\\2', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]))', '\1\\\2', 'g') AS t
  FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         3 + sum(length(r) + length(t) + 17) AS formatted_chars
  FROM escaped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "verdict.base_failed",
        "verdict.kept",
    )


OP2_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(list) AS w, generate_subscripts(list, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM texts)),
windows AS (
  SELECT r, i, w AS a, lead(w) OVER (PARTITION BY r ORDER BY i) AS b,
         lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS c
  FROM words),
repeated AS (
  SELECT r, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, i AS p FROM repeated UNION ALL SELECT r, i + 1 FROM repeated UNION ALL SELECT r, i + 2 FROM repeated)
  GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT r, count(*) AS n, sum(length(w)) AS chars,
         count(DISTINCT w) FILTER (WHERE w IN ({", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))})) AS stop
  FROM words GROUP BY r),
m AS (
  SELECT doc_id, coalesce(counted.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
         len(regexp_extract_all(text, '[!?]')) AS n_marks, coalesce(stop, 0) AS n_stop
  FROM texts LEFT JOIN counted USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.1 * n_words AND n_capitals <= 0.5 * word_chars
       AND n_marks <= 0.5 * n_words AND word_chars >= 1.5 * n_words AND word_chars <= 30 * n_words
       AND n_stop >= 1 AND n_dup_lines <= 0.5 * n_lines AS kept
FROM base
"""


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet matrices and read back."""
    path = scratch_path(spark, "token-shards")
    wavelet.write_token_shards(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        "doc_id",
        "text",
        tokenizer_file("word_bpe_49k.json"),
        END_ID,
        path,
    )
    return wavelet.read_token_shards(spark, path)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), END_ID)


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    samples = language.learn(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), samples)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in training order."""
    docs = table(spark, sf_dir, "documents")
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    rows = stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), digest.alias("order")), "sizes")
    placed = mixing.place(rows)
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position", "order").orderBy("position", "order").drop("order")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE (-0.5)::DOUBLE END AS tilt
  FROM sources),
levels AS (
  SELECT CAST((SELECT sum(source_size) FROM sources) - (SELECT coalesce(sum(y.cap), 0) FROM weighed y
                WHERE y.cap::DOUBLE / y.weight < x.cap::DOUBLE / x.weight) AS DOUBLE)
         / (SELECT sum(y.weight) FROM weighed y WHERE y.cap::DOUBLE / y.weight >= x.cap::DOUBLE / x.weight) AS level,
         x.cap::DOUBLE / x.weight AS top
  FROM weighed x),
level AS (SELECT level FROM levels WHERE level <= top ORDER BY top LIMIT 1),
targets AS (
  SELECT source, source_size, tilt, least(cap::DOUBLE, level * weight) AS target,
         CAST(floor(least(cap::DOUBLE, level * weight) + 0.5) AS BIGINT) AS goal
  FROM weighed, level),
placed AS (
  SELECT doc_id, size, source_size, target, goal, tilt,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY digest, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
taken AS (
  SELECT *, CAST(least(greatest(goal - start, 0), size) + least(greatest(goal - source_size - start, 0), size)
            + least(greatest(goal - 2 * source_size - start, 0), size) AS BIGINT) AS taken,
         (CAST(start AS DOUBLE) + CAST(least(size, goal - start) AS DOUBLE) / 2) / goal AS share
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN 2 * share / (1 + tilt + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, 0)))
       END AS position
FROM taken
"""


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document over eight shards of one weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_key(docs, "doc_id", "text", [1.0] * N_SHARDS)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood under counts and under the recurrent model."""
    documents = table(spark, sf_dir, "documents")
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents.select("doc_id", (checksum % 7 == 2).alias("held_out"), "text")
    found = scoring.score(docs, "text", ~F.col("held_out"))
    return found.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated and given to the user, by a checksum of their key."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    ).where("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, pieces = repair.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    digest = repair.digests(pieces).withColumnRenamed("conv", "digest_conv")
    found = every.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    found = found.join(digest, F.col("conv_id").eqNullSafe(F.col("digest_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP12_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
summed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS damage
  FROM source),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM summed WHERE damage <> 0),
ordered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair
  FROM ordered),
counted AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv),
inserts(state, after, audit, lines) AS (
  VALUES ('', '', '', []::VARCHAR[]), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']),
         ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']),
         ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('u', 'u', 'II', ['assistant:', 'user:']),
         ('a', 'a', '', []), ('a', 'u', 'I', ['user:']), ('a', 'a', 'II', ['user:', 'assistant:'])),
paths AS (
  SELECT conv, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best
  FROM counted
  UNION ALL
  SELECT conv, i, state, min(best) AS best FROM (
    SELECT conv, i, o.state AS state,
           {'cost': cost + o.cost, 'audit': audit || o.audit,
            'lines': CASE WHEN o.line IS NULL THEN lines ELSE list_append(lines, o.line) END} AS best
    FROM (
      SELECT p.conv, r.i, r.role, r.text, r.fault, t.after,
             p.best.cost + 2 * length(t.audit) AS cost, p.best.audit || t.audit AS audit,
             list_concat(p.best.lines, t.lines) AS lines,
             CASE WHEN t.after = 'u' THEN 'assistant' ELSE 'user' END AS next_role
      FROM paths p JOIN inserts t ON t.state = p.state JOIN judged r ON r.conv = p.conv AND r.i = p.i + 1) s,
      LATERAL (SELECT unnest([
        {'state': after, 'cost': 3::BIGINT, 'audit': 'D', 'line': NULL::VARCHAR, 'ok': true},
        {'state': next_role[1:1], 'cost': 2::BIGINT + (fault = 't')::BIGINT, 'audit': 'R',
         'line': next_role || ':' || text, 'ok': fault NOT IN ('b', 'd')},
        {'state': role[1:1], 'cost': (fault = 't')::BIGINT, 'audit': 'K', 'line': role || ':' || text,
         'ok': fault NOT IN ('b', 'd') AND (role[1:1] = next_role[1:1] OR (role[1:1] = 's' AND after = ''))}]) AS o) e
    WHERE o.ok) GROUP BY conv, i, state),
ends AS (
  SELECT p.conv, min({'cost': p.best.cost + 2 * length(t.audit), 'audit': p.best.audit || t.audit,
                      'lines': list_concat(p.best.lines, t.lines)}) AS best
  FROM paths p JOIN counted c ON c.conv = p.conv AND c.n = p.i JOIN inserts t ON t.state = p.state
  WHERE t.after IN ('', 'a') GROUP BY p.conv)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counted c ON c.conv = coalesce(CAST(e.conv_id AS VARCHAR), 'null')
LEFT JOIN ends ON ends.conv = c.conv
"""


CENTROIDS, DIMENSIONS, ROUNDS, SALT = 40, 64, 5, "2:"


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, "vec_id", "embedding", CENTROIDS, DIMENSIONS, ROUNDS, SALT)


def _op13_sql() -> str:
    """Plain distances to every centroid; one pair of tables per round."""
    parts = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
ranked AS (
  SELECT p, row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')), p) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, p FROM ranked WHERE c < {CENTROIDS})"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(k.p) AS p, min({{'d': CAST(list_sum(list_transform(list_zip(k.p, c{n}.p),
         lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}}) AS best
  FROM kept k, c{n} GROUP BY r)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""s{n} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n
  FROM (SELECT best.c AS c, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN m{n} USING (c))"""
            )
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.p, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} f ON f.c = best.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_shards": op3_token_shards,
    "op4_pack": op4_pack,
    "op5_language": op5_language,
    "op6_mix_sources": op6_mix_sources,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_shards": op8_shards,
    "op9_html_text": op9_html_text,
    "op10_nearest": op10_nearest,
    "op11_score": op11_score,
    "op12_repair": op12_repair,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op6_mix_sources": OP6_SQL,
    "op12_repair": OP12_SQL,
    "op13_centroids": _op13_sql(),
}
