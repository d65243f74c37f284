"""The registered query of each operator: its contract's columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, maxscore, mixing, pii, quality, sharding, simhash, substrings, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The mix: web-like sources (numbers divisible by 4) count double, English and French over German and Spanish.
DOMAINS = ("web", "books", "code", "news")
MIX_WEIGHTS = {("web",): 4, ("books",): 3, ("code",): 1, ("news",): 2} | {(d, x): w for d in DOMAINS for x, w in (("en", 4), ("fr", 2), ("de", 2), ("es", 1))}
MIX_RATIO, MIX_EPOCHS, MIX_SEED = 0.5, 2, 17
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def domain_of(source: Column) -> Column:
    """The synthetic corpus has no domains; a source's number, modulo 4, stands for one."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 4 + 1).cast("int"))


def op1_mixing_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_RATIO, MIX_EPOCHS, MIX_SEED, domain_of(F.col("source")))
    return mixed.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_sharding_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op6_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")


QUERIES = {
    "op1_mixing_budgets": op1_mixing_budgets,
    "op2_quality_discriminant": op2_quality_discriminant,
    "op3_pretoken_counts": op3_pretoken_counts,
    "op4_maxscore": op4_maxscore,
    "op5_sharding_permutation_table": op5_sharding_permutation_table,
    "op6_fm_index_substrings": op6_fm_index_substrings,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_prefix_decontamination": op8_prefix_decontamination,
    "op9_line_suffix_array": op9_line_suffix_array,
    "op10_pii_weak_supervision": op10_pii_weak_supervision,
}


def _mix_levels() -> str:
    """One level of the tree after the other: capacities, weights and shares as in mixing.fill."""
    weight = lambda k, names: " ".join(["CASE", *(f"WHEN {' AND '.join(f'{n} = {chr(39)}{v}{chr(39)}' for n, v in zip(names, p, strict=True))} THEN {w}" for p, w in MIX_WEIGHTS.items() if len(p) == k + 1), "WHEN true THEN 1 END"])
    out, above = [], None
    for k in range(3):
        names = list(mixing.LEVELS[: k + 1])
        by, family = ", ".join(names), f"PARTITION BY {', '.join(names[:-1])}" if k else ""
        goal = f"(SELECT CAST(sum(tokens) * {MIX_RATIO} AS BIGINT) FROM leaves)" if above is None else "b.share"
        join = "" if above is None else f" JOIN level{k - 1} b USING ({', '.join(names[:-1])})"
        out.append(f"""
nodes{k} AS (SELECT {', '.join('n.' + x for x in names)}, n.capacity, n.weight, {goal} AS budget FROM (
  SELECT {by}, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS capacity, {weight(k, names)} AS weight FROM leaves WHERE tokens > 0 GROUP BY ALL) n{join}),
ordered{k} AS (SELECT *, budget - (sum(capacity) OVER ahead - capacity) AS remains, sum(weight) OVER ({family}) - sum(weight) OVER ahead + weight AS beside
  FROM nodes{k} WINDOW ahead AS ({family} ORDER BY capacity::DOUBLE / weight, {names[-1]} ROWS UNBOUNDED PRECEDING)),
level{k} AS (SELECT {by}, capacity, CAST(greatest(0, least(capacity, floor(max(remains::DOUBLE / beside) OVER ({family}) * weight))) AS BIGINT) AS share FROM ordered{k})""")
        above = k
    return ",".join(out)


ORACLE_OP1 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    (['web', 'books', 'code', 'news'])[coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4 + 1] AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),
{_mix_levels()},
goals AS (SELECT domain, lang, source, share // tokens AS whole, share - share // tokens * tokens AS rest FROM level2 JOIN leaves USING (domain, lang, source)),
epochs AS (SELECT docs.*, whole, rest, e.epoch,
    CAST('0x' || substr(md5('{MIX_SEED}:' || e.epoch || ':' || doc_id), 1, 15) AS BIGINT) AS key
  FROM docs JOIN goals USING (domain, lang, source), (SELECT unnest(range({MIX_EPOCHS + 1})) AS epoch) e WHERE e.epoch <= whole),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM epochs)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM summed WHERE epoch < whole OR (rest > 0 AND upto <= rest)
"""

ORACLE_OP5 = f"""
SELECT doc_id, slot, ({sharding.lookup_table(SHARDS)})[slot + 1] AS shard FROM (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
"""

ORACLE_OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.vector[i] * c.vector[i] FOR i IN range(1, len(q.vector) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

ORACLE_OP9 = f"""
WITH lines AS (
  SELECT doc_id, pos, line, replace(line, ' ', '') = '' AS blank
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
numbered AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM lines WHERE NOT blank),
windows AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM numbered),
later AS (
  SELECT doc_id, i, 2 AS size, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS copy FROM windows WHERE b IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM numbered
  WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {linededup.MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (SELECT unnest([0, 1]) AS d) WHERE copy > 1 AND d < size),
kept AS (
  SELECT l.doc_id, l.pos, l.line, g.i IS NOT NULL AS cut
  FROM lines l LEFT JOIN numbered n ON l.doc_id = n.doc_id AND l.pos = n.pos LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE cut) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

ORACLE_OP6 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT row, unnest(range(1, greatest(len(words) - {substrings.WINDOW - 2}, 1))) AS i,
    unnest([md5(array_to_string(words[j:j + {substrings.WINDOW - 1}], ' ')) FOR j IN range(1, greatest(len(words) - {substrings.WINDOW - 2}, 1))]) AS w FROM docs),
often AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
gone AS (SELECT row, list(i ORDER BY i) AS starts FROM often GROUP BY row),
marked AS (
  SELECT doc_id, words, coalesce(starts, []) AS starts FROM docs LEFT JOIN gone USING (row)),
edges AS (SELECT doc_id, words, row_number() OVER () AS row, starts FROM marked),
spots AS (SELECT row, i, sum(d) AS d FROM (SELECT row, unnest(starts) AS i, 1 AS d FROM edges UNION ALL SELECT row, unnest(starts) + {substrings.WINDOW}, -1 FROM edges) GROUP BY ALL),
each AS (SELECT doc_id, row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM edges),
open AS (SELECT e.*, coalesce(sum(s.d) OVER (PARTITION BY e.row ORDER BY e.i), 0) AS open FROM each e LEFT JOIN spots s ON e.row = s.row AND e.i = s.i),
summed AS (SELECT row, count(*) AS n_words, count(*) FILTER (WHERE open > 0) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE open = 0) AS kept FROM open GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM edges LEFT JOIN summed USING (row)
"""

ORACLE_OP8 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
owners AS (
  SELECT DISTINCT item_id, least(len(words), {decontaminate.WINDOW}) AS m, unnest([array_to_string(words[j:j + {decontaminate.WINDOW - 1}], ' ') FOR j IN range(1, greatest(len(words) - {decontaminate.WINDOW - 2}, 2))]) AS w FROM items WHERE len(words) > 0),
sizes AS (SELECT DISTINCT m FROM owners),
hits AS (
  SELECT row, i, m, w FROM (
    SELECT row, m, unnest(range(1, greatest(len(words) - m + 2, 1))) AS i, unnest([array_to_string(words[j:j + m - 1], ' ') FOR j IN range(1, greatest(len(words) - m + 2, 1))]) AS w FROM docs, sizes)
  WHERE w IN (SELECT w FROM owners)),
words AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS k FROM hits) GROUP BY row),
found AS (SELECT row, list(DISTINCT item_id ORDER BY item_id) AS ids FROM hits JOIN owners USING (w) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (row) LEFT JOIN found USING (row)
"""

#: Queries that SQL can't express over whole tables have none; tests/llm holds them against brute force.
ORACLES = {
    "op1_mixing_budgets": ORACLE_OP1,
    "op4_maxscore": ORACLE_OP4,
    "op5_sharding_permutation_table": ORACLE_OP5,
    "op6_fm_index_substrings": ORACLE_OP6,
    "op8_prefix_decontamination": ORACLE_OP8,
    "op9_line_suffix_array": ORACLE_OP9,
}
