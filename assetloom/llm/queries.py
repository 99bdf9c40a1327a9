"""The queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, cover_tree, importance, jaccard_join, line_dedup, mixing, phrases, pieces, pii, prefix_counts, quality_rules, quotes, toxicity
from .common import n_words, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its compared lines, those that stay, and the line that stays for each that goes."""
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the class of near-copies it is in, its direct links, and whether it stays."""
    return jaccard_join.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message in reply order without its quotes, with the message that it answers."""
    out = quotes.linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", "position", "thread", "reply_to", "n_quoted", "n_linked", "body", quotes.formatted(F.col("role"), F.col("body")).alias("formatted"))


ORACLE["op5_quotation_linking"] = r"""
WITH RECURSIVE lined AS (
  SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations),
leveled AS (SELECT *, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level FROM lined),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS r FROM leveled),
passages AS (
  SELECT conv_id, turn, level, min(i) AS pos, trim(string_agg(regexp_replace(line, '^(?:[ \t]*>)+ ?', ''), chr(10) ORDER BY i), ' ') AS body FROM runs GROUP BY conv_id, turn, level, r),
filled AS (SELECT *, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS norm FROM passages WHERE trim(regexp_replace(body, '\s+', ' ', 'g')) <> ''),
bodies AS (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY pos) AS body FROM filled WHERE level = 0 GROUP BY conv_id, turn),
parts AS (
  SELECT conv_id, turn, norm FROM filled WHERE level = 0
  UNION SELECT conv_id, turn, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) FROM bodies
  UNION SELECT conv_id, turn, lower(trim(regexp_replace(unnest(regexp_split_to_array(body, '\n\s*\n')), '\s+', ' ', 'g'))) FROM bodies
  UNION SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(body, chr(10))), '\s+', ' ', 'g'))) FROM bodies),
originals AS (SELECT conv_id, norm, min(turn) AS first FROM parts WHERE norm <> '' GROUP BY conv_id, norm),
quoted AS (SELECT DISTINCT conv_id, turn, level, norm FROM filled WHERE level > 0),
found AS (SELECT q.*, CASE WHEN first < turn THEN first END AS first FROM quoted q LEFT JOIN originals USING (conv_id, norm)),
replies AS (SELECT conv_id, turn, count(*) AS n_quoted, count(first) AS n_linked, arg_min(first, level * 1000000000 - first) AS reply_to FROM found GROUP BY conv_id, turn),
heads AS (SELECT conv_id, turn, reply_to AS head FROM replies WHERE reply_to IS NOT NULL UNION SELECT h.conv_id, h.turn, r.reply_to FROM heads h JOIN replies r ON r.conv_id = h.conv_id AND r.turn = h.head WHERE r.reply_to IS NOT NULL),
threads AS (SELECT conv_id, turn, min(head) AS head FROM heads GROUP BY conv_id, turn),
joined AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(b.body, '') AS body, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(head, c.turn) AS thread
  FROM conversations c LEFT JOIN bodies b ON b.conv_id = c.conv_id AND b.turn = c.turn LEFT JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.turn LEFT JOIN threads t ON t.conv_id = c.conv_id AND t.turn = c.turn)
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS BIGINT) AS position, thread, reply_to, CAST(n_quoted AS BIGINT) AS n_quoted,
       CAST(n_linked AS BIGINT) AS n_linked, body, '<|' || coalesce(role, 'user') || '|>' || chr(10) || body || chr(10) AS formatted FROM joined
"""


@_query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6: links of cosine 0.98 and more within labels, and the components they make."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT reach.n, pairs.b FROM reach JOIN pairs ON pairs.a = reach.m),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT r.n AS vec_id, CAST(coalesce(max(links.n), 0) AS BIGINT) AS n_links, min(r.m) AS component_id, r.n = min(r.m) AS kept
FROM reach r LEFT JOIN links ON links.a = r.n GROUP BY r.n
"""


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10: the words that each document gives to the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("size"))
    return mixed.select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("size")).alias("taken"), F.col("mix_copies").alias("copies"),
    )


ORACLE["op10_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY none, k ORDER BY size, h, doc_id) AS r FROM docs),
per AS (
  SELECT none, k, sum(size)::DOUBLE AS source_size, CASE (row_number() OVER (ORDER BY none, k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM docs GROUP BY none, k),
ratio AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER rising, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER rising, 0)) AS level FROM ratio
  WINDOW rising AS (ORDER BY ratio, none, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT none, k, source_size, least(cap, coalesce(w * max(CASE WHEN level <= ratio THEN level END) OVER (), cap)) AS target FROM levels),
copies AS (
  SELECT doc_id, size, source_size, target, r, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS e,
         CAST('0x' || substr(md5('mix-1:' || CAST(none AS INT) || ':' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked JOIN target USING (none, k))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(floor(e * r + u) - floor(e * (r - 1) + u) AS BIGINT) * size AS taken, CAST(floor(e * r + u) - floor(e * (r - 1) + u) AS BIGINT) AS copies FROM copies
"""


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 3: measurements, failure bits and the verdict of policy v1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = quality_rules.ledger(quality_rules.measured(docs))
    base = quality_rules.passes("base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & quality_rules.passes("v1")).alias("kept"), "fail_bits")


_LEDGER = r"""
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, text FROM documents),
windows AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
measures AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS BIGINT) AS n_marks
  FROM words JOIN lined ON words.doc_id = lined.doc_id LEFT JOIN repeated ON words.doc_id = repeated.doc_id),
ledger AS (
  SELECT *, CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT)
         + 8 * CAST(10 * n_marks > n_words AS INT) + 16 * CAST(10 * n_dup_lines > 3 * n_lines AS INT)
         + 32 * CAST(word_chars < 2 * n_words AS INT) + 64 * CAST(word_chars > 20 * n_words AS INT) AS BIGINT) AS fail_bits FROM measures)
"""
ORACLE["op3_quality_rules"] = f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits FROM ledger
"""


@_query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy adds to it, from the ledger's bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.ablations(quality_rules.ledger(quality_rules.measured(docs)))


ORACLE["quality_rule_ablations"] = f"""WITH {_LEDGER},
cases AS (SELECT * FROM (VALUES
  ('base', 'few_words', 3, 1), ('base', 'repeated_words', 3, 2),
  ('v1', 'few_words', 15, 1), ('v1', 'repeated_words', 15, 2), ('v1', 'symbols', 15, 4), ('v1', 'exclamation', 15, 8),
  ('v2', 'few_words', 127, 1), ('v2', 'repeated_words', 127, 2), ('v2', 'symbols', 127, 4), ('v2', 'exclamation', 127, 8),
  ('v2', 'repeated_lines', 127, 16), ('v2', 'short_words', 127, 32), ('v2', 'long_words', 127, 64)) AS t(policy, rule, mask, bit))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_fail, count(*) FILTER (fail_bits & mask = bit) AS n_fail_alone,
       count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without
FROM ledger, cases GROUP BY policy, rule
"""


@_query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 4: number and hash of each text's ids, and the hash of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encoded(docs, keep=["doc_id"])).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7: counts and digest of the base spans, and all spans with those that the field adds; has_pii where there is any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.tagged(docs, pii.learn(docs), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_pii"))


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document from two co-trained views; kept where it is 0.5 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = cotraining.learned_and_scored(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9: a score for every document from a lexicon learned on the training rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.scored(docs, lexicon).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), toxicity.rejected(F.col("toxic_score")).alias("predicted"))


@_query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 11: each document's features, weight and score, and its rank where it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resampled(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


# Checksums are folded from the bytes of a feature over the table of 256 entries, which is derived from the polynomial.
ORACLE["op11_importance"] = r"""
WITH RECURSIVE bit AS (
  SELECT i AS b, i AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bit WHERE step < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE step = 8),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT side, row_number() OVER () AS row, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)),
bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
hits AS (SELECT side, row, bucket FROM feature JOIN bucketed USING (f)),
sums AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM hits GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM sums),
weighed AS (SELECT row, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM hits JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
doc AS (
  SELECT words.id AS doc_id, words.row, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CAST(coalesce(CASE WHEN total >= 0 THEN total // n ELSE -((-total + n - 1) // n) END, 0) AS BIGINT) AS weight,
         ('0x' || substr(sha256('7:' || words.id), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN weighed ON weighed.row = words.row WHERE side = 's'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_words >= 20 AS able FROM doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, row) AS r, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN CAST(r AS BIGINT) END AS rank FROM ranked
"""


@_query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 12: bytes and tokens of each text, and the most characters that the limit leaves of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = prefix_counts.longest_within(prefix_counts.prefixes(docs, keep=["doc_id"]), F.lit(prefix_counts.LIMIT), "chars_within")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > prefix_counts.LIMIT).alias("over_limit"), "chars_within")


@_query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 13: the best collocations of two to four words of each language."""
    return phrases.mined(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE["op13_phrases"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
f AS (SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM gram GROUP BY lang, k, g HAVING count(*) >= 30),
part AS (SELECT lang, k, f, g, unnest(range(2, k)) AS m FROM f WHERE k > 2),
inner_part AS (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(g[i : i + m - 1], ' '))) AS phrase FROM part),
around AS (SELECT lang, phrase, max(f) AS around FROM inner_part GROUP BY lang, phrase),
free AS (SELECT f.* FROM f LEFT JOIN around USING (lang, phrase) WHERE k > 1 AND (around IS NULL OR 100 * around::HUGEINT < 80 * f::HUGEINT)),
cut AS (SELECT lang, phrase, f AS a, g, k, unnest(range(1, k)) AS c FROM free),
sided AS (
  SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.g[1 : c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.g[c + 1 : cut.k], ' ')),
worst AS (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst JOIN total USING (lang) QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
