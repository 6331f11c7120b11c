"""The text operators as queries over the given tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    html_text,
    language_model,
    near_dedup,
    packing,
    repeats,
    secret_scan,
    toxicity,
    url_filter,
    vector_links,
)
from fleetgauge.llm.shared import LOWER, UPPER, crc_mod, reachable

#: The rules of ``op2_url_filter``.
URL_RULES = (
    url_filter.rule("allow", "com/"),
    url_filter.rule("block", "example.com/en/"),
    url_filter.rule("allow", "www.example.com/en/"),
    url_filter.rule("block", "net/es/"),
    url_filter.rule("block", "net/fr/"),
)

#: Documents with this remainder of crc32(doc_id) by 3 are held out of the toxicity model.
TOXICITY_HELD_OUT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Place of the tokenizer file, which is not part of this package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def toxicity_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    """The labels, and which of them the model may learn."""
    return table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != TOXICITY_HELD_OUT


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels, learned = toxicity_labels(spark, sf_dir)
    scored = toxicity.with_score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, learned))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == TOXICITY_HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secret_scan.BASE]

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        _digest(joined(F.filter("spans", lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    model = language_model.fit(docs, ~held_out)
    return language_model.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.known.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        _digest(F.array_join(F.array_sort("hits.items"), ",")).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_toxicity,
            op2_url_filter,
            op3_html_text,
            op4_exact_dedup,
            op5_secret_scan,
            op6_repeats,
            op7_language_model,
            op8_packing,
            op9_near_dedup,
            op10_decontaminate,
            op11_conversation_trie,
            op12_near_vectors,
            op13_fill_in_middle,
        )
    }


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_EXACT_DEDUP = f"""
WITH lowered AS (SELECT doc_id, {_LOWERED} AS lowered FROM documents)
SELECT doc_id,
       max(doc_id) OVER alike AS keep_id,
       count(*) OVER alike AS group_size,
       doc_id = max(doc_id) OVER alike AS kept,
       sha256(lowered) AS text_sha256
FROM lowered
WINDOW alike AS (PARTITION BY lowered)
"""

_URL_FILTER = f"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0
              THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1)
              ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
), rules (verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT page_id, rule, verdict FROM fitting WHERE place = 1) USING (page_id)
"""

_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS size,
         array_to_string(words[first : first + least(10, len(words)) - 1], ' ') AS content
  FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS starts (first)
  WHERE len(words) > 0
), docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
runs AS (
  SELECT doc_id, first, size, array_to_string(words[first : first + size - 1], ' ') AS content
  FROM docs, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(1, len(words) - size + 2)) AS starts (first)
), hits AS (SELECT doc_id, first, size, item FROM runs JOIN windows USING (size, content)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM hits, unnest(range(first, first + size)) AS places (place) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


_TRIE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc (conv_id, rest, state) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM turns
  UNION ALL
  SELECT conv_id, substr(rest, 2),
         list_reduce(list_prepend(xor(state, CAST(ord(rest) AS BIGINT)), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                     lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))
  FROM crc WHERE rest <> ''
), lists AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS own FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1 : h], []), c.own[h + 1 :]) AS path
  FROM lists c JOIN (SELECT conv_id, xor(state, 4294967295) % 6 AS h FROM crc WHERE rest = '') USING (conv_id)
  LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
  SELECT conv_id, depth, len(path) AS size, path[1 : depth] AS prefix
  FROM rebuilt, unnest(range(0, len(path) + 1)) AS depths (depth)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(length(prefix[depth].text), 0) AS chars,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends
  FROM members GROUP BY depth, prefix
), lines AS (
  SELECT n.depth AS low, n.n_convs, n.chars, n.conv_id, above, n.prefix[1 : above] AS prefix
  FROM nodes n, unnest(range(0, n.depth + 1)) AS depths (above)
), children AS (
  SELECT above AS depth, prefix, count(*) AS n_children FROM lines WHERE low = above + 1 GROUP BY above, prefix
), leaves AS (
  SELECT depth, prefix FROM nodes ANTI JOIN children USING (depth, prefix)
), below AS (
  SELECT above AS depth, l.prefix, sum((n_convs - 1) * chars) AS saved FROM lines l GROUP BY above, l.prefix
), leafy AS (
  SELECT above AS depth, leaf.prefix[1 : above] AS prefix, count(*) AS n_leaves
  FROM leaves leaf, unnest(range(0, leaf.depth + 1)) AS depths (above) GROUP BY above, leaf.prefix[1 : above]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (depth, prefix) JOIN leafy USING (depth, prefix) LEFT JOIN children USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
"""

_NEAR_VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 END
), reached (u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u
), components AS (SELECT u AS vec_id, min(v) AS component_id FROM reached GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_FILL_IN_MIDDLE = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS hash
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units) AS n,
         CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
         CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
         CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 AS taken,
         CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 AS turned
  FROM lines
), cut AS (
  SELECT doc_id, n, text,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR taken >= 100
              THEN 'plain' WHEN turned < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1 : greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1 :], '') AS suffix
  FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _URL_FILTER,
        "op4_exact_dedup": _EXACT_DEDUP,
        "op10_decontaminate": _DECONTAMINATE,
        "op11_conversation_trie": _TRIE,
        "op12_near_vectors": _NEAR_VECTORS,
        "op13_fill_in_middle": _FILL_IN_MIDDLE,
    }
