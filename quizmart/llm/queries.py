"""Registered queries of the training-data operators and, where SQL can express them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, crosstok, decontaminate, fertility, langid, lines, packing, repeats, secrets, simhash, urlrules, wrappers
from .common import table


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and verdict of every document."""
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats from smaller documents leave of every document."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every compared line of every document with its class, links and verdict."""
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item with a passage that aligns."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), order_col="doc_id")
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted text, of every conversation and of conversation -1."""
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digest(rows.unionByName(more).withColumn("content", chat.text_part(F.col("text"))))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and confirmed secret spans of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations."""
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


#: The listed rules of the query; the pages that they decide teach the mined ones.
URL_RULES = [
    urlrules.ListRule("allow", "org", "/"),
    urlrules.ListRule("block", "example.org", "/es/"),
    urlrules.ListRule("block", "example.org", "/en/1"),
    urlrules.ListRule("allow", "com", "/fr/"),
    urlrules.ListRule("block", "com", "/de/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, listed rule and verdict of every page."""
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups, links and corpus counts of every document."""
    return crosstok.link_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tokeniser_fertility, op2_suffix_dedup, op3_line_dedup, op4_benchmark_decontamination, op5_language_id, op6_html_extraction, op7_chat_formatting, op8_secret_scan, op9_best_fit_packing, op10_simhash_near_dedup,
                                op11_phrase_collocations, op12_url_filter, op13_tokenizer_alignment)
}

ORACLE: dict[str, str] = {
    "op7_chat_formatting": """
        WITH m AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        r AS (SELECT *, replace(text, '<', '<' || chr(92)) AS body FROM m)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(body) + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 24)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op11_phrase_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) AS t(k)),
        f AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM s GROUP BY ALL),
        c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
        u AS (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 :], ' ') AS y
              FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        o AS (SELECT u.lang, u.phrase, u.a, fl.a AS l, fr.a AS r,
                ((2000000::HUGEINT * u.a) // (fl.a + fr.a))::BIGINT AS score, j
              FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = x JOIN f fr ON fr.lang = u.lang AND fr.phrase = y),
        b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (SELECT lang, a, ws, k, s, m FROM (SELECT *, unnest(range(1, k)) AS s FROM c), range(2, 4) AS t(m) WHERE m < k AND s + m - 1 <= k),
        x AS (SELECT DISTINCT i.lang, c.phrase FROM i JOIN c ON c.lang = i.lang AND c.phrase = array_to_string(i.ws[i.s : i.s + m - 1], ' ')
              WHERE 100 * i.a >= 80 * c.a),
        kept AS (SELECT b.* FROM b ANTI JOIN x ON x.lang = b.lang AND x.phrase = b.phrase)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
        p AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        l(rule, rh, rp, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
          ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        t AS (SELECT page_id, host, path, string_split(host, '.') AS hl,
                regexp_extract(url, '^[^?#]*\\?([^=&#]*)', 1) AS q, url FROM p),
        k AS (SELECT row_number() OVER () AS id, page_id, host, path,
                CASE WHEN host = '' AND path = '' THEN [] ELSE list_sort(list_filter([
                  CASE WHEN host <> '' AND split_part(url, '://', 1) <> '' THEN 'scheme=' || split_part(url, '://', 1) END,
                  CASE WHEN hl[-1] <> '' THEN 'tld=' || hl[-1] END,
                  CASE WHEN len(hl) >= 2 THEN 'domain=' || hl[-2] || '.' || hl[-1] END,
                  CASE WHEN len(hl) >= 3 THEN 'host=' || host END,
                  CASE WHEN len(hl) >= 3 AND hl[1] <> '' THEN 'sub=' || hl[1] END,
                  CASE WHEN regexp_matches(path, '^/[^/]+/') THEN 'dir=' || regexp_extract(path, '^/([^/]+)/', 1) END,
                  CASE WHEN path <> '' THEN 'leaf=/' || regexp_replace(regexp_extract(path, '([^/]*)\\z', 1), '[0-9]+', '9', 'g') END,
                  CASE WHEN q <> '' THEN 'query=' || q END], lambda x: x IS NOT NULL)) END AS tokens FROM t),
        r AS (SELECT id, rule, v FROM k JOIN l ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(rule) DESC, rule) = 1),
        j AS (SELECT k.*, rule, v FROM k LEFT JOIN r USING (id)),
        m AS (SELECT id, page_id, v, unnest(range(1, 1 << len(tokens))) AS mask, tokens FROM j),
        s AS (SELECT id, v, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM m),
        total AS (SELECT count(*) AS n FROM j WHERE v IS NOT NULL AND len(tokens) > 0),
        f AS (SELECT items, count(*) AS held FROM s WHERE v IS NOT NULL GROUP BY items),
        g AS (SELECT items, v, count(*) AS c FROM s WHERE v IS NOT NULL GROUP BY items, v),
        a AS (SELECT items, g.v, c / held AS confidence, c FROM g JOIN f USING (items), total
              WHERE c >= 5 AND c >= ceil(n / 512) AND c / held >= 0.9),
        best AS (SELECT id, array_to_string(a.items, ' ') || ' -> ' || a.v AS mined, a.v AS mv FROM s JOIN a USING (items) WHERE s.v IS NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, c DESC, len(a.items), array_to_string(a.items, ' '), a.v) = 1)
        SELECT page_id, host, path, rule, coalesce(v, mv, 'allow') AS verdict, mined AS mined_rule FROM j LEFT JOIN best USING (id)""",
}
