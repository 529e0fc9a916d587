"""The registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtable.llm import filter_audit, language, mixing, near_dedup, packing, secrets, spelling, syncmers, templates, token_files, topk, toxicity, url_rules
from flowtable.llm.common import table
from flowtable.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """A public vocabulary file: below $TOKENIZERS_DIR if that is set, else the installed package's."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), "byte", end_id=0, length=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"))))


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT p.*, '.' || host || '#' || path AS url, r.rule, r.verdict AS rule_verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN (VALUES {', '.join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in url_rules.HOST_RULES)}) r(rule_host, rule_path, rule, verdict)
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM (SELECT *, CASE {' '.join(f"WHEN url GLOB '{g}' THEN '{g}'" for g in url_rules.BLOCK_GLOBS)} END AS pattern FROM ruled WHERE n = 1)
"""


@query("op3_url_rules", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "word", end_id=2)
    return token_files.read_token_files(spark, manifest)


# The added kinds in the words of an engine without look-around: a web token with the character before it,
# and a private key without the short last line of one that has no END, which `TAIL` finds behind it.
_LABEL = "[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:[ \t\n\x0B\f\r]|\\[nr])+"
PLAIN = {
    "jwt": (r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1),
    "pem": (
        rf"-----BEGIN {_LABEL}(?:[^-]*(?:-{{1,4}}[^-]+)*-----END {_LABEL}"
        rf"|(?:{_BREAK}(?:[A-Z][A-Za-z-]*: [^\r\n\\]*|[A-Za-z0-9+/=]{{16,}}))+)?", 0,
    ),
}
TAIL = r"^([ \t\n\x0B\f\r]*[\r\n][A-Za-z0-9+/=]+)[ \t]*(?:[\r\n]|$)"


def _spans_sql() -> str:
    def one(rank: int, rule: secrets.Rule) -> str:
        pattern, own = PLAIN.get(rule.kind, (rule.pattern, 0))
        if pattern.startswith("(?i)"):  # the engine would take other alphabets' forms of a letter for it, too
            head, tail = pattern[4:].split(")", 1)
            pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + tail
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {rule.least} AS least,
          unnest(list_transform(string_split_regex(text, '{p}'), lambda x: length(x))) AS gap,
          unnest(list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x))) AS size,
          unnest(list_transform(regexp_extract_all(text, '{p}', {own}), lambda x: length(x))) AS wide,
          unnest(list_transform(regexp_extract_all(text, '{p}', {rule.group or own}), lambda x: length(x))) AS value,
          unnest(range(len(string_split_regex(text, '{p}')))) AS i
        FROM docs WHERE regexp_matches(text, '{p}')"""

    return " UNION ALL ".join(one(i, r) for i, r in enumerate(secrets.RULES))


SECRET_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
each AS ({_spans_sql()}),
placed AS (
  SELECT *, sum(gap + coalesce(size, 0)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM each
),
ended AS (
  SELECT * REPLACE (stop + CASE WHEN kind = 'pem' AND size > 0 AND substr(text, stop::bigint - 4, 5) <> '-----'
      THEN length(regexp_extract(substr(text, stop::bigint + 1), '{TAIL}', 1)) ELSE 0 END AS stop), stop - wide AS start
  FROM placed JOIN docs USING (doc_id)
),
hits AS (
  SELECT doc_id, base, kind, start, rank, kind || ':' || start::bigint || ':' || stop::bigint AS span
  FROM ended WHERE value >= least
),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS base_spans,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM hits GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)
"""


@query("op5_secret_scan", SECRET_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the documents through one ledger: the second scans only texts that the first did not have."""
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger")
    secrets.update_ledger(secrets.drafts(docs), ledger)
    return secrets.findings(docs, ledger).drop("blob", "found")


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight
  FROM sizes GROUP BY source
), tops AS (
  SELECT *, {mixing.CEILING}::double * source_size AS top, {mixing.SHARE}::double * sum(source_size) OVER () AS goal FROM sources
), ordered AS (  -- a source stands at its ceiling if filling all to its level costs no more than the goal
  SELECT *, coalesce(sum(top) OVER below, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS free
  FROM tops WINDOW below AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, max(CASE WHEN held + top / weight * free > goal THEN (goal - held) / free END) OVER () AS any_level,
    min(CASE WHEN held + top / weight * free > goal THEN top / weight END) OVER () AS edge FROM ordered
), level AS (
  SELECT max((goal - held) / free) FILTER (top / weight = edge) AS water FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR top <= weight * water THEN top ELSE weight * water END AS target FROM tops, level
), rated AS (
  SELECT doc_id, s.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496 AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, floor(rate)::bigint + (u < rate - floor(rate))::bigint AS copies FROM rated
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM counted
"""


@query("op7_mixing", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_syncmers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("sketch")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""


@query("op9_top_k", TOPK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(*language.sample(docs)))


@query("op11_page_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


# The checksum of a byte string by the table of its 256 remainders.
CRC_TABLE = [zlib.crc32(bytes([255 ^ i])) ^ 0xFF000000 for i in range(256)]
SPELLING_SQL = f"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(text, '{spelling.RUN}')) AS r FROM documents
), runs AS (
  SELECT id, translate(r, '{spelling.CAPITALS}', '{spelling.SMALL}') AS r FROM found
), hashed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(id || ':' || r, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))),
    lambda c, b: xor(c >> 8, {CRC_TABLE}[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs
), counted AS (
  SELECT CASE WHEN h % {spelling.SLIPS} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed
), known AS (
  SELECT word, count(*) AS n FROM counted WHERE length(word) >= {spelling.LEAST} GROUP BY word HAVING n >= {spelling.TWICE}
), cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM known)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM known a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word FROM known a JOIN cut b ON a.word = b.rest
), ranked AS (
  SELECT a.word, count(*) OVER (PARTITION BY a.word) AS n_near, b.n >= {spelling.TIMES} * a.n AS fits, b.word AS form, b.n AS form_n,
    row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, b.word) AS i
  FROM near JOIN known a ON near.word = a.word JOIN known b ON near.other = b.word
), formed AS (
  SELECT known.word, known.n, coalesce(n_near, 0) AS n_near, CASE WHEN fits THEN form END AS form, CASE WHEN fits THEN form_n END AS form_n
  FROM known LEFT JOIN ranked ON known.word = ranked.word AND i = 1
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT chain.word, form, steps + 1 FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
"""


@query("op12_spelling", SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


AUDIT_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), marked AS (
  SELECT doc_id, part, (len(words) < 200)::int + 2 * (100 * list_unique(words) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::int AS mask FROM words
), known AS (
  SELECT doc_id, max((quality = 1)::int) AS q, max((toxic = 1)::int) AS t FROM labels GROUP BY doc_id
), held AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (t = 1) AS toxic
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM f a JOIN f b ON b.name <> a.name JOIN f c ON c.name NOT IN (a.name, b.name)
    JOIN f d ON d.name NOT IN (a.name, b.name, c.name) JOIN f e ON e.name NOT IN (a.name, b.name, c.name, d.name)
), steps AS (
  SELECT filter_order, step, f.name AS filter, f.bit,
    coalesce((SELECT sum(g.bit) FROM f g WHERE instr(filter_order, g.name) < step), 0)::int AS before
  FROM orders, range(1, 6) r(step) JOIN f ON f.name = substr(filter_order, step, 1)
), seen AS (
  SELECT part, filter_order, step::int AS step, filter, n, good, toxic, mask = bit AS only_here,
    (mask & bit) <> 0 AS fails, (mask & before) <> 0 AS earlier FROM held, steps
), counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN only_here THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::bigint AS shapley FROM counted
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
