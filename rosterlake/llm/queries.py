"""The registered queries of this subpackage, op1 to op13, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import RANKS, decode_ids, encode_texts
from .chat_tools import TURN_SCHEMAS, link_tools, turns_as_tools
from .common import table, work_path
from .conversation_repair import repair_reports, with_planted_faults
from .decontaminate import find_contamination, ids_digest
from .minhash import similar_groups
from .mixing import mix_sources
from .periodic_runs import find_runs, longest_run, runs_digest, with_planted_runs
from .quality import score_quality
from .sharding import shard_documents
from .token_counts import count_tokens
from .url_filter import judge_urls, referral_keys
from .vector_dedup import similar_vectors
from .warc import read_warc, write_warc


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, referral_keys(pages)).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(*turns_as_tools(table(spark, sf_dir, "conversations")), TURN_SCHEMAS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_documents(docs, keep=["doc_id", "text_crc32"]).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ranks_path=RANKS)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_reports(with_planted_faults(turns), turns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    best = longest_run(F.col("runs"))
    found = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", "runs", "collapsed")
    thousandths = F.floor(F.lit(1000).cast("long") * F.col("length") / F.col("period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", thousandths, runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path=ranks, pattern=pattern)
    ids = ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_ids(ids, keep=["doc_id", "n_tokens", "ids_sha256"], ranks_path=ranks, pattern=pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filters, op2_quality_classifier, op3_chat_tool_links, op4_decontamination, op5_sharding, op6_warc, op7_mixing, op8_token_counts, op9_embedding_near_dedup, op10_minhash_near_dedup, op11_conversation_repair, op12_periodic_runs, op13_byte_bpe)
    return {f.__name__: f for f in every}


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_URLS = f"""SELECT page_id, url, coalesce({_FOLD.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages"""


def _rule_case(values: tuple[str, str, str, str, str]) -> str:
    tests = (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/"))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'" for (h, p), v in zip(tests, values)) + " END"


OP1_SQL = f"""
WITH u AS ({_URLS}),
listed AS (SELECT DISTINCT host || path AS key FROM u WHERE contains(url, '://') AND regexp_matches(regexp_extract(url, '\\?([^#]*)', 1), '(^|&)ref='))
SELECT page_id, host, path, {_rule_case(("www.example.com/en/", "example.com/en/", "net/es/", "net/fr/", "com/"))} AS rule,
  coalesce({_rule_case(("allow", "block", "block", "block", "allow"))}, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM u"""

OP3_SQL = r"""
WITH c AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, 'call-' || turn AS call_id, turn, min(coalesce(text, '')) AS text, count(*) AS n_calls,
    CASE turn // 2 % 4 WHEN 0 THEN turn + 2 WHEN 2 THEN turn - 2 WHEN 3 THEN turn - 6 END AS dep_turn, 'call-' || dep_turn AS dep
  FROM conversations WHERE role = 'user' AND turn IS NOT NULL GROUP BY conv_id, turn),
r AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, 'call-' || (turn - 1) AS call_id, turn AS result_turn, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id, turn),
k AS (SELECT c.*, c.dep_turn IS NOT NULL AND d.turn IS NULL AS lost, CASE WHEN d.turn > c.turn THEN 1 WHEN e.turn > d.turn THEN 2 ELSE 0 END AS level
  FROM c LEFT JOIN c AS d ON d.conv = c.conv AND d.turn = c.dep_turn LEFT JOIN c AS e ON e.conv = d.conv AND e.turn = d.dep_turn),
p AS (SELECT k.*, row_number() OVER (PARTITION BY conv ORDER BY level, turn, call_id) - 1 AS position, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM k),
j AS (SELECT coalesce(p.conv, r.conv) AS conv, coalesce(p.call_id, r.call_id) AS call_id, * EXCLUDE (conv, call_id) FROM p FULL JOIN r ON p.conv = r.conv AND p.call_id = r.call_id)
SELECT conv, call_id, coalesce(turn, result_turn) AS turn, CASE WHEN n_calls IS NOT NULL THEN 'answer' END AS name,
  CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status, position,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN n_calls IS NULL THEN [] ELSE list_filter([CASE WHEN lost THEN 'dependency ' || dep || ': not known' END, CASE WHEN text = '' THEN '$.text: too short' END,
    CASE WHEN words < 1 THEN '$.words: too small' END, CASE WHEN words > 200 THEN '$.words: too large' END], lambda x: x IS NOT NULL) END AS errors,
  '{"call":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '},"id":"' || call_id || '","name":"answer","position":' || position || '}' END
    || ',"result":' || CASE WHEN n_results IS NULL THEN 'null' ELSE '{"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"turn":' || result_turn || '}' END || '}' AS json
FROM j"""

OP4_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM v),
g AS (SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM w, lengths, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
h AS (SELECT r, i, g.k, item FROM g JOIN v ON g.g = v.g AND g.k = v.k),
words_hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(words_hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM d"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, coalesce(least(cap, f.level * w), cap) AS target FROM l LEFT JOIN f ON true),
o AS (SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(3, epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT n.doc_id, n.n, hash(g) AS g FROM s JOIN n USING (doc_id), unnest(s.s) AS t(g)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.a = doc_id"""


#: A struct of (cost, edits, repaired text) for what comes from a row on, in each of four states: nothing written, a system turn, whole pairs, an open pair.
_FAR = "{'c': 1000000, 'a': '~', 'r': ''}"


def _edited(state: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {letter} || {state}.a, 'r': {line} || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) || {state}.r END}}"


def _turned(role: str, initial: str, state: str) -> str:
    """The row kept or given another role, unless it must go."""
    kept = f"initial = '{initial}'"
    return f"""CASE WHEN fault IN ('blank', 'duplicate') THEN {_FAR} ELSE {_edited(state, f"CASE WHEN {kept} THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", f"CASE WHEN {kept} THEN 'K' ELSE 'R' END", f"CASE WHEN {kept} THEN role ELSE '{role}' END || ':' || text")} END"""


_DROPPED = {q: f"{{'c': w.{q}.c + 2, 'a': 'D' || w.{q}.a, 'r': w.{q}.r}}" for q in "nspo"}
_SYSTEM_KEPT = f"""CASE WHEN initial = 's' AND fault NOT IN ('blank', 'duplicate') THEN {_edited('w.s', "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", "'K'", "role || ':' || text")} ELSE {_FAR} END"""
_INSERTED = lambda role, state: _edited(state, "5", "'I'", f"'{role}:'")  # noqa: E731

OP11_SQL = rf"""
WITH RECURSIVE bits AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS x FROM range(256) AS r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS UBIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295) % 20 AS h FROM k, bits),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(rtrim(text, e' 	
'), 1) AS tail, substr(role, 1, 1) AS initial FROM d),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
b AS (SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'r': ''}} AS n, {{'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS s, {{'c': 0, 'a': '', 'r': ''}} AS p, {{'c': 5, 'a': 'I', 'r': 'assistant:'}} AS o FROM c
  UNION ALL SELECT conv_id, i, list_min([n, {_INSERTED('user', 'z')}]), list_min([s, {_INSERTED('user', 'z')}]), list_min([p, {_INSERTED('user', 'o')}]), z FROM (SELECT *, list_min([o, {_INSERTED('assistant', 'p')}]) AS z FROM (
    SELECT w.conv_id, f.i, list_min([{_DROPPED['n']}, {_turned('user', 'u', 'w.o')}, {_SYSTEM_KEPT}]) AS n, list_min([{_DROPPED['s']}, {_turned('user', 'u', 'w.o')}]) AS s, list_min([{_DROPPED['p']}, {_turned('user', 'u', 'w.o')}]) AS p, list_min([{_DROPPED['o']}, {_turned('assistant', 'a', 'w.p')}]) AS o
    FROM b AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1)))
SELECT e.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(n.c, 0) AS BIGINT) AS cost, coalesce(n.a, '') AS audit, sha256(coalesce(n.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN (SELECT c.* EXCLUDE (n), b.n AS n FROM c JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1) AS x ON x.conv_id IS NOT DISTINCT FROM e.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL, "op3_chat_tool_links": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_warc": OP6_SQL,
        "op7_mixing": OP7_SQL, "op9_embedding_near_dedup": OP9_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL,
    }  # fmt: skip
