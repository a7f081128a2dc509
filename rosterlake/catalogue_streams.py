"""Registered batch twins of the stream jobs, and scans that depend on order."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _query
from .functions import columns as C
from .functions import lexicons as L
from .functions.embedding import hashed_vectors
from .sources.memo import Memo
from .sources.tables import table
from .sources.work import session_dir
from .streaming import status
from .streaming.versions import VersionStore

_STATUS = {"signup": "pending", "click": "pending", "view": "processing", "purchase": "completed"}
_ALLOWED = "CASE WHEN f.state IS NULL THEN e.status = 'pending' WHEN f.state = 'pending' THEN e.status = 'processing' WHEN f.state = 'processing' THEN e.status IN ('completed', 'failed') WHEN f.state = 'failed' THEN e.status = 'processing' AND f.failures < 3 ELSE false END"


@_query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE 'failed' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS state, 0 AS failures FROM events
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.ts, e.status, {_ALLOWED}, CASE WHEN {_ALLOWED} THEN e.status ELSE f.state END, f.failures + CASE WHEN e.status = 'failed' AND {_ALLOWED} THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, ts, status, accepted, state, failures FROM f WHERE i > 0""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each status event with whether the status machine accepts it and the status after it; events stand for the attempts at a document."""
    kind = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    events = table(spark, d, "events").select("user_id", "event_id", "ts", F.coalesce(kind[F.col("event_type")], F.lit("failed")).alias("status"))
    return status.transitions_of_table(events, "user_id", "ts", "status")


def parsed_arrivals(arrivals: DataFrame) -> DataFrame:
    """What a stream parses of each arriving text: contact, stated years, lexicon skills, length."""
    text = F.coalesce("text", F.lit(""))
    return arrivals.select("conv_id", "turn", C.first_email(text).alias("email"), C.stated_years(text).alias("years"), C.skills_in(text).alias("skills"), F.length(text).cast("long").alias("n_chars"))


_YEARS_SQL = ", ".join(f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i){p}', 1), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 20)[1]" for p in L.YEARS_PATTERNS)


@_query(f"""WITH v AS (SELECT conv_id, turn, nullif(regexp_extract(coalesce(text, ''), '{L.EMAIL}'), '') AS email, coalesce({_YEARS_SQL}) AS years, list_filter([{", ".join(repr(w) for w in L.JOB_SKILLS)}], lambda w: contains(lower(coalesce(text, '')), w)) AS skills, length(coalesce(text, '')) AS n_chars,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce((turn % 3 + 3) % 3, 0), turn NULLS FIRST) AS INTEGER) AS version_number FROM conversations)
SELECT *, version_number = max(version_number) OVER (PARTITION BY conv_id) AS is_current FROM v""")
def ingested_versions(spark: SparkSession, d: str) -> DataFrame:
    """Texts that arrive in three batches, parsed inside each and appended as versions of their conversation through the committed store."""
    store = VersionStore(spark, f"{session_dir(spark)}/versions-{uuid.uuid4().hex}", "conv_id", ["turn"])
    arrivals = table(spark, d, "conversations")
    for batch in range(3):
        store.append(parsed_arrivals(arrivals.filter(F.coalesce(F.pmod("turn", F.lit(3)), F.lit(0)) == batch)), batch)
        if batch == 1:
            store.gather()
    return store.read()


@_query(r"""WITH d AS (SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash, coalesce(text, '') AS text FROM documents),
w AS (SELECT text_hash, md5(w) AS h FROM (SELECT text_hash, unnest(regexp_split_to_array(lower(text), '[ \t-\r]+')) AS w FROM d) WHERE w <> ''),
p AS (SELECT text_hash, ('0x' || h[1:4])::INTEGER % 64 AS i, sum(CASE WHEN ('0x' || h[5:5])::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL),
n AS (SELECT text_hash, map_from_entries(list((i, s))) AS m, sqrt(CAST(sum(s * s) AS DOUBLE)) AS n FROM p GROUP BY text_hash)
SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, list_transform(range(64), lambda i: CASE WHEN n > 0 THEN CAST(floor(coalesce(CAST(m[i] AS DOUBLE), 0) / n * 1000 + 0.5::DOUBLE) AS BIGINT) ELSE 0 END) AS thousandths
FROM documents LEFT JOIN n ON n.text_hash = sha256(coalesce(text, ''))""")
def text_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every document's vector, computed once for each distinct text and read through the store; components in thousandths."""
    memo = Memo(spark, f"{session_dir(spark)}/memo-{uuid.uuid4().hex}", "vector array<double>", 60)
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = memo.through(docs, "text", lambda t: hashed_vectors(t, "text_hash", "text"), datetime.datetime(2024, 1, 1))
    return found.select("doc_id", "text_hash", F.transform("vector", lambda x: F.floor(x * 1000 + 0.5)).alias("thousandths"))
