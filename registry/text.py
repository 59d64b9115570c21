"""Text, flag and rule queries."""

from pyspark.sql import functions as F

from opsight.functions import rules, text
from registry.base import big, query, rnd

URL_PARTS = """
u AS (SELECT page_id, url, CASE WHEN strpos(url, '?') > 0
        THEN substr(url, strpos(url, '?')) ELSE '' END AS q FROM pages)"""


@query("pages", sql=f"""
WITH {URL_PARTS}
SELECT page_id, nullif(substr(split_part(q, '&', 1), 2), '') AS query_string1,
  nullif(split_part(q, '&', 2), '') AS query_string2,
  nullif(split_part(q, '&', 3), '') AS query_string3,
  nullif(array_to_string(string_split(q, '&')[2:], '&'), '') AS query_rest FROM u""")
def split_query_string(pages):
    """P1."""
    at = F.instr("url", "?")
    q = pages.select("page_id", F.when(at > 0, F.substr(F.col("url"), at)).otherwise("").alias("q"))
    all_slots = text.split_query_string(q, "q", drop_first=True)
    rest = text.split_query_string(q, "q", 1).select("page_id", "query_rest")
    return all_slots.drop("query_rest").join(rest, "page_id").select(
        "page_id", "query_string1", "query_string2", "query_string3", "query_rest")


@query("documents", sql="""
SELECT doc_id, concat(replace(text, ' ', '+'), '|100%&', source, '=a b%zé% ', text) AS decoded FROM documents""")
def percent_decode(documents):
    """Good, bad and doubly coded parts in one text; '+' stays as it is."""
    encoded = F.concat(
        F.replace(F.col("text"), F.lit(" "), F.lit("+")), F.lit("%7C100%&"), "source",
        F.lit("%3Da%2520b%z%C3%A9% "), "text")
    return text.percent_decode(documents.select("doc_id", encoded.alias("decoded")), ["decoded"])


@query("pages", sql="""
SELECT page_id, CASE WHEN upper(url) LIKE '%/EN/%' THEN 'EN' WHEN upper(url) LIKE '%EXAMPLE.ORG%'
  THEN 'ORG' WHEN upper(url) LIKE '%/FR/%' THEN 'FR' END AS domain FROM pages""")
def classify_url_domain(pages):
    """The first matching rule."""
    order = (("%/EN/%", "EN"), ("%EXAMPLE.ORG%", "ORG"), ("%/FR/%", "FR"))
    return text.classify_url_domain(pages, rules=order).select("page_id", "domain")


@query("events", sql="""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'JREPQ' WHEN event_type = 'error'
  THEN 'SAMQ' ELSE 'APPQ' END AS queue FROM events""")
def reassign_queue(events):
    """P4."""
    rows = events.select("event_id", F.col("event_type").alias("service"),
                         F.lit("APPQ").alias("queue"))
    return text.reassign_queue(rows, {"click": "JREPQ", "view": "JREPQ", "error": "SAMQ"}).select(
        "event_id", "queue")


@query("events", sql="""
SELECT concat('SELECT v FROM t WHERE k=:,n=: AND kind=: AND type=', event_type) AS fingerprint,
  count(*) AS executions, round(sum(value), 3) AS total_duration, max(value) AS max_duration
FROM events GROUP BY 1""")
def rollup_by_fingerprint(events):
    """P5: statements that differ in literals only fall together."""
    statement = F.concat(
        F.lit("CEX Stmt=SELECT  v FROM t WHERE k = "), F.col("user_id").cast("string"),
        F.lit(" , n= "), F.col("value").cast("string"), F.lit(" AND kind ='it''s "),
        F.col("props"), F.lit("' AND type = "), F.col("event_type"))
    rows = events.select(statement.alias("operation"), "value")
    return text.rollup_by_fingerprint(rows, "operation", "value").select(
        "fingerprint", "executions", rnd("total_duration", 3), "max_duration")


@query("events", sql="""
SELECT event_id, regexp_replace(props, '([ :])[0-9]+', '\\1:') AS masked FROM events""")
def fingerprint_props(events):
    """P5 over the numbers of a JSON text."""
    return events.select("event_id", text.fingerprint("props").alias("masked")).select(
        "event_id", F.regexp_replace("masked", ":(?=:)", ": ").alias("masked"))


@query("cat_records", "cat_field_types", sql="""
SELECT recname, CASE rectype WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 6 THEN 'QUERY VIEW'
  WHEN 7 THEN 'TEMPORARY TABLE' END AS label FROM cat_records""")
def decode_codes(records, types):
    """P8."""
    from opsight.operators.catalog import RECORD_LABELS
    return records.select("recname", text.decode_codes("rectype", RECORD_LABELS).alias("label"))


@query("pages", sql="""
SELECT page_id, CASE WHEN len(string_split(url, '=')) > 2
  THEN nullif(array_to_string(string_split(url, '=')[3:], '='), '') ELSE url END AS tail,
  CASE WHEN strpos(url, ':') > 1 THEN split_part(url, ':', 1) END AS host,
  nullif(substr(url, strpos(url, ':') + 1), '') AS port FROM pages""")
def delimited_parts(pages):
    """P9, P10."""
    return pages.select("page_id", text.nth_delimited_tail("url").alias("tail"),
                        text.host_of("url").alias("host"), text.port_of("url").alias("port"))


@query("cat_pairs", sql="""
SELECT l_partkey, l_suppkey, CAST(q AS BIGINT) & 16 <> 0 AS floored,
  CAST(q AS BIGINT) % 32 = 16 AS unfloored FROM cat_pairs""")
def flag_tests(pairs):
    """The plain and the un-floored test."""
    q = F.col("q").cast("long")
    return pairs.select("l_partkey", "l_suppkey", rules.has_flag(q, 16).alias("floored"),
                        rules.has_flag_unfloored(q, 16).alias("unfloored"))


@query("prc_requests", sql="""
SELECT prcsinstance, concat_ws('_', replace(replace(prcstype, ' ', '_'), '-', '_'), prcsname,
    prcsinstance, replace(replace(servernamerun, ' ', '_'), '-', '_')) AS tag,
  left(concat(prcstype, ', ', prcsname, ', ', prcsinstance, ', Start, ', oprid), 160) AS comment,
  left(concat('PI=', prcsinstance, ':', servernamerun, ' ', oprid), 32) AS action
FROM prc_requests""")
def session_tags(requests):
    """P16."""
    return requests.select(
        "prcsinstance",
        text.session_tag("prcstype", "prcsname", "prcsinstance", "servernamerun").alias("tag"),
        text.status_comment("prcstype", "prcsname", "prcsinstance", F.lit("Start"), "oprid", 160).alias(
            "comment"),
        text.action_tag("prcsinstance", F.concat("servernamerun", F.lit(" "), "oprid"), 32).alias(
            "action"))


@query("documents", sql="""
WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS seq, '' AS piece, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, seq + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT doc_id, seq, rest, CASE WHEN length(rest) < 254 THEN length(rest)
      WHEN strpos(reverse(left(rest, 254)), ' ') > 0
      THEN 255 - strpos(reverse(left(rest, 254)), ' ') ELSE 254 END AS n FROM p WHERE rest <> '')
)
SELECT doc_id, CAST(seq AS BIGINT) AS parm_seq, piece AS message_parm FROM p WHERE seq > 0""")
def chunk_text(documents):
    """P17 over whole texts."""
    return text.chunk_text(documents.select("doc_id", "text"), "text", max_parts=None).select(
        "doc_id", big("parm_seq"), "message_parm")


@query("documents", "labels", sql="""
SELECT doc_id, 'text too long' AS rule FROM documents WHERE length(text) > 4000
UNION ALL SELECT doc_id, 'lang not allowed' FROM documents WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT doc_id, 'n_chars wrong' FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT d.doc_id, 'label missing' FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE l.quality IS NULL""")
def check_rules(documents, labels):
    """Length, domain and NOT NULL rules in one pass."""
    rows = documents.join(labels, "doc_id", "left")
    return rules.check_rules(rows, {
        "text too long": rules.max_length("text", 4000),
        "lang not allowed": F.col("lang").isin("en", "fr"),
        "n_chars wrong": F.col("n_chars") == F.length("text"),
        "label missing": F.col("quality").isNotNull(),
    }).select("doc_id", "rule")
