"""Queries over the test tables, one or more per operator, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import mining, patterns, profile, sequences
from ..sources import archive, container, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL fragments shared by the oracles.
_L = """L AS (SELECT 'events.log' AS file, event_id AS line_no, concat_ws(' ', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'),
 CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, 'svc-' || (user_id % 7), event_id, 'user', user_id, 'action', event_type,
 'value', CAST(floor(value * 100) AS BIGINT), 'k', json_extract_string(props, '$.k')) AS raw FROM events)"""
_T = _L + ", T AS (SELECT *, string_split(raw, ' ') AS toks FROM L)"
_E = _T + ", first AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS tid FROM events WHERE event_id < 1000 GROUP BY event_type), M AS (SELECT T.*, tid, event_type FROM T JOIN events ON line_no = event_id JOIN first USING (event_type))"
_V = _E + ", V AS (SELECT 'events.log' AS file, 'header' AS kind, 0 AS tid, i - 1 AS col, line_no, toks[i] AS value FROM T, unnest(range(1, 6)) AS r(i) UNION ALL SELECT 'events.log', 'var', tid, j, line_no, toks[p] FROM M, (VALUES (0, 7), (1, 11), (2, 13)) AS q(j, p))"
_N = _V + ", N AS (SELECT *, v - lag(v, 1, 0) OVER (PARTITION BY file, kind, tid, col ORDER BY line_no) AS d FROM (SELECT *, CASE WHEN regexp_matches(value, '^(0|-?[1-9][0-9]*)$') THEN TRY_CAST(value AS BIGINT) END AS v FROM V))"
_W = "CASE WHEN x <= 0 THEN 1.0 ELSE greatest(1.0, log2(x + 1.0)) END"
_D = "D AS (SELECT CAST(doc_id AS VARCHAR) AS file, i - 1 AS line_no, l[i] AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)), DT AS (SELECT *, list_filter(regexp_split_to_array(raw, '[\\p{Z}\\s\\x0B\\x{85}]+'), lambda t: t <> '') AS toks FROM D)"
_MASK = "CASE WHEN regexp_matches(t, '^([0-9]+|[0-9]+\\.[0-9]+|[0-9]{1,3}(\\.[0-9]{1,3}){3}|[0-9a-fA-F]{8,})$') THEN '<*>' ELSE t END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d):
    return files.event_lines(_table(spark, d, "events"))


def _docs(spark, d):
    return mining.parsed(files.document_lines(_table(spark, d, "documents")))


def _matched(spark, d):
    lines = _lines(spark, d)
    return mining.match(lines, mining.train(lines))


def _columns(spark, d):
    return profile.long_columns(_matched(spark, d))


@query(f"WITH {_L} SELECT * FROM L")
def log_lines(spark, d):
    return _lines(spark, d)


@query(f"WITH {_D} SELECT file, line_no, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS joined FROM DT")
def tokenize(spark, d):
    return _docs(spark, d).select("file", "line_no", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("joined"))


@query(f"WITH {_T} SELECT line_no, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS token FROM T, unnest(range(1, len(toks) + 1)) AS r(i)")
def token_positions(spark, d):
    return mining.parsed(_lines(spark, d)).select("line_no", F.posexplode("toks").alias("pos", "token"))


@query(f"WITH {_D} SELECT file, line_no, array_to_string(toks[1:5], ' ') AS header, CASE WHEN len(toks) > 5 THEN array_to_string(toks[6:], ' ') ELSE '' END AS content FROM DT")
def split_header(spark, d):
    return _docs(spark, d).select("file", "line_no", F.array_join("header", " ").alias("header"), F.array_join("content", " ").alias("content"))


@query(f"WITH {_D} SELECT CASE WHEN len(toks) < 5 THEN 'load_failed' WHEN len(toks) = 5 THEN 'no_content' ELSE 'content' END AS status, count(*) AS n_lines FROM DT GROUP BY 1")
def line_status(spark, d):
    n = F.size("toks")
    return _docs(spark, d).groupBy(F.when(n < 5, "load_failed").when(n == 5, "no_content").otherwise("content").alias("status")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_D} SELECT t AS token, {_MASK} AS masked, count(*) AS n FROM (SELECT unnest(toks) AS t FROM DT) GROUP BY t")
def mask_tokens(spark, d):
    return _docs(spark, d).select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", text.mask(F.col("token")).alias("masked"), "n")


@query(f"WITH {_T} SELECT array_to_string(list_transform(toks[6:], lambda t: {_MASK}), ' ') AS skeleton, count(*) AS n FROM T GROUP BY 1")
def masked_skeletons(spark, d):
    rows = mining.parsed(_lines(spark, d))
    return rows.groupBy(F.array_join(F.transform("content", text.mask), " ").alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_T}, C AS (SELECT line_no, i - 1 AS field, toks[i] AS v FROM T, unnest(range(1, 6)) AS r(i) WHERE line_no < 1000 AND i <= len(toks)),
G AS (SELECT field, bool_and(regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$', 'i')) AS num, arg_min(v, line_no) AS f, max(strlen(v)) AS w FROM C GROUP BY field)
SELECT 'events.log' AS file, CAST(field AS INTEGER) AS field, num AS is_numeric, CASE WHEN NOT num THEN '%s' WHEN regexp_matches(f, '^[0-9]+\\.[0-9]+$') THEN '%f' ELSE '%d' END AS format,
CAST(CASE WHEN num THEN w ELSE -1 END AS INTEGER) AS max_len, ' ' AS delim FROM G""")
def header_schema(spark, d):
    return profile.header_schema(_lines(spark, d))


@query(f"WITH {_E} SELECT CAST(tid AS INTEGER) AS tid, 'user <*> action ' || event_type || ' value <*> k <*>' AS template FROM first")
def templates(spark, d):
    return mining.train(_lines(spark, d)).templates.select("tid", F.array_join("tokens.value", " ").alias("template"))


@query(f"WITH {_E} SELECT CAST(tid AS INTEGER) AS tid, 'user <*> action ' || event_type || ' value <*> k <*>' AS template, count(*) AS n_lines FROM M GROUP BY tid, event_type")
def template_counts(spark, d):
    m = _matched(spark, d)
    return m.where("eid > 0").groupBy(F.col("eid").alias("tid"), F.array_join("template.value", " ").alias("template")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_E} SELECT line_no, CAST(tid AS INTEGER) AS eid FROM M")
def eids(spark, d):
    return _matched(spark, d).select("line_no", "eid")


@query(f"WITH {_E} SELECT line_no, array_to_string([toks[7], toks[11], toks[13]], '|') AS vars FROM M")
def extract_vars(spark, d):
    return _matched(spark, d).select("line_no", F.array_join("vars", "|").alias("vars"))


@query(f"WITH {_V} SELECT CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, line_no, value FROM V WHERE kind = 'var'")
def vars_long(spark, d):
    return _columns(spark, d).where("kind = 'var'").select("tid", "col", "line_no", "value")


@query(f"WITH {_E} SELECT CAST(tid AS INTEGER) AS tid, CAST(3 AS INTEGER) AS arity FROM first")
def template_var_arity(spark, d):
    return mining.train(_lines(spark, d)).templates.select("tid", F.size(F.filter("tokens", lambda t: t["is_var"])).alias("arity"))


@query(f"""WITH {_E}, P AS (SELECT tid, ['user', NULL, 'action', event_type, 'value', NULL, 'k', NULL] AS t FROM first)
SELECT line_no, CAST(P.tid AS INTEGER) AS tid, (6 + 1 + CASE WHEN toks[9] = t[4] THEN 1 ELSE 0 END) / 8.0 AS score FROM T, P""")
def similarity_scores(spark, d):
    lines = mining.parsed(_lines(spark, d))
    known = mining.train(_lines(spark, d)).templates.select("tid", F.col("tokens").alias("template"))
    return lines.join(F.broadcast(known)).select("line_no", "tid", mining.similarity("template", "content").alias("score"))  # a model of at most 1000 templates


@query(f"WITH {_V} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, count(*) AS n, count(DISTINCT value) AS n_distinct, round(count(DISTINCT value) / count(*), 9) AS ratio FROM V GROUP BY ALL")
def column_distinct_ratio(spark, d):
    return profile.profile(_columns(spark, d)).select("kind", "tid", "col", "n", "n_distinct", F.round("ratio", 9).alias("ratio"))


_P = f"""{_N}, hv AS (SELECT kind, tid, col, round(sum(-{_W} * c / n * log2(c / n)), 6) AS hv FROM (SELECT *, sum(c) OVER (PARTITION BY kind, tid, col) AS n FROM (SELECT kind, tid, col, v AS x, count(*) AS c FROM N WHERE v IS NOT NULL AND d IS NOT NULL GROUP BY ALL)) GROUP BY ALL),
hd AS (SELECT kind, tid, col, round(sum(-{_W} * c / n * log2(c / n)), 6) AS hd FROM (SELECT *, sum(c) OVER (PARTITION BY kind, tid, col) AS n FROM (SELECT kind, tid, col, d AS x, count(*) AS c FROM N WHERE v IS NOT NULL AND d IS NOT NULL GROUP BY ALL)) GROUP BY ALL),
B AS (SELECT kind, tid, col, count(*) AS n, count(DISTINCT value) AS u, bool_and(v IS NOT NULL) AS i, min(v) AS lv, min(d) AS ld FROM N GROUP BY ALL),
P AS (SELECT *, CASE WHEN i AND n > 2 AND lv >= -1 AND ld >= -1 AND hd <= hv + 1e-9 THEN 'delta' WHEN n >= 3 AND u / n < 0.5 THEN 'dict' ELSE 'raw' END AS encoding FROM B LEFT JOIN hv USING (kind, tid, col) LEFT JOIN hd USING (kind, tid, col))"""


@query(f"WITH {_P} SELECT 'events.log' AS file, kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, n, u AS n_distinct, round(u / n, 9) AS ratio, round(hv, 5) AS hv, round(hd, 5) AS hd, encoding FROM P")
def column_profile(spark, d):
    p = profile.profile(_columns(spark, d))
    return p.withColumns({"ratio": F.round("ratio", 9), "hv": F.round("hv", 5), "hd": F.round("hd", 5)})


@query(f"WITH {_P} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, encoding FROM P")
def choose_encoding(spark, d):
    return profile.profile(_columns(spark, d)).select("kind", "tid", "col", "encoding")


_ENT = "FROM (SELECT *, sum(c) OVER (PARTITION BY l_shipmode) AS n FROM (SELECT l_returnflag AS l_shipmode, {x} AS x, count(*) AS c FROM lineitem GROUP BY ALL)) GROUP BY 1"


@query("SELECT l_shipmode AS l_returnflag, round(sum(-(c / n) * log2(c / n)), 6) AS shannon " + _ENT.format(x="l_suppkey"))
def shannon_entropy(spark, d):
    return profile.entropies(_table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag"]).select("l_returnflag", F.round("shannon", 6).alias("shannon"))


@query(f"SELECT l_shipmode AS l_returnflag, round(sum(-{_W} * (c / n) * log2(c / n)), 6) AS weighted " + _ENT.format(x="l_suppkey"))
def weighted_entropy(spark, d):
    return profile.entropies(_table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag"]).select("l_returnflag", F.round("weighted", 6).alias("weighted"))


_KEYS = "K AS (SELECT o_orderstatus AS s, o_orderkey AS line_no, CAST(o_custkey AS VARCHAR) AS value, o_custkey AS v, o_custkey - lag(o_custkey, 1, 0) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS d FROM orders)"


def _orders(spark, d):
    return _table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("line_no"), F.col("o_custkey").cast("string").alias("value"))


@query(f"WITH {_KEYS} SELECT s, round(sum(-{_W} * (c / n) * log2(c / n)), 6) AS weighted FROM (SELECT *, sum(c) OVER (PARTITION BY s) AS n FROM (SELECT s, d AS x, count(*) AS c FROM K GROUP BY ALL)) GROUP BY s")
def weighted_entropy_delta(spark, d):
    return profile.entropies(profile.with_deltas(_orders(spark, d), ["s"]), "d", ["s"]).select("s", F.round("weighted", 6).alias("weighted"))


@query(f"WITH {_KEYS} SELECT s, line_no, d FROM K")
def delta_encode(spark, d):
    return profile.with_deltas(_orders(spark, d), ["s"]).select("s", "line_no", "d")


@query("SELECT o_orderstatus AS s, o_orderkey AS line_no, o_custkey AS v FROM orders")
def delta_decode(spark, d):
    return profile.delta_decode(profile.with_deltas(_orders(spark, d), ["s"]), ["s"])


_DICT = f"{_V}, X AS (SELECT kind, tid, col, value, row_number() OVER (PARTITION BY kind, tid, col ORDER BY min(line_no), value) - 1 AS code FROM V GROUP BY kind, tid, col, value)"


@query(f"WITH {_DICT} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, CAST(code AS INTEGER) AS code, value FROM X")
def dictionary_build(spark, d):
    return profile.dictionaries(_columns(spark, d)).drop("file")


@query(f"WITH {_DICT} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, line_no, CAST(code AS INTEGER) AS code FROM V JOIN X USING (kind, tid, col, value)")
def dict_encode(spark, d):
    c = _columns(spark, d)
    return profile.dict_encode(c, profile.dictionaries(c)).drop("file")


@query(f"WITH {_V} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, line_no, value FROM V")
def dict_decode(spark, d):
    c = _columns(spark, d)
    known = profile.dictionaries(c)
    return profile.dict_decode(profile.dict_encode(c, known), known).drop("file")


@query(r"SELECT page_id, regexp_replace(url, '[^-#><_:;,\[\]\\/.()]', '', 'g') AS delims FROM pages")
def delimiter_filter(spark, d):
    return _table(spark, d, "pages").select("page_id", text.delimiters(F.col("url")).alias("delims"))


@query(r"SELECT regexp_replace(url, '[^-#><_:;,\[\]\\/.()]', '', 'g') AS skeleton, count(*) AS n FROM pages GROUP BY 1")
def delimiter_skeletons(spark, d):
    return _table(spark, d, "pages").groupBy(text.delimiters(F.col("url")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CAST(len(p) AS INTEGER) AS n_parts, p[1] AS head, p[len(p)] AS tail FROM (SELECT page_id, string_split(url, '://') AS p FROM pages)")
def split_by_pattern(spark, d):
    p = _table(spark, d, "pages").select("page_id", text.split_by(F.col("url"), "://").alias("p"))
    return p.select("page_id", F.size("p").alias("n_parts"), F.element_at("p", 1).alias("head"), F.element_at("p", -1).alias("tail"))


@query("SELECT page_id, url FROM pages")
def rejoin_by_pattern(spark, d):
    return _table(spark, d, "pages").select("page_id", text.rejoin(text.split_by(F.col("url"), "/"), "/").alias("url"))


@query("SELECT min(len(p)) = max(len(p)) AND min(len(p)) > 1 AS splits, CAST(min(len(p)) AS INTEGER) AS parts FROM (SELECT list_filter(string_split(url, '://'), lambda x: x <> '') AS p FROM pages)")
def pattern_splits(spark, d):
    c = _table(spark, d, "pages").select(F.lit(1).alias("k"), F.col("url").alias("value"))
    return patterns.splits(c, "://", ["k"]).drop("k")


@query()
def delimiter_lcs(spark, d):
    pages = _table(spark, d, "pages").select((F.col("page_id") % 8).alias("k"), F.col("page_id").alias("line_no"), F.col("url").alias("value"))
    return patterns.column_patterns(pages, ["k"])


@query("SELECT o_orderkey AS id, o_orderkey - 2 * o_custkey AS n, CASE WHEN o_orderkey - 2 * o_custkey >= 0 THEN 2 * (o_orderkey - 2 * o_custkey) ELSE -2 * (o_orderkey - 2 * o_custkey) - 1 END AS z, o_orderkey - 2 * o_custkey AS back FROM orders")
def zigzag(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - 2 * F.col("o_custkey")).alias("n"))
    z = o.withColumn("z", text.zigzag(F.col("n")))
    return z.withColumn("back", text.unzigzag(F.col("z")))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 WHEN z < 34359738368 THEN 5 ELSE 6 END AS INTEGER) AS size FROM (SELECT o_orderkey, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z FROM (SELECT o_orderkey, o_orderkey * o_custkey * (1 - 2 * (o_orderkey % 2)) AS n FROM orders))")
def varint_size(spark, d):
    o = _table(spark, d, "orders")
    n = F.col("o_orderkey") * F.col("o_custkey") * (1 - 2 * (F.col("o_orderkey") % 2))
    return o.select(F.col("o_orderkey").alias("id"), text.varint_size(n).alias("size"))


@query(f"WITH {_L} SELECT * FROM L")
def reconstruct_lines(spark, d):
    return archive.restore(archive.tables(_lines(spark, d)))


@query(f"WITH {_D} SELECT count(*) AS n_lines, CAST(0 AS BIGINT) AS n_lost FROM D")
def roundtrip_diff(spark, d):
    lines = files.document_lines(_table(spark, d, "documents")).withColumn("file", F.lit("all")).withColumn("line_no", F.monotonically_increasing_id())
    lines = lines.select("file", "line_no", "raw").persist()
    back = archive.restore(archive.tables(lines)).withColumnRenamed("raw", "now")
    both = lines.join(back, ["file", "line_no"], "full")
    return both.agg(F.count("raw").alias("n_lines"), F.coalesce(F.sum((~F.col("raw").eqNullSafe(F.col("now"))).cast("long")), F.lit(0)).alias("n_lost"))


@query(f"WITH {_L} SELECT file, count(*) AS n_lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS n_bytes, count(DISTINCT line_no // 1000) AS n_chunks FROM L GROUP BY file")
def archive_list(spark, d):
    return archive.listing(archive.tables(_lines(spark, d), chunk_lines=1000))


@query(f"WITH {_L} SELECT file, count(*) AS n_lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS n_bytes, true AS ok FROM L GROUP BY file")
def archive_verify(spark, d):
    return archive.verify(archive.tables(_lines(spark, d))).select("file", "n_lines", "n_bytes", "ok")


@query(f"WITH {_L} SELECT line_no // 1000 AS chunk, count(*) AS n_lines, min(line_no) AS first_line FROM L GROUP BY 1")
def chunk_assign(spark, d):
    return _lines(spark, d).groupBy(archive.chunk_of(F.col("line_no"), 1000).alias("chunk")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def first_occurrence_dedupe(spark, d):
    return profile.first_occurrences(_table(spark, d, "events"), ["event_type"], "event_id").withColumnRenamed("first", "first_id")


@query(f"WITH {_D} SELECT file, line_no, raw FROM DT WHERE len(toks) < 5")
def failed_lines(spark, d):
    return _docs(spark, d).where(F.size("toks") < 5).select("file", "line_no", "raw")


def _seqs(spark, d):
    return sequences.windows(_matched(spark, d).select("file", "line_no", "eid"), 20)


_S = f"{_E}, C AS (SELECT line_no // 20 AS win, tid AS eid, count(*) AS tf FROM M GROUP BY ALL), Q AS (SELECT count(DISTINCT win) AS n FROM C), I AS (SELECT eid, ln((n + 1) / (count(*) + 1)) AS idf FROM C, Q GROUP BY eid, n), A AS (SELECT sum(idf) / (max(eid) + 1) AS m FROM I)"


@query(f"WITH {_E} SELECT line_no // 20 AS win, string_agg(tid, ',' ORDER BY line_no) AS eids FROM M GROUP BY 1")
def sequence_windows(spark, d):
    return _seqs(spark, d).select("win", F.array_join(F.transform("eids", lambda e: e.cast("string")), ",").alias("eids"))


@query(f"WITH {_S} SELECT win, CAST(eid AS INTEGER) AS eid, tf FROM C")
def sequence_tf(spark, d):
    return sequences.term_counts(_seqs(spark, d)).drop("file")


@query(f"WITH {_S} SELECT CAST(eid AS INTEGER) AS eid, round(idf, 9) AS idf, round(1 / (1 + exp(m - idf)), 9) AS weight FROM I, A")
def sequence_idf(spark, d):
    s = _seqs(spark, d)
    return sequences.weights(sequences.term_counts(s), s).select("eid", F.round("idf", 9).alias("idf"), F.round("weight", 9).alias("weight"))


@query(f"WITH {_S} SELECT win, CAST(eid AS INTEGER) AS eid, round(tf / (1 + exp(m - idf)), 8) AS x FROM C JOIN I USING (eid), A")
def sequence_vectors(spark, d):
    return sequences.vectors(_seqs(spark, d)).select("win", "eid", F.round("x", 8).alias("x"))


def _points(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT a.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 6) AS dist FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def vector_distance(spark, d):
    p = _points(spark, d)
    one = p.where("id = 0").select(F.col("v").alias("w"))
    return p.join(F.broadcast(one)).select("id", F.round(sequences.distance("v", "w"), 6).alias("dist"))  # one row


@query("""WITH x AS (SELECT a.vec_id AS id, b.vec_id AS c, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS d FROM embeddings a, embeddings b WHERE b.vec_id < 8)
SELECT id, arg_min(c, (round(d, 9), c)) AS c, round(min(d), 6) AS d FROM x WHERE d < 100 GROUP BY id""")
def nearest_centroid(spark, d):
    p = _points(spark, d)
    centers = p.where("id < 8").select(F.col("id").alias("c"), F.col("v").alias("center"))
    return sequences.nearest(p, centers, 100.0).select("id", "c", F.round("d", 6).alias("d"))


@query()
def hac_clusters(spark, d):
    assigned, _ = sequences.cluster(_points(spark, d), sequences.Sampling(rate=0.05, candidates=60, threshold=_threshold(spark, d)))
    return assigned


@query()
def balanced_sample(spark, d):
    options = sequences.Sampling(rate=0.05, candidates=60, threshold=_threshold(spark, d))
    return sequences.balanced(sequences.cluster(_points(spark, d), options)[0], options)


def _threshold(spark, d) -> float:
    """The root mean square distance between two points: twice the mean square distance from the mean, of all points."""
    cells = _points(spark, d).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s"))
    return float((2 * (cells.agg(F.sum("s")).first()[0] or 0.5)) ** 0.5)


# Lines that are not all alike: from line 1000 on, of every 50 one is too short, one has a header alone, one no
# template, one a word where all others have a number, one a double space.
_X = f"""{_E}, Y AS (SELECT *, CASE WHEN line_no >= 1000 THEN line_no % 50 ELSE -1 END AS r, array_to_string(toks[1:5], ' ') AS h FROM M),
X AS (SELECT line_no, tid, toks, r, CASE r WHEN 0 THEN 'orphan ' || line_no WHEN 1 THEN h WHEN 2 THEN h || ' unknown thing ' || line_no
 WHEN 3 THEN h || ' user bob ' || array_to_string(toks[8:], ' ') WHEN 4 THEN h || '  ' || array_to_string(toks[6:], ' ') ELSE raw END AS line FROM Y)"""


def _mixed(spark, d):
    rows = mining.parsed(_lines(spark, d))
    r = F.when(F.col("line_no") >= 1000, F.col("line_no") % 50).otherwise(-1)
    h, own = F.array_join("header", " "), F.array_join("content", " ")
    after = F.array_join(F.slice("content", 3, 100), " ")
    line = F.when(r == 0, F.concat(F.lit("orphan "), F.col("line_no"))).when(r == 1, h).when(r == 2, F.concat(h, F.lit(" unknown thing "), F.col("line_no"))).when(r == 3, F.concat(h, F.lit(" user bob "), after)).when(r == 4, F.concat(h, F.lit("  "), own)).otherwise(F.col("raw"))
    return rows.select("file", "line_no", line.alias("raw"))


@query(f"WITH {_X} SELECT line_no, CAST(CASE WHEN r = 0 THEN -1 WHEN r IN (1, 2) THEN 0 ELSE tid END AS INTEGER) AS eid, CASE WHEN r IN (0, 1, 2) THEN '' WHEN r = 3 THEN array_to_string(['bob', toks[11], toks[13]], '|') ELSE array_to_string([toks[7], toks[11], toks[13]], '|') END AS vars FROM X")
def mixed_eids(spark, d):
    lines = _mixed(spark, d)
    return mining.match(lines, mining.train(lines)).select("line_no", "eid", F.coalesce(F.array_join("vars", "|"), F.lit("")).alias("vars"))


@query(f"WITH {_X} SELECT line_no, CAST(CASE WHEN r = 0 THEN -1 WHEN r IN (1, 2) THEN 0 ELSE tid END AS INTEGER) AS eid FROM X")
def mixed_eids_by_prefix(spark, d):
    """As a model too large to broadcast is matched: joins by prefix, and walks of the prefixes that are no path."""
    lines = _mixed(spark, d)
    return mining.match(lines, mining.train(lines), small=0).select("line_no", "eid")


@query(f"WITH {_X} SELECT line_no, CASE WHEN r = 0 THEN 'load' ELSE 'match' END AS kind, line AS raw FROM X WHERE r IN (0, 1, 2, 4)")
def mixed_failed(spark, d):
    return archive.tables(_mixed(spark, d))["failed"].select("line_no", "kind", "raw")


@query(f"WITH {_X} SELECT line_no, line AS raw FROM X")
def mixed_restored(spark, d):
    return archive.restore(archive.tables(_mixed(spark, d))).select("line_no", "raw")


@query(f"WITH {_X} SELECT 'events.log' AS file, line_no, line AS raw FROM X")
def container_roundtrip(spark, d):
    return container.decode(container.encode(_mixed(spark, d), chunk_lines=1000))


@query(f"WITH {_L} SELECT * FROM L")
def container_raw_roundtrip(spark, d):
    return container.decode(container.encode(_lines(spark, d), backend="gzip", analysed=False))


@query(f"""WITH {_X} SELECT 'events.log' AS file, line_no // 1000 AS chunk, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes,
CAST(count(DISTINCT CASE WHEN r NOT IN (0, 1, 2, 4) THEN tid END) AS INTEGER) AS n_templates, CAST(count(*) FILTER (r = 0) AS INTEGER) AS n_load, CAST(count(*) FILTER (r IN (1, 2, 4)) AS INTEGER) AS n_match FROM X GROUP BY ALL""")
def container_listing(spark, d):
    found = container.listing(container.encode(_mixed(spark, d), backend="none", chunk_lines=1000))
    return found.select("file", F.col("chunk"), "n_lines", "n_bytes", F.col("n_templates").cast("int").alias("n_templates"), F.col("n_load").cast("int").alias("n_load"), F.col("n_match").cast("int").alias("n_match"))


@query(f"WITH {_P} SELECT kind, CAST(tid AS INTEGER) AS tid, CAST(col AS INTEGER) AS col, encoding, n FROM P")
def container_columns(spark, d):
    """The encodings as they are stored, all lines in one chunk."""
    return container.columns(container.encode(_lines(spark, d), chunk_lines=1 << 31)).select("kind", "tid", "col", "encoding", "n")


@query(f"WITH {_L}, B AS (VALUES ('none'), ('gzip'), ('zstd')) SELECT col0 AS backend, count(*) AS n_lines, CAST(sum(strlen(raw)) AS BIGINT) AS n_bytes, min(raw) AS low, max(raw) AS high FROM L, B GROUP BY 1")
def archive_backends(spark, d):
    """Written to and read from files, with every backend."""
    out = None
    for backend in archive.CODECS:
        path = files.scratch(spark, "archive")
        archive.write(_lines(spark, d), path, backend)
        back = archive.read(spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("raw")).alias("n_bytes"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        back = back.select(F.lit(backend).alias("backend"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"WITH {_T} SELECT toks[4] || '.log' AS name, row_number() OVER (PARTITION BY toks[4] ORDER BY line_no) - 1 AS line_no, raw FROM T")
def read_files(spark, d):
    """A file for each service, written in the order of the lines, read with their numbers."""
    path = files.scratch(spark, "files")
    rows = mining.parsed(_lines(spark, d)).select(F.concat(F.lit("logs/"), F.element_at("toks", 4), F.lit(".log")).alias("file"), "line_no", "raw")
    archive.to_text(rows, path)
    back = files.read_lines(spark, path, recursive=True, glob="*")
    back = back.withColumn("name", F.regexp_extract("file", r"(svc-[0-9]+\.log)", 1))
    place = F.row_number().over(Window.partitionBy("name").orderBy("file", "line_no")) - 1  # a file of several tasks is a folder of parts
    return back.select("name", place.cast("long").alias("line_no"), "raw")


_FLOAT = "'^([+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?|0x([0-9a-f]+\\.?[0-9a-f]*|\\.[0-9a-f]+)p[+-]?[0-9]+|inf(inity)?)|nan)$', 'i'"


@query(f"WITH {_D} SELECT t AS token, regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') AS is_numeric, regexp_matches(t, {_FLOAT}) AS is_float, CASE WHEN regexp_matches(t, {_FLOAT}) THEN coalesce(TRY_CAST(t AS DOUBLE), 0.0) ELSE 0.0 END AS number FROM (SELECT DISTINCT unnest(toks) AS t FROM DT)")
def numeric_tokens(spark, d):
    t = _docs(spark, d).select(F.explode("toks").alias("token")).distinct()
    return t.select("token", text.is_numeric(F.col("token")).alias("is_numeric"), text.is_float(F.col("token")).alias("is_float"), text.parse_number(F.col("token")).alias("number"))


@query("SELECT o_orderkey AS id, printf('%.6f', o_totalprice) AS price, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders")
def format_fields(spark, d):
    o = _table(spark, d, "orders")
    own = lambda c, f: text.format_field(F.col(c).cast("string"), F.lit(f))
    return o.select(F.col("o_orderkey").alias("id"), own("o_totalprice", "%f").alias("price"), own("o_custkey", "%d").alias("cust"), own("o_orderstatus", "%s").alias("status"))


@query(f"WITH {_T} SELECT file, line_no, array_to_string(toks[1:5], ' ') || ' ' AS formatted FROM T")
def format_headers(spark, d):
    lines = _lines(spark, d)
    return profile.formatted_headers(mining.parsed(lines), profile.header_schema(lines))


@query(f"WITH {_T} SELECT 'events.log' AS file, CAST(max(strlen(toks[5])) * 5 * 4 AS INTEGER) AS bits FROM T WHERE line_no < 1000")
def header_bits(spark, d):
    return profile.bit_width(profile.header_schema(_lines(spark, d)))


@query(f"WITH {_E} SELECT CAST(tid AS INTEGER) AS tid, '1,5,7' AS positions FROM first")
def template_wildcards(spark, d):
    return mining.train(_lines(spark, d)).templates.select("tid", F.array_join(mining.wildcards("tokens").cast("array<string>"), ",").alias("positions"))


_I = "I AS (SELECT o_orderkey AS id, ((o_orderkey * o_custkey * 104729 + 2147483648) % 4294967296) - 2147483648 AS n FROM orders)"


def _ints(spark, d):
    """Numbers of 32 bits, some of them negative."""
    n = text.wrap32(F.col("o_orderkey") * F.col("o_custkey") * 104729)
    return _table(spark, d, "orders").select(F.lit(1).alias("k"), F.col("o_orderkey").alias("line_no"), n.cast("string").alias("value"), n.alias("n"))


@query(f"WITH {_I}, J AS (SELECT id, n - lag(n, 1, 0) OVER (ORDER BY id) AS d FROM I) SELECT id AS line_no, ((d + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS d FROM J")
def delta_encode_32(spark, d):
    return profile.deltas32(_ints(spark, d).drop("n"), ["k"]).select("line_no", "d")


@query(f"WITH {_I} SELECT id AS line_no, n AS v FROM I")
def delta_decode_32(spark, d):
    return profile.delta_decode32(profile.deltas32(_ints(spark, d).drop("n"), ["k"]), ["k"]).select("line_no", "v")


@query(f"""WITH {_I}, Z AS (SELECT id, n, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z FROM I)
SELECT id, CASE WHEN z < 128 THEN printf('%02X', z) WHEN z < 16384 THEN printf('%02X%02X', z % 128 + 128, z // 128) WHEN z < 2097152 THEN printf('%02X%02X%02X', z % 128 + 128, z // 128 % 128 + 128, z // 16384)
WHEN z < 268435456 THEN printf('%02X%02X%02X%02X', z % 128 + 128, z // 128 % 128 + 128, z // 16384 % 128 + 128, z // 2097152)
ELSE printf('%02X%02X%02X%02X%02X', z % 128 + 128, z // 128 % 128 + 128, z // 16384 % 128 + 128, z // 2097152 % 128 + 128, z // 268435456) END AS bytes, n AS back FROM Z""")
def varint_bytes(spark, d):
    rows = _ints(spark, d).withColumn("b", text.varint(F.col("n")))
    return rows.select(F.col("line_no").alias("id"), F.hex("b").alias("bytes"), text.read_varint(F.col("b")).alias("back"))


@query("""SELECT o_orderkey AS id, printf('%02X%02X', o_custkey % 256, o_custkey // 256 % 256) AS b2, printf('%02X%02X%02X%02X', o_custkey % 256, o_custkey // 256 % 256, o_custkey // 65536 % 256, o_custkey // 16777216 % 256) AS b4,
printf('%02X%02X%02X%02X', o_custkey % 256, o_custkey // 256 % 256, o_custkey // 65536 % 256, o_custkey // 16777216 % 256) || '00000000' AS b8, o_custkey AS back FROM orders""")
def fixed_bytes(spark, d):
    o, n = _table(spark, d, "orders"), F.col("o_custkey")
    b = {f"b{size}": F.hex(text.fixed(n, size)) for size in (2, 4, 8)}
    return o.select(F.col("o_orderkey").alias("id"), *(v.alias(k) for k, v in b.items()), text.read_fixed(text.fixed(n, 8), 8).alias("back"))


@query("SELECT page_id, printf('%02X%02X', strlen(url) % 256, strlen(url) // 256) || hex(encode(url)) AS bytes, url AS back FROM pages")
def short_strings(spark, d):
    p = _table(spark, d, "pages").withColumn("b", text.short_string(F.col("url")))
    return p.select("page_id", F.hex("b").alias("bytes"), text.read_short_string(F.col("b")).alias("back"))


def _made(spark, d):
    """Columns of known delimiters: high in distinct values and splitting, low in them, one delimiter, no literal pattern."""
    key = F.col("o_orderkey").cast("string")
    own = {"shard": F.concat(F.lit("shard::"), key), "priority": F.col("o_orderpriority"), "key": F.concat(F.lit("k."), key), "apart": F.concat(F.lit("a-"), key, F.lit("/b"))}
    cells = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in own.items()))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.explode(cells).alias("c")).select("c.k", "line_no", "c.value")


@query("""SELECT k, n, CASE WHEN k = 'priority' THEN p ELSE n END AS n_distinct, CASE WHEN k = 'shard' THEN '::' ELSE '' END AS pattern, CASE k WHEN 'shard' THEN 'pattern' WHEN 'priority' THEN 'dict' ELSE 'none' END AS verdict, CAST(CASE WHEN k = 'shard' THEN 2 ELSE 1 END AS INTEGER) AS parts
FROM (SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS p FROM orders), (VALUES ('shard'), ('priority'), ('key'), ('apart')) AS x(k)""")
def column_analysis(spark, d):
    return patterns.analyse(_made(spark, d), ["k"])


@query("SELECT 'shard' AS k, CAST(0 AS INTEGER) AS sub, o_orderkey AS line_no, 'shard' AS value FROM orders UNION ALL SELECT 'shard', 1, o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders")
def pattern_subfields(spark, d):
    rows = _made(spark, d)
    return patterns.subfields(rows, patterns.analyse(rows, ["k"]), ["k"])


@query("SELECT CAST(0 AS INTEGER) AS sub, count(*) AS n, CAST(1 AS BIGINT) AS n_distinct, 'dict' AS encoding FROM orders UNION ALL SELECT 1, count(*), count(DISTINCT o_orderkey), 'delta' FROM orders")
def subfield_profile(spark, d):
    """Sub-columns by the rule of columns: the first repeats one word, the second counts up."""
    rows = _made(spark, d)
    parts = patterns.subfields(rows, patterns.analyse(rows, ["k"]), ["k"])
    return profile.profile(parts, ["k", "sub"]).select("sub", "n", "n_distinct", "encoding")


@query("SELECT k, p AS pattern FROM (VALUES ('date', '--'), ('price', ''), ('mixed', '-/'), ('nested', '[(::)]')) AS x(k, p)")
def delimiter_lcs_known(spark, d):
    """Columns whose longest common subsequence of delimiters is known from how they are made."""
    o, odd = _table(spark, d, "orders"), F.col("o_orderkey") % 2 == 1
    key = F.col("o_orderkey").cast("string")
    own = {"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "price": F.concat(key, F.lit(".5")), "mixed": F.concat(F.lit("a-b/"), F.when(odd, F.concat(F.lit("c."), key)).otherwise(key)), "nested": F.concat(F.when(odd, "#").otherwise(""), F.lit("[("), key, F.lit("::x)]"))}
    cells = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in own.items()))
    rows = o.select(F.col("o_orderkey").alias("line_no"), F.explode(cells).alias("c")).select("c.k", "line_no", "c.value")
    return patterns.column_patterns(rows, ["k"])


def _blobs(spark, d):
    """Points in three groups that lie far apart."""
    k = F.col("o_orderkey")
    return _table(spark, d, "orders").select(k.alias("id"), F.array((k % 3 * 1000).cast("double"), (F.col("o_custkey") % 10).cast("double") / 10).alias("v"))


_BLOBS = sequences.Sampling(rate=0.05, candidates=60, threshold=5.0)


@query("SELECT o_orderkey AS id, o_orderkey % 3 AS rep FROM orders")
def hac_groups(spark, d):
    """Clusters by their least members: the groups the points were made in."""
    assigned, _ = sequences.cluster(_blobs(spark, d), _BLOBS)
    return assigned.join(assigned.groupBy("c").agg(F.min("id").alias("rep")), "c").select("id", "rep")


@query("SELECT g, CAST(20 AS BIGINT) AS n FROM (VALUES (0), (1), (2)) AS x(g)")
def balanced_groups(spark, d):
    picked = sequences.balanced(sequences.cluster(_blobs(spark, d), _BLOBS)[0], _BLOBS)
    return picked.groupBy((F.col("id") % 3).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(1 AS BIGINT) AS n, true AS alone")
def sequence_sample_alone(spark, d):
    """Fewer windows than candidates are not clustered: one is picked."""
    picked = sequences.sample(_matched(spark, d).select("file", "line_no", "eid"), sequences.Sampling(candidates=1 << 30))
    return picked.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("c").isNull()).alias("alone"))


@query()
def sequence_sample(spark, d):
    return sequences.sample(_matched(spark, d).select("file", "line_no", "eid"), sequences.Sampling(candidates=20))
