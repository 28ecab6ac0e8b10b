"""Queries on script texts, cards and windows over the documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards as C
from ..registry import query
from ..sources.tables import table
from .statistics import FEATURES_SQL, order_features

#: Documents stand for scripts; comments and engine-specific syntax are added by rule.
SCRIPT_SQL = r"""
s AS (SELECT doc_id, text || E'\n-- ' || lang || ' = comment\n\n/* ' || source || E'\n*/ ' ||
        CASE doc_id % 6 WHEN 0 THEN 'GROUP BY ROLLUP (a)' WHEN 1 THEN 'select TOP 5 `x y`' WHEN 2 THEN 'd + INTERVAL ''3'' day' WHEN 3 THEN 'nvl (a, 1) = 2' WHEN 4 THEN 'qualify rownum (+)' ELSE 'listagg(x) -- cube (' END AS sql FROM documents)
"""
SCRIPT_SQL = SCRIPT_SQL.replace("' = comment\\n\\n/* '", "E' = comment\\n\\n/* '")
_TAILS = ("GROUP BY ROLLUP (a)", "select TOP 5 `x y`", "d + INTERVAL '3' day", "nvl (a, 1) = 2", "qualify rownum (+)", "listagg(x) -- cube (")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), (F.col("doc_id") % 6).cast("int"))
    return docs.select("doc_id", F.concat("text", F.lit("\n-- "), "lang", F.lit(" = comment\n\n/* "), "source", F.lit("\n*/ "), tail).alias("sql"))


_STRIPPED = r"regexp_replace(sql, '(?s)--[^\n]*|/\*.*?\*/', '', 'g')"
_LINES = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '')"
_WORDS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
_TOKENS = "CAST(floor(len({w}) * 1.3::DOUBLE + len(list_filter({w}, lambda v: regexp_matches(v, '[0-9=]')))) AS BIGINT)"


def _tokens(t: str) -> str:
    return _TOKENS.format(w=_WORDS.format(t=t))


@query("line_counts", f"WITH {SCRIPT_SQL} SELECT doc_id, CAST(len({_LINES.format(t='sql')}) AS BIGINT) AS loc, CAST(len({_LINES.format(t=_STRIPPED)}) AS BIGINT) AS loc_code, length(sql) AS chars FROM s")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sql")
    return scripts(spark, sf_dir).select("doc_id", T.line_count(s).alias("loc"), T.line_count(T.strip_comments(s)).alias("loc_code"), F.length(s).cast("long").alias("chars"))


@query("comment_strip", f"WITH {SCRIPT_SQL} SELECT doc_id, md5({_STRIPPED}) AS stripped FROM s")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("doc_id", F.md5(T.strip_comments(F.col("sql"))).alias("stripped"))


@query("token_estimate", f"WITH {SCRIPT_SQL} SELECT doc_id, {_tokens('sql')} AS tokens, {_tokens('sql')} <= 380 AS within_budget FROM s")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("doc_id", T.token_estimate(F.col("sql")).alias("tokens")).withColumn("within_budget", F.col("tokens") <= C.BUDGET)


_MARKER_SQL = ", ".join("CASE WHEN regexp_matches(lower({}), '{}') THEN '{}' END".format(_STRIPPED, p.replace("'", "''"), n) for n, p in T.MARKERS)


@query("markers_regexp", f"WITH {SCRIPT_SQL} SELECT doc_id, concat_ws('|', {_MARKER_SQL}) AS markers FROM s")
def markers_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("doc_id", F.concat_ws("|", T.markers(F.col("sql"))).alias("markers"))


WINDOWS_SQL = f"""{SCRIPT_SQL},
l AS (SELECT doc_id, {_LINES.format(t=_STRIPPED)} AS ls FROM s),
c AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
k AS (SELECT doc_id, i, greatest(1, {_tokens('line')}) AS cost FROM c),
w AS (SELECT doc_id, i, cost AS used, CAST(0 AS BIGINT) AS win FROM k WHERE i = 1
      UNION ALL SELECT k.doc_id, k.i, CASE WHEN w.used + k.cost <= 380 THEN w.used + k.cost ELSE k.cost END, CASE WHEN w.used + k.cost <= 380 THEN w.win ELSE w.win + 1 END
      FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1),
g AS (SELECT w.doc_id, w.win, string_agg(c.line, chr(10) ORDER BY w.i) AS txt, count(*) AS n FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY 1, 2)"""


@query("chunk_windows", f"""WITH RECURSIVE {WINDOWS_SQL}
SELECT doc_id, win AS window_, md5(txt) AS text_md5, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'Fragment ' || (win + 1) || ' of ' || count(*) OVER (PARTITION BY doc_id) || ' of one SQL script.' END AS note FROM g""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.each_window(scripts(spark, sf_dir), "doc_id", T.windows(F.col("sql")))
    return rows.select("doc_id", F.col("window").cast("long").alias("window_"), F.md5("sql").alias("text_md5"), T.window_note(F.col("window"), F.col("n")).alias("note"))


#: Orders stand for scripts again; the features of a card are taken from their counts.
_CARD_SQL = """
k AS (SELECT name, quantity AS loc_code, 1 + name % 2 AS statements, n_suppliers AS source_tables, greatest(n_suppliers - 1, 0) AS graph_edges, n_suppliers AS graph_max_scope_sources,
             n_returned AS subquery_count, CASE WHEN n_returned > 1 THEN n_returned - 1 ELSE 0 END AS correlated_subquery_count, name % 3 AS cte_count, n_lines % 2 AS window_function_count,
             n_parts % 4 AS set_operation_count, n_lines AS case_expression_count, name % 4 AS max_nesting_depth FROM f)
"""


def _card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_features(spark, sf_dir)
    return f.selectExpr(
        "name", "quantity AS loc_code", "1 + name % 2 AS statements", "n_suppliers AS source_tables", "greatest(n_suppliers - 1, 0) AS graph_edges", "n_suppliers AS graph_max_scope_sources",
        "n_returned AS subquery_count", "CASE WHEN n_returned > 1 THEN n_returned - 1 ELSE 0 END AS correlated_subquery_count", "name % 3 AS cte_count", "n_lines % 2 AS window_function_count",
        "n_parts % 4 AS set_operation_count", "n_lines AS case_expression_count", "name % 4 AS max_nesting_depth", "'star' AS widest_scope_shape",
        "CASE WHEN name % 5 = 0 THEN array('rollup', 'nvl_fn') END AS nonportable_markers",
    )


_FACT_SQL = " || ' ' || ".join(f"'{k}=' || {c}" for k, c in C.FACTS)


@query("card_facts", f"WITH {FEATURES_SQL}, {_CARD_SQL} SELECT name, {_FACT_SQL} AS facts FROM k")
def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(_card_features(spark, sf_dir)).select("name", "facts")


def _count_sql(c: str, noun: str) -> str:
    many = noun[:-1] + "ies" if noun.endswith("y") else noun + "s"
    return f"{c} || CASE WHEN {c} = 1 THEN ' {noun}' ELSE ' {many}' END"


def _list_sql(items: str, word: str) -> str:
    return f"CASE WHEN len({items}) <= 1 THEN coalesce({items}[1], '') ELSE array_to_string({items}[1:len({items}) - 1], ', ') || ' {word} ' || {items}[len({items})] END"


_PRESENT = "list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN {_count_sql(c, n)} END" for n, c in C.PARTS) + "], lambda x: x IS NOT NULL)"
_ABSENT = "list_filter([" + ", ".join(f"CASE WHEN {c} = 0 THEN '{n}' END" for n, c in C.PARTS) + "], lambda x: x IS NOT NULL)"


@query("card_structure", f"""WITH {FEATURES_SQL}, {_CARD_SQL}, x AS (SELECT *, {_PRESENT} AS present, {_ABSENT} AS absent FROM k)
SELECT name, concat_ws(' ', {_count_sql('statements', 'statement')} || ' in the file.',
  'Reads ' || {_count_sql('source_tables', 'source table')} || ', joined in a star shape with ' || {_count_sql('graph_edges', 'join predicate')} || '.',
  CASE WHEN len(present) > 0 THEN 'Uses ' || {_list_sql('present', 'and')} || '.' END, CASE WHEN len(absent) > 0 THEN 'No ' || {_list_sql('absent', 'or')} || '.' END,
  CASE WHEN correlated_subquery_count > 0 THEN {_count_sql('correlated_subquery_count', 'subquery')} || ' correlated with the outer query.' END,
  CASE WHEN max_nesting_depth > 0 THEN 'Nests ' || {_count_sql('max_nesting_depth', 'level')} || ' deep.' END,
  CASE WHEN name % 5 = 0 THEN 'Engine-specific syntax: rollup, nvl_fn.' END) AS structure FROM x""")
def card_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(_card_features(spark, sf_dir)).select("name", "structure")


@query("card_budget", f"""WITH {FEATURES_SQL}, {_CARD_SQL}, y AS (SELECT name, {_FACT_SQL} AS facts FROM k)
SELECT name, {_tokens('facts')} AS fact_tokens FROM y""")
def card_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(_card_features(spark, sf_dir)).select("name", T.token_estimate(F.col("facts")).alias("fact_tokens"))
