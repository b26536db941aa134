"""Queries over the text jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import textjobs
from .contract import query
from .inputs import (
    DIALOGUES, ERROR_LINES, ERROR_RULES, ERROR_TEXTS, PART_LINES, PART_RULES, REPLIES, REQUESTS, RUN_HEADER, RUN_LINES, table,
)

_TABLE = "lake.sales.events"
_COMPARED = textjobs.COMPARISON.removeprefix("(?U)")
_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "user_id")] + [T.StructField("event_type", T.StringType())])
_NULLS = "SELECT " + ", ".join(f"COUNT(*) - COUNT(`{f.name}`) AS `{f.name}`" for f in _SCHEMA) + f" FROM {_TABLE}"


def _route_oracle(compat: bool) -> str:
    extra = "" if compat else "when u like '%null values%' then 'null_check'"
    year, limit = ("'year'", " || ' LIMIT 50'") if compat else ("c", "")
    return f"""
    with d as ({REQUESTS.sql()}),
    m as (select event_id, request, lower(request) as u, regexp_extract(lower(request), '{_COMPARED}', 1) as c,
        regexp_extract(lower(request), '{_COMPARED}', 2) as v,
        coalesce(nullif(regexp_extract(request, '\\d+', 0), ''), '10') as n from d),
    r as (select *, case when c <> '' and contains(c, 'year') then 'fiscal_after' when c <> '' then 'where_above' {extra}
        when u like '%snapshot%' or u like '%version%' or u like '%history%' then 'snapshots'
        when u like '%count%' or u like '%how many%' or u like '%total%' then 'row_count'
        when u like '%schema%' or u like '%describe%' or u like '%columns%' then 'describe'
        else 'top_n' end as intent from m)
    select event_id, request, intent,
      case when intent in ('fiscal_after', 'where_above') then c end as "column",
      case when intent in ('fiscal_after', 'where_above') then v when intent = 'top_n' then n end as value,
      case intent
        when 'fiscal_after' then 'SELECT * FROM {_TABLE} WHERE SUBSTR(' || {year} || ',1,4) > ''' || v || ''''{limit}
        when 'where_above' then 'SELECT * FROM {_TABLE} WHERE ' || c || ' > ' || v{limit}
        when 'snapshots' then
          'SELECT snapshot_id,committed_at,operation FROM {_TABLE}.snapshots ORDER BY committed_at DESC'
        when 'null_check' then '{_NULLS}'
        when 'row_count' then 'SELECT COUNT(*) as total_rows FROM {_TABLE}'
        when 'describe' then 'DESCRIBE TABLE {_TABLE}'
        when 'top_n' then 'SELECT * FROM {_TABLE} LIMIT ' || n end as sql,
      case intent when 'fiscal_after' then 'Year above ' || v when 'where_above' then c || ' > ' || v
        when 'null_check' then 'Missing values of each column'
        when 'snapshots' then 'Show snapshots' when 'row_count' then 'Count rows' when 'describe' then 'Show schema'
        when 'top_n' then 'Show top ' || n || ' rows' end as explanation
    from r"""


@query("route_requests", _route_oracle(compat=True))
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.route_requests(REQUESTS.frame(spark, sf_dir), "request", _TABLE, compat=True)


@query("route_requests_strict", _route_oracle(compat=False))
def route_requests_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.route_requests(REQUESTS.frame(spark, sf_dir), "request", _TABLE, columns=_SCHEMA)


_PARSED = f"""
    with r as ({REPLIES.sql()}), j as (
      select event_id, case when json_valid(reply) then reply
        when regexp_matches(reply, '(?s)\\{{.*\\}}') then regexp_extract(reply, '(?s)\\{{.*\\}}', 0) end as doc from r),
    p as (select event_id, json_extract_string(doc, '$.sql') as sql,
      json_extract_string(doc, '$.explanation') as explanation,
      coalesce(json_extract_string(doc, '$.is_destructive') in ('true', '1')
        or json_extract_string(doc, '$.sql') not like 'SELECT%', false) as is_destructive,
      json_extract_string(doc, '$.warning') as warning from j)"""


@query("parse_replies", f"{_PARSED} select *, sql is not null as is_valid from p")
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.parse_replies(REPLIES.frame(spark, sf_dir), "reply").drop("reply")


@query("qualify_sql", f"{_PARSED} select event_id, replace(sql, 'events', '{_TABLE}') as sql from p")
def qualify_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = textjobs.parse_replies(REPLIES.frame(spark, sf_dir), "reply").select("event_id", "sql")
    return textjobs.qualify_sql(parsed, "sql", "events", _TABLE)


@query("resolve_requests", f"""
    with routed as ({_route_oracle(compat=True)}), parsed as ({_PARSED} select * from p)
    select event_id, coalesce(replace(p.sql, 'events', '{_TABLE}'), r.sql) as sql,
      case when p.sql is null then r.explanation else p.explanation end as explanation,
      p.sql is not null and is_destructive as is_destructive,
      case when p.sql is null then '' else p.warning end as warning, p.sql is not null as is_valid
    from routed r join parsed p using (event_id)""")
def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = textjobs.resolve_requests(DIALOGUES.frame(spark, sf_dir), "request", "reply", "events", _TABLE)
    return resolved.drop("request", "reply")


@query("last_turns", """
    select conv_id, count(*) as turns, string_agg(turn || ' ' || role || ': ' || text, chr(10) order by turn) as context
    from (select *, row_number() over (partition by conv_id order by turn desc) as newest from conversations) c
    where newest <= 8 group by conv_id""")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = textjobs.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    line = lambda t: F.concat(t["turn"].cast("string"), F.lit(" "), t["role"], F.lit(": "), t["text"])
    return turns.select("conv_id", F.size("context").cast("bigint").alias("turns"),
                        F.array_join(F.transform("context", line), "\n").alias("context"))


_RULES = ", ".join(
    "({}, '{}', '{}', '{}')".format(i, *(part.replace("'", "''") for part in rule)) for i, rule in enumerate(ERROR_RULES))


@query("match_rules", f"""
    with d as ({ERROR_LINES.sql()}), rules(rule_no, pattern, fix, note) as (values {_RULES})
    select event_id, message, arg_min(fix, rule_no) as fix, arg_min(note, rule_no) as fix_message
    from d left join rules on contains(lower(message), lower(pattern)) group by event_id, message""")
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.match_rules(ERROR_LINES.frame(spark, sf_dir), "message", ERROR_RULES)


@query("match_rule_list", f"""
    with d as ({PART_LINES.sql()}),
    rules as (select pattern, min(p_type) as fix, cast(max(p_size) as varchar) as note, row_number() over (order by pattern desc) as rule_no
      from ({PART_RULES.sql()}) r group by pattern)
    select p_partkey, message, arg_min(fix, rule_no) as fix, arg_min(note, rule_no) as fix_message
    from d left join rules on contains(lower(message), lower(pattern)) group by p_partkey, message""")
def match_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each name and brand of a part: as many as these words make, whatever the number of parts."""
    found = PART_RULES.frame(spark, sf_dir).groupBy("pattern").agg(F.min("p_type").alias("fix"), F.max("p_size").cast("string").alias("note"))
    rules = [tuple(r) for r in found.orderBy(F.desc("pattern")).collect()]
    return textjobs.match_rule_list(PART_LINES.frame(spark, sf_dir), "message", rules)


def _status_oracle(start: int, end: int) -> str:
    fields = ", ".join(f"trim(split_part(line, '|', {i + 1})) as f{i}" for i in range(6))
    return f"""
    with d as ({RUN_LINES.sql()}), f as (select event_id, lower(line) as l, line not like '%scheduled%' as state_known, {fields} from d)
    select f0 as job, case when l like '%success%' then 'success' when l like '%failed%' then 'failed'
        when l like '%running%' then 'running' when l like '%queued%' then 'queued'
        when l like '%up_for_retry%' then 'up_for_retry' else 'unknown' end as state,
      case when state_known then f1 else '' end as run_id, case when state_known then f{start} else '' end as start_date,
      case when state_known then f{end} else '' end as end_date
    from (select *, row_number() over (partition by f0 order by state_known desc, event_id desc) as newest from f) n where newest = 1"""


@query("run_status", _status_oracle(3, 4))
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.run_status(RUN_LINES.frame(spark, sf_dir), "line", "event_id")


@query("run_status_by_header", _status_oracle(4, 5))
def run_status_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.run_status(RUN_LINES.frame(spark, sf_dir), "line", "event_id", header=RUN_HEADER)


@query("error_tail", "select doc_id, replace(right(text, 4000), '\"', '\\\"') as tail from documents")
def error_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.error_tail(table(spark, sf_dir, "documents"), "text").select("doc_id", "tail")


@query("last_error", f"""
    with d as ({ERROR_TEXTS.sql()})
    select event_id, coalesce(trim([l for l in string_split(output, chr(10)) if trim(l) <> ''
      and not contains(l, 'Warning') and not contains(l, 'graphviz') and not contains(l, 'INFO')][-1]),
      'Trigger failed') as last_error from d""")
def last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.last_error(ERROR_TEXTS.frame(spark, sf_dir), "output").drop("output")
