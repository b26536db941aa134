"""Text jobs over tables of requests, replies, conversations, logs and run lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.text import error_tail as tail_of
from ..functions.text import last_error as last_error_of
from ..functions.text import quoted_regex, quoted_replacement, strip
from .querying import reads

# What a request must look like to be routed, and the SQL it becomes.
COMPARISON = r"(?U)(\w+)\s+(?:above|greater than|>)\s*(\d+)"
FIRST_NUMBER = r"(?U)\d+"
SNAPSHOT_WORDS = ("snapshot", "version", "history")
COUNT_WORDS = ("count", "how many", "total")
SCHEMA_WORDS = ("schema", "describe", "columns")
DEFAULT_LIMIT = "10"

# The rows that a routed filter shows, the SQL and the explanations.
SHOWN_ROWS = 50
FISCAL_SQL = ("SUBSTR(", ",1,4) > '", "'")
SNAPSHOTS_SQL = "SELECT snapshot_id,committed_at,operation FROM {table}.snapshots ORDER BY committed_at DESC"
COUNT_SQL = "SELECT COUNT(*) as total_rows FROM {table}"
DESCRIBE_SQL = "DESCRIBE TABLE {table}"
EXPLANATIONS = {"snapshots": "Show snapshots", "row_count": "Count rows", "describe": "Show schema"}

REPLY_SCHEMA = "sql string, explanation string, warning string"

# Run states in the order in which they are looked for.
RUN_STATES = ("success", "failed", "running", "queued", "up_for_retry")

RULE_BLOCK = 100
#: Bytes of patterns that go to every task.
RULE_BYTES = 64_000_000


def _has_any(text: Column, words: tuple[str, ...], whole_words: bool) -> Column:
    if whole_words:
        return text.rlike(r"(?U)\b(" + "|".join(words) + r")s?\b")
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _refuse_clash(df: DataFrame, added: tuple[str, ...] | list[str]) -> None:
    taken = sorted({c.lower() for c in df.columns} & set(added))
    if taken:
        raise ValueError(f"the table has columns of its own named {taken}")


ROUTED = ("intent", "column", "value", "sql", "explanation")


def _of_columns(columns: T.StructType, table: str, numeric: bool, measures: tuple[str, ...]) -> str:
    """A statement with some measures of each column, or of each numeric one."""
    names = [f.name for f in columns.fields if not numeric or isinstance(f.dataType, T.NumericType)]
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    parts = [m.format(c=q, n=n.replace("`", "``")) for n, q in zip(names, quoted) for m in measures]
    return f"SELECT {', '.join(parts) or 'COUNT(*) AS total_rows'} FROM {table}"


def route_requests(df: DataFrame, column: str, table: str, compat: bool = False, columns: T.StructType | None = None) -> DataFrame:
    """Route plain-language requests to a query shape.

    Adds ``intent``, ``column``, ``value``, ``sql`` and ``explanation``. With ``compat`` words match
    inside longer words ("count" in "country"), questions about nulls and
    statistics count as a count and a description, and a comparison on any column
    that holds "year" filters the column ``year``, and filters show SHOWN_ROWS. Without
    it, words match whole, nulls and statistics have routes of their own, for which
    ``columns`` gives the table's schema, the column named is used, and filters have
    no limit. A column of ``df`` that is named like an added one raises.
    """
    _refuse_clash(df, ROUTED)
    if not compat and columns is None:
        raise ValueError("the columns of the table are needed for null counts and statistics")
    read = df.withColumn("__request", F.lower(col(column))).withColumns({
        "__compared": F.regexp_extract("__request", COMPARISON, 1),
        "__number": F.regexp_extract("__request", COMPARISON, 2),
    })
    request, compared, number = F.col("__request"), F.col("__compared"), F.col("__number")
    first_number = F.regexp_extract(col(column), FIRST_NUMBER, 0)
    limit = F.coalesce(F.nullif(first_number, F.lit("")), F.lit(DEFAULT_LIMIT))

    routes: list[tuple[str, Column]] = [
        ("fiscal_after", (compared != "") & compared.contains("year")),
        ("where_above", compared != ""),
    ]
    if not compat:
        routes += [
            ("null_check", request.rlike(r"(?U)\bnulls?\b") & ~request.rlike(r"(?U)\bdelete\b")),
            ("numeric_stats", request.rlike(r"(?U)\b(statistics|stats|(min|max|avg)\b.*\b(min|max|avg))\b")),
        ]
    routes += [
        ("snapshots", _has_any(request, SNAPSHOT_WORDS, not compat)),
        ("row_count", _has_any(request, COUNT_WORDS, not compat)),
        ("describe", _has_any(request, SCHEMA_WORDS, not compat)),
    ]
    intent = reduce(lambda chain, r: chain.when(r[1], r[0]), routes[1:], F.when(routes[0][1], routes[0][0]))
    routed = read.withColumns({"intent": intent.otherwise("top_n"), "__limit": limit})

    kind = F.col("intent")
    filters = kind.isin("fiscal_after", "where_above")
    year = F.lit("year") if compat else compared
    fiscal = F.concat(F.lit(FISCAL_SQL[0]), year, F.lit(FISCAL_SQL[1]), number, F.lit(FISCAL_SQL[2]))
    above = F.concat(compared, F.lit(" > "), number)
    sql = (
        F.when(filters, F.concat(F.lit(f"SELECT * FROM {table} WHERE "),
                                 F.when(kind == "fiscal_after", fiscal).otherwise(above),
                                 F.lit(f" LIMIT {SHOWN_ROWS}" if compat else "")))
        .when(kind == "snapshots", F.lit(SNAPSHOTS_SQL.format(table=table)))
        .when(kind == "row_count", F.lit(COUNT_SQL.format(table=table)))
        .when(kind == "describe", F.lit(DESCRIBE_SQL.format(table=table)))
        .when(kind == "top_n", F.concat(F.lit(f"SELECT * FROM {table} LIMIT "), F.col("__limit")))
    )
    explanation = (
        F.when(kind == "fiscal_after", F.concat(F.lit("Year above "), number))
        .when(kind == "where_above", above)
        .when(kind == "snapshots", EXPLANATIONS["snapshots"]).when(kind == "row_count", EXPLANATIONS["row_count"])
        .when(kind == "describe", EXPLANATIONS["describe"])
        .when(kind == "top_n", F.concat(F.lit("Show top "), F.col("__limit"), F.lit(" rows")))
    )
    if not compat:
        nulls = _of_columns(columns, table, False, ("COUNT(*) - COUNT({c}) AS {c}",))
        stats = _of_columns(columns, table, True, ("MIN({c}) AS `min_{n}`", "MAX({c}) AS `max_{n}`", "AVG({c}) AS `avg_{n}`"))
        sql = F.when(kind == "null_check", F.lit(nulls)).when(kind == "numeric_stats", F.lit(stats)).otherwise(sql)
        explanation = F.when(kind == "null_check", F.lit("Missing values of each column")).when(
            kind == "numeric_stats", F.lit("Range and average of each number column")).otherwise(explanation)
    return routed.withColumns({
        "column": F.when(filters, compared),
        "value": F.when(filters, number).when(kind == "top_n", F.col("__limit")),
        "sql": sql,
        "explanation": explanation,
    }).drop("__request", "__compared", "__number", "__limit")


REPLIED = ("sql", "explanation", "is_destructive", "warning", "is_valid")


def _truthy(flag: Column) -> Column:
    """Truth of a JSON value: null, false, zero and what is empty are not true; the text "false" is."""
    kind, text = F.schema_of_variant(flag), F.to_json(flag)
    plain = (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | text.isin('""', "[]", "{}")
    zero = ~kind.isin("STRING", "BOOLEAN", "VOID") & (F.try_variant_get(flag, "$", "double") == 0)
    return F.coalesce(flag.isNotNull() & ~F.coalesce(plain, F.lit(False)) & ~F.coalesce(zero, F.lit(False)), F.lit(False))


def parse_replies(df: DataFrame, column: str) -> DataFrame:
    """Read structured replies.

    Code fences go; what lies between the first ``{`` and the last ``}`` is read as
    JSON, unless the whole is JSON of another kind. Adds ``sql``, ``explanation``, ``is_destructive``,
    ``warning`` and ``is_valid``: a reply without ``sql`` is not valid and is left
    to ``route_requests``. The flag is harmless only if it is absent, null, false, zero or empty;
    SQL that does not only read is destructive whatever the flag says. A column of ``df`` that
    is named like an added one raises.
    """
    _refuse_clash(df, REPLIED)
    bare = F.col("__bare")
    # A whole reply that is valid JSON, but a list or a text, holds no record.
    other_json = bare.rlike(r'^[\["]') & F.try_parse_json(bare).isNotNull()
    braced = F.when(~other_json, F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    return (
        df.withColumn("__bare", strip(F.regexp_replace(col(column), "```json|```", "")))
        .withColumn("__json", braced)
        .withColumn("__reply", F.from_json("__json", REPLY_SCHEMA))
        .withColumn("__flag", F.try_variant_get(F.try_parse_json("__json"), "$.is_destructive", "variant"))
        .withColumns({
            "sql": F.col("__reply.sql"),
            "explanation": F.col("__reply.explanation"),
            "is_destructive": _truthy(F.col("__flag")) | (F.col("__reply.sql").isNotNull() & ~reads(F.col("__reply.sql"))),
            "warning": F.col("__reply.warning"),
            "is_valid": F.col("__reply.sql").isNotNull(),
        })
        .drop("__bare", "__json", "__reply", "__flag")
    )


def qualify_sql(df: DataFrame, column: str, table: str, full: str) -> DataFrame:
    """Put the full table name where only the short one stands (T3). Whole words only."""
    text = col(column)
    replaced = F.regexp_replace(
        text, r"(?U)\b" + quoted_regex(table) + r"\b", quoted_replacement(full))
    return df.withColumn(column, F.when(text.contains(full), text).otherwise(replaced))


def resolve_requests(df: DataFrame, request: str, reply: str, table: str, full: str) -> DataFrame:
    """SQL for each request: that of a valid reply, its table qualified, else the routed one.

    Adds ``sql``, ``explanation``, ``is_destructive``, ``warning`` and ``is_valid``.
    """
    _refuse_clash(df, {*REPLIED, *ROUTED})
    answer = list(REPLIED)
    replied = qualify_sql(parse_replies(df, reply), "sql", table, full)
    held = replied.select(*map(col, df.columns), F.struct(*answer).alias("__reply"))
    routed = route_requests(held, request, full, compat=True)
    valid = F.col("__reply.is_valid")
    return routed.select(
        *map(col, df.columns),
        F.coalesce("__reply.sql", "sql").alias("sql"),
        F.when(valid, F.coalesce("__reply.explanation", F.lit(""))).otherwise(F.col("explanation")).alias("explanation"),
        (valid & F.col("__reply.is_destructive")).alias("is_destructive"),
        F.when(valid, F.coalesce("__reply.warning", F.lit(""))).otherwise("").alias("warning"),
        valid.alias("is_valid"),
    )


def last_turns(df: DataFrame, conversation: str, order_by: str, n: int = 8) -> DataFrame:
    """The last ``n`` turns of each conversation, oldest first (T4); eight are four requests with their answers.

    Each task keeps ``n`` turns per conversation before the shuffle, so one long
    conversation does not weigh on one task.
    """
    newest = Window.partitionBy(col(conversation)).orderBy(col(order_by).desc())
    rest = [order_by] + [c for c in df.columns if c not in (conversation, order_by)]
    return (
        df.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= n)
        .groupBy(col(conversation))
        .agg(F.array_sort(F.collect_list(F.struct(*[col(c) for c in rest]))).alias("context"))
    )


def schema_text(df: DataFrame) -> DataFrame:
    """Columns as one line ``name(type), ...`` (T5)."""
    line = ", ".join(f"{f.name}({f.dataType.simpleString()})" for f in df.schema.fields)
    return df.sparkSession.range(1).select(F.lit(line).alias("schema_text"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """Rules ``(pattern, fix, message)`` of a JSON object ``{pattern: {fix, message}}``, in file order."""
    parsed = F.from_json("value", "map<string,struct<fix:string,message:string>>")
    entries = spark.read.text(path, wholetext=True).select(F.map_entries(parsed).alias("rules")).first()["rules"]
    return [(e["key"], e["value"]["fix"], e["value"]["message"]) for e in entries]


def match_rule_list(df: DataFrame, column: str, rules: list[tuple[str, str, str]], most_bytes: int = RULE_BYTES) -> DataFrame:
    """As ``match_rules``, for thousands of rules (T6): one walk over a message finds all patterns that it holds.

    The patterns go to every task, which makes an Aho-Corasick automaton of them once; lists of over ``most_bytes``
    are refused. Of the patterns that a message holds, the first in the list gives the rule.
    """
    patterns = [pattern.lower() for pattern, _, _ in rules]
    size = sum(len(p.encode()) for p in patterns)
    if size > most_bytes:
        raise ValueError(f"{size} bytes of patterns; raise `most_bytes` to send them to every task")
    answers = [(fix, message) for _, fix, message in rules]
    sent = df.sparkSession.sparkContext.broadcast({"patterns": patterns, "answers": answers})

    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        held = sent.value
        if "automaton" not in held:  # once for each worker
            places: dict[str, int] = {}
            for place, pattern in enumerate(held["patterns"]):
                places.setdefault(pattern, place)
            held["always"] = places.pop("", None)  # an empty pattern is in every message
            held["automaton"] = ahocorasick.Automaton() if places else None
            for pattern, place in places.items():
                held["automaton"].add_word(pattern, place)
            if places:
                held["automaton"].make_automaton()
        walk = held["automaton"].iter if held["automaton"] else lambda text: ()
        always = [] if held["always"] is None else [held["always"]]
        fixes, messages = (pa.array([a[i] for a in held["answers"]], pa.string()) for i in range(2))
        for batch in batches:
            found = []
            for text in batch.to_pylist():
                best = None if text is None else min((place for _, place in walk(text)), default=None)
                found.append(None if text is None else min([*always, *([] if best is None else [best])], default=None))
            at = pa.array(found, pa.int64())
            yield pa.StructArray.from_arrays([fixes.take(at), messages.take(at)], ["fix", "fix_message"])

    first.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rule = F.arrow_udf(first, "fix string, fix_message string")
    return (
        df.withColumn("__rule", rule(F.lower(col(column))))
        .withColumns({"fix": F.col("__rule.fix"), "fix_message": F.col("__rule.fix_message")})
        .drop("__rule")
    )


def match_rules(df: DataFrame, column: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The first rule whose pattern a message holds, case aside; none gives null.

    Adds ``fix`` and ``fix_message``. Rules are ``(pattern, fix, message)`` in
    order. They become one chain of conditions per row, which stops at the first
    hit: no join, no shuffle, and no row per rule. Long lists go in blocks.
    """
    text = F.col("__lower")
    blocks = []
    for start in range(0, len(rules), RULE_BLOCK):
        chain = None
        for pattern, fix, message in rules[start:start + RULE_BLOCK]:
            hit = text.contains(pattern.lower())
            found = F.struct(F.lit(fix).alias("fix"), F.lit(message).alias("fix_message"))
            chain = F.when(hit, found) if chain is None else chain.when(hit, found)
        blocks.append(chain)
    if not blocks:
        return df.withColumns({c: F.lit(None).cast("string") for c in ("fix", "fix_message")})
    return (
        df.withColumn("__lower", F.lower(col(column)))
        .withColumn("__rule", F.coalesce(*blocks))
        .withColumns({"fix": F.col("__rule.fix"), "fix_message": F.col("__rule.fix_message")})
        .drop("__lower", "__rule")
    )


def run_status(
    df: DataFrame, column: str, order_by: str, header: list[str] | None = None
) -> DataFrame:
    """State, run id, start and end of the newest line of each job that holds a known state.

    Lines are ``|``-separated; the first field is the job. The state is the first
    known one that the line holds anywhere, in a fixed order. A job without such a
    line is ``unknown``, with empty fields. Start and end are fields 3 and 4 counted
    from 0, unless ``header`` names the fields and thereby says where ``start_date``
    and ``end_date`` stand. The places of the newest lines are found by an aggregate
    without the texts; only these lines are then taken apart. Of lines in one place
    the last by its text counts.
    """
    start, end = (header.index("start_date"), header.index("end_date")) if header else (3, 4)
    lines = df.filter(col(column).rlike(r"[^|\s]")).select(  # any other line has no job
        strip(F.regexp_extract(col(column), r"^[|\s]*([^|]*)", 1)).alias("job"), col(order_by).alias("place"), col(column).alias("line"))
    known = reduce(lambda a, b: a | b, [F.lower("line").contains(s) for s in RUN_STATES])
    places = lines.groupBy("job").agg(F.max(F.when(known, F.col("place"))).alias("known"), F.max("place").alias("any"))
    places = places.select("job", F.coalesce("known", "any").alias("place"))
    same = (lines["job"] == places["job"]) & lines["place"].eqNullSafe(places["place"])
    newest = (
        lines.join(places, same, "left_semi")
        .groupBy("job").agg(F.max(F.struct(known.alias("known"), "line")).alias("newest"))
        .select("job", F.col("newest.line").alias("__line"))
        .withColumns({
            "__lower": F.lower("__line"),
            "__f": F.filter(F.transform(F.split("__line", r"\|"), strip), lambda p: p != ""),
        })
    )
    lowered = F.col("__lower")
    state = reduce(lambda chain, s: chain.when(lowered.contains(s), s), RUN_STATES[1:],
                   F.when(lowered.contains(RUN_STATES[0]), RUN_STATES[0])).otherwise("unknown")

    def part(i: int) -> Column:
        return F.when((F.col("state") != "unknown") & (F.size("__f") > i), F.get("__f", F.lit(i))).otherwise("")

    return newest.withColumn("state", state).select(
        "job", "state", part(1).alias("run_id"), part(start).alias("start_date"), part(end).alias("end_date"))


def error_tail(df: DataFrame, column: str, **options) -> DataFrame:
    """Add ``tail``: the last characters of a text, quotes escaped."""
    return df.withColumn("tail", tail_of(col(column), **options))


def last_error(df: DataFrame, column: str, **options) -> DataFrame:
    """Add ``last_error``: the last meaningful line of a text."""
    return df.withColumn("last_error", last_error_of(col(column), **options))
