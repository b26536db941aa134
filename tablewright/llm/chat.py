"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens choose the windows: a turn that lies within one share of SPAN tokens
goes to that share's window, one that crosses a border has a window of its own. So windows are whole
turns, and only a single turn can be longer than SPAN. Each window begins with what it repeats: the
system turn, if the conversation begins with one, and the latest turns of at most HISTORY tokens. The
loss mask holds the texts of the assistant's turns where they are new, so each counts once.

A turn is written as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. In
roles and texts a backslash becomes two, ``<|`` becomes ``<\\|``, in roles a line break becomes ``\\/``;
so no marker can occur inside, and the reverse is exact.

Prefix sums are formed in two steps, over ranges of turns and then over the ranges' sums, so that a
conversation of any length is spread over tasks. A window is as large as its budget or its one turn.

Defined cases: null roles and texts are empty; null conversation ids are one conversation; turns are
ordered by turn (nulls first), role and text, and rows that repeat stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import staged

#: Tokens of new turns in a window, of repeated turns, and those that the markers of a turn count.
SPAN, HISTORY, MARKS = 640, 256, 4
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?s)\G((?:[^\\]|\\[^/])*+)\\/", "$1\n"))


def tokens(text: Column) -> Column:
    """Words between white space, and the markers."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("bigint") + MARKS


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the tokens before them."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ("conv_id", "turn", "role", "text", "row")
    # the ranges are written, so that a task that runs again finds the same ones
    ranged = staged(rows.withColumn("n", tokens(F.col("text"))).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("conv_id", "range").agg(F.sum("n").alias("n"), F.count("*").alias("turns"))
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    within = W.partitionBy("conv_id", "range").orderBy("turn", "role", "text", "row")
    local = ranged.withColumn("place", F.row_number().over(within)).withColumn("n_here", F.sum("n").over(within.rowsBetween(W.unboundedPreceding, -1)))
    return local.join(starts, _same(local, starts, "conv_id", "range")).select(
        local["conv_id"], "role", "text", "n", (F.col("place") + F.col("turns_before")).alias("place"),
        (F.coalesce("n_here", F.lit(0)) + F.col("n_before")).alias("at"))


def format_windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, repeated, loss): a row for each window.

    ``repeated`` is the number of characters before the first new turn; ``loss`` holds start and length,
    in characters from 0, of each span that counts.
    """
    share = F.floor(F.col("at") / span)
    crosses = F.floor((F.col("at") + F.col("n") - 1) / span) != share
    placed = staged(_placed(turns).withColumn("window", 2 * share + crosses.cast("int")))
    new = placed.select("conv_id", "window", "place", F.lit(True).alias("new"), "role", "text")
    first = placed.groupBy("conv_id", "window").agg(F.min("place").alias("first"), F.min("at").alias("first_at"))

    system = placed.where((F.col("place") == 1) & (F.col("role") == "system")).select(F.col("conv_id").alias("of"), "place", "role", "text")
    kept = first.where("first > 1").join(system, F.col("conv_id").eqNullSafe(F.col("of")))
    kept = kept.select("conv_id", "window", "place", F.lit(False).alias("new"), "role", "text")

    # turns meet the windows that begin up to `history` tokens later, by shares of `history` tokens
    earlier = placed.where(~((F.col("place") == 1) & (F.col("role") == "system"))).select(
        F.col("conv_id").alias("of"), "place", "at", "role", "text", F.floor(F.col("at") / history).alias("in_share"))
    ends = F.floor(F.col("first_at") / history)
    wanted = first.where("first > 1").withColumn("share", F.explode(F.array(ends - 1, ends)))
    repeated = wanted.join(earlier, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("share") == F.col("in_share"))).where(
        (F.col("at") < F.col("first_at")) & (F.col("at") >= F.col("first_at") - history))
    repeated = repeated.select("conv_id", "window", "place", F.lit(False).alias("new"), "role", "text")

    pieces = new.union(kept).union(repeated).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    pieces = pieces.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = W.partitionBy("conv_id", "window").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    counts = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct((F.col("offset") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length")))
    written = F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("piece"))))
    return pieces.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(written, lambda p: p["piece"]), "").alias("text"),
        F.min(F.when(F.col("new"), F.col("offset"))).alias("repeated"),
        F.array_sort(F.collect_list(counts)).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from windows alone."""
    new = F.substr(F.col("text"), F.col("repeated") + 1)
    parts = F.split(new, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        role = F.substr(part, F.lit(len(START) + 1), line - len(START) - 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substr(part, line + 1)), F.lit("\n"))

    counted = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = windows.select(
        "conv_id", "window", F.size(parts).alias("n"), F.array_join(F.transform(parts, turn), "").alias("turns"),
        F.array_join(counted, "").alias("counted"), F.length("text").alias("chars"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda w: w[c]), "")
    of_conv = read.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), whole("turns").alias("turns"), whole("counted").alias("counted"),
        F.sum("chars").cast("bigint").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return of_conv.select(
        "conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("counted").cast("bigint").alias("loss_chars"),
        digest("counted").alias("loss_sha256"), "formatted_chars")
