"""Plain-text histories: input lines with time comments, and chat logs in Markdown. Islands of lines become entries by running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.dedup import first_of
from . import formats
from .records import VISIBLE, lines, strip

_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$"


def line_endings(value: Column) -> Column:
    """none, lf, crlf or mixed."""
    total, crlf = F.regexp_count(value, F.lit("\n")), F.regexp_count(value, F.lit("\r\n"))
    return F.when(total == 0, "none").when(crlf == 0, "lf").when(crlf == total, "crlf").otherwise("mixed")


def encoding_degraded(value: Column) -> Column:
    """More than one character in a hundred was no UTF-8."""
    return F.length(value) - F.length(F.replace(value, F.lit("\ufffd"), F.lit(""))) > F.length(value) * formats.ENCODING_RATIO


def naive_time(x: Column) -> Column:
    return F.when(x.rlike(_STAMP), x.try_cast("timestamp"))


def _numbered(found: DataFrame) -> DataFrame:
    rows = lines(found).withColumn("_last", F.max("line_no").over(Window.partitionBy("path")))
    rows = rows.where(~((F.col("line_no") == F.col("_last")) & (F.col("line") == "")))
    return rows.withColumn("final", F.col("line_no") == F.col("_last")).withColumn("line", F.regexp_replace("line", "\r$", "")).drop("_last")


def _upto() -> object:
    return Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def input_entries(found: DataFrame) -> DataFrame:
    """Every entry (a run of lines that start with ``+``): ordinal, raw text, time of the nearest time line before it, and whether it was cut off."""
    rows, order = _numbered(found), _upto()
    plus = F.col("line").startswith("+")
    stamp = F.regexp_extract("line", r"^# (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s*$", 1)
    mark = ~plus & F.col("line").startswith("#")
    rows = rows.withColumn("ts", F.last(F.when(mark, F.struct(naive_time(stamp).alias("at"))), ignorenulls=True).over(order)["at"]).withColumn("island", F.sum(F.when(plus, 0).otherwise(1)).over(order))
    entries = rows.where(plus).groupBy("path", "island").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 2, 1 << 30).alias("t")))), lambda x: x["t"]), "\n").alias("raw"),
        F.min("ts").alias("ts"), F.bool_or(F.col("final") & ~F.col("closed")).alias("cut"),
    )
    return entries.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).drop("island")


def input_files(found: DataFrame, entries: DataFrame) -> DataFrame:
    """By file: counts and whether it is supported; ``undated`` marks files whose times are mostly missing."""
    stats = entries.groupBy("path").agg(F.count("*").alias("entry_count"), F.count_if(F.col("ts").isNull()).alias("undated_entries"), F.bool_or("cut").alias("truncated_tail"))
    content = F.exists(F.split("value", "\n", -1), lambda x: x.rlike(VISIBLE) & ~x.startswith("+"))
    own = found.select("path", line_endings(F.col("value")).alias("line_ending"), encoding_degraded(F.col("value")).alias("degraded"), content.alias("has_content"))
    out = own.join(stats, "path", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0))).withColumn("truncated_tail", F.coalesce("truncated_tail", F.lit(False)))
    return out.withColumn("supported", ~(F.col("degraded") | (F.col("has_content") & (F.col("entry_count") == 0)))).withColumn("undated", F.coalesce(F.col("undated_entries") > F.col("entry_count") * formats.UNDATED_RATIO, F.lit(False)))


def input_utterances(found: DataFrame) -> DataFrame:
    entries = input_entries(found)
    body = strip(F.col("raw"))
    kept = entries.where(~F.col("cut")).withColumn("text", body).where((body != "") & ~body.startswith("/") & ~body.startswith("!") & (strip(F.split(body, "\n")[0]) != "{"))
    gate = input_files(found, entries).where("supported").select("path", "truncated_tail")
    last = F.max("ordinal").over(Window.partitionBy("path"))
    flags = F.array_compact(F.array(F.when(F.col("ts").isNull(), "undated").otherwise("timezone_unknown"), F.when(F.length("text") > fixed.LONG_PASTE_CHARS, F.lit("possible_paste")), F.when(F.col("truncated_tail") & (F.col("ordinal") == last), F.lit("truncated_tail_dropped"))))
    return kept.join(gate, "path").withColumn("flags", flags).select("path", "ordinal", "text", "ts", "flags")


def chat_messages(found: DataFrame) -> DataFrame:
    """Every message of a Markdown log (a run of user lines outside of fences): banner, ordinal under it, text, the banner's time."""
    rows, order = _numbered(found), _upto()
    rows = rows.where(~(F.col("final") & ~F.col("closed")))  # a line without its end is an append that was cut
    fence = F.ltrim("line").startswith("```") | F.ltrim("line").startswith("~~~")
    rows = rows.withColumn("fence", fence).withColumn("inside", F.pmod(F.sum(F.when(fence, 1).otherwise(0)).over(order) - F.when(fence, 1).otherwise(0), F.lit(2)) == 1)
    outer = ~F.col("fence") & ~F.col("inside")
    banner, user = outer & F.col("line").startswith(formats.BANNER), outer & F.col("line").startswith(formats.USER_LINE)
    rows = rows.withColumn("user", user).withColumn("banner", F.sum(F.when(banner, 1).otherwise(0)).over(order)).withColumn("island", F.sum(F.when(F.col("fence") | (outer & ~user), 1).otherwise(0)).over(order))
    at = naive_time(strip(F.substring("line", len(formats.BANNER) + 1, 1 << 30)))
    rows = rows.withColumn("ts", F.last(F.when(banner, F.struct(at.alias("at"))), ignorenulls=True).over(order)["at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", len(formats.USER_LINE) + 1, 1 << 30).alias("t")))), lambda x: x["t"]), "\n")
    out = rows.where("user").groupBy("path", "island").agg(F.min("line_no").alias("line_no"), F.min("banner").alias("banner"), F.min("ts").alias("ts"), text.alias("raw"))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("path", "banner").orderBy("line_no")) - 1).drop("island")


def chat_utterances(found: DataFrame) -> DataFrame:
    good = found.where(~encoding_degraded(F.col("value"))).select("path")
    body = strip(F.col("raw"))
    kept = chat_messages(found).join(good, "path").withColumn("text", body).where((body != "") & (body != "<blank>") & ~body.startswith("/") & ~body.startswith("!"))
    flags = F.array_compact(F.array(F.lit("fallback_channel"), F.when(F.col("ts").isNull(), "undated").otherwise("session_start_time_only"), F.when(F.length("text") > fixed.LONG_PASTE_CHARS, F.lit("possible_paste"))))
    return kept.withColumn("flags", flags).select("path", "banner", "ordinal", "text", "ts", "flags")


def chosen_channel(inputs: DataFrame, chats: DataFrame, folder: Column) -> DataFrame:
    """Utterances of the input history of each folder, or of its chat log where it has no supported input history."""
    one = inputs.select(folder.alias("folder"), "path", F.lit(0).alias("rank"), "text", "ts", "flags", F.col("ordinal").cast("long").alias("at"))
    two = chats.select(folder.alias("folder"), "path", F.lit(1).alias("rank"), "text", "ts", "flags", (F.col("banner") * 1_000_000 + F.col("ordinal")).cast("long").alias("at"))
    both = one.union(two)
    return both.join(first_of(both.select("folder", "rank").distinct(), ["folder"], [F.col("rank")]), ["folder", "rank"], "left_semi").drop("rank")
