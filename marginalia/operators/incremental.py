"""Reading only what is new: cutoffs, sender matching, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import dates, text
from marginalia.operators.keyed import top_k_per_key
from marginalia.settings import LOOKBACK_DAYS

# Characters of the grams that sender names are looked up by.
GRAM = 3
# Parts of a day's landed messages, by the sender's address.
SENDER_PARTS = 32


def source_cutoffs(
    sources: DataFrame, sync_state: DataFrame, as_of: Column, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Per source: its mark, and the midnight from which messages are searched.

    A source without a mark looks back a number of days and has no precise cutoff.
    """
    start = F.coalesce(F.col("last_sync"), dates.lookback_start(as_of, lookback_days))
    marks = sync_state.select(F.col("source").alias("name"), "last_sync")
    return sources.join(marks, "name", "left").withColumn("search_from", F.date_trunc("day", start))


def _same_type(df: DataFrame, column: str, value: Column) -> Column:
    """Cast a cutoff to the message column's type, so that the scan can use the filter."""
    return value.cast(df.schema[column].dataType)


def earliest_search(cutoffs: DataFrame) -> Column:
    return cutoffs.agg(F.min("search_from")).scalar()


def coarse_search(messages: DataFrame, cutoffs: DataFrame, ts: str = "internal_ts") -> DataFrame:
    """Messages no source can reject by date. The bound is one value, known before the
    scan starts, so Parquet row groups that are too old are not read."""
    return messages.filter(F.col(ts) >= _same_type(messages, ts, earliest_search(cutoffs)))


def _part(address: Column) -> Column:
    return F.lpad(F.pmod(F.xxhash64(address), F.lit(SENDER_PARTS)).cast("string"), 2, "0")


def slice_of(ts: Column, address: Column) -> Column:
    """Folder of a landed message: its day, and a part of it by the sender's address."""
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd"), _part(address))


def wanted_slices(sources: DataFrame, cutoffs: DataFrame, as_of: Column) -> DataFrame:
    """(slice) of all landed folders that some source can have new messages in.

    A source known by its address needs one part of each day since its own search day; one
    known by its display name all parts. Messages dated after tomorrow are read when their day comes.
    """
    named = F.nullif(F.col("sender_name"), F.lit("")).isNotNull()
    every = F.sequence(F.lit(0), F.lit(SENDER_PARTS - 1))
    parts = F.when(named, F.transform(every, lambda k: F.lpad(k.cast("string"), 2, "0"))).otherwise(F.array(_part(F.lower("email"))))
    dated = sources.select("name", "email", "sender_name").join(cutoffs.select("name", "search_from"), "name")
    until = F.date_add(as_of.cast("date"), 1)
    dated = dated.filter(F.col("search_from").cast("date") <= until)
    days = dated.select(F.explode(F.sequence(F.col("search_from").cast("date"), until)).alias("_day"), parts.alias("_parts"))
    cells = days.select("_day", F.explode("_parts").alias("_part")).distinct()
    return cells.select(F.concat_ws("_", F.date_format("_day", "yyyyMMdd"), "_part").alias("slice"))


def landed_search(messages: DataFrame, sources: DataFrame, cutoffs: DataFrame, as_of: Column) -> DataFrame:
    """Landed messages (with ``slice``, their partition) of the folders that some source needs.

    The folders are known when the scan starts, so the others are not even listed; a source with
    an old mark makes no other source's folders be read.
    """
    return messages.join(wanted_slices(sources, cutoffs, as_of), "slice", "left_semi")


def is_new(ts: Column) -> Column:
    """After the mark, or since the search day for a source that has no mark."""
    return F.when(F.col("last_sync").isNotNull(), ts > F.col("last_sync")).otherwise(
        ts >= F.col("search_from")
    )


def new_messages(
    messages: DataFrame,
    cutoffs: DataFrame,
    ts: str = "internal_ts",
    source: str = "source",
) -> DataFrame:
    """New messages of messages that already carry their source name."""
    wanted = coarse_search(messages, cutoffs, ts)
    marks = cutoffs.withColumnRenamed("name", source)
    return wanted.join(marks, source).filter(is_new(F.col(ts))).drop("last_sync", "search_from")


def sender_address(from_header: Column) -> Column:
    """Address inside ``<…>``, or the whole header, in lower case."""
    inside = F.regexp_extract(from_header, r"<([^<>]*)>", 1)
    return F.lower(text.strip(F.when(inside != "", inside).otherwise(from_header)))


def _grams(name: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a name; a shorter name has none."""
    starts = F.when(F.length(name) >= size, F.sequence(F.lit(1), F.length(name) - size + 1))
    return F.array_distinct(F.coalesce(F.transform(starts, lambda at: F.substr(name, at, F.lit(size))), F.array().cast("array<string>")))


def _named_lookup(names: DataFrame, named: DataFrame) -> DataFrame:
    """(key: display name, source) for every sender name a display name contains.

    The substring test is an equi-join on q-grams: a sender name is looked up by one gram, the one
    that the fewest display names hold, and then compared. A name that has no longer gram than
    one or two characters is looked up by that. A display name gives as many rows as it has
    characters, three at most for each, whatever sender names there are.
    """
    sized = named.withColumn("_size", F.least(F.length("_piece"), F.lit(GRAM)))
    sizes = sized.agg(F.collect_set("_size")).scalar()

    def grams_of(name: Column, size: Column) -> Column:
        return F.when(size == 1, _grams(name, 1)).when(size == 2, _grams(name, 2)).otherwise(_grams(name, GRAM))

    of_all = F.flatten(F.transform("_sizes", lambda n: grams_of(F.col("key"), n)))
    found = names.withColumn("_sizes", sizes).select("key", F.explode(of_all).alias("_gram"))
    wanted = sized.select("source", "_piece", F.explode(grams_of(F.col("_piece"), F.col("_size"))).alias("_gram"))
    held = found.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = (
        wanted.join(held, "_gram")
        .groupBy("source", "_piece")
        # A gram that no display name holds rules its sender name out.
        .agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count("*").alias("_met"))
    )
    whole = wanted.groupBy("source", "_piece").agg(F.count("*").alias("_all"))
    usable = rarest.join(whole, ["source", "_piece"]).filter("_met = _all").select("source", "_piece", "_gram")
    return found.join(usable, "_gram").filter(F.contains("key", F.col("_piece"))).select("key", "source")


def match_senders(messages: DataFrame, sources: DataFrame, from_header: str = "from_header") -> DataFrame:
    """Messages × the sources they belong to; a message may match several.

    Sources without a sender name, or with an empty one, match on the address. Sources with
    one match when the display name contains it, in any letter case, and the address is not
    looked at. Only distinct headers are matched, so the messages themselves, with all they
    carry, are joined once and on the header.
    """
    source, sender = F.col("name").alias("source"), F.nullif(F.col("sender_name"), F.lit(""))
    named = sources.filter(sender.isNotNull()).select(source, F.lower("sender_name").alias("_piece"))
    by_address = sources.filter(sender.isNull()).select(F.lower("email").alias("_address"), source)
    headers = messages.select(
        F.col(from_header).alias("_header"),
        sender_address(F.col(from_header)).alias("_address"),
        F.lower(text.display_name(F.col(from_header))).alias("key"),
    ).distinct()
    by_name = headers.join(_named_lookup(headers.select("key").distinct(), named), "key")
    found = headers.join(by_address, "_address").select("_header", "source")
    found = found.unionByName(by_name.select("_header", "source"))
    return messages.join(found, F.col(from_header) == F.col("_header")).drop("_header")


def newest_per_source(messages: DataFrame, k: int, ts: str = "internal_ts", source: str = "source") -> DataFrame:
    """At most ``k`` newest messages of each source (the page limit of the mail search)."""
    order = [F.col(ts).desc(), F.col("message_id").desc()]
    return top_k_per_key(messages, [source], order, k, salt_on="message_id")


def new_marks(processed: DataFrame, ok: Column, ts: str = "internal_ts", source: str = "source") -> DataFrame:
    """Latest successfully processed timestamp of each source; a message without a date moves no mark."""
    dated = F.unix_micros(F.col(ts).cast("timestamp")) > 0
    return (
        processed.groupBy(F.col(source).alias("source"))
        .agg(F.max(F.when(ok & dated, F.col(ts))).alias("last_sync"))
        .filter(F.col("last_sync").isNotNull())
    )


def advance_marks(sync_state: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks after a run: sources not seen keep theirs, and no mark moves back."""
    found = marks.select("source", F.col("last_sync").alias("_new"))
    return sync_state.join(found, "source", "full_outer").select(
        "source", F.greatest("last_sync", "_new").alias("last_sync")
    )
