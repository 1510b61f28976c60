"""Removal of passages that many documents repeat, by content-defined chunks of lines. DataFrame functions only.

A line ends at a newline, after a mark followed by a blank, or after a long word (`LONG` characters) and its blank: the
ends depend on nothing but the characters before them, so a passage is cut alike wherever it stands. A line that is
still long (`LIMIT`: short words without marks, scripts without blanks) is cut by content as well, where hashes of
characters are least. Lines are hashed without trailing white space, a rolling hash covers each line and the next, and
a chunk begins where the rolling hash is a local minimum, and before and after a line of `LONE` bytes; so chunks shift
with their text. A passage in which one word or a few characters recur without end has no minimum inside: it is found
only where it begins and ends with its text.

Hashes of chunks are counted over all documents with map-side aggregation. Occurrences of repeated hashes are then
compared, character by character, with the first one (smallest row number, then position), together with the lines of
the chunks beside them, which extends a match to the whole repeated passage. Matches that touch form a run, and runs of
at least `min_chars` characters are removed. The first occurrence always stays: a removed line equals one at an earlier
place, which stays or equals a still earlier one.

Defined results: null text stays null and counts as empty; an empty text stays empty; a text that is wholly repeated
becomes empty and its row stays; repeats within one document are repeats; rows are told apart by an internal number, so
repeated rows and ids count as documents of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frame, hot_keys, join_back, keep, numbered

LONG, MIN_CHUNK, MIN_CHARS, REACH = 6, 32, 100, 24
#: A line of more than LIMIT characters is cut, WINDOW characters apart at most; one of LONE bytes or more is a chunk alone.
LIMIT, WINDOW, LONE = 96, 24, 64
# the first condition is the cheap one: nothing else is tried within words
_ENDS = rf"(?<=[ \n])(?:(?<=\n)|(?<=[.,;:!?] )|(?<=\S{{{LONG}}} ))"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of(pair: Callable[[Column, int], Column], shift: int) -> Callable[[Column], Column]:
    return lambda m: pair(m, shift)


def part(items: Column, start: Column, size: Column) -> Column:
    """Elements `start` to `start + size - 1`: unlike a slice, it costs its own length, not that of the whole array."""
    taken = F.transform(F.sequence(start, start + size - 1), lambda i: F.get(items, i))
    return F.when(size > 0, taken).otherwise(F.slice(items, 1, 0))


def _pieces(line: Column) -> Column:
    """A long line cut where, within some `WINDOW` places, the hash of the eight characters around is least.

    Places behind white space come before all others; of equal places the first is taken.
    """
    def keys(chars: Column) -> Column:
        # one number a place: inside a word or not, 31 bits of the hash, the place
        return F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.when(
            F.get(chars, i - 1).isin(" ", "\n", "\t"), F.lit(0)).otherwise(F.lit(1 << 62)) + i + F.shiftleft(
            F.shiftrightunsigned(F.xxhash64(*[F.get(chars, i + k) for k in range(-4, 4)]), 33), 31))

    def least(keys: Column) -> Column:
        # minima of 2, 4, 8, 16 and 24 places in a row, by pairs of shorter ones
        def paired(m: Column, shift: int) -> Column:
            return F.zip_with(F.slice(m, F.lit(1), F.size(m) - shift), F.slice(m, F.lit(shift + 1), F.size(m) - shift),
                              lambda x, y: F.least(x, y))

        low = keys
        for shift in (1, 2, 4, 8, WINDOW - 16):
            low = _let(low, _of(paired, shift))
        return F.transform(F.array_distinct(low), lambda key: key.bitwiseAND((1 << 31) - 1).cast("int"))

    def cut(chars: Column, at: Column) -> Column:
        return _let(F.concat(F.array(F.lit(0)), at), lambda s: F.transform(s, lambda a, k: F.array_join(
            part(chars, a, F.coalesce(F.get(s, k + 1), F.size(chars)) - a), "")))

    return _let(F.split(line, ""), lambda chars: _let(least(keys(chars)), lambda at: cut(chars, at)))


def lines_of(text: Column) -> Column:
    """Lines with the white space that ends them: joined again they are the text."""
    return _let(F.split(text, _ENDS), lambda lines: F.when(
        F.exists(lines, lambda x: F.octet_length(x) > LIMIT), F.flatten(F.transform(lines, lambda x: F.when(
            F.length(x) > LIMIT, _pieces(x)).otherwise(F.array(x))))).otherwise(lines))


def bare(line: Column) -> Column:
    """A line without the blanks, and the white space before its newline, that end it."""
    return F.when(F.endswith(line, F.lit("\n")), F.rtrim(line, F.lit(" \n\t\r"))).otherwise(F.rtrim(line))


def chunked(rows: DataFrame) -> DataFrame:
    """`rid, chunks` with first line, number of lines and hash of each chunk of a table `rid, text`.

    Chunks of less than `MIN_CHUNK` bytes say nothing alone and are left out; a match beside them covers them.
    """
    cut = rows.select("rid", F.transform(lines_of(F.coalesce("text", F.lit(""))), bare).alias("x"))
    # the rolling hash of a line and the next; its last bit says whether the line is a chunk alone (its end counts as a byte)
    rolled = cut.select("rid", "x", F.zip_with("x", F.slice("x", F.lit(2), F.size("x")), lambda x, y: F.xxhash64(
        x, y).bitwiseAND(-2) + F.when(F.octet_length(x) >= LONE - 1, F.lit(1)).otherwise(F.lit(0))).alias("r"))

    def begins(r: Column, i: Column) -> Column:
        prior = F.get("r", i - 1)
        return (i == 0) | (r.bitwiseAND(1) == 1) | (prior.bitwiseAND(1) == 1) | (
            (prior > r) & F.coalesce(r <= F.get("r", i + 1), F.lit(True)))

    begun = rolled.select("rid", "x", F.transform("r", lambda r, i: F.when(begins(r, i), i)).alias("at"))
    starts = begun.select("rid", "x", F.filter("at", lambda a: a.isNotNull()).alias("s"), F.size("x").alias("n"))

    def chunk(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("s", k + 1), F.col("n"))
        return _let(F.transform(F.sequence(at, stop - 1), lambda i: F.get("x", i)), lambda lines: F.when(
            F.aggregate(lines, F.size(lines), lambda n, x: n + F.octet_length(x)) >= MIN_CHUNK,
            F.struct(at.alias("start"), F.size(lines).alias("size"), F.xxhash64(lines).alias("hash"))))

    return starts.select("rid", F.filter(F.transform("s", chunk), lambda c: c.isNotNull()).alias("chunks"))


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")


def _occurrence(chunk: Column, k: Column) -> Column:
    """The k-th repeated chunk of a row `found, lines`, with the lines beside it (`REACH` at most, nearest first)."""
    start, stop = chunk["start"], chunk["start"] + chunk["size"]
    # a match extends no further than to the repeated chunks beside it
    prior, later = F.get("found", k - 1), F.get("found", k + 1)
    low = F.greatest(start - REACH, F.coalesce(prior["start"] + prior["size"], F.lit(0)))
    high = F.least(stop + REACH, F.coalesce(later["start"], F.size("lines")))
    return F.struct(
        start.alias("start"), stop.alias("stop"), chunk["hash"].alias("hash"), chunk["own"].alias("own"),
        F.array_join(part(F.col("lines"), start, chunk["size"]), "\n").alias("body"),
        F.reverse(part(F.col("lines"), low, start - low)).alias("before"),
        part(F.col("lines"), stop, high - stop).alias("after"))


def occurrences(source: DataFrame, places: DataFrame) -> DataFrame:
    """The repeated chunks of the documents that have some, cut inside the row: a long text is not copied for each."""
    held = source.join(places.hint("merge"), "rid").select(
        "rid", "found", F.transform(lines_of("text"), bare).alias("lines"))
    return held.select("rid", F.inline(F.transform("found", _occurrence)))


def repeated_runs(source: DataFrame, chunks: DataFrame, min_chars: int) -> DataFrame:
    """`rid, gone` (numbers of the lines that go) of the documents of a table `rid, text` that lose some."""
    flat = chunks.select("rid", F.inline("chunks"))
    repeated = keep(flat.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("first")).where("n > 1"),
                    "line-repeats")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(repeated, ["hash"], total)
    met = join_back(flat.select("rid", "start", "size", "hash"), repeated.select("hash", F.col("first.rid").alias("first_rid"),
                                                                                       F.col("first.start").alias("first_start")), ["hash"], hot)
    places = keep(met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(
        "start", "size", "hash",
        ((F.col("rid") == F.col("first_rid")) & (F.col("start") == F.col("first_start"))).alias("own")))).alias("found")),
        "line-places")

    each = keep(occurrences(source, places), "line-occurrences")
    firsts = each.where("own").select("hash", F.col("body").alias("fbody"), F.col("before").alias("fbefore"),
                                      F.col("after").alias("fafter"))
    others = each.where("not own").select("rid", "start", "stop", "hash", "body", "before", "after")
    same = join_back(others, firsts, ["hash"], hot).where(F.col("body") == F.col("fbody"))
    wide = same.select("rid", "start", "stop", F.length("body").alias("size"), "before", "after",
                       _common(F.col("before"), F.col("fbefore")).alias("up"),
                       _common(F.col("after"), F.col("fafter")).alias("down"))
    spans = wide.select(
        "rid", (F.col("start") - F.col("up")).alias("a"), (F.col("stop") + F.col("down")).alias("b"),
        (F.col("size") + F.length(F.array_join(F.slice("before", F.lit(1), F.col("up")), " "))
         + F.length(F.array_join(F.slice("after", F.lit(1), F.col("down")), " "))).alias("chars"))
    # spans that touch form a run: a span opens one where no earlier span reaches it
    order = Window.partitionBy("rid").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    runs = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "rid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("chars").alias("chars"))
    return runs.where(F.col("chars") >= min_chars).groupBy("rid").agg(
        F.flatten(F.collect_list(F.sequence(F.col("a"), F.col("b") - 1))).alias("gone"))


def without_repeats(table: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`rid, text, n_removed` (lines) of a table `rid, text` with distinct, lasting `rid`."""
    source = table.select("rid", "text")
    chunks = keep(chunked(source), "line-chunks")
    gone = repeated_runs(source, chunks, min_chars)
    cleaned = source.join(gone.hint("merge"), "rid", "left").select(
        "rid", "text", "gone", F.when(F.col("gone").isNotNull(), lines_of(F.col("text"))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return cleaned.select(
        "rid", F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("lines", i)), "")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def remove_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """`doc_id, text, n_removed` of every row, with later occurrences of repeated passages taken out."""
    table = numbered(frame(docs, id_col, text_col), "line-rows")
    return table.select("rid", "doc_id").join(without_repeats(table, min_chars), "rid").select(
        "doc_id", "text", "n_removed")
