"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Equal lines are found by their hashes. Lines within an edit bound of one unit are found by their
variants: a line emits itself with each unit cut out, and with a gap before, between and after its
units. Two lines share a variant (the same units before and behind the gap) exactly if one unit was
replaced, left out or put in. All lines of a variant are within the bound of each other, so the
earliest one stands for them and no pairs are made; the edit distance to it is verified on the units.
Units are the words of a line, or the characters of one of few words.

An edit of one unit leaves the first or the second half of a line as it is. So only lines that share
such an end with another line emit variants.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound, running
from .scratch import Scratch

#: Two lines are compared by words if one of them has so many, else by characters; and if one has so many units.
NEAR_WORDS, NEAR_UNITS = 10, 10


def _cleaned(text: Column) -> Column:
    """The text with one space for each run of white space within its lines."""
    return F.regexp_replace(text, "(?:\\x20*[\\x09\\x0B-\\x0D]|\\x20\\x20)[\\x20\\x09\\x0B-\\x0D]*", " ")


def _n_words(line: str) -> Column:
    return F.when(F.col(line) == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1)


def _at(doc_id: str = "doc_id", line: str = "line") -> Column:
    """A line's place as one number: by document, then by line."""
    return F.col(doc_id).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col(line).cast("decimal(11,0)")


def _of(at: str, kind: str) -> tuple[Column, Column]:
    """The document and the line of a place."""
    line = f"pmod({at}, cast({1 << 31} as decimal(11,0)))"
    return F.expr(f"({at} - {line}) div {1 << 31}").cast(kind).alias("doc_id"), F.expr(line).cast("int").alias("line")


def _ends(rows: DataFrame, near_units: int) -> DataFrame:
    """Adds e0 to e3, hashes of both ends of a line of ``n`` units that may have near lines, else null.

    An end has half of ``near_units``, or twice, four times, ... that: half of the line's units at most
    and more than a quarter. A line of just ``near_units``, or twice, ... that, has the shorter ends, too,
    as a near line can have one unit less. Ends in words and in characters are kept apart.
    """
    step = F.floor(F.log2(F.greatest(F.col("n"), F.lit(near_units)) / F.lit(near_units)) + 1e-9).cast("int")
    rows = rows.withColumn("size", (F.lit(near_units // 2) * F.pow(F.lit(2), step)).cast("int"))
    shorter = (F.col("n") == 2 * F.col("size")) & (F.col("n") > near_units)
    sizes = [F.when(F.col("n") >= near_units, F.col("size")), F.when(shorter, (F.col("size") / 2).cast("int"))]
    for k, size in enumerate(sizes):
        rows = rows.withColumn("k", size)
        first = F.when(F.col("by_words"), F.expr("substring_index(line_text, ' ', k)")).otherwise(F.expr("left(line_text, k)"))
        last = F.when(F.col("by_words"), F.expr("substring_index(line_text, ' ', -k)")).otherwise(F.expr("right(line_text, k)"))
        for i, end in enumerate((first, last)):
            rows = rows.withColumn(f"e{2 * k + i}", F.when(F.col("k").isNotNull(), F.xxhash64(F.lit(i), F.col("by_words"), F.col("k"), end)))
    return rows


def _short_ends(rows: DataFrame, near_words: int, near_units: int) -> DataFrame:
    """Adds e4 and e5, the ends of a line that is one unit short of being compared, as a near line can have that unit.

    That is a line of ``near_units - 1`` units, or one of ``near_words - 1`` words, whose ends are then in words.
    """
    size = lambda n: near_units // 2 << max(0, math.floor(math.log2(max(n, 1) / near_units) + 1e-9))
    k = F.when(F.col("short_words"), size(near_words - 1)).when(F.col("n") == near_units - 1, size(near_units - 1))
    rows = rows.withColumn("k", k).withColumn("in_words", F.col("short_words") | F.col("by_words"))
    ends = [F.when(F.col("in_words"), F.expr(f"substring_index(line_text, ' ', {sign}k)")).otherwise(F.expr(f"{side}(line_text, k)")) for sign, side in (("", "left"), ("-", "right"))]
    return rows.withColumns({f"e{4 + i}": F.when(F.col("k").isNotNull(), F.xxhash64(F.lit(i), F.col("in_words"), F.col("k"), end)) for i, end in enumerate(ends)})


def _variants(units: str, seed: Column, whole: str) -> Column:
    """One number for each unit cut out and for each gap of a line that has units; only the gaps of one that isn't ``whole``."""
    n = F.size(units)
    ahead = F.transform(units, lambda w, i: F.xxhash64(seed, i, w))
    back = F.transform(F.reverse(units), lambda w, i: F.xxhash64(seed, -1 - i, w))
    cut = lambda p, q: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.element_at(p, i), F.element_at(q, n + 1 - i)))
    gap = lambda p, q: F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.element_at(p, i), F.element_at(q, n + 2 - i)))
    # before[i]: the first i units; behind[i]: the last i
    hashes = lambda terms: running(terms, lambda x, y: x.bitwiseXOR(y), F.lit(0).cast("long"))
    return bound(hashes(ahead), lambda before: bound(hashes(back), lambda behind: F.concat(F.when(F.col(whole), cut(before, behind)).otherwise(F.array().cast("array<long>")), gap(before, behind))))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one unit at most was replaced, left out or put in."""
    apart = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)

    def inserted(long: Column, short: Column) -> Column:
        at = apart(F.slice(long, 1, F.size(short)), short)
        at = F.when(at == 0, F.size(long).cast("long")).otherwise(at).cast("int")
        return F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(long))

    replaced = F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda x: x)) <= 1
    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) == F.size(b) + 1, inserted(a, b)).when(F.size(b) == F.size(a) + 1, inserted(b, a)).otherwise(False)


def _kinds(rows: DataFrame, near_words: int, near_units: int) -> DataFrame:
    """Adds n_words, by_words, and short_words of lines that have one word too few to be compared by words."""
    rows = rows.withColumn("n_words", _n_words("line_text"))
    short = F.col("n_words") == near_words - 1 if near_words >= near_units else F.lit(False)
    return rows.withColumn("by_words", F.col("n_words") >= near_words).withColumn("short_words", short)


def removed_lines(docs: DataFrame, tables: Scratch, near_words: int = NEAR_WORDS, near_units: int = NEAR_UNITS) -> DataFrame:
    """(doc_id, exact, near, places): the places, from 0, of lines that have an earlier equal or near line, and all of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = docs.select("doc_id", F.posexplode(F.split(_cleaned(F.col("text")), "\n")).alias("line", "body")).select("doc_id", "line", F.trim("body").alias("line_text"))
    lines = _kinds(lines.where("line_text != ''"), near_words, near_units)
    lines = _ends(lines.withColumn("n", F.when(F.col("by_words"), F.col("n_words")).otherwise(F.length("line_text"))), near_units)
    lines = _short_ends(lines, near_words, near_units)
    lines = lines.select("doc_id", "line", F.xxhash64("line_text").alias("h"), F.xxhash64(F.lit(3), "line_text").alias("g"), *[f"e{k}" for k in range(6)])
    lines = tables.put(lines, "lines").withColumn("at", _at())
    # a line's ends follow from its words, so that any of them serves
    first = lines.groupBy("h", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(f"e{k}").alias(f"e{k}") for k in range(6)])
    first = tables.put(first, "first")

    # sides that grow with the corpus are shuffled at any size
    repeated = tables.put(first.where("n > 1").select("h", "g", "first"), "repeated")
    exact = lines.join(repeated.hint("merge"), ["h", "g"]).where("at != first").select("doc_id", "line", F.lit(True).alias("exact"))
    exact = tables.put(exact, "exact")

    ends = first.where("e0 is not null or e4 is not null").select(*_of("first", kind), F.explode(F.array(*[f"e{k}" for k in range(6)])).alias("end")).where("end is not null")
    ends = tables.put(ends, "ends")
    shared = tables.put(ends.groupBy("end").count().where("count > 1").select("end"), "shared")
    near = ends.join(shared.hint("merge"), "end", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("places"))
    near = tables.put(near, "near-places")
    body = lambda own, p: F.struct(p.alias("line"), F.trim(F.get(own, p)).alias("line_text"))
    bodies = docs.join(near.hint("merge"), "doc_id").select("doc_id", F.explode(bound(F.split(_cleaned(F.col("text")), "\n"), lambda own: F.transform("places", lambda p: body(own, p)))).alias("x"))
    # a repeated id may have other lines at these places
    bodies = _kinds(bodies.select("doc_id", "x.line", "x.line_text").where("line_text != ''"), near_words, near_units)
    units = lambda in_words: F.when(in_words, F.split("line_text", " ")).otherwise(F.split("line_text", ""))
    own = F.struct("by_words", F.lit(False).alias("short"), units(F.col("by_words")).alias("units"))
    short = F.struct(F.lit(True).alias("by_words"), F.lit(True).alias("short"), F.when(F.col("short_words"), units(F.lit(True))).alias("units"))
    bodies = bodies.select("doc_id", "line", F.inline(F.array(own, short)))
    bodies = bodies.where(F.col("units").isNotNull() & (F.col("short") | (F.size("units") >= near_units - 1)))
    bodies = tables.put(bodies.select("doc_id", "line", "by_words", "units", (~F.col("short") & (F.size("units") >= near_units)).alias("whole")), "bodies")
    keys = tables.put(bodies.select("doc_id", "line", "by_words", F.explode(_variants("units", F.col("by_words"), "whole")).alias("key")), "keys").withColumn("at", _at())
    groups = keys.groupBy("key").agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).where("earliest < latest").drop("latest")
    groups = tables.put(groups, "variants")
    pairs = keys.join(groups.hint("merge"), "key").where("at > earliest").select("at", "earliest", "by_words").distinct()
    pairs = tables.put(pairs, "pairs")
    bodies = bodies.withColumn("at", _at())
    pairs = pairs.join(bodies.withColumnRenamed("units", "a").hint("merge"), ["at", "by_words"])
    pairs = pairs.join(bodies.select(F.col("at").alias("earliest"), "by_words", F.col("units").alias("b")).hint("merge"), ["earliest", "by_words"])
    near = pairs.where(_one_edit(F.col("a"), F.col("b"))).select("doc_id", "line", F.lit(False).alias("exact"))
    both = exact.unionAll(tables.put(near.distinct(), "near"))
    places = lambda flag: F.array_sort(F.collect_set(F.when(flag, F.col("line"))))
    removed = both.groupBy("doc_id").agg(places(F.col("exact")).alias("exact"), places(~F.col("exact")).alias("near"), F.array_sort(F.collect_set("line")).alias("places"))
    return tables.keep(tables.put(removed, "removed"), "removed")


def _without(text: str, places: str) -> Column:
    """The text without the lines at sorted places: what lies between these is taken over whole."""

    def kept(own: Column) -> Column:
        begin = lambda k: F.when(k == 0, 0).otherwise(F.least(F.get(places, k - 1) + 1, F.size(own)))
        end = lambda k: F.least(F.coalesce(F.get(places, k), F.size(own)), F.size(own))
        return F.array(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: F.slice(own, begin(k) + 1, end(k) - begin(k)))), "\n"))

    return F.when(F.col(places).isNull(), F.col(text)).otherwise(bound(F.split(text, "\n"), kept)[0])


def dedupe_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS, near_units: int = NEAR_UNITS) -> DataFrame:
    """Removes each line that equals an earlier line, or differs from one by one word or character.

    Earlier is a line of a document with a smaller id, or a line before in the same document; lines
    are judged on the input. Lines end with ``\\n``; their words are runs of characters that are no
    ASCII white space, and two lines are equal if their words are, however few they have. Two lines of
    which one has ``near_words`` words or more are near if one word was replaced, left out or put in. If
    both are shorter, as in scripts without spaces, they are near if the same holds for one character (a
    space stands between words). The longer one must have ``near_units`` words or characters; lines that
    both have fewer are only compared as they are. Lines without a word stay.

    Returns a row for every row of ``docs``: doc_id, n_lines, n_exact and n_near (lines removed), and
    kept, the other lines joined by ``\\n``. A null text has no lines and stays null. Rows with a
    null id are left as they are. Rows that repeat an id are one document: a line's place counts for
    each of them. Empty tables give no rows; other columns are not looked at. Lines and documents may
    be of any length: work grows with the units of a line to the power of 1.5 at most.
    """
    tables = Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = removed_lines(docs.where("doc_id is not null and text is not null"), tables, near_words, near_units)
    gone = gone.select("doc_id", "exact", F.array_except("near", "exact").alias("near"), "places")
    rows = docs.join(gone.hint("merge"), "doc_id", "left")
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    rows = rows.withColumn("n_lines", n_lines.cast("long"))
    size = lambda x: F.coalesce(F.size(F.filter(x, lambda i: i < F.col("n_lines"))), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_lines", size("exact").alias("n_exact"), size("near").alias("n_near"), _without("text", "places").alias("kept"))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, without the lines that ``dedupe_lines`` removes.

    A document goes if lines were removed and no word is left; all others stay, those with a null id or
    text as they are. Each row of an id that repeats loses the lines at the places found for that id.
    Columns may have any names.
    """
    tables = Scratch(docs.sparkSession, "lines")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = removed_lines(plain.where("doc_id is not null and text is not null"), tables, **options).select("doc_id", "places")
    # the columns of the documents are kept apart, whatever their names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(gone.hint("merge"), "doc_id", "left").withColumn("kept", _without("text", "places"))
    rows = rows.where(F.col("places").isNull() | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select(*[F.col("kept").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
