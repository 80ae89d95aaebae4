"""Fuzzy line dedup (op4), in DataFrame functions alone.

Lines (between line feeds, without the spaces around them) take part unless they are empty. A line's set is its distinct shingles of
SHINGLE characters (UTF-16 code units), or the whole line where it is shorter; two lines are linked if the Jaccard similarity of their sets
is at least 0.8. Signatures have BANDS * ROWS minimums: row r of a band has a 64-bit hash of its own, and band k takes the minimum
of that hash after exclusive-or with a constant whose top bits are k, so that each band looks first at its own part of the hash's range.
A pair at 0.8 shares a band with a probability of 0.997, as with independent minimums. Candidates whose signatures are not far apart
are confirmed on their full sets; linked lines are joined into components, and one line of each component stays: the first one
(smallest document id, then the leftmost).

Equal lines are one class first, told apart by 64-bit hashes (two of them where a class is alone). Two classes that meet in a band are
compared. Of larger groups, classes are compared with one pivot in each of a few rounds, the class that occurs most first; groups whose
classes are still in several components then compare all of those, inside a join in blocks of BLOCK classes, so that only similar
pairs come out. A line that very many documents hold makes no pairs.

Defined results: a null text has no lines and stays null; rows with a null id come after all others; equal rows (same id and text) are
equally early, so each keeps its lines; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stage, sweep, table, unstage
from .components import components

SHINGLE, BANDS, ROWS = 8, 8, 3
PERCENT = 80
#: Minimums that may differ in a candidate: 4.8 of 24 do on average at a similarity of 0.8 (deviation 2.0), more than 13 in less than one pair in 10,000.
DIFFERING = 13
#: Rounds that link classes to pivots before pairs are made; their number changes the cost, not the result.
ROUNDS = 2
#: Bytes of a line in the last join besides its set.
ROW_BYTES = 192
#: Classes of a group that are compared with each other in one key of the last join.
BLOCK = 1024
#: The last join shuffles about this much at a time: a group's members stand there once for each of its blocks, which grows faster than the input.
SLICE_BYTES = 2 << 30
#: Shingles of a line that one row of the signatures' aggregate holds: its minimums are looked up and written once for all of them.
AT_ONCE = 8
#: A table of at most this size (counted rows times bytes a row) is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: After the band's number in the top three bits; any constants do.
_MIXED = [(k << 61) + (0x243F6A8885A308D3 * (k + 1)) % (1 << 61) for k in range(BANDS)]


def if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def code_units(line: Column) -> Column:
    """Two bytes a character, so that a shingle is found without walking the line."""
    return F.encode(line, "UTF-16BE")


def last_place(units: Column) -> Column:
    return F.greatest(F.shiftright(F.length(units), 1) - SHINGLE, F.lit(0))


def shingles(units: Column, f: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Hashes of all shingles of a line's code units, repeated ones too. The code units are a lambda's variable, as a lambda copies a
    row's whole binary whenever it reads it: once a line here, not once a shingle."""
    firsts = F.sequence(F.lit(1), F.greatest(F.length(units) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))
    made = F.transform(F.array(units), lambda u: F.transform(firsts, lambda i: f(F.substring(u, i, F.lit(2 * SHINGLE)))))
    return F.element_at(made, 1)


def shingle_set(units: Column, f: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Distinct shingles (as hashes: Spark's set functions compare binaries one by one) of a line's code units."""
    return F.array_distinct(shingles(units, f))


def short_hash(shingle: Column) -> Column:
    return F.shiftright(F.hash(shingle), 16).cast("short")


def similar(x: str, y: str, percent: int) -> Column:
    """Whether two sets have at least that Jaccard similarity: 100 * shared >= percent * (x + y - shared), with one intersection."""
    return F.lit(100 + percent) * F.size(F.array_intersect(x, y)) >= F.lit(percent) * (F.size(x) + F.size(y))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_a, row_b (stand for a row's id and text), place (order of document and line), pos, line and its class (a, b: 128 bits)."""
    own = docs.select(F.col(id_col).cast("decimal(20)").alias("doc"), F.xxhash64(id_col, text_col).alias("row_a"), F.xxhash64(text_col, id_col, F.lit(7)).alias("row_b"), F.split(text_col, "\n").alias("raws"))
    own = own.select("doc", "row_a", "row_b", F.posexplode("raws").alias("pos", "raw"))  # beside the explode, hashes of a row would be made for each line
    place = F.coalesce(F.col("doc") * F.lit(1 << 32).cast("decimal(12)"), F.lit("1" + 30 * "0").cast("decimal(32)")) + F.col("pos")
    own = own.select("row_a", "row_b", place.cast("decimal(38)").alias("place"), "pos", F.trim("raw").alias("line")).where("line != ''")
    return own.select("*", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(11)).alias("b"))


def _signed_64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signed(lines: DataFrame) -> DataFrame:
    """a, often (occurrences), keys (one for each band), s0 and s1 (four bits of each minimum). Buffers are numbers alone, so that the aggregate hashes and never sorts the exploded shingles."""
    own = lines.select("a", code_units(F.col("line")).alias("units"))
    each = own.select("a", "units", last_place(F.col("units")).alias("last"))
    each = each.select("a", "units", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(AT_ONCE))).alias("i"))
    at = [F.least(F.col("i") + j, F.col("last")) if j else F.col("i") for j in range(AT_ONCE)]  # the last shingle again where a row has places left
    each = each.select("a", F.when(F.col("i") == 0, 1).alias("one"), *[F.xxhash64(F.substring("units", i * 2 + 1, F.lit(2 * SHINGLE))).alias(f"h0_{j}") for j, i in enumerate(at)])
    each = each.select("*", *[F.xxhash64(f"h0_{j}", F.lit(r)).alias(f"h{r}_{j}") for r in range(1, ROWS) for j in range(AT_ONCE)])
    least = [F.min(F.least(*[F.col(f"h{r}_{j}").bitwiseXOR(F.lit(_signed_64(_MIXED[k]))) for j in range(AT_ONCE)])).alias(f"m{k * ROWS + r}") for k in range(BANDS) for r in range(ROWS)]
    sigs = each.groupBy("a").agg(F.count("one").alias("often"), *least)
    keys = F.array(*[F.xxhash64(F.lit(k), *[f"m{k * ROWS + r}" for r in range(ROWS)]) for k in range(BANDS)])
    bits = [F.shiftrightunsigned(F.hash(f"m{k}"), 28).cast("long") for k in range(BANDS * ROWS)]
    packed = [sum((F.shiftleft(b, 4 * j) for j, b in enumerate(bits[k + 1 : k + 12], 1)), bits[k]) for k in (0, 12)]
    return sigs.select("a", "often", keys.alias("keys"), packed[0].alias("s0"), packed[1].alias("s1"))


def differing(other: str) -> Column:
    """Minimums in which s0, s1 and those of another line differ, as far as four bits tell."""
    total = None
    for k in (0, 1):
        x = F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}{other}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        n = F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))
        total = n if total is None else total + n
    return total


def occurrences(lines: DataFrame) -> DataFrame:
    """a, b, first (place), n: each class once."""
    return lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n"))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (p, id), those whose full sets are similar enough."""
    both = pairs.join(as_other(texts), "p").join(texts, "id")
    # The explode holds the filter back: below the sets, it would make them again wherever it names them.
    both = both.select("p", "id", F.explode(F.array(F.struct(shingles(F.col("units_p")).alias("x"), shingles(F.col("units")).alias("y")))).alias("of"))
    alike = F.lit(100) * F.size(F.array_intersect("of.x", "of.y")) >= F.lit(PERCENT) * F.size(F.array_union("of.x", "of.y"))
    return both.where(alike).select(F.col("p").alias("a"), F.col("id").alias("b"))


def as_other(df: DataFrame, *keep: str) -> DataFrame:
    """The other side of a pair: id is p there, and what isn't in keep ends in _p."""
    return df.select(*[F.col(c).alias(c if c in keep else "p" if c == "id" else f"{c}_p") for c in df.columns])


def in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members twice, with x and y, so that in a join by key, x and y all blocks of a group meet two by two."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(sizes, "key").withColumn("x", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    left = own.withColumn("y", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1))).drop("blocks")
    right = own.withColumnRenamed("x", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y")))).drop("blocks")
    return left, as_other(right, "key", "x", "y")


def close_within(members: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of members (key, id, component) that stand in the same group, in different components, and whose sets are similar
    as far as 16-bit hashes tell (they make sets look more alike rather than less): each pair at the first key that it shares. The join
    gives only those. A line stands there once for each key and block, so its set's size is most of what this round shuffles."""
    sets = stage(texts.join(members.select("id").distinct(), "id", "left_semi").select("id", shingle_set(F.col("units"), short_hash).alias("set")).withColumn("held", F.size("set") * 2 + ROW_BYTES), "line-sets")
    marked = members.join(near.select("id", "s0", "s1", "keys"), "id").select("key", "id", "component", "s0", "s1", "keys")
    n = slices(members, sets)
    if n == 1:
        return close_at(*in_blocks(marked.join(sets.drop("held"), "id")))
    out = None
    for k in range(n):  # in turn, so that one slice's shuffle files are gone before the next one's are written
        mine = F.pmod(F.xxhash64("key", "x", "y", F.lit(9)), F.lit(n)) == k
        found = stage(close_at(*[side.where(mine) for side in in_blocks(marked.join(sets.drop("held"), "id"))]), "line-close")
        sweep(members.sparkSession)
        out = found if out is None else out.union(found)
    return out


def slices(members: DataFrame, sets: DataFrame) -> int:
    """In how many turns all blocks meet: from the bytes of both sides of the join, in which a group of n blocks has each member n + 1 times."""
    each = members.join(sets.select("id", "held"), "id").groupBy("key").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    total = each.agg(F.sum(F.col("held") * (F.ceil(F.col("n") / BLOCK) + 1))).first()[0]
    return max(1, math.ceil((total or 0) / SLICE_BYTES))


def close_at(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of the two sides that in_blocks() makes."""
    apart = (F.col("component") != F.col("component_p")) & (differing("_p") <= DIFFERING)
    at = [left[c] == right[c] for c in ("key", "x", "y")]
    sides = (left["x"] < left["y"]) | (F.col("p") < F.col("id"))
    first = F.coalesce(*[F.when(F.get("keys", F.lit(k)) == F.get("keys_p", F.lit(k)), F.get("keys", F.lit(k))) for k in range(BANDS)])
    sizes = F.lit(100) * F.least(F.size("set"), F.size("set_p")) >= F.lit(PERCENT - 1) * F.greatest(F.size("set"), F.size("set_p"))
    alike = [sides, apart, sizes, first == left["key"], similar("set", "set_p", PERCENT - 1)]  # cheap ones first
    return left.join(right, [*at, *alike]).select("p", "id")


def linked(lines: DataFrame, sigs: DataFrame) -> DataFrame:
    """id, component of the classes that have links to others; id is a class's `a`."""
    spark = sigs.sparkSession
    sweep(spark)
    keys = sigs.select(F.col("a").alias("id"), F.explode("keys").alias("key"))
    groups = stage(keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("id"), F.count("*").alias("n")).where("n > 1"), "line-groups")
    sweep(spark)
    large = groups.where("n > 2").select("key")
    held = stage(keys.join(if_small(large, large.count(), 24), "key"), "line-keys")
    sweep(spark)
    two = groups.where("n = 2").select("p", "id").distinct()
    wanted = stage(held.select("id").union(two.select("id")).union(two.select("p")).distinct(), "line-candidates")
    n_wanted = wanted.count()
    near = stage(sigs.withColumnRenamed("a", "id").join(if_small(wanted, n_wanted, 24), "id", "left_semi"), "line-near")
    texts = lines.select(F.col("a").alias("id"), "line").join(if_small(wanted, n_wanted, 24), "id", "left_semi")
    texts = stage(texts.groupBy("id").agg(F.first("line").alias("line")).select("id", code_units(F.col("line")).alias("units")), "line-texts")
    unstage(sigs)
    sweep(spark)
    marks = near.select("id", "s0", "s1")
    two = two.join(as_other(marks), "p").join(marks, "id").where(differing("_p") <= DIFFERING).select("p", "id")
    members = held.join(near.select("id", "often", "s0", "s1"), "id")
    all_, links = stage(members.withColumn("component", F.col("id")), "line-members"), None
    members = all_
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:  # the class that occurs most is the pivot, then any
            first = F.struct(-F.col("often"), "id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            pivots = members.groupBy("key").agg(F.min_by(F.struct("id", "component", "s0", "s1"), first).alias("p"))
            other = pivots.select("key", F.col("p.id").alias("p"), F.col("p.component").alias("component_p"), F.col("p.s0").alias("s0_p"), F.col("p.s1").alias("s1_p"))
            pairs = members.join(other, "key").where((F.col("component") != F.col("component_p")) & (differing("_p") <= DIFFERING)).select("p", "id")
            pairs = pairs.union(two) if turn == 0 else pairs
        else:
            pairs = close_within(members.select("key", "id", "component"), near, texts)
        pairs = pairs.select(F.least("p", "id").alias("p"), F.greatest("p", "id").alias("id")).distinct()
        found = stage(confirmed(pairs, texts), "line-links")
        sweep(spark)
        links = found if links is None else links.union(found)
        reached = stage(components(links, native=True), "line-components")
        sweep(spark)
        if turn < ROUNDS:
            members = all_.drop("component").join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            members = stage(members.join(several, "key"), "line-open-keys")
            if members.isEmpty():
                break
    return reached.withColumnRenamed("node", "id")


def dropped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_a, row_b, drop (positions of the lines that go) for rows that lose lines."""
    lines = lines_of(docs, id_col, text_col)
    reached = linked(lines, stage(signed(lines), "line-signatures"))
    known = stage(occurrences(lines), "line-classes")
    sweep(docs.sparkSession)
    known = known.join(reached, known.a == reached.id, "left").where("n > 1 or component is not null").select("a", "b", "first", "n", F.coalesce("component", "a").alias("component"), F.when(F.col("component").isNull(), F.col("b")).alias("alone"))
    known = stage(known, "line-repeats")
    sweep(docs.sparkSession)
    firsts = known.groupBy("component", "alone").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).where("all > 1")
    again = stage(known.select("a", "b", "component", "alone").join(firsts.withColumnsRenamed({"component": "c", "alone": "d"}), F.expr("component = c and alone <=> d")).select("a", "b", "keep"), "repeated-lines")
    gone = lines.select("row_a", "row_b", "place", "pos", "a", "b").join(if_small(again, again.count(), 64), ["a", "b"]).where("place > keep")
    out = stage(gone.groupBy("row_a", "row_b").agg(F.collect_set("pos").alias("drop")), "dropped-lines")
    sweep(docs.sparkSession)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cut to the lines that stay, and n_lines, n_removed (of the lines that take part or not)."""
    ready(docs.sparkSession)
    drop = dropped(docs, id_col, text_col)
    size = drop.agg(F.count("*").alias("n"), F.sum(F.size("drop")).alias("m")).first()
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(names)], F.xxhash64(id_col, text_col).alias("row_a"), F.xxhash64(text_col, id_col, F.lit(7)).alias("row_b"))
    text = F.col(f"in_{names.index(text_col)}")
    own = own.join(if_small(drop, size.n, 72 + 8 * int((size.m or 0) / max(1, size.n))), ["row_a", "row_b"], "left")
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("drop", i)), "\n"))
    columns = [(kept if c == text_col else F.col(f"in_{k}")).alias(c) for k, c in enumerate(names)]
    extra = {"n_lines": F.coalesce(F.when(text.isNotNull(), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("drop"), F.lit(0)).cast("long")}
    return own.select(*columns, *[v.alias(k) for k, v in extra.items() if k not in names])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
