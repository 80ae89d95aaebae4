"""Secret scans (op9), in DataFrame functions alone: fixed patterns, and character Markov models compared by log-likelihood ratio.

Fixed patterns give spans of the kinds assign, access and hex. Besides, runs of at least LEAST_VALUE characters that secrets are made of,
outside of those spans, are scored under two first-order character models: one trained on random strings (made by hashing, and the secrets
that the patterns find in a sample), one on the sample's ordinary runs (words, identifiers, addresses: those under LABELLED characters, and
longer ones without digits). Running sums find the stretches of a run where the log-likelihood ratio rises most, so that a path or name
before a secret doesn't dilute it: a stretch is a span of the kind `random` if its ratio is at least LEAST_TOTAL in all and LEAST_MEAN a step.

Each distinct run is scored once, wherever and however often it stands; runs without enough rising steps are left out by their sum alone.
Then texts look up which of their runs hold stretches, and only for those are places counted.

The models are fitted on at most `sample` documents (those with the smallest hash of their id); every whole text is scanned. Places count
code points.

Defined results: a null text counts as empty (no spans); rows with a null id are scanned like others; repeated rows each give a row; an
empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stage, table
from .line_dedup import if_small

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least length in the pattern: a run that is too short holds no match further on.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
WORDS_BEFORE = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LABELLED, LEAST_TOTAL, LEAST_MEAN = 20, 12.0, 0.6
RUN = "[A-Za-z0-9+/_.=-]{%d,}" % LEAST_VALUE
SAMPLE, RANDOM_STRINGS = 2000, 2000
_WIDE = len(ALPHABET) + 1
_NONE = "array<struct<start:int,kind:int,stop:int,value:string>>"


def places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all matches, with the text of a group: what lies between the matches gives their places."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["between"]
        stop = at + F.length(x["found"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value")))).cast(_NONE).alias("out"))

    rows = F.filter(F.arrays_zip(between.alias("between"), found.alias("found"), value.alias("value")), lambda x: x["found"].isNotNull())
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start and kind."""
    none, low = F.array().cast(_NONE), F.lower(text)
    maybe = F.lit(False)
    for w in WORDS_BEFORE:
        maybe = maybe | F.contains(low, F.lit(w))
    assign = F.when(maybe, F.filter(places(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), places(text, ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), places(text, HEX, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def codes(run: Column) -> Column:
    """Places of a run's characters in the alphabet, from 1; 0 for others."""
    return F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def steps_of(run: Column) -> Column:
    """A number for each pair of neighbouring characters."""
    x = codes(run)
    n = F.size(x) - 1
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda p, q: p * _WIDE + q)


def fit(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of random against ordinary for each pair of characters."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    own = stage(scanned(docs, id_col, text_col).join(F.broadcast(ids), "id").select("base.value", "rest"), "secrets-sample")
    secrets = own.select(F.explode("value").alias("run"), F.lit(1).alias("random"))
    runs = own.select(F.explode(F.regexp_extract_all("rest", F.lit("[A-Za-z0-9+/_.=-]{4,}"), F.lit(0))).alias("run"), F.lit(0).alias("random"))
    runs = runs.where((F.length("run") < LABELLED) | ~F.col("run").rlike("[0-9]"))  # long runs with digits may be secrets: no label
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    made = spark.range(RANDOM_STRINGS).select(F.explode(F.array(F.base64(F.unhex(digest)), digest, F.translate(F.base64(F.unhex(digest)), "+/=abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234"))).alias("run"), F.lit(1).alias("random"))
    pairs = secrets.unionByName(runs).unionByName(made).distinct().where(F.length("run") >= 2).select("random", F.explode(steps_of(F.col("run"))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}

    def log_p(kind: int, p: int, q: int) -> float:
        row = sum(counts.get((kind, p * _WIDE + k), 0) for k in range(1, _WIDE))
        return math.log((counts.get((kind, p * _WIDE + q), 0) + 0.5) / (row + 0.5 * (_WIDE - 1)))

    return [log_p(1, p, q) - log_p(0, p, q) if p and q else 0.0 for p in range(_WIDE) for q in range(_WIDE)]


def masked(text: Column, base: Column) -> Column:
    """The text with blanks in place of the fixed spans, as long as before."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        stop = F.greatest(acc["at"], b["stop"])
        own = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), b["start"] - acc["at"]))
        return F.struct(stop.alias("at"), F.rpad(F.concat(acc["out"], own), stop, " ").alias("out"))

    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(base, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_a and row_b (stand for id and text), base (spans of the fixed patterns) and rest (the text without them)."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("id", F.xxhash64("id", "text").alias("row_a"), F.xxhash64("text", "id", F.lit(7)).alias("row_b"), "text", base_spans(F.col("text")).alias("base"))
    return own.select("id", "row_a", "row_b", "base", masked(F.col("text"), F.col("base")).alias("rest"))


def stretches(weights: Column) -> Column:
    """Where the ratio's running sum rises by enough: from its last rise above 0 to its peak, closed by a fall to 0 or by LEAST_TOTAL."""
    none = "array<struct<start:int,stop:int>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("begin"), F.lit(0.0).alias("best"), F.lit(0).alias("peak"), F.array().cast(none).alias("out"))

    def closed(acc: Column) -> Column:
        enough = (acc["best"] >= LEAST_TOTAL) & (acc["best"] >= LEAST_MEAN * (acc["peak"] - acc["begin"]))
        return F.when(enough, F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("start"), (acc["peak"] + 1).alias("stop"))))).otherwise(acc["out"]).cast(none)

    def step(acc: Column, w: Column) -> Column:
        i, total = acc["i"] + 1, acc["sum"] + w
        rise = F.struct(i.alias("i"), total.alias("sum"), acc["begin"].alias("begin"), F.greatest(total, acc["best"]).alias("best"), F.when(total > acc["best"], i).otherwise(acc["peak"]).alias("peak"), acc["out"].alias("out"))
        fall = F.struct(i.alias("i"), F.lit(0.0).alias("sum"), i.alias("begin"), F.lit(0.0).alias("best"), i.alias("peak"), closed(acc).alias("out"))
        return F.when((total <= 0) | (total <= acc["best"] - LEAST_TOTAL), fall).otherwise(rise)

    return F.aggregate(weights, zero, step, closed)


def random_runs(texts: DataFrame, ratios: Column) -> DataFrame:
    """run, h (its hash), hits: each distinct run that holds a stretch."""
    runs = texts.select(F.explode(F.regexp_extract_all("rest", F.lit(RUN), F.lit(0))).alias("run")).distinct()
    runs = runs.select("run", F.transform(steps_of(F.col("run")), lambda k: F.element_at(ratios, k + 1)).alias("w"))
    rising = F.aggregate("w", F.lit(0.0), lambda n, w: n + F.greatest(w, F.lit(0.0)))  # no stretch has more
    runs = runs.where(rising >= LEAST_TOTAL).select("run", F.xxhash64("run").alias("h"), stretches(F.col("w")).alias("hits"))
    return stage(runs.where(F.size("hits") > 0), "random-runs")


def random_spans(rest: Column, runs: Column) -> Column:
    """Spans of the kind random, from which runs (k: the place among the text's runs) hold which stretches."""
    between, sizes = (F.transform(x, F.length) for x in (F.split(rest, RUN, -1), F.regexp_extract_all(rest, F.lit(RUN), F.lit(0))))

    def total(x: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, b: a + b)

    starts = F.transform(runs, lambda r: F.struct((total(between, r["k"] + 1) + total(sizes, r["k"])).alias("at"), r["hits"].alias("hits")))
    each = F.transform(starts, lambda r: F.transform(r["hits"], lambda s: F.struct((r["at"] + s["start"]).alias("start"), F.lit(3).alias("kind"), (r["at"] + s["stop"]).alias("stop"), F.lit("").alias("value"))))
    return F.flatten(each).cast(_NONE)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    ready(docs.sparkSession)
    ratios = F.expr("array(" + ", ".join(f"{x!r}D" for x in fit(docs, id_col, text_col, sample)) + ")")  # a literal of fixed size
    texts = scanned(docs, id_col, text_col)
    known = random_runs(texts, ratios)
    places = texts.select("row_a", "row_b", F.posexplode(F.regexp_extract_all("rest", F.lit(RUN), F.lit(0))).alias("k", "run")).withColumn("h", F.xxhash64("run"))
    places = places.join(if_small(known.select("h").distinct(), known.count(), 24), "h", "left_semi").select("row_a", "row_b", "k", "run").distinct()
    found = stage(places.join(known.select("run", "hits"), "run").groupBy("row_a", "row_b").agg(F.collect_list(F.struct("k", "hits")).alias("runs")), "random-places")
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("runs")).alias("m")).first()
    own = texts.join(if_small(found, size.n + (size.m or 0), 96), ["row_a", "row_b"], "left")
    random = F.when(F.col("runs").isNotNull(), random_spans(F.col("rest"), F.col("runs"))).otherwise(F.array().cast(_NONE))
    own = own.select("id", "base", F.array_sort(F.concat("base", random)).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(spans: str, kind: int) -> Column:
        return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")

    return own.select(
        F.col("id").alias(id_col), *[number("base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), number("spans", 3).alias("n_random"),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
