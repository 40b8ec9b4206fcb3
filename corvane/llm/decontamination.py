"""Benchmark decontamination by template windows, with DataFrame functions alone.

Numbers, names and units of a text become typed placeholders; what is left is its template. Windows of
``WINDOW`` template tokens are hashed and joined with those of the benchmark items. Only an item's
smallest hashes take part in the join, as many as any document with the wanted coverage must share one of;
the documents that hold one are then measured on all windows of the item. For such a pair the values in
the slots are compared: one value of the item must always stand for one value of the document. That
catches a question whose numbers, names or units were changed throughout, and leaves alone a text that
merely has the same form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare

WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8  # windows are hashed in steps of 2, 4 and 5
#: An item's window needs so many plain words.
PLAIN = 2
#: Up to so many anchors are looked up in a set that goes along with the plan; more are joined by shuffle.
IN_PLAN = 20_000
#: Marks in front of slot values: name, number, unit.
NAME, NUMBER, UNIT, PLAINLY = "\u0001", "\u0002", "\u0003", "\u0004"
#: Words that count as units behind a number.
UNITS = (
    "mm cm dm m km in inch inches ft feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces ml cl l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years km/h mph kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal c f k percent pct dollar dollars euro euros "
    "cent cents usd eur gbp yen"
).split()

_MARKED = f"{NAME}{NUMBER}{UNIT}"
_CHAR = r"\p{L}\p{M}"
#: Words that are no names though a sentence or line may begin with them.
PLAIN_WORDS = (
    "i the an and or but if so as at by for from how of on to up with what when where which while who whose why is are was were do "
    "does did has have had can could will would should he she it its we you they his her their our your my this that these those "
    "there then thus each every all some any no not after before during since until find let given suppose calculate "
    "der die das ein eine und oder aber wenn wie was wo wer warum ist sind hat er sie es wir ihr in im mit von zu auf für "
    "le la les un une des et ou mais si comment quand où qui que quel quelle est sont il elle nous vous ils dans sur pour avec de du "
    "el los las una y o pero cómo cuándo dónde quién qué cuál es son ella nosotros en sobre para con del por"
).split()
#: A capitalised word, wherever it stands.
_NAME = (
    rf"(?=\p{{Lu}})(?<![{_CHAR}\p{{N}}_])(?!(?iu:{'|'.join(sorted({*PLAIN_WORDS, *UNITS}, key=lambda w: (-len(w), w)))})(?![{_CHAR}]))\p{{Lu}}[{_CHAR}]*+"
)
_MORE_NAME = rf"({NAME}[{_CHAR}]++)\s++(?={NAME})"
_STOPS = rf"(?<![0-9])[^{_CHAR}\p{{N}}\s{_MARKED}_]|[^{_CHAR}\p{{N}}\s{_MARKED}_](?![0-9])"
_NUMBER = r"\p{N}++(?:[^\p{L}\p{N}\p{M}\s]\p{N}++)*+"
_UNIT = rf"({NUMBER}\S++)\s*+(?i:({'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![{_CHAR}\p{{N}}])"


def template_tokens(text):
    """Array of tokens in order: lower-case words, and slot values with their type's mark in front."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_MARKED}{PLAINLY}]", " ")
    t = F.regexp_replace(t, _NAME, f"{NAME}$0")
    t = F.regexp_replace(t, _MORE_NAME, "$1_")
    t = F.regexp_replace(t, _STOPS, " ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}$0 ")
    t = F.regexp_replace(t, _UNIT, f"$1 {UNIT}$2 ")
    return F.array_remove(F.split(F.lower(t), r"\s+"), "")


def _bound(value, use):
    """``use`` of ``value``, which is made once (by way of a one-element array)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_tokens(text):
    """Array of lower-case words and numbers in order, nothing marked."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^{_CHAR}\p{{N}}]+"), "")


def _rolled(h, *salt):
    """Hash of every ``WINDOW`` neighbours of an array that holds as many: of pairs, of pairs of these, and of one more."""
    behind = lambda x, k, fewer: F.slice(x, 1 + k, F.size(x) - fewer)
    join = lambda x, y: F.xxhash64(x, y)
    fours = _bound(F.zip_with(behind(h, 0, 1), behind(h, 1, 1), join), lambda two: F.zip_with(behind(two, 0, 2), behind(two, 2, 2), join))
    return _bound(fours, lambda four: F.zip_with(behind(four, 0, 1), behind(h, WINDOW - 1, WINDOW - 1), lambda x, y: F.xxhash64(*salt, x, y)))


def plain_hashes(tokens):
    """Hash of every window of plain tokens; none if these are fewer. They differ from those of template windows."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return _bound(hashes, lambda h: F.when(F.size(h) < WINDOW, F.array().cast("array<long>")).otherwise(_rolled(h, F.lit(1))))


def window_hashes(tokens):
    """Hash of every window of template tokens; of all tokens, if these are fewer."""
    kinds = F.transform(tokens, lambda t: F.when(t < PLAINLY, F.ascii(t).cast("long")).otherwise(F.xxhash64(t)))
    return _bound(kinds, lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>")).when(F.size(h) < WINDOW, F.array(F.xxhash64(h))).otherwise(_rolled(h)))


def _fewest(asked):
    """The smallest of the asked windows, as many as any document with the wanted coverage must share one of."""
    many = F.size(asked) - F.ceil(F.lit(COVERAGE) * F.size(asked) - 1e-9).cast("int") + 1
    return F.slice(F.array_sort(asked), 1, many)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, tokens, all windows by position (null where a window has too few plain words), the distinct ones, plain ones, anchors."""
    rows = benchmark.select(
        F.col(item_col).alias("item"), template_tokens(F.col(text_col)).alias("i_tokens"), plain_tokens(F.col(text_col)).alias("i_plain")
    )
    rows = cut(rows.withColumn("raw", window_hashes(F.col("i_tokens"))).withColumn("raw_plain", plain_hashes(F.col("i_plain"))))
    plain = F.transform(
        F.col("raw"), lambda w, i: F.when(F.size(F.filter(F.slice("i_tokens", i + 1, WINDOW), lambda t: t >= PLAINLY)) >= PLAIN, w)
    )
    worded = F.transform(
        F.col("raw_plain"), lambda w, i: F.when(F.size(F.filter(F.slice("i_plain", i + 1, WINDOW), lambda t: t.rlike(r"\p{L}"))) >= PLAIN, w)
    )
    rows = rows.withColumn("i_windows", plain).withColumn("asked", F.array_distinct(F.array_compact("i_windows")))
    rows = rows.withColumn("asked_plain", F.array_distinct(F.array_compact(worded))).filter("size(asked) + size(asked_plain) > 0")
    return cut(rows.withColumn("anchors", F.concat(_fewest("asked"), _fewest("asked_plain"))).drop("raw", "raw_plain", "i_plain"))


def _values():
    """Distinct pairs of slot values (x of the item, y of the document) along the best alignment of a pair's windows.

    Every place of a window in the document counts. Each offset between two places is tried: a window is read at
    its place nearest to that offset. The reading with the highest consistency, then the fewest changed values, is taken.
    """
    held = F.filter(
        F.transform("windows", lambda w, j: F.struct(w.alias("w"), (j + 1).alias("j"))), lambda p: F.array_contains("asked", p["w"])
    )
    places = _bound(held, lambda h: F.filter(
        F.transform("i_windows", lambda w, i: F.struct((i + 1).alias("i"), F.transform(F.filter(h, lambda p: p["w"] == w), lambda p: p["j"]).alias("js"))),
        lambda p: F.size(p["js"]) > 0,
    ))

    def read(places, d):
        def nearest(p):
            return F.array_min(F.transform(p["js"], lambda j: F.struct(F.abs(j - p["i"] - d).alias("far"), j.alias("j"))))["j"]

        pairs = F.flatten(F.transform(
            places, lambda p: F.arrays_zip(F.slice("i_tokens", p["i"], WINDOW).alias("x"), F.slice("tokens", nearest(p), WINDOW).alias("y"))
        ))
        return F.array_distinct(F.filter(pairs, lambda v: v["x"] < PLAINLY))

    def judged(v, d):
        distinct = F.least(F.size(F.array_distinct(v["x"])), F.size(F.array_distinct(v["y"])))
        changed = F.size(F.filter(v, lambda p: p["x"] != p["y"]))
        return F.struct((-distinct / F.greatest(F.size(v), F.lit(1))).alias("bad"), changed.alias("changed"), d.alias("d"), v.alias("values"))

    def best(places):
        offsets = F.array_distinct(F.flatten(F.transform(places, lambda p: F.transform(p["js"], lambda j: j - p["i"]))))
        return F.array_min(F.transform(offsets, lambda d: _bound(read(places, d), lambda v: judged(v, d))))["values"]

    return _bound(places, best)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item that it gives away.

    A document gives an item away if it holds at least ``COVERAGE`` of the item's distinct template windows
    and at least ``CONSISTENCY`` of the slot values are used consistently, or if it holds ``COVERAGE`` of the item's
    plain windows, in any case of letters (then no slots are counted). Returns ``id_col``, ``item_col``,
    matched, windows, coverage, slots (distinct pairs of slot values), consistency, and reparameterised
    (whether any slot has another value than in the item).

    Where a window stands in several places of the document, that reading of all of them is judged which is most consistent.
    Null and empty texts give nothing away, nor are they given away; an item of fewer than ``WINDOW`` tokens is
    given away only by a text of the same tokens, and one without ``PLAIN`` plain words not at all. Repeated
    rows give their pair once; of rows that repeat an id with other texts, the one that gives most away is told of. Ids may be null. Other columns are left out; empty tables give no rows.
    """
    prepare(docs.sparkSession)
    items = _items(benchmark, item_col, item_text_col)
    anchors = items.select("item", F.explode("anchors").alias("anchor"))
    tokens = template_tokens(F.col(text_col))
    found = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), tokens.alias("tokens"))
    found = found.withColumn("plain", plain_hashes(plain_tokens(F.col("text"))))
    found = found.withColumn("windows", window_hashes(F.col("tokens"))).withColumn("all", F.concat("windows", "plain")).drop("text")
    wanted = [r[0] for r in anchors.select("anchor").distinct().limit(IN_PLAN + 1).collect()]
    if len(wanted) <= IN_PLAN:
        known = F.filter("all", lambda w: w.isin(wanted)) if wanted else F.array().cast("array<long>")
        held = cut(found.withColumn("known", F.array_distinct(known)).filter("size(known) > 0").drop("all"))
        hits = held.select("doc", "mark", F.explode("known").alias("anchor"))
    else:
        held = found
        hits = found.select("doc", "mark", F.explode(F.array_distinct("all")).alias("anchor"))
    pairs = hits.join(anchors, ["anchor"]).select("doc", "mark", "item").distinct()
    both = (
        pairs.join(held.dropDuplicates(["doc", "mark"]).withColumnRenamed("doc", "doc_").withColumnRenamed("mark", "mark_"),
                   F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("mark") == F.col("mark_")))
        .withColumnRenamed("item", "item_")
        .join(items, F.col("item_").eqNullSafe(F.col("item")))
        .withColumn("matched", F.size(F.array_intersect("asked", "windows")))
        .withColumn("coverage", F.when(F.size("asked") > 0, F.col("matched") / F.size("asked")).otherwise(0.0))
        .withColumn("copied", F.size(F.array_intersect("asked_plain", "plain")))
        .withColumn("copy", F.when(F.size("asked_plain") > 0, F.col("copied") / F.size("asked_plain")).otherwise(0.0))
        .filter((F.col("coverage") >= COVERAGE - 1e-9) | (F.col("copy") >= COVERAGE - 1e-9))
    )
    # each made once: filters behind it would otherwise repeat it
    both = cut(cut(both).withColumn("values", F.when(F.col("coverage") >= COVERAGE - 1e-9, _values())).drop("tokens", "windows", "i_tokens", "i_windows"))
    slots = F.size("values")
    distinct = F.least(F.size(F.array_distinct("values.x")), F.size(F.array_distinct("values.y")))
    both = both.withColumn("consistency", F.when(slots == 0, 1.0).otherwise(distinct / slots))
    told = F.coalesce(F.col("consistency") >= CONSISTENCY, F.lit(False))  # else the plain windows tell
    found = both.filter(told | (F.col("copy") >= COVERAGE - 1e-9)).select(
        F.col("doc"), F.col("item_"), F.when(told, F.col("coverage")).otherwise(F.col("copy")).alias("coverage"),
        F.when(told, F.col("consistency")).otherwise(1.0).alias("consistency"),
        F.when(told, F.col("matched")).otherwise(F.col("copied")).cast("long").alias("matched"),
        F.when(told, F.size("asked")).otherwise(F.size("asked_plain")).cast("long").alias("windows"),
        F.when(told, slots).otherwise(0).cast("long").alias("slots"),
        (told & F.exists("values", lambda v: v["x"] != v["y"])).alias("reparameterised"),
    )
    # rows may repeat an id with other texts: the one that gives most away is told of
    best = found.groupBy("doc", "item_").agg(F.max(F.struct("coverage", "consistency", "matched", "windows", "slots", "reparameterised")).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item_").alias(item_col), "x.matched", "x.windows", "x.coverage", "x.slots", "x.consistency", "x.reparameterised")
