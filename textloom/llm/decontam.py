"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts become token lists in which numbers, units and names are typed placeholders (slots). Windows of WINDOW template
tokens are hashed and joined with those of the benchmark's items, so that a question with other numbers or names still
matches. A window of more than MOST_SLOTS slots says little by itself: it is joined by its values, or counts where it
matches along an alignment of item and document that another window found. Then slots are checked: along one alignment,
each value of the item must always stand for the same value of the document; windows that hold one which doesn't go. An
item is found where enough of its windows are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, text_or_empty

#: Tokens a window; share of an item's windows that must match; slots of a window that is joined by its template at most.
WINDOW, COVERAGE, MOST_SLOTS = 5, 0.5, 3
#: Tables of the benchmark, and of findings, up to so many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
UNITS = ["mm", "cm", "m", "km", "g", "kg", "t", "l", "ml", "s", "sec", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "mile", "miles", "mph", "percent", "meter", "meters", "liter", "liters", "gram", "grams", "pound", "pounds", "inch", "inches", "foot", "feet"]
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = "0", "1", "2"


def tokens(text: Column) -> Column:
    """Lower-case words; numbers whole; names as ``~name``: capitalised words after a lower-case letter, number or comma
    and a blank, or before a blank and another capitalised word, so that all words of a full name are names."""
    text = F.translate(text, "~", " ")
    text = F.regexp_replace(text, r"(?<=[\p{Ll}0-9,] )\p{Lu}\p{Ll}+|\p{Lu}\p{Ll}+(?= \p{Lu}\p{Ll})", "~$0")
    text = F.regexp_replace(F.lower(text), r"([0-9])[.,:/]([0-9])", "$1_$2")
    return F.filter(F.split(text, r"[^\p{L}0-9_~]+"), lambda w: w != "")


def template(words: Column) -> Column:
    """tokens with slots in place of numbers, of units after numbers and of names."""

    def typed(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        # get() of the index before the first gives null.
        before = F.substring(F.get(words, i - 1), 1, 1)
        number = first.between("0", "9")
        unit = before.between("0", "9") & w.isin(UNITS)
        return F.when(number, NUMBER_SLOT).when(first == "~", NAME_SLOT).when(unit, UNIT_SLOT).otherwise(w)

    return F.transform(words, typed)


def _is_slot(w: Column) -> Column:
    return w.isin(NUMBER_SLOT, UNIT_SLOT, NAME_SLOT)


def _n_slots(typed: Column, at: Column, window: int) -> Column:
    return sum((_is_slot(F.get(typed, at + k)).cast("int") for k in range(1, window)), _is_slot(F.get(typed, at)).cast("int"))


def _windows(words: Column, typed: Column, window: int) -> Column:
    """Structs (at, n_slots, h) of a text's windows; h is a hash of the template, of the values where slots are too many."""
    last = F.size(typed) - window
    at = F.when(last >= 0, F.sequence(F.lit(0), last))

    def one(i: Column) -> Column:
        by_template = F.xxhash64(*[F.get(typed, i + k) for k in range(window)])
        by_values = F.xxhash64(F.lit("="), *[F.get(words, i + k) for k in range(window)])
        n_slots = _n_slots(typed, i, window)
        return F.struct(i.alias("at"), n_slots.alias("n_slots"), F.when(n_slots > MOST_SLOTS, by_values).otherwise(by_template).alias("h"))

    return F.transform(at, one)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """df, a table that was cut, marked for a broadcast if its rows have BROADCAST_BYTES as JSON at most."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched (its distinct windows found), coverage, n_slots_checked of all findings.

    A finding is a document in which at least ``coverage`` of an item's windows match with consistent slots. Items of
    fewer than ``window`` tokens are found where they are the whole document; such a match is one window. Null and empty
    items are found nowhere. Rows that repeat an id are searched as one document or item; equal items are each found;
    null ids are not reported; other columns are ignored.
    """
    # Each list is a column of its own before it is used more than once, or it would be computed anew for each element;
    # explode_outer, as for explode Spark puts a filter that computes the whole list again below all of these columns.
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(text_or_empty(item_text)).alias("item_words")).where("item_id IS NOT NULL")
    items = cut(items.withColumn("item_typed", template(F.col("item_words"))).withColumn("n_tokens", F.size("item_words")).where("n_tokens > 0"), "leak-items")
    asked = items.withColumn("w", _windows(F.col("item_words"), F.col("item_typed"), window)).select("item_id", F.explode_outer("w").alias("w")).where("w IS NOT NULL")
    asked = cut(asked.select("item_id", F.col("w.at").alias("item_at"), "w.n_slots", "w.h"), "leak-windows")
    rich = F.col("n_slots") > MOST_SLOTS
    sizes = cut(asked.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(rich, F.col("item_at"))).alias("n_rich")), "leak-sizes")

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).where("doc_id IS NOT NULL")
    typed = rows.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", "words", template(F.col("words")).alias("typed"))
    found = typed.select("doc_id", _windows(F.col("words"), F.col("typed"), window).alias("w")).select("doc_id", F.explode_outer("w").alias("w")).where("w IS NOT NULL").select("doc_id", F.col("w.at").alias("at"), "w.h")
    hits = cut(found.join(_maybe_broadcast(asked), "h").select("doc_id", "item_id", "item_at", "n_slots", (F.col("at") - F.col("item_at")).alias("shift")), "leak-hits")
    slotted = _sound_slots(_alignments(hits, sizes, coverage), items, rows, window)
    sound = hits.where("n_slots = 0").select("doc_id", "item_id", "item_at", "n_slots").unionByName(slotted)
    counts = sound.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n_matched"), F.countDistinct(F.when(F.col("n_slots") > 0, F.col("item_at"))).alias("n_slots_checked"))
    out = counts.join(_maybe_broadcast(sizes), "item_id").where(F.col("n_matched") >= coverage * F.col("n_windows"))
    out = out.select("doc_id", "item_id", "n_windows", "n_matched", F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"), "n_slots_checked")
    short = cut(items.where(F.col("n_tokens") < window), "leak-short")
    return out if short.isEmpty() else out.unionByName(_whole(rows, short, window))


def _whole(rows: DataFrame, short: DataFrame, window: int) -> DataFrame:
    """The findings of items that are too short for a window."""
    words = rows.select("doc_id", tokens(F.col("text")).alias("words")).where(F.size("words") < window)
    both = words.join(_maybe_broadcast(short), F.col("words") == F.col("item_words")).dropDuplicates(["doc_id", "item_id"])
    one = F.lit(1).cast("long")
    return both.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"), F.exists("item_typed", _is_slot).cast("long").alias("n_slots_checked"))


def _alignments(hits: DataFrame, sizes: DataFrame, coverage: float) -> DataFrame:
    """doc_id, item_id, shift where slots are to be looked at, of pairs that could have enough windows."""
    pairs = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n_found"), F.max("n_slots").alias("most"))
    pairs = pairs.join(_maybe_broadcast(sizes), "item_id").where((F.col("n_found") + F.col("n_rich") >= coverage * F.col("n_windows")) & (F.col("most") + F.col("n_rich") > 0))
    return hits.join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", "item_id", "shift").distinct()


def _sound_slots(alignments: DataFrame, items: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """doc_id, item_id, item_at, n_slots of the windows with slots that match along alignments with consistent values."""
    wanted = alignments.join(_maybe_broadcast(cut(items.select("item_id", "n_tokens"), "leak-lengths")), "item_id")
    wanted = cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "n_tokens")).alias("wanted")), "leak-wanted")
    words = rows.join(_maybe_broadcast(wanted), "doc_id").select("doc_id", "wanted", tokens(F.col("text")).alias("words"))
    seen = words.select("doc_id", "words", template(F.col("words")).alias("typed"), F.explode_outer("wanted").alias("x"))
    along = lambda c: F.transform(F.sequence(F.lit(0), F.col("x.n_tokens") - 1), lambda i: F.get(F.col(c), F.col("x.shift") + i))
    seen = seen.select("doc_id", "x.item_id", "x.shift", along("words").alias("words"), along("typed").alias("typed"))
    both = seen.join(_maybe_broadcast(items), "item_id").where(F.col("n_tokens") >= window)
    at = F.sequence(F.lit(0), F.col("n_tokens") - window)
    equal = lambda i, a, b: F.forall(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.get(F.col(a), i + k).eqNullSafe(F.get(F.col(b), i + k)))
    matched = both.withColumn("matched", F.transform(F.filter(at, lambda i: equal(i, "typed", "item_typed")), lambda i: F.struct(i.alias("at"), _n_slots(F.col("item_typed"), i, window).alias("n_slots"))))
    matched = matched.withColumn("anchored", F.exists("matched", lambda w: w["n_slots"] <= MOST_SLOTS))
    counts = F.filter("matched", lambda w: (w["n_slots"] > 0) & ((w["n_slots"] <= MOST_SLOTS) | F.col("anchored") | equal(w["at"], "words", "item_words")))
    windows = matched.withColumn("w", F.explode_outer(counts)).where("w IS NOT NULL").select("doc_id", "item_id", "shift", F.col("w.at").alias("item_at"), "w.n_slots", *[F.slice(c, F.col("w.at") + 1, F.lit(window)).alias(c) for c in ("words", "item_words", "item_typed")])
    windows = cut(windows, "leak-slotted")
    slots = windows.select("doc_id", "item_id", "shift", "item_at", F.explode(F.arrays_zip("item_typed", "item_words", "words")).alias("z")).where(_is_slot(F.col("z.item_typed")))
    slots = slots.select("doc_id", "item_id", "shift", "item_at", F.col("z.item_typed").alias("kind"), F.col("z.item_words").alias("value"), F.col("z.words").alias("stands_for"))
    of = ["doc_id", "item_id", "shift", "kind", "value"]
    wrong = slots.groupBy(*of).agg(F.min("stands_for").alias("lo"), F.max("stands_for").alias("hi")).where("lo != hi").select(*of)
    bad = slots.join(wrong, of, "left_semi").select("doc_id", "item_id", "shift", "item_at").distinct()
    return windows.join(bad, ["doc_id", "item_id", "shift", "item_at"], "left_anti").select("doc_id", "item_id", "item_at", "n_slots")


#: The same for DuckDB, over documents and benchmark. It has no lookbehind, so names after names are marked in a second pass.
_NAMES = "regexp_replace({}, '([\\p{{Ll}}0-9,] )(\\p{{Lu}}\\p{{Ll}}+)', '\\1~\\2', 'g')"
_FIRST_NAMES = "regexp_replace(replace(coalesce(text, ''), '~', ' '), '(\\p{Lu}\\p{Ll}+)( \\p{Lu}\\p{Ll})', '~\\1\\2', 'g')"
_SLOTS = f"('{NUMBER_SLOT}', '{UNIT_SLOT}', '{NAME_SLOT}')"
ORACLE_SQL = f"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(regexp_replace(lower({_NAMES.format(_NAMES.format(_FIRST_NAMES))}),
    '([0-9])[.,:/]([0-9])', '\\1_\\2', 'g'), '[^\\p{{L}}0-9_~]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark) WHERE id IS NOT NULL),
typed AS (
  SELECT kind, id, w, list_transform(w, lambda x, i: CASE WHEN x[1] BETWEEN '0' AND '9' THEN '{NUMBER_SLOT}' WHEN x[1] = '~' THEN '{NAME_SLOT}'
    WHEN i > 1 AND w[i - 1][1] BETWEEN '0' AND '9' AND x IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN '{UNIT_SLOT}' ELSE x END) AS t FROM words),
win AS (
  SELECT kind, id, i - 1 AS pos, t[i:i + {WINDOW - 1}] AS shape, w[i:i + {WINDOW - 1}] AS vals, len(list_filter(t[i:i + {WINDOW - 1}], lambda x: x IN {_SLOTS})) AS n_slots
  FROM (SELECT kind, id, w, t, unnest(generate_series(1, len(t) - {WINDOW - 1})) AS i FROM typed WHERE len(t) >= {WINDOW})),
b AS (SELECT id AS item_id, pos AS item_at, shape, vals AS item_vals, n_slots FROM win WHERE kind = 'b'),
d AS (SELECT id AS doc_id, pos, shape, vals FROM win WHERE kind = 'd'),
items AS (SELECT item_id, count(DISTINCT item_at) AS n_windows FROM b GROUP BY item_id),
poor AS (SELECT doc_id, item_id, item_at, pos - item_at AS shift, n_slots, b.shape, vals, item_vals FROM b JOIN d ON d.shape = b.shape WHERE n_slots <= {MOST_SLOTS}),
hits AS (
  SELECT * FROM poor
  UNION SELECT doc_id, item_id, item_at, pos - item_at, n_slots, b.shape, vals, item_vals FROM b JOIN d ON d.shape = b.shape AND vals = item_vals WHERE n_slots > {MOST_SLOTS}
  UNION SELECT doc_id, item_id, item_at, shift, n_slots, b.shape, vals, item_vals
    FROM (SELECT DISTINCT doc_id, item_id, shift FROM poor) JOIN b USING (item_id) JOIN d USING (doc_id) WHERE n_slots > {MOST_SLOTS} AND pos = item_at + shift AND d.shape = b.shape),
slots AS (
  SELECT doc_id, item_id, shift, item_at, shape[k] AS s, item_vals[k] AS a, vals[k] AS v
  FROM hits, generate_series(1, {WINDOW}) AS g(k) WHERE n_slots > 0 AND shape[k] IN {_SLOTS}),
wrong AS (SELECT doc_id, item_id, shift, s, a FROM slots GROUP BY ALL HAVING min(v) <> max(v)),
bad AS (SELECT DISTINCT doc_id, item_id, shift, item_at FROM slots SEMI JOIN wrong USING (doc_id, item_id, shift, s, a)),
sound AS (SELECT doc_id, item_id, item_at, n_slots FROM hits ANTI JOIN bad USING (doc_id, item_id, shift, item_at))
SELECT doc_id, item_id, n_windows, n_matched, round(n_matched / n_windows, 6) AS coverage, n_slots_checked
FROM (SELECT doc_id, item_id, count(DISTINCT item_at) AS n_matched, count(DISTINCT CASE WHEN n_slots > 0 THEN item_at END) AS n_slots_checked
      FROM sound GROUP BY doc_id, item_id) JOIN items USING (item_id)
WHERE n_matched >= {COVERAGE} * n_windows
UNION ALL
SELECT DISTINCT x.id, y.id, 1, 1, 1.0, CAST(len(list_filter(y.t, lambda x: x IN {_SLOTS})) > 0 AS BIGINT)
FROM typed x JOIN typed y ON x.w = y.w WHERE x.kind = 'd' AND y.kind = 'b' AND len(x.w) BETWEEN 1 AND {WINDOW - 1}"""
