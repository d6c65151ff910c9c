"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders,
punctuation goes, letters are lower-cased. Windows of five template words of an item are
hashed, a name both as placeholder and as the word it is, so copies in another case or
punctuation match; documents are cut into windows at every ``stride``-th word and hash-joined
with them. The stride is the length of a run of matching windows that any text of
the wanted similarity must have (``safe_stride``), so no such text is missed. The
documents found are then compared window by window, and the slot values of
matched windows are checked: an item's value must stand for one value of the document
throughout. So a question with other numbers or names is found, and a text that
merely has the same pattern is not.

A name is a capitalised word that another capitalised word may stand for; so is one
that opens a sentence, and half of the matched words must be no replaced names. A name
changed to a word without capital counts as a changed word. A unit is one of ``UNITS`` right after a number.

Defined cases: null and empty texts match nothing; items of fewer than five words
match nothing; repeated item rows count once an id, repeated documents each; only
the id and the text columns are read, so other columns cannot clash; a row is known
by its id and its text's hash, so a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scale import stored
from auditlake.llm.line_dedup import let

WORDS = 5
SIMILARITY = 0.8
SLOT_SHARE = 0.8
KEPT_SHARE = 0.5
MAX_STRIDE = 8
# Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal ms s sec secs min mins h hr hrs "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon "
    "gallons dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz "
    "b kb mb gb tb w kw v a c f k"
).split()
NUMBER, NAME, OPENER, UNIT = "0", "@", "^", "~"
_UNITS = "|".join(UNITS)


def marked(text: Column, item: bool = False) -> Column:
    """The text with single spaces, without punctuation, what may be a name prefixed with @.

    That is every capitalised word; ``_variants`` leaves open whether it is one. In
    items those that may be capitalised for opening a sentence are prefixed with ^.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), f"{NAME}{OPENER}{UNIT}", "")
    spaced = F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")
    if item:
        named = F.regexp_replace(spaced, r"(?<=[^.!?: ] )(\p{Lu}\p{Ll}+)", "@$1")
        clean = F.regexp_replace(named, r"[^\p{L}\p{M}\p{N}@ ]+", "")
        return F.regexp_replace(clean, r"(?<![^ ])(\p{Lu}\p{Ll})", f"{OPENER}$1")
    clean = F.regexp_replace(spaced, r"[^\p{L}\p{M}\p{N} ]+", "")
    return F.regexp_replace(clean, r"(?<![^ ])(\p{Lu}\p{Ll})", "@$1")


def template(marked_text: Column) -> Column:
    """Lower case, placeholders for numbers and units; names stay marked words."""
    numbers = F.when(
        marked_text.rlike(r"\p{N}"),
        F.regexp_replace(
            F.regexp_replace(marked_text, r"\p{N}+", NUMBER),
            rf"(?i)(?<=\b0 ?)[@^]?({_UNITS})(?![\p{{L}}\p{{N}}])", UNIT,
        ),
    ).otherwise(marked_text)
    return F.lower(numbers)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _variants(form: Column, at: Column) -> Column:
    """Hashes of a window, every marked word both as it is and as a name."""

    def both(done: Column, w: Column) -> Column:
        literal = F.transform(done, lambda a: F.concat(a, F.lit(" "), F.translate(w, NAME + OPENER, "")))
        return F.when(
            w.startswith(NAME) | w.startswith(OPENER),
            F.concat(literal, F.transform(done, lambda a: F.concat(a, F.lit(f" {NAME}"))))
        ).otherwise(literal)

    def hashed(joined: Column) -> Column:
        return F.when(~(joined.contains(NAME) | joined.contains(OPENER)), F.array(F.xxhash64(joined))).otherwise(
            F.transform(
                F.aggregate(F.slice(form, at + 1, WORDS), F.array(F.lit("")), both), lambda a: F.xxhash64(a)
            )
        )

    return let(F.concat(F.lit(" "), F.array_join(F.slice(form, at + 1, WORDS), " ")), hashed)


def _starts(n: Column, stride: int = 1) -> Column:
    """0, stride, ... up to the last whole window; none for short texts."""
    return F.when(n >= WORDS, F.sequence(F.lit(0), n - WORDS, F.lit(stride))).otherwise(
        F.array().cast("array<int>")
    )


def windows(text: Column, item: bool = False) -> Column:
    """Every window of a text: its first word, hashes, and words with their forms."""

    def all_windows(both: Column) -> Column:
        raw, form = both["raw"], both["form"]
        return F.transform(
            _starts(F.size(form)),
            lambda i: F.struct(
                i.alias("at"), _variants(form, i).alias("hashes"),
                F.slice(raw, i + 1, WORDS).alias("raw"), F.slice(form, i + 1, WORDS).alias("form"),
            ),
        )

    def words_of(clean: Column) -> Column:
        raw = words(F.lower(F.translate(clean, NAME + OPENER, "")))
        return let(F.struct(raw.alias("raw"), words(template(clean)).alias("form")), all_windows)

    return let(marked(text, item), words_of)


def _slots(raw: Column, form: Column, theirs: Column) -> Column:
    """(mine, theirs) of the item's numbers, names and units in a matched window.

    A sentence's first word is a name here only if it was replaced.
    """
    return F.filter(
        F.arrays_zip(raw.alias("mine"), theirs.alias("theirs"), form.alias("form")),
        lambda x: x["form"].rlike(f"[{NUMBER}{NAME}{UNIT}]")
        | (x["form"].startswith(OPENER) & (x["mine"] != x["theirs"])),
    )


def _is_word_kept(mine: Column, theirs: Column, form: Column) -> Column:
    return (mine == theirs) | form.rlike(f"[{NUMBER}{UNIT}]")


def safe_stride(n_windows: Column, similarity: float) -> Column:
    """Matching windows in a row that an item of ``n_windows`` surely has at this similarity.

    At most a share of 1 - similarity is lost; a change inside loses at least
    ``WORDS - 1`` windows and cuts a run in two.
    """
    least = F.ceil(n_windows * similarity)
    cuts = F.floor((n_windows - least) / (WORDS - 1))
    return F.ceil(least / (cuts + 1))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_hash, n_windows, at, hash, raw, form), stored; a window has a row for each
    variant. Each different text under an id is an item of its own, told apart by its hash."""
    once = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(
        "item_id IS NOT NULL"
    ).distinct()
    return stored(
        once.select("item_id", F.xxhash64("text").alias("item_hash"), windows(F.col("text"), item=True).alias("w"))
        .select("item_id", "item_hash", F.size("w").alias("n_windows"), F.explode("w").alias("w"))
        .select("item_id", "item_hash", "n_windows", "w.at", F.explode("w.hashes").alias("hash"), "w.raw", "w.form")
    )


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    slot_share: float = SLOT_SHARE,
) -> DataFrame:
    """Leaked (document, item) pairs.

    Columns: ``id_col``, ``row_hash`` (of the text), ``item_id``, ``n_windows`` of the
    item, ``n_matched`` of them found, ``n_slots`` compared, ``n_changed`` of them with
    another value than the item's.
    """
    wins = item_windows(items, item_id_col, item_text_col)
    stride = wins.agg(F.min(safe_stride(F.col("n_windows"), similarity))).first()[0]
    stride = max(1, min(MAX_STRIDE, int(stride or 1)))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text")
    )
    hashes = let(
        words(template(marked(F.col("text")))),
        lambda form: F.flatten(F.transform(_starts(F.size(form), stride), lambda i: _variants(form, i))),
    )
    probes = rows.select("id", "row_hash", F.explode(hashes).alias("hash"))
    # a stored table of hashes: broadcast by the planner if it is small, else hash-joined
    keys = stored(wins.select("hash").distinct())
    found = stored(probes.join(keys, "hash", "left_semi").select("id", "row_hash").distinct())
    near = found.select(F.col("id").alias("near_id"), F.col("row_hash").alias("near_hash"))
    suspects = rows.join(
        near,
        F.col("id").eqNullSafe(F.col("near_id")) & (F.col("row_hash") == F.col("near_hash")),
        "left_semi",
    ).dropDuplicates(["id", "row_hash"])
    matched = (
        suspects.select("id", "row_hash", F.explode(windows(F.col("text"))).alias("w"))
        .select("id", "row_hash", F.col("w.at").alias("doc_at"), F.explode("w.hashes").alias("hash"),
                F.col("w.raw").alias("doc_raw"))
        .join(wins, "hash")
        .withColumn("shift", F.col("doc_at") - F.col("at"))
    )
    pair = ["id", "row_hash", "item_id", "item_hash"]
    # at most one row for each window of the item, whatever variants match
    line = matched.groupBy(*pair, "n_windows", "shift", "at").agg(
        F.first("raw").alias("raw"), F.first("form").alias("form"), F.first("doc_raw").alias("doc_raw")
    ).withColumn("run", F.count("*").over(Window.partitionBy(*pair, "shift")))
    # of the places that match a window, the one where most of the item matches
    best = stored(
        line.groupBy(*pair, "n_windows", "at").agg(
            F.max_by(F.struct("raw", "form", "doc_raw"), F.struct("run", -F.col("shift"))).alias("m")
        )
    )
    kept = F.size(F.filter(
        F.arrays_zip(F.col("m.raw").alias("mine"), F.col("m.doc_raw").alias("theirs"), F.col("m.form").alias("form")),
        lambda x: _is_word_kept(x["mine"], x["theirs"], x["form"]),
    ))
    # where every word has a capital, replaced names alone would make any two texts alike
    covered = best.groupBy(*pair, "n_windows").agg(
        F.count("*").alias("n_matched"), F.sum(kept).alias("n_kept")
    ).where(
        (F.col("n_matched") >= similarity * F.col("n_windows"))
        & (F.col("n_kept") >= KEPT_SHARE * WORDS * F.col("n_matched"))
    )
    slots = (
        best.select(*pair, F.explode(
            _slots(F.col("m.raw"), F.col("m.form"), F.col("m.doc_raw"))).alias("s"))
        .groupBy(*pair, F.col("s.mine").alias("mine"), F.col("s.theirs").alias("theirs"))
        .agg(F.count("*").alias("n"))
        .groupBy(*pair, "mine")
        .agg(F.sum("n").alias("n"), F.max("n").alias("agreed"),
             F.sum(F.when(F.col("mine") != F.col("theirs"), F.col("n")).otherwise(0)).alias("changed"))
        .groupBy(*pair)
        .agg(F.sum("n").alias("n_slots"), F.sum("agreed").alias("agreed"),
             F.sum("changed").alias("n_changed"))
    )
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in pair]
    leaked = (
        covered.alias("c").join(slots.alias("s"), same, "left")
        .where(F.col("agreed").isNull() | (F.col("agreed") >= slot_share * F.col("n_slots")))
        .select(
            "c.id", "c.row_hash", "c.item_id", "c.item_hash", "n_windows", "n_matched",
            F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
            F.coalesce("n_changed", F.lit(0)).cast("bigint").alias("n_changed"),
        )
    )
    # of several texts under one id, the one that is found best
    figures = F.struct("n_windows", "n_matched", "n_slots", "n_changed")
    found_best = F.struct(F.col("n_matched") / F.col("n_windows"), "n_windows", "item_hash")
    return (
        leaked.groupBy("id", "row_hash", "item_id").agg(F.max_by(figures, found_best).alias("f"))
        .select(F.col("id").alias(id_col), "row_hash", "item_id", "f.*")
    )


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold an item."""
    ids = stored(leaks.select(F.col(id_col).alias("leaked_id"), F.col("row_hash").alias("leaked_hash")).distinct())
    return docs.join(
        ids,
        docs[id_col].eqNullSafe(ids["leaked_id"]) & (F.xxhash64(docs[text_col]) == ids["leaked_hash"]),
        "left_anti",
    )
