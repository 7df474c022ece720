"""Many rules against every record: an index from words to the rules that need them.

A rule that cannot match without a certain whole word (or one of a few) is filed under it.  The distinct words of a
record look up their rules in the broadcast index, and only rules that were fetched run their
regular expression, so work follows the text and the rules that are near it, not the number of rules.  The look-up is
one pass of the scan: words are exploded, joined and tested without moving the text, and what is
shuffled is a slim row per record and one per rule that fired.

Rules without such a word are evaluated on every record, in projections of ``PER_PROJECTION`` rules each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.sources.rules import Rule, RuleBook

#: Rules of one projection.
PER_PROJECTION = 250
#: Up to this size in bytes the index is broadcast; beyond it the join shuffles words and their records.
BROADCAST_BYTES = 64 << 20
#: Stands for the record itself among the rows of its words.
ITSELF = -2

INDEX = "word string, ordinal int, place int, sure boolean, java string, prefixed string"


def index_table(records: DataFrame, rules: list[Rule], places: dict) -> tuple[DataFrame, list[Rule]]:
    """The index ``(word, ordinal, place, sure, java, prefixed)`` and the rules that cannot be filed.

    ``place`` numbers the rule's side of its category; ``sure`` rules are one word and need no regular expression.
    """
    rows, rest = [("", ITSELF, ITSELF, True, None, None)], []
    for r in rules:
        words = r.filed_under
        if not words:
            rest.append(r)
            continue
        sure = r.words == (r.pattern.strip().lower(),)
        rows += [(w, r.ordinal, places[r.dictionary, r.category, r.role], sure, r.java, r.java_after_prefix) for w in words]
    table = records.sparkSession.createDataFrame(rows, INDEX)
    if sum(len(w) + len(java or "") + len(prefixed or "") + 64 for w, _, _, _, java, prefixed in rows) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return table, rest


def fired_by_index(
    base: DataFrame,
    book: RuleBook,
    details: bool,
    unrolled: Callable[[list[Rule], bool], str],
    quoted: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """``base`` without its text, with ``_inc_{dictionary}_{category}`` and ``_exc_...`` for every side that has rules.

    Entries are ``struct<ordinal>``, with ``details`` also ``n_hits`` and ``excerpt``.  ``unrolled`` says rules as one
    SQL expression; ``quoted`` makes the excerpt of a text between two places.
    """
    sides = list(dict.fromkeys((r.dictionary, r.category, r.role) for r in book.rules))
    places = {side: i for i, side in enumerate(sides)}
    index, rest = index_table(base, list(book.rules), places)

    slim = [c for c in base.columns if not c.startswith("_")]
    # rules that every record must try, a bounded number to a projection
    parts = []
    for side in sides:
        own = [r for r in rest if (r.dictionary, r.category, r.role) == side]
        for a in range(0, len(own), PER_PROJECTION):
            name = f"_unfiled_{len(parts)}"
            base = base.selectExpr("*", f"{unrolled(own[a : a + PER_PROJECTION], details)} AS {name}")
            parts.append((name, places[side]))

    def entry(ordinal: Column, place: Column, n_hits: Column | None, excerpt: Column | None) -> Column:
        said = [n_hits.alias("n_hits"), excerpt.alias("excerpt")] if details else []
        return F.struct(place.alias("place"), F.struct(ordinal.alias("ordinal"), *said).alias("fired"))

    text = F.col("_text")
    def placed(name: str, place: int) -> Column:
        return F.transform(name, lambda f: entry(f["ordinal"], F.lit(place), f["n_hits"], quoted(text, f["a"], f["b"])))

    tried = [placed(*part) for part in parts]
    none = F.array().cast(f"array<struct<place:int,fired:struct<ordinal:int{',n_hits:int,excerpt:string' if details else ''}>>>")
    words = F.coalesce(F.array_union(F.array(F.lit("")), "_words"), F.array(F.lit("")))
    seen = base.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*slim, (F.flatten(F.array(*tried)) if tried else none).alias("_tried")).alias("_record"),
        "_text",
        text.rlike(r"[\x{10000}-\x{10FFFF}]").alias("_wide"),
        words.alias("_words"),
    ).select("_row", "_record", "_text", "_wide", F.explode("_words").alias("word"))

    # an ordinary look-up column: a rule's pattern is compiled where its row is tested
    java, itself = F.col("java"), F.col("ordinal") == ITSELF
    near = seen.join(index, "word")
    if details:
        matches = F.when(~itself, F.regexp_extract_all("_text", java, F.lit(0)))
        near = near.withColumn("_matches", matches).where(itself | (F.size("_matches") > 0))
        # a position counts UTF-16 units; in a text with characters beyond them the prefix is cut out and measured
        start = F.expr("if(_wide, length(regexp_extract(_text, prefixed, 1)), regexp_instr(_text, java) - 1)")
        end = start + F.length(F.get("_matches", 0))
        hit = entry(F.col("ordinal"), F.col("place"), F.size("_matches"), quoted(text, start, end))
    else:
        near = near.where(itself | F.col("sure") | F.expr("_text rlike java"))
        hit = entry(F.col("ordinal"), F.col("place"), None, None)
    rows = near.select("_row", F.when(itself, F.col("_record")).alias("_record"), F.when(~itself, hit).alias("_hit"))
    folded = rows.groupBy("_row").agg(F.first("_record", True).alias("r"), F.collect_set("_hit").alias("_hits"))
    folded = folded.select(*[F.col(f"r.{c}").alias(c) for c in slim], F.concat("_hits", "r._tried").alias("_hits"))

    def of(side) -> Column:
        own = F.filter("_hits", lambda h: h["place"] == places[side])
        return F.sort_array(F.transform(own, lambda h: h["fired"]))

    named = {side: f"_{'inc' if side[2] == 'include' else 'exc'}_{side[0]}_{side[1]}" for side in sides}
    included = folded.withColumns({named[s]: of(s) for s in sides if s[2] == "include"})
    # exclude rules only count where an include rule of the category fired
    excluded = {}
    for d, k, role in sides:
        if role == "exclude":
            other = named.get((d, k, "include"))
            stands = F.size(other) > 0 if other else F.lit(False)
            excluded[named[d, k, role]] = F.when(stands, of((d, k, role))).otherwise(F.array())
    return included.withColumns(excluded).drop("_hits")
