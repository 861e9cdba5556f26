"""Secret scans with multipart credential linking, in DataFrame operations only.

Base patterns find assignments, access identifiers and hexadecimal secrets. Weak candidates (bare 40-character keys,
endpoints, client names) are reported only when complementary parts lie in the same scope: an interval join links
them on overlapping scopes of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: The kinds in the order that breaks ties. Fixed values of the base patterns.
KINDS = ["assign", "access", "hex", "weak_key", "endpoint", "client"]
BASE = KINDS[:3]
#: Marks around matches; in texts they are first replaced by a character that no pattern takes either.
_EDGE, _INNER, _OTHER = "\x01", "\x03", "\x02"
_VALUE = "[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)(""" + _VALUE + ")",
    "access": "(AKIA)([A-Z0-9]{16,})",
    "hex": "()([0-9a-f]{24,})",
    "weak_key": r"()((?<![A-Za-z0-9/+=_.-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_.-]))",
    "endpoint": r"""((?i:https?)://)([A-Za-z0-9.-]{4,}(?::[0-9]{1,5})?)""",
    "client": r"""((?i:client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9_.@-]{3,})""",
}
#: What a text must hold for a pattern to be worth a pass over it.
_NEEDS = {"access": "AKIA", "endpoint": "://"}
#: Shortest group 2 of an assignment.
LEAST_VALUE = 6
#: Which kinds must lie in the scope of a weak candidate: all of the sets, any kind of each.
COMPLEMENTS = {"weak_key": [{"access", "client"}], "endpoint": [{"access", "client"}, {"assign", "hex", "weak_key"}], "client": [{"assign", "hex", "weak_key"}]}


def _matches(text: Column, kind: str) -> Column:
    """Of one pattern: the text cut at its matches, as (gap length, match length, value length) for each match."""
    marked = F.regexp_replace(text, PATTERNS[kind], f"{_EDGE}$1{_INNER}$2{_EDGE}")
    pieces = F.split(marked, _EDGE)
    found = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
        lambda i: F.struct(
            F.lit(kind).alias("kind"),
            F.length(F.get(pieces, i - 1)).alias("gap"),
            (F.length(F.get(pieces, i)) - 1).alias("size"),
            F.length(F.substring_index(F.get(pieces, i), _INNER, -1)).alias("value"),
        ),
    )
    nothing = F.expr("cast(array() as array<struct<kind:string,gap:int,size:int,value:int>>)")
    found = F.when(F.size(pieces) >= 3, found).otherwise(nothing)
    return F.when(text.contains(_NEEDS[kind]), found).otherwise(nothing) if kind in _NEEDS else found


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """For every document: (id, n_assign, n_access, n_hex, base_sha256, spans).

    Base spans: leftmost non-overlapping matches of each kind, those with too short a value dropped. Added spans: weak
    candidates with their complements within ``scope`` code points. Positions are code points, the end exclusive. A null
    text is empty; a document without spans has zero counts, the digest of the empty text and empty ``spans``. Rows that
    repeat an identifier stay rows of their own.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _EDGE + _INNER, _OTHER + _OTHER)
    scanned = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    found = scanned.select("id", *[_matches(F.col("t"), kind).alias(kind) for kind in KINDS])
    # Only lengths are kept from here on; the row number is fixed by writing it.
    rows = store(found.withColumn("row", F.monotonically_increasing_id()), "matches")
    spans = store(_spans(rows), "spans")
    linked = _linked(spans, scope)
    every = spans.where(F.col("kind").isin(BASE)).union(linked)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    item = F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind")
    per = every.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("all"))
    per = per.withColumn("base", F.filter("all", lambda x: x["rank"] < len(BASE)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda x: x["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    text_of = lambda c: F.coalesce(joined(F.col(c)), F.lit(""))
    return (
        rows.select("row", "id")
        .join(per, "row", "left")
        .select(F.col("id").alias(id_col), *[count(k) for k in BASE], F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all").alias("spans"))
    )


def _spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all matches: running sums of gaps and matches within a row and kind."""
    some = rows.select("row", F.explode(F.array(*KINDS)).alias("m")).where(F.size("m") > 0)
    each = some.select("row", F.posexplode("m").alias("at", "m")).select("row", "at", "m.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = each.withColumn("end", upto)
    long_enough = (F.col("kind") != "assign") | (F.col("value") >= LEAST_VALUE)
    return placed.where(long_enough).select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak candidates whose complements lie within ``scope`` code points: an interval join on cells of that width.

    Each side is first reduced to the kinds a cell holds with its outermost spans, so a cell full of spans of one
    kind costs two rows, not all pairs.
    """
    cell = F.floor(F.col("start") / scope)
    parts = spans.groupBy("row", cell.alias("cell"), "kind").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.collect_list("start").alias("starts"))
    # A span looks into its own cell and both neighbours.
    shown = parts.select("row", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("kind").alias("other"), "first", "last", "starts")
    weak = spans.where(~F.col("kind").isin(BASE)).withColumn("cell", cell)
    near = (F.col("first") - F.col("start") <= scope) & (F.col("start") - F.col("last") <= scope)
    inside = F.exists("starts", lambda s: F.abs(s - F.col("start")) <= scope)
    met = weak.join(shown, ["row", "cell"]).where(near & inside & (F.col("kind") != F.col("other")))
    kinds = met.groupBy("row", "kind", "start", "end").agg(F.collect_set("other").alias("others"))
    complete = F.lit(False)
    for kind, sets in COMPLEMENTS.items():
        has = F.col("kind") == kind
        for one in sets:
            has &= F.arrays_overlap("others", F.array(*[F.lit(k) for k in sorted(one)]))
        complete |= has
    return kinds.where(complete).select("row", "kind", "start", "end")
