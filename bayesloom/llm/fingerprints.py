"""Document fingerprints: invertible Bloom look-up sketches of a text's paragraphs, in DataFrame functions only.

A paragraph is a line; a line's sentences count by themselves, so that a text of one line has more than one cell to
differ in. A text is the set of its paragraphs' 64-bit digests. A sketch has three rows of 2**b cells; each digest enters
one cell a row, and a cell holds the count, the xor of digests and the xor of their check sums.

Two versions are compared by subtracting sketches cell by cell: what both hold cancels, and peeling (take a cell with
one digest left, take that digest out of its other cells) recovers the digests that differ. The fixed-size fingerprints
are tried first. If they are too small for the difference, both sets are dealt by digest into as many small sketches
as they need, and each small sketch that can't be peeled is retried with twice the cells. Cells are counted by whole
arrays within a row: there is no explosion, and one exchange, by ranges of the order that says which text is next.

Nulls: a null text is empty; a null id comes last, in the order of the text's hash. Repeated ids follow that order too.
Two texts without paragraphs are alike (1.0). A table of one row is its own next. Texts of any length are whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where one paragraph ends and the next begins.
BREAKS = r"\\n+|(?<=[.!?])[ \\t]+"
#: log2 of a row's cells in the fingerprint, and in the sketches that are tried one after the other.
BITS, TRIES = 3, (3, 4, 5, 7)
#: Digests that a small sketch gets, about.
LOAD = 8
#: Text of a range, about, the number of quantiles that end one, and into how many parts one may be split.
RANGE_BYTES, RANGES, SPLIT = 1 << 20, 4096, 16


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    return f"array_distinct(transform(filter(split({text}, '{BREAKS}'), p -> p <> ''), p -> xxhash64(p)))"


def signed(column: str, sign: int) -> str:
    return f"transform({column}, d -> named_struct('d', d, 's', {sign}, 'x', xxhash64(d)))"


def _own_cell(d: str, c: str, bits: int) -> str:
    """Whether digest ``d`` enters cell ``c``: row c >> bits takes its place from other bits of the digest."""
    mask = (1 << bits) - 1
    return f"(shiftright({d}, {bits} * shiftright({c}, {bits})) & {mask}) = ({c} & {mask})"


def cells(items: str, bits: int) -> str:
    """The sketch of signed items."""
    zero = "named_struct('n', 0, 'k', 0L, 'x', 0L)"
    hit = "named_struct('n', a.n + e.s, 'k', a.k ^ e.d, 'x', a.x ^ e.x)"
    return f"transform(sequence(0, {3 * (1 << bits) - 1}), c -> aggregate({items}, {zero}, (a, e) -> if({_own_cell('e.d', 'c', bits)}, {hit}, a)))"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'x', p.x ^ q.x))"


def peel(sketch: str, steps: str, bits: int) -> str:
    """How many digests were recovered until nothing is left; null if something is."""
    pure = "filter(st.c, z -> abs(z.n) = 1 and z.x = xxhash64(z.k))"
    out = f"transform(st.c, (q, c) -> if({_own_cell('f[0].k', 'c', bits)}, named_struct('n', q.n - f[0].n, 'k', q.k ^ f[0].k, 'x', q.x ^ f[0].x), q))"
    step = let("f", pure, f"if(size(f) = 0, st, named_struct('c', {out}, 'd', st.d + 1))")
    start = f"named_struct('c', {sketch}, 'd', 0)"
    finish = "if(forall(st.c, z -> z.n = 0 and z.k = 0L and z.x = 0L), st.d, cast(null as int))"
    return f"aggregate(slice(sequence(0, {steps}), 2, {steps}), {start}, (st, i) -> {step}, st -> {finish})"


def differing(items: str) -> str:
    """How many digests of signed ``items`` differ: small sketches, the failed ones retried larger."""
    tries = [let("sk", cells("sub", b), peel("sk", "size(sub)", b)) for b in TRIES]
    exact = "size(filter(sub, u -> size(filter(sub, v -> v.d = u.d)) = 1))"  # digests that share all their cells
    one = f"coalesce({', '.join(tries)}, {exact})"
    sides = f"cast(ceil(sqrt(size({items}) / {LOAD})) as int)"
    inner = f"transform(sequence(0, greatest(w, 1) - 1), j -> filter(grp, y -> pmod(shiftright(y.d, 42), greatest(w, 1)) = j))"
    parts = let("w", sides, f"flatten(transform(sequence(0, greatest(w, 1) - 1), i -> {let('grp', f'filter({items}, y -> pmod(shiftright(y.d, 22), greatest(w, 1)) = i)', inner)}))")
    return f"aggregate({parts}, 0, (t, sub) -> t + {one})"


def written(sketch: str) -> str:
    """A sketch as text: count, digests' xor and 16 bits of the check sums' xor of each cell."""
    return f"array_join(transform({sketch}, z -> concat(hex(z.n), '.', lpad(hex(z.k), 16, '0'), lpad(hex(z.x & 65535), 4, '0'))), '-')"


def likeness(difference: Column, a: str, b: str) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - difference) / (both + difference))


def literals(values) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def place(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are below ``x``, looked up in two steps."""
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < x))
    group = F.greatest(below(literals(g[0] for g in groups)) - 1, F.lit(0))
    return group * step + below(F.get(F.array(*map(literals, groups)), group))


def in_order(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, Window]:
    """(rows by ranges of the order, the order within a range): each range also holds its successor's first row, as a guest.

    Ranges end at up to 4,096 quantiles of the id, so that clustered ids make narrow ones; an id that is a quantile twice is
    split by the hash of the text, as null ids are; beyond that many ranges each is cut into at most 16 equal parts. The
    table of their first rows, which is broadcast, has 131,088 rows at most.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(RANGES, max(1, -(-total // range_bytes))))
    deep = int(min(SPLIT, max(1, -(-total // (n * range_bytes)))))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 20000)).first()[0] or [0]
    bounds, heavy = sorted(set(found)), sorted({a for a, b in zip(found[:-1], found[1:], strict=True) if a == b})
    every = literals(bounds)
    low, high = (F.coalesce(F.get(every, F.col("at") + k), F.col("doc_id")) for k in (-1, 0))
    part = F.least(F.lit(deep - 1), ((F.col("doc_id") - low) * F.lit(float(deep)) / F.greatest(high - low, F.lit(1))).cast("int"))
    by_hash = F.shiftright("h", 60) + SPLIT // 2
    inner = F.when(F.col("doc_id").isin(heavy), deep + by_hash).otherwise(F.greatest(F.lit(0), part)) if heavy else F.greatest(F.lit(0), part)
    known = F.col("at").cast("bigint") * (deep + SPLIT) + inner + SPLIT
    ranged = rows.withColumn("at", place(bounds, F.col("doc_id"))).withColumn("range", F.when(F.col("doc_id").isNull(), by_hash).otherwise(known).cast("bigint")).drop("at")
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "h")
    firsts = ranged.groupBy("range").agg(F.max(key).alias("first"))
    over = Window.orderBy("range")
    firsts = firsts.select("range", "first", F.coalesce(F.lead("range").over(over), F.min("range").over(Window.partitionBy())).alias("above"))
    placed = ranged.join(F.broadcast(firsts), "range").withColumn("places", F.when(key == F.col("first"), F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("above").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct("range", F.lit(False).alias("guest")))))
    laid = placed.select("doc_id", "text", "h", F.explode("places").alias("p")).select("doc_id", "text", "h", "p.range", "p.guest")
    return laid, Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last third replaced by the beginning of the next document's, in descending order of ids.
    """
    laid, order = in_order(docs)
    laid = laid.repartition("range").withColumn("D", F.expr(digests("text"))).withColumn("S", F.expr(cells(signed("D", 1), BITS)))
    after = F.lead(F.struct("text", "D", "S")).over(order)
    rows = laid.withColumn("after", after).where(~F.col("guest"))
    rows = rows.withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n - cut), substring(after.text, 1, cut))"))
    rows = rows.withColumn("E", F.expr(digests("edited"))).withColumn("T", F.expr(cells(signed("E", 1), BITS)))
    most = str(3 * (1 << BITS) // 2)
    for name, other, sketch in (("to_edited", "E", "T"), ("to_next", "after.D", "after.S")):
        quick = peel(subtract("S", sketch), most, BITS)
        whole = let("items", f"concat({signed('D', 1)}, {signed(other, -1)})", differing("items"))
        rows = rows.withColumn(name, F.expr(f"coalesce({quick}, {whole})"))
    return rows.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(written("S")).alias("fingerprint"),
        F.expr(written("T")).alias("edited_fingerprint"),
        likeness(F.col("to_edited"), "D", "E").alias("near_edited"),
        likeness(F.col("to_next"), "D", "after.D").alias("near_next"),
    )
