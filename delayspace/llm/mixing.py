"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same number of copies to expect, c = target / size of the source, of
which the fraction has to be rounded. Two units at a time, one passes words (probability times size) to the
other in a random direction, with chances that leave every expectation as it was, until the probability of one is 0 or 1; that
one is settled and the other goes on.

Documents that are large beside their source come first, the largest first: the other unit is then all that is left of the
source, taken as one, so that what a large document takes too much or too little is spread over many small ones. There are at most
LARGE of them in a source. The small ones are paired in chunks; a chunk leaves one residual, residuals meet in chunks
again, a tree of fixed fan-in, and the one residual that a source has at the end is rounded by a draw. Its size is
less than a part in LARGE of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, cut, ranked, words_of

#: Documents or residuals that meet in one fold.
FAN_IN = 64
#: A document is large that has more than one part in so many of its source's words.
LARGE = 1_024
#: Tables of sources up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

#: Open documents of a fold: probability, size, row hash, id, place.
ITEM = "struct<p:double,s:bigint,h:bigint,id:bigint,place:bigint>"
#: Probabilities nearer to 0 or 1 than this are integral but for the arithmetic.
NEAR = 1e-12


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, ..) with each source's target. Weights go round by the sources' order, null last.

    A target stops at ``cap`` times its size; the excess is shared again by weight until no source is above.
    """
    order = (F.col("source").isNull().asc(), F.col("source").asc())
    placed = ranked(sizes, *order, name="rank", label="sources")
    placed = placed.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    size, w = F.col("source_size"), F.col("w")
    total = placed.agg(F.sum("source_size")).head()[0] or 0
    a_weight, capped_before = None, -1
    while True:
        full = F.lit(False) if a_weight is None else cap * size <= a_weight * w
        found = placed.agg(
            F.sum(F.when(full, cap * size).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(w)).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).head()
        if found["capped"] == capped_before or not found["open"]:
            break
        a_weight, capped_before = max(0.0, share * total - found["given"]) / found["open"], found["capped"]
    return placed.withColumn("target", F.least(cap * size, F.lit(a_weight or 0.0) * w)).drop("w")


def _draw(x: str, salt: int, seed: int) -> str:
    """A number from 0 to 1 of an item and a salt."""
    return f"(pmod(xxhash64({x}.h, {x}.id, {x}.place, {salt}L, {seed}L), 9007199254740992L) / 9007199254740992D)"


def _fold(level: int, seed: int) -> str:
    """SQL that folds the array ``items``: (rest: place of the residual or -1, p: its probability, done: twice the place, and one if taken, of each settled item)."""
    r = "items[acc.rest]"
    one, two = f"acc.p * {r}.s", "x.p * x.s"
    up, down = f"least((1 - x.p) * x.s, {one})", f"least((1 - acc.p) * {r}.s, {two})"
    step = lambda settled, taken, rest, p: f"named_struct('rest', {rest}, 'p', {p}, 'at', acc.at + 1, 'done', array_append(acc.done, 2 * {settled} + {taken}))"
    return f"""aggregate(items, named_struct('rest', -1, 'p', 0D, 'at', 0, 'done', cast(array() as array<int>)),
      (acc, x) -> CASE
        WHEN acc.rest < 0 THEN named_struct('rest', acc.at, 'p', x.p, 'at', acc.at + 1, 'done', acc.done)
        WHEN {_draw('x', level, seed)} * ({up} + {down}) <= {down} THEN
          CASE WHEN (1 - x.p) * x.s <= {one} THEN {step('acc.at', 1, 'acc.rest', f'greatest(0D, ({one} - (1 - x.p) * x.s) / {r}.s)')}
               ELSE {step('acc.rest', 0, 'acc.at', f'least(1D, ({one} + {two}) / x.s)')} END
        ELSE
          CASE WHEN (1 - acc.p) * {r}.s <= {two} THEN {step('acc.rest', 1, 'acc.at', f'greatest(0D, ({two} - (1 - acc.p) * {r}.s) / x.s)')}
               ELSE {step('acc.at', 0, 'acc.rest', f'least(1D, ({one} + {two}) / {r}.s)')} END
      END)"""


def _large(seed: int) -> str:
    """SQL that settles the array ``items``, largest first, against what is left of the source: (words and expected words left, done: 1 for each item taken, else 0)."""
    p, rest, room = "acc.mass / acc.words", "acc.mass - acc.mass / acc.words * x.s", "(acc.words - x.s) - (acc.mass - acc.mass / acc.words * x.s)"
    up, down = f"least((1 - {p}) * x.s, {rest})", f"least({p} * x.s, {room})"
    step = lambda mass, taken: f"named_struct('words', acc.words - x.s, 'mass', {mass}, 'done', array_append(acc.done, {taken}))"
    return f"""aggregate(items, named_struct('words', words, 'mass', mass, 'done', cast(array() as array<int>)),
      (acc, x) -> CASE
        WHEN {_draw('x', -1, seed)} * ({up} + {down}) <= {down} THEN
          CASE WHEN (1 - {p}) * x.s <= {rest} THEN {step(f'greatest(0D, {rest} - (1 - {p}) * x.s)', 1)}
               ELSE {step('0D', f'if({_draw("x", -2, seed)} * x.s < acc.mass, 1, 0)')} END
        ELSE
          CASE WHEN {p} * x.s <= {room} THEN {step('least(acc.words - x.s, acc.mass)', 0)}
               ELSE {step('acc.words - x.s', f'if({_draw("x", -2, seed)} * x.s < acc.mass - (acc.words - x.s), 1, 0)')} END
      END)"""


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken, row_hash.

    size counts words (null text: 0). A document is taken ``floor(c)`` times or once more; c never exceeds ``cap``.
    Documents without words take none of the rounding. Null is a source of its own. All draws are hashes of the
    row, so reruns agree; rows without an id are told apart by their place in the input. Repeated rows are rounded each
    for itself. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).alias("source"),
            words_of(F.col(text_col)).cast("long").alias("s"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long").alias("place"),
        ),
        "sizes",
    )
    sized = targets(rows.groupBy("source").agg(F.sum("s").alias("source_size"), F.count("*").alias("n")), weights, share, cap)
    c = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    plan = cut(sized.select(F.col("source").alias("of"), "source_size", "target", c.alias("c"), F.ceil(F.col("n") / fan_in).alias("chunks")).withColumn("base", F.floor("c")), "targets")
    n_sources, chunks = plan.agg(F.count("*"), F.max("chunks")).head()
    with_plan = lambda df, plan: df.join(F.broadcast(plan) if n_sources <= BROADCAST_ROWS else plan, df["source"].eqNullSafe(plan["of"])).drop("of")
    item = F.struct("p", "s", "h", "id", "place").alias("item")
    in_order = lambda *first: F.transform(F.array_sort(F.collect_list(F.struct(*first, "item"))), lambda x: x["item"]).alias("items")
    settled_row = ["source", "item.id", "item.s", "item.h", F.col("taken").cast("long").alias("extra")]

    # the large documents of each source against the rest of it
    planned = with_plan(rows, plan).withColumn("p", F.col("c") - F.col("base"))
    open_, large = (F.col("s") > 0) & (F.col("p") > NEAR), F.col("s") * LARGE > F.col("source_size")
    first = planned.where(open_ & large).select("source", "source_size", "p", item).groupBy("source").agg(F.first("source_size").cast("double").alias("words"), F.first("p").alias("p"), in_order((-F.col("item.s")).alias("order")))
    first = cut(first.withColumn("mass", F.col("p") * F.col("words")).withColumn("out", F.expr(_large(seed))).select("source", "items", "out"), "large")
    settled = [first.select("source", F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("out.done").alias("taken"))).alias("x")).select("source", "x.item", "x.taken").select(*settled_row)]
    left = first.select(F.col("source").alias("again"), (F.col("out.mass") / F.nullif(F.col("out.words"), F.lit(0.0))).alias("left"))
    plan = plan.join(left, plan["of"].eqNullSafe(left["again"]), "left").withColumn("q", F.coalesce("left", F.col("c") - F.col("base"))).drop("again", "left")

    # the small ones, by a tree of folds
    planned = with_plan(rows, plan)
    by_tree = (F.col("s") > 0) & ~large & (F.col("q") > NEAR) & (F.col("q") < 1 - NEAR)
    chunk = F.pmod(F.xxhash64("h", "id", "place", F.lit(seed)), F.col("chunks"))
    live = planned.where(by_tree).withColumn("p", F.col("q")).select("source", chunk.alias("chunk"), item)
    level = 0
    while True:
        draw = F.xxhash64("item.h", "item.id", "item.place", F.lit(level), F.lit(seed)).alias("draw")
        folded = live.groupBy("source", "chunk").agg(in_order(draw)).withColumn("out", F.expr(_fold(level, seed)))
        own = F.expr("transform(out.done, e -> named_struct('item', items[shiftright(e, 1)], 'taken', e & 1))")
        rest = F.expr("named_struct('p', out.p, 's', items[out.rest].s, 'h', items[out.rest].h, 'id', items[out.rest].id, 'place', items[out.rest].place)")
        folded = cut(folded.select("source", "chunk", own.alias("done"), rest.alias("rest")), "folded")
        settled.append(folded.select("source", F.explode("done").alias("x")).select("source", "x.item", "x.taken").select(*settled_row))
        if chunks is None or chunks <= 1:
            break
        live = folded.select("source", F.floor(F.col("chunk") / fan_in).alias("chunk"), F.col("rest").alias("item"))
        level, chunks = level + 1, -(-chunks // fan_in)
    last = F.expr(f"if({_draw('item', -3, seed)} < item.p, 1, 0)").alias("taken")
    settled.append(folded.select("source", F.col("rest").alias("item")).select("source", "item", last).select(*settled_row))

    decided = settled[0]
    for more in settled[1:]:
        decided = decided.unionByName(more)
    integral = planned.where(~by_tree & ~(large & (F.col("s") > 0) & (F.col("c") - F.col("base") > NEAR)))
    rest = integral.select("source", "id", "s", "h", F.when(F.col("s") > 0, F.round("q")).otherwise(0).cast("long").alias("extra"), "source_size", "target", "base")
    out = with_plan(decided, plan.select("of", "source_size", "target", "base")).unionByName(rest)
    copies = (F.col("base") + F.col("extra")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("s").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("s")).alias("taken"), F.col("h").alias("row_hash"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as :func:`mix_sources` says, all columns as they were."""
    copies = mix_sources(docs, id_col, text_col, source_col, **how).select(F.col(id_col).alias("of"), F.col("row_hash").alias("of_hash"), F.col("copies").alias("n"))
    copies = cut(copies.groupBy("of", "of_hash").agg(F.sum("n").cast("int").alias("n"), F.count("*").cast("int").alias("rows")), "copies")
    rows = aside(docs, id=F.col(id_col).cast("long"), hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    taken = copies.where("n > 0")
    found = rows.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")))
    own = F.col("n")
    if not copies.where("rows > 1").isEmpty():
        # rows that repeat id and text share out what was taken of them
        found = found.withColumn("turn", F.row_number().over(W.partitionBy("id", "hash").orderBy(F.monotonically_increasing_id())))
        own = (F.floor(F.col("n") / F.col("rows")) + (F.col("turn") <= F.col("n") % F.col("rows")).cast("int")).cast("int")
    return found.withColumn("own", own).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
