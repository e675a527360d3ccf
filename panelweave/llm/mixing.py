"""Mixing sources to target weights by pivotal dependent rounding.

Native: DataFrame functions only. A source with the words S and the target T wants T / S copies of
each of its documents. The whole copies are given at once; the rest is a probability in [0, 1)
that pivotal rounding makes 0 or 1. Two documents meet, and mass moves from one to the other, in words, until
one of them is whole; the other meets the next.

Of n rows with the same id, size and source, whose mass can only end in floor(n p) of them and one more, that
one takes part with what is left of n p, so rows without ids don't meet in one group. Documents of a
source are dealt by the octave of their size, and there by a hash of their id into groups of about
`fan_in`; each group is folded in one array, long documents first, what is left of it goes on to a group of groups, and
so on up the tree. A group of each octave waits for the end, where a source's open documents meet
from the longest octave to the shortest: a long one is settled by the shorter ones after it, so the last one, which
meets nobody and goes to the nearer whole number, is a short one as a rule. The words a source takes differ
from its target by half of that document at most. So no task sees more than a group, or a group for each octave, one source may
hold all rows, and the coin of each meeting is a hash of both documents, so reruns agree.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own
and the last; rows that share an id and a source are rounded one by one; mix() tells them apart by
row numbers, which follow the files read; a very long text is one long document; documents of equal size are ordered by the hash of their id;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: What is folded, in the order of the fold: longer octaves first, then by hash.
ITEM = "struct<o:int,h:bigint,doc_id:{id},size:bigint,p:double>"
#: Rows that one task writes of equal ones.
CHUNK = 4096


def source_targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target of rows source, size, n (how often): a row per source; only these rows meet in one task."""
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight).coalesce(1), "sources")
    # sources fill up in this order as the level rises: the level is that of the first one it doesn't fill
    fills = F.col("source_size") * most / F.col("weight")
    order = Window.orderBy(fills, F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum(F.col("source_size") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - held) / open_
    steps = sources.select(fills.alias("fills"), "source", level.alias("level")).where("level <= fills")
    found = steps.orderBy("fills", F.col("source").asc_nulls_last()).select("level").first()
    full = F.col("source_size") * most
    target = full if found is None else F.least(F.col("weight") * found["level"], full)
    return materialize(sources.select("source", "source_size", target.alias("target")), "targets")


def _fold(id_type: str) -> str:
    """SQL that folds sorted items into (what is left, who is decided)."""
    done = f"array<struct<doc_id:{id_type},size:bigint,up:int>>"
    item = ITEM.format(id=id_type)
    coin = "pmod(xxhash64(a.left.h, b.h), 9007199254740992) / 9007199254740992D"
    ratio = "(b.size / a.left.size)"
    # the most that a can rise and fall
    rise, fall = f"least(1 - a.left.p, b.p * {ratio})", f"least(a.left.p, (1 - b.p) * {ratio})"
    met = f"""named_struct('rise', {rise}, 'fall', {fall})"""
    moved = f"""transform(array({met}), m -> CASE WHEN {coin} * (m.rise + m.fall) < m.fall
        THEN named_struct('a', a.left.p + m.rise, 'b', b.p - m.rise / {ratio})
        ELSE named_struct('a', a.left.p - m.fall, 'b', b.p + m.fall / {ratio}) END)[0]"""
    whole = lambda p: f"(CASE WHEN {p} < 1e-9 THEN 0D WHEN {p} > 1 - 1e-9 THEN 1D ELSE {p} END)"
    decide = lambda x, p: f"array(named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'up', cast({p} AS int)))"
    none = f"cast(null AS {item})"
    with_p = lambda x, p: f"named_struct('o', {x}.o, 'h', {x}.h, 'doc_id', {x}.doc_id, 'size', {x}.size, 'p', {p})"
    a, b = whole("q.a"), whole("q.b")
    settled = f"""CASE
        WHEN {a} IN (0D, 1D) AND {b} IN (0D, 1D) THEN named_struct('left', {none}, 'done', concat(a.done, {decide('a.left', a)}, {decide('b', b)}))
        WHEN {a} IN (0D, 1D) THEN named_struct('left', {with_p('b', b)}, 'done', concat(a.done, {decide('a.left', a)}))
        ELSE named_struct('left', {with_p('a.left', a)}, 'done', concat(a.done, {decide('b', b)})) END"""
    return f"""aggregate(array_sort(items), named_struct('left', {none}, 'done', cast(array() AS {done})),
        (a, b) -> CASE WHEN a.left IS NULL THEN named_struct('left', b, 'done', a.done)
                  ELSE transform(array({moved}), q -> {settled})[0] END)"""


def octave(size: Column) -> Column:
    """The number of binary digits of a size."""
    return F.length(F.bin(size))


def pivotal_round(items: DataFrame, fan_in: int = 48) -> DataFrame:
    """source, doc_id, size, up (0 or 1) of items source, doc_id, size, p in (0, 1); an id and a size occur once in a source."""
    id_type = dict(items.dtypes)["doc_id"]
    items = items.withColumn("octave", octave(F.col("size")))
    groups = F.ceil(F.count(F.lit(1)) / fan_in)
    octaves = materialize(items.groupBy("source", "octave").agg(groups.alias("groups")), "octaves")
    most = octaves.agg(F.max("groups")).first()[0]
    if most is None:
        return items.select("source", "doc_id", "size", F.lit(0).alias("up"))
    same = F.col("i.source").eqNullSafe(F.col("o.source")) & (F.col("i.octave") == F.col("o.octave"))
    rows = items.withColumn("h", F.xxhash64(F.lit("deal"), "doc_id", "size")).alias("i").join(octaves.alias("o"), same)
    item = F.struct((-F.col("i.octave")).alias("o"), "h", "doc_id", "size", "p").cast(ITEM.format(id=id_type))
    rows = rows.select("i.source", "i.octave", F.pmod(F.xxhash64(F.lit("group"), "h"), F.col("groups")).alias("g"), "groups", item.alias("item"))

    def fold(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.expr(_fold(id_type).replace("(items)", "(collect_list(item))")).alias("r"))

    # group 0 waits for the end; the others, of which there are `groups` from here on, go up the tree
    last, decided = rows.where("g = 0").select("source", "item"), []
    rows, most = rows.where("g > 0").select("source", "octave", (F.col("g") - 1).alias("g"), (F.col("groups") - 1).alias("groups"), "item"), most - 1
    while most:
        folded = materialize(fold(rows, "source", "octave", "g", "groups"), "folded")
        decided.append(folded)
        left = folded.where("r.left is not null").select("source", "octave", "g", "groups", F.col("r.left").alias("item"))
        last = last.unionByName(left.where("groups = 1").select("source", "item"))
        rows = left.where("groups > 1").select("source", "octave", F.floor(F.col("g") / fan_in).alias("g"), F.ceil(F.col("groups") / fan_in).alias("groups"), "item")
        most = -(-most // fan_in) if most > 1 else 0
    end = materialize(fold(last, "source"), "folded")
    out = end.where("r.left is not null").select("source", "r.left.doc_id", "r.left.size", (F.col("r.left.p") >= 0.5).cast("int").alias("up"))
    for folded in (*decided, end):
        out = out.unionByName(folded.select("source", F.explode("r.done").alias("__one")).select("source", "__one.*"))
    return out


def _each(rows: DataFrame) -> DataFrame:
    """Rows as often as their column c says; of more than `CHUNK`, the chunks are dealt over tasks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / CHUNK)))
    many = rows.where(F.col("c") > CHUNK).withColumn("__chunk", chunk)
    many = many.repartition("source", "doc_id", "size", "up", "__chunk").withColumn("c", F.least(F.lit(CHUNK), F.col("c") - F.col("__chunk") * CHUNK)).drop("__chunk")
    few = rows.where(F.col("c").between(1, CHUNK)).unionByName(many)
    return few.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("bigint"), "c"))).drop("__one", "c")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] | None = None, share: float = 1.5, most: float = 2.0, fan_in: int = 48) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: a row per document."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sized")
    targets = source_targets(sized, weights or [5.0, 2.0, 1.0], share, most)
    wants = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a share of copies that differs from a whole number by rounding alone is that number
    base = F.floor(wants + 1e-9)
    mass = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wants - base) * F.col("n")).otherwise(0.0)
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    all_rows = sized.alias("d").join(targets.alias("t"), same).select("d.doc_id", "d.source", "d.size", "n", mass.alias("mass"))
    all_rows = all_rows.withColumn("ups", F.floor(F.col("mass") + 1e-9)).withColumn("p", F.col("mass") - F.col("ups"))
    open_ = F.col("p") > 1e-9
    counts = F.array(F.struct(F.lit(1).alias("up"), F.col("ups").alias("c")), F.struct(F.lit(0).alias("up"), (F.col("n") - F.col("ups") - open_.cast("bigint")).alias("c")))
    plain = _each(all_rows.select("doc_id", "source", "size", F.inline(counts)))
    decided = pivotal_round(all_rows.where(open_).select("source", "doc_id", "size", "p"), fan_in).select("doc_id", "source", "size", "up").unionByName(plain)
    return decided.alias("d").join(targets.alias("t"), same).select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", (base.cast("int") + F.col("up")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as many times as copies() says; the columns are those of docs."""
    rows, key = docs, id_col
    if docs.groupBy(id_col, source_col).count().where("count > 1").head(1):
        rows, key = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
    taken = copies(rows, key, text_col, source_col, **how).where("copies > 0").select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"))
    same = rows[key].eqNullSafe(F.col("__mix_id")) & rows[source_col].eqNullSafe(F.col("__mix_source"))
    mixed = rows.join(taken, same)
    return mixed.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*(rows[c] for c in docs.columns))
