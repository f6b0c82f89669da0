"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm.graph import components
from postlake.llm.ids import within
from postlake.llm.words import distinct_sets, map_texts, mix, slices, text_bytes, word_hashes
from postlake.sources.scratch import cut_lineage

SHINGLE = 5
BANDS, ROWS = 20, 4
BITS = 4
PER_LONG = 64 // BITS
HASHES = BANDS * ROWS
#: A pair is dropped unseen only if its estimate lies this many standard errors too low.
SIGMAS = 5
#: Members of one key that meet in one cell.
BLOCK = 256

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>, bands array<long>"


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """Group documents whose word-shingle sets have Jaccard similarity >= percent / 100.

    Takes `doc_id` (whole number) and `text`; other columns are ignored. Returns one row
    per input row: doc_id, n_shingles, class_id (least id with the very same set),
    component_id (least id reachable over links), kept.

    1. One pass makes a sketch per document: an exact digest of its set, the low BITS
       bits of 80 minima packed into longs, and 20 band keys.
    2. Equal sets become one class, by digest, with map-side combination.
    3. Classes that share a band key are compared with the least class of that bucket: first
       by the collision-corrected estimate from bit counts, then on full sets.
    4. Members of buckets that still hold several components are compared across components
       where they share enough of their differences from one member (see `_across`). So no
       link is lost, and a bucket of a thousand copies costs about a thousand comparisons.

    A text without words has an empty set and is its own component. Words of a text with
    fewer than five form one shingle. Rows that share a doc_id count as one document for
    links. A NULL doc_id takes no part: its ids are NULL and it is kept. A pair at the
    threshold shares a band with probability 1 - (1 - s^4)^20, above 0.9999995 at 0.85.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut_lineage(map_texts(docs, _sketcher(shingle), SKETCH), "sketches")
    classes = cut_lineage(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "classes")
    buckets = _buckets(classes)
    signatures = classes.select("rep", "signature")
    least = percent / 100
    stars = buckets.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    likely = _likely(stars, signatures, least)
    links = _confirm(docs, likely, percent, shingle)
    groups = components(links)
    open_ = _unresolved(buckets, groups)
    if not open_.isEmpty():
        rest = _confirm(docs, _across(docs, open_, percent, shingle), percent, shingle)
        if not rest.isEmpty():
            groups = components(links.unionAll(rest))
    labels = classes.select("d1", "d2", "rep").join(
        within(groups).withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    found = sketches.select("doc_id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2"], "left")
    alone = lambda name: F.when(F.col("doc_id").isNotNull(), F.coalesce(name, "doc_id"))
    return found.select(
        "doc_id", "n_shingles", alone("component_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        alone("class_id").alias("class_id"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one document of every group of near copies, the one with the least id.

    Texts without words are no copies of each other. Of rows that repeat both doc_id and
    text one stays; rows that share a doc_id with other texts stay or go together; rows
    without doc_id stay.
    """
    found = cut_lineage(near_duplicates(docs, percent, shingle).select("doc_id", "kept"), "verdicts")
    copies = cut_lineage(found.where("NOT kept").select("doc_id").distinct(), "copies")
    left = docs.join(within(copies), "doc_id", "left_anti").select(*docs.columns)
    again = cut_lineage(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where(
        "count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    once = left.join(within(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return left.join(within(again), "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def _sketcher(shingle: int):
    def sketch(batches):
        draw = np.random.default_rng(20240607)
        flips = draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        factors = draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
        for batch in slices(batches, "text"):
            words, first = word_hashes(*text_bytes(batch.column("text")))
            flat, offsets = distinct_sets(words, first, shingle)
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            count = len(sizes)
            digests = np.zeros((2, count), np.int64)
            signature = np.zeros((count, HASHES // PER_LONG), np.int64)
            bands = np.zeros((count, BANDS), np.int64)
            if len(some):
                starts = offsets[:-1][some]
                for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    digests[k, some] = np.add.reduceat(mix(flat ^ np.uint64(salt)), starts).view(np.int64)
                minima = _minima(flat, starts, flips, factors)
                signature[some] = _pack(minima)
                bands[some] = _band_keys(minima)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]),
                _lists(signature), _lists(bands)],
                names=["doc_id", "n_shingles", "d1", "d2", "signature", "bands"])
    return sketch


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _minima(flat: np.ndarray, starts: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(row, hash): the least value of every hash over each row's shingles."""
    out = np.empty((len(starts), HASHES), np.uint64)
    ends = np.append(starts[1:], len(flat))
    begin = 0
    while begin < len(starts):  # pieces that stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + (1 << 15), side="right")))
        piece, at = flat[starts[begin]:ends[end - 1]], starts[begin:end] - starts[begin]
        held = np.empty_like(piece)
        for k in range(HASHES):
            np.bitwise_xor(piece, flips[k], out=held)
            np.multiply(held, factors[k], out=held)
            out[begin:end, k] = np.minimum.reduceat(held, at)
        begin = end
    return out


def _pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of the 32-bit minima, PER_LONG of them to a long."""
    low = (minima >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    low = low.reshape(len(minima), -1, PER_LONG)
    places = (np.arange(PER_LONG) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low << places, axis=2).view(np.int64)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(len(minima), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
    return keys.view(np.int64)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, lead) for every bucket of at least two classes."""
    entries = classes.select("rep", F.explode("bands").alias("key"))
    heads = entries.groupBy("key").agg(
        F.min("rep").alias("lead"), F.max("rep").alias("last")
    ).where("last > lead").drop("last")
    return cut_lineage(entries.join(heads, "key"), "buckets")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal slots by bit count, less chance collisions."""
    ones = int("1" * PER_LONG, 16) if BITS == 4 else None
    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: _differing(x.bitwiseXOR(y), ones)), F.lit(0), lambda s, x: s + x)
    share = 1 - differing / F.lit(HASHES)
    chance = 1 / (1 << BITS)
    return (share - chance) / (1 - chance)


def _differing(x: Column, ones: int) -> Column:
    folded = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2))
    return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))


def _cut(least: float) -> float:
    chance = 1 / (1 << BITS)
    share = least + (1 - least) * chance
    return least - SIGMAS * (share * (1 - share) / HASHES) ** 0.5 / (1 - chance)


def _likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate leaves the threshold possible."""
    side = lambda end: signatures.select(F.col("rep").alias(end), F.col("signature").alias(f"s{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        estimate(F.col("sa"), F.col("sb")) >= _cut(least)).select("a", "b").distinct()


def _unresolved(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, component, family) of the members of buckets that still hold several components.

    A family is what such buckets connect; it is named by its least member.
    """
    own = within(groups).select(F.col("node").alias("rep"), "component")
    members = cut_lineage(buckets.join(own, "rep", "left").select(
        "key", "rep", "lead", F.coalesce("component", "rep").alias("component")), "members")
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = cut_lineage(members.join(mixed, "key", "left_semi").select("rep", "component", "lead").distinct(), "unresolved")
    families = components(open_.select(F.col("lead").alias("a"), F.col("rep").alias("b"))).select(
        F.col("node").alias("rep"), F.col("component").alias("family"))
    return cut_lineage(open_.select("rep", "component").distinct().join(within(families), "rep"), "families")


def _across(docs: DataFrame, open_: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs of different components in one family that can still reach the threshold.

    Let D(x) be the shingles in which x and the family's first member p differ. Two sets
    x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and similarity t allows
    (1 - t) / (1 + t) (|x| + |y|) of them. So x and y must share a certain number of
    differences from p, one at least as not both are linked with p.

    Whoever y is, x shares at least |D(x)| - (1 - t) / t |x| of its differences with it, as y
    has no more than |x| / t shingles and c common differences need |D(y)| >= c. Members
    that share fewer with all others are dropped. Differences are taken in one order, the
    rare ones first; a pair that must share k of them meets at the first common one, where
    each side has k left. So the join keeps pairs only at rare differences: it misses no
    link, and neither copies with edits of their own nor the many that all differ from
    p in the same way meet pair by pair.
    """
    ids = open_.select(F.col("rep").alias("doc_id"))
    texts = cut_lineage(docs.join(within(ids), "doc_id", "left_semi"), "texts")
    side = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"t{end}"))
    both = within(open_.select("rep", "family")).join(side("rep"), "rep").join(side("family"), "family")

    def differ(batches):
        for batch in slices(batches, "trep"):
            for part in slices([batch], "tfamily"):
                sets = [distinct_sets(*word_hashes(*text_bytes(part.column(c))), shingle) for c in ("trep", "tfamily")]
                elements, sizes = [], np.zeros((2, part.num_rows), np.int64)
                for row in range(part.num_rows):
                    a, b = (flat[offsets[row]:offsets[row + 1]] for flat, offsets in sets)
                    elements.append(np.setxor1d(a, b, assume_unique=True))
                    sizes[:, row] = len(a), len(elements[-1])
                rows = pa.array(np.repeat(np.arange(part.num_rows), sizes[1]))
                yield pa.RecordBatch.from_arrays([
                    part.column("rep").take(rows), part.column("family").take(rows), pa.array(sizes[0]).take(rows),
                    pa.array(sizes[1]).take(rows), pa.array(np.concatenate(elements).view(np.int64))],
                    names=["rep", "family", "size", "away", "element"])

    rows = map_texts(both, differ, "rep long, family long, size long, away long, element long")
    rows = cut_lineage(rows.join(within(open_.select("rep", "component")), "rep"), "differences")
    place = ["family", "element"]
    # A hundredth is taken off so that rounding cannot lose a pair.
    least = F.greatest(F.lit(1.0), F.ceil(F.col("away") - F.col("size") * (100 - percent) / percent - 0.01))
    for name in ("shared", "partners"):  # the second time without the members dropped by the first
        rows = _met(rows, place).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("rep")))
        rows = cut_lineage(rows.where(F.col("shared") >= least), name)
    sets = cut_lineage(rows.groupBy("rep").agg(F.collect_list("element").alias("elements")), "sets")
    rare = Window.partitionBy("rep").orderBy("members", "element")
    rows = rows.withColumn("left", F.col("shared") - F.row_number().over(rare) + 1)
    rows = cut_lineage(_met(cut_lineage(rows.where(F.col("left") >= least), "rare"), place), "meeting")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    end = lambda e, own, other: rows.select(
        *place, F.col(own).alias("i"), F.col(other).alias("j"), F.col("rep").alias(e), F.col("component").alias(f"c{e}"),
        F.col("size").alias(f"n{e}"), F.col("away").alias(f"d{e}"), F.col("left").alias(f"s{e}"), F.col("low").alias(f"l{e}"))
    # One end of a pair is outside the element's least component.
    a, b = end("a", "block", "other").where("ca <> la"), end("b", "other", "block")
    need = F.greatest(F.lit(1.0), F.ceil((
        F.col("da") + F.col("db") - (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)) / 2 - 0.01))
    possible = (F.col("ca") != F.col("cb")) & (F.least("sa", "sb") >= need) & (
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((F.col("cb") == F.col("lb")) | (F.col("a") < F.col("b")))
    met = cut_lineage(a.join(b, [*place, "i", "j"]).where(possible).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), need.alias("need")).distinct(), "met")
    side = lambda e: sets.select(F.col("rep").alias(e), F.col("elements").alias(f"e{e}"))
    return met.join(side("a"), "a").join(side("b"), "b").where(
        F.size(F.array_intersect("ea", "eb")) >= F.col("need")).select("a", "b")


def _met(rows: DataFrame, place: list[str]) -> DataFrame:
    """`rows` at places where several components meet, with their members and least component there."""
    common = rows.groupBy(*place).agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.drop("members", "low").join(common.drop("high"), place)


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = cut_lineage(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    ids = cut_lineage(ids, "ids")
    texts = cut_lineage(docs.join(within(ids), "doc_id", "left_semi"), "texts")
    side = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"t{end}"))
    both = within(pairs).join(side("a"), "a").join(side("b"), "b")

    def compare(batches):
        for batch in slices(batches, "ta"):
            for part in slices([batch], "tb"):
                sets = [distinct_sets(*word_hashes(*text_bytes(part.column(c))), shingle) for c in ("ta", "tb")]
                linked = np.zeros(part.num_rows, bool)
                for row in range(part.num_rows):
                    a, b = (flat[offsets[row]:offsets[row + 1]] for flat, offsets in sets)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    linked[row] = len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common)
                rows = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(pa.array(rows)), part.column("b").take(pa.array(rows))], names=["a", "b"])

    return cut_lineage(map_texts(both, compare, "a long, b long").distinct(), "links")
