"""Near-duplicates by BagMinHash (operator 6).

A text is the multiset of its five-word shingles. A shingle that occurs w times
stands for the cells 0..w-1 of a discretised weight axis, cut into octaves of
1, 2, 4, ... cells. Every octave of a shingle is a Poisson process whose rate is
its width; a point carries a time, a cell and a signature slot, all from a hash,
and counts where the cell is below w. The earliest time in each slot is the
signature, and two signatures agree in a slot with the probability of the
weighted Jaccard similarity. Processes stop once all slots are filled.

Bands of the signature propose pairs, the multisets decide. A bucket's members
meet one leader, drawn by hash so that the buckets of one group have a few
different ones. Every member is checked against the leader whose signature is
nearest to its own, leaders also against each other; members that find no link
meet other leaders. Where the links leave a bucket in several components, the
members outside the largest are compared with all others in blocks, and a block
hands on only links that join components. Exact copies are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, map_batches, quoted
from cytoquilt.llm.graph import components
from cytoquilt.session import materialize

SHINGLE = 5
BANDS, ROWS = 20, 5
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree less than so many standard errors below the threshold are not looked at.
SLACK = 4
BLOCK = 256
#: Orders in which the buckets draw leaders, for all members and for those still without a link.
DRAWS, MORE_DRAWS = 4, 8


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_bags(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of all documents; one with fewer than five words is a single shingle."""
    sizes = np.diff(offsets)
    per = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(sizes)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offsets[:-1], per)
    end = np.repeat(offsets[1:], per)
    padded = np.concatenate((words.view(np.uint64), np.zeros(SHINGLE, np.uint64)))
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < end, padded[at + k], np.uint64(k)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (docs, slots): the earliest time per slot; inf for a document without shingles."""
    octaves = np.floor(np.log2(count)).astype(np.int64) + 1 if len(count) else np.zeros(0, np.int64)
    pick = np.repeat(np.arange(len(count)), octaves)
    octave = np.arange(octaves.sum()) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    doc, count, width = doc[pick], count[pick], (1 << octave).astype(np.float64)
    seed = mix(shingle[pick] + octave.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    weight = np.bincount(doc, np.minimum(width, count - (width - 1)), docs)
    signature = np.full(docs * slots, np.inf)
    # enough points to fill every slot of nearly all documents at the first go
    until = slots * (np.log(slots) + 6) / np.maximum(weight, 1)
    time, step = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    drawn = seed

    def advance(live: np.ndarray) -> None:
        drawn[live] = mix(seed[live] + (step[live] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        time[live] += -np.log(((drawn[live] >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live]
        step[live] += np.uint64(1)

    drawn = np.zeros(len(doc), np.uint64)
    advance(np.arange(len(doc)))
    live = np.arange(len(doc))
    while True:
        live = live[time[live] <= until[doc[live]]]
        while live.size:
            y = mix(drawn[live] ^ np.uint64(0xA0761D6478BD642F))
            slot = ((y >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            cell = width[live] - 1 + np.floor((y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[live])
            ok = cell < count[live]
            np.minimum.at(signature, doc[live][ok] * slots + slot[ok], time[live][ok])
            advance(live)
            live = live[time[live] <= until[doc[live]]]
        open_ = np.isinf(signature.reshape(docs, slots)).any(1) & (weight > 0)
        if not open_.any():
            return signature.reshape(docs, slots)
        until = np.where(open_, until * 1.5, 0.0)
        live = np.flatnonzero(open_[doc])


Bag = tuple[np.ndarray, np.ndarray]  # ascending shingle hashes and their counts


def bags_of(lists: list[np.ndarray]) -> list[Bag]:
    """Shingle multisets of word-hash arrays."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    doc, h, n = shingle_bags(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), offsets)
    cut = np.searchsorted(doc, np.arange(len(lists) + 1))
    return [(h[i:j], n[i:j]) for i, j in zip(cut, cut[1:])]


def overlap(a: Bag, b: Bag) -> float:
    """Weighted Jaccard similarity of two multisets; 0 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    common = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of the shingle multisets of two word-hash arrays."""
    return overlap(*bags_of([a, b]))


def words_of(text: Column) -> Column:
    """Hashes of a text's words: lower-cased runs of letters and digits."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def node_of(words: Column) -> Column:
    """128-bit key of the word sequence; texts that share it are exact copies."""
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(3), words).alias("b"))


NODE = "struct<a:bigint,b:bigint>"


def signatures(rows: DataFrame, id_kind: str) -> DataFrame:
    """(id, node, bands array<long>, sketch binary) of rows (id, node, words)."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            lists = batch.column(2)
            words, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            doc, h, n = shingle_bags(words, offsets)
            times = bag_minhash(doc, h, n, batch.num_rows).view(np.uint64)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            parts = times.reshape(batch.num_rows, BANDS, ROWS)
            for k in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
            bands ^= mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            flat = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.view(np.int64).ravel())
            sketch = (mix(times) & np.uint64(0xFF)).astype(np.uint8)
            return [batch.column(0), batch.column(1), flat, [row.tobytes() for row in sketch]]

        return work

    return map_batches(rows, make, f"id {id_kind}, node {NODE}, bands array<bigint>, sketch binary", rows=16_384, size=12 << 20)


def least_agreement(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / SLOTS) ** 0.5


def leaders(members: DataFrame, first: int, draws: int) -> DataFrame:
    """(bucket, u): one member of each bucket, the first in one of ``draws`` orders."""
    order = F.xxhash64("node", F.pmod("bucket", F.lit(draws)) + first)
    return members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "node")).alias("leader")).select("bucket", F.col("leader.node").alias("u"))


def agreeing(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (u, v) whose signatures agree enough, with their agreement."""
    floor = least_agreement(threshold)
    near = pairs.join(sketches.withColumnsRenamed({"node": "u", "sketch": "su"}), "u")
    near = near.join(sketches.withColumnsRenamed({"node": "v", "sketch": "sv"}), "v")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
            agree = (a == b).mean(1)
            keep = pa.array(agree >= floor)
            return [*batch.filter(keep).columns[:2], agree[agree >= floor]]

        return work

    return map_batches(near.select("u", "v", "su", "sv"), make, f"u {NODE}, v {NODE}, agree double", size=32 << 20)


def nearest(scored: DataFrame) -> DataFrame:
    """For each v the u that agrees most."""
    return scored.groupBy("v").agg(F.max(F.struct("agree", "u")).alias("best")).select("best.u", "v")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those (u, v) whose multisets overlap enough."""
    full = pairs.join(texts.withColumnsRenamed({"node": "u", "text": "tu"}), "u").join(texts.withColumnsRenamed({"node": "v", "text": "tv"}), "v")
    full = full.select("u", "v", words_of(F.col("tu")).alias("wu"), words_of(F.col("tv")).alias("wv"))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            left, right = (bags_of([x.values.to_numpy() for x in batch.column(k)]) for k in (2, 3))
            keep = [overlap(a, b) >= threshold for a, b in zip(left, right)]
            return batch.filter(pa.array(keep, pa.bool_())).columns[:2]

        return work

    return map_batches(full, make, f"u {NODE}, v {NODE}", size=32 << 20)


def joining_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between components of one block: rows on side 0 against those on side 1; only links that join are returned."""
    floor = least_agreement(threshold)
    left, right = group[group.side == 0].reset_index(drop=True), group[group.side == 1].reset_index(drop=True)
    out: list[tuple] = []
    if len(left) and len(right):
        right_sketch = np.stack([np.frombuffer(s, np.uint8) for s in right.sketch])
        bags = bags_of([np.asarray(w) for w in [*left.words, *right.words]])
        names = pd.factorize(pd.concat([left.component, right.component]).map(lambda c: (c["a"], c["b"])))[0]
        root = list(range(names.max() + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(left)):
            agree = (right_sketch == np.frombuffer(left.sketch[i], np.uint8)).mean(1)
            for j in np.argsort(-agree, kind="stable"):
                if agree[j] < floor:
                    break
                a, b = find(names[i]), find(names[len(left) + j])
                if a != b and overlap(bags[i], bags[len(left) + j]) >= threshold:
                    root[b] = a
                    out.append((left.node[i], right.node[j]))
    return pd.DataFrame(out, columns=["u", "v"])


def rest_links(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """Links inside buckets that still hold several components; None if there is no such bucket."""
    known = materialize(labelled(members, labels))
    per = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    # buckets of the same members, from different bands, are one
    active = per.where("low != high").groupBy("sum", "n").agg(F.min("bucket").alias("bucket"))
    active = materialize(active)
    if active.isEmpty():
        return None
    inside = known.join(active, "bucket")
    sizes = inside.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"))
    inside = inside.join(sizes, "bucket")
    # signatures first: only members with a possible partner outside their component need their texts
    rows = inside.join(sketches.select("node", "sketch"), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    outside = F.col("component") != F.col("top.component")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where(outside).select("bucket", F.col("block").alias("ub"), every.alias("mb"), "node", "component", "sketch", F.lit(0).alias("side"))
    right = rows.select("bucket", every.alias("ub"), F.col("block").alias("mb"), "node", "component", "sketch", F.lit(1).alias("side"))
    paired = left.unionByName(right)
    floor = least_agreement(threshold)

    def hopeful(group: pd.DataFrame) -> pd.DataFrame:
        side = group.side.to_numpy()
        sketch = np.stack([np.frombuffer(s, np.uint8) for s in group.sketch])
        names = pd.factorize(group.component.map(lambda c: (c["a"], c["b"])))[0]
        keep = np.zeros(len(group), bool)
        other = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            hit = other[((sketch[other] == sketch[i]).mean(1) >= floor) & (names[other] != names[i])]
            keep[i] |= hit.size > 0
            keep[hit] = True
        return group[keep]

    schema = f"bucket bigint, ub int, mb int, node {NODE}, component {NODE}, sketch binary, side int"
    # few bytes, much work: as many tasks as the session has partitions, which adaptive execution leaves alone
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_of = ["bucket", "ub", "mb"]
    some = materialize(paired.repartition(parts, *block_of).groupBy(*block_of).applyInPandas(hopeful, schema))
    if some.isEmpty():
        return None
    # a text is shorter than its words' hashes, so those are made behind the shuffle
    full = some.join(texts, "node").repartition(parts, *block_of).withColumn("words", words_of(F.col("text"))).drop("text")
    return full.groupBy(*block_of).applyInPandas(lambda g: joining_links(g, threshold), f"u {NODE}, v {NODE}")


SLOT_BITS = 24  # 2 MB of bitmap, however many ids there are


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose id falls into a slot of some id of ``wanted``: all that match and few others.

    The slots are a bitmap of fixed size, so it may be broadcast; with very many
    ids it fills up and lets more through. An exact join follows.
    """

    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << SLOT_BITS)) + 1

    marks = wanted.select(slot("low").alias("slot")).selectExpr("bitmap_bucket_number(slot) as part", "bitmap_bit_position(slot) as at")
    marks = materialize(marks.groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("bits")))
    placed = rows.withColumn("slot", slot("id")).selectExpr(*rows.columns, "bitmap_bucket_number(slot) as part", "bitmap_bit_position(slot) as at")
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1")
    return placed.join(F.broadcast(marks), "part").where(bit == 1).select(*rows.columns)


def texts_of(rows: DataFrame, busy: DataFrame) -> DataFrame:
    """(node, text) of each node of ``busy`` (node, id), from ``rows`` (id, text); an id may come with several texts.

    The node decides: another text of the same words serves as well. It is an inner join on
    unique nodes, since the planner moves a semi join below :func:`likely` and shuffles every text.
    """
    some = likely(rows, busy.select(F.col("id").alias("low"))).select(node_of(words_of(F.col("text"))).cast(NODE).alias("node"), "text")
    return some.join(busy.select("node"), "node").groupBy("node").agg(F.min("text").alias("text"))


def near_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, node null where there are no words, and (node, component) of nodes that have a near-duplicate."""
    plain = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    words = plain.select("id", words_of(F.col("text")).alias("words"))
    words = words.select("id", F.when(F.size("words") > 0, node_of(F.col("words"))).alias("node"), "words")
    signed = materialize(signatures(words, plain.schema["id"].dataType.simpleString()))
    # copies carry equal signatures, one of them stands for all
    nodes = signed.where("node is not null").groupBy("node")
    nodes = materialize(nodes.agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    bands = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialize(bands.join(shared, "bucket", "left_semi"))
    busy = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "sketch")
    busy = materialize(busy)
    sketches = busy.select("node", "sketch")
    texts = materialize(texts_of(plain, busy))
    led = leaders(members, 0, DRAWS)
    pairs = members.join(led, "bucket").select("u", F.col("node").alias("v")).where("u != v").distinct()
    scored = materialize(agreeing(pairs, sketches, threshold))
    # leaders of one group find each other, however many members each has; a pair may come from both sides
    among = scored.join(led.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
    first = nearest(scored).unionByName(among).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = materialize(verified(first, texts, threshold))
    done = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    open_ = members.join(done, "node", "left_anti")
    pairs = open_.join(leaders(members, DRAWS, MORE_DRAWS), "bucket").select("u", F.col("node").alias("v")).where("u != v").distinct()
    links = links.unionByName(materialize(verified(nearest(agreeing(pairs, sketches, threshold)), texts, threshold)))
    labels = components(links)
    more = rest_links(members, labels, sketches, texts, threshold)
    return signed.select("id", "node"), labels if more is None else merged(labels, materialize(more))


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further links, which are links between components: those alone are joined anew."""

    def component(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))

    joined = more.join(component("u"), "u", "left").join(component("v"), "v", "left")
    joined = joined.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    roots = components(joined)
    kept = labels.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    kept = kept.select("node", F.coalesce("root", "component").alias("component"))
    # a node without a link so far is its own component
    return kept.unionByName(roots.join(labels.select("node"), "node", "left_anti"))


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the component that they are in so far."""
    return members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, class_col: str = "class_id") -> DataFrame:
    """(id, class id, class size) of every row; the class id is the smallest id of the class.

    Classes are connected by similarity ``threshold`` or more of five-word shingle
    multisets, words being lower-cased runs of letters and digits. Texts of fewer
    than five words are alike only where their words are the same. A null, empty
    or wordless text is in a class of its own; repeated rows share a class; null
    ids never name a class that has another id. An empty table gives no rows.
    """
    rows, near = near_classes(df, id_col, text_col, threshold)
    per = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    per = materialize(per.join(near, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "low", "n"))
    whole = per.groupBy("component").agg(F.min("low").alias("first"), F.sum("n").alias("size"))
    out = rows.join(per.select("node", "component").join(whole, "component"), "node", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("first", "id").alias(class_col), F.coalesce("size", F.lit(1)).alias("class_size")
    )


def keep_one(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each class left, that of the smallest id; columns stay as they are."""
    low, times, words, key = fresh(df, "_low", "_times", "_words", "_node")
    own = [quoted(c) for c in df.columns]
    rows, near = near_classes(df, id_col, text_col, threshold)
    per = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    per = materialize(per.join(near, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "low", "n"))
    first = per.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node", "n")).alias("kept"))
    kept = first.select(F.col("kept.node").alias(key), F.col("kept.low").alias(low), F.col("kept.n").alias(times))
    keyed = df.select(*own, words_of(quoted(text_col)).alias(words))
    keyed = keyed.select(*own, F.when(F.size(words) > 0, node_of(quoted(words))).alias(key))
    wordless = keyed.where(quoted(key).isNull()).select(*own)
    found = keyed.join(kept, key).where(quoted(id_col).eqNullSafe(quoted(low)))
    once = found.where(quoted(times) == 1).select(*own)
    # rows of a copied text may repeat the id as well
    again = found.where(quoted(times) > 1).dropDuplicates([key]).select(*own)
    return wordless.unionByName(once).unionByName(again)
