"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

1. One Arrow pass turns each text into its set of five-word shingles (64-bit hashes), a
   128-bit fingerprint of the set and one hash per band.  Only the fingerprint and the
   bands leave the pass.
2. Texts with equal sets are one class (map-side combined); joins go on between classes.
3. Classes that share a band hash are tied to the smallest class of that bucket - a star
   instead of all pairs - and the stars' connected components are the candidate groups.
4. Each candidate group is cut into size bands (Jaccard >= t bounds the size ratio by t)
   and hash blocks of a bounded number of shingles; a pair of blocks is one cell.  The
   sets of candidate classes alone are computed again and joined to the cells, and each
   cell takes all its intersections with one matrix product.
5. A cell returns a partial number of links per class and a spanning forest of its links,
   never the pairs, so a group of m near copies costs m rows per block, not m squared.

The number of bands is chosen so that a pair at the threshold itself is found with
probability ``recall``; pairs above it are found with a higher one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.graph import components
from ticketlake.llm.kernels import Words, as_long, mix, pieces
from ticketlake.llm.spark import bounded_batches
from ticketlake.session import materialize

BLOCK_ROWS = 256
BLOCK_SHINGLES = 1_000_000


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which enough bands for ``recall`` at
    ``threshold`` fit in ``most`` permutations (more rows: fewer false candidates)."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _signatures(n: int, bands: int, rows: int, with_sets: bool):
    """Arrow pass: (id, text) -> fingerprint and band hashes, or the shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in pieces(batches, "text"):
            ids = batch.column(0)
            hashes, offsets = Words(batch.column(1).to_pylist()).shingles(n)
            docs = len(ids)
            sets = [np.unique(hashes[offsets[d]:offsets[d + 1]]) for d in range(docs)]
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            flat = np.concatenate(sets) if docs else np.zeros(0, np.uint64)
            at = np.concatenate(([0], np.cumsum(size)))
            fp = np.zeros((2, docs), np.uint64)
            if len(some):
                for k in (0, 1):
                    fp[k][some] = np.add.reduceat(mix(flat, 11 + k), at[some])
            key = [x if x is not None else -(int(fp[0][d]) >> 2) - 2**62 for d, x in enumerate(ids.to_pylist())]
            out = {"id": ids, "key": pa.array(key, pa.int64()), "n": pa.array(size),
                   "fp1": pa.array(as_long(fp[0])), "fp2": pa.array(as_long(fp[1]))}
            if with_sets:
                out["grams"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(as_long(flat)))
            else:
                low = np.zeros((docs, bands), np.uint64)
                if len(some):
                    for band in range(bands):
                        h = np.full(len(some), band, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            h = mix(h ^ np.minimum.reduceat(flat * mult[k] + add[k], at[some]))
                        low[some, band] = h
                per = np.where(size > 0, bands, 0)
                out["bands"] = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(as_long(low[some].ravel())))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _verify(threshold: float):
    """One cell: links between its left and its right block (or inside one block)."""

    def run(table: pa.Table) -> pa.Table:
        # a class once; an id with two texts is the node of two classes
        _, first = np.unique(np.stack([table["fp1"].to_numpy(), table["fp2"].to_numpy()]), axis=1, return_index=True)
        table = table.take(pa.array(first))
        node, weight = table["node"].to_numpy(), table["copies"].to_numpy()
        left = table["left"].to_numpy(zero_copy_only=False)
        right = table["right"].to_numpy(zero_copy_only=False)
        size = table["n"].to_numpy()
        grams = table["grams"].combine_chunks()
        lengths = np.diff(grams.offsets.to_numpy())
        row = np.repeat(np.arange(len(node)), lengths)
        values, gram, count = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = count[gram] > 1
        row, gram = row[shared], gram[shared]
        rank = np.cumsum(count > 1) - 1
        gram = rank[gram]
        common = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(gram, kind="stable")
        row, gram = row[order], gram[order]
        width = 8192
        for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
            lo, hi = np.searchsorted(gram, (at, at + width))
            dense = np.zeros((len(node), min(width, int(gram[hi - 1]) - at + 1)), np.float32)
            dense[row[lo:hi], gram[lo:hi] - at] = 1
            common += dense @ dense.T
        both = size[:, None] + size[None, :]
        link = common * (1 + threshold) >= threshold * both - 1e-6
        link &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        np.fill_diagonal(link, False)
        links = link @ weight
        label = np.arange(len(node))
        while True:  # smallest reachable row of the cell
            new = np.minimum(label, np.where(link, label[None, :], len(node)).min(1, initial=len(node)))
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.table({"fp1": table["fp1"], "fp2": table["fp2"], "node": pa.array(node), "links": pa.array(links.astype(np.int64)),
                         "to": pa.array(node[label])}).filter(pa.array(links > 0))

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, component_id, kept.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of
    other rows with Jaccard similarity >= threshold, ``component_id`` the smallest id
    reachable over links, ``kept`` whether the row's id is that one.

    Words are lower-case and split at white space.  Null and empty texts have the empty
    set; two empty sets count as equal (similarity 1).  Texts of fewer than n words have
    one shingle.  Rows that repeat an id and text link with each other like copies; a row
    without id gets a class like any other, whose number is negative if no row of the
    class has an id.  An id that stands for two different texts joins their groups.
    Other columns are ignored, an empty table gives an empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, key long, n long, fp1 long, fp2 long"
    sign = materialize(plain.mapInArrow(_signatures(n, bands, rows, False), schema + ", bands array<long>"))

    classes = materialize(
        sign.groupBy("fp1", "fp2")
        .agg(F.coalesce(F.min("id"), F.min("key")).alias("node"), F.count("*").alias("copies"),
             F.first("n").alias("n"), F.first("bands").alias("bands")))
    entry = classes.select("node", F.explode("bands").alias("h"))
    bucket = entry.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    group = components(entry.join(bucket, "h").select("node", "least"), "node", "least")

    # size bands: Jaccard >= t means sizes within a factor t, so only neighbouring bands meet
    member = materialize(
        classes.drop("bands").join(group, "node")
        .withColumn("sb", F.floor(F.log("n") / F.lit(math.log(1 / threshold)) + 1e-9)))
    blocks = materialize(
        member.groupBy("root", "sb").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        .select("root", "sb", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("nb")))
    above = blocks.select("root", (F.col("sb") - 1).alias("sb"), F.col("nb").alias("nb_up"))
    below = blocks.select("root", (F.col("sb") + 1).alias("sb"), F.col("nb").alias("nb_down"))
    around = blocks.join(above, ["root", "sb"], "left").join(below, ["root", "sb"], "left").na.fill(0)
    placed = member.join(around, ["root", "sb"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    cells = placed.select(
        "node", "copies", "n", "fp1", "fp2", "root", F.explode(F.expr("""concat(
          transform(sequence(0, nb - 1), x -> struct(sb as sa, least(blk, x) as ba, sb as sz, greatest(blk, x) as bz, blk <= x as left, blk >= x as right)),
          if(nb_up > 0, transform(sequence(0, nb_up - 1), x -> struct(sb as sa, blk as ba, sb + 1 as sz, x as bz, true as left, false as right)), array()),
          if(nb_down > 0, transform(sequence(0, nb_down - 1), x -> struct(sb - 1 as sa, x as ba, sb as sz, blk as bz, false as left, true as right)), array()))
          """)).alias("cell")).select("node", "copies", "n", "fp1", "fp2", "root", "cell.*")

    again = plain.where("id is not null").join(group.select(F.col("node").alias("id")), "id", "left_semi")
    again = again.unionByName(plain.where("id is null"))
    sets = again.mapInArrow(_signatures(n, bands, rows, True), schema + ", grams array<long>")
    found = materialize(
        cells.join(sets.select(F.col("key").alias("node"), "fp1", "fp2", "grams"), ["node", "fp1", "fp2"])
        .groupBy("root", "sa", "ba", "sz", "bz")
        .applyInArrow(_verify(threshold), "fp1 long, fp2 long, node long, links long, to long"))

    degree = found.groupBy("fp1", "fp2").agg(F.sum("links").alias("links"))
    # an id with several texts joins their classes
    several = sign.where("id is not null").groupBy("id").agg(F.min("fp1").alias("low"), F.max("fp1").alias("high")).where("low <> high")
    owned = sign.join(several, "id", "left_semi").join(classes, ["fp1", "fp2"]).select("id", "node")
    same_id = owned.join(owned.groupBy("id").agg(F.min("node").alias("to")), "id").select("node", "to")
    root = components(found.select("node", "to").union(same_id), "node", "to")
    per_class = (
        classes.select("fp1", "fp2", "node", "copies").join(degree, ["fp1", "fp2"], "left").join(root, "node", "left")
        .select("fp1", "fp2", F.col("node").alias("class_id"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("root", "node").alias("component_id")))
    return (sign.select("id", "key", "fp1", "fp2").join(per_class, ["fp1", "fp2"])
            .select(F.col("id").alias(id_col), "class_id", "n_links", "component_id",
                    (F.coalesce("id", "key") == F.col("component_id")).alias("kept")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row left of each group of linked texts, that of the smallest id;
    rows that repeat it are left once.  A row without id can't be named and stays."""
    found = jaccard_classes(docs, id_col, text_col, **options).where(F.col("kept") & F.col(id_col).isNotNull())
    keep = materialize(found.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_rows")))
    many = keep.where("_rows > 1")
    out = docs.join(keep.where("_rows = 1"), docs[id_col] == keep["_id"], "left_semi")
    out = out.unionByName(docs.where(F.col(id_col).isNull()))
    if not many.isEmpty():
        out = out.unionByName(docs.join(many, docs[id_col] == many["_id"], "left_semi").dropDuplicates([id_col]))
    return out
