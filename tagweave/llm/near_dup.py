"""Near-duplicate documents: MinHash bands propose, signatures and full sets confirm, star steps connect.

Documents with equal shingle sets are one class from the start, whatever their number. Classes that share a band's
hash lie in one bucket. No bucket is expanded into all its pairs: its least class, the pivot, is compared with the
others, which connects most of a group of copies with as many comparisons as it has members. Buckets that then still hold several
components go a second, exact way: their classes meet under their rarest shingles, as far as sizes and places leave
a chance, and only across components. That way is complete for all pairs of its classes, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, discard, keyed, keyed_rows, mix, random_words, stage
from tagweave.llm.components import connected_components
from tagweave.llm.shingles import minima, set_digests, shingle_sets

#: Links need ``100 * intersection >= percent * union``; the contract of the query binds it to this, the pipeline takes 80.
PERCENT = 85
#: Sets whose similarity is the threshold share no band with this probability at most.
MISSED = 3e-7
#: Standard errors below the threshold at which a signature rules a pair out.
SLACK = 6

SIGNED = "doc_id long, h long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"


def bands_and_rows(percent: int) -> tuple[int, int]:
    """Bands, and hash functions of each: 32 of 6 for 85 per cent, 38 of 5 for 80."""
    rows = 6 if percent >= 85 else 5
    shared = min((percent / 100) ** rows, 1 - 1e-9)
    return math.ceil(math.log(MISSED) / math.log1p(-shared)), rows


def _signed(percent: int):
    n_bands, n_rows = bands_and_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size, digest, band hashes and the low bytes of all minima of every document's shingle set."""
        factor = random_words(31, n_rows)
        for block in blocks(batches, "text"):
            hashes, bounds = shingle_sets(block.column("text"))
            least = minima(hashes, bounds, n_bands * n_rows)
            s1, s2 = set_digests(hashes, bounds)
            rows = least.reshape(len(least), n_bands, n_rows).astype(np.uint64)
            bands = mix((rows * factor).sum(axis=2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)).view(np.int64)
            size = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * n_bands), pa.array(bands.ravel()))
            low = [row.tobytes() for row in least.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("h"), pa.array(size), pa.array(s1), pa.array(s2), lists, pa.array(low, pa.binary())],
                ["doc_id", "h", "n_shingles", "s1", "s2", "bands", "signature"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        hashes, bounds = shingle_sets(block.column("text"))
        s1, s2 = set_digests(hashes, bounds)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([block.column("r_rep"), pa.array(s1), pa.array(s2), lists], ["r_rep", "r1", "r2", "items"])


def _likely(percent: int):
    n = math.prod(bands_and_rows(percent))
    share = percent / 100
    least = share * n - SLACK * np.sqrt(n * share * (1 - share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("sig_a", "sig_b")]
                good = pa.array((sides[0] == sides[1]).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(good)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` of classes those whose signatures, then whose full sets, agree enough, as documents ``u, v``."""
    sig = classes.select("own", "signature")
    signed = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    likely = signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(percent), "a long, b long")
    full = likely.join(sets.toDF("b", "v", "items_b"), "b").join(sets.toDF("a", "u", "items_a"), "a")
    both = F.size(F.array_intersect("items_a", "items_b"))
    full = full.select("u", "v", both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("sum"))
    return full.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("u", "v")


def _members(classes: DataFrame) -> DataFrame:
    """``bucket, own, rep, n`` of the buckets with two classes or more."""
    spread = classes.select(F.explode("bands").alias("bucket"), "own", "rep", "n")
    shared = spread.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    return spread.join(shared, "bucket", "left_semi")


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's least class with every other class of the bucket that is of fitting size."""
    least = members.groupBy("bucket").agg(F.min(F.struct("rep", "own", "n")).alias("p")).select("bucket", "p.own", "p.n").toDF("bucket", "p_own", "p_n")
    fits = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    pairs = members.join(least, "bucket").where((F.col("own") != F.col("p_own")) & fits)
    return pairs.select(F.col("p_own").alias("a"), F.col("own").alias("b")).distinct()


def _size_class(n) -> F.Column:
    """Sizes of one class differ by four per cent at most."""
    return F.floor(F.log(n) / F.log(F.lit(1.04))).cast("int")


def _rest_pairs(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair ``a, b`` of the classes in ``active`` (``own, n, label``) that may be alike and has two labels.

    Shingles are put in one order, rarest first. If the intersection of two sets must have k shingles, the first one that they
    share stands before place n - k + 1 in either; so the shorter set is entered under its first shingles only, and
    the longer one asks under its own for sets of the sizes that its place still allows. Shingles that only copies of one
    label hold under their first are left out, and so is one label (the most frequent) against itself.
    """
    held = sets.select("own", "items").join(active, "own")
    tokens = held.select("own", "n", "label", F.explode("items").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(often, "token").groupBy("own", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    share, n = percent / 100, F.col("n")
    first = (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    placed = ordered.select("own", "n", "label", F.posexplode(F.slice("t", F.lit(1), first)).alias("pos", "o")).where("o.df > 1")
    placed = stage(placed.select("own", "n", "label", "pos", F.col("o.token").alias("token")), "placed")
    labels = placed.groupBy("token", "label").count().groupBy("token")
    mixed = labels.agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = stage(placed.join(mixed, "token"), "mixed")
    both = share / (1 + share)
    room = (n - F.col("pos")) / both - n + 1e-9  # sizes that a partner may have at most, if this is the first shared shingle
    entered = rows.where(room >= n).withColumn("size", _size_class(n))
    most = F.least(F.floor(room), n)
    asking = rows.withColumn("lo", F.ceil(n * share - 1e-9)).withColumn("hi", most).where("lo <= hi and hi >= 1")
    asking = asking.withColumn("size", F.explode(F.sequence(_size_class(F.greatest("lo", F.lit(1))), _size_class(F.col("hi")))))
    names = ["own", "n", "label", "pos"]
    few = F.col("label") != F.col("major")

    def meet(short: DataFrame, long: DataFrame) -> DataFrame:
        one = short.select("token", "size", *(F.col(c).alias(f"s_{c}") for c in names))
        two = long.select("token", "size", *(F.col(c).alias(f"l_{c}") for c in names))
        overlap = F.least(F.expr("s_n - s_pos"), F.expr("l_n - l_pos")) * (100 + percent) >= (F.col("s_n") + F.col("l_n")) * percent
        fits = (F.col("s_label") != F.col("l_label")) & F.expr("s_n <= l_n") & (F.col("s_n") * 100 >= F.col("l_n") * percent) & overlap
        equal = (one["token"] == two["token"]) & (one["size"] == two["size"])
        return one.join(two, equal & fits).select(F.least("s_own", "l_own").alias("a"), F.greatest("s_own", "l_own").alias("b"))

    return meet(entered.where(few), asking).union(meet(entered.where(~few), asking.where(few))).distinct()


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``u, v``: documents whose rows have different sets, and the representatives of the classes of these."""
    own = F.struct("s1", "s2")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    rows = signed.where("n_shingles > 0").select("doc_id", "s1", "s2").join(several.select("doc_id"), "doc_id", "left_semi")
    rows = rows.join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    alone = several.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v"))
    return rows.union(alone).distinct()


def link_classes(base: DataFrame, classes: DataFrame, same: DataFrame, percent: int) -> DataFrame:
    """``u, v``: the representative of every linked class and the least representative of its component.

    ``same`` has links that hold in any case.
    """
    members = stage(_members(classes), "members")
    needed = members.select(F.col("rep").alias("r_rep")).distinct()
    texts = base.join(needed, base["doc_id"] == needed["r_rep"]).select("r_rep", "text").mapInArrow(
        _sets, "r_rep long, r1 long, r2 long, items array<long>"
    )
    of_class = (F.col("rep") == F.col("r_rep")) & (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2"))
    sets = stage(texts.join(classes.select("own", "rep", "s1", "s2"), of_class).select("own", "rep", "items").dropDuplicates(["own"]), "sets")
    edges = stage(_verified(_pivot_pairs(members, percent), classes, sets, percent).union(same), "links")
    labels = connected_components(edges)
    labelled = members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = stage(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    active = stage(labelled.join(mixed, "bucket", "left_semi").select("own", "n", "label").distinct(), "active")
    rest = _verified(_rest_pairs(active, sets, percent), classes, sets, percent)
    all_edges = stage(edges.union(rest), "links")
    out = connected_components(all_edges)
    discard(members, sets, edges, labels, labelled, active, all_edges)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, kept`` of every row.

    Words are runs of non-white-space, A-Z as a-z; a document's set holds its 5-word shingles, or its whole sequence if
    it has fewer words. Documents are linked if the intersection of their sets has ``percent`` of the union or more.
    ``component_id`` is the least ``doc_id`` that links reach, ``kept`` says whether it is the row's own. Null, empty and
    blank texts have empty sets and are linked with nothing. Rows that share a ``doc_id`` count as one document, linked
    with whatever any of them is linked with. A null ``doc_id`` is compared with nothing: ``component_id`` is null and
    ``kept`` true. ``h`` is ``common.keyed``'s hash of the text; other columns are ignored.
    """
    base = keyed(docs, doc_id, text)
    signed = stage(base.mapInArrow(_signed(percent), SIGNED), "signed")
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2")
    classes = stage(
        grouped.agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
        ).withColumn("own", F.monotonically_increasing_id()),
        "classes",
    )
    # A document id may stand for several classes (repeated ids); the links between them make it one document.
    same = stage(_same_document(signed, classes), "same")
    labels = link_classes(base, classes, same, percent)
    of_id = same.select(F.col("u").alias("i_id")).distinct().join(labels.toDF("i_id", "i_label"), "i_id", "left")
    of_id = stage(of_id.select("i_id", F.coalesce("i_label", "i_id").alias("i_label")), "ids")
    groups = classes.select("s1", "s2", "rep").join(labels.toDF("rep", "label"), "rep", "left")
    groups = groups.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("label", "rep").alias("label"))
    of_class = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    found = signed.select("doc_id", "h", "n_shingles", "s1", "s2").join(groups, of_class, "left")
    found = found.join(of_id, F.col("doc_id") == F.col("i_id"), "left")  # also for rows of the document with empty sets
    component = F.coalesce("i_label", "label", "doc_id")
    return found.select(
        "doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def near_duplicate_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, n_shingles, component_id, kept``."""
    return near_duplicates(docs.select("doc_id", "text"), percent=PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; all columns stay. Equal rows are one document, which stays or goes."""
    gone = near_duplicates(docs, doc_id, text, percent).where("not kept").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"))
    whole = keyed_rows(docs, doc_id, text)
    left = whole.join(gone.distinct().hint("shuffle_hash"), (F.col("doc_id") == F.col("g_id")) & (F.col("h") == F.col("g_h")), "left_anti")
    return left.select("row.*")
