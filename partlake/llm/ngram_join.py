"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

The incidence matrix is cut into blocks of columns (ranges of n-gram hashes). In a first
sweep a block counts its columns; columns with one document cannot add to any overlap and
go. What is left of a document bounds its overlap with every other, so documents with less
than the least overlap their size asks for are discarded, which leaves few but the true near
copies. In the product itself, a block multiplies its part of two rows and emits the partial
overlap; the partial overlaps of a pair are summed over blocks, and pairs below the bound
that follows from both sizes are discarded.

Which entries of the product are asked for is bounded by sizes, too: columns are ordered
from rare to frequent, and a linked pair must meet in the first columns of both. Copies are
one row of the matrix. Groups of near copies are not expanded into pairs: each column first
links its documents to one leader, linked documents become one component, and only pairs
between different components are still open. The last round takes every such pair, so no
link between components is missed, and what bounds the work is the number of links needed to
join a group, not the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.llm.batches import slices_by_bytes, text_batches
from partlake.llm.components import connected_components
from partlake.llm.scratch import Scratch
from partlake.llm.shingles import shingle_sets

#: Groups of copies that are emitted once: the largest ones.
HEAVY_GROUPS = 1024
#: Share of a piece's documents from which a column is a candidate for the heavy ones, and of all
#: documents from which it is one. With m columns to a document there are m / HEAVY_SHARE at most.
HEAVY_SHARE = 0.01
#: Incidences in a block of the first sweep.
BLOCK_CELLS = 1_000_000
#: Incidences of an average row, and of the longest one, in a block of the product.
ROW_CELLS, LONGEST_CELLS = 256, 1 << 16
LEADER_ROUNDS = 4
#: Incidences that a task packs at once.
PACK_CELLS = 1_000_000
#: Bytes of text hashed at once.
PIECE = 1 << 20
#: Rows of a column compared with each other at once.
CHUNK = 512


def set_table(docs: DataFrame, id_col: str, text_col: str, k: int, row_col: str | None = None) -> DataFrame:
    """Rows of two kinds: (id, key, n) of each document; (null, column, hits) of columns frequent in a piece.

    With ``row_col``, a long, documents have it as ``row``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more, form = ([row_col], ", `row` long") if row_col else ([], "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices_by_bytes(b, 1, PIECE):
                rows = part.num_rows
                s = shingle_sets(part.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s.key.view(np.int64)), pa.array(s.size), pa.array([False] * rows), *part.columns[2:]],
                    names=["id", "key", "n", "column", *["row" for _ in more]],
                )
                cols, hits = np.unique(s.flat, return_counts=True)
                often = hits > max(1, HEAVY_SHARE * rows)
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(m, b.column(0).type),
                        pa.array(cols[often].view(np.int64)),
                        pa.array(hits[often].astype(np.int64)),
                        pa.array([True] * m, pa.bool_()),
                        *[pa.nulls(m, pa.int64()) for _ in more],
                    ],
                    names=["id", "key", "n", "column", *["row" for _ in more]],
                )

    return text_batches(docs).select(id_col, text_col, *more).mapInArrow(run, f"id {kind}, key long, n long, `column` boolean{form}")


def _incidence(docs, id_col, text_col, k, n_blocks, heavy_cols, heavy_sets) -> DataFrame:
    """A task's documents cut by block and packed, one row for each block and ``PACK_CELLS`` incidences.

    ``cells`` has ``m`` column numbers of each document: the low 48 bits, as the block has the
    others, or all 64 where ``hot``, as heavy columns stay with a block of their document's own.
    """
    order = np.sort(np.array(heavy_cols, np.int64).view(np.uint64))

    def pack(keys, flat, own) -> Iterator[pa.RecordBatch]:
        hot = np.isin(flat, order) if len(order) else np.zeros(len(flat), bool)
        for is_hot in (False, True):
            f, o = flat[hot == is_hot], own[hot == is_hot]
            if not len(f):
                continue
            if is_hot:
                block = (keys[o].view(np.uint64) % np.uint64(n_blocks)).astype(np.int64)
            else:
                block = _block_of(f, n_blocks)
            by_block = np.argsort(block, kind="stable")
            f, o, block = f[by_block], o[by_block], block[by_block]
            start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            doc = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (block[1:] != block[:-1])]))
            if is_hot:
                data, width = f.astype("<u8").tobytes(), 8
            else:
                low = f & np.uint64(0xFFFFFFFFFFFF)
                packed = np.empty((len(f), 3), "<u2")
                for w in range(3):
                    packed[:, w] = (low >> np.uint64(16 * w)).astype(np.uint16)
                data, width = packed.tobytes(), 6
            cut = np.append(np.searchsorted(doc, start), len(doc)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[start].astype(np.int32)),
                    pa.array([is_hot] * len(start)),
                    lists(keys[o[doc]]),
                    lists(np.diff(np.append(doc, len(f))).astype(np.int32)),
                    _binaries(data, start * width, np.append(start[1:], len(f)) * width),
                ],
                names=["block", "hot", "key", "m", "cells"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, docs_held, seen = [], 0, 0, set()

        def flush():
            if held:
                yield from pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for b in batches:
            for part in slices_by_bytes(b, 1, PIECE):
                ids = part.column(0).to_pylist()
                s = shingle_sets(part.column(1).to_pylist(), k)
                keys = s.key.view(np.int64)
                # a set is emitted once a pack; one of a huge group by its first document alone
                first = np.zeros(len(ids), bool)
                for x, key in enumerate(keys.tolist()):
                    if s.size[x] and key not in seen and heavy_sets.get(key, ids[x]) == ids[x]:
                        seen.add(key)
                        first[x] = True
                if not first.any():
                    continue
                mine = np.repeat(first, s.size)
                own = np.repeat(np.arange(int(first.sum())), s.size[first]) + docs_held
                held.append((keys[first], s.flat[mine], own))
                cells, docs_held = cells + len(own), docs_held + int(first.sum())
                if cells >= PACK_CELLS:
                    yield from flush()
                    held, cells, docs_held, seen = [], 0, 0, set()
        yield from flush()

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(run, "block int, hot boolean, key array<long>, m array<int>, cells binary")


def _block_of(col: np.ndarray, n_blocks: int) -> np.ndarray:
    """Blocks are equal ranges of the hashes' leading 32 bits."""
    return ((col >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def _binaries(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over consecutive parts of ``data``."""
    offsets = np.concatenate([starts, ends[-1:]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


PACKED = "dest int, key array<long>, m array<int>, cols array<long>, df array<int>"


def _shared_cells(n_dest: int):
    """For a block: its documents' columns of two or more documents, with those columns' counts.

    Documents are packed by destination, so a block gives ``n_dest`` rows, however many
    documents it has.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        hot = t.column("hot").to_numpy()
        lists = lambda c, at: t.column(c).take(pa.array(at)).combine_chunks().flatten().to_numpy()
        keys, own, cols, dfs, docs = [], [], [], [], 0
        for is_hot in (False, True):
            rows = np.flatnonzero(hot == is_hot)
            if not len(rows):
                continue
            key_of, m = lists("key", rows), lists("m", rows)
            once = np.zeros(len(key_of), bool)
            once[np.unique(key_of, return_index=True)[1]] = True  # copies of a set count once
            data = b"".join(c.as_buffer() for c in t.column("cells").take(pa.array(rows)))
            if is_hot:
                col = np.frombuffer(data, "<u8")[np.repeat(once, m)]
                df = np.full(len(col), np.iinfo(np.int32).max, np.int64)
            else:
                words = np.frombuffer(data, "<u2").reshape(-1, 3)[np.repeat(once, m)]
                col = words[:, 2].astype(np.uint64)
                for w in (1, 0):
                    col <<= np.uint64(16)
                    col |= words[:, w]
                del words
                _, where, df = np.unique(col, return_inverse=True, return_counts=True)
                df = df[where]
                col |= np.uint64(key[0].as_py() & 0xFFFF) << np.uint64(48)
            more = df > 1
            own.append(np.repeat(np.arange(int(once.sum())), m[once])[more] + docs)
            cols.append(col[more].view(np.int64))
            dfs.append(df[more].astype(np.int32))
            keys.append(key_of[once])
            docs += int(once.sum())
        keys = np.concatenate(keys)
        own, cols, dfs = (np.concatenate(x) for x in (own, cols, dfs))
        dest = (keys[own].view(np.uint64) % np.uint64(n_dest)).astype(np.int64)
        order = np.lexsort((own, dest))
        own, cols, dfs, dest = own[order], cols[order], dfs[order], dest[order]
        doc = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        m = np.diff(np.concatenate([doc, [len(own)]])) if len(own) else np.zeros(0, np.int64)
        dests, first_doc = np.unique(dest[doc], return_index=True)
        doc_cut = np.concatenate([first_doc, [len(doc)]]).astype(np.int32)
        cell_cut = np.concatenate([doc, [len(own)]])[doc_cut].astype(np.int32)
        lists = lambda cut, x, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(kind)))
        return pa.table(
            {
                "dest": pa.array(dests.astype(np.int32)),
                "key": lists(doc_cut, keys[own[doc]], np.int64),
                "m": lists(doc_cut, m, np.int32),
                "cols": lists(cell_cut, cols, np.int64),
                "df": lists(cell_cut, dfs, np.int32),
            }
        )

    return run


def _whole_rows(num: int, den: int, parts: int):
    """For a destination and the sizes of its documents: documents whose shared columns reach the least overlap their size asks for.

    A document gives a row for each block of the product where it has columns; ``s`` is the
    number of its shared columns. The first of these rows, ``lead``, also has as ``head`` those of
    its columns, from rare to frequent, of which a linked document must have one.
    """

    def run(table: pa.Table, sizes: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0, np.int64)
        keys, m = flat("key"), flat("m")
        which, doc = np.unique(keys, return_inverse=True)
        shared = np.bincount(doc, weights=m, minlength=len(which)).astype(np.int64)
        known, n = (sizes.column(c).to_numpy() for c in ("key", "n"))
        by_key = np.argsort(known)
        size = n[by_key][np.searchsorted(known[by_key], which)]
        kept = shared * den >= size * num
        cell_doc = np.repeat(doc, m)
        here = kept[cell_doc]
        cols, df, cell_doc = flat("cols")[here], flat("df")[here], cell_doc[here]
        order = np.lexsort((cols, df, cell_doc))
        cols, cell_doc = cols[order], cell_doc[order]
        rank = np.arange(len(cols)) - (np.cumsum(shared * kept) - shared * kept)[cell_doc]
        most = (shared - -(-size * num // den) + 1)[cell_doc]
        in_head = rank < most
        head_ends = np.concatenate([[0], np.cumsum(np.bincount(cell_doc[in_head], minlength=len(which)))])
        heads = cols[in_head]
        part = (cols.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by_part = np.lexsort((part, cell_doc))
        cols, cell_doc, part = cols[by_part], cell_doc[by_part], part[by_part]
        start = np.flatnonzero(np.concatenate([[True], (cell_doc[1:] != cell_doc[:-1]) | (part[1:] != part[:-1])])) if len(cols) else np.zeros(0, np.int64)
        d = cell_doc[start]
        lead = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
        head_sizes = np.where(lead, np.diff(head_ends)[d], 0) if len(d) else np.zeros(0, np.int64)
        return pa.table(
            {
                "key": pa.array(which[d]),
                "n": pa.array(size[d]),
                "s": pa.array(shared[d]),
                "lead": pa.array(lead),
                "head": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(head_sizes)]).astype(np.int32)), pa.array(heads)),
                "part": pa.array(part[start].astype(np.int32)),
                "cols": pa.ListArray.from_arrays(pa.array(np.append(start, len(cols)).astype(np.int32)), pa.array(cols)),
            }
        )

    return run


ROWS = "key long, n long, s long, lead boolean, head array<long>, part int, cols array<long>"


def jaccard_components(
    docs: DataFrame,
    k: int = 4,
    num: int = 85,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_cells: int = BLOCK_CELLS,
    row_col: str | None = None,
) -> DataFrame:
    """(id, ``n_shingles``, ``class_id``, ``class_size``, ``component_id``) for every row.

    Two documents link when ``den * intersection >= num * union`` of their sets of distinct
    ``k``-word shingles (see ``shingles``). ``class_id`` is the smallest id with the same
    set, ``component_id`` the smallest id reachable over links. Null, blank and empty texts
    have no shingles and are alone, each its own class. Repeated rows share a class; rows
    that repeat an id with another text are each compared, under that id. An empty table gives no rows;
    other columns are not read. ``num / den`` must be over one half. With ``row_col``, a long
    that tells rows with one id apart, that column and ``first`` (``no_id``, ``id``, ``row``) are added:
    the component's smallest row, nulls of the id last; null for rows without shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = scratch.write(set_table(docs, id_col, text_col, k, row_col), "sets")
    more = ["row"] if row_col else []
    sets = rows.where("NOT `column`").select("id", "key", "n", *more)
    first = [F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")] if row_col else []
    classes = scratch.write(
        sets.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), *first), "classes"
    )
    cells, longest, n_sets = classes.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    cells, longest = cells or 0, longest or 0
    n_blocks = max(1, -(-cells // block_cells))
    often = rows.where("`column`").groupBy("key").agg(F.sum("n").alias("hits")).where(F.col("hits") > HEAVY_SHARE * n_sets)
    heavy_cols = [r[0] for r in often.select("key").collect()]
    big = classes.orderBy(F.desc("class_size"), "key").limit(HEAVY_GROUPS).where("class_size > 2").collect()
    heavy_sets = {r["key"]: r["class_id"] for r in big}

    parts = int(max(1, -(-cells // max(1, n_sets) // ROW_CELLS), -(-longest // LONGEST_CELLS)))
    n_dest = 1 + n_blocks // 2
    # like numpy's remainder of the unsigned key, which the blocks deal by
    dest = F.expr(f"CAST(pmod(pmod(shiftrightunsigned(key, 1), {n_dest}) * 2 + (key & 1), {n_dest}) AS INT)")
    sizes = classes.select(dest.alias("dest"), "key", "n").groupBy("dest")
    alive = (
        _incidence(docs, id_col, text_col, k, n_blocks, heavy_cols, heavy_sets)
        .groupBy("block")
        .applyInArrow(_shared_cells(n_dest), PACKED)
        .groupBy("dest")
        .cogroup(sizes)
        .applyInArrow(_whole_rows(num, den, parts), ROWS)
    )
    alive = scratch.write(alive, "rows")
    labels = _link(alive, num, den, scratch)

    joined = classes.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    roots = joined.groupBy("comp").agg(F.min("class_id").alias("component_id"), *[F.min("first").alias("least") for _ in more])
    firsts = [F.col("least").alias("first") for _ in more]
    classes = joined.join(roots, "comp").select("key", "n", "class_id", "class_size", "component_id", *firsts)
    out = sets.join(classes, ["key", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("component_id", "id").alias("component_id"),
        *[c for _ in more for c in (F.col("row").alias(row_col), F.col("first"))],
    )
    out = scratch.write(out, "result", keep=True)
    scratch.clear()
    return out


def _link(alive: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(key, comp) of the rows that link with another."""
    ahead = alive.where("lead").select("key", "n", "s", "head")
    entries = ahead.select("key", "n", "s", F.posexplode("head").alias("pos", "col"))
    entries = scratch.write(_can_link(entries, num, den), "prefixes")

    # every row meets the leader of each of its columns; what they share bounds what others can share with the row
    heads = entries.groupBy("col").agg(F.max_by("key", F.struct(F.col("s") / F.col("n"), "key")).alias("lead"))
    entries = entries.join(heads, "col")
    pairs = entries.where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct()
    tested = [scratch.write(_products(pairs, alive, num, den), "products")]
    labels = _joined_labels(None, tested[0], scratch)
    met = tested[0].select(F.col("a").alias("key"), F.col("b").alias("lead"), "overlap")
    home = met.groupBy("key").agg(F.max_by(F.struct("lead", "overlap"), F.struct("overlap", "lead")).alias("home"))
    entries = entries.join(met, ["key", "lead"], "left").join(home, "key", "left")
    entries = entries.select(
        "key", "n", "s", "col", "pos", "c",
        F.coalesce("overlap", "s").alias("o"),
        F.coalesce("home.lead", "key").alias("home"),
        F.coalesce("home.overlap", "s").alias("h"),
    )
    entries = scratch.write(entries, "entries")

    for r in range(1, LEADER_ROUNDS + 1):
        at = _labelled(entries, labels)
        ends = at.groupBy("col").agg(
            F.max_by(F.struct(*_MEMBER, "comp"), F.struct(F.xxhash64("key", F.lit(r)), "key")).alias("y"),
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            F.min("n").alias("least_n"),
            F.max(F.col("s") - F.col("o")).alias("rest"),
        ).where("lo <> hi")
        met = at.join(ends, "col").where(_open_entry(num, den))
        if r < LEADER_ROUNDS:
            pairs = met.where("comp <> y.comp").select(F.struct(*_MEMBER).alias("x"), "y").where(_may_link(F.col("x"), F.col("y"), num, den))
        else:
            pairs = _open_pairs(met.join(ahead.select("key", "head"), "key"), num, den)
        pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
        # all pairs tested so far go in one join, so a pair passes once a round, not once for each round before
        before = [t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for t in tested]
        pairs = pairs.join(reduce(DataFrame.unionByName, before), ["a", "b"], "left_anti")
        tested.append(scratch.write(_products(pairs, alive, num, den), "products"))
        labels = _joined_labels(labels, tested[-1], scratch)
    if labels is None:
        return alive.sparkSession.createDataFrame([], "key long, comp long")
    return labels


_MEMBER = ("key", "n", "s", "o", "home", "h")


def _products(pairs: DataFrame, alive: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, overlap, linked): the entries of the product at the pairs.

    A block multiplies its columns of both rows; the partial overlaps are summed over blocks.
    """
    x = alive.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "part", F.col("cols").alias("cols_a"))
    y = alive.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "part", F.col("cols").alias("cols_b"))
    both = pairs.join(x, "a").join(y, ["b", "part"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("cols_a", "cols_b")).cast("long").alias("partial"))
    whole = partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return whole.select("a", "b", "overlap", (den * F.col("overlap") >= num * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("linked"))


def _joined_labels(labels: DataFrame | None, seen: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Components after the links in ``seen``."""
    links = seen.where("linked").select("a", "b")
    if not links.limit(1).count():
        return labels
    if labels is None:
        return scratch.write(connected_components(links, scratch).select(F.col("node").alias("key"), "comp"), "components")
    ends = links.join(labels.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a", "left").join(
        labels.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b", "left"
    )
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    if not between.limit(1).count():
        return labels
    roots = connected_components(between, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    moved = labels.join(roots, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
    fresh = roots.join(labels.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("key"), F.col("root").alias("comp"))
    return scratch.write(moved.unionByName(fresh), "components")


def _open_entry(num: int, den: int) -> str:
    """Whether a row can still link with any row of its column: it shares at most ``o`` columns by way of the leader, and ``rest`` beside it."""
    return f"(o + least(s - o, rest)) * {num + den} >= (n + least_n) * {num}"


def _may_link(x: Column, y: Column, num: int, den: int) -> Column:
    """Upper bounds of an overlap, by size, by shared columns, and by what both share with the column's or a common leader."""
    n, m = x["n"], y["n"]
    need = (n + m) * num
    by_column = F.least(x["o"], y["o"]) + F.least(x["s"] - x["o"], y["s"] - y["o"])
    by_home = F.least(x["h"], y["h"]) + F.least(x["s"] - x["h"], y["s"] - y["h"])
    return (
        (F.least(n, m) * den >= F.greatest(n, m) * num)
        & (F.least(x["s"], y["s"]) * (num + den) >= need)
        & (by_column * (num + den) >= need)
        & ((x["home"] != y["home"]) | (by_home * (num + den) >= need))
    )


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("comp", F.col("key"))
    return entries.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _can_link(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries without those whose row cannot link with the column's smallest row, so with none in it; columns of one go."""
    cols = entries.groupBy("col").agg(F.min("n").alias("least_n"), F.count("*").alias("c")).where("c > 1")
    kept = entries.join(cols, "col").where(f"s * {num + den} >= (n + least_n) * {num}").drop("least_n", "c")
    cols = kept.groupBy("col").agg(F.count("*").alias("c")).where("c > 1")
    return kept.join(cols, "col")


def _open_pairs(at: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): all pairs of a column that are in different components and may link, by pairs of bounded chunks of them.

    A pair is made in the first column that both rows have: the columns ahead of it
    (``before``) are not shared. Two rows that can link are in all their common columns here,
    as every bound by which an entry was left out holds for both. Dealing a large column's rows
    by a second shared column was tried and dropped: like rows share them all, so rows multiply.
    """
    part = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.expr(f"c DIV {CHUNK}")))
    before = F.slice("head", F.lit(1), F.col("pos"))
    rows = at.select("col", part.alias("part"), *_MEMBER, "comp", before.alias("before"))
    chunks = rows.groupBy("col", "part").agg(F.collect_list(F.struct(*_MEMBER, "comp", "before")).alias("xs"))
    right = chunks.select("col", F.col("part").alias("part_2"), F.col("xs").alias("ys"))
    met = chunks.join(right, "col").where("part <= part_2")

    def partners(x: Column) -> Column:
        fits = F.filter(
            "ys", lambda y: (x["comp"] != y["comp"]) & _may_link(x, y, num, den) & ~F.arrays_overlap(x["before"], y["before"])
        )
        return F.transform(fits, lambda y: F.struct(F.struct(x["key"].alias("key")).alias("x"), F.struct(y["key"].alias("key")).alias("y")))

    return met.select(F.explode(F.flatten(F.transform("xs", partners))).alias("p")).select("p.x", "p.y")
