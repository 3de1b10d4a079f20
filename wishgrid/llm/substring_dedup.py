"""Removal of long byte strings that occur more than once, by hash-compared suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.llm.common import send_package, written

#: Bytes of a repeated string that is removed, and of the anchors by which its copies find each other.
LENGTH, ANCHOR = 200, 64
REACH = LENGTH - ANCHOR
#: Different contexts of one anchor that are sorted in one place; of more, all windows are counted by hash.
TOGETHER = 20_000
#: Contexts sorted at once.
BATCH = 16_384

_BASES = [int(b) | 1 for b in np.random.default_rng(44).integers(1, 2**63, 2, np.uint64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all prefixes, along the last axis, scaled so that differences compare."""
    n = data.shape[-1]
    if which not in _powers or len(_powers[which][0]) < n + 1:
        size = max(4096, 2 * n)
        up, down = np.full(size, _BASES[which], np.uint64), np.full(size, pow(_BASES[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    out = np.zeros((*data.shape[:-1], n + 1), np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[which][0][:n], axis=-1, out=out[..., 1:])
    return out


def string_hashes(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[start:end] for arrays of starts and ends."""
    value = (prefix[end] - prefix[start]) * _powers[which][1][start]
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def _slide(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every run of ``width``, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and context hashes of the anchors of one document.

    An anchor is an ANCHOR-byte string whose hash is the least in some LENGTH-byte window: it depends on the window
    alone, so all copies of a window choose the same. The context is what any window over the anchor can cover.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    starts = np.arange(n - ANCHOR + 1)
    hashes = string_hashes(prefix, starts, starts + ANCHOR)
    least = _slide(hashes, REACH + 1, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    highest = _slide(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    at = np.flatnonzero(highest == hashes)
    low, high = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, n)
    other = prefix_hashes(data, 1)
    context = string_hashes(other, low, high, 1) ^ ((at - low).astype(np.uint64) * _MIX + (high - at).astype(np.uint64))
    return at, hashes[at], context


def merge_sorted(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, keys), and how far each row agrees with the one before it (-1: another group).

    Mergesort of all rows at once: every row seeks its place in the sibling run by binary search, and two rows are
    compared by the extension they have in common, itself found by binary search over prefix hashes. Neighbours are
    checked on the values afterwards; should a hash have lied, the values are sorted instead.
    """
    rows, width = keys.shape
    prefix = prefix_hashes(keys)
    ended = np.concatenate([keys, np.full((rows, 1), -1, keys.dtype)], axis=1)

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.full(len(i), width, np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = prefix[i, mid] == prefix[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> np.ndarray:
        at = extension(i, j)
        a, b = ended[i, at], ended[j, at]
        inside = (a < b) | ((a == b) & equal)
        return (group[i] < group[j]) | ((group[i] == group[j]) & inside)

    order, run, place = np.arange(rows), 1, np.arange(rows)
    while run < rows:
        own = place // run
        pair = (own >> 1) * (2 * run)
        low = np.minimum((own ^ 1) * run, rows)
        first, high = low.copy(), np.minimum(low + run, rows)
        is_right = (own & 1) == 1
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) >> 1
            less = before(order[mid], order[at], is_right[at])
            low[at] = np.where(less, mid + 1, low[at])
            high[at] = np.where(less, high[at], mid)
        target = pair + (place - own * run) + (low - first)
        merged = np.empty_like(order)
        merged[target] = order
        order, run = merged, 2 * run
    for attempt in range(2):
        a, b = keys[order[:-1]], keys[order[1:]]
        differs = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
        agree = differs.argmax(axis=1)
        one = group[order[:-1]] == group[order[1:]]
        wrong = one & (ended[order[:-1], agree] > ended[order[1:], agree])
        if attempt or not wrong.any():
            break
        order = np.lexsort([*keys.T[::-1], group])
    return order, np.append(-1, np.where(one, agree, -1))


def repeated_reach(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (rows of bytes, anchor from REACH on) the farthest and nearest start of a window that repeats.

    A window starting ``a`` bytes before the anchor repeats if another context of the group agrees with it on ``a``
    bytes to the left and REACH - a to the right. Contexts are sorted by what follows the anchor and by what stands
    before it, read backwards; with the common extensions of neighbours, classes of equal sides are running counts.
    -1 where no window repeats. ``left`` and ``right`` are the bytes that the document has on either side.
    """
    rows = len(group)
    span = np.arange(REACH)
    after = np.where(span < right[:, None], context[:, LENGTH:].astype(np.int16), -1)
    ahead = np.where(span < left[:, None], context[:, :REACH][:, ::-1].astype(np.int16), -1)
    anchor = np.unique(context[:, REACH:LENGTH].copy().view(f"V{ANCHOR}").ravel(), return_inverse=True)[1]
    group = group * (anchor.max() + 1 if rows else 1) + anchor  # equal hashes of unequal anchors part here
    (by_after, agree_after), (by_ahead, agree_ahead) = merge_sorted(group, after), merge_sorted(group, ahead)
    far, near = np.full(rows, -1), np.full(rows, -1)
    class_after, class_ahead = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for a in range(REACH, -1, -1):
        fits = (left >= a) & (right >= REACH - a)
        if fits.sum() < 2:
            continue
        class_after[by_after] = np.cumsum((agree_after < REACH - a) | (agree_after < 0))
        class_ahead[by_ahead] = np.cumsum((agree_ahead < a) | (agree_ahead < 0))
        at = np.flatnonzero(fits)
        both = class_after[at] * (rows + 1) + class_ahead[at]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        hit = at[order[np.append(same, False) | np.append(False, same)]]
        far[hit] = np.maximum(far[hit], a)
        near[hit] = a
    return far, near


def repeated_strings(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """documents(doc_id, text) -> d (hash of id and text), start, end: intervals of bytes that repeated strings cover.

    Every LENGTH-byte string that starts at two places (in different documents, rows or places of one) has an anchor
    there, the same in both. Anchors are counted by hash with map-side sums; those seen once are gone. Where all
    contexts of an anchor are equal, or a context is seen twice, its windows all repeat. What is left, contexts that
    differ from all others of their anchor (the ends of repeated passages), is fetched as bytes and suffix-sorted,
    anchor by anchor; an anchor with more than ``together`` contexts has the windows of its contexts counted by hash
    and place instead, in all tasks. Intervals may overlap.
    """
    send_package(docs.sparkSession)
    base = docs.select(F.xxhash64("doc_id", "text").alias("d"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b")).where(F.length("b") >= LENGTH)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                p, h, c, many = [], [], [], []
                for text in some.column(1):
                    at, own, context = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                    p.append(at)
                    h.append(own)
                    c.append(context)
                    many.append(len(at))
                d = np.repeat(some.column(0).to_numpy(), many)
                columns = [d, np.concatenate(p).astype(np.int32), np.concatenate(h).view(np.int64), np.concatenate(c).view(np.int64)]
                yield pa.record_batch([pa.array(x) for x in columns], ["d", "p", "h", "c"])

    every = written(base.mapInArrow(found, "d long, p int, h long, c long"), "anchors")
    several = every.groupBy("h").agg(F.count("*").alias("rows"), F.min("c").alias("low"), F.max("c").alias("high")).where("rows > 1")
    kept = written(every.join(several.select("h", (F.col("low") == F.col("high")).alias("equal")), "h"), "repeated")
    mixed = kept.where("NOT equal").groupBy("h", "c").agg(F.count("*").alias("rows"), F.min(F.struct("d", "p")).alias("one"))
    mixed = written(mixed.select("h", "c", "rows", "one.d", "one.p"), "mixed")
    whole = kept.where("equal").select("d", "p").union(kept.join(mixed.where("rows > 1").select("h", "c"), ["h", "c"]).select("d", "p"))
    sizes = mixed.groupBy("h").agg(F.count("*").alias("contexts"), F.min("rows").alias("fewest")).where("fewest = 1")
    wanted = mixed.join(sizes, "h").groupBy("d").agg(F.collect_list(F.struct("h", "p", "rows", "contexts")).alias("w"))
    fetched = base.mapInArrow(_packed, "d long, z binary").join(wanted, "d")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for d, z, want in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    text = undo.decompress(z)
                    for w in want:
                        p = w["p"]
                        low, high = max(0, p - REACH), min(len(text), p + LENGTH)
                        context = bytes(REACH - (p - low)) + text[low:high] + bytes(p + LENGTH - high)
                        rows.append((w["h"], w["contexts"], d, p, w["rows"] == 1, p - low, high - p - ANCHOR, context))
                yield pa.record_batch(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))],
                    ["h", "contexts", "d", "p", "single", "left", "right", "context"],
                )

    contexts = fetched.mapInArrow(cut, "h long, contexts long, d long, p int, single boolean, left int, right int, context binary")
    contexts = written(contexts, "contexts")
    small = contexts.where(f"contexts <= {together}").drop("contexts").repartition("h").sortWithinPartitions("h")
    edges = small.mapInArrow(_compared, "d long, start long, end long")
    crowd = contexts.where(f"contexts > {together}")
    if crowd.limit(1).count():
        windows = written(crowd.select("h", "d", "p", "single", "left", "right", "context").mapInArrow(_windows, "h long, d long, start long, single boolean, w long, v long"), "windows")
        # A window over two anchors of one hash is listed for each: only different places count.
        place = F.xxhash64("d", "start")
        again = windows.groupBy("h", "w", "v").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("h", "w", "v")
        hits = windows.where("single").join(again, ["h", "w", "v"])
        edges = edges.union(hits.select("d", "start", (F.col("start") + LENGTH).alias("end")))
    reach = whole.select("d", F.greatest(F.col("p") - REACH, F.lit(0)).cast("long").alias("start"), (F.col("p") + LENGTH).cast("long").alias("end"))
    return reach.union(edges)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([press.compress(t.as_buffer()) for t in batch.column(1)], pa.binary())], ["d", "z"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows over the anchor of each context, by two hashes."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out: list[list] = [[] for _ in range(6)]
            for h, d, p, single, left, right, context in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                data = np.frombuffer(context, np.uint8)
                start = np.arange(REACH - left, right + 1)
                w, v = (string_hashes(prefix_hashes(data, i), start, start + LENGTH, i).view(np.int64) for i in (0, 1))
                n = len(start)
                for column, value in zip(out, (np.full(n, h), np.full(n, d), start + p - REACH, np.full(n, single), w, v), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["h", "d", "start", "single", "w", "v"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of h; whole anchors are compared, about BATCH contexts at a time."""

    def told(table: pa.Table) -> pa.RecordBatch:
        get = {c: table.column(c).to_numpy() for c in ("h", "d", "p", "single", "left", "right")}
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(len(table), REACH + LENGTH)
        group = np.cumsum(np.append(0, get["h"][1:] != get["h"][:-1]))
        far, near = repeated_reach(group, context, get["left"], get["right"])
        use = get["single"] & (far >= 0)
        p = get["p"][use].astype(np.int64)
        return pa.record_batch([pa.array(get["d"][use]), pa.array(p - far[use]), pa.array(p + LENGTH - near[use])], ["d", "start", "end"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield told(table.slice(0, last).combine_chunks())
                held = table.slice(last).combine_chunks().to_batches()
            else:
                held = table.to_batches()
    if held:
        yield told(pa.Table.from_batches(held).combine_chunks())


def remove_repeats(docs: DataFrame, together: int = TOGETHER, with_text: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    Removed is each byte of the UTF-8 text inside a LENGTH-byte string that also starts anywhere else, judged on the
    input; matches do not cross documents. Null texts are empty; one row per row of ``docs``; repeated rows remove
    each other, texts shorter than LENGTH keep all. Other columns are not read.
    """
    spans = repeated_strings(docs, together).distinct().groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = written(spans, "spans")
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("d"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = own.select("d", "b", "doc_id").mapInArrow(_packed_with_id, f"d long, z binary, doc_id {kind}").join(spans, "d", "left").select("doc_id", "z", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some, rows = batch.slice(k, 512), []
                for z, spans in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    text, kept, at, gone, runs, end = undo.decompress(z), [], 0, 0, 0, -1
                    for s in spans or ():
                        low, high = max(s["start"], at), min(s["end"], len(text))
                        if high <= low:
                            continue
                        if low > end:
                            runs += 1
                        kept.append(text[at:low])
                        gone, at, end = gone + high - low, high, high
                    kept.append(text[at:])
                    left = b"".join(kept)
                    rows.append((len(text), gone, runs, hashlib.sha256(left).hexdigest(), left))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_text]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", *names])

    return sent.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _packed_with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = next(_packed(iter([pa.RecordBatch.from_arrays(batch.columns[:2], ["d", "b"])])))
        yield pa.RecordBatch.from_arrays([*packed.columns, batch.column(2)], ["d", "z", "doc_id"])
