"""Removal of repeated byte strings by sorting suffixes, deep-shallow style.

Every window of ``LENGTH`` bytes belongs to an anchor: the ``GRAM``-byte string in it whose hash is
smallest. Equal windows have equal anchors at the same place, so only windows of one anchor need be
sorted against each other. Consecutive windows with one anchor form a run. Runs that are equal as a
whole are settled by their hashes: all but the earliest repeat. What remains are runs whose anchor
occurs with different surroundings, at the ends of repeated passages. Their windows are sorted:
multikey quicksort by eight-byte words down to a shallow depth, then a blind trie for each group
that is still tied, whose leaves are the classes of equal windows.

Anchors that occur in many surroundings within one slice of the input are hot: their windows are
dealt by their own hash instead of by anchor, after repeats within the slice are taken out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import plain_bytes, slices
from cliptide.operators.exact import settled

LENGTH = 100
GRAM = 24
SPREAD = LENGTH - GRAM + 1
SLICE_BYTES = 2 << 20
#: Surroundings of one anchor in a slice from which on it is hot.
HOT = 8
SHALLOW_WORDS = 6
WINDOWS_AT_ONCE = 200_000
BUCKET_BYTES = 16 << 20

_rng = np.random.default_rng(19991231)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = int(_rng.integers(0, 1 << 62)) * 2 + 1
_INVERSE = pow(_RADIX, -1, 1 << 64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(of: int, count: int) -> np.ndarray:
    table = np.full(count, of, np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of a byte array, from prefix sums modulo 2 ** 64."""

    def __init__(self, cells: np.ndarray):
        self.sums = np.zeros(len(cells) + 1, np.uint64)
        np.cumsum(_BYTES[cells] * _powers(_RADIX, len(cells)), out=self.sums[1:])
        self.down = _powers(_INVERSE, len(cells) + 1)

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))


def runs(cells: np.ndarray, limits: np.ndarray, hashes: Hashes):
    """(anchor hash of 48 bits, run hash, first window, windows) of the texts between ``limits``."""
    empty = np.empty(0, np.int64)
    if len(cells) < LENGTH:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    grams = _scramble((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.down[: len(cells) - GRAM + 1] + np.uint64(GRAM))
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPREAD - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    sizes = np.diff(limits)
    inside = np.zeros(len(cells) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, limits[:-1][long], 1)
    np.add.at(inside, limits[1:][long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(windows):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    anchor = (least[windows] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(windows) != 1)]))
    start, count = windows[first], np.diff(np.append(first, len(windows)))
    at = anchor[first]
    whole = _scramble(hashes.of(start, start + count - 1 + LENGTH) + (at - start).astype(np.uint64))
    return grams[at] >> np.uint64(16), whole, start, count


def repeats(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray):
    """Order by keys, then (doc, at); which are the first of their keys, and which come strictly later."""
    order = np.lexsort((at, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[head]) | (at[order] != at[head])
    first = np.zeros(len(order), bool)
    first[order] = new
    return first, later


def _surroundings(anchor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, how many first rows have its anchor."""
    names, place = np.unique(anchor, return_inverse=True)
    return np.bincount(place[first], minlength=len(names))[place] if len(names) else np.empty(0, np.int64)


ANCHOR = np.dtype([("anchor", "u8"), ("whole", "u8"), ("doc", "i8"), ("at", "i4"), ("n", "u1"), ("hot", "u1")])
RUN = np.dtype([("anchor", "i8"), ("doc", "i8"), ("at", "i4"), ("n", "i4"), ("kind", "u1")])
REPEAT, COLD, WARM = 0, 1, 2


def pack(rows: np.ndarray) -> bytes:
    """Column by column, anchors in six bytes and documents as small offsets where that is possible."""
    base = int(rows["doc"].min())
    far = int(rows["doc"].max()) - base >= 1 << 32
    docs = (rows["doc"] - base).astype("i8" if far else "u4")
    parts = [np.array([len(rows), base, far], np.int64).tobytes(), np.ascontiguousarray(rows["anchor"]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()]
    return b"".join(parts + [np.ascontiguousarray(x).tobytes() for x in (rows["whole"], docs, rows["at"], rows["n"], rows["hot"])])


def unpack(value: bytes) -> np.ndarray:
    n, base, far = np.frombuffer(value, np.int64, 3).tolist()
    rows, at = np.zeros(n, ANCHOR), 24
    anchors = np.zeros((n, 8), np.uint8)
    anchors[:, :6] = np.frombuffer(value, np.uint8, 6 * n, at).reshape(n, 6)
    rows["anchor"] = anchors.view(np.uint64).ravel()
    at += 6 * n
    for name, kind in (("whole", np.uint64), ("doc", np.int64 if far else np.uint32), ("at", np.int32), ("n", np.uint8), ("hot", np.uint8)):
        column = np.frombuffer(value, kind, n, at)
        rows[name] = column.astype(np.int64) + base if name == "doc" else column
        at += column.nbytes
    return rows


def _pieces(ids: list, texts: list[bytes | None]):
    """Texts in pieces of at most about a slice that overlap by a window, with where each begins."""
    for doc, text in zip(ids, texts):
        if doc is not None and text is not None and len(text) >= LENGTH:
            for begin in range(0, len(text) - LENGTH + 1, SLICE_BYTES):
                yield doc, begin, text[begin : begin + SLICE_BYTES + LENGTH - 1]


def _joined(ids, texts):
    """Groups of pieces of about ``SLICE_BYTES`` together: (bytes, limits, docs, begins)."""
    group, size = [], 0
    for piece in _pieces(ids, texts):
        if group and size + len(piece[2]) > SLICE_BYTES:
            yield _group(group)
            group, size = [], 0
        group.append(piece)
        size += len(piece[2])
    if group:
        yield _group(group)


def _group(group):
    cells = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    limits = np.cumsum([0] + [len(p[2]) for p in group])
    return cells, limits, np.array([p[0] for p in group], np.int64), np.array([p[1] for p in group], np.int64)


def _anchors(buckets: int):
    """Rows (bucket, kind, payload): first runs of a slice by anchor; repeats and hot runs as they are."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                for cells, limits, docs, begins in _joined(part.column(0).to_pylist(), plain_bytes(part.column(1))):
                    anchor, whole, at, n = runs(cells, limits, Hashes(cells))
                    if not len(at):
                        continue
                    place = np.searchsorted(limits, at, "right") - 1
                    rows = np.zeros(len(at), ANCHOR)
                    rows["anchor"], rows["whole"], rows["doc"], rows["n"] = anchor, whole, docs[place], n
                    rows["at"] = at - limits[place] + begins[place]
                    first, later = repeats([rows["anchor"], rows["whole"]], rows["doc"], rows["at"])
                    hot = _surroundings(rows["anchor"], first) >= HOT
                    direct = np.zeros(int((later | (first & hot)).sum()), RUN)
                    source = rows[later | (first & hot)]
                    for name in ("doc", "at", "n"):
                        direct[name] = source[name]
                    direct["anchor"] = source["anchor"].astype(np.int64)
                    direct["kind"] = np.where(later[later | (first & hot)], REPEAT, WARM)
                    cold = rows[first & ~hot]
                    marks = rows[first & hot]
                    marks = marks[np.unique(marks["anchor"], return_index=True)[1]]
                    marks["hot"] = 1
                    sent = np.concatenate([cold, marks])
                    to = (sent["anchor"] % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    sent, to = sent[order], to[order]
                    cuts = np.flatnonzero(np.diff(to)) + 1
                    groups = np.split(sent, cuts) if len(sent) else []
                    names = to[np.concatenate([[0], cuts])].tolist() if len(sent) else []
                    payloads, kinds = [pack(g) for g in groups], [0] * len(groups)
                    if len(direct):
                        payloads.append(direct.tobytes())
                        kinds.append(1)
                        names.append(int(direct["doc"][0]) % buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "kind", "payload"])

    return run


RUN_FIELDS = "doc_id long, at int, n int, kind int, anchor long"


def _run_frame(rows: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"doc_id": rows["doc"], "at": rows["at"], "n": rows["n"].astype(np.int32), "kind": rows["kind"].astype(np.int32), "anchor": rows["anchor"]})


def _settle(pdf):
    """The runs of one bucket: repeats, and those whose windows have to be sorted."""
    direct = [np.frombuffer(p, RUN) for p in pdf.payload[pdf.kind == 1]]
    packed = [unpack(p) for p in pdf.payload[pdf.kind == 0]]
    if packed:
        rows = np.concatenate(packed)
        marked = rows["hot"] == 1
        warm = np.isin(rows["anchor"], rows["anchor"][marked])
        rows, warm = rows[~marked], warm[~marked]
        first, later = repeats([rows["anchor"], rows["whole"]], rows["doc"], rows["at"])
        mixed = first & (warm | (_surroundings(rows["anchor"], first) > 1))
        chosen = later | mixed
        out = np.zeros(int(chosen.sum()), RUN)
        for name in ("doc", "at", "n"):
            out[name] = rows[name][chosen]
        out["anchor"] = rows["anchor"][chosen].astype(np.int64)
        out["kind"] = np.where(later[chosen], REPEAT, np.where(warm[chosen], WARM, COLD))
        direct.append(out)
    return _run_frame(np.concatenate(direct) if direct else np.zeros(0, RUN))


class BlindTrie:
    """Keys of equal length as whole numbers; inner nodes know only the bit in which their keys differ."""

    def __init__(self):
        self.bits: list[int] = []
        self.below: list[list[int]] = []
        self.keys: list[int] = []
        self.root: int | None = None

    def leaf(self, key: int) -> int:
        """The number of the leaf that holds ``key``, which is put in if it is new."""
        if self.root is None:
            self.keys.append(key)
            self.root = -1
            return 0
        node = self.root
        while node >= 0:
            node = self.below[node][key >> self.bits[node] & 1]
        unlike = key ^ self.keys[-1 - node]
        if not unlike:
            return -1 - node
        bit = unlike.bit_length() - 1
        self.keys.append(key)
        leaf = -len(self.keys)
        parent, node = -1, self.root
        while node >= 0 and self.bits[node] > bit:
            parent, node = node, self.below[node][key >> self.bits[node] & 1]
        side = key >> bit & 1
        self.bits.append(bit)
        self.below.append([leaf, node] if side == 0 else [node, leaf])
        if parent < 0:
            self.root = len(self.bits) - 1
        else:
            self.below[parent][key >> self.bits[parent] & 1] = len(self.bits) - 1
        return len(self.keys) - 1


def sort_classes(windows: np.ndarray) -> np.ndarray:
    """A class number for each row of a matrix of ``LENGTH`` bytes; equal rows, and only they, share one."""
    n = len(windows)
    padded = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = windows
    words = padded.view(">u8").astype(np.uint64)
    group, tied = np.zeros(n, np.int64), np.arange(n)
    # Multikey quicksort, all groups at once: those still tied are parted by their next word.
    for depth in range(SHALLOW_WORDS):
        if not len(tied):
            break
        order = np.lexsort((words[tied, depth], group[tied]))
        tied = tied[order]
        g, w = group[tied], words[tied, depth]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tied)))
        group[tied] = n * (depth + 1) + np.cumsum(new)
        tied = tied[np.repeat(size > 1, size)]
    classes = -1 - np.arange(n)
    if len(tied):
        size = 8 * (words.shape[1] - SHALLOW_WORDS)
        rest, members = padded[tied, 8 * SHALLOW_WORDS :].tobytes(), tied.tolist()
        cuts = [0, *(np.flatnonzero(np.diff(group[tied])) + 1).tolist(), len(members)]
        named = []
        for start, stop in zip(cuts[:-1], cuts[1:]):
            trie, firsts = BlindTrie(), []
            for i in range(start, stop):
                leaf = trie.leaf(int.from_bytes(rest[i * size : (i + 1) * size], "big"))
                if leaf == len(firsts):
                    firsts.append(members[i])
                named.append(firsts[leaf])
        classes[tied] = named
    return classes


def _fields(column):
    """An Arrow column of lists of structs as bounds per row and one array per field."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return bounds, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


WINDOW_FIELDS = "key long, doc_id long, at int, n int, body binary"


def _bodies(batches):
    """Rows (key, doc_id, at, n, body) of the runs to sort; hot ones window by window, repeats without body."""
    import pyarrow as pa

    names, kinds = ["key", "doc_id", "at", "n", "body"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            part = batch.slice(start, stop - start)
            bounds, runs_ = _fields(part.column(2))
            if not bounds[-1]:
                continue
            doc = np.repeat(part.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.diff(bounds))
            at, n = runs_["at"].astype(np.int64), runs_["n"].astype(np.int64)
            texts = plain_bytes(part.column(1))
            bodies = []
            for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
                bodies += [text[i : i + m - 1 + LENGTH] for i, m in zip(at[a:b].tolist(), n[a:b].tolist())]
            cold = np.flatnonzero(runs_["kind"] == COLD)
            yield pa.RecordBatch.from_arrays([
                pa.array(runs_["anchor"][cold]), pa.array(doc[cold]), pa.array(at[cold], pa.int32()), pa.array(n[cold], pa.int32()),
                pa.array([bodies[i] for i in cold.tolist()], pa.binary()),
            ], names)
            hot = np.flatnonzero(runs_["kind"] == WARM)
            if len(hot):
                yield from _hot_windows([bodies[i] for i in hot.tolist()], doc[hot], at[hot], n[hot], runs_["anchor"][hot], names, kinds)


def _hot_windows(bodies, doc, at, n, anchor, names, kinds):
    """The windows of hot runs, dealt by their hash; those that repeat within the slice go without body."""
    import pyarrow as pa

    joined = b"".join(bodies)
    begins, within = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]]), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cells = np.repeat(begins, n) + within
    key = Hashes(np.frombuffer(joined, np.uint8)).of(cells, cells + LENGTH).view(np.int64)
    doc, at = np.repeat(doc, n), np.repeat(at, n) + within
    first, later = repeats([key, np.repeat(anchor, n)], doc, at)
    for chosen, size in ((np.flatnonzero(first), 1), (np.flatnonzero(later), -1)):
        if len(chosen):
            parts = [joined[c : c + LENGTH] for c in cells[chosen].tolist()] if size == 1 else [b""] * len(chosen)
            columns = (key[chosen], doc[chosen], at[chosen], np.full(len(chosen), size), parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _as_runs(doc: np.ndarray, at: np.ndarray):
    """Neighbouring windows as (doc_id, at, n)."""
    import pandas as pd

    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])) if len(doc) else np.empty(0, int)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return pd.DataFrame({"doc_id": doc[first], "at": at[first].astype(np.int32), "n": (at[last] - at[first] + 1).astype(np.int32)})


def _sort_bucket(pdf):
    """Repeated windows among the runs of one bucket."""
    import pandas as pd

    done = [pdf[pdf.n == -1].assign(n=1)[["doc_id", "at", "n"]]]
    pdf = pdf[pdf.n > 0]
    # A run that is alone with its key repeats nothing: its own windows have the anchor at different places.
    pdf = pdf[pdf.key.duplicated(keep=False)].sort_values("key", kind="stable")
    total = pdf.n.cumsum().to_numpy()
    key = pdf.key.to_numpy()
    ends = np.flatnonzero(np.append(np.diff(key) != 0, True)) if len(key) else np.empty(0, int)
    at = 0
    while at < len(pdf):
        # As many whole keys as fit; at least one.
        limit = (total[at - 1] if at else 0) + WINDOWS_AT_ONCE
        fit = ends[(ends >= at) & (total[ends] <= limit)]
        stop = int(fit[-1]) + 1 if len(fit) else int(ends[ends >= at][0]) + 1
        part = pdf.iloc[at:stop]
        n = part.n.to_numpy()
        cells = np.frombuffer(b"".join(part.body), np.uint8)
        begins = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = np.lib.stride_tricks.sliding_window_view(cells, LENGTH)[np.repeat(begins, n) + within]
        doc, place = np.repeat(part.doc_id.to_numpy(), n), np.repeat(part["at"].to_numpy().astype(np.int64), n) + within
        _, later = repeats([sort_classes(windows)], doc, place)
        done.append(_as_runs(doc[later], place[later]))
        at = stop
    return pd.concat(done, ignore_index=True)


def _cut(batches, out_names):
    """Texts without the bytes that repeated windows cover."""
    import pyarrow as pa

    for batch in batches:
        for start, stop in slices(batch.column(1)):
            part = batch.slice(start, stop - start)
            rows = []
            bounds, found = _fields(part.column(2))
            every = list(zip(found["at"].tolist(), found["n"].tolist()))
            for text, first, last in zip(plain_bytes(part.column(1)), bounds[:-1], bounds[1:]):
                text = text or b""
                if first == last:
                    rows.append((len(text), 0, [], text))
                    continue
                spans: list[list[int]] = []
                for a, n in sorted(every[first:last]):
                    b = min(len(text), a + n - 1 + LENGTH)
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    elif a < b:
                        spans.append([a, b])
                edges = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), [{"start": a, "stop": b} for a, b in spans], kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            made = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["n_bytes", "n_removed", "spans", "kept"])
            yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", out_names])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cut) for each row; ``cut`` is a struct of (n_bytes, n_removed, spans, kept).

    Removed is every byte covered by a string of 100 bytes that also starts earlier: in a smaller id,
    or before it in the same document. Strings are judged on the input; overlaps count. ``spans``
    are the removed ranges, ``kept`` the remaining bytes.

    A null text is empty; texts of under 100 bytes stay whole. Rows with a null id stay whole and
    repeat nothing. Rows that share an id are read as one document: equal positions in them are the
    same place, and what repeats in one of them is removed from each. An empty table gives no rows;
    other columns are ignored. Ids are whole numbers.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    anchors = plain.mapInArrow(_anchors(buckets), "bucket int, kind int, payload binary")
    found = settled(anchors.groupBy("bucket").applyInPandas(_settle, RUN_FIELDS), "runs")
    mixed = found.filter(F.col("kind") != REPEAT).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "kind", "anchor")).alias("runs"))
    texts = plain.join(mixed, "doc_id", "left").select("doc_id", "text", "runs")
    sorted_ = (
        texts.mapInArrow(_bodies, WINDOW_FIELDS).withColumn("bucket", F.pmod(F.xxhash64("key", F.when(F.col("n") < 0, F.col("doc_id"))), F.lit(buckets)))
        .groupBy("bucket").applyInPandas(lambda pdf: _sort_bucket(pdf), "doc_id long, at int, n int")
    )
    spans = found.filter(F.col("kind") == REPEAT).select("doc_id", "at", "n").unionByName(sorted_)
    lost = spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    cut = "struct<n_bytes: long, n_removed: long, spans: array<struct<start: long, stop: long>>, kept: binary>"
    return plain.join(lost, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(lambda b: _cut(b, "cut"), f"doc_id long, cut {cut}")
