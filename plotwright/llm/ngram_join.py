"""N-gram Jaccard join: which documents reach each other over links of similarity 0.8 or more.

1. Each text becomes the set of its word shingles, as 64-bit fingerprints made with numpy. Texts of
   one set form a class; only classes are joined.
2. Fingerprints go out to buckets, packed by the task, and come back with their document frequency.
   One that no second class has cannot be in an intersection, so a class whose shared part is under
   0.8 of its set has no link and is done.
3. The rest is ordered rarest first, the same way everywhere. Classes that share a prefix
   fingerprint are candidates; candidate groups are the components of that relation.
4. Each candidate group is joined in a prefix tree: the ordered sets lie in a trie, a probe walks it
   carrying the overlap of the path so far, and leaves a subtree when what remains cannot reach the
   bound. It enters only at sets that share enough of the rarest fingerprints with it, from lists by
   fingerprint, so sets without links cost no walk. The order is the group's own, by how many of its
   sets have a fingerprint: it is the group's tree that shares paths. Groups over a size bound are split in blocks that meet pairwise, so no task holds more
   than two blocks. Only links between parts that are not yet connected are looked for.

Fingerprints travel as the number of their part and 40 bits: two different shingles are taken for
one with a chance of 2 ** -40 over the number of parts, a pair of documents of 1000 shingles each has
such a case with a chance of about 1e-6 over the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, free_name, join_hot, pack, unpack
from .components import components

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Text bytes that are hashed at once, fingerprints gathered before they are packed, fingerprints of a bucket.
CHUNK_BYTES, FLUSH, BUCKET = 1_000_000, 1_000_000, 2_000_000
#: The most classes in a chunk: their places fit in two bytes.
CHUNK_ROWS = 60_000
#: The most classes and fingerprints in one block of a candidate group.
BLOCK_ROWS, BLOCK_TOKENS = 20_000, 4_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3 on 64-bit integers."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def weights(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


PLACE = weights(SHINGLE, 77)


def text_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and text offsets of some rows at a time, CHUNK_BYTES or one text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z in lower case) and the number of words in each text."""
    n_texts = len(at) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data), bool)
    edge[at[:-1][at[:-1] < len(data)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(start)
    words = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    size = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, size)
    value = (low[where].astype(np.uint64) + U(1)) * weights(int(size.max()), 5)[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * U(0x2545F4914F6CDD1D)), np.diff(words)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text; fewer words than a shingle has make one."""
    for data, at in text_pieces(column):
        words, counts = word_hashes(data, at)
        n = len(words)
        full = np.zeros(n, np.uint64)
        if n >= SHINGLE:
            m = n - SHINGLE + 1
            for k in range(SHINGLE):
                full[:m] += words[k : k + m] * PLACE[k]
            full[:m] = mix(full[:m])
        begin = 0
        for c in counts.tolist():
            if c >= SHINGLE:
                yield np.unique(full[begin : begin + c - SHINGLE + 1])
            elif c:
                yield mix((words[begin : begin + c] * PLACE[:c]).sum(keepdims=True) + U(c))
            else:
                yield words[:0]
            begin += c


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(mix(mix(s ^ U(0x5851F42D4C957F2D)).sum(keepdims=True) + U(len(s))).view(np.int64)[0])


def classes(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles and key, the name of the document's set (null if empty); text_hash on demand."""
    more = [F.xxhash64(docs[text_col].cast("string")).alias("text_hash")] if hashed else []
    names = ["doc_id", "n_shingles", "key", *(["text_hash"] if hashed else [])]

    def rows(batches):
        for b in batches:
            n, key = [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), *b.columns[2:]], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *more).mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _spread(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the entries of each part, in order."""
    order = np.argsort(part, kind="stable")
    bound = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(bound)).tolist():
        yield p, order[bound[p] : bound[p + 1]]


def _gaps(owner: np.ndarray) -> np.ndarray:
    """Ascending small numbers as compressed steps."""
    return np.frombuffer(zstandard.compress(np.diff(owner, prepend=0).astype(np.uint16).tobytes(), 1), np.uint8)


def _owners(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(gaps.tobytes()), np.uint16), dtype=np.int64)


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _by_part(batches) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The unpacked payloads of one part after another, from rows sorted by part."""
    part, held = None, []
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(unpack(blob.as_py()))
    if held:
        yield part, held


PARTS = ["part", "payload"], [pa.int32(), pa.binary()]


def postings(docs: DataFrame, text_col: str, n_parts: int) -> DataFrame:
    """part and payload: the fingerprints of a task's classes, dealt out by their leading bits.

    A task gathers the classes it meets into chunks. A chunk sends its entries (place of the class in
    the chunk, 40 bits of the fingerprint) to the parts, and once the list of its classes.
    """

    def rows(batches):
        held: dict[int, np.ndarray] = {}
        total = 0

        def flush():
            sets = list(held.values())
            token = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            part = ((token >> U(32)) * U(n_parts) >> U(32)).astype(np.uint16 if n_parts < 65536 else np.int32)
            keys, sizes = np.fromiter(held, np.int64, len(sets)), np.fromiter(map(len, sets), np.int32, len(sets))
            # the same for a task that is run again
            chunk = mix((keys.view(np.uint64) * weights(len(keys), 9)).sum(keepdims=True)).view(np.int64)
            yield _record([(int(chunk.view(np.uint64)[0] % U(n_parts)), pack(chunk, keys, sizes))], *PARTS)
            for p, at in _spread(part, n_parts):
                t = token[at]
                yield _record([(p, pack(chunk, _gaps(owner[at]), ((t >> U(8)) & U(0xFFFFFFFF)).astype(np.uint32), (t & U(0xFF)).astype(np.uint8)))], *PARTS)

        for b in batches:
            for s in shingle_sets(b.column(0)):
                if len(s) and (key := set_key(s)) not in held:
                    held[key] = s
                    total += len(s)
                    if total >= FLUSH or len(held) == CHUNK_ROWS:
                        yield from flush()
                        held, total = {}, 0
        if held:
            yield from flush()

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(rows, "part int, payload binary")


def _shared(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Of each part the fingerprints that two entries or more have, with their number, back to their chunks.

    Chunks of the same classes in the same order have one name and one content, of which one goes on.
    A class in several other chunks counts in each: its document frequency is then too high, which
    costs a candidate, never a link.
    """

    def rows(batches):
        for part, payloads in _by_part(batches):
            once = {(len(x), int(x[0][0])): x for x in payloads}.values()
            entries = [x for x in once if len(x) == 4]
            for chunk, *rest in (x for x in once if len(x) == 3):
                yield _record([(int(chunk.view(np.uint64)[0] % U(n_parts)), pack(chunk, *rest))], *PARTS)
            if not entries:
                continue
            token = np.concatenate([(high.astype(np.uint64) << U(8)) | low for _, _, high, low in entries])
            order = np.argsort(token, kind="stable")
            ordered = token[order]
            start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            times = np.diff(np.append(start, len(ordered)))
            df = np.empty(len(token), np.int64)
            df[order] = np.repeat(times, times)
            at = 0
            for chunk, gaps, high, low in entries:
                mine = df[at : at + len(high)]
                at += len(high)
                more = mine > 1
                if more.any():
                    # one byte tells how rare a fingerprint is, on a logarithmic scale
                    often = np.minimum(8 * np.log2(mine[more]), 255).astype(np.uint8)
                    out = pack(chunk, np.array([part], np.int64), _gaps(_owners(gaps)[more]), high[more], low[more], often)
                    yield _record([(int(chunk.view(np.uint64)[0] % U(n_parts)), out)], *PARTS)

    return dealt.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(rows, "part int, payload binary")


def _width(n_parts: int) -> int:
    """Bytes of a fingerprint: five for its 40 bits, and what the number of its part needs."""
    return 5 + max(1, -(-(n_parts - 1).bit_length() // 8))


def _narrow(token: np.ndarray, width: int) -> bytes:
    """Fingerprints under 256 ** width, `width` bytes each."""
    return np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


ACTIVE = "key long, n long, m long, tokens binary"


KINDS = ["key", "n", "m", "tokens"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _active(shared: DataFrame, n_parts: int) -> DataFrame:
    """The classes whose shared part can hold a link: key, n, and their m shared fingerprints, rarest first.

    A class of several chunks comes once for each.
    """
    width = _width(n_parts)

    def rows(batches):
        for _, payloads in _by_part(batches):
            place, keys, sizes = {}, [], []
            for chunk, k, n in (x for x in payloads if len(x) == 3):
                place[int(chunk[0])] = sum(map(len, keys))
                keys.append(k)
                sizes.append(n)
            entries = [x for x in payloads if len(x) == 6]
            if not entries:
                continue
            keys, sizes = np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
            entry = np.concatenate([_owners(x[2]) + place[int(x[0][0])] for x in entries])
            token = np.concatenate([(x[1].astype(np.uint64) << U(40)) | (x[3].astype(np.uint64) << U(8)) | x[4] for x in entries])
            df = np.concatenate([x[5] for x in entries])
            live = 100 * np.bincount(entry, minlength=len(keys)) >= PERCENT * sizes
            kept = live[entry]
            token, df, entry = token[kept], df[kept], entry[kept]
            order = np.lexsort((token, df, entry))
            token, df, entry = token[order], df[order], entry[order]
            ids = np.flatnonzero(live)
            first, last = np.searchsorted(entry, ids), np.searchsorted(entry, ids, "right")
            out = []
            for i, a, z in zip(ids.tolist(), first.tolist(), last.tolist(), strict=True):
                out.append((int(keys[i]), int(sizes[i]), z - a, _narrow(token[a:z], width)))
                if len(out) == 500:
                    yield _record(out, *KINDS)
                    out = []
            yield _record(out, *KINDS)

    return shared.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(rows, ACTIVE)


def _prefixes(active: DataFrame, width: int) -> DataFrame:
    """token and key for the prefix of each class: two that are linked share one of these."""

    def rows(batches):
        for b in batches:
            token, key = [], []
            for k, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = _wide(blob.as_py(), width)
                # fingerprints of one class only come first in the order and take up their part of the prefix
                m = n - -(-PERCENT * n // 100) + 1 - (n - len(t))
                token.append(t[: max(0, m)].view(np.int64))
                key.append(np.full(len(token[-1]), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token) if token else [], pa.int64()), pa.array(np.concatenate(key) if key else [], pa.int64())], ["token", "key"])

    return active.select("key", "n", "tokens").mapInArrow(rows, "token long, key long")


class Trie:
    """Ordered sets as a prefix tree: sorted, each with the length of the path it shares with the one before."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        self.sets = [sets[i] for i in order]
        self.n = [int(sizes[i]) for i in order]
        g = len(order)
        self.lcp = [0] * g
        for i in range(1, g):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.lcp[i] = int(differ[0]) if len(differ) else m
        # the subtree that opens at i ends before jump[i]; its deepest path and smallest set
        self.jump, self.deep, self.small = [g] * g, [len(s) for s in self.sets], list(self.n)
        stack: list[int] = []
        for i in range(g + 1):
            while stack and (i == g or self.lcp[i] <= self.lcp[stack[-1]]):
                k = stack.pop()
                self.jump[k] = i
                if stack:
                    self.deep[stack[-1]] = max(self.deep[stack[-1]], self.deep[k])
                    self.small[stack[-1]] = min(self.small[stack[-1]], self.small[k])
            if i < g:
                stack.append(i)
        self.depth = np.array(self.lcp, np.int64)
        self.member = np.zeros(max((int(s[-1]) + 1 for s in self.sets if len(s)), default=1), np.int32)
        self.path = np.zeros(max(map(len, self.sets), default=0) + 1, np.int64)
        # Two linked sets share `least` of what they hold, so the rarest `need` that they share lie among the
        # `reach` rarest of either (the order ends with the rarest). Lists of the sets by these fingerprints:
        size = np.array(self.n, np.int64)
        have = np.array([len(s) for s in self.sets], np.int64)
        least = -(-PERCENT * size // 100)
        self.size, self.need = size, np.maximum(1, least // 4)
        self.reach = np.clip(have - least + self.need, 0, have)
        near = np.concatenate([s[len(s) - r :] for s, r in zip(self.sets, self.reach.tolist(), strict=True)])
        by = np.argsort(near, kind="stable")
        self.holder = np.repeat(np.arange(g, dtype=np.int32), self.reach)[by]
        self.bound = np.searchsorted(near[by], np.arange(len(self.member) + 1))

    def candidates(self, y: int, label: np.ndarray) -> np.ndarray:
        """The places, in order, of sets with another label that share enough of the rarest with set y."""
        rare = self.sets[y][len(self.sets[y]) - int(self.reach[y]) :]
        first, count = self.bound[rare], self.bound[rare + 1] - self.bound[rare]
        total = int(count.sum())
        spot = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
        holder = self.holder[spot]
        if total < len(self.sets) // 8:
            place, times = np.unique(holder, return_counts=True)
        else:
            times = np.bincount(holder, minlength=len(self.sets))
            place = np.flatnonzero(times)
            times = times[place]
        ny, n = self.n[y], self.size[place]
        fits = (times >= np.minimum(self.need[place], self.need[y])) & (100 * np.minimum(n, ny) >= PERCENT * np.maximum(n, ny))
        place = place[fits]
        return place[label[place] != label[y]]

    def linked(self, y: int, label: np.ndarray) -> list[int]:
        """The sets with another label that are linked with set y (places in sorted order)."""
        places = self.candidates(y, label)
        if not len(places):
            return []
        probe, ny, member, path, out = self.sets[y], self.n[y], self.member, self.path, []
        member[probe] = 1
        at, before, known = 0, 0, 0
        while at < len(places):
            i = int(places[at])
            s = self.sets[i]
            # the path to here is known as far as the last walk went and the sets between agree
            depth = min(known, int(self.depth[before + 1 : i + 1].min())) if i > before else known
            have = int(path[depth])
            left = len(probe) if not depth else len(probe) - int(np.searchsorted(probe, s[depth - 1], "right"))
            if depth == self.lcp[i] and 180 * (have + min(left, self.deep[i] - depth)) < PERCENT * (ny + self.small[i]) * 180 // (100 + PERCENT):
                # no set below here can reach the bound
                at, before, known = int(np.searchsorted(places, self.jump[i])), i, depth
                continue
            path[depth + 1 : len(s) + 1] = have + np.cumsum(member[s[depth:]])
            both = int(path[len(s)])
            if 100 * both >= PERCENT * (ny + self.n[i] - both):
                out.append(i)
            at, before, known = at + 1, i, len(s)
        member[probe] = 0
        return out


def join_group(sizes: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """For each set of a candidate group the first member of its component over links.

    Fingerprints are ordered by how many sets of the group have them. Sets are probed until all that
    is not probed lies in one component: a link between two components would have shown from either
    side.
    """
    names, rank, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    place = np.empty(len(names), np.int64)
    # what every set has makes the paths that the tree shares, so it comes first; sets share what is common, and differ below it
    place[np.lexsort((names, -often))] = np.arange(len(names))
    rank = place[rank]
    at = np.cumsum([0] + [len(t) for t in tokens])
    trie = Trie([np.sort(rank[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)], sizes)
    g = len(tokens)
    label, probed, count = np.arange(g), np.zeros(g, bool), np.ones(g, np.int64)
    most = 0
    while len(rest := np.flatnonzero((label != most) & ~probed)):
        for y in rest.tolist():
            if label[y] == most:
                continue
            probed[y] = True
            if found := trie.linked(y, label):
                parts = np.unique(label[[y, *found]])
                label[np.isin(label, parts)] = parts[0]
                count[parts[0]] = count[parts].sum()
                if count[parts[0]] > count[most] or most in parts:
                    most = int(parts[0])
    out = np.empty(g, np.int64)
    out[trie.order] = trie.order[label]
    return out


def _joined(groups: DataFrame, n_parts: int, width: int) -> DataFrame:
    """key and other: a star around the smallest key of each component inside a group."""

    def finish(held):
        keys = np.array([h[0] for h in held], np.int64)
        label = join_group(np.array([h[1] for h in held]), [_wide(h[2], width) for h in held])
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, label, keys)
        other = low[label]
        moved = keys != other
        return pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(other[moved])], ["key", "other"])

    def rows(batches):
        group, held = None, []
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for r in range(b.num_rows):
                g = tuple(c[r].as_py() for c in cols[:3])
                if g != group and held:
                    yield finish(held)
                    held = []
                group = g
                held.append(tuple(c[r].as_py() for c in cols[3:]))
        if held:
            yield finish(held)

    order = ["comp", "i", "j"]
    return groups.select(*order, "key", "n", "tokens").repartition(n_parts, *order).sortWithinPartitions(*order).mapInArrow(rows, "key long, other long")


def _with_first(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """The classes of all rows with `first`, the id (and text hash) of the first row of the component.

    It is null where a row is alone in its component or has no shingles. Rows meet their component by
    way of their class, and hot classes and components by broadcast: no task gets all copies of a text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    member = cut(classes(docs, id_col, text_col, hashed))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *(["text_hash"] if hashed else []))
    classed = cut(member.where("key IS NOT NULL").groupBy("key").agg(F.max("n_shingles").alias("n"), F.min(row).alias("first"), F.count("*").alias("times")))
    total, n_rows, n_classes = (x or 0 for x in classed.agg(F.sum("n"), F.sum("times"), F.count("*")).first())
    n_parts = max(least, -(-total // BUCKET))
    active = cut(_active(_shared(postings(docs, text_col, n_parts), n_parts), n_parts))
    prefix = _prefixes(active, _width(n_parts))
    heads = prefix.groupBy("token").agg(F.min("key").alias("other"), F.count("*").alias("times")).where("times > 1").drop("times")
    near = prefix.join(heads, "token").where("key <> other").select("key", "other").distinct()
    group = components(near, "key", "other")
    group = group.withColumnRenamed("node", "key").withColumnRenamed("root", "comp")
    blocks = group.join(active.select("key", "m"), "key").groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("m") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    blocks = cut(blocks)
    own = F.expr("CAST(pmod(xxhash64(key), blocks) AS INT)")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))
    # the split is told on the keys alone, so that the sets move once
    split = group.join(blocks, "comp").withColumn("b", own).withColumn("pair", F.explode(pairs)).selectExpr("comp", "pair.i AS i", "pair.j AS j", "key")
    found = cut(_joined(split.join(active.select("key", "n", "tokens"), "key"), least, _width(n_parts)).distinct())
    if blocks.where("blocks > 1").limit(1).count():
        found = components(found, "key", "other").where("node <> root").selectExpr("node AS key", "root AS other")
    found = cut(found)
    rooted = cut(classed.join(found, "key", "left").select("key", F.coalesce("other", "key").alias("root"), "first", "times"))
    first = cut(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("classes"), F.sum("times").alias("rows")).where("rows > 1").drop("rows"))
    named = cut(join_hot(rooted.drop("first"), first, ["root"], "classes", n_classes).drop("root"))
    return join_hot(member, named, ["key"], "times", n_rows, "left")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable over links, of every row.

    A null, empty or wordless text has no shingles and is linked with nothing. Rows of one text are
    linked with each other, whatever their ids; a row with a null id takes part, and its component is
    named by the smallest id that is not null. Other columns are not read; an empty table gives an
    empty result.
    """
    found = _with_first(docs, id_col, text_col)
    return found.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the first by id (null last) and hash of the text.

    Of rows that are alike in id and text one stays. Rows without shingles all stay.
    """
    found = _with_first(docs, id_col, text_col, hashed=True).where("first IS NOT NULL")
    an_id, a_hash, is_later, n_times = (free_name(docs, n) for n in ("_id", "_hash", "_later", "_times"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    # rows of one id and text are in one component
    fate = found.groupBy(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash)).agg(F.max(later).alias(is_later), F.count("*").alias(n_times))
    fate = cut(fate.where(F.col(is_later) | (F.col(n_times) > 1)).drop(n_times))
    same = docs[id_col].cast("long").eqNullSafe(fate[an_id]) & (F.xxhash64(docs[text_col].cast("string")) == fate[a_hash])
    if not fate.where(~F.col(is_later)).limit(1).count():
        return docs.join(fate, same, "left_anti")
    told = docs.join(fate, same, "left")
    return told.where(F.col(is_later).isNull()).unionByName(told.where(~F.col(is_later)).dropDuplicates([an_id, a_hash])).select(*docs.columns)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, and reachability by recursion: for small tables only.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, other) AS (SELECT rid, rid FROM w UNION SELECT r.rid, e.y FROM r JOIN e ON r.other = e.x)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(min(o.doc_id), w.doc_id) AS component_id FROM w JOIN r ON r.rid = w.rid JOIN w o ON o.rid = r.other LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id
"""
