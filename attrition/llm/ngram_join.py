"""Size-aware heavy-light Jaccard self-join on word shingles, as classes of linked documents.

Equal sets are one class first. A set of n shingles shares at least t = ceil(n * num / den)
with any partner, so two partners share a shingle among the first n - t + 1 of each, and two
among the first n - t + 2, in one order of all shingles (rare first). That order comes from
counts over the whole corpus, hashed to ``2**bits`` counters: as many as the corpus has bytes, at
most 2**24, an upper bound on each frequency, and any error in it costs time only.

* Light sets (n <= boundary) enumerate the 2-subsets of their first n - t + 2 shingles.
* Heavy sets, and light ones large enough to be their partners, go to the inverted lists of
  their first n - t + 1 shingles, which are scanned.
* The boundary minimises the estimated rows: enumerated subsets against list entries and the
  candidates these meet, from the histogram of set sizes and the counters.

Sets that meet in a subset or list are candidates. Emitting their pairs would be quadratic in a
group of copies, so a list is cut into runs of sizes that can be partners, its candidates are
joined to the smallest of their run (very frequent lists in several parts) and connected to groups. Within a group,
or list by list where that is the smaller work, blocks of at most ``block`` sets are compared, first by
their marks: a set's mark has a bit for each residue of its shingles, 1 if an odd number of them has it, and two
sets differ in at least as many shingles as their marks do in bits. About one bit a shingle tells chance meetings
from partners, so that unions of rare lists, which grow faster than the corpus, do not ship texts. A text with a
possible partner in its block is shipped there and compared exactly, all pairs of a block in one sparse
product, and a block gives a spanning forest of its links. Components of those links are the classes.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than ``words``
words make one shingle; a null, empty or blank text has no shingles and is its own class; rows
with a null id are their own class (null); rows repeating an id are one document; an empty table
gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from attrition.llm.common import PAGE, components, member_bits, written
from attrition.session import ship_package

HEAVY = 10_000  # rows of one list in one task
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)


ROOT, SLICE = 0xA0761D6478BD642F, 1 << 20
BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
BYTE[BLANK] = 0


class Powers:
    """Powers of ``ROOT`` and of its inverse modulo 2**64, as many as the longest piece of text so far needs."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int):
        if n > len(self.up):
            steps = np.full((2, n), [[ROOT], [pow(ROOT, -1, 1 << 64)]], dtype=np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[4]
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit polynomial hash of every word of UTF-8 bytes, in order; long texts go in slices that end at a blank."""
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + SLICE)
        if end < len(raw):
            last = np.flatnonzero(BLANK[raw[start:end]])
            if len(last):
                end = start + int(last[-1]) + 1
            else:  # a word longer than a slice
                while end < len(raw) and not BLANK[raw[end]]:
                    end += 1
        piece, start = raw[start:end], end
        blank = BLANK[piece]
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if len(first):
            up, down = powers.upto(max(len(piece), 1 << 14))
            out.append(np.add.reduceat(BYTE[piece] * up[:len(piece)], first) * down[first])
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingles(text, words: int, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text (str, or an object with UTF-8 bytes)."""
    h = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", np.uint8), powers)
    if not len(h):
        return h
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += h[i:n + i] * (MIX[i % 4] + np.uint64(2 * i))
    out = np.sort(mixed(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.astype("<u8").tobytes())


def as_long(b: bytes) -> int:
    return int.from_bytes(b[:8], "little", signed=True)


def needed(n, num: int, den: int):
    """Shingles that a set of n shares with any partner."""
    return -(-n * num // den)


def code(counts: np.ndarray) -> np.ndarray:
    """Counts as 16 bits, on a log scale that keeps their order (small ones exactly)."""
    return np.minimum(np.log2(1.0 + counts) * 2048, 65535).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes / 2048.0) - 1


def packed(counts: np.ndarray) -> bytes:
    """16-bit numbers compressed, low bytes before high bytes: most are zero or small."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    low, high = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, -1).astype(np.uint16)
    return low + (high << np.uint16(8))


def boundary(sizes: dict[int, int], held: np.ndarray, num: int, den: int) -> int:
    """Largest light size: least subsets + list entries * (1 + expected list length). ``held``: counters by code."""
    each = decoded(np.arange(len(held)))
    mass = each * held
    total = mass.sum()
    if not total:
        return 0
    rare = np.cumsum(mass) <= max((1 - num / den) * total, mass[mass > 0][0])
    met = 1 + max(0.0, float((mass * each)[rare].sum() / max(1.0, mass[rare].sum()) - total / held.sum()))
    n = np.array(sorted(sizes), dtype=np.int64)
    k = np.array([sizes[int(i)] for i in n], dtype=np.float64)
    free = n - needed(n, num, den)
    subsets, entries = np.cumsum(k * (free + 2) * (free + 1) / 2), k * (free + 1) * (1 + met)
    best, at = float(entries.sum()), 0
    for i, b in enumerate(n.tolist()):
        cost = subsets[i] + entries[n >= needed(b + 1, num, den)].sum()
        if cost < best:
            best, at = float(cost), b
    return at


def signatures(s: np.ndarray, order: np.ndarray, light: int, num: int, den: int):
    """(keys, code of the counter behind each key) under which a set meets its partners."""
    n = len(s)
    free = n - needed(n, num, den)
    if n * den // num <= n and not free:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)  # no different set can be a partner
    count = order[(s & np.uint64(len(order) - 1)).astype(np.int64)]
    at = np.lexsort((s, count))[:free + 2]
    s, count = s[at], count[at]
    keys, freq = [], []
    if n <= light:
        a, b = np.triu_indices(len(s), 1)
        keys.append(mixed(s[a] * MIX[6] + mixed(s[b] ^ MIX[7])))
        freq.append(count[a])
    if n >= needed(light + 1, num, den) or n - free < 2:
        keys.append(s[:free + 1])
        freq.append(count[:free + 1])
    return np.concatenate(keys), np.concatenate(freq)


def mark(s: np.ndarray) -> bytes:
    """Parities of the number of shingles at each residue modulo a power of two, at least their number."""
    if not len(s):
        return b""
    width = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def partners(ids: list, size: list, marks: list, side: list, i: int, j: int, num: int, den: int, wide: int = 2048) -> np.ndarray:
    """Whether each set of one cell may have a partner in it: no linked pair is missed. Marks are folded to the shorter of two."""
    ids, size, side = (np.array(x, dtype=np.int64) for x in (ids, size, side))
    marks = [np.frombuffer(m, np.uint8) for m in marks]
    width, found = np.array([len(m) for m in marks]), np.zeros(len(marks), dtype=bool)
    for w in np.unique(width).tolist():
        own, rest = np.flatnonzero(width == w), np.flatnonzero(width >= w)
        folded, at = np.stack([np.bitwise_xor.reduce(marks[k].reshape(-1, w), axis=0) for k in rest]), np.searchsorted(rest, own)
        apart = np.zeros((len(own), len(rest)), dtype=np.float64)
        for start in range(0, w, wide):
            m = np.unpackbits(folded[:, start:start + wide], axis=1).astype(np.float32) * 2 - 1
            apart += (m.shape[1] - m[at] @ m.T) / 2
        a, b = size[own][:, None], size[rest][None, :]
        may = (apart * (den + num) <= (a + b) * (den - num)) & (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (ids[own][:, None] != ids[rest][None, :])
        if i != j:
            may &= side[own][:, None] != side[rest][None, :]
        found[own] |= may.any(axis=1)
        found[rest] |= may.any(axis=0)
    return found


def by_cell(batches):
    """(cell, its rows) from rows (unit, i, j, ...) in the order of their cells."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:3] != now:
                if rows:
                    yield now, rows
                now, rows = r[:3], []
            rows.append(r[3:])
    if rows:
        yield now, rows


def forest(ids: list, sets: list, side: list, i: int, j: int, num: int, den: int, wide: int = 2048):
    """Spanning forest of the links of one cell: pairs inside block i, or between blocks i and j."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), size)
    shared = seen[at] > 1
    column = np.cumsum(seen > 1) - 1
    doc, col = doc[shared], column[at[shared]]
    side = np.array(side)
    a, b = (np.arange(len(sets)),) * 2 if i == j else (np.nonzero(side == i)[0], np.nonzero(side == j)[0])
    common = np.zeros((len(a), len(b)), dtype=np.float64)
    by = np.argsort(col, kind="stable")
    doc, col = doc[by], col[by]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        lo, hi = np.searchsorted(col, [start, start + wide])
        m = np.zeros((len(sets), wide), dtype=np.float32)
        m[doc[lo:hi], col[lo:hi] - start] = 1
        common += m[a] @ m[b].T
    common = common.astype(np.int64)
    linked = common * den >= num * (size[a][:, None] + size[b][None, :] - common)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(a[x])), root(int(b[y]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield ids[x], ids[y]


def jaccard_classes(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, bits: int | None = None, block: int = 256, heavy: int = HEAVY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): sets link when den * common >= num * union; component_id is the smallest linked id."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if bits is None:  # a text has fewer shingles than bytes, so small corpora need fewer counters to tell rare shingles apart
        held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(24, max(16, int(held).bit_length()))
    part, slots = 1024, 1 << bits

    # 1: size and digest of every set, and the counters of each task
    def measure(batches):
        powers, counts, held, most = Powers(), np.zeros(slots, dtype=np.uint16), [], 1 << 20

        def count():
            at = np.sort((np.concatenate(held) & np.uint64(slots - 1)).astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            at, n = at[first], np.diff(np.concatenate([first, [len(at)]]))
            counts[at] = np.minimum(counts[at] + n, 65535)
            held.clear()

        for b in batches:
            out = []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                s = shingles(t.as_buffer(), words, powers)
                if len(s):
                    held.append(s)
                if sum(map(len, held)) > most:
                    count()
                d = digest(s)
                out.append((i.as_py(), len(s), d, as_long(d), mark(s)))
            if out:
                ids, n, ds, cs, ms = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ds, pa.binary()), pa.array(cs, pa.int64()), pa.array(ms, pa.binary()),
                                                  pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names=names)
        if held:
            count()
        tables = counts.reshape(part, -1)
        used = [k for k in range(part) if tables[k].any()]
        if used:
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array([packed(tables[k]) for k in used], pa.binary())], names=names)

    names = ["doc_id", "n", "digest", "cls", "mark", "block", "counts"]
    measured = written(texts.mapInArrow(measure, "doc_id long, n long, digest binary, cls long, mark binary, block int, counts binary"), "shingle-sets")
    sets = measured.where("block is null").select("doc_id", "n", "digest", "cls", "mark")

    def add_up(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpacked(c).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(code(v)) for v in total.values()], pa.binary())], names=["block", "counts"])

    order, held = {}, np.zeros(65536)  # the counters' codes stay compressed on their way over the driver
    for r in measured.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add_up, "block int, counts binary").toLocalIterator():
        order[r.block] = bytes(r.counts)
        held += np.bincount(unpacked(order[r.block]), minlength=65536)
    held[0] += 0 if held.any() else slots
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("cls").alias("cls")), "shingle-classes")
    most = 4096  # larger sets are heavy at any sensible boundary; they enter the cost as this size
    sizes = {int(r.n): r["count"] for r in classes.groupBy(F.least("n", F.lit(most)).alias("n")).count().collect()}
    light = boundary(sizes, held, num, den)
    shared_order, order = spark.sparkContext.broadcast(order), None

    # 2: subsets of light sets, list entries of heavy ones
    def sign(batches):
        powers, done, counters = Powers(), set(), np.zeros((part, slots // part), dtype=np.uint16)
        for k, c in shared_order.value.items():
            counters[k] = unpacked(c)
        counters = counters.reshape(-1)
        for b in batches:
            keys, parts, cls, size = [], [], [], []
            for t in b.column(0):
                s = shingles(t.as_buffer(), words, powers)
                if not len(s):
                    continue
                d = digest(s)
                if d in done:
                    continue
                if len(done) >= 200_000:
                    done.clear()
                done.add(d)
                k, f = signatures(s, counters, light, num, den)
                keys.append((k >> np.uint64(24)).view(np.int64))  # 40 bits of a key: one that two share only adds candidates
                cut = 1 + (decoded(f) / heavy).astype(np.int64)
                parts.append(np.where(cut > 1, as_long(d[8:]) % cut, -1).astype(np.int32))
                cls.append(np.full(len(k), as_long(d), np.int64))
                size.append(np.full(len(k), len(s), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, parts, cls, size)], names=["key", "part", "cls", "n"])

    # partners have sizes in a ratio of num / den, so a list falls into runs: by size, each entry close enough to the one before
    in_list = Window.partitionBy("key", "part").orderBy("n", "cls")
    # a class from several tasks repeats, next to itself in this order; the lists below are told apart by their members, so each may be there once only
    entries = (texts.where("doc_id is not null").select("text").mapInArrow(sign, "key long, part int, cls long, n long")
               .withColumn("before", F.struct(F.lag("n").over(in_list).alias("n"), F.lag("cls").over(in_list).alias("cls")))
               .where("not (before.n <=> n and before.cls <=> cls)").drop("before"))
    starts = F.when(F.col("part") >= 0, 0).when(F.lag("n").over(in_list) * den >= F.col("n") * num, 0).otherwise(1)
    ends = F.when(F.col("part") >= 0, 0).when(F.col("n") * den >= F.lead("n").over(in_list) * num, 0).otherwise(1)
    met = (entries.withColumn("starts", starts).withColumn("ends", ends).withColumn("run", F.sum("starts").over(in_list))
           .where("starts = 0 or ends = 0").select("key", "part", F.xxhash64("key", "run").alias("list"), "cls"))
    # a class by its smallest id; a 64-bit class shared by two digests only adds candidates
    met = written(met.join(classes.select("cls", "rep", "n"), "cls").select("key", "part", "list", "rep", "n"), "shingle-lists")
    shared_order.destroy()  # its one use is written

    # 3: groups of sets connected through lists, and the smaller of two ways to compare them
    low = written(met.groupBy("list", "part", "key").agg(F.min("rep").alias("lo")), "list-heads")
    head = low.where("part >= 0").groupBy("key").agg(F.min("lo").alias("head"))
    edges = (met.join(low.drop("key"), ["list", "part"]).select(F.col("rep").alias("a"), F.col("lo").alias("b"))
             .unionByName(low.where("part >= 0").join(head, "key").select(F.col("lo").alias("a"), F.col("head").alias("b"))).where("a <> b").distinct())
    group = written(components(edges).withColumnRenamed("component", "grp"), "candidate-groups")
    mine = met.join(group, F.col("rep") == F.col("node")).select("list", "rep", "n", "grp")
    lists = mine.groupBy("list").agg(F.first("grp").alias("grp"), F.count("*").alias("c"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo"))
    lists = written(lists.groupBy("grp", "c", "x", "lo").agg(F.min("list").alias("list"), F.first("size").alias("size")).where("c > 1"), "distinct-lists")
    members = mine.select("grp", "rep", "n").distinct()
    by_list = lists.groupBy("grp").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("by_list"))
    ways = written(members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("size")).join(by_list, "grp")
                   .withColumn("whole", (F.col("m") <= block) | (F.col("m").cast("double") * F.col("m") <= 4 * F.col("by_list"))), "group-ways")

    def blocks(count, size):
        return F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(size) / 500_000)).cast("int")

    whole = members.join(ways.where("whole").select("grp", blocks("m", "size").alias("nb")), "grp").select(F.xxhash64("grp", F.lit(0)).alias("unit"), "nb", "rep")
    apart = (mine.select("list", "rep").join(lists.join(ways.where("not whole").select("grp"), "grp").select("list", blocks("c", "size").alias("nb")), "list")
             .select(F.xxhash64("list", F.lit(1)).alias("unit"), "nb", "rep"))
    units = written(whole.unionByName(apart).withColumn("side", F.pmod(F.xxhash64("unit", "rep"), F.col("nb")).cast("int")), "units")
    cells = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "unit", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep")

    # 4: the cells' sets by their marks, then the texts of possible partners, shipped to their cells and compared exactly
    def sift(batches):
        for cell, rows in by_cell(batches):
            side, reps, size, marks = zip(*rows, strict=True)
            kept = dict(r[:2][::-1] for r, k in zip(rows, partners(reps, size, marks, side, *cell[1:], num, den), strict=True) if k)
            if kept:
                yield pa.RecordBatch.from_arrays([*(pa.array([c] * len(kept), x) for c, x in zip(cell, (pa.int64(), pa.int32(), pa.int32()), strict=True)),
                                                  pa.array(kept.values(), pa.int32()), pa.array(kept, pa.int64())], names=["unit", "i", "j", "side", "rep"])

    marked = sets.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "mark")
    cells = written(cells.join(marked, F.col("rep") == F.col("id")).select("unit", "i", "j", "side", "rep", "n", "mark").repartition("unit", "i", "j")
                    .sortWithinPartitions("unit", "i", "j").mapInArrow(sift, "unit long, i int, j int, side int, rep long"), "cells")
    wanted_bits = 24
    flags = np.zeros((1 << wanted_bits) // 8, dtype=np.uint8).reshape(-1, PAGE // 8)
    for r in member_bits(cells.select(F.xxhash64("rep").alias("h")).distinct(), "h", wanted_bits).collect():
        flags[r.page] = np.frombuffer(r.bitmap, np.uint8)
    wanted = spark.sparkContext.broadcast(flags.reshape(-1))

    def deliver(batches):
        import zstandard

        bitmap, pack = wanted.value, zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            at = b.column(2).to_numpy() % (1 << wanted_bits)
            hit = np.nonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)[0]
            if len(hit):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array([pack(b.column(1)[int(r)].as_buffer() or b"") for r in hit], pa.binary())], names=["id", "packed"])

    delivered = (texts.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(deliver, "id long, packed binary"))

    def compare(batches):
        import zstandard

        powers, unpack = Powers(), zstandard.ZstdDecompressor().decompress
        for (_, i, j), rows in by_cell(batches):
            if len(rows) > 1:
                side, reps, packed = zip(*rows, strict=True)
                out = list(forest(reps, [shingles(unpack(t), words, powers) for t in packed], side, i, j, num, den))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    shipped = cells.join(delivered, F.col("rep") == F.col("id")).select("unit", "i", "j", "side", "rep", "packed")
    links = written(shipped.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(compare, "a long, b long"), "jaccard-links")
    wanted.destroy()
    linked = components(links)

    # 5: back to documents; equal sets share the class
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("g"), F.coalesce("component", "rep").alias("component"), "copies", "rep").where("copies > 1 or component <> rep")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = sets.where("n > 0 and doc_id is not null").join(named, F.col("digest") == F.col("g"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return joined.unionByName(alone)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class of 4-word shingle sets linked at Jaccard 0.85."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
