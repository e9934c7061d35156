"""Sets of word shingles and the exact Jaccard self-join on them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import components, mix64, pieces, small_batches, stash, unstash, utf8

_RNG = np.random.default_rng(20240229)
#: Random odd letters' weights and powers for the rolling word hash.
_LETTER = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER[_SPACE] = 0
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
#: A shingle is frequent if this many documents have it, found in runs of RUN bytes of text that have it SEEN times; frequent ones come last in the order.
FREQUENT, RUN, SEEN = 10, 16 << 20, 3
#: Frequent shingles that the order knows by rank; the rest keep hash order. Bounds what is broadcast (8 MB).
RANKED = 1_000_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of many texts laid end to end, and the text each is of (not yet distinct)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = solid[heads]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(np.concatenate([[0], at[1:]]), np.diff(np.concatenate([[0], at[1:], [n]])))
    powers = np.cumprod(np.full(int(place.max()) + 2, _BASE))
    hashed = mix64(np.add.reduceat(_LETTER[data] * powers[place], at))
    text = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    out, of = [], []
    if len(hashed) >= words:
        full = np.flatnonzero(text[: len(text) - words + 1] == text[words - 1 :])
        rolled = np.zeros(len(full), np.uint64)
        for j in range(words):
            rolled += hashed[full + j] * _STEP[j]
        out.append(mix64(rolled))
        of.append(text[full])
    first = np.searchsorted(text, np.arange(len(count)))
    for t in np.flatnonzero((count > 0) & (count < words)):
        own = hashed[first[t] : first[t] + count[t]]
        out.append(mix64((own * _STEP[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], np.uint64) * _STEP[63]))
        of.append(np.array([t]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


def text_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    hashes, of = shingle_hashes(data, offsets, words)
    cuts = np.searchsorted(of, np.arange(len(offsets)))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents have, rarest first, by counts over all documents.

    Each run of about RUN bytes sends only the shingles that SEEN of its texts have, so a shingle spread more thinly
    than that keeps its place by hash. The order matters for speed only; any one gives all links.
    """

    def local(batches):
        held, size = [], 0

        def counts():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= SEEN].view(np.int64)), pa.array(n[n >= SEEN].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for part in pieces(b, "text"):
                held += text_sets(part.column(0), words)
                size += part.nbytes
                if size >= RUN:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    found = docs.select("text").mapInArrow(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def _ceil_share(n: np.ndarray | int, top: int, bottom: int):
    return -(-n * top // bottom)


def _described(docs: DataFrame, late: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, id, n, prefix and bits of every row's set, `late` shingles last in the order."""
    rank = docs.sparkSession.sparkContext.broadcast(late)

    def describe(batches):
        late = rank.value
        sort = np.argsort(late)
        known = late[sort]
        for b in batches:
            for part in pieces(b, "text"):
                ns, ids, prefixes, bits = [], [], [], []
                for s in text_sets(part.column(1), words):
                    ns.append(len(s))
                    ids.append(set_id(s))
                    bits.append(bitmap(s))
                    if len(known) and len(s):
                        hit = np.searchsorted(known, s)
                        hit[hit == len(known)] = 0
                        common = known[hit] == s
                        s = np.concatenate([s[~common], late[np.sort(sort[hit[common]])]])
                    prefixes.append(s[: len(s) - _ceil_share(len(s), percent, 100) + 1].view(np.int64) if len(s) else s.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "id", "n", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, id long, n long, prefix array<long>, bits binary")


def shingle_classes(docs: DataFrame, late: np.ndarray, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, n) of every row, and a row per distinct non-empty set: id, doc (the least), n, prefix, bits.

    The prefix holds the set's first shingles in the order (frequent last, else by hash) that any set at
    `percent` or more shares one of: n - ceil(percent% n) + 1 of them. bits has the low bits of all hashes.
    """
    whole = stash(_described(docs, late, words, percent), "sets")
    classes = whole.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes, rows = stash(classes, "classes"), stash(whole.select("doc_id", "id", "n"), "rows")
    unstash(whole)
    return rows, classes


def set_id(s: np.ndarray) -> int:
    """A 64-bit digest of a set, as the shingles are themselves."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for the low bits of each hash, in a power of two of at least 4 a hash and 64 in all."""
    m = 1 << max(6, int(4 * len(s) - 1).bit_length())
    out = np.zeros(m, np.uint8)
    out[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """An upper bound of how many hashes each pair of sets shares, from bitmaps and sizes."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0):
        at = np.flatnonzero((size == (la, lb)).all(1))
        x = np.frombuffer(b"".join(a[i] for i in at), np.uint8).reshape(len(at), la)
        y = np.frombuffer(b"".join(b[i] for i in at), np.uint8).reshape(len(at), lb)
        w = min(la, lb)
        x = np.bitwise_or.reduce(x.reshape(len(at), la // w, w), 1)
        y = np.bitwise_or.reduce(y.reshape(len(at), lb // w, w), 1)
        both, px, py = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x & y, x, y))
        out[at] = np.minimum(both + n[at] - px, both + m[at] - py)
    return out


#: Postings of a list that one comparison holds side by side.
BLOCK = 512
#: Lists of more postings are dealt over several tasks, in pairs of blocks of about so many.
SPLIT = 4096
#: Lists of at least so many postings make their shingle a late one when open sets are listed again.
LONG = 4
#: Ids that are broadcast to choose the texts to read; more are joined by shuffles.
FEW = 2_000_000
#: Postings that a worker gathers before it compares; bounds its memory beside one list part of 2 * SPLIT.
GATHER = 1 << 16


def _reach(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which sets of n and m shingles link."""
    return _ceil_share(n + m, percent, 100 + percent)


def list_pairs(key: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, role: np.ndarray, percent: int):
    """Index pairs within runs of equal `key` that are of two groups and may reach `percent`.

    Each run is sorted by size. If the shingle of the list is the first that two sets share, they share no more than
    the fewer of the shingles from there on: `n - at`. Short lists of one length are compared at once; longer ones
    by blocks, and a block is skipped whole where its sizes or its best position leave too little. Of a list dealt
    in pairs of blocks, postings of the two `role`s are compared with each other only.
    """
    after = n - at
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(cuts)
    mixed = np.minimum.reduceat(group, cuts[:-1]) != np.maximum.reduceat(group, cuts[:-1])
    crossed = np.minimum.reduceat(role, cuts[:-1]) != np.maximum.reduceat(role, cuts[:-1])

    def fits(x, y):
        return (group[x] != group[y]) & (np.minimum(after[x], after[y]) >= _reach(n[x], n[y], percent))

    for size in np.unique(sizes[mixed & (sizes <= 64)]):
        starts = cuts[:-1][mixed & (sizes == size)]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(i))
        for lo in range(0, len(starts), step):
            x, y = ((starts[lo : lo + step, None] + k[None]).ravel() for k in (i, j))
            ok = fits(x, y)
            yield x[ok], y[ok]
    for run in np.flatnonzero(mixed & (sizes > 64)):
        begin, stop = cuts[run], cuts[run + 1]
        for a in range(begin, stop, BLOCK):
            rows = np.arange(a, min(a + BLOCK, stop))
            end = begin + int(np.searchsorted(n[begin:stop], n[rows[-1]] * 100 // percent, "right"))
            for b in range(a, end, BLOCK):
                cols = np.arange(b, min(b + BLOCK, end))
                if min(after[rows].max(), after[cols].max()) < _reach(n[rows[0]], n[cols[0]], percent):
                    continue
                ok = fits(rows[:, None], cols[None]) & (rows[:, None] < cols[None])
                if crossed[run]:
                    ok &= role[rows, None] != role[None, cols]
                x, y = np.nonzero(ok)
                yield rows[x], cols[y]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in schema.split(", ")])


def _gathered(batches, keys: int):
    """(table, rows done): batches in runs of about GATHER rows; the last list of a run waits for the next one."""
    held, count = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= GATHER:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = np.ones(count, bool)
            for k in range(keys):
                column = whole.column(k).to_numpy()
                last &= column == column[-1]
            cut = int(np.argmax(last))
            if cut:
                yield whole.slice(0, cut)
            held, count = [whole.slice(cut)], count - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _leads(postings: DataFrame, percent: int) -> DataFrame:
    """Each list (token, at, id, n) against its lead, the set that has the shingle earliest, so the most ordinary one.

    kind 0: a pair (a: lead, b) that may reach `percent`. kind 1: a further posting of a list that has two of them
    or more (token, a: id, n, at). kind 2: token and number n of such postings. Lists pass by once, sorted by
    position; a worker holds no more of one than its lead and the posting before.
    """
    schema = "kind int, token long, a long, b long, n int, at int"

    def scan(batches):
        lead = last = None  # rows (token, at, id, n) of the open list: its lead, and its second posting while it is alone
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            token, at, ids, n = (b.column(k).to_numpy().astype(np.int64) for k in range(4))
            first = np.concatenate([[lead is None or lead[0] != token[0]], token[1:] != token[:-1]])
            index = np.maximum.accumulate(np.where(first, np.arange(len(token)), -1))
            own = index >= 0
            at_lead, id_lead, n_lead = (np.where(own, x[index], lead[k] if lead else 0) for k, x in ((1, at), (2, ids), (3, n)))
            order = np.arange(len(token)) - np.where(own, index, -seen)  # place in its list; the lead has 0
            ok = (order > 0) & (np.minimum(n - at, n_lead - at_lead) >= _reach(n, n_lead, percent)) & (ids != id_lead)
            ends = np.append(first[1:], False)
            more = (order > 1) | ((order == 1) & np.append(order[1:] == 2, False))
            early = last is not None and order[0] == 2  # the posting before, the last of its batch, isn't alone
            done = np.flatnonzero(ends & (order > 1))
            count = order[done]
            closed = [lead[0], seen - 1] if first[0] and lead is not None and seen > 2 else None
            pair = np.unique(np.stack([id_lead[ok], ids[ok]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
            k0, k1, k2 = len(pair), int(more.sum()) + early, len(done) + (closed is not None)
            kind = np.repeat(np.array([0, 1, 2], np.int32), [k0, k1, k2])
            head = np.array([last] if early else np.zeros((0, 4)), np.int64).reshape(-1, 4)
            tail = np.array([closed] if closed else np.zeros((0, 2)), np.int64).reshape(-1, 2)
            none = np.zeros(k0 + k1 + k2, np.int64)
            yield _batch(schema, [
                kind,
                np.concatenate([none[:k0], head[:, 0], token[more], token[done], tail[:, 0]]),
                np.concatenate([pair[:, 0], head[:, 2], ids[more], none[:k2]]),
                np.concatenate([pair[:, 1], none[: k1 + k2]]),
                np.concatenate([none[:k0], head[:, 3], n[more], count, tail[:, 1]]).astype(np.int32),
                np.concatenate([none[:k0], head[:, 1], at[more], none[:k2]]).astype(np.int32),
            ])
            lead, seen = (int(token[-1]), int(at_lead[-1]), int(id_lead[-1]), int(n_lead[-1])), int(order[-1]) + 1
            last = (int(token[-1]), int(at[-1]), int(ids[-1]), int(n[-1])) if order[-1] == 1 else None
        if seen > 2:
            yield _batch(schema, [np.array([2], np.int32), np.array([lead[0]], np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([seen - 1], np.int32), np.zeros(1, np.int32)])

    return _dealt(postings.select("token", "at", "id", "n"), "token").sortWithinPartitions("token", "at", "n", "id").mapInArrow(scan, schema)


def _compared(postings: DataFrame, sizes: DataFrame, percent: int, want: str) -> DataFrame:
    """What lists (token, id, n, at, g) leave open between groups: "pairs" (a, b), or the "sets" (id) in such pairs.

    `sizes` has (token, n) of at least every list over SPLIT postings: these are dealt by pairs of blocks.
    """
    parts = sizes.where(F.col("n") > SPLIT).select("token", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    role = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = postings.join(parts, "token", "left").withColumn("role", role)
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select("token", F.least("role", "other").alias("p"), F.greatest("role", "other").alias("q"), "id", "n", "at", "g", "role")
    schema = "a long, b long" if want == "pairs" else "a long"

    def scan(batches):
        for table in _gathered(batches, 3):
            token, p, q, ids, n, at, g, role = (table.column(k).to_numpy() for k in range(8))
            key = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            found = [np.zeros(0, np.int64)] if want == "sets" else [np.zeros((0, 2), np.int64)]
            for x, y in list_pairs(key, ids, n.astype(np.int64), at, g, role, percent):
                pair = np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1)
                found.append(np.unique(pair, axis=0) if want == "pairs" else np.unique(pair))
            out = np.unique(np.concatenate(found), axis=0)
            yield _batch(schema, [out[:, 0], out[:, 1]] if want == "pairs" else [out])

    return _dealt(rows, "token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "id").mapInArrow(scan, schema).distinct()


def _overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b, s, na, nb): the exact overlap s of those pairs whose bitmaps let them reach `percent`.

    The bound drops no pair that reaches it; only documents of the pairs it leaves are read again.
    """

    def bound(batches):
        for r in batches:
            n, m = r.column(1).to_numpy(), r.column(4).to_numpy()
            ok = most_shared(r.column(2).to_pylist(), r.column(5).to_pylist(), n, m) >= _reach(n, m, percent)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(3)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    left = stash(pairs.join(x, "a").join(y, "b").select("a", "na", "xa", "b", "nb", "xb").mapInArrow(bound, "a long, b long"), "candidates")

    def expand(batches):
        for r in batches:
            for part in pieces(r, "text"):
                sets = text_sets(part.column(1), words)
                same = [set_id(s) == d for s, d in zip(sets, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "set"]).filter(pa.array(same, pa.bool_()))

    asked = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct().join(classes.select("id", "doc"), "id")
    sets = docs.join(asked, docs["doc_id"] == asked["doc"]).select("id", "text").mapInArrow(expand, "id long, set array<long>")
    sets = stash(sets.dropDuplicates(["id"]), "shingle-sets")
    both = left.join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b")
    out = stash(both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("s"), F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb")), "overlaps")
    unstash(sets)
    unstash(left)
    return out


def _need(n, m, percent: int):
    """The least overlap at which sets of n and m shingles link, as a column."""
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(F.col("s") * 100 >= (F.col("na") + F.col("nb") - F.col("s")) * percent).select("a", "b")


def derive(pairs: DataFrame, known: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): `pairs` (a, b) with what known overlaps (a, b, s, na, nb) say of them; what they rule out is gone.

    Each set has its most similar set among its known ones. Where a and b have the same one, r, their overlap follows
    from r's answers but for the shingles in which they differ from it: it is at least s(a,r) + s(b,r) - n(r) and at
    most s(b,r) + (n(a) - s(a,r)). A pair that the lower bound links is `sure`; one that the upper bound forbids goes.
    """
    sides = known.select(F.col("a").alias("id"), F.struct("s", F.col("b").alias("r"), F.col("nb").alias("nr")).alias("k")).union(known.select(F.col("b").alias("id"), F.struct("s", F.col("a").alias("r"), F.col("na").alias("nr")).alias("k")))
    near = sizes.select("id", F.col("n").cast("long").alias("n")).join(sides.groupBy("id").agg(F.max("k").alias("k")), "id", "left")
    x, y = (near.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("k.s").alias(f"s{c}"), F.col("k.r").alias(f"r{c}"), F.col("k.nr").alias(f"m{c}")) for c in "ab")
    told = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti").join(x, "a").join(y, "b")
    least, most = F.expr("sa + sb - ma"), F.expr("least(sb + na - sa, sa + nb - sb)")
    same, need = F.coalesce(F.expr("ra = rb"), F.lit(False)), _need("na", "nb", percent)
    return told.where(~same | (most >= need)).select("a", "b", (same & (least >= need)).alias("sure"))


def jaccard_components(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the connected components of all links at `percent` or more.

    Equal sets are one class. Every shingle's list is compared with its lead first, the set that has it at the
    earliest position; sets linked to it are of one component, and pairs within a component are never formed. Sets of
    pairs that remain, of two components in one list, are listed again with the shingles of long lists last in the
    order, and compared block by block as sizes and positions allow. A pair whose sets have the same most similar set
    has its answer from that set's; the others are verified on whole sets. No link between components is lost.

    Null or wordless text: 0 shingles, its own component. Rows that share a doc_id count as one document. A null
    doc_id links with nothing and has a null component. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = _frequent(docs, words)
    rows, classes = shingle_classes(docs, late, words, percent)
    found = stash(_leads(classes.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token")), percent), "lists")
    pairs = found.where("kind = 0 and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = _overlaps(pairs, classes, docs, percent, words)
    # rows of one doc_id are one document, whatever sets they have
    links = _linked(known, percent).union(rows.where("n > 0").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b and doc_id is not null").join(rows, "doc_id").select("a", F.col("id").alias("b")))
    parts = components(links)
    sizes = found.where("kind = 2").select("token", "n")
    grouped = found.where("kind = 1").select("token", F.col("a").alias("id"), "n", "at").join(parts, "id", "left").withColumn("g", F.coalesce("component", "id"))
    again = stash(_compared(grouped, sizes, percent, "sets").select(F.col("a").alias("id")).join(classes.select("id", "doc"), "id"), "open-sets")
    long = sizes.where(F.col("n") >= LONG).orderBy(F.desc("n"), "token").limit(RANKED).select("token").toArrow().column("token").to_numpy()[::-1].view(np.uint64)
    unstash(found)
    late = np.concatenate([long[~np.isin(long, late)], late])
    # Only prefixes are shuffled, not the texts that they are of.
    asked = again.select(F.col("doc").alias("doc_id")).distinct()
    described = _described(docs.join(F.broadcast(asked) if asked.limit(FEW + 1).count() <= FEW else asked, "doc_id", "left_semi"), late, words, percent)
    described = described.select("id", "n", "prefix").join(again.select("id"), "id").dropDuplicates(["id"])
    postings = described.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    postings = stash(postings.join(parts, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("g")), "listed-again")
    sizes = postings.groupBy("token").agg(F.count("*").alias("n"))
    told = stash(derive(_compared(postings, sizes, percent, "pairs"), known, classes, percent), "derived")
    more = _overlaps(told.where("not sure").select("a", "b"), classes, docs, percent, words)
    whole = components(links.union(told.where("sure").select("a", "b")).union(_linked(more, percent)))
    of = classes.select("id", "doc").join(whole, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("part"))
    of = of.select("id", "part").join(of.groupBy("part").agg(F.min("doc").alias("class")), "part").select("id", "class")
    out = rows.join(of, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
    out = stash(out, "jaccard")
    for used in (again, postings, told, known, more, parts, whole, classes, rows):
        unstash(used)
    return out
