"""Cross-tokenizer alignment: token pairs that share a byte range, counted by document in stripes of ids."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leaklens.llm.shared import pieces, small_batches, stash, unstash
from leaklens.llm.tokens import _byte_letters

#: Ids of the first tokenizer in a stripe: its dense matrix has so many rows, and a column for each id of the second.
STRIPE = 128
#: Chunks whose alignment a worker remembers; the memory is emptied between batches.
CHUNKS = 250_000
#: Bytes of text worked on together; a longer text is worked on alone, so many chunks at a time.
TEXT, SOME = 4 << 20, 200_000
#: Requests that one task adds up for a stripe, about.
REQUESTS = 2048
#: Longest chunk that is aligned with others.
PLAIN = 200
#: How byte-level vocabularies of this kind split a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the first tokenizer's split pattern takes as white space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space and the words up to the next space or line end after a word; white space at the end goes with the last.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:(?![ \n])[{_SPACE}]+[^{_SPACE}]+)*(?:[{_SPACE}]+\\Z)?|[{_SPACE}]+\\Z")
#: Chunks that begin with white space, end without, and have letters whose classes all libraries agree on.
_PLAIN = re.compile(r"[ \n][\t-\r -~\xa0-\u024f]*[!-~\xa1-\u024f]")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's varint and length-delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            at += 8 if tag & 7 == 1 else 4


class Aligner:
    """Groups of two tokenizers' tokens that end together, remembered by chunk of text.

    Both tokenizers cut before white space that follows a word, as the first splits there and no piece of the second
    goes across; so a text's groups are those of its chunks end to end, and chunks can be encoded end to end. Files
    for which that does not hold are found by their settings, and their texts are one chunk each.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else b""
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        steps = json.loads(open(path_a, encoding="utf-8").read())
        split, bpe = steps["pre_tokenizer"] or {}, steps["model"]
        a_cuts = steps["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        with open(path_b, "rb") as f:
            model = list(_fields(f.read()))
        norm = dict(x for n, v in model if n == 3 for x in _fields(v))
        as_is = not norm.get(2) and norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
        self.by_chunk = bool(a_cuts and as_is and self.b.piece_to_id("▁") != self.b.unk_id() and not any("\n" in p or re.search("[^▁]▁", p) for p in names))
        self.ranked = None
        special = {x["id"] for x in steps["added_tokens"]}
        merged = [vocabulary.get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in bpe.get("merges", [])]
        if self.by_chunk and bpe["type"] == "BPE" and merged == sorted(set(merged)) and not bpe.get("ignore_merges"):  # ids grow with the rank of their merge
            self.ranked = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if x and i not in special}, special_tokens={})
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.inner_a, self.last_a, self.inner_b, self.last_b = text(len(self.bytes_a), ","), text(len(self.bytes_a), "|"), text(len(names), ","), text(len(names), ";")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[bytes | None] = []
        self.sizes, self.begin, self.pair, self.times = array("q"), array("q", [0]), array("q"), array("q")

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.by_chunk else [" " + text]

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """The second tokenizer adds a space, which a chunk that begins with one stands for."""
        out = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, out, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known yet: short Latin ones all together, others one by one."""
        plain, rest = [], []
        for c in chunks:
            (plain if self.ranked and len(c) <= PLAIN and _PLAIN.fullmatch(c) else rest).append(c)
        if plain:
            self._learn_plain(plain)
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for c, a, b in zip(some, self.a.encode_batch(some, add_special_tokens=False), self._ids_b(some), strict=True):
                self.known[c] = len(self.said)
                self._store(groups(c.encode(), a.ids, b, self.bytes_a, self.bytes_b))

    def _learn_plain(self, chunks: list[str]) -> None:
        whole = "".join(chunks)
        a, lists = np.array(self.ranked.encode_ordinary(whole), np.int64), self._ids_b(chunks)
        b = np.array([x for ids in lists for x in ids], np.int64)
        stop = np.cumsum([len(c.encode()) for c in chunks])  # where chunks end
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole.encode() or not np.isin(stop, end_a).all() or not np.isin(stop, end_b).all():
            raise RuntimeError("the tokenizers' files do not behave as their settings say")
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)  # the group of each token
        n, m = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        last = np.searchsorted(both, stop) + 1  # the groups of chunks end before these
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)[last - 1]]))
        sizes = np.stack([per(n), per(m), np.diff(last, prepend=0), per(n * m)], 1)
        chunk = np.repeat(np.arange(len(chunks)), sizes[:, 2])  # of a group
        x = np.repeat(a, m[of_a])
        y = b[ragged((np.cumsum(m) - m)[of_a], m[of_a])]
        wide = len(self.bytes_b)
        all_ = len(self.bytes_a) * wide
        links, times = np.unique(np.repeat(chunk[of_a], m[of_a]) * all_ + x * wide + y, return_counts=True)
        is_last = lambda of: np.append(of[1:] != of[:-1], True)
        words = np.concatenate([np.where(is_last(of_a), self.last_a[a], self.inner_a[a]), np.where(is_last(of_b), self.last_b[b], self.inner_b[b])])
        order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
        words = words[order].tolist()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))[np.cumsum(sizes[:, 0] + sizes[:, 1]) - 1].tolist()
        said, at = "".join(words).encode(), 0
        for c, end in zip(chunks, ends, strict=True):
            self.known[c] = len(self.said)
            self.said.append(said[at : end - 1])
            at = end
        base = len(self.pair)
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.pair.frombytes((links % all_).tobytes())
        self.times.frombytes(times.astype(np.int64).tobytes())
        self.begin.frombytes((base + np.cumsum(np.bincount(links // all_, minlength=len(chunks)))).astype(np.int64).tobytes())

    def _store(self, found: list[tuple[list[int], list[int]]] | None) -> None:
        links: Counter[int] = Counter()
        wide, n_a, n_b, n_links = len(self.bytes_b), 0, 0, 0
        for a, b in found or ():
            n_a, n_b, n_links = n_a + len(a), n_b + len(b), n_links + len(a) * len(b)
            many = Counter(b).items()
            for x, n in Counter(a).items():
                for y, m in many:
                    links[x * wide + y] += n * m
        self.said.append(None if found is None else ";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found]).encode())
        self.sizes.extend((n_a, n_b, len(found or ()), n_links))
        self.pair.extend(links.keys())
        self.times.extend(links.values())
        self.begin.append(len(self.pair))

    def ids(self, chunks: list[str]) -> list[int]:
        """Where the chunks are remembered; new ones are aligned first."""
        if new := [c for c in dict.fromkeys(chunks) if c not in self.known]:
            self.learn(new)
        return list(map(self.known.__getitem__, chunks))


def groups(whole: bytes, a: list[int], b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]) -> list[tuple[list[int], list[int]]] | None:
    """Runs of both sides' ids between offsets where tokens of both end; None where a side's bytes are not the text's."""
    if b"".join([bytes_a[x] for x in a]) != whole or b"".join([bytes_b[x] for x in b]) != whole:
        return None
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        from_i, from_j = i, j
        end_a, end_b = end_a + len(bytes_a[a[i]]), end_b + len(bytes_b[b[j]])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                end_a += len(bytes_a[a[i]])
                i += 1
            else:
                end_b += len(bytes_b[b[j]])
                j += 1
        out.append((a[from_i:i], b[from_j:j]))
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, deflated, in the least width that holds them; the first byte says which."""
    most = int(x.max()) if len(x) else 0
    kind = next(i for i, t in enumerate(_WIDTHS) if most <= np.iinfo(t).max)
    return bytes([kind]) + zlib.compress(x.astype(_WIDTHS[kind]).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), _WIDTHS[raw[0]]).astype(np.int64)


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+n[0]-1, begin[1] .. end to end."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    kept, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(kept), np.int64)
    np.add.at(out, at, values)
    return kept, out


class _Batch:
    """Documents whose links are kept together: for each, the bundles of links it has and how often; a bundle is a chunk's links."""

    def __init__(self) -> None:
        self.said: list[str] = []
        self.sizes: list[list[int]] = []
        self.doc, self.bundle, self.often = [], [], []
        self.begin, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def blank(self) -> None:
        self.said.append("")
        self.sizes.append([0, 0, 0, 0])

    def messages(self, batch: int, ids: pa.Array, wide: int) -> Iterator[tuple]:
        """One row of links, and a row for each stripe with the batch's distinct pairs and how many documents have each."""
        doc = np.concatenate(self.doc) if self.doc else np.zeros(0, np.int64)
        bundle = np.concatenate(self.bundle) if self.bundle else np.zeros(0, np.int64)
        often = np.concatenate(self.often) if self.often else np.zeros(0, np.int64)
        used, bundle = np.unique(bundle, return_inverse=True)
        n = self.begin[used + 1] - self.begin[used]
        take = ragged(self.begin[used], n)
        pairs, pair = np.unique(self.pair[take], return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(n)])
        each = n[bundle]
        hold = np.unique(np.repeat(doc, each) * max(len(pairs), 1) + pair[ragged(begin[bundle], each)])
        held = np.bincount(hold % max(len(pairs), 1), minlength=len(pairs))
        sizes = np.array(self.sizes, np.int64).reshape(-1, 4)
        blobs = [*(packed(sizes[:, k]) for k in range(4)), *map(packed, (np.bincount(doc, minlength=len(self.said)), np.diff(doc * len(used) + bundle, prepend=0), often, n, pair, self.times[take]))]
        yield (1, batch, -1, ids, self.said, blobs)
        stripe, code = np.divmod(pairs, STRIPE * wide)
        cut = np.flatnonzero(np.diff(stripe, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(pairs)][: len(cut)], strict=True):
            yield (0, batch, int(stripe[a]), None, None, [packed(code[a:b]), packed(held[a:b])])


def _short(own: Aligner, texts: list[str | None]) -> _Batch:
    """Many documents by their chunks."""
    out = _Batch()
    cut = [own.chunks(t) if t else [] for t in texts]
    flat = own.ids([c for x in cut for c in x])
    seen, at = np.array(flat, np.int64), 0
    sizes = np.frombuffer(own.sizes, np.int64).reshape(-1, 4)
    for k, chunks in enumerate(cut):
        said = [own.said[i] for i in flat[at : at + len(chunks)]]
        mine = seen[at : at + len(chunks)]
        at += len(chunks)
        if not said or None in said:
            out.blank()
            continue
        bundle, often = np.unique(mine, return_counts=True)
        out.said.append(hashlib.sha256(b";".join(said)).hexdigest())
        out.sizes.append((sizes[bundle] * often[:, None]).sum(0).tolist())
        out.doc.append(np.full(len(bundle), k))
        out.bundle.append(bundle)
        out.often.append(often)
    out.begin, out.pair, out.times = (np.array(x, np.int64) for x in (own.begin, own.pair, own.times))
    return out


def _long(own: Aligner, text: str) -> _Batch:
    """One long document, some chunks at a time; a bundle is a distinct pair."""
    out, digest, sizes, first = _Batch(), hashlib.sha256(), np.zeros(4, np.int64), True
    pair, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    chunks = (m.group() for m in _CHUNK.finditer(" " + text)) if own.by_chunk else iter([" " + text])
    while some := list(islice(chunks, SOME)):
        if len(own.said) > CHUNKS:
            own.forget()
        flat = own.ids(some)
        said = [own.said[i] for i in flat]
        if None in said:
            out.blank()
            return out
        digest.update((b"" if first else b";") + b";".join(said))
        first = False
        bundle, often = np.unique(np.array(flat, np.int64), return_counts=True)
        sizes += (np.array(own.sizes, np.int64).reshape(-1, 4)[bundle] * often[:, None]).sum(0)
        begin = np.array(own.begin, np.int64)
        n = begin[bundle + 1] - begin[bundle]
        take = ragged(begin[bundle], n)
        pair, times = _summed(np.concatenate([pair, np.array(own.pair, np.int64)[take]]), np.concatenate([times, np.array(own.times, np.int64)[take] * np.repeat(often, n)]))
    out.said.append(digest.hexdigest())
    out.sizes.append(sizes.tolist())
    out.doc, out.bundle, out.often = [np.zeros(len(pair), np.int64)], [np.arange(len(pair))], [times]
    out.begin, out.pair, out.times = np.arange(len(pair) + 1), pair, np.ones(len(pair), np.int64)
    return out


def _add_up(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (stripe, salt, blobs), ordered by the first two: the sums of each as (stripe, blobs) with codes and counts, from a dense matrix."""
    counts, now = None, None

    def ready() -> pa.RecordBatch:
        codes = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([[packed(codes), packed(counts[codes])]], pa.list_(pa.binary()))], names=["stripe", "blobs"])

    for b in batches:
        for stripe, salt, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (stripe, salt) != now:
                if now is not None:
                    yield ready()
                counts, now = np.zeros(STRIPE * wide, np.int64), (stripe, salt)
            np.add.at(counts, unpacked(blobs[0]), unpacked(blobs[1]))
    if now is not None:
        yield ready()


def _answer(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (stripe, salt, batch, blobs), a stripe's counts (null batch) before requests: each request's counts, and which are the highest of their row."""
    counts = most = None
    for b in batches:
        out: list[tuple] = []
        for stripe, batch, blobs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            codes = unpacked(blobs[0])
            if batch is None:
                counts = np.zeros(STRIPE * wide, np.int64)
                counts[codes] = unpacked(blobs[1])
                most = counts.reshape(STRIPE, wide).max(1)
            else:
                out.append((batch, stripe, [packed(counts[codes]), packed((counts[codes] == most[codes // wide]).astype(np.int64))]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.binary())), strict=True)], names=["batch", "stripe", "blobs"])


def _score(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows (batch, stripe, ids, said, blobs), answers in the order of stripes before the batch's links (null stripe): the documents' rows."""
    now, count, best = None, [], []
    for b in batches:
        for k, (batch, stripe, said, blobs) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True)):
            if batch != now:
                now, count, best = batch, [], []
            if stripe is not None:
                count.append(unpacked(blobs[0]))
                best.append(unpacked(blobs[1]))
                continue
            *sizes, per_doc, bundle, often, n, pair, times = map(unpacked, blobs)
            value, top = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (count, best))
            begin = np.concatenate([[0], np.cumsum(n)])
            bundle = np.cumsum(bundle) % max(len(n), 1)
            of_bundle = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[pair] * times)])[begin]) if len(n) else n  # noqa: E731, B023
            ends = np.concatenate([[0], np.cumsum(per_doc)])
            of_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(of_bundle(x)[bundle] * often)])[ends])  # noqa: E731, B023
            columns = [*sizes, of_doc(top), of_doc(value)]
            yield pa.RecordBatch.from_arrays([b.column(2).slice(k, 1).flatten(), *(pa.array(c, pa.int64()) for c in columns), pa.array(said, pa.string())], names=[key, *COUNTS, "groups_sha256"])


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def link_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """What the alignment of all texts leaves: `links` (by batch of documents), `requests` (by batch and stripe), `counts` (by stripe).

    Every text is encoded once, where it lies. Links stay together by batch of documents; what is counted are the
    batch's distinct pairs with the number of its documents that hold them, dealt to stripes of the first tokenizer's
    ids. A stripe with many requests is added up in parts, dense blocks in either case.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType
    arrow, wide = to_arrow_type(kind), len(aligner(path_a, path_b).bytes_b)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, k = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(arrow), pa.list_(pa.string()), pa.list_(pa.binary()))
        for b in batches:
            for part in pieces(b, "text", TEXT):
                if len(own.said) > CHUNKS:
                    own.forget()
                texts = part.column(1).to_pylist()
                found = _long(own, texts[0]) if len(texts) == 1 and len(texts[0] or "") > TEXT // 4 else _short(own, texts)
                rows = list(found.messages((task << 32) + k, part.column(0), wide))
                k += 1
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows] + [part.num_rows] * (len(rows) - 1), pa.int32()), part.column(0))
                columns = [pa.array(v, t) if t is not types[3] else ids for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "batch", "stripe", "ids", "said", "blobs"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(align, f"kind int, batch long, stripe int, ids array<{kind.simpleString()}>, said array<string>, blobs array<binary>")
    both = stash(rows, "links", "kind")
    requests = both.where("kind = 0").select("stripe", "batch", "blobs")
    salts = max([1, *(-(-r["count"] // REQUESTS) for r in requests.groupBy("stripe").count().agg(F.max("count").alias("count")).collect() if r["count"])])
    requests = requests.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    add = lambda df: df.select("stripe", "salt", "blobs").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(lambda b: _add_up(b, wide), "stripe int, blobs array<binary>")
    counts = add(requests)
    if salts > 1:
        counts = add(counts.withColumn("salt", F.lit(0)))
    counts = stash(counts, "counts")
    return {"written": both, "links": both.where("kind = 1").select("batch", "ids", "said", "blobs"), "requests": requests, "counts": counts, "salts": salts}


def pair_counts(found: dict, path_a: str, path_b: str) -> DataFrame:
    """(a, b, documents, best) of every id pair that some document holds linked."""
    wide = len(aligner(path_a, path_b).bytes_b)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, (codes, n) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, n = unpacked(codes), unpacked(n)
                most = np.zeros(STRIPE, np.int64)
                np.maximum.at(most, codes // wide, n)
                yield pa.RecordBatch.from_arrays([pa.array(stripe * STRIPE + codes // wide), pa.array(codes % wide), pa.array(n), pa.array(n == most[codes // wide])], names=["a", "b", "documents", "best"])

    return found["counts"].mapInArrow(read, "a long, b long, documents long, best boolean")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    space + text is cut by a byte-level vocabulary (path_a) and a piece model (path_b), special tokens being plain
    text. Offsets where tokens of both end cut them into groups; within one all occurrence pairs are links. A pair's count
    is the number of rows that hold it linked. Texts that are null or empty, or that a tokenizer does not give back byte
    for byte, have zeros and ''. Equal counts are all highest. Repeated rows and null keys are rows like others and
    each counts as a document; very long texts go some chunks at a time; an empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    found = link_tokens(docs, path_a, path_b, key, text)
    wide, kind = len(aligner(path_a, path_b).bytes_b), docs.schema[key].dataType.simpleString()
    counts = found["counts"].select("stripe", F.explode(F.sequence(F.lit(0), F.lit(found["salts"] - 1))).alias("salt"), F.lit(None).cast("long").alias("batch"), "blobs")
    asked = counts.unionByName(found["requests"]).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").asc_nulls_first())
    answers = asked.select("stripe", "salt", "batch", "blobs").mapInArrow(lambda b: _answer(b, wide), "batch long, stripe int, blobs array<binary>")
    none = lambda t: F.lit(None).cast(t)
    each = answers.select("batch", "stripe", none(f"array<{kind}>").alias("ids"), none("array<string>").alias("said"), "blobs").unionByName(found["links"].withColumn("stripe", none("int")))
    met = each.repartition("batch").sortWithinPartitions("batch", F.col("stripe").asc_nulls_last()).select("batch", "stripe", "ids", "said", "blobs")
    out = stash(met.mapInArrow(lambda b: _score(b, key), f"{key} {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string"), "aligned")
    unstash(found["written"])
    unstash(found["counts"])
    return out
