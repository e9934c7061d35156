"""Exact token ids of a vocabulary file, and token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import small_batches, stash

#: Chunks outside plain Latin text whose ids a worker remembers; beyond it the memory is emptied, so it stays bounded.
CACHE_CHUNKS = 200_000
#: Longest chunk that is remembered.
CACHE_CHARS = 48
#: Longest chunk, in bytes, that is split into words here.
PLAIN_BYTES = 1000
#: Chunks that are looked at together, each different one once.
TOGETHER = 1 << 20
#: Chunks of these characters only are unchanged by NFC and lower-cased alike everywhere.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: The vocabulary's split pattern, and what it comes to in plain, lower-cased chunks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+"
#: Set after each word in place of the vocabulary's suffix for ends of words; no plain chunk has it.
_MARK = "\x01"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _spread(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat`, which are of these sizes, in the order of `index`, and their sizes."""
    n = sizes[index]
    return flat[np.repeat((np.cumsum(sizes) - sizes)[index] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _joined(each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and the number of each entry's."""
    return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4


class WordEncoder:
    """Ids as the library gives them, a column of texts at a time.

    For a vocabulary that drops white space, a text's ids are its white-space-free chunks' ids end to end. A column's
    different chunks of plain Latin letters, ASCII digits and signs are split into words and merged all together, by
    rank; where the file's merges do not allow that, and for chunks with other characters or a special token's opening,
    the library is asked. It also gets whole texts where the file's steps are not the ones this holds for.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        raw = open(path, encoding="utf-8").read()
        self.version = hashlib.sha256(raw.encode()).hexdigest()[:16]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = json.loads(raw)
        names = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_chunk = names == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0].get("invert") is True and not any(x["lstrip"] or x["rstrip"] or x["normalized"] for x in steps["added_tokens"])
        self.ranked = self._ranked(steps["model"]) if self.by_chunk and split[0]["pattern"] == {"Regex": _SPLIT} else None
        self.chunks: dict[str, bytes] = {}

    def _ranked(self, model: dict):
        """Merges by the rank of what results, with _MARK for the suffix; None where that may differ from the library's.

        They agree where ids grow with the rank of their only merge, come after all single letters, and every entry is
        what the library makes of its own letters: then no other two neighbours can ever form an entry.
        """
        import tiktoken

        suffix, vocabulary, letters = model.get("end_of_word_suffix"), model.get("vocab", {}), _byte_letters()
        if model["type"] != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return None
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        single = [vocabulary.get(x + end, len(vocabulary)) for x in letters.values() for end in ("", suffix)]
        back = {ord(x): byte for byte, x in letters.items()}
        alone = letters[ord(_MARK)]  # ends words in which nothing merges with it
        ranks = {}
        for piece, i in vocabulary.items():
            ends, part = piece.endswith(suffix), piece.removesuffix(suffix)
            if not all(ord(x) in back for x in part) or (len(part) > 1 and alone in part):
                return None
            tokens = self.library.model.tokenize(part if ends else part + alone)
            if [x.id for x in tokens] != ([i] if ends else [i, vocabulary.get(alone + suffix)]):
                return None
            ranks[part.translate(back).encode("latin-1") + _MARK.encode() * ends] = i
        if merged != sorted(set(merged)) or max(single) >= min(merged, default=len(vocabulary)) or not len(single) + len(merged) == len(ranks) == len(vocabulary):
            return None
        self.gap = ranks[b"\n" + _MARK.encode()]
        return tiktoken.Encoding("ranked", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self._library(chunk)
            if len(chunk) <= CACHE_CHARS:
                if len(self.chunks) >= CACHE_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks end to end, and their numbers."""
        marked = pc.replace_substring_regex(pc.utf8_lower(chunks), _PLAIN_SPLIT, "\\0" + _MARK)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), "\n" + _MARK)[0].as_py()
        ids = np.array(self.ranked.encode_ordinary(whole), "<u4")
        gaps = ids == self.gap
        return ids[~gaps], np.diff(np.concatenate([[-1], np.flatnonzero(gaps), [len(ids)]])) - 1

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks end to end, and their numbers; each different chunk is looked at once."""
        coded = chunks.dictionary_encode()
        fresh = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(fresh, _PLAIN), pc.and_not(pc.less_equal(pc.binary_length(fresh), PLAIN_BYTES), pc.match_substring(fresh, "<|")))
        is_plain = plain.to_numpy(zero_copy_only=False) & (self.ranked is not None)
        parts = [_joined([self._chunk(c) if c else b"" for c in fresh.filter(pa.array(~is_plain)).to_pylist()])]
        if is_plain.any():
            parts.append(self._plain(fresh.filter(pa.array(is_plain))))
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.empty(len(fresh), np.int64)
        place[np.concatenate([np.flatnonzero(~is_plain), np.flatnonzero(is_plain)])] = np.arange(len(fresh))
        return _spread(flat, sizes, place[coded.indices.to_numpy()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end (null: none), as little-endian unsigned 32-bit numbers, and where each text's end."""
        if not self.by_chunk:
            ids, n = _joined([self._library(t) if t else b"" for t in texts.to_pylist()])
            return ids, np.cumsum(n)
        rows = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        parts = [self._chunks(rows.values.slice(k, TOGETHER)) for k in range(0, len(rows.values), TOGETHER)]
        if not parts:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids, np.concatenate([[0], np.cumsum(n)])[rows.offsets.to_numpy()[1:]]

    def ids(self, text: str | None) -> bytes:
        """One text's ids as little-endian unsigned 32-bit numbers."""
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def counter(path: str) -> tuple[str, Callable[[pa.Array], np.ndarray]]:
    """A version name and a function that counts the tokens of each of a column's texts, for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        with open(path, "rb") as f:
            version = hashlib.sha256(f.read()).hexdigest()[:16]
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return version, lambda texts: np.array([len(model.encode(t, num_threads=1)) for t in texts.to_pylist()], np.int64)
    own = encoder(path)
    return own.version, lambda texts: np.diff(own.encode(texts)[1], prepend=0)


def drops_space(path: str) -> bool:
    """Whether runs of white space between words have no tokens in this file's vocabulary."""
    return not path.endswith(".model") and encoder(path).by_chunk


def normalised(text: Column, path: str) -> Column:
    """The text (null: empty) without differences that its count can't show: runs of ASCII white space are one space, none is at its ends."""
    whole = F.coalesce(text, F.lit(""))
    return F.btrim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")) if drops_space(path) else whole


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of one version in the cache folder; None where nothing is stored yet. Other faults are raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest string, n_tokens long").parquet(f"{cache}/version={version}").dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row: encode each distinct text that `cache` has no count for, once.

    cache: folder of Parquet rows (digest, n_tokens), one subfolder for each tokenizer version, in shared storage.
    Digests of normalised content are joined to the version's stored counts; only distinct misses are encoded, and
    their counts are appended. Without a cache only the call's own repeats are saved. Null texts count as empty (0). Repeated rows and null keys come back as often as they came. An empty table gives an
    empty result. Columns besides key and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version, _ = counter(path)
    rows = docs.select(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), normalised(F.col(text), path).alias("text")).withColumn("digest", F.md5("text"))
    misses = rows.select("digest", "text").dropDuplicates(["digest"])
    known = stored_counts(spark, cache, version) if cache else None
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")

    def encode(batches):
        _, count = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)), pa.int64())], names=["digest", "n_tokens"])

    fresh = misses.mapInArrow(encode, "digest string, n_tokens long")
    if cache:
        fresh.write.mode("append").parquet(f"{cache}/version={version}")
        counts = stored_counts(spark, cache, version)
    else:
        counts = stash(fresh, "token-counts")
    return rows.select("key", "digest", "n_bytes").join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
