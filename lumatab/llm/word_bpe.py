"""BPE encoding and decoding with a word lexicon (operator 5).

All words of the corpus are counted; the most frequent ones (a documented bound on their number) are merged
once and compiled with their ids into a minimal acyclic transducer (lexicon.py), which every Python worker
maps. Encoding looks words up there; any other word is merged exactly by the file's merge ranks. Results
equal the tokenizers library's: special tokens in a text first, then its normaliser and word pattern; texts
with characters outside the Latin blocks take the library's own normaliser and splitter.

Defined cases: a null or empty text has no ids and decodes to the empty string; a word of any length is
merged by a heap; repeated rows and ids are encoded one by one; an empty table gives no rows; only id and
text are read (and the columns asked for in `keep`).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatab.llm import shared
from lumatab.llm.lexicon import Lexicon, compile_words
from lumatab.llm.token_files import byte_symbols

#: Outside these characters lower-casing, composition or character classes may differ between libraries.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧]")
#: The file's word pattern over those characters, lower-cased.
_WORDS = re.compile("[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9ªµºß-öø-ſ²³¹¼-¾]+")
#: Words that a worker remembers between batches.
MEMO = 400_000
#: Words compiled into the lexicon, at most, and their length in bytes; longer ones are merged like rare ones.
LEXICON = 131_072
LEXICON_BYTES = 64


class Merges:
    """The vocabulary file: splitting, exact merging and decoding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["byte_fallback"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a word-level BPE file of the supported kind")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path}: another normaliser or splitter than the ones supported")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens: list[bytes] = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self._bytes = byte_symbols()
        self._chars = {b: c for c, b in self._bytes.items()}
        self._whole = Tokenizer.from_file(path)

    def split(self, text: str) -> list[str]:
        """A text's words, normalised; a special token stands for itself."""
        if self._special and any(s in text for s in self.special):
            out: list[str] = []
            for part in self._special.split(text):
                out += [part] if part in self.special else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _WORDS.findall(text.lower())
        found = self._whole.pre_tokenizer.pre_tokenize_str(self._whole.normalizer.normalize_str(text))
        return [bytes(map(self._bytes.__getitem__, w)).decode() for w, _ in found]

    def merge(self, word: str) -> list[int]:
        """A word's ids: the pair of lowest rank, the leftmost of these, merges until none is left."""
        if word in self.special:
            return [self.special[word]]
        chars = [self._chars[b] for b in word.encode()]
        chars[-1] += self.suffix
        ids = [self.vocab[c] for c in chars if c in self.vocab]
        ranks = self.ranks
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                r = ranks.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the library's decode with skip_special_tokens=False: the file has no decoder, so tokens joined by a space."""
        return b" ".join(map(self.tokens.__getitem__, ids))


class _Numbers(dict):
    """Gives every new word the next number and notes it."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes batches of texts; remembers a bounded number of words."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None) -> None:
        self.merges, self.lexicon = merges, lexicon
        self._forget()

    def _forget(self) -> None:
        self.memo = _Numbers()
        self.ends, self.flat = array("q", [0]), array("I")

    def _learn(self, new: list[str]) -> None:
        place = self.lexicon.find([w.encode() for w in new]).tolist() if self.lexicon is not None else [-1] * len(new)
        for w, p in zip(new, place, strict=True):
            self.flat.extend(self.lexicon.output(p).tolist() if p >= 0 and w not in self.merges.special else self.merges.merge(w))
            self.ends.append(len(self.flat))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends): the ids of some texts in order, and where each text's ids end."""
        words: list[str] = []
        counts: list[int] = []
        for t in texts:
            got = self.merges.split(t) if t else []
            words += got
            counts.append(len(got))
            if len(words) > 250_000:
                yield self._ids(words, counts)
                words, counts = [], []
        if counts:
            yield self._ids(words, counts)

    def _ids(self, words: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO:
            self._forget()
        slot = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if self.memo.new:
            self._learn(self.memo.new)
            self.memo.new = []
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        begin = ends[slot]
        size = ends[slot + 1] - begin
        upto = np.cumsum(size)
        ids = flat[np.repeat(begin - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.concatenate([[0], upto])[np.cumsum(counts)]


@cache
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def encoder_of(path: str, lexicon: str | None) -> Encoder:
    return Encoder(merges_of(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def count_words(docs: DataFrame, path: str, text_col: str = "text", held: int = 300_000) -> DataFrame:
    """(word, n) over all texts. A task adds its words up in a table of bounded size before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = merges_of(path).split, Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    seen.update(split(t))
                    if len(seen) > held:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON) -> str | None:
    """Counts all words, compiles the most frequent ones and ships the file to the executors; its name there.

    The words are those at least as frequent as a bound, chosen from a histogram of counts by sixteenths of
    a doubling so that at most `size` words pass; no sort, and no more than that reaches the driver.
    """
    spark = docs.sparkSession
    counts, at = shared.written(count_words(docs, path, text_col).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    total, bound = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 levels
        total += row["count"]
        if total > size:
            break
        bound = row["level"]
    words = [] if bound is None else [r["word"] for r in counts.where(level >= bound).select("word").collect()]
    shared.drop(spark, at)
    if not words:
        return None
    merges = merges_of(path)
    data = compile_words({w.encode(): merges.merge(w) for w in words if w not in merges.special})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.lex"
    if not any(f.endswith("/" + name) for f in spark.sparkContext.listFiles):  # the same words again: the same file
        path = f"{shared.home(spark)}/{name}"
        shared.store(spark, path, data)
        spark.sparkContext.addFile(path)  # every executor gets it from the shared folder
    return name


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns in keep, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids as array<int>) per row."""
    lexicon = build_lexicon(docs, path, text_col, size)
    taken = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in taken)
    names = [*taken, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(path, lexicon)
        for b in batches:
            done = 0
            for ids, ends in coder.encode(b.column(len(taken)).to_pylist()):
                starts = [0, *ends[:-1].tolist()]
                ids = ids.astype("<u4", copy=False)
                digests, texts = [], []
                for i, j in zip(starts, ends.tolist(), strict=True):
                    own = ids[i:j]
                    digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                    texts.append(hashlib.sha256(coder.merges.decode(own.tolist())).hexdigest())
                k = len(digests)
                out = [*(b.column(c).slice(done, k) for c in range(len(taken))), pa.array(ends - starts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                done += k
                yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(*taken, F.col(text_col).cast("string").alias("_text_"))
    return source.mapInArrow(run, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the decoded text of each id list (null for null)."""
    back = F.udf(lambda ids: None if ids is None else merges_of(path).decode(list(ids)).decode(), "string", useArrow=True)
    return rows.withColumn(out_col, back(F.col(ids_col)))
