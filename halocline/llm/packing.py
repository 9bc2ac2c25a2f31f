"""Lexical retrieval packing: related documents share a window.

Documents become token ids once and are kept as a written table. They are dealt by ranges of a signature (their rarest
token ids, the key breaking ties, so copies can fill many ranges) into shards of a bounded number of tokens. Each
shard has an inverted index with BM25 weights, whose document frequencies and mean length are those of the whole
corpus and have a size that the vocabulary fixes. A shard's documents are seeds in turn: a window starts with a seed
and is filled greedily with the unused neighbours that the index returns for it, best first; when it has none left,
with the next unused documents. A document that does not fit is cut, and its rest starts the next window. What
remains at a shard's end is cut into sequences of powers of two, which need no padding.

Cases: null and empty texts consist of the end-of-document id alone. Rows that repeat an id are packed each, and their
pieces are alike. A null id is kept. Very long documents fill as many windows as they need. An empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, lean, slices, table, written

# a word's last comma or full stop after a letter or digit is a token of its own; letters: those of ASCII, and of Latin-1 in lower case
_MARK, _BEFORE, _SPACE, _LATIN = 1, 2, 4, 8
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_MARK, b",."), (_BEFORE, bytes([*range(48, 58), *range(65, 91), *range(97, 123)])), (_SPACE, b" \t\n\x0b\x0c\r"), (_LATIN, bytes([*range(0x9F, 0xB7), *range(0xB8, 0xC0)]))):
    _KINDS[list(_bytes)] = _kind
# words of printable ASCII and such letters, without upper case, and without < that may begin a special token
_SIMPLE = re.compile(rb"(?:[!-;=-@\[-`a-z{-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# the tokenizer's own rule for what is encoded apart (fixed values), for such words
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^a-z0-9\xc3]+")
# the characters by which byte-level models know bytes that do not print: from 256 on, in order
_SHOWN = {byte: 256 + n for n, byte in enumerate([*range(33), *range(127, 161), 173])}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingParameters:
    tokenizer: str = "word_bpe_49k.json"  # a name in the public tokenizers' folder, or a path
    end: int = 2  # id that ends each document
    window: int = 4096
    shard_tokens: int = 2_000_000
    query_terms: int = 24
    k1: float = 1.2
    b: float = 0.75
    remembered_words: int = 800_000
    single_words: int = 250_000  # of words that only one slice of texts had so far, about how many are remembered


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers words in the order of their first look-up and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _apart(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """texts with a space before each comma or full stop that ends a word and is a token of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _KINDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(kinds == _MARK)
    last = edge[at + 1] | (kinds[np.minimum(at + 1, len(data) - 1)] == _SPACE)
    after = (kinds[at - 1] == _BEFORE) | (kinds[at - 1] == _LATIN) & (data[at - 2] == 0xC3)
    at = at[last & after & ~edge[at]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(at, offsets)), pa.py_buffer(np.insert(data, at, 32)))


#: texts that tell whether a tokenizer lowers case and cuts words as the encoder does
PROBES = ("Plain words, and MORE of them.", "don't we'll 's a.b,c 12,3. x_y (z) -- ... #1!", "Über naïve señor, été. ÿ ß ÀÉ ÷ a\u0301", "中文。 ١٢ İ ŉ 😀 ½ \x00 \x85", "a<b <|x|> <|endoftext|>", "tab\tnew\nline  two   spaces ")


class Encoder:
    """Token ids of texts; words between ASCII white space, which no token crosses, are encoded once and remembered.

    Most words of a corpus are met once, so those that no second slice of texts had are forgotten again and again, and
    encoded anew if they come back. Of a tokenizer that does otherwise, as probes tell, every text is encoded whole.
    """

    def __init__(self, p: PackingParameters):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.single, self.end = Tokenizer.from_file(tokenizer_path(p.tokenizer)), p.remembered_words, p.single_words, p.end
        self._forget()
        self.by_word = True
        self.by_word = all(x.tolist() == self._whole(t).tolist() for x, t in zip(self(list(PROBES)), PROBES, strict=True))

    def _whole(self, text: str | None) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text or "", add_special_tokens=False).ids, self.end], np.uint32)

    def _forget(self) -> None:
        """Only the end-of-document id is known, as the word that no text has: number 0."""
        self.numbers = _Numbers()
        self.numbers[b""] = 0
        self.ids, self.first, self.length = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.again = np.ones(1, bool)  # whether a second slice had the word

    def _forget_single(self) -> None:
        """Only words that a second slice had are known."""
        kept = np.flatnonzero(self.again)
        numbers = type(self.numbers)()
        numbers.update(zip(compress(self.numbers, self.again.tolist()), range(len(kept)), strict=True))
        self.numbers, self.again = numbers, np.ones(len(kept), bool)
        self.ids, ends = self._of(kept)
        self.length = self.length[kept]
        self.first = ends - self.length

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if not texts:
            return []
        if len(self.again) - np.count_nonzero(self.again) > self.single:
            self._forget_single()
        if len(self.numbers) > self.most:
            self._forget()
        # the tokenizer lowers case itself; only its special tokens, which begin with <|, tell cases apart
        given = pc.ascii_trim_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        words = pc.ascii_split_whitespace(_apart(pc.if_else(pc.match_substring(given, "<|"), given, pc.ascii_lower(given))))
        # only distinct words are looked up; an empty text has one word, the empty one, which is the end of a document
        distinct = words.flatten().dictionary_encode()
        known = distinct.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.__getitem__, known), np.int64, len(known))
        self.again[numbers[numbers < len(self.again)]] = True
        numbers = numbers[distinct.indices.to_numpy()]
        self._learn()
        some = pc.not_equal(given, "").to_numpy(zero_copy_only=False)
        sizes = np.diff(words.offsets.to_numpy())
        numbers = np.insert(numbers, np.cumsum(sizes)[some], 0)
        sizes = sizes + some
        ids, ends = self._of(numbers)
        return np.split(ids, ends[np.cumsum(sizes) - 1][:-1])

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, and where each word's end."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.first[numbers] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self) -> None:
        """Encodes the new words and appends their ids."""
        numbers = self.numbers
        found: list = [()] * len(numbers.new)
        for i in self._encode(numbers.new, found):
            found[i] = self.tokenizer.encode(numbers.new[i].decode(), add_special_tokens=False).ids
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))])
        self.again = np.concatenate([self.again, np.zeros(len(found), bool)])
        numbers.new.clear()

    def _encode(self, words: list[bytes], found: list) -> list[int]:
        """Sets the ids of most words and returns the places of those left."""
        tokenize, letters, rest = self.tokenizer.model.tokenize, [], []
        for i, w in enumerate(words):
            # normalising changes neither of these, and the model alone is left to apply to each piece
            if w.isalpha() and w.islower():
                found[i] = [t.id for t in tokenize(w.decode())]
            elif _SIMPLE.fullmatch(w):
                found[i] = [t.id for x in _PIECE.findall(w) for t in tokenize(x.decode("latin-1").translate(_SHOWN))]
            elif w.decode().isalpha():
                letters.append(i)
            else:
                rest.append(i)
        for at in range(0, len(letters), 500):
            # the tokenizer keeps each of these whole, so they can go together
            part = letters[at : at + 500]
            e = self.tokenizer.encode(b" ".join([words[i] for i in part]).decode(), add_special_tokens=False)
            of, ids = e.word_ids, e.ids
            if of[-1] != len(part) - 1:
                rest += part
                continue
            cut = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            for i, x, y in zip(part, cut, cut[1:], strict=False):
                found[i] = ids[x:y]
        return rest


def _largest(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of n ids each, the largest id and the next one, or the same one twice."""
    first, ids = np.cumsum(n) - n, ids.astype(np.int32)
    most = np.maximum.reduceat(ids, first)
    ids[ids == np.repeat(most, n)] = -1
    rest = np.maximum.reduceat(ids, first)
    return most, np.where(rest < 0, most, rest)


def tokenised(docs: DataFrame, p: PackingParameters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sig_a, sig_b (the two largest ids: the rarest by the vocabulary's order), n, ids as 16 or 32 bits each."""

    def run(batches):
        encode = None
        for part, texts in slices(batches, "text", 2_000_000):
            encode = encode or Encoder(p)
            ids = encode(texts)
            small = np.uint16 if encode.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.concatenate(ids)
            ends = np.concatenate([[0], np.cumsum(n)]) * np.dtype(small).itemsize
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype(small))])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int32()) for x in (*_largest(flat, n), n)), data],
                names=["doc_id", "sig_a", "sig_b", "n", "ids"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, sig_a int, sig_b int, n int, ids binary")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32)


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Over all documents, how many have each id; as long as the vocabulary."""

    def count(batches):
        total, place = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                ids, at = _ids(data, n), np.arange(n)
                if (most := int(ids.max())) >= len(total):
                    total, place = (np.concatenate([x, np.zeros(most + 1 - len(x), np.int64)]) for x in (total, place))
                place[ids] = at
                total[ids[place[ids] == at]] += 1  # one place of each distinct id
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})

    summed = tokens.select("n", "ids").mapInArrow(lean(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(1 + max([0, *summed.column("term").to_pylist()]), np.int64)
    out[summed.column("term").to_numpy()] = summed.column("df").to_numpy()
    return out


class Shard:
    """A BM25 inverted index of some documents, each of which a window can take once."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, p: PackingParameters):
        self.p = p
        length = np.array([len(x) for x in docs])
        pairs = np.repeat(np.arange(len(docs)) << 32, length) | np.concatenate(docs)
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf, pairs = np.diff(first, append=len(pairs)), pairs[first]
        terms, owner = pairs & 0xFFFFFFFF, pairs >> 32
        sizes = np.bincount(owner, minlength=len(docs))
        weight = (idf[terms] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length[owner] / mean))).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.terms, self.own, self.at = terms, weight, np.concatenate([[0], np.cumsum(sizes)])
        self.unused = np.ones(len(docs), bool)

    def neighbours(self, doc: int) -> np.ndarray:
        """Unused documents that share a heavy term with doc, best first, ties in order."""
        a, b = self.at[doc], self.at[doc + 1]
        take = np.argsort(-self.own[a:b], kind="stable")[: self.p.query_terms]
        scores = np.zeros(len(self.unused), np.float32)
        for t in self.terms[a:b][take]:
            s = slice(self.first[t], self.first[t + 1])
            scores[self.owner[s]] += self.weight[s]
        scores[~self.unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, p: PackingParameters) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); only the last can be short, and it comes cut into powers of two."""
    shard, following, rest, out = Shard(docs, idf, mean, p), 0, None, []
    while True:
        if rest is None:
            while following < len(docs) and not shard.unused[following]:
                following += 1
            if following == len(docs):
                break
            doc, start = following, 0
            shard.unused[doc] = False
        else:
            (doc, start), rest = rest, None
        window, space, queue, seed = [], p.window, None, doc
        while True:
            n = min(space, len(docs[doc]) - start)
            window.append((doc, start, n))
            space -= n
            if start + n < len(docs[doc]):
                rest = (doc, start + n)
            if not space:
                break
            if queue is None:
                queue = iter(shard.neighbours(seed))
            doc, start = next((int(d) for d in queue if shard.unused[d]), -1), 0
            if doc < 0:
                while following < len(docs) and not shard.unused[following]:
                    following += 1
                if following == len(docs):
                    break
                doc = following
            shard.unused[doc] = False
        out.append(window)
    if out:
        tail, used = out.pop(), 0
        total = sum(n for *_, n in tail)
        for bit in reversed(range(total.bit_length())):
            size, part = total & (1 << bit), []
            while size:
                doc, start, n = tail[used]
                take = min(n, size)
                part.append((doc, start, take))
                size -= take
                if take < n:
                    tail[used] = (doc, start + take, n - take)
                else:
                    used += 1
            if part:
                out.append(part)
    return out


def pack(docs: DataFrame, p: PackingParameters | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: where it stands in its document and in which sequence at which offset."""
    p = p or PackingParameters()
    with arrow_batches(docs.sparkSession, "4m"):
        tokens = written(tokenised(docs, p, key, text), "tokens")
    rows, total = tokens.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(tokens)
    idf = np.log1p((max(rows, 1) - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf, (total or 1) / max(rows, 1)))
    shards = max(1, math.ceil((total or 0) / p.shard_tokens))

    def run(batches):
        idf, mean = shared.value
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def done():
            nonlocal number
            ids, out = [x for _, x in held], []
            for sequence in fill(ids, idf, mean, p):
                offset = 0
                for doc, start, n in sequence:
                    crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
                    out.append((held[doc][0], start, n, crc, len(ids[doc]), base + number, offset))
                    offset += n
                number += 1
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc, _ids(data, n)))
                size += n
                if size >= 2 * p.shard_tokens:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return tokens.repartitionByRange(shards, "sig_a", "sig_b", "doc_id").sortWithinPartitions("sig_a", "sig_b", "doc_id", "n").mapInArrow(lean(run), PIECE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"))
